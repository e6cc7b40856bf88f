"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import ann
from factorlake.llm import embedding_dedup as ED
from factorlake.llm import mixing as MX
from factorlake.llm import pii


# --- vectors ---


def crowded(n=900, group=300, size=64, seed=0):
    """Unit vectors, of which `group` are different near copies of one."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    x[:group] = x[0] / np.linalg.norm(x[0]) + r.normal(size=(group, size)) * 0.2 / np.sqrt(size)
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return x, (u @ u.T >= 0.95).sum(axis=1) - 1


@pytest.mark.parametrize("chunk", [1024, 100])
def test_vectors_that_the_graph_misses_are_found_by_the_exact_pass(spark, chunk, monkeypatch):
    x, want = crowded()
    graph = ED._links
    monkeypatch.setattr(ED, "CHUNK", chunk)
    monkeypatch.setattr(ED, "_links", lambda *a: graph(*a).where("links % 3 = 0"))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    out = ED.near_vectors(df).toPandas().sort_values("vec_id")
    assert want[:300].min() > 30 and out.n_links.tolist() == want.tolist()
    assert (out.component_id[:300] == 0).all() and out.kept.sum() == 601


def test_audit_counts_each_vector_alike(spark):
    x = np.eye(8)[[0] * 20 + [1, 1, 2, 2]] + 1e-4 * np.arange(24)[:, None]
    own = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, v array<double>, copies long")
    links = spark.createDataFrame([(i, 19) for i in range(20)], "id long, n_links long")
    assert ED.audit_recall(own, links, 0.95) == pytest.approx(20 / 24)


# --- mixing ---


def test_small_sources_give_their_targets_beside_a_large_one(spark):
    sizes = {"a": 40_000_000, "b": 150, "c": 90, "d": 611, "e": 7, None: 45}
    rows = [(i, "a", 400_000) for i in range(100)]
    for s, n in sizes.items():
        rows += [(len(rows), s, min(13, n - at)) for at in range(0, n, 13)] if s != "a" else []
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").select("doc_id", "source", F.repeat(F.lit("w "), F.col("n")).alias("text"))
    out = MX.mix(df).toPandas()
    assert out["size"].sum() == sum(sizes.values()) and (out.taken <= 3 * out["size"]).all()
    for s, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5, s
    assert (out[out.source != "a"].taken == 3 * out[out.source != "a"]["size"]).all()


# --- personal data ---


def test_addresses_are_read_wherever_they_stand():
    model = pii.trained()
    found = lambda t: [(k, t[a:b]) for a, k, b in pii.model_spans([t], model)[0]]
    for t, form in [("write to jane at example.com", "jane at example.com"), ("mail jo_lee at host.example.com, thanks", "jo_lee at host.example.com"), ("anna [At] mail Dot com", "anna [At] mail Dot com"), ("jane at example.com", "jane at example.com")]:
        assert found(t) == [(0, form)], t
    for t in ["he sat at home. Then they left", "look at this", "see it at www.example.com", "a new data format"]:
        assert found(t) == [], t
    # what is found follows from what is around it, not from the place in the text
    form = "please mail jane.roe (at) mail.com now"
    before = "y" * 3 + " some words that stand before the place in every one of these texts, and a few more. "
    starts = set()
    for n in (0, 1, 31, 64, 65, 127, 128, 300, 4999, 60_000):
        off = n + len(before)
        starts.add(tuple((a - off, k, b - off) for a, k, b in pii.model_spans(["x" * n + before + form], model)[0]))
    assert starts == {((12, 0, 12 + len("jane.roe (at) mail.com")),)}


def test_all_that_may_be_a_form_is_read():
    r = np.random.default_rng(5)
    for _ in range(300):
        t = "".join(r.choice(["ab ", "cd, ", "12", "(at)", " at ", "@", ".com", " dot ", "x.y", "+1 ", "4111 1111 ", "\n", "AT"], 30))
        read = pii.places(t)
        for kind in range(4):
            for a in range(0, len(t), 3):
                for b in range(a + 6, min(len(t), a + 40), 5):
                    if pii._plausible(kind, t[a:b].strip(" \n.,;")) and t[a:b] == t[a:b].strip(" \n.,;"):
                        assert any(x <= a and b <= y for x, y in read), (t, t[a:b])


# --- search ---


def test_shares_looked_at_are_measured(spark):
    r = np.random.default_rng(0)
    for spread, most in ((1.0, 1.0), (0.05, 0.5)):  # without structure, and in tight clusters
        x = np.repeat(r.normal(size=(40, 32)), 50, axis=0) * (spread < 1) + spread * r.normal(size=(2000, 32))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        out = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=500).toPandas()
        hits = 0
        for q, g in out.groupby("query_id"):
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
        assert hits / (20 * 100) >= 0.93
        if most < 1:
            ids, level = np.arange(2000), ann._level(x, np.linalg.norm(x, axis=1).max())
            turn = next(ann.Forest(level).turns(ann._asked(x[:1])))
            s = x @ x[0]
            best = np.argsort(-s)[1:21]
            assert (np.searchsorted(np.sort(turn), turn[best], side="right") / len(ids)).max() < most


def test_a_graph_search_compares_a_part_of_the_pairs():
    r = np.random.default_rng(1)
    x = np.concatenate([c + 0.05 * r.normal(size=(10, 32)) for c in r.normal(size=(80, 32))])
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    graph = ED.robust_prune(u @ u.T)
    a, b, compared = ED.range_search(u, graph, np.array([0, 1]), 0.95)
    want = set(map(tuple, np.argwhere(u @ u.T >= 0.95).tolist()))
    assert len(set(zip(a.tolist(), b.tolist())) & want) >= 0.99 * len(want)
    assert compared < 0.6 * len(u) ** 2


def test_audits_are_told(spark):
    x, _ = crowded(600, 100)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    told = []
    ED.near_vectors(df, audits=told)
    assert told and told[-1]["dim"] == 64 and (told[-1]["recall"] >= ED.LEAST_RECALL or told[-1]["exact"])
