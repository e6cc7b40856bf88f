"""Mixing, URL filter, classifier, vectors, components and the pipeline."""

import fnmatch
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import ann
from factorlake.llm import embedding_dedup as ED
from factorlake.llm import mixing as MX
from factorlake.llm import quality as QL
from factorlake.llm import queries as LQ
from factorlake.llm import url_filter as UF
from factorlake.llm.common import heavy_join
from factorlake.llm.graph import components


# --- mixing ---


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def mix_frame(spark, sizes, seed=0):
    r, rows, i = np.random.default_rng(seed), [], 0
    for s, n in sizes.items():
        while n > 0:
            k = int(min(n, r.integers(1, 60)))
            rows.append((i, "w " * k, s, "clash", 1))
            n, i = n - k, i + 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target long")


def test_mixing(spark):
    sizes = {"b": 3000, "a": 20_000, "c": 400, None: 2500, "é": 900, "z": 9000}
    df = mix_frame(spark, sizes).coalesce(2)
    df = df.unionByName(spark.createDataFrame([(-1, None, "a", "", 1), (-2, " \n", "empty", "", 1)], df.schema))
    out = MX.mix(df).toPandas()
    want = plain_targets({**sizes, "empty": 0})
    total = sum(sizes.values())
    assert len(out) == df.count() and (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert g["size"].sum() == g.source_size.iloc[0] == {**sizes, "empty": 0}[s]
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert abs(g.taken.sum() - want[s]) <= max(20, 0.002 * total)
    again = MX.mix(df.repartition(5)).toPandas()
    assert sorted(zip(out.doc_id, out.taken)) == sorted(zip(again.doc_id, again.taken))


def test_mixing_edges(spark):
    df = mix_frame(spark, {"a": 500})
    assert MX.mix(df.where("false")).count() == 0
    one = MX.mix(df).toPandas()
    assert one.taken.sum() == 500 and (one.taken == one["size"]).all()
    assert MX.mix(df.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0
    same = df.withColumn("doc_id", F.lit(1))
    assert MX.mix(same).agg(F.sum("taken")).first()[0] == 500


def test_schedule_is_spread_out(spark):
    t = spark.createDataFrame([("a", 1000, 600.0), ("b", 1000, 300.0), ("c", 50, 100.0)], "source string, source_size long, target double")
    s = MX.schedule(t, 1, 1000).orderBy("slot").toPandas()
    assert len(s) == 1000 and s.slot.tolist() == list(range(1000))
    for n in (100, 377, 1000):
        share = s.head(n).source.value_counts()
        assert all(abs(share[k] - n * w) <= 4 for k, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)))
    for _, g in s.groupby("source"):
        assert g["rank"].tolist() == list(range(len(g)))
    c = s[s.source == "c"]
    assert (c.block_no == c["rank"] % 50).all() and (c.pass_no == c["rank"] // 50).all()


def test_mixed_documents(spark):
    df = mix_frame(spark, {"a": 3000, "b": 3000, "c": 3000}).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    plan = {r.doc_id: (r["size"], r.taken) for r in MX.mix(df).collect()}
    got = Counter()
    out = MX.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {i: n for i, (_, n) in plan.items() if n} == dict(got)


def test_mix_of_rows_that_repeat(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, _r string, n long"
    row = lambda i, t, s="a": (i, t, "en", s, len(t or ""), "clash", 7)
    rows = [row(1, "x y z")] * 50 + [row(1, "other words here")] * 3 + [row(None, "no id at all")] * 20 + [row(5, None), row(6, ""), row(7, " \n")] + [row(9, "b c", "b")] * 5 + [row(3, "d", None)]
    df = spark.createDataFrame(rows, cols)
    plan = MX.mix(df).toPandas()
    assert len(plan) == len(rows) and (plan.taken <= 3 * plan["size"]).all()
    for _, g in plan.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5
    out = MX.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text) and len(r.text.split()) > 0
        words[r.source] += len(r.text.split())
    assert dict(words) == {s: int(g.taken.sum()) for s, g in ((None if s != s else s, g) for s, g in plan.groupby("source", dropna=False))}
    assert MX.mixed_documents(df.where("false")).count() == 0
    assert MX.mixed_documents(df.where("doc_id > 4 and doc_id < 8")).count() == 0


def test_every_target_has_its_slots(spark):
    t = spark.createDataFrame([("a", 10_000, 6000.4, 6000), ("b", 9000, 3000.0, 3000), (None, 40, 3.0, 3), ("none", 10, 0.2, 0), ("c", 400, 1200.0, 1200)], "source string, source_size long, target double, need long")
    s = MX.filled_slots(t, 8).toPandas()
    assert s.slot.is_unique and s.slot.min() >= 0
    for name, need in (("a", 6000), ("b", 3000), (None, 3), ("c", 1200)):
        own = s[s.source.isna() if name is None else s.source == name].sort_values("slot")
        assert sorted(own["rank"]) == list(range(-(-need // 8)))
    assert "none" not in set(s.source)


def test_prefixes_of_the_mix(spark):
    """The mix is in the order of its slots, and each prefix of it is near the targets."""
    sizes = {"b": 30_000, "a": 60_000, "c": 30_000, None: 20_000}
    df = mix_frame(spark, sizes, 3).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    plan = MX.mix(df, block=64).toPandas()
    target = {None if s != s or s is None else s: g.target.iloc[0] for s, g in plan.groupby("source", dropna=False)}
    total = sum(target.values())
    out = [(r.source, len(r.text.split())) for r in MX.mixed_documents(df, block=64).collect()]
    assert sum(n for _, n in out) == int(plan.taken.sum())
    got, done = Counter(), 0
    for source, n in out:
        got[source] += n
        done += n
        if done > 2000:
            assert all(abs(got[s] - done * target[s] / total) < 600 for s in target), (done, got)


def test_a_row_taken_very_often(spark, monkeypatch):
    monkeypatch.setattr(MX, "AT_ONCE", 7)
    df = spark.createDataFrame([(1, "x y z", "en", "a", 5)] * 60 + [(2, "p q", "en", "b", 3)] * 400, "doc_id long, text string, lang string, source string, n_chars long")
    plan, out = MX.mix(df, block=4), MX.mixed_documents(df, block=4)
    want = {r.source: r.w for r in plan.groupBy("source").agg(F.sum("taken").alias("w")).collect()}
    got = Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    assert dict(got) == want and sum(want.values()) == 980


# --- URLs ---


def test_automaton_against_fnmatch():
    r = np.random.default_rng(0)
    globs = ["*", "a*", "*b", "a?c", "*ab*", "a*b*c", "", "abc", "?", "*a?b*", "x" * 70 + "*", "*" + "y" * 70, "é*", "*ö?", "日"]
    texts = ["".join(r.choice(list("abc"), int(r.integers(0, 9)))) for _ in range(400)] + ["x" * 70, "x" * 90, "y" * 70, "z" + "y" * 70, "é", "aéc", "a" * 700 + "b", "öx", "éx", "日", "本"]
    hit = UF.ShiftAnd(globs).match(texts)
    for i, t in enumerate(texts):
        assert hit[i].tolist() == [fnmatch.fnmatchcase(t, g) for g in globs], t
    assert UF.ShiftAnd(globs).match([]).shape == (0, len(globs))


def test_urls(spark):
    cases = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "https://net/": ("net", "/", "net/", "block"),
        "https://net": ("net", "", None, "allow"),
        "https://notnet/": ("notnet", "/", None, "allow"),
        "https://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "https://m.example.com/den": ("m.example.com", "/den", None, "allow"),
        "ftp://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"),
        "https://x.org/a.net/fr/": ("x.org", "/a.net/fr/", None, "allow"),
        "https://x.org?a=b/fr/": ("x.org", "", None, "allow"),
        "http://casino-win.example.com/": ("casino-win.example.com", "/", None, "block"),
        "http://a|b.net/": ("a|b.net", "/", "net/", "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "long" * 2000 + ".net/x": ("long" * 2000 + ".net", "/x", "net/", "block"),
    }
    rows = [(i, u, "clash", "clash") for i, u in enumerate(cases)] + [(None, None, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in UF.filter_urls(df).collect()}
    for i, want in enumerate(cases.values()):
        assert got[i] == want
    assert UF.filter_urls(df.where("false")).count() == 0


# --- classifier ---


def test_classifier_on_held_out_rows(spark):
    t = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{t}/documents.parquet"), spark.read.parquet(f"{t}/labels.parquet")
    own = QL.grades(labels)
    train, held = own.where("doc_id % 4 != 0"), own.where("doc_id % 4 = 0")
    out = QL.score(docs, QL.fit_on(docs, train, 3), 2).join(held, "doc_id").toPandas()
    assert out[out.grade == 2].kept.mean() > 0.93
    assert out[out.grade == 0].kept.mean() < 0.15
    assert ((out.expected_grade >= out.tail_probability) & (out.expected_grade <= 2)).all()


def test_classifier_orders_grades():
    r = np.random.default_rng(0)
    x = r.integers(0, 3, 600)
    rows = [np.array([10 + g, 100 + int(r.integers(0, 50))], np.int32) for g in x]
    m = QL.fit(rows, x, 3)
    assert (np.diff(m.thresholds) >= 0).all()
    assert m.weights[10] < m.weights[11] < m.weights[12]
    above = m.above(np.array([m.weights[list(q)].sum() for q in rows]))
    assert (np.round(above.sum(axis=1)) == x).mean() > 0.95


def test_classifier_scores_and_gradient_against_plain_python(spark):
    import math
    import re
    import zlib

    def plain_features(text):
        raw = text.encode()
        words = re.sub(rb"[.,;:?\"()]", b"", bytes(c + 32 if 65 <= c <= 90 else c for c in raw)).split()
        kinds = set(words)
        hashed = {zlib.crc32(w) % QL.WIDTH for w in kinds} | {zlib.crc32(b"^" + w[:5]) % QL.WIDTH for w in kinds if len(w) > 5}
        n, size = max(1, len(words)), max(1, len(raw))
        count = lambda chars: sum(raw.count(bytes([c])) for c in set(chars))
        over = lambda x, cuts: len([c for c in cuts if x > c])
        levels = [
            over(len(kinds) / n, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) if n >= 20 else 9,
            over(count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, [0.01, 0.03, 0.06, 0.1, 0.2, 0.4]),
            over(count(b"!#$%&*+/<=>@[\\]^_`{|}~") / size, [0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1]),
            over(count(b"0123456789") / size, [0.0, 0.01, 0.03, 0.1, 0.3]),
            over(size / n, [2, 4, 5, 6, 7, 8, 10, 15]),
            over(n, [0, 5, 20, 100, 500, 2000]),
        ]
        return sorted(hashed) + [QL.WIDTH + 16 * i + x for i, x in enumerate(levels)]

    t = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{t}/documents.parquet"), QL.grades(spark.read.parquet(f"{t}/labels.parquet"))
    model = QL.fit_on(docs, labels, 3)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(QL.features(x).tolist() == plain_features(x) for x in texts.values())
    for r in QL.score(docs, model, 2).collect():
        s = sum(model.weights[i] for i in plain_features(texts[r.doc_id]))
        above = [1 / (1 + math.exp(c - s)) for c in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(above), abs=1e-9) and r.tail_probability == pytest.approx(above[1], abs=1e-9)
        assert r.kept == (r.tail_probability >= 0.5)
    # one step of the fit follows the gradient of the plain likelihood, by differences
    rows, y = [np.array([3, 4]), np.array([4]), np.array([3])] * 3, np.array([0, 1, 2, 1, 2, 0, 2, 0, 1])

    def loss(w, theta):
        total = 0.0
        for x, g in zip(rows, y):
            s = sum(w[i] for i in x)
            cdf = [0.0] + [1 / (1 + math.exp(s - c)) for c in theta] + [1.0]
            total -= math.log(cdf[g + 1] - cdf[g])
        return total / len(y)

    first = QL.fit(rows, y, 3, steps=1, batch=9, rate=1e-6, l1=0.0)
    start = [math.log(1 / 2), math.log(2)]
    for i in (3, 4):
        up = {3: 0.0, 4: 0.0} | {i: 1e-5}
        g = (loss(up, start) - loss({k: -v for k, v in up.items()}, start)) / 2e-5
        assert first.weights[i] == pytest.approx(-1e-6 * g / math.sqrt(1e-4 + g * g), rel=1e-3, abs=1e-12)
    for k in range(2):
        up, down = list(start), list(start)
        up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
        g = (loss({3: 0, 4: 0}, up) - loss({3: 0, 4: 0}, down)) / 2e-5
        assert first.thresholds[k] - start[k] == pytest.approx(-1e-6 * g / math.sqrt(1e-4 + g * g), rel=1e-3, abs=1e-12)


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x " * 20_000, 2), (2, "", 1)], "doc_id long, text string, kept int").withColumn("_q", F.lit(1)).withColumn("grade", F.lit(9))
    none = QL.score(df, None, 2)
    assert none.where("kept").count() == 4 and none.where("tail_probability is null").count() == 4
    lab = spark.createDataFrame([(1, 0), (2, 2), (None, 1), (2, None)], "doc_id long, grade int")
    model = QL.fit_on(df, lab, 3)
    out = QL.score(df, model, 2)
    assert out.count() == 4 and out.where("tail_probability between 0 and 1").count() == 4
    assert QL.score(df.where("false"), model, 2).count() == 0
    assert QL.fit_on(df, lab.where("false"), 3) is None
    assert set(out.columns) == {*df.columns, "expected_grade", "tail_probability"} and dict(out.dtypes)["kept"] == "boolean"
    # an id that repeats brings no more rows than the bound
    many = df.unionByName(spark.createDataFrame([(2, f"t {i}", 1, 1, 1) for i in range(300)], df.schema))
    assert QL.fit_on(many, lab, 3, sample_rows=50) is not None
    g = QL.grades(spark.createDataFrame([(1, 1, None), (2, None, 1), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int"))
    assert [r.grade for r in g.orderBy("doc_id").collect()] == [2, None, 1, 0]


# --- vectors ---


def vectors(spark, n=700, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16))
    for k in range(0, n // 2, 7):
        x[k : k + 5] = x[k] + 0.12 * r.normal(size=(5, 16))
    if n > 60:
        x[-60:] = x[-1] + 0.02 * r.normal(size=(60, 16))
        x[-10:] = x[-1]
    rows = [(i, [float(np.float32(v)) for v in row], "clash", 3) for i, row in enumerate(x)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]
    rows += [(n + i, b, "clash", 3) for i, b in enumerate(bad)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int"), np.array([row[1] for row in rows[:n]])


@pytest.mark.parametrize("chunk", [1024, 40])
def test_near_vectors(spark, chunk, monkeypatch):
    monkeypatch.setattr(ED, "CHUNK", chunk)
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    want = near.sum(axis=1) - 1
    label = np.arange(len(u))
    while True:
        new = np.where(near, label[None], len(u)).min(axis=1)
        if (new == label).all():
            break
        label = new
    out = ED.near_vectors(df).toPandas().sort_values("vec_id")
    assert len(out) == len(u) + 6
    ok = out.head(len(u))
    assert (ok.n_links.to_numpy() == want).mean() > 0.99 and ok.n_links.sum() >= 0.98 * want.sum()
    assert (ok.n_links.to_numpy() <= want).all()
    assert (ok.component_id.to_numpy() == label).mean() > 0.99
    assert (out.tail(6).n_links == 0).all() and out.tail(6).kept.all()
    assert (out.kept == (out.vec_id == out.component_id)).all()


def test_near_vectors_edges(spark):
    df, _ = vectors(spark, 14)
    assert ED.near_vectors(df.where("false")).count() == 0
    assert ED.near_vectors(df.where("vec_id >= 14")).where("n_links = 0 and kept").count() == 6
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in ED.near_vectors(two).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (None, 0, None)], key=str)


def test_nearest(spark):
    df, x = vectors(spark)
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=300).toPandas()
    hits = 0
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        assert q not in set(g.vec_id) and g["rank"].tolist() == list(range(1, 21))
        np.testing.assert_allclose(g.score, s[g.vec_id], atol=1e-12)
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        hits += len(set(order) & set(g.vec_id))
        assert (np.diff(g.score) <= 0).all()
    n = len(range(0, 700, 20))
    assert out.query_id.nunique() == n and hits / (20 * n) >= 0.9


def test_nearest_edges(spark):
    df, _ = vectors(spark, 6)
    out = ann.nearest(df, df.where("vec_id = 0"), 20).toPandas()
    assert sorted(out.vec_id) == [1, 2, 3, 4, 5]
    assert ann.nearest(df.where("false"), df, 20).count() == 0
    assert ann.nearest(df, df.where("vec_id > 6"), 20).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = ann.nearest(ties, ties.where("vec_id = 20"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2]


# --- shared parts ---


def test_components_of_paths_and_stars(spark):
    r = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 900)] + [(int(a), int(b)) for a, b in r.integers(1000, 1200, (90, 2))] + [(7, 7), (None, 8)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_join_is_a_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 5000 + list(range(2, 400)))], "k long, i long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k != 300")
    out = heavy_join(left, right, "k", "n", 5000)
    assert out.count() == 5000 + 397 and out.where("k = 1 and n = 5000").count() == 5000


def test_queries_agree_with_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    key = lambda d: sorted(json.dumps([None if v != v else v for v in r], default=int) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist())
    for name, sql in LQ.ORACLE_SQL.items():
        assert key(LQ.QUERIES[name](spark, sf).toPandas()) == key(c.execute(sql).fetchdf()), name


def test_near_vectors_agree_with_sql_where_there_are_links(spark, tmp_path):
    import duckdb

    df, _ = vectors(spark, 300)
    df.select("vec_id", "embedding").coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(ED.OP2_SQL).fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ED.near_vectors(df).collect()}
    assert got == want and sum(n for n, _, _ in want.values()) > 1000


@pytest.mark.parametrize("name", sorted(LQ.QUERIES))
def test_every_query_returns_rows(spark, sf, name):
    assert LQ.QUERIES[name](spark, sf).count() > 0


# --- pipeline ---


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as CP

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in CP.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert kept.schema == before.schema and kept.count() > 0
        if name != "mixing":
            assert kept.join(before, "doc_id", "left_anti").count() == 0 and kept.count() <= before.count()
    pieces = CP.STAGES[-1][1](spark, kept, sf)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert sorted(map(tuple, CP.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, pieces.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_against_plain_python(spark, tmp_path):
    from itertools import groupby

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as CP
    from factorlake.llm import simhash as SH

    from .test_text_operators import plain_components, plain_dedup

    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in r.integers(0, 5000, n))
    passage = "\n".join(text(8) for _ in range(9))
    own = [text(int(r.integers(5, 200))) for _ in range(25)]
    texts = own + [f"{text(6)}\n{passage}\n{text(6)}" for _ in range(5)] + own[:6] + [None, "", "  "]
    rows = [(i, t, "en", "ab"[i % 2] if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = CP.run(spark, str(tmp_path)).collect()

    clean = plain_dedup([(r[0], r[1]) for r in rows], 50)
    clean = {i: t for i, t in clean.items() if t == texts[i] or t.strip()}
    worded = sorted(i for i, t in clean.items() if t and t.strip())
    prints = [[int(f) for f in SH.fingerprint(clean[i], 5, 42, 2)] for i in worded]
    near = lambda a, b: min(bin(x ^ y).count("1") for x, y in zip(a, b)) <= 8 and sum(bin(x ^ y).count("1") for x, y in zip(a, b)) <= 30
    low = {i: i for i in worded}
    for a, i in enumerate(worded):
        for b in range(a):
            if near(prints[a], prints[b]):
                x, y = sorted((low[i], low[worded[b]]))
                low = {k: x if v == y else v for k, v in low.items()}
    stays = [(i, clean[i], "en", rows[i][3], len(clean[i])) for i in worded if low[i] == i]
    assert len(stays) < len(worded)
    mixed = MX.mixed_documents(spark.createDataFrame(stays, schema)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for m in mixed:
        want[m.doc_id] += len(t.encode(m.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    for _, g in groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        n = 0
        for p in g:
            assert p.offset == n
            n += p.length
        assert n <= 4096


@pytest.mark.parametrize("stage", ["quality", "line dedup", "simhash", "mixing", "packing"])
def test_pipeline_stages_on_odd_rows(spark, sf, stage):
    import corpus_pipeline as CP

    run = dict(CP.STAGES)[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _d string, n_removed string, _r string, n string"
    row = lambda i, t, s="s": (i, t, "en", s, len(t or ""), "k", "d", "r", "r", "n")
    rows = [row(1, "same words here and there\nand a second line"), row(1, "other words of the same id\nand its second line"), row(1, "same words here and there\nand a second line"), row(2, None), row(3, ""), row(None, "without an id"), row(None, None, None), row(4, "long " * 20_000), row(5, "x")]
    docs = spark.createDataFrame(rows, schema)
    out = run(spark, docs, sf)
    if stage != "packing":
        assert out.columns == docs.columns and out.count() <= 3 * len(rows)
    else:
        assert out.count() >= len(rows)
    assert run(spark, docs.where("false"), sf).count() == 0


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline as CP

    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["other"] + words[151:]
    texts = {0: " ".join(words), 1: " ".join(words), 2: " ".join(near), 3: " ".join(reversed(words)), 4: "", 5: None}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in CP.simhash(spark, docs, "").collect()} == {0, 3, 4, 5}
    passage = " ".join(words[:80])
    lines = spark.createDataFrame([(i, f"own text {i}\n{passage}", "en", "s", 1) for i in range(5)] + [(9, passage, "en", "s", 1)], docs.schema)
    out = {r.doc_id: r.text for r in CP.line_dedup(spark, lines, "").collect()}
    assert out[0].endswith(passage) and out[1] == "own text 1" and 9 not in out
