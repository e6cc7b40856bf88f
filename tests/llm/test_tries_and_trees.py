"""Prefix trie of conversations, alignment of tokenizers, exact search in an M-tree."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import mtree as MT
from factorlake.llm import prefix_trie as PT
from factorlake.llm import tokenizer_alignment as TA


# --- prefix trie ---


def plain_rebuilt(rows, every=100, most=5):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t if t is not None else 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = turns.get(c - c % every, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        return [p] + [x for c in children[p] for x in below(c)]

    out = []
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), sum(not children[x] for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("k1", F.lit(1))
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return df, PT.op11_prefix_trie(spark, str(tmp_path))


@pytest.mark.parametrize("stretch,long", [(4096, 250_000), (3, 20)])
def test_trie(spark, tmp_path, monkeypatch, stretch, long):
    monkeypatch.setattr(PT, "STRETCH", stretch)
    monkeypatch.setattr(PT, "LONG", long)
    r = np.random.default_rng(stretch)
    rows = []
    for c in [*range(0, 260), 1000, 1001, 999_999, 123_456_789]:
        for t in range(int(r.integers(1, 9))):
            rows.append((c, t, str(r.choice(["user", "bot"])) if t % 3 else None, f"text {r.integers(0, 2)} é" if t else None))
    rows += [(5, None, "system", "first"), (None, 1, "user", "of no conversation"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (8, 1, "", "")]
    rows += [(400, t, "user", "deep" if t < 11 else f"t{t}") for t in range(30)] + [(401, t, "user", "deep") for t in range(40)]
    df, out = trie_of(spark, rows, tmp_path)
    got = sorted(str(tuple(x)) for x in out.select(*NAMES).collect())
    assert got == plain_trie(plain_rebuilt(rows))


def test_trie_edges(spark, tmp_path):
    df, out = trie_of(spark, [], tmp_path)
    assert out.columns == NAMES and out.count() == 0
    # one conversation that rebuilding leaves without a turn still is a member of the root
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    df, out = trie_of(spark, [(c, 0, "user", "x")], tmp_path)
    assert [tuple(x)[:7] for x in out.collect()] == [(c, 0, None, 1, 0, 1, 0)]
    assert out.first().ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    with duckdb.connect() as db:
        db.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
        want = db.execute(PT.OP11_SQL)
        names = [x[0] for x in want.description]
        want = sorted(str(tuple(x)) for x in want.fetchall())
    assert sorted(str(tuple(x)) for x in PT.op11_prefix_trie(spark, d).select(*names).collect()) == want


# --- alignment ---


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as T

    return T.path("byte_bpe_50k.json"), T.path("piece_bpe_32k.model")


TEXTS = [
    "Plain words, and more words.", "", None, "  two  spaces\n\n and\ttabs ", "don't we'll I'm", "é日本 ﬁ é 🙂", "a▁b", "<s> <|endoftext|> <unk> <0x41>", "\x00\x1c\x85\xa0　x", "words words words",
    "12345 67.89 -1", " lead", "trail ", " ", "\n", "x" * 3000, "the the the", "ab​cd", "Ünïcödé tèxt", "\U00010D5A x",
]


def plain_alignment(aligner, text):
    if not text:
        return "", 0, 0, []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return "", 0, 0, []
    a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
    groups, i0, j0 = [], 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        i, j = sum(e <= end for e in a_ends), sum(e <= end for e in b_ends)
        groups.append((a[i0:i], b[j0:j]))
        i0, j0 = i, j
    links = [(x, y) for x, e in zip(a, a_ends) for y, f in zip(b, b_ends) if e == f]
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), len(a), len(b), links


def test_merge_with_empty_tokens():
    i, j = TA.merge(np.array([1, 3, 3, 6]), np.array([0, 3, 5, 6, 6]))
    assert i.tolist() == [3, 4] and j.tolist() == [2, 5]
    assert [x.tolist() for x in TA.merge(np.array([2]), np.array([2]))] == [[1], [1]]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_alignment(spark, files, sent):
    rows = [(i if i % 4 else 4, t, "clash", 1) for i, t in enumerate(TEXTS * 2)] + [(None, "no id", "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, pair long").repartition(3)
    out = TA.with_pair_counts(TA.alignments(df, *files), most_sent=sent).collect()
    aligner = TA.Aligner(*files)
    assert aligner.fast is not None
    plain = [(r[0], *plain_alignment(aligner, r[1])) for r in rows]
    count = Counter(x for *_, links in plain for x in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    want = [(i, n_a, n_b, len(g.split(";")) if g else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), g) for i, g, n_a, n_b, links in plain]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, want))
    none = TA.with_pair_counts(TA.alignments(df.where("false"), *files))
    assert none.count() == 0


def test_alignment_query(spark, sf, files):
    out = {r.doc_id: r for r in TA.op12_tokenizer_alignment(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    aligner = TA.Aligner(*files)
    assert len(out) == len(docs)
    for d in docs[:60]:
        if d.text and len(d.text) < 3000:
            g, n_a, n_b, links = plain_alignment(aligner, d.text)
            assert out[d.doc_id].groups_sha256 == (hashlib.sha256(g.encode()).hexdigest() if n_a else "")
            assert (out[d.doc_id].n_a, out[d.doc_id].n_links) == (n_a, len(links))


# --- M-tree ---


def plain_top(x, queries, top):
    out = []
    for i in queries:
        found = sorted((-sum(a * b for a, b in zip(v, x[i])), j) for j, v in x.items() if j != i and len(v) == len(x[i]))[:top]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("spread", [2, 300])
def test_mtree_is_exact(spark, spread):
    r = np.random.default_rng(spread)
    centre = r.integers(-250, 250, (12, 6))
    x = (centre[r.integers(0, 12, 900)] * r.uniform(0.2, 2, (900, 1)) + r.integers(-spread, spread + 1, (900, 6))).astype(int)
    x[100:400], x[7], x[401:420] = x[100], 0, -x[100]
    x = {i: v for i, v in enumerate(x.tolist())} | {2000: [1, 2], 2050: [3, 4], 2100: []}
    rows = [(i, v, 1) for i, v in x.items()] + [(0, x[0], 1), (3000, None, 1), (3050, [1, None, 2, 3, 4, 5], 1), (None, x[1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, d int")
    out = MT.top_products(df, df.where("vec_id % 50 = 0 or vec_id = 7"), 5, page_rows=100)
    assert sorted(map(tuple, out.collect())) == plain_top(x, [i for i in x if i % 50 == 0 or i == 7], 5)
    assert MT.top_products(df.where("false"), df, 5).count() == 0 and MT.top_products(df, df.where("false"), 5).count() == 0


def test_mtree_leaves_distances_out():
    r = np.random.default_rng(1)
    x = (r.standard_normal((30, 8))[r.integers(0, 30, 8000)] * 250 + r.standard_normal((8000, 8)) * 10).astype(np.int64)
    longest2 = float((x.astype(float) ** 2).sum(axis=1).max())
    page = MT.Page.build(np.arange(8000), x.astype("i4"), longest2)
    page = MT.Page.unpack(page.pack(), 8, "i4").open(MT.Scorer(int(abs(x).max()), 8))
    computed = []
    for i in range(0, 8000, 100):
        ids, scores, n = page.search(x[i : i + 1], np.array([i]), 5, np.array([np.inf]), longest2)[0]
        s = x @ x[i]
        s[i] = -(2**62)
        assert ids.tolist() == np.lexsort((np.arange(8000), -s))[:5].tolist()
        computed.append(n)
    assert np.mean(computed) < 0.7 * 8000, np.mean(computed)


def test_mtree_numbers(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf"), 0.0])], "vec_id long, e array<float>")
    assert [r.v for r in df.select(MT.whole_numbers(F.col("e")).alias("v")).collect()] == [[128, -1], None, None, None, None]
    with pytest.raises(ValueError):
        MT.Scorer(2**31, 2)
    assert MT.Scorer(2**20, 8).kind is np.float64
    x = np.array([[2**28] * 8, [2**28 - 1] * 8, [0] * 8])
    page = MT.Page.build(np.arange(3), x, 8.0 * 2**56).open(MT.Scorer(2**28, 8))
    (ids, scores, _), = page.search(x[1:2], np.array([1]), 2, np.array([np.inf]), 8.0 * 2**56)
    assert ids.tolist() == [0, 2] and scores.tolist() == [8 * 2**28 * (2**28 - 1), 0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mtree_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
        want = sorted(map(tuple, db.execute(f"select query_id, rank, vec_id, score from ({MT.OP13_SQL})").fetchall()))
    assert sorted(map(tuple, MT.op13_mtree(spark, d).select("query_id", "rank", "vec_id", "score").collect())) == want
