"""Token counts, packing, SimHash, personal data and line dedup against brute force, with their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorlake.llm import line_dedup as LD
from factorlake.llm import packing as PK
from factorlake.llm import pii
from factorlake.llm import simhash as SH
from factorlake.llm import token_counts as TC

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, n long, fp string, h string"
LONG_WORD = "x" * 3000


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, "s", 1, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " ", "a", "A  b\tc\n", "same text here once more", "same text here once more", LONG_WORD, "word " * 3000, "é ß 日本 🎉", "<|endoftext|> x", "line\nline\nline\nline"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# --- token counts ---


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, name):
    path = P.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(m.encode(x))
    for df in (docs.limit(60), frame(spark, EDGES)):
        texts = Counter((r.doc_id, r.text) for r in df.collect())
        want = Counter((i, len((x or "").encode()), count(x or ""), count(x or "") > 100) for i, x in texts.elements())
        assert Counter(tuple(r) for r in TC.token_counts(df, path, 100).collect()) == want


def test_token_counts_of_nothing(spark):
    out = TC.token_counts(frame(spark, []), P.path("byte_bpe_50k.json"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


# --- packing ---


def check_packing(rows, texts, room=(4096, 1024, 4096)):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in texts.items()}
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        n, segments, loss = bins.get(r.sequence_id, (0, 0, 0))
        assert r.offset == n
        bins[r.sequence_id] = (n + r.length, segments + 1, loss + r.loss_tokens)
    assert all(b <= m for x in bins.values() for b, m in zip(x, room))
    return [n for n, _, _ in bins.values()]


def test_packing(spark, docs):
    sizes = check_packing(PK.pack(docs, P.path("word_bpe_49k.json"), 2).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert all(n & (n - 1) == 0 for n in sizes)  # no padding at all
    assert sum(n == 4096 for n in sizes) > 0.8 * len(sizes)


def test_packing_edges_and_limits(spark):
    df = frame(spark, EDGES).coalesce(1).withColumn("share", F.when(F.col("doc_id") % 2 == 0, 0.25))
    texts = {r.doc_id: r.text for r in df.collect()}
    path = P.path("word_bpe_49k.json")
    check_packing(PK.pack(df, path, 2).collect(), texts)
    rows = PK.pack(df, path, 2, 64, 3, 20, loss_share_col="share").collect()
    check_packing(rows, texts, (64, 3, 20))
    bears = Counter()
    for r in rows:
        bears[r.doc_id] += r.loss_tokens
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert all(bears[i] == (round(n * 0.25) if i % 2 == 0 else n) for i, n in total.items())
    assert PK.pack(frame(spark, []), path, 2).count() == 0
    again = PK.pack(df, path, 2, 64, 3, 20, loss_share_col="share").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_without_an_id(spark):
    assert PK.pack(frame(spark, ["a", "b"], [None, None]), P.path("word_bpe_49k.json"), 2).where("doc_id is null").count() == 2


# --- SimHash ---


def plain_fingerprint(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, ids, most):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(fps))]


def test_simhash(spark, docs):
    assert plain_fingerprint("Only three Words") == SH.fingerprint("only three words")[0]
    for df in (docs.where("length(text) < 3000"), frame(spark, [t for t in EDGES if t != "word " * 3000])):
        rows = df.select("doc_id", "text").collect()
        fps = [plain_fingerprint(r.text) for r in rows]
        want = sorted(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], plain_components(fps, [r.doc_id for r in rows], 4)))
        assert sorted(map(tuple, SH.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_simhash_links_chains_and_large_buckets(spark):
    r = np.random.default_rng(0)
    fps = []
    for _ in range(60):
        x = int(r.integers(0, 2**63))
        for _ in range(int(r.integers(1, 8))):
            for b in r.integers(0, 64, int(r.integers(1, 6))):
                x ^= 1 << int(b)
            fps.append(x)
    base = int(r.integers(0, 2**63))
    fps += [base ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))) for _ in range(80)]
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f, [f]) for f in signed], "node long, fps array<long>")
    want = plain_components(fps, range(len(fps)), 4)
    from factorlake.llm.graph import components

    for chunk in (4096, 10):
        links = {x.node: x.component for x in components(SH.link_edges(df, 4, len(fps), chunk)).collect()}
        label = [links.get(s, s) for s in signed]
        groups = {}
        for i, x in enumerate(label):
            groups.setdefault(x, set()).add(i)
        other = {}
        for i, x in enumerate(want):
            other.setdefault(x, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_gray_index_finds_all_within_reach():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 1500, dtype=np.int64).view(np.uint64)
    flip = lambda n: np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
    x[800:1200] = x[0] ^ flip(400) ^ flip(400)
    assert (SH.gray_rank(x ^ (x >> np.uint64(1))) == x).all()
    for most, size in [(0, 1500), (2, 7), (4, 1500), (4, 90), (8, 400)]:
        key = np.arange(1500) // size
        order = np.lexsort((SH.gray_rank(x), key))
        v, k = x[order], key[order]
        index = SH.GrayIndex(v, np.bincount(key))
        # a bit stands in one node above a member, or is left for the member
        held = index.loose.copy()
        at = np.arange(1500)
        for first, many, _, own in index.levels:
            up = np.empty(len(at), np.int64)
            parent = np.repeat(np.arange(len(first)), many)
            up = parent[at]
            assert not (held & own[up]).any()
            held |= own[up]
            at = up
        assert (held == np.uint64(2**64 - 1)).all()
        q, m = index.search(v, k, most, np.arange(1500))
        near = (np.bitwise_count(v[:, None] ^ v) <= most) & (k[:, None] == k)
        assert sorted(zip(q, m)) == sorted(map(tuple, np.argwhere(np.triu(near, 1))))
        if size == 1500:
            a, b = SH.chunk_edges(v[:700, None], v[700:, None], most)
            got, want = np.arange(1500), np.arange(1500)
            SH._unite(got, a, b)
            SH._unite(want, *(p[(p0 < 700) & (p1 >= 700)] for p0, p1 in [np.nonzero(near)] for p in (p0, p1)))
            assert (got == want).all() and len(a) < 1500


def test_stretches_follow_from_the_number_of_fingerprints():
    assert [SH.stretches_to_agree(n, 4) for n in (10**3, 10**6, 10**8, 10**11)] == sorted(SH.stretches_to_agree(n, 4) for n in (10**3, 10**6, 10**8, 10**11))
    assert SH.stretches_to_agree(10**3, 4) == 1 and SH.stretches_to_agree(10**11, 4) > 2


def test_simhash_second_check_and_empty(spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:100] + ["changed"] + words[101:]
    df = frame(spark, [" ".join(words), " ".join(near), " ".join(reversed(words)), None, ""])
    out = {r.doc_id: r.component_id for r in SH.near_duplicates(df, 8, 5, more=2, total_bits=30).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert SH.near_duplicates(frame(spark, [])).count() == 0
    assert [r.component_id for r in SH.near_duplicates(frame(spark, ["a b c d e", "a b c d e"], [None, 5])).collect()] == [5, 5]


def test_near_copies_go_by_row_and_not_by_id(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(60)) for x in "abc")
    df = frame(spark, [a, b, b, c, c, a, None, "", " "], [1, 1, 2, 3, 3, None, 7, 7, 8])
    kept = sorted(((r.doc_id, r.text) for r in SH.drop_near_duplicates(df).collect()), key=str)
    # of id 1 both texts stay: each is the first of its own copies; the equal rows of id 3 become one
    assert kept == sorted([(1, a), (1, b), (3, c), (7, None), (7, ""), (8, " ")], key=str)
    assert SH.drop_near_duplicates(df).columns == df.columns
    nulls = SH.drop_near_duplicates(frame(spark, [a, a, b], [None, None, None])).collect()
    assert sorted(r.text for r in nulls) == [a, b]
    assert SH.drop_near_duplicates(frame(spark, [])).count() == 0


# --- personal data ---

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(s):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, s):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(v) <= 255 for v in m[0].split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    r = np.random.default_rng(2)
    letters = list("ab@@..+-1 234567890()\n1111@a.b")
    for _ in range(5000):
        s = "".join(r.choice(letters, 40))
        assert pii.base_spans(s) == plain_spans(s), s
    assert pii.base_spans("9" * 100_000 + ".1") == [] and pii.base_spans("a" * 100_000) == []


def test_pii_rows(spark, docs):
    for df in (docs, frame(spark, [*EDGES, "mail a.b@c.org or +1 (415) 555-0199, 10.0.0.1 and 4111 1111 1111 1111"])):
        rows = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        got = {r.doc_id: r for r in pii.find_pii(df).collect()}
        for i, t in rows:
            base = plain_spans(t or "")
            r, shown = got[i], ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
            spans = r.spans.split(",") if r.spans else []
            assert set(filter(None, shown.split(","))) <= set(spans) and len(spans) == len(base) + r.n_added
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_model_finds_what_patterns_miss():
    model = pii.trained()
    held = pii.labelled_texts(300, 77)
    found = pii.model_spans([t for t, _ in held], model)
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, held))
    # numbers without a right check digit are left out on purpose
    real = sum(k != 2 or pii.luhn(re.sub("[^0-9]", "", t[a:b])) for t, s in held for a, k, b in s)
    assert right / max(1, sum(map(len, found))) > 0.9
    assert right / real > 0.8
    t = "Please write to jane.roe (at) mail dot example dot com today."
    assert any(k == 0 for _, k, _ in pii.model_spans([t], model)[0])
    assert pii.model_spans(["nothing to see in these plain words", ""], model) == [[], []]


def test_gradients():
    x, y = pii.windows_of(pii.labelled_texts(4, 5))
    m = pii.BiLstmCrf()
    _, g = m.loss_and_grads(x[:4], y[:4])
    for k, v in m.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        v[at] += 1e-5
        up = m.loss_and_grads(x[:4], y[:4])[0]
        v[at] -= 2e-5
        down = m.loss_and_grads(x[:4], y[:4])[0]
        v[at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-4)


def test_training_lowers_the_loss_and_the_weights_are_stored():
    x, y = pii.windows_of(pii.labelled_texts(60, 5))
    losses = pii.BiLstmCrf().train(x, y, 3)
    assert losses[2] < losses[0] / 2
    assert {k: v.shape for k, v in pii.trained().p.items()} == {k: v.shape for k, v in pii.BiLstmCrf().p.items()}


def test_reading_agrees_with_training():
    m = pii.trained()
    x, _ = pii.windows_of(pii.labelled_texts(6, 8))
    s, _ = m.scores(x)
    np.testing.assert_allclose(m.states(x.T), s.transpose(1, 0, 2), atol=1e-3)
    # the best path of all, by brute force over a short stretch
    s = m.states(x[:3].T)[20:24]
    best = m.viterbi(s)
    trans = m.p["t"] + m.allowed
    from itertools import product

    for w in range(3):
        def worth(path):
            first = -1e4 if path[0] and path[0] % 2 == 0 else 0
            return first + sum(s[i, w, k] for i, k in enumerate(path)) + sum(trans[i, j] for i, j in zip(path, path[1:]))  # noqa: B023

        assert worth(best[w].tolist()) >= max(map(worth, product(range(pii.TAGS), repeat=4))) - 1e-3


def test_a_text_of_many_addresses():
    text = "".join(f"user{i} at host.com, " for i in range(20_000))
    assert len(pii.model_spans([text], pii.trained(), at_once=256)[0]) > 19_900
    spans, base = [(i, 0, i + 2) for i in range(0, 300_000, 3)], [(i, 1, i + 4) for i in range(0, 300_000, 9)]
    assert len(pii.untouched(spans, base)) == len([s for s in spans if s[0] % 9 == 6])
    assert pii.untouched([(0, 0, 5), (7, 0, 9)], [(1, 1, 2), (0, 2, 6)][::-1]) == [(7, 0, 9)]
    assert pii.untouched([(0, 0, 5)], []) == [(0, 0, 5)]


# --- line dedup ---


def i64(x):
    return int.from_bytes(x.to_bytes(8, "little"), "little", signed=True)


def plain_chunks(s, words=None):
    lines = s.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    n = len(lines)
    two = lambda a, b: i64(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)))
    r = [two(h[i], h[min(i + 1, n - 1)]) for i in range(n)]
    w = [words is not None and x.count(" ") >= words for x in lines]
    cut = [0] + [i for i in range(1, n) if (2 <= i < n - 1 and r[i] < r[i - 1] and r[i] < r[i + 1]) or w[i] or w[i - 1]]
    return ["\n".join(lines[a:b]) for a, b in zip(cut, [*cut[1:], n])]


def plain_dedup(rows, words=None):
    seen, out = set(), {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = None
            continue
        keep = []
        for c in plain_chunks(t, words):
            if "\n" in c or (words is not None and c.count(" ") >= words):
                if c in seen:
                    continue
                seen.add(c)
            keep.append(c)
        out[i] = "\n".join(keep)
    return out


def test_line_dedup(spark, docs):
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(12))
    own = [f"{'own %d\n' % i * (i % 3)}start {i}\n{passage}\nend {i}" for i in range(40)] + [" ".join(["w"] * 60)] * 3
    for df in (docs, frame(spark, own), frame(spark, EDGES)):
        for words in (None, 50):
            rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
            got = LD.dedup_lines(df, passage_words=words).collect()
            assert {r.doc_id: r.text for r in got} == plain_dedup(rows, words) and len(got) == len(rows)
            assert all(r.n_removed <= r.n_lines for r in got)
    cleaned = LD.dedup_lines(frame(spark, own))
    assert cleaned.agg(F.sum("n_removed")).first()[0] > 39 * 6
    assert cleaned.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_lines", "n_removed", "n_chunks_removed"]


@pytest.mark.parametrize("kinds", [1, 3])
def test_line_dedup_compares_bytes_where_hashes_collide(spark, docs, kinds):
    some = docs.limit(40).unionByName(docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10**6)).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    collide = lambda c: F.pmod(F.xxhash64(c), F.lit(kinds))
    assert {r.doc_id: r.text for r in LD.dedup_lines(some, hashed=collide).collect()} == plain_dedup(rows)
    alone = frame(spark, ["a\nb", "c\nd", "e\nf\ng", "a\nb"])
    assert [r.text for r in LD.dedup_lines(alone, hashed=collide).orderBy("doc_id").collect()] == ["a\nb", "c\nd", "e\nf\ng", ""]


def test_line_dedup_with_clashing_names(spark):
    names = ["n_lines", "n_removed", "n_chunks_removed", "_text", "_d", "_k", "_h", "_id", "_ks", "_goes"]
    df = frame(spark, ["a\nb", "a\nb"]).select("*", *[F.lit("own").alias(n) for n in names])
    out = LD.dedup_lines(df).orderBy("doc_id").collect()
    assert [(r.text, r.n_removed, r._text, r._goes) for r in out] == [("a\nb", 0, "own", "own"), ("", 2, "own", "own")]


def test_line_dedup_of_nothing_and_of_clean_texts(spark):
    assert LD.dedup_lines(frame(spark, [])).count() == 0
    clean = frame(spark, ["a\nb\nc", "d\ne", "f"])
    assert [r.text for r in LD.dedup_lines(clean).orderBy("doc_id").collect()] == ["a\nb\nc", "d\ne", "f"]
    # equal rows of one id keep the same; a null id comes after all others
    twice = frame(spark, ["x y\nz w\nq"] * 3, [1, 1, None])
    assert {(r.doc_id, r.text) for r in LD.dedup_lines(twice).collect()} == {(1, "x y\nz w\nq"), (None, "")}
    # of different texts of one id, one is the first place
    part, long = "same line a\nsame line b", " ".join(["w"] * 60)
    mixed = frame(spark, [f"{long}\n{part}", f"{part}\n{long}", f"{long}\n{part}"], [1, 1, 2])
    texts = [r.text for r in LD.dedup_lines(mixed, passage_words=50).orderBy("doc_id").collect()]
    assert sorted(texts, key=len) in ([["", "", f"{long}\n{part}"]] + [["", "", f"{part}\n{long}"]])


# --- addresses of any length ---


@pytest.mark.parametrize("form", ["{}@example (dot) com", "{} (at) example.com"])
def test_long_names_are_whole(form):
    """A name before the at has 1 to 64 characters; what the model adds is all of it."""
    name, model, missed = "jane.roe_smith-kowalska.of.the.northern.department.and.others12345", pii.trained(), []
    for n in range(1, 65):
        local = name[: n - 1].rstrip("._-").ljust(n, "x")
        address = form.format(local)
        text = f"Some words stand here before it and then: {address}, and more words follow after that."
        at = text.index(address)
        if (at, 0, at + len(address)) not in pii.model_spans([text], model)[0]:
            missed.append(n)
    assert len(missed) <= 1, missed


def test_plain_speech_is_no_address():
    texts = ["we look at paris.fr today", "Meet me at noon.com or stay at home.", "It is at www.x.com", "found at example.net yesterday", "they work at big-firm.co.uk now"]
    assert pii.model_spans(texts, pii.trained()) == [[]] * len(texts)
    assert pii.model_spans(["write jane.roe at example.com please"], pii.trained()) == [[(6, 0, 29)]]
