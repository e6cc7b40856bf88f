"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint of 64 bits is the bitwise majority of the XXH64 hashes of a
text's word shingles. Equal fingerprints are folded first. Two different ones
within `max_bits` bits agree wholly in at least `agree` of max_bits + agree
stretches of the 64 bits, so that each is sent once for each choice of stretches
to the bucket of their values. How many must agree follows from the number of
fingerprints.

All buckets of a task lie in one index. In a bucket, fingerprints are sorted by
Gray rank and stacked into a tree. A node keeps the bits that all below it share
and that its parent doesn't have: shared patterns stand as high as can be. A
search adds up a fingerprint's differences on its way down, counts each bit once,
and drops whole groups once the sum passes max_bits; at the leaves only the bits
that no node holds are left to compare. A bucket gives no pairs, only a spanning
set of its links: at most one edge a member.

Buckets beyond a bound are cut, in Gray order, into chunks of bounded size, and
only pairs of chunks whose shared bits differ little enough are searched, by
separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_join, materialize, read_table, text_hashes
from .graph import components

#: Members of a tree node, and of a bucket's chunk.
FAN, CHUNK = 8, 4_096
#: Members of a bucket whose search is worth sending a fingerprint to one more bucket: 300 by measured time, more as sending takes disk too.
WORTH = 500
#: Rows that a task indexes at once, and (query, member) pairs that a search looks at together at most.
AT_ONCE, PAIRS = 65_536, 4_000_000


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42, more: int = 0) -> list[int]:
    """Bitwise majority of the hashes of all shingles, then of `more` remixes of them; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return [0] * (1 + more)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts, h = ends - sizes, xxhash.xxh64_intdigest
    k = max(0, len(tokens) - words)
    pairs = zip(starts[: k + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist())
    hashes = np.array([h(joined[a:b], seed) for a, b in pairs], np.uint64)
    out = [_majority(hashes)]
    for _ in range(more):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        out.append(_majority(hashes))
    return out


def fingerprints(words: int = 4, seed: int = 42, text_col: str = "text", more: int = 0) -> Column:
    """array<long> of a text's fingerprints, as signed 64-bit numbers."""

    @F.pandas_udf("array<long>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(np.array([fingerprint(t, words, seed, more) for t in batch], np.uint64).reshape(-1, 1 + more).view(np.int64)))

    return run(F.col(text_col))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code's order: neighbours in it differ by one bit."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 ... of counts[i] numbers, for each i."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


class GrayIndex:
    """Fingerprints of several buckets, each bucket a tree over its Gray order whose nodes hold what they add to their parents' shared bits."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        """values: bucket after bucket, each in Gray order; sizes: members of each bucket."""
        self.values, self.levels = values, []  # of a level: first child, number of children, shared bits, and which of them the parent lacks
        ands = ors = values
        counts, masks = sizes, []
        while True:
            nodes = -(-counts // FAN)
            off, node_off = np.cumsum(counts) - counts, np.cumsum(nodes) - nodes
            rank = np.arange(nodes.sum()) - np.repeat(node_off, nodes)
            first = np.repeat(off, nodes) + rank * FAN
            many = np.minimum(FAN, np.repeat(counts, nodes) - rank * FAN)
            ands, ors = np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first)
            masks.append(~(ands ^ ors))
            self.levels.append((first, many, ands))
            counts = nodes
            if counts.max() == 1:
                break
        self.loose = ~np.repeat(masks[0], self.levels[0][1])  # by member: the bits that no node above it holds
        for depth, (first, many, shared) in enumerate(self.levels):
            own = masks[depth]
            if depth + 1 < len(self.levels):
                own = own & ~np.repeat(masks[depth + 1], self.levels[depth + 1][1])
            self.levels[depth] = (first, many, shared, own)

    def search(self, queries: np.ndarray, bucket: np.ndarray, most: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) within `most` bits, each query in its own bucket; with after, only members beyond that place."""
        q, node, differ = np.arange(len(queries)), bucket, np.zeros(len(queries), np.uint8)
        for first, many, shared, own in reversed(self.levels):
            differ = differ + np.bitwise_count((queries[q] ^ shared[node]) & own[node])
            near = differ <= most
            q, node, differ = q[near], node[near], differ[near]
            counts = many[node]
            q, node, differ = np.repeat(q, counts), _spread(first[node], counts), np.repeat(differ, counts)
        if after is not None:
            later = node > after[q]
            q, node, differ = q[later], node[later], differ[later]
        near = differ + np.bitwise_count((queries[q] ^ self.values[node]) & self.loose[node]) <= most
        return q[near], node[near]


def _unite(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those that first connect groups; group (place -> lowest place of its group) is updated."""
    out_a, out_b = [], []
    while len(a):
        low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
        apart = low < high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        if not len(a):
            break
        # every group joins a lower one, by one pair
        roots, at = np.unique(high, return_index=True)
        out_a.append(a[at])
        out_b.append(b[at])
        to = np.arange(len(group))
        to[roots] = low[at]
        while (to[to] != to).any():
            to = to[to]
        group[:] = to[group]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _check(prints: np.ndarray, others: np.ndarray, q: np.ndarray, m: np.ndarray, total: int | None) -> np.ndarray:
    """Whether all fingerprints of the pairs together differ in at most `total` bits."""
    if total is None:
        return np.ones(len(q), bool)
    return np.concatenate([np.bitwise_count(prints[q[i : i + PAIRS // 8]] ^ others[m[i : i + PAIRS // 8]]).sum(axis=1) for i in range(0, len(q), PAIRS // 8)] or [np.empty(0)]) <= total


def bucket_edges(key: np.ndarray, prints: np.ndarray, most: int, total: int | None = None, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of edges that connect whatever links connect inside each bucket of equal keys.

    prints: (members x fingerprints); the one at `at` is indexed. Links are within
    `most` bits of it and, with total, within so many bits of all together.
    """
    order = np.lexsort((gray_rank(prints[:, at]), key))
    key, prints = key[order], prints[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
    sizes = np.diff(cuts)
    index = GrayIndex(prints[:, at], sizes)
    bucket, group = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(key))
    slices, out = np.cumsum(sizes[bucket]) // PAIRS, []
    bounds = np.r_[0, np.flatnonzero(np.diff(slices)) + 1, len(key)]
    for lo, hi in zip(bounds, bounds[1:]):
        q, m = index.search(prints[lo:hi, at], bucket[lo:hi], most, np.arange(lo, hi))
        q = q + lo
        good = _check(prints, prints, q, m, total)
        out.append(_unite(group, q[good], m[good]))
    return order[np.concatenate([a for a, _ in out])], order[np.concatenate([b for _, b in out])]


def chunk_edges(left: np.ndarray, right: np.ndarray, most: int, total: int | None = None, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Like bucket_edges, of links between left and right; places count through left, then right."""
    order = np.argsort(gray_rank(right[:, at]), kind="stable")
    right = right[order]
    index, group, out = GrayIndex(right[:, at], np.array([len(right)])), np.arange(len(left) + len(right)), []
    step = max(1, PAIRS // len(right))
    for lo in range(0, len(left), step):
        some = left[lo : lo + step]
        q, m = index.search(some[:, at], np.zeros(len(some), np.int64), most)
        good = _check(some, right, q, m, total)
        out.append(_unite(group, q[good] + lo, order[m[good]] + len(left)))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def stretches_to_agree(n: int, most: int) -> int:
    """How many stretches must agree, so that sending fingerprints and searching buckets cost least at n fingerprints."""
    cost = lambda k: comb(most + k, k) * (1 + n / 2 ** (64 * k / (most + k)) / WORTH)
    return min(range(1, 6), key=cost)


def _keys(fp: Column, most: int, agree: int) -> Column:
    """Array of bucket keys: the values of each choice of `agree` stretches out of most + agree."""
    n = most + agree
    cuts = [64 * i // n for i in range(n + 1)]
    stretch = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(i), *[stretch[k] for k in c]) for i, c in enumerate(combinations(range(n), agree))])


def _prints(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).view(np.uint64)


def _edge_frame(node: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"a": node[edges[0]], "b": node[edges[1]]})


def link_edges(distinct: DataFrame, most: int, n: int, chunk: int = CHUNK, total: int | None = None, at: int = 0) -> DataFrame:
    """a, b: edges between nodes (node, fps) that connect what links connect (see bucket_edges)."""
    agree = stretches_to_agree(n, most)
    rows = distinct.select("node", "fps", F.explode(_keys(F.get("fps", at), most, agree)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") > chunk), "simhash-large")
    n_large = large.count()
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 200_000)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; a bucket may go on in the next batch."""
        held = pd.DataFrame()
        for pdf in batches:
            held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
            if len(held) < AT_ONCE:
                continue
            key = held["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield edges_of(held.iloc[:whole])
                held = held.iloc[whole:]
        if len(held):
            yield edges_of(held)

    def edges_of(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy()
        shared = np.r_[False, key[1:] == key[:-1]]
        pdf, key = pdf[shared | np.r_[shared[1:], False]], key[shared | np.r_[shared[1:], False]]
        if not len(pdf):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        return _edge_frame(pdf["node"].to_numpy(), bucket_edges(key, _prints(pdf["fps"]), most, total, at))

    small = rows.join(large.select("key"), "key", "left_anti") if n_large else rows
    edges = small.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(within, "a long, b long")
    if n_large:
        edges = edges.unionByName(_large_buckets(rows.join(large.select("key"), "key", "left_semi"), most, chunk, total, at))
    return edges.distinct()


def _large_buckets(rows: DataFrame, most: int, chunk: int, total: int | None, at: int) -> DataFrame:
    """Edges of buckets of over `chunk` members: chunk by chunk, in Gray order, without chunk pairs that differ too much."""
    spark = rows.sparkSession

    @F.pandas_udf("long")
    def rank(fp: pd.Series) -> pd.Series:
        # signed numbers sort like the unsigned ranks when the top bit is flipped
        return pd.Series((gray_rank(fp.to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))

    rows = materialize(rows.withColumn("rank", rank(F.get("fps", at))), "simhash-hot")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // (16 * chunk))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of key and rank: a new chunk begins with a key, and after `chunk` members."""
        last, got, no = None, 0, -1
        for pdf in batches:
            numbers = np.empty(len(pdf), np.int64)
            for i, key in enumerate(pdf["key"].tolist()):
                if key != last or got == chunk:
                    last, got, no = key, 0, no + 1
                got += 1
                numbers[i] = no
            yield pdf.assign(chunk=(pdf["part"].to_numpy() << 32) + numbers)[["key", "node", "fps", "chunk"]]

    # ranges of (key, rank), whatever the bucket's size: no chunk is larger than `chunk`
    placed = rows.repartitionByRange(parts, "key", "rank").sortWithinPartitions("key", "rank").select("key", "node", "fps", F.spark_partition_id().cast("long").alias("part"))
    placed = materialize(placed.mapInPandas(number, "key long, node long, fps array<long>, chunk long"), "simhash-chunks")
    own = F.get("fps", at)
    nodes = placed.groupBy("key", "chunk").agg(F.bit_and(own).alias("all"), F.bit_or(own).alias("any"))
    nodes = materialize(nodes.select("key", "chunk", "all", F.bitwise_not(F.col("all").bitwiseXOR(F.col("any"))).alias("mask")), "simhash-nodes")
    i, j = nodes.alias("i"), nodes.alias("j")
    differ = F.bit_count(F.col("i.all").bitwiseXOR(F.col("j.all")).bitwiseAND(F.col("i.mask")).bitwiseAND(F.col("j.mask")))
    pairs = i.join(j, "key").where((F.col("i.chunk") <= F.col("j.chunk")) & (differ <= most)).select("key", F.col("i.chunk").alias("i"), F.col("j.chunk").alias("j"))
    pairs = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    tasks = placed.join(pairs, ["key", "chunk"]).select("key", "i", "j", "chunk", "node", "fps")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["chunk"] == i], pdf[pdf["chunk"] == j]
        if i == j:
            return _edge_frame(left["node"].to_numpy(), bucket_edges(np.zeros(len(left), np.int64), _prints(left["fps"]), most, total, at))
        return _edge_frame(np.concatenate([left["node"], right["node"]]), chunk_edges(_prints(left["fps"]), _prints(right["fps"]), most, total, at))

    return tasks.groupBy("key", "i", "j").applyInPandas(between, "a long, b long")


def near_duplicates(docs: DataFrame, max_bits: int = 4, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", more: int = 0, total_bits: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), text_hashes and kept of every row.

    Texts link within max_bits differing bits of their fingerprints. With `more`
    fingerprints of remixed hashes, texts link that are within max_bits by any of
    them and within total_bits of all together: that allows a wider max_bits
    without links between unlike texts.

    kept: whether the row is the first of its component, by id and then by its
    text's hashes (text_hashes, 128 bits); rows that agree in both are all kept.

    Null and empty texts, and texts without words, have fingerprint 0, which
    links like any other. Rows that repeat an id each get their row; a null id
    keeps its row and is never a component's smallest one unless it is alone
    (then null). No rows give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hashes(F.col(text_col)).alias("text_hashes"), fingerprints(words, seed, text_col, more).alias("fps"))
    rows = materialize(rows, "simhash-rows")
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hashes")
    # one fingerprint is its node's name; several are told apart as they are, and their node gets a number
    distinct = rows.groupBy("fps").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id() if more else F.get("fps", 0)), "simhash-distinct")
    n = distinct.count()
    edges = link_edges(distinct, max_bits, n, CHUNK, total_bits)
    for at in range(1, 1 + more):
        edges = materialize(edges, "simhash-edges").unionByName(link_edges(distinct, max_bits, n, CHUNK, total_bits, at))
    links = materialize(components(edges), "simhash-components")
    owner = distinct.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    owner = materialize(owner, "simhash-owner")
    firsts = owner.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("fingerprints"))
    named = heavy_join(owner.select("fps", "n", "component"), firsts, "component", "fingerprints", n).select("fps", "n", "first")
    named = materialize(named, "simhash-named")
    out = heavy_join(rows, named.withColumnRenamed("n", "n_rows"), "fps", "n_rows", rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.get("fps", 0))), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "text_hashes", place.eqNullSafe(F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns of docs, with one row of each component of near_duplicates(): the one with the lowest id.

    Rows are told apart by id and text: of several with the lowest id, the one
    whose text has the lowest hashes stays, and of rows that agree in both the
    least by its columns. Documents without any word have no copies and all stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    id_, text = F.col("_d")[id_col], F.col("_d")[text_col]
    worded = F.coalesce(F.regexp(text, F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))
    asked = rows.where(worded).select(id_.alias("doc_id"), text.alias("text"))
    stays = near_duplicates(asked, **options).where("kept").groupBy(F.struct("doc_id", "text_hashes").alias("_r")).agg(F.count("*").alias("_n"))
    stays = materialize(stays, "simhash-stays")
    total = stays.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    own = rows.where(worded).withColumn("_r", F.struct(id_.alias("doc_id"), text_hashes(text).alias("text_hashes")))
    hits = heavy_join(own, stays, "_r", "_n", total)
    again = hits.where("_n > 1").groupBy("_r").agg(F.min("_d").alias("_d"))
    out = hits.where("_n = 1").select("_d").unionByName(again.select("_d")).unionByName(rows.where(~worded))
    return out.select("_d.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
