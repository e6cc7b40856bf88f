"""Nearest neighbours by largest inner product, from forests of random-projection trees.

Largest inner products are made nearest directions by one more component, which
gives all rows the same length. A trunk, a tree of random projections fitted on
a bounded sample, deals the rows into branches, and these are cut by a hash into
blocks of bounded size. Each block gets a forest over all of its rows. A query
goes to the branches on whose wrong side it lies least, there down every tree;
the margins by which it would fall on the far side of the splits rank the leaves
of all trees in one shared priority queue. Leaves are taken from it, nearest
first, until the query has looked at its share of the block, and what they hold
is ranked again by the exact product of the original vectors. The best of all
blocks are merged by window rank.

How many branches and what share of a block a query looks at is measured, not
set: for a bounded sample of queries the true neighbours are found by brute
force, and the shares are those in which enough of them lie.

A block's forest is built once for up to BLOCK_QUERIES queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, usable_vector

#: Rows and queries of a block, trees of a forest, rows of a leaf.
BLOCK_ROWS, BLOCK_QUERIES, TREES, LEAF = 4_096, 65_536, 32, 8
#: Rows that the trunk is fitted on at most, and of them in a branch at least.
SAMPLE, BRANCH = 16_384, 64
#: Queries by which the shares are measured at most, and the shares of true neighbours that the branches and the leaves looked at must hold.
MEASURED, IN_BRANCHES, IN_LEAVES = 200, 0.99, 0.965


def _splits(x: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A random direction to split rows by: between two of them, which follows the data's spread."""
    a, b = random.choice(rows, 2, replace=False) if len(rows) > 1 else (rows[0], rows[0])
    d = x[a] - x[b]
    size = np.linalg.norm(d)
    if size < 1e-12:
        d = random.standard_normal(x.shape[1])
        size = np.linalg.norm(d)
    return d / size


class Forest:
    """Random-projection trees over unit vectors, all of one depth, in arrays."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        random = np.random.default_rng(seed)
        n, dim = x.shape
        self.depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
        nodes = (1 << self.depth) - 1
        self.directions, self.cuts = np.zeros((trees, nodes, dim)), np.zeros((trees, nodes))
        self.leaf = np.zeros((trees, n), np.int64)  # of each row, counted through all trees
        for t in range(trees):
            groups = [np.arange(n)]
            for level in range(self.depth):
                first, nxt = (1 << level) - 1, []
                for k, g in enumerate(groups):
                    if len(g):
                        self.directions[t, first + k] = _splits(x, g, random)
                    p = x[g] @ self.directions[t, first + k]
                    half = len(g) // 2
                    order = np.argpartition(p, half) if len(g) > 1 else np.arange(len(g))
                    self.cuts[t, first + k] = p[order[half]] if len(g) else 0.0
                    nxt += [g[order[:half]], g[order[half:]]]
                groups = nxt
            for k, g in enumerate(groups):
                self.leaf[t, g] = t * (nodes + 1) + k

    def priorities(self, q: np.ndarray) -> np.ndarray:
        """(queries x all trees' leaves): how far the query is, at worst, on the wrong side of a split above the leaf."""
        out = []
        for t in range(len(self.leaf)):
            cost = np.zeros((len(q), 1))
            margin = q @ self.directions[t].T - self.cuts[t]
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1 : (2 << level) - 1]
                low, high = np.maximum(cost, m), np.maximum(cost, -m)
                cost = np.stack([low, high], axis=2).reshape(len(q), -1)
            out.append(cost)
        return np.concatenate(out, axis=1)

    def turns(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, at which turn of the queue each row comes up: that of the first of its leaves."""
        for at in range(0, len(q), 256):
            cost = self.priorities(q[at : at + 256])
            turn = np.empty(cost.shape, np.int32)
            np.put_along_axis(turn, np.argsort(cost, axis=1, kind="stable"), np.arange(cost.shape[1], dtype=np.int32)[None], axis=1)
            for row in turn:
                yield row[self.leaf].min(axis=0)


def _level(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with one more component, all of length 1."""
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1) / longest


def _asked(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1) / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, top: int, look: float, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best `top` found for each query in one block, the query's own row left out."""
    least = min(len(x), max(4 * top, math.ceil(look * len(x))))
    a, b, c = [], [], []
    for i, turn in enumerate(Forest(_level(x, longest)).turns(_asked(q))):
        rows = np.flatnonzero(turn <= np.partition(turn, least - 1)[least - 1])
        rows = rows[ids[rows] != query_ids[i]]
        s = x[rows] @ q[i]
        if len(s) > top:  # with all that tie with the last
            near = s >= np.partition(s, len(s) - top)[len(s) - top]
            rows, s = rows[near], s[near]
            best = np.lexsort((ids[rows], -s))[:top]
            rows, s = rows[best], s[best]
        a.append(np.full(len(rows), query_ids[i]))
        b.append(ids[rows])
        c.append(s)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def shares_needed(ids: np.ndarray, x: np.ndarray, q: np.ndarray, wanted: list[np.ndarray], longest: float) -> np.ndarray:
    """For each wanted row of each query, the share of the block that the queue brings up by then."""
    out = []
    for turn, own in zip(Forest(_level(x, longest)).turns(_asked(q)), wanted):
        rows = np.flatnonzero(np.isin(ids, own))
        out.append(np.searchsorted(np.sort(turn), turn[rows], side="right") / len(x))
    return np.concatenate(out) if out else np.empty(0)


def _double(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _same_length(x: DataFrame, q: DataFrame, top: int, block_rows: int, block_queries: int, look: float | None) -> DataFrame:
    """query_id, vec_id and score of the best found in each block, for vectors of one length. x, q: id, v."""
    spark = x.sparkSession
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    n, longest = x.agg(F.count("*"), F.max(size)).first()
    m = q.count()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    some = x.orderBy(F.xxhash64("id"), "v").limit(min(SAMPLE, n)).toPandas()
    depth = max(0, math.floor(math.log2(max(1, min(n / block_rows, len(some) / BRANCH)))))
    trunk = Forest(_level(_double(some["v"]), longest), 1, max(1, len(some) >> depth), seed=5)
    sent, branches = spark.sparkContext.broadcast((trunk.directions, trunk.cuts, trunk.depth)), 1 << trunk.depth

    def costs(v: np.ndarray) -> np.ndarray:
        own = Forest.__new__(Forest)
        own.directions, own.cuts, own.depth = sent.value
        own.leaf = np.zeros((1, 0), np.int64)
        return own.priorities(v)

    @F.pandas_udf("int")
    def branch(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.concatenate([costs(_level(_double(part.iloc[i : i + 2048]), longest)).argmin(axis=1) for i in range(0, len(part), 2048)] or [np.empty(0)]).astype(np.int32))

    @F.pandas_udf("array<int>")
    def order(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Branches, nearest first."""
        for part in parts:
            yield pd.Series([row.astype(np.int32) for i in range(0, len(part), 2048) for row in costs(_asked(_double(part.iloc[i : i + 2048]))).argsort(axis=1, kind="stable")], dtype=object)

    rows = materialize(x.withColumn("branch", branch("v")), "ann-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("branch").count().collect()}  # one row a branch
    chunks = F.element_at(F.create_map(*[F.lit(y) for b, c in counts.items() for y in (b, math.ceil(c / block_rows))]), F.col("branch"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), chunks).cast("int"))

    def blocks_of(queries: DataFrame, most: int) -> DataFrame:
        near = queries.withColumn("branch", F.explode(F.slice("order", 1, most))).withColumn("chunks", chunks).where("chunks is not null")
        return near.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "order")

    asked = q.withColumn("order", order("v"))
    reach = branches
    if look is None:
        look, reach = _measure(rows, asked, blocks_of, longest, top, branches)
    routed = blocks_of(asked, reach)
    own = routed.groupBy("branch", "block").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("parts"))
    routed = routed.join(own, ["branch", "block"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), F.col("parts")).cast("int")).drop("parts")
    copies = rows.join(own, ["branch", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = copies.withColumn("asks", F.lit(False)).unionByName(routed.withColumn("asks", F.lit(True)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # in order of id, so that reruns build the same forest
        pdf = pdf.sort_values("id", kind="stable")
        asks, ids, v = pdf["asks"].to_numpy(), pdf["id"].to_numpy(), _double(pdf["v"])
        a, b, c = search_block(ids[~asks], v[~asks], ids[asks], v[asks], top, look, longest)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return both.groupBy("branch", "block", "part").applyInPandas(run, "query_id long, vec_id long, score double")


def _measure(rows: DataFrame, asked: DataFrame, blocks_of, longest: float, top: int, branches: int) -> tuple[float, int]:
    """(share of a block, number of branches) in which enough true neighbours of some queries lie."""
    some = asked.orderBy(F.xxhash64("id", F.lit(9))).limit(MEASURED).toPandas().sort_values("id", kind="stable")
    ids, v = some["id"].to_numpy(), _double(some["v"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["id"].to_numpy()
            s = v @ _double(pdf["v"]).T
            s[ids[:, None] == own] = -np.inf
            k = min(top, len(own))
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(ids)), k)
            yield pd.DataFrame({"q": q, "id": own[at.ravel()], "branch": pdf["branch"].to_numpy()[at.ravel()], "s": s[q, at.ravel()]})

    truth = rows.mapInPandas(best, "q int, id long, branch int, s double").where(F.col("s") > float("-inf"))
    truth = truth.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "id"))).where(F.col("n") <= top).toPandas()  # at most MEASURED x top rows
    place = np.stack([np.argsort(o) for o in some["order"]])
    ranks = np.sort(place[truth["q"].to_numpy(), truth["branch"].to_numpy()])
    reach = int(ranks[min(len(ranks) - 1, math.ceil(IN_BRANCHES * len(ranks)))]) + 1 if len(ranks) else branches
    wanted = {int(i): g["id"].to_numpy() for i, g in truth.groupby("q")}
    no = {int(i): k for k, i in enumerate(ids.tolist())}

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        asks, own, x = pdf["asks"].to_numpy(), pdf["id"].to_numpy(), _double(pdf["v"])
        want = [wanted.get(no[int(i)], np.empty(0, np.int64)) for i in own[asks]]
        return pd.DataFrame({"share": shares_needed(own[~asks], x[~asks], x[asks], want, longest)})

    sample = asked.sparkSession.createDataFrame(some[["id", "v", "order"]].assign(v=[list(map(float, a)) for a in some["v"]], order=[list(map(int, a)) for a in some["order"]]), "id long, v array<double>, order array<int>")
    both = rows.withColumn("asks", F.lit(False)).unionByName(blocks_of(sample, reach).withColumn("asks", F.lit(True)))
    found = both.groupBy("branch", "block").applyInPandas(shares, "share double")
    look = found.agg(F.percentile("share", IN_LEAVES)).first()[0]
    return (1.0 if look is None else float(look)), min(reach, branches)


def nearest(rows: DataFrame, queries: DataFrame, top: int = 20, look: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the `top` largest inner products found for each row of queries among rows.

    A query looks at the share `look` of every block; by default, this share and
    the branches that it goes to are measured. A query's own id is no candidate.
    Fewer candidates than `top`: all of them. Ties go to the smaller id. Vectors
    that are null, zero, or hold null or non-finite components take no part;
    vectors only meet others of their length. Rows that repeat an id are kept
    apart as candidates; as queries, the least of their vectors is asked. Empty
    tables give no rows. Other columns are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable_vector(F.col("v")))

    x, q = clean(rows), clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    found = None
    for dim in sorted(r[0] for r in q.select(F.size("v").alias("d")).distinct().collect()):
        own = _same_length(x.where(F.size("v") == dim), q.where(F.size("v") == dim), top, block_rows, block_queries, look)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 20)
