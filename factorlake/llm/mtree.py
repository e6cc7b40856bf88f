"""Exact top-k search by largest inner product in a paged M-tree.

One more component gives all rows the length of the longest, and then the rows
of the largest inner products are the nearest ones: d(q, x)^2 = |q|^2 + M^2 -
2 q.x. In this metric the rows are dealt to pivots, and the rows of a pivot lie
in pages of bounded size. A page is an M-tree over all of its rows, built where
they lie and stored as one row of a table: its nodes have a pivot, a covering
radius and the distance to the parent's pivot, and its entries the distance to
their leaf's pivot.

A query goes to the page of its nearest pivot first; what it finds there bounds
how far its k-th neighbour can be. Then it goes to those pages alone whose ring
around the pivot reaches within that bound. In a page, a queue takes nodes by
the least distance that they allow; by the triangle inequality, stored distances
tell for most children and entries that they lie beyond the bound before any
distance to them is computed. What is beyond it by more than rounding can't be
among the k best, so that the results are exact; scores are whole numbers.

Copies of a vector are cut down to the k + 1 smallest ids before: others can't be
among the k best of any query. Catalyst does so on the map side.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Bytes of a page's vectors, rows of it at most, children of a node, entries of a leaf, queries that search a page in one task.
PAGE_BYTES, PAGE_ROWS, FANOUT, LEAF, PAGE_QUERIES = 4_000_000, 16_384, 16, 256, 1_024
#: Pivots at most, and bytes of them; they are distinct vectors with the least hashes.
PIVOTS, PIVOT_BYTES = 4_096, 32_000_000
#: Queries that share a queue.
SHARED = 256
#: Distances closer than this share of the longest lengths aren't told apart by rounding.
ROUNDING = 1e-6


def lifted(x: np.ndarray, longest2: float) -> np.ndarray:
    """Rows with one more component, so that all have the squared length longest2."""
    rest = np.sqrt(np.maximum(longest2 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of a and of b."""
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0))


class Page:
    """An M-tree over some rows, in arrays. Nodes stand in breadth order; children and entries of a node lie together."""

    NAMES = ("ids", "x", "to_leaf", "pivot", "radius", "to_parent", "first", "last", "inner")

    def __init__(self, **arrays):
        for k in self.NAMES:
            setattr(self, k, arrays[k])

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, longest2: float, seed: int = 3) -> Page:
        random = np.random.default_rng(seed)
        y = lifted(x.astype(np.float64), longest2)
        # a node: pivot row, its rows, their distances to the pivot, distance to the parent's pivot
        start = np.arange(len(ids))
        nodes = [(0, start, distances(y, y[:1])[:, 0], 0.0)]
        inner, span, order, k = [], [], [], 0
        while k < len(nodes):
            pivot, rows, d, _ = nodes[k]
            k += 1
            inner.append(len(rows) > LEAF)
            if not inner[-1]:
                span.append((len(order), len(order) + len(rows)))
                order.extend(zip(rows.tolist(), d.tolist()))
                continue
            first = len(nodes)
            pivots = random.choice(rows, FANOUT, replace=False)
            near = distances(y[rows], y[pivots])
            own = near.argmin(axis=1)
            groups = [np.flatnonzero(own == c) for c in range(FANOUT)]
            if max(map(len, groups)) == len(rows):  # copies, or as good as that
                groups = np.array_split(np.arange(len(rows)), FANOUT)
            up = distances(y[pivots], y[pivot : pivot + 1])[:, 0]
            nodes += [(int(pivots[c]), rows[g], near[g, c], float(up[c])) for c, g in enumerate(groups) if len(g)]
            span.append((first, len(nodes)))
        at = np.array([r for r, _ in order], np.int64)
        return cls(
            ids=ids[at], x=x[at], to_leaf=np.array([d for _, d in order]), pivot=y[[n[0] for n in nodes]], radius=np.array([n[2].max() for n in nodes]),
            to_parent=np.array([n[3] for n in nodes]), first=np.array([s[0] for s in span]), last=np.array([s[1] for s in span]), inner=np.array(inner),
        )

    def pack(self) -> dict:
        return {k: np.ascontiguousarray(getattr(self, k)).tobytes() for k in self.NAMES}

    @classmethod
    def unpack(cls, row, dim: int, kind: str) -> Page:
        kinds = {"ids": "i8", "x": kind, "first": "i8", "last": "i8", "inner": "?"}
        a = {k: np.frombuffer(row[k], kinds.get(k, "f8")) for k in cls.NAMES}
        return cls(**a | {"x": a["x"].reshape(len(a["ids"]), dim), "pivot": a["pivot"].reshape(-1, dim + 1)})

    def open(self, exact: Scorer) -> Page:
        """Ready for search(): vectors in the type that the scores are computed in, lengths of the pivots."""
        self.x, self.kind = self.x.astype(exact.kind), exact.kind
        self.pivot2 = np.einsum("ij,ij->i", self.pivot, self.pivot)
        return self

    def search(self, q: np.ndarray, own: np.ndarray, top: int, bound: np.ndarray, longest2: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each row of q: (ids, scores, distances that its bounds didn't rule out) of the `top` best rows within its bound, the row `own` left out; best first, ties to the smaller id. The page is open.

        The queries share a queue. A node is taken once, by the least distance that
        it allows to any of them, with those that it still may help; their bounds
        say which children and entries are looked at.
        """
        m = len(q)
        z, bound = np.concatenate([q.astype(np.float64), np.zeros((m, 1))], axis=1), np.array(bound, np.float64)
        asked, q2 = q.astype(self.kind), np.einsum("ij,ij->i", z, z)
        slack = ROUNDING * (math.sqrt(longest2) + np.sqrt(q2))
        ids: list[np.ndarray] = [np.empty(0, np.int64)] * m
        scores: list[np.ndarray] = [np.empty(0, np.int64)] * m
        least = np.full(m, np.iinfo(np.int64).min)  # the last of the `top` best
        computed = np.ones(m, np.int64)

        def to_pivots(some: np.ndarray, at) -> np.ndarray:
            return np.sqrt(np.maximum(q2[some][:, None] + self.pivot2[at] - 2 * (z[some] @ self.pivot[at].T), 0))

        every = np.arange(m)
        d = to_pivots(every, slice(0, 1))[:, 0]
        low = np.maximum(d - self.radius[0], 0)
        queue = [(float(low.min()), 0, every, d, low)]
        while queue:
            _, node, some, d, low = heapq.heappop(queue)
            reach = bound[some] + slack[some]
            stay = low <= reach
            if not stay.any():
                continue
            some, d, reach = some[stay], d[stay], reach[stay]
            first, last = int(self.first[node]), int(self.last[node])
            if self.inner[node]:
                may = np.abs(d[:, None] - self.to_parent[first:last]) - self.radius[first:last] <= reach[:, None]
                children = np.flatnonzero(may.any(axis=0))
                near = to_pivots(some, first + children)
                computed[some] += may.sum(axis=1)
                low = np.maximum(near - self.radius[first + children], 0)
                for c in range(len(children)):
                    on = may[:, children[c]] & (low[:, c] <= reach)
                    if on.any():
                        heapq.heappush(queue, (float(low[on, c].min()), int(first + children[c]), some[on], near[on, c], low[on, c]))
                continue
            may = np.abs(d[:, None] - self.to_leaf[first:last]) <= reach[:, None]
            computed[some] += may.sum(axis=1)
            any_ = may.any(axis=0)
            rows = slice(first, last) if any_.all() else first + np.flatnonzero(any_)
            x_ids = self.ids[rows]
            s = (asked[some] @ self.x[rows].T).astype(np.int64)
            better = (s >= least[some][:, None]) & (x_ids != own[some][:, None])
            for k in np.flatnonzero(better.any(axis=1)).tolist():
                i, new = int(some[k]), np.flatnonzero(better[k])
                own_ids, own_scores = np.concatenate([ids[i], x_ids[new]]), np.concatenate([scores[i], s[k, new]])
                best = np.lexsort((own_ids, -own_scores))[:top]
                ids[i], scores[i] = own_ids[best], own_scores[best]
                if len(best) == top:
                    least[i] = scores[i][-1]
                    bound[i] = min(bound[i], math.sqrt(max(0.0, q2[i] + longest2 - 2.0 * float(least[i]))))
        return list(zip(ids, scores, computed.tolist()))


def _stack(column: pd.Series, kind: str) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


class Scorer:
    """In which kind of number inner products are exact: doubles where these hold all sums of vectors with components of at most `largest`, else longs."""

    def __init__(self, largest: int, dim: int):
        if largest * largest * dim >= 2**63:
            raise ValueError("inner products of these vectors don't fit a long")
        self.kind = np.float64 if largest * largest * dim < 2**53 else np.int64


def _one_length(x: DataFrame, q: DataFrame, top: int, dim: int, page_rows: int | None) -> DataFrame:
    """query_id, vec_id, score and computed (distances for this query in this page) of the best in each page searched. x, q: id, v (array of long)."""
    spark = x.sparkSession
    shape = "query_id long, vec_id long, score long, computed long"
    size2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, longest2, largest = x.agg(F.count(F.lit(1)), F.max(size2), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    asked, longest_q = q.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if not n or not asked:
        return spark.createDataFrame([], shape)
    exact = Scorer(max(largest or 0, longest_q or 0), max(dim, 1))
    kind = "i4" if max(largest or 0, longest_q or 0) < 2**31 else "i8"
    page_rows = page_rows or max(LEAF, min(PAGE_ROWS, PAGE_BYTES // (max(dim, 1) * int(kind[1]))))

    n_pivots = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(dim, 1)), math.ceil(2 * n / page_rows)))
    some = x.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()
    pivots = lifted(_stack(some["v"], "f8"), longest2)
    sent = spark.sparkContext.broadcast(pivots)  # at most PIVOTS rows

    @F.pandas_udf("struct<cell:int,d:double>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cell, d = np.zeros(len(part), np.int32), np.zeros(len(part))
            for i in range(0, len(part), 1024):
                near = distances(lifted(_stack(part.iloc[i : i + 1024], "f8"), longest2), sent.value)
                cell[i : i + 1024] = near.argmin(axis=1)
                d[i : i + 1024] = near.min(axis=1)
            yield pd.DataFrame({"cell": cell, "d": d})

    rows = materialize(x.withColumn("_c", nearest("v")).select("id", "v", "_c.cell", "_c.d"), "mtree-rows")
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).orderBy("cell").toPandas()  # a row a pivot
    chunks = {int(c): math.ceil(m / page_rows) for c, m in zip(cells["cell"], cells["n"])}
    n_chunks = F.element_at(F.array(*[F.lit(chunks.get(c, 1)) for c in range(len(pivots))]), F.col("cell") + 1)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), n_chunks).cast("int"))
    packed = ", ".join(f"{k} binary" for k in Page.NAMES)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")  # reruns build the same tree
        page = Page.build(pdf["id"].to_numpy(), _stack(pdf["v"], kind), longest2)
        return pd.DataFrame([{"cell": key[0], "chunk": key[1], **page.pack()}])

    pages = materialize(rows.groupBy("cell", "chunk").applyInPandas(build, f"cell int, chunk int, {packed}"), "mtree-pages")

    n_rows, low, high = cells["n"].to_numpy(), cells["low"].to_numpy(), cells["high"].to_numpy()
    centres, numbers = pivots[cells["cell"].to_numpy()], cells["cell"].to_numpy()
    enough = np.flatnonzero(n_rows > top) if (n_rows > top).any() else np.arange(len(numbers))

    def cell_distances(v: pd.Series) -> np.ndarray:
        z = _stack(v, "f8")
        return distances(np.concatenate([z, np.zeros((len(z), 1))], axis=1), centres)

    @F.pandas_udf("int")
    def first_cell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            d = [numbers[enough[cell_distances(v.iloc[i : i + 1024])[:, enough].argmin(axis=1)]] for i in range(0, len(v), 1024)]
            yield pd.Series(np.concatenate(d or [np.empty(0)]).astype(np.int32))

    @F.pandas_udf("array<int>")
    def cells_within(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """Cells whose ring around the pivot reaches within the bound."""
        for v, bound in parts:
            out = []
            for i in range(0, len(v), 1024):
                d, b = cell_distances(v.iloc[i : i + 1024]), bound.iloc[i : i + 1024].to_numpy(np.float64)
                slack = ROUNDING * (math.sqrt(longest2) + np.sqrt(np.array([float(np.dot(z, z)) for z in _stack(v.iloc[i : i + 1024], "f8")])))
                out += [numbers[r].astype(np.int32) for r in np.maximum(d - high, low - d) <= (b + slack)[:, None]]
            yield pd.Series(out, dtype=object)

    def search(queries: DataFrame) -> DataFrame:
        """Of queries (id, v, bound, cell, chunk). The queries of a page go to tasks of PAGE_QUERIES, each with a copy of the page."""
        parts = queries.groupBy("cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / PAGE_QUERIES).cast("int").alias("parts"))
        queries = queries.join(parts, ["cell", "chunk"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), F.col("parts")).cast("int")).drop("parts")
        copies = pages.join(parts, ["cell", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(asks: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
            names, out = ["query_id", "vec_id", "score", "computed"], []
            if len(asks) and len(page):
                tree = Page.unpack(page.iloc[0], dim, kind).open(exact)
                for at in range(0, len(asks), SHARED):
                    some = asks.iloc[at : at + SHARED]
                    own = some["id"].to_numpy(np.int64)
                    found = tree.search(_stack(some["v"], "i8"), own, top, some["bound"].to_numpy(np.float64), longest2)
                    n = [len(f[0]) for f in found]
                    columns = [np.repeat(own, n), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat([f[2] for f in found], n)]
                    out.append(pd.DataFrame(dict(zip(names, columns))))
            return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in names})

        # small rows, long work: not to be put into few tasks by their size
        key, n = ["cell", "chunk", "part"], int(spark.conf.get("spark.sql.shuffle.partitions"))
        return queries.repartition(n, *key).groupBy(*key).cogroup(copies.repartition(n, *key).groupBy(*key)).applyInPandas(run, shape)

    far = F.lit(float("inf"))
    q = q.withColumn("cell", first_cell("v")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(6)), n_chunks).cast("int"))
    q = materialize(q, "mtree-queries")
    first = materialize(search(q.withColumn("bound", far)), "mtree-first")
    q2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    least = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_s")).withColumnRenamed("query_id", "id")
    bounds = q.join(least, "id", "left").withColumn("bound", F.when(F.col("_n") >= top, F.sqrt(F.greatest(q2 + longest2 - 2.0 * F.col("_s"), F.lit(0.0)))).otherwise(far))
    rest = bounds.withColumnRenamed("cell", "_cell").withColumnRenamed("chunk", "_chunk").withColumn("cell", F.explode(cells_within("v", "bound")))
    rest = rest.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))).where("cell != _cell or chunk != _chunk").select("id", "v", "bound", "cell", "chunk")
    return first.unionByName(search(rest))


def whole_numbers(v, scale: int = 256):
    """Components as floor(scale * x), x as double; null for a vector that is null or holds null or non-finite components."""
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale)))


def top_products(rows: DataFrame, queries: DataFrame, top: int = 5, id_col: str = "vec_id", vector_col: str = "v", page_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the `top` largest inner products of each row of queries among rows, exactly.

    Vectors are arrays of whole numbers; null ones, and those that hold nulls,
    take no part, and vectors only meet others of their length. Zero vectors do
    take part. A query's own id is no candidate. Fewer candidates than `top`: all
    of them. Ties go to the smaller id. Null ids take no part. Rows that repeat an
    id count once as candidates if their vectors agree too, else each for itself;
    as queries, the least of their vectors is asked. Empty tables give no rows; other columns are
    ignored. Products that don't fit a long raise an error.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<long>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull()))

    of_copies = Window.partitionBy("v").orderBy("id")
    x = clean(rows).distinct().withColumn("_n", F.row_number().over(of_copies)).where(F.col("_n") <= top + 1).drop("_n")
    x = materialize(x, "mtree-vectors")
    q = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    found = None
    for dim in sorted(r[0] for r in q.select(F.size("v").alias("d")).distinct().collect()):
        own = _one_length(x.where(F.size("v") == dim), q.where(F.size("v") == dim), top, dim, page_rows)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, computed long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op13_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("v"))
    return top_products(rows, rows.where("vec_id % 50 = 0"), 5)


OP13_SQL = """
with x as (select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
pair as (select q.vec_id query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) as bigint) score
  from x q join x on q.vec_id % 50 = 0 and x.vec_id != q.vec_id and len(x.v) = len(q.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pair)
select query_id, cast(rank as integer) as rank, vec_id, coalesce(score, 0) as score from ranked where rank <= 5
"""
