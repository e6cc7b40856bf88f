"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping shards.

Equal vectors are folded first. Cluster centres come from a bounded sample,
and every vector goes to the shards of its `overlap` nearest centres. In a
shard, each vector gets its nearest ones as a candidate pool, of which robust
pruning leaves a few that point in different directions. A vector's lists from
all of its shards are united. The search then starts at a shard's medoids and
goes greedily to where each vector's neighbours are; from what lies in range it
spreads on through the graph until nothing new is in range. Links are checked
with the original vectors in double precision.

A pair is counted in the lowest shard that both vectors share. Tasks give link
counts and a spanning set of their links, not the pairs. A shard beyond a
bound is cut into chunks, and pairs of chunks are searched by separate tasks.

An audit compares link counts of a bounded set of vectors with brute force over
all rows; where the graph has found too few, the overlap is doubled and the
graph built anew. Where that doesn't help, or would cost more than comparing
all, an exact pass follows: every vector lies in the cell of its nearest centre,
and meets each cell whose angular radius, widened by the threshold's angle,
reaches it. By the triangle inequality no link lies elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_join, materialize, read_table, usable_vector
from .graph import components

#: Rows that a shard holds about, members of a chunk at most, and centres at most, in number and in bytes (they are broadcast).
SHARD_ROWS, CHUNK, MOST_CENTRES, MOST_BYTES = 512, 1_024, 65_536, 64 << 20
#: Sampled vectors a centre, and sampled vectors at most.
SAMPLE_EACH, MOST_SAMPLE = 24, 262_144
#: Candidates and degree of a vertex, its slack in pruning, and the width of a search.
POOL, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 24
#: Below the threshold by so much, a vertex is still spread from.
SLACK = 0.04
#: Audited vectors, and the mean share of a vector's links that must be found.
AUDITED, LEAST_RECALL = 256, 0.98
#: Shards of a vector beyond which the exact pass follows.
MOST_OVERLAP = 64
#: Radians by which the exact pass looks further, for rounding.
ROUNDING = 1e-6


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    random = np.random.default_rng(seed)
    c = sample[random.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def robust_prune(sims: np.ndarray, alpha: float = ALPHA, pool: int = POOL, degree: int = DEGREE) -> np.ndarray:
    """(vertices x degree) neighbours, -1 where there are fewer: the nearest candidate stays, and drops those it is nearer to by alpha."""
    n = len(sims)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if pool < 1:
        return out
    s = sims.copy()
    np.fill_diagonal(s, -np.inf)
    cand = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(-s[rows, cand], axis=1, kind="stable"), axis=1)
    far = np.sqrt(np.maximum(2 - 2 * s[rows, cand], 0))  # distances of unit vectors, ascending
    alive = np.ones_like(cand, bool)
    row = np.arange(n)
    for k in range(degree):
        at = alive.argmax(axis=1)
        some = alive[row, at]
        if not some.any():
            break
        star = cand[row, at]
        out[some, k] = star[some]
        between = np.sqrt(np.maximum(2 - 2 * sims[star[:, None], cand], 0))
        alive &= ~(some[:, None] & (alpha * between <= far))
        alive[row, at] = False
    return out


def range_search(v: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (a, b) of the pairs with similarity >= least that the graph leads to from each of the unit vectors, and how many pairs were compared.

    Only pairs that the walk meets are compared: each vector's way from the
    entries towards itself, and the neighbours of what lies in its range.
    """
    n = len(v)
    s = np.full((n, n), -np.inf, np.float32)
    visited = np.zeros((n, n), bool)

    def compare(q: np.ndarray, c: np.ndarray) -> None:
        visited[q, c] = True
        for at in range(0, len(q), 1 << 16):
            i, j = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
            s[i, j] = np.einsum("ij,ij->i", v[i], v[j])

    row = np.arange(n)
    compare(np.repeat(row, len(entries)), np.tile(entries, n))
    width = max(BEAM, len(entries))
    beam = np.full((n, width), -1, np.int64)
    beam[:, : len(entries)] = entries
    done = beam < 0
    for _ in range(4 * BEAM):
        near = np.where(done, -np.inf, np.take_along_axis(s, np.maximum(beam, 0), axis=1))
        at = near.argmax(axis=1)
        live = np.flatnonzero(near[row, at] > -np.inf)
        if not len(live):
            break
        done[live, at[live]] = True
        nxt = adjacency[beam[live, at[live]]]
        fresh = (nxt >= 0) & ~visited[live[:, None], np.maximum(nxt, 0)]
        r, c = np.nonzero(fresh)
        compare(live[r], nxt[r, c])
        nxt = np.where(fresh, nxt, -1)
        all_ids, all_done = np.concatenate([beam[live], nxt], axis=1), np.concatenate([done[live], nxt < 0], axis=1)
        worth = np.where(all_ids < 0, -np.inf, np.take_along_axis(s[live], np.maximum(all_ids, 0), axis=1))
        best = np.argpartition(-worth, width - 1, axis=1)[:, :width]
        beam[live], done[live] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_done, best, axis=1)
    # spread from what is in range, or nearly; a vector lies in its own range
    compare(row, row)
    edges = np.zeros((n, n), np.float32)
    a, b = np.nonzero(adjacency >= 0)
    edges[a, adjacency[a, b]] = 1
    edges = np.maximum(edges, edges.T)
    front = s >= least - SLACK
    on = np.flatnonzero(front.any(axis=1))
    while len(on):
        new = ((front[on].astype(np.float32) @ edges) > 0) & ~visited[on]
        r, c = np.nonzero(new)
        compare(on[r], c)
        front = np.zeros_like(front)
        front[on] = new & (s[on] >= least - SLACK)
        on = on[front[on].any(axis=1)]
    a, b = np.nonzero((s >= least - 1e-5) | (s.T >= least - 1e-5))
    return a, b, int(np.count_nonzero(visited))


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _shard_graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """Robust-pruned lists within one chunk of a shard, of at most some CHUNK vectors, of which each one's pool is looked for among all."""
    pdf = pdf.sort_values("id", kind="stable")
    ids, v = pdf["id"].to_numpy(), _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64)).astype(np.float32)
    out = robust_prune(v @ v.T)
    return pd.DataFrame({"id": ids, "near": [ids[r[r >= 0]] for r in out]})


def _shard_links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one shard, or of a pair of its chunks: (id, other or null, links) rows."""
    pdf = pdf.sort_values(["chunk", "id"], kind="stable")
    shard, i, j = pdf["shard"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
    ids, chunk, copies = pdf["id"].to_numpy(), pdf["chunk"].to_numpy(), pdf["copies"].to_numpy()
    exact = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    unit = _unit(exact)
    v = unit.astype(np.float32)
    place = pd.Index(ids)
    lists = pdf["near"].to_numpy()
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    local = place.get_indexer(np.concatenate(lists)) if sizes.sum() else np.empty(0, np.int64)
    adjacency = np.full((len(ids), int(sizes.max(initial=1))), -1, np.int64)
    rows = np.repeat(np.arange(len(ids)), sizes)
    adjacency[rows, np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = local
    entries = []
    for part in {i, j}:
        own = np.flatnonzero(chunk == part)
        if len(own):
            entries.append(own[(v[own] @ v[own].mean(axis=0)).argmax()])
    a, b, _ = range_search(v, adjacency, np.array(entries), least)
    keep = a < b
    if i != j:
        keep &= chunk[a] != chunk[b]
    a, b = a[keep], b[keep]
    # the lowest shard that both are in counts the pair
    homes = np.stack(pdf["shards"].to_numpy())
    keep = np.ones(len(a), bool)
    for at in range(0, len(a), 200_000):
        x, y = homes[a[at : at + 200_000]], homes[b[at : at + 200_000]]
        shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
        low = np.where(shared, x, np.iinfo(np.int64).max).min(axis=1)
        cos = np.einsum("ij,ij->i", unit[a[at : at + 200_000]], unit[b[at : at + 200_000]])
        keep[at : at + 200_000] = (low == shard) & (cos >= least)
    a, b = a[keep], b[keep]
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    return _link_rows(ids, a, b, links)


def _link_rows(ids: np.ndarray, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pd.DataFrame:
    """(id, other or null, links) rows of the links between places a and b: every member of a group points to its first."""
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = np.flatnonzero(links > 0)
    other = pd.arrays.IntegerArray(ids[label[on]].astype(np.int64), label[on] == on)
    return pd.DataFrame({"id": ids[on], "other": other, "links": links[on].astype(np.int64)})


def _sampled_centres(vectors: DataFrame, k: int, n: int) -> np.ndarray:
    """At most k centres of a bounded sample of vectors."""
    k = max(1, min(k, MOST_BYTES // (4 * (vectors.select(F.size("v")).first()[0] or 1))))
    want = min(MOST_SAMPLE, n, max(1_024, SAMPLE_EACH * k))
    some = vectors.select("id", "v").orderBy(F.xxhash64("id")).limit(want).toPandas().sort_values("id", kind="stable")
    return centres(_unit(np.stack(some["v"].to_numpy()).astype(np.float64)).astype(np.float32), k)


def _links(vectors: DataFrame, least: float, overlap: int, n: int) -> DataFrame:
    """id, other (a vector of the same group, or null) and links, a row for each shard in which id has links. vectors: id, v, copies."""
    spark = vectors.sparkSession
    k = max(1, min(MOST_CENTRES, n * overlap // SHARD_ROWS))
    c = _sampled_centres(vectors, k, n)
    sent, own = spark.sparkContext.broadcast(c), min(overlap, len(c))

    @F.pandas_udf("array<long>")
    def homes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = sent.value
        for part in parts:
            out = []
            for at in range(0, len(part), 2048):
                sims = _unit(np.stack(part.iloc[at : at + 2048].to_numpy()).astype(np.float64)).astype(np.float32) @ c.T
                near = np.argpartition(-sims, own - 1, axis=1)[:, :own] if own < len(c) else np.tile(np.arange(len(c)), (len(sims), 1))
                out += [np.sort(r).astype(np.int64) for r in near]
            yield pd.Series(out)

    placed = vectors.withColumn("shards", homes("v")).withColumn("shard", F.explode("shards"))
    placed = materialize(placed, "vectors-placed")
    sizes = placed.groupBy("shard").agg(F.count("*").alias("size"))  # at most MOST_CENTRES rows
    placed = placed.join(F.broadcast(sizes), "shard")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    placed = placed.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), chunks).cast("int"))
    graph = placed.select("shard", "chunk", "id", "v").groupBy("shard", "chunk").applyInPandas(_shard_graph, "id long, near array<long>")
    united = materialize(graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vectors-graph")
    rows = placed.join(united, "id")
    # the chunk pairs that a member takes part in: itself with every chunk of its shard
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("chunk", "with")).withColumn("j", F.greatest("chunk", "with"))
    rows = rows.select("shard", "i", "j", "chunk", "id", "v", "copies", "shards", "near")
    return rows.groupBy("shard", "i", "j").applyInPandas(lambda pdf: _shard_links(pdf, least), "id long, other long, links long")


def _block_links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """All links inside a block (i = j), or between two: (id, other or null, links) rows."""
    pdf = pdf.sort_values(["block", "id"], kind="stable")
    ids, copies, block = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
    unit = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = np.nonzero(unit[left] @ unit[right].T >= least)
    a, b = left[a], right[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    return _link_rows(ids, a, b, links)


def _exact_links(vectors: DataFrame, least: float, n: int) -> DataFrame:
    """Like _links, with every link: a pair is looked at in the task of both vectors' blocks. vectors: id, v, copies."""
    k = max(1, min(MOST_CENTRES, n // CHUNK))
    c = _unit(_sampled_centres(vectors, k, n).astype(np.float64))
    sent, reach = vectors.sparkSession.sparkContext.broadcast(c), math.acos(max(-1.0, min(1.0, least))) + ROUNDING

    def angles(part: pd.Series, c: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(part), 256):
            yield np.arccos(np.clip(_unit(np.stack(part.iloc[at : at + 256].to_numpy()).astype(np.float64)) @ c.T, -1, 1))

    @F.pandas_udf("cell long, angle double")
    def home(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(x.argmin(axis=1), x.min(axis=1)) for x in angles(part, sent.value)]
            none = [(np.empty(0, np.int64), np.empty(0))]
            yield pd.DataFrame({"cell": np.concatenate([f[0] for f in none + found]), "angle": np.concatenate([f[1] for f in none + found])})

    placed = materialize(vectors.withColumn("home", home("v")).select("id", "v", "copies", "home.cell", "home.angle"), "vectors-cells")
    cells = materialize(placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / CHUNK).alias("chunks")), "vectors-radii")  # at most MOST_CENTRES rows
    radius = np.full(len(c), -np.inf)  # an empty cell meets nothing
    for r in cells.collect():
        radius[r["cell"]] = r["radius"]
    wide = vectors.sparkSession.sparkContext.broadcast(radius + reach)

    @F.pandas_udf("array<long>")
    def meets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.flatnonzero(row) for x in angles(part, sent.value) for row in x <= wide.value])

    # a block is a cell, or a chunk of a large one
    name = lambda cell, chunk: cell * F.lit(1 << 32) + chunk
    own = placed.join(F.broadcast(cells.select("cell", "chunks")), "cell")
    own = own.withColumn("block", name(F.col("cell"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")))).drop("chunks")
    rows = own.withColumn("met", F.explode(F.array_union(meets("v"), F.array("cell"))))
    rows = rows.join(F.broadcast(cells.select(F.col("cell").alias("met"), F.col("chunks"))), "met")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("with", name(F.col("met"), F.col("chunk")))
    rows = rows.select(F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "v", "copies")
    return rows.groupBy("i", "j").applyInPandas(lambda pdf: _block_links(pdf, least), "id long, other long, links long")


def audit_recall(vectors: DataFrame, links: DataFrame, least: float, audited: int = AUDITED) -> float:
    """Mean share of a vector's links that `links` (id, n_links) holds, over those of `audited` vectors that have any; by brute force over all rows.

    The audited vectors are those with the lowest hashes.
    """
    some = vectors.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(audited).toPandas()
    q, own = _unit(np.stack(some["v"].to_numpy()).astype(np.float64)), some["copies"].to_numpy()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(q))
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                total += ((q @ x.T) >= least) @ part["copies"].to_numpy().astype(np.float64)
        yield pd.DataFrame({"k": np.arange(len(q)), "n": total})

    true = vectors.select("v", "copies").mapInPandas(count, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas().set_index("k")["n"]
    true = true.reindex(range(len(q))).to_numpy() - own
    got = links.where(F.col("id").isin(some["id"].tolist())).toPandas().set_index("id")["n_links"].reindex(some["id"]).fillna(0).to_numpy()
    some_links = true > 0
    return float((np.minimum(got, true)[some_links] / true[some_links]).mean()) if some_links.any() else 1.0


def near_vectors(rows: DataFrame, least: float = 0.95, overlap: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", audits: list | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    audits, if given, gets a dict of each graph that was built: the vectors'
    length, the overlap, the recall found, and whether an exact pass followed.

    Two vectors link at cosine >= least; only vectors of one length meet.
    Vectors that are null, zero, or hold null or non-finite components link
    with nothing. A row with a null id is left alone (n_links 0, component null,
    kept). Rows that repeat an id are vectors of their own with one component,
    the ids' links added up. No rows give no rows. Other columns are ignored.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    base = base.withColumn("ok", F.coalesce(usable_vector(F.col("v")) & F.col("id").isNotNull(), F.lit(False)))
    base = base.withColumn("h", F.when(F.col("ok"), F.xxhash64("v")))
    base = materialize(base, "vectors")
    # equal vectors become one, named by the lowest id
    folded = base.where("ok").groupBy("h", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    folded = materialize(folded.withColumn("dim", F.size("v")), "vectors-folded")
    parts = []
    for dim, n in sorted((r[0], r[1]) for r in folded.groupBy("dim").count().collect()):
        # an id may stand for several vectors: number the vectors by their first id and hash
        own = folded.where(F.col("dim") == dim).select(F.xxhash64("first", "h").alias("id"), "v", "copies")
        wide = overlap
        while True:
            found = materialize(_links(own, least, wide, n), "vectors-links")
            counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
            recall = audit_recall(own, counts, least)
            if audits is not None:
                audits.append({"dim": dim, "overlap": wide, "recall": recall, "exact": recall < LEAST_RECALL and (2 * wide > MOST_OVERLAP or 4 * wide * SHARD_ROWS >= n)})
            if recall >= LEAST_RECALL:
                break
            wide *= 2
            # too few: a wider graph while it compares fewer pairs than there are, then all pairs that may link
            if wide > MOST_OVERLAP or 2 * wide * SHARD_ROWS >= n:
                found = materialize(_exact_links(own, least, n), "vectors-links")
                break
        parts.append(found)
    if not parts:
        none = base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return none
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select("id", "other"), "id", "other")
    vectors = folded.withColumn("id", F.xxhash64("first", "h")).drop("dim")
    whole = vectors.join(counts, "id", "left").join(named.withColumnRenamed("node", "id"), "id", "left")
    whole = materialize(whole.withColumn("component", F.coalesce("component", "id")), "vectors-named")
    sizes = materialize(whole.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "vectors-groups")
    total = whole.count()
    whole = heavy_join(whole, sizes, "component", "n", total).select("h", F.col("v").alias("own"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    whole = materialize(whole, "vectors-whole")
    # two vectors with one hash are told apart by their values
    by_hash = whole.groupBy("h").agg(F.sum("copies").alias("n"), F.collect_list(F.struct("own", "n_links", "component_id")).alias("same"))
    joined = heavy_join(base.where("ok"), by_hash, "h", "n", base.count())
    hit = F.get(F.filter("same", lambda s: s["own"] == F.col("v")), 0)
    good = joined.select("id", hit.alias("hit")).select("id", "hit.n_links", "hit.component_id")
    rest = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs by cosine, and what links reach, in DuckDB.
OP2_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, least(m.vec_id, coalesce(c.c, m.vec_id)) AS component_id, m.vec_id <= coalesce(c.c, m.vec_id) AS kept FROM embeddings m
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = m.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = m.vec_id"""
