"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the mix stands at the point frac(n / golden ratio) of [0, 1), and the
source whose stretch of cumulative weight covers that point supplies it. The
slots of a source are ranked, and the slot of rank k takes block k of the
source: its documents, shuffled by a hash and laid end to end again and again,
are cut into blocks of equal numbers of words. Blocks meet their slots in a join
by source and rank. Every prefix of the mix is close to the target weights, and
reruns agree.

A source has as many slots as its target has blocks. Its last one takes what is
left of the target, so that every source gives its target to the word; the few
blocks for which the points leave no slot follow at the end.

All of it is DataFrame operations. Running sums over a source, which may hold
a third of all rows, go by hash buckets: sums of buckets first, then sums
within a bucket. What is joined has a key for each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import heavy_join, materialize, read_table, repeated, text_hashes

#: Weights that sources have in the order of their names, again and again. Fixed values.
WEIGHTS = (5, 2, 1)
#: A source supplies at most so many times its own size.
MOST = 3
#: The golden ratio's fraction in 32 bits, and the cells of [0, 1) by which points find sources.
GOLDEN, CELLS = 2_654_435_769, 4_096
#: Rows that a hash bucket of a source should hold; words of a block; times that a text is taken for which it goes through one row.
BUCKET_ROWS, BLOCK, AT_ONCE = 5_000, 1_024, 1_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size): one row each, filled by weight up to most x size.

    Sources whose share passes their cap stop there, and the rest is shared
    anew. A source stops if cap / weight is below the level at which the others
    fill the total; with the sources in order of cap / weight, that level is
    found by one running sum.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.try_divide("_cap", "_w"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    below = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("_total", F.sum("source_size").over(whole).cast("double"))
    # the level, if this source and all after it in the order don't stop
    s = s.withColumn("_level", (F.col("_total") - below) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_stops", F.col("_level") * F.col("_w") > F.col("_cap"))
    s = s.withColumn("_free", F.min(F.when(~F.col("_stops"), F.struct(F.row_number().over(order).alias("i"), F.col("_level").alias("v")))).over(whole))
    target = F.when(F.row_number().over(order) < F.coalesce(F.col("_free.i"), F.lit(2**31 - 1)), F.col("_cap")).otherwise(F.col("_free.v") * F.col("_w"))
    return s.select("source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block: int, slots: int) -> DataFrame:
    """slot, source, rank, block_no and pass_no of each slot; block_no counts the source's blocks of `block` words from 0."""
    spark = targets.sparkSession
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, 0)
    t = targets.where("target > 0 and source_size > 0")
    t = t.withColumn("_hi", F.sum("target").over(order) / F.sum("target").over(whole))
    t = t.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("_hi", F.col("source").isNull(), F.col("source"))), F.lit(0.0)))
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    last = F.max("_hi").over(whole)
    t = t.withColumn("_hi", F.when(F.col("_hi") == last, F.lit(2.0)).otherwise(F.col("_hi")))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1)).cast("int")
    t = t.withColumn("cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    point = F.pmod(F.pmod(F.col("id"), F.lit(2**31)) * GOLDEN, F.lit(2**32)) / float(2**32)
    n = spark.range(slots).withColumn("_x", point).withColumn("cell", cell(F.col("_x")))
    hit = n.join(t, "cell").where("_x >= _lo and _x < _hi").select(F.col("id").alias("slot"), "source", "source_size", "n_blocks")
    # ranks within a source: first over runs of slots, then within a run
    hit = hit.withColumn("_run", F.floor(F.col("slot") / 4096))
    runs = hit.groupBy("source", "_run").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    hit = hit.alias("h").join(runs.alias("r"), (F.col("h.source").eqNullSafe(F.col("r.source"))) & (F.col("h._run") == F.col("r._run"))).select("h.*", "r._before")
    hit = hit.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("source", "_run").orderBy("slot")) - 1)
    return hit.select("slot", "source", "rank", (F.col("rank") % F.col("n_blocks")).alias("block_no"), F.floor(F.col("rank") / F.col("n_blocks")).alias("pass_no"))


def filled_slots(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, rank and need (words of the source's target) of all blocks of all targets (source, source_size, target, need)."""
    wanted = targets.where("need > 0").select("source", "need", F.ceil(F.col("need") / block).cast("long").alias("_m"))
    total = wanted.agg(F.coalesce(F.sum("_m"), F.lit(0))).first()[0]
    points = schedule(targets.where("need > 0"), block, total).select("slot", "source", "rank")
    same = F.col("p.source").eqNullSafe(F.col("w.source"))
    held = points.alias("p").join(F.broadcast(wanted.alias("w")) if total < 1_000_000 else wanted.alias("w"), same)
    held = held.where("rank < _m").select("slot", "p.source", "rank", "need")
    held = materialize(held, "mix-slots")
    got = held.groupBy("source").agg(F.count(F.lit(1)).alias("_got"))
    rest = wanted.alias("w").join(got.alias("g"), F.col("w.source").eqNullSafe(F.col("g.source")), "left").select("w.source", "need", "_m", F.coalesce("_got", F.lit(0)).alias("_got"))
    rest = rest.where("_got < _m").select("source", "need", F.explode(F.sequence(F.col("_got"), F.col("_m") - 1)).alias("rank"))
    # a few blocks a source: by how far they are through their target, so that the end is mixed too
    order = Window.orderBy((F.col("rank") * block) / F.col("need"), F.col("source").isNull(), "source", "rank")
    return held.unionByName(rest.select((F.row_number().over(order) - 1 + F.lit(total)).cast("long").alias("slot"), "source", "rank", "need"))


def _places(docs: DataFrame, weights: tuple, most: int, seed: int, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One row for rows that agree in source, id and text: doc_id, source, hashes, size, n (rows), source_size, target, need, and at (words of its source before it); and the targets."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), text_hashes(text).alias("hashes"))
    rows = materialize(rows.groupBy("source", "doc_id", "hashes", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    need = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    targets = materialize(source_targets(sizes, weights, most).withColumn("need", need).coalesce(1), "mix-targets")
    n_rows = rows.count()

    # where each document starts among the words of its source; the hash is of id and text, so that no id is hot
    bits = min(24, max(4, math.ceil(math.log2(max(1, n_rows) / BUCKET_ROWS + 1)) + 4))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "hashes"))
    rows = rows.withColumn("_bucket", F.shiftright(F.col("_h"), 64 - bits).cast("int"))
    words = F.col("size") * F.col("n")
    sums = rows.groupBy("source", "_bucket").agg(F.sum(words).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "_bucket", F.coalesce(earlier, F.lit(0)).alias("_before"))
    # a source's target goes with its buckets, so that its many rows never meet at one key
    sums = sums.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.target", "t.need")
    within = F.sum(words).over(Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "hashes").rowsBetween(Window.unboundedPreceding, -1))
    at = rows.withColumn("_within", F.coalesce(within, F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._bucket") == F.col("b._bucket"))
    places = at.alias("a").join(sums.alias("b"), same).select("a.doc_id", "a.source", "a.hashes", "a.size", "a.n", "b.source_size", "b.target", "b.need", (F.col("a._within") + F.col("b._before")).alias("at"))
    return places, targets


def _taken(places: DataFrame, most: int) -> DataFrame:
    """A row for each time that the source's words, gone through again and again, come to a row: its columns, _i (which of equal rows), first and last (words of the source before and with it, as far as the target goes)."""
    rows = repeated(places.where("size > 0"), "n", "_i")
    start = F.col("at") + F.col("_i") * F.col("size")
    passes = [F.struct((F.col("source_size") * p + start).alias("first"), F.least(F.col("source_size") * p + start + F.col("size"), F.col("need")).alias("last")) for p in range(most)]
    return rows.withColumn("_p", F.explode(F.filter(F.array(*passes), lambda x: x["first"] < x["last"]))).select("*", "_p.first", "_p.last").drop("_p")


def _on_slots(rows: DataFrame, slots: DataFrame, rank) -> DataFrame:
    """rows with the slot of their source's block `rank`: as many rows a key as lie in a block."""
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.rank") == F.col("s.rank"))
    return rows.withColumn("rank", rank).alias("r").join(slots.select("source", "rank", "slot").alias("s"), same).select("r.*", "s.slot")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the slots take of the row, repeats counted) of every row.

    A null text has size 0; a null source is a source of its own, the last one.
    A row without words is never taken. Rows with equal ids are mixed each for
    itself, in an order by hashes of id and text; rows that agree in both stand
    one after the other. No rows give no rows. Other columns are ignored.
    """
    places, targets = _places(docs, weights, most, seed, id_col, source_col, text_col)
    places = materialize(places, "mix-places")
    blocks = F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block)))
    met = _on_slots(_taken(places, most), filled_slots(targets, block), blocks)
    words = F.least(F.col("last"), (F.col("rank") + 1) * block) - F.greatest(F.col("first"), F.col("rank") * block)
    key = ["source", "doc_id", "hashes", "_i", "size", "source_size", "target"]
    none = repeated(places, "n", "_i").select(*key, F.lit(0).cast("long").alias("_w"))
    out = met.select(*key, words.cast("long").alias("_w")).unionByName(none).groupBy(*key).agg(F.sum("_w").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of docs, in the order of the slots: a row for each whole time that a document is taken, and one for a part.

    A document stands in the slot of the block that its first word lies in; each
    partition holds a stretch of slots, in order. A part is the document's first
    words with the white space between them; n_chars, if there is such a column,
    is set anew. Of rows that agree in source, id and text, the least by its
    columns stands for all. Null and empty texts, and texts without words, are
    never taken. No rows give no rows.
    """
    places, targets = _places(docs, weights, most, seed, id_col, source_col, text_col)
    slots = filled_slots(targets, block)
    n_slots = slots.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0] + 1
    times = _on_slots(_taken(materialize(places, "mix-places"), most), slots, F.floor(F.col("first") / block))
    times = times.select(F.struct("source", F.col("doc_id").alias("id"), "hashes").alias("_r"), F.col("n").alias("_n"), F.floor(F.col("_i") / AT_ONCE).alias("_c"), F.struct("slot", "first", (F.col("last") - F.col("first")).alias("words"), "size").alias("_t"))
    # one row a text, and more only where very many equal rows are taken
    plan = materialize(times.groupBy("_r", "_n", "_c").agg(F.collect_list("_t").alias("_t")), "mix-plan")
    total = plan.where("_c = 0").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    key = F.struct(F.col("_d")[source_col].alias("source"), F.col("_d")[id_col].alias("id"), text_hashes(F.col("_d")[text_col]).alias("hashes"))
    hits = heavy_join(rows.withColumn("_r", key), plan.where("_c = 0").select("_r", "_n", "_t"), "_r", "_n", total)
    again = hits.where("_n > 1").groupBy("_r").agg(F.min("_d").alias("_d"), F.first("_t").alias("_t"))
    out = hits.where("_n = 1").select("_d", "_t").unionByName(again.select("_d", "_t"))
    more = plan.where("_c > 0").select("_r", "_t")
    out = out.unionByName(again.select("_r", "_d").join(more, "_r").select("_d", "_t"))
    out = out.select("_d", F.explode("_t").alias("_t"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartitionById(parts, F.floor(F.col("_t.slot") * parts / n_slots).cast("int")).sortWithinPartitions("_t.slot", "_t.first")
    text = F.col("_d")[text_col]
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, F.col("_t.words").cast("int")), "")
    out = out.withColumn("_text", F.when(F.col("_t.words") == F.col("_t.size"), text).otherwise(head))
    new = {text_col: F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col("_d")[c]).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
