"""Removal of multi-line passages that occur again, by content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over two neighbouring lines is
taken at each. Where it is lower than at the lines before and after, a chunk
begins. The choice depends on the lines close by only, so that a passage is cut
alike wherever it stands, and every such chunk but a text's last has two lines at
least. Chunks of two lines or more may go.

Only hashes are grouped over the whole corpus, combined on the map side, so
that a chunk that a third of all texts hold costs one row a task. Texts that hold
a hash seen in several places are then looked at once more: their chunks are
grouped by hash and bytes, and what goes is decided by bytes. A hash that only
one kind of chunk has stands for its bytes; chunks of different bytes with one
hash are joined by their bytes. Of equal chunks the first stays: in the
lowest id, there the one that comes first. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import heavy_join, let, materialize, read_table


def _wordy(line: Column, words: int) -> Column:
    """Whether a line has more than `words` words, by its spaces."""
    return (F.octet_length(line) > 2 * words) & (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) >= words)


def chunks(text: Column, passage_words: int | None = None) -> Column:
    """array<struct<lines: int, goes: boolean, text: string>> of a text's chunks, in order; goes: may be removed. Null for a null text."""
    lines = F.split(text, "\n", -1)

    def rolled(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.element_at(hashes, F.least(i + 2, n))))

    def starts(x: Column) -> Column:
        """x: struct of the rolling hashes and of which lines are chunks of their own."""
        r, n = x["r"], F.size(x["r"])
        low = lambda i: (i > 2) & (i < n) & (F.get(r, i - 1) < F.get(r, i - 2)) & (F.get(r, i - 1) < F.get(r, i))
        alone = lambda i: F.get(x["w"], i - 1) | F.get(x["w"], i - 2)
        begins = low if passage_words is None else lambda i: low(i) | alone(i)
        inner = F.when(n > 1, F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), begins)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(F.lit(1)), inner)

    def cut(x: Column) -> Column:
        """x: struct of the lines, of which are chunks of their own, and the numbers of the lines that chunks start at."""
        n, s = F.size(x["l"]), F.size(x["s"])
        end = lambda k: F.when(k + 2 > s, n + 1).otherwise(F.get(x["s"], k + 1))
        goes = lambda start, k: (end(k) - start > 1) | (F.lit(False) if passage_words is None else F.get(x["w"], start - 1))
        body = lambda start, k: F.struct((end(k) - start).alias("lines"), goes(start, k).alias("goes"), F.array_join(F.slice(x["l"], start, end(k) - start), "\n").alias("text"))
        return F.transform(x["s"], body)

    def whole(v: Column) -> Column:
        wordy = F.array().cast("array<boolean>") if passage_words is None else F.transform(v, lambda line: _wordy(line, passage_words))
        both = F.struct(let(F.transform(v, lambda line: F.xxhash64(line)), rolled).alias("r"), wordy.alias("w"))
        return let(both, lambda x: let(F.struct(v.alias("l"), x["w"].alias("w"), starts(x).alias("s")), cut))

    return F.when(text.isNotNull(), let(lines, whole))


#: What a row is known by: its id, and 128 bits of its text. Rows that agree in it are alike and get one result.
ROW = ["_id", "_t", "_u"]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """All columns of docs with text cleaned, and n_lines, n_removed (lines) and n_chunks_removed.

    A chunk of two lines or more that occurs more than once in all of docs stays
    only at its first place. With passage_words, a line of more words than that is
    a chunk by itself, and may go too. Lines that stay keep their order. A null
    text stays null, with 0 lines; an empty text is one empty line. Rows that
    agree in id and text are one place: each keeps its first such chunk, if it is
    the lowest. Of rows with one id and different texts, one is the first place. A
    null id ranks after all others. No rows give no rows. A column of docs with
    a name that is added here is replaced. `hashed` stands for the chunks' hash;
    results don't depend on it.
    """
    added = ["n_lines", "n_removed", "n_chunks_removed"]
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_d"))
    id_, text = F.col("_d")[id_col], F.col("_d")[text_col]
    rows = rows.select(id_.alias("_id"), F.xxhash64(text).alias("_t"), F.xxhash64(F.lit(7), text).alias("_u"), "_d")
    # a text of one line has nothing to lose
    may = F.coalesce(F.contains(text, F.lit("\n")), F.lit(False)) if passage_words is None else text.isNotNull()
    own = F.posexplode(chunks(text, passage_words)).alias("_k", "_c")
    seen = rows.where(may).select(*ROW, own).where("_c.goes").select(*ROW, "_k", hashed(F.col("_c.text")).alias("_h"))
    seen = materialize(seen, "lines-seen")
    again = materialize(seen.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1"), "lines-again")
    total = again.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    asked = heavy_join(seen, again, "_h", "_n", total).groupBy(*ROW).agg(F.collect_set("_k").alias("_ks"))
    # the only time that whole texts are shuffled
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ROW]
    joined = rows.where(may).alias("a").join(asked.alias("b"), same[0] & same[1] & same[2], "left").select("a.*", "b._ks")
    joined = materialize(joined, "lines-joined")

    # the chunks with such hashes, told apart by their bytes
    some = joined.where("_ks is not null").select(*ROW, "_ks", own).where(F.array_contains("_ks", F.col("_k")))
    some = some.select(*ROW, "_k", hashed(F.col("_c.text")).alias("_h"), F.col("_c.text").alias("_own"))
    place = F.struct(F.col("_id").isNull().alias("no"), *ROW)
    kinds = materialize(some.groupBy("_h", "_own").agg(F.count("*").alias("_n"), F.min(place).alias("_first")), "lines-kinds")
    of_hash = kinds.groupBy("_h").agg(F.count("*").alias("_kinds"))
    alone, odd = of_hash.where("_kinds = 1").select("_h"), of_hash.where("_kinds > 1").select("_h")
    alone = kinds.join(alone, "_h", "left_semi").where("_n > 1").select("_h", "_n", "_first")
    hits = heavy_join(some.drop("_own"), alone, "_h", "_n", total).select(*ROW, "_k", "_first", F.lit(None).cast("string").alias("_own"), "_h")
    if odd.limit(1).count():
        mixed = kinds.join(odd, "_h", "left_semi").where("_n > 1").drop("_h")
        hits = hits.unionByName(heavy_join(some.join(odd, "_h", "left_semi"), mixed, "_own", "_n", total).select(*ROW, "_k", "_first", "_own", "_h"))
    # in the first place, the first of equal chunks stays
    per_row = hits.groupBy(*ROW, "_h", "_own", "_first").agg(F.collect_set("_k").alias("_ks"))
    is_first = F.struct(F.col("_id").isNull().alias("no"), *ROW).eqNullSafe(F.col("_first"))
    stays = F.when(is_first, F.slice(F.array_sort("_ks"), F.lit(2), F.size("_ks"))).otherwise(F.col("_ks"))
    goes = per_row.select(*ROW, F.explode(stays).alias("_k")).groupBy(*ROW).agg(F.collect_set("_k").alias("_goes"))

    def keep(x: Column) -> Column:
        """x: struct of the chunks and the numbers that go."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["c"]) - 1), x["g"])
        return F.struct(
            F.array_join(F.transform(kept, lambda k: F.get(x["c"], k)["text"]), "\n").alias("text"),
            F.aggregate(x["c"], F.lit(0), lambda n, c: n + c["lines"]).alias("n"),
            F.aggregate(x["g"], F.lit(0), lambda n, k: n + F.get(x["c"], k)["lines"]).alias("removed"),
        )

    hit = joined.where("_ks is not null").drop("_ks").alias("a").join(goes.alias("b"), same[0] & same[1] & same[2], "left").select("a._d", "b._goes")
    # a text that loses nothing isn't cut again
    cleaned = F.when(F.col("_goes").isNotNull(), let(F.struct(chunks(text, passage_words).alias("c"), F.col("_goes").alias("g")), keep))
    hit = hit.withColumn("_done", cleaned)
    rest = joined.where("_ks is null").select("_d").unionByName(rows.where(~may).select("_d"))
    out = hit.unionByName(rest, allowMissingColumns=True)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1)))
    back = [F.coalesce("_done.text", text).alias(c) if c == text_col else F.col("_d")[c].alias(c) for c in names]
    return out.select(*back, F.coalesce("_done.n", n_lines).alias("n_lines"), F.coalesce("_done.removed", F.lit(0)).alias("n_removed"), F.coalesce(F.size("_goes"), F.lit(0)).alias("n_chunks_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text cleaned of passages that occur before."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
