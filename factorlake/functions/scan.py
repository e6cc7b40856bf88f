"""Ranks and running values over keys of any size.

A window with a key runs in one task, which is right for the cross-section of a
date or the bars of a symbol, and wrong where one key holds a large share of all
rows: ranks of a factor over all dates, or the trades of a whole market. Here the
rows are dealt by ranges of (key, order) into segments of about SEGMENT_ROWS
rows, so that a key goes over as many tasks as it needs. What crosses the bounds
of segments is one small row a segment: counts, ties, sums, products, maxima, or
the decayed sums of an exponential mean. These are composed in order, FAN at a
time, level by level, and brought back to the rows.

The dealt rows are written once to the shared folder (functions/scratch.py): the
bounds of ranges come from a sample, and two readings must see the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Rows of a segment, about; states that one row composes.
SEGMENT_ROWS, FAN = 250_000, 64

FIRST = Window.unboundedPreceding


def segments(df: DataFrame, keys: list[str], order: list[str], rows: int = SEGMENT_ROWS, label: str = "segments") -> DataFrame:
    """df, written once, with _seg: a number that rises with (keys, order).

    Rows that agree in keys and order stay together, unless `order` ends in
    columns that tell them apart: give such columns where many rows may tie.
    """
    n = df.count()
    parts = max(1, math.ceil(n / rows))
    dealt = df.repartitionByRange(parts, *keys, *order) if parts > 1 else df.coalesce(1)
    return materialize(dealt.withColumn("_seg", F.spark_partition_id()), label)


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, nulls equal; right has one row a key. Left's columns, then right's others."""
    a, b = left.alias("a"), right.alias("b")
    others = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return a.join(b, _same(keys, "a", "b"), how).select("a.*", *others)


# --- composing states along a key ---------------------------------------------------------


def compose_states(states: DataFrame, keys: list[str], index: str, state: str, identity: Column, compose: Callable[[Column, Column], Column], fan: int = FAN) -> DataFrame:
    """keys, index and before: what the states of smaller index of the same key compose to, identity for the first.

    states has one row for each (keys, index), index from 0 and not necessarily
    without gaps. Blocks of `fan` indices are composed in one row each, then the
    blocks' own states likewise, until one block is left: no row holds over `fan` states.
    """
    block = F.floor(F.col(index) / fan).cast("long")
    listed = states.select(*keys, block.alias("_g"), F.struct(F.col(index).cast("long").alias("i"), F.col(state).alias("s")).alias("_x"))
    groups = listed.groupBy(*keys, "_g").agg(F.sort_array(F.collect_list("_x")).alias("_l"))
    kind = states.schema[state].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), identity.cast(kind).alias("acc"))
    run = F.aggregate("_l", start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["acc"])).alias("out"), compose(a["acc"], x["s"]).cast(kind).alias("acc")))
    groups = materialize(groups.withColumn("_r", run), "scan-blocks")
    inside = groups.select(*keys, "_g", F.explode(F.arrays_zip(F.col("_l").alias("l"), F.col("_r.out").alias("b"))).alias("_e"))
    inside = inside.select(*keys, "_g", F.col("_e.l.i").alias(index), F.col("_e.b").alias("before"))
    most = groups.agg(F.max("_g")).first()[0]
    if not most:
        return inside.drop("_g")
    above = compose_states(groups.select(*keys, F.col("_g").alias("_i"), F.col("_r.acc").alias("_s")), keys, "_i", "_s", identity, compose, fan)
    above = above.select(*keys, F.col("_i").alias("_g"), F.col("before").alias("_above"))
    out = join_same(inside, above, [*keys, "_g"])
    return out.select(*keys, index, compose(F.col("_above"), F.col("before")).cast(kind).alias("before"))


# --- ranks --------------------------------------------------------------------------------


def average_rank(df: DataFrame, value: str, keys: list[str], out: str, rows: int = SEGMENT_ROWS, label: str = "rank") -> DataFrame:
    """df with out: rank within keys from 1, ties get their mean rank; null values rank first, as they are sorted.

    A value's rank follows from its place among the rows of its segment, unless it
    is the segment's first or last one: these may go on in other segments, and
    are settled by one row for each end of a segment. Rows that tie are dealt by a
    hash of all their columns, so that a value that a third of all rows hold is spread.
    """
    n = math.ceil(df.count() / rows)
    spread = df.withColumn("_tie", F.xxhash64(*df.columns))
    seg = materialize((spread.repartitionByRange(n, *keys, value, "_tie") if n > 1 else spread.coalesce(1)).withColumn("_seg", F.spark_partition_id()).drop("_tie"), label)
    own = [*keys, "_seg"]
    w = Window.partitionBy(*own).orderBy(value)
    same = w.rangeBetween(Window.currentRow, Window.currentRow)
    local = seg.withColumns({"_less": F.rank().over(w) - 1, "_ties": F.count(F.lit(1)).over(same)})
    # the ends of each segment: its lowest and its highest value, how many rows hold them, and how many are less
    counts = seg.groupBy(*own, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*own).agg(
        F.sum("_c").alias("n"),
        F.min(F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))).alias("lo"),
        F.max(F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))).alias("hi"),
    )
    ends = materialize(ends, f"{label}-ends")
    zero = F.lit(0).cast("long")
    before = compose_states(ends.select(*own, "n"), keys, "_seg", "n", zero, lambda a, b: a + b)
    ends = join_same(ends, before, own)
    edge = ends.select(*own, "before", F.explode(F.array_distinct(F.array(F.struct(F.col("lo.v").alias("v"), zero.alias("less"), F.col("lo.c").alias("c")), F.struct(F.col("hi.v").alias("v"), (F.col("n") - F.col("hi.c")).alias("less"), F.col("hi.c").alias("c"))))).alias("e"))
    # rows less than an end's value, and rows that hold it, over all segments
    whole = edge.groupBy(*keys, F.col("e.v").alias("_v")).agg(F.min(F.struct("_seg", (F.col("before") + F.col("e.less")).alias("less"))).alias("_f"), F.sum("e.c").alias("_t"))
    whole = whole.select(*keys, "_v", (F.col("_f.less") + (F.col("_t") + 1) / 2).alias("_rank"))
    sides = {}
    for side in ("lo", "hi"):
        at = ends.select(*own, "before", F.col(f"{side}.v").alias("_v"))
        sides[side] = join_same(at, whole, [*keys, "_v"]).select(*own, "before", F.col("_v").alias(f"_{side}"), F.col("_rank").alias(f"_rank_{side}"))
    both = join_same(sides["lo"], sides["hi"].drop("before"), own)
    df = join_same(local, both, own)
    v = F.col(value)
    rank = F.when(v.eqNullSafe(F.col("_lo")), F.col("_rank_lo")).when(v.eqNullSafe(F.col("_hi")), F.col("_rank_hi")).otherwise(F.col("before") + F.col("_less") + (F.col("_ties") + 1) / 2)
    return df.withColumn(out, rank.cast("double")).drop("_seg", "_less", "_ties", "before", "_lo", "_hi", "_rank_lo", "_rank_hi")


# --- running values -----------------------------------------------------------------------


def with_index(df: DataFrame, keys: list[str], order: list[str], out: str = "_k", rows: int = SEGMENT_ROWS, label: str = "index") -> DataFrame:
    """df with out: the place of a row among those of its key, from 0. Rows that agree in keys and order come in any order."""
    seg = segments(df, keys, order, rows, label)
    own = [*keys, "_seg"]
    n = seg.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    before = compose_states(n, keys, "_seg", "_n", F.lit(0).cast("long"), lambda a, b: a + b)
    local = seg.withColumn(out, F.row_number().over(Window.partitionBy(*own).orderBy(*order)).cast("long") - 1)
    return join_same(local, before, own).withColumn(out, F.col(out) + F.col("before")).drop("before", "_seg")


@dataclass(frozen=True)
class Running:
    """A running value: `kind` sum, product, max or min of the column `value` up to and with each row, nulls left out; null before the first one."""

    kind: str
    value: str

    def aggregate(self) -> Column:
        return {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}[self.kind](self.value)

    def compose(self, a: Column, b: Column) -> Column:
        both = {"sum": a + b, "product": a * b, "max": F.greatest(a, b), "min": F.least(a, b)}[self.kind]
        return F.coalesce(both, a, b)


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running], rows: int = SEGMENT_ROWS, label: str = "running") -> DataFrame:
    """df with running values (out -> Running) along order within keys, in segments of about `rows` rows; order must tell a key's rows apart."""
    seg = segments(df, keys, order, rows, label)
    own = [*keys, "_seg"]
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(FIRST, 0)
    totals = seg.groupBy(*own).agg(F.struct(*[r.aggregate().alias(c) for c, r in values.items()]).alias("_s"))
    kind = totals.schema["_s"].dataType
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])

    def compose(a: Column, b: Column) -> Column:
        return F.struct(*[r.compose(a[c], b[c]).alias(c) for c, r in values.items()])

    before = compose_states(totals, keys, "_seg", "_s", none, compose).withColumnRenamed("before", "_before")
    local = seg.withColumns({f"_l_{c}": r.aggregate().over(w) for c, r in values.items()})
    out = join_same(local, before, own)
    return out.withColumns({c: r.compose(F.col("_before")[c], F.col(f"_l_{c}")) for c, r in values.items()}).drop("_seg", "_before", *[f"_l_{c}" for c in values])


def ewm_mean(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, alpha: float, min_periods: int, rows: int = SEGMENT_ROWS, label: str = "ewm") -> DataFrame:
    """df with out: exponentially weighted mean with normalised weights along order within keys, as panel.with_ewm_mean(), for keys of any size.

    Each row decays what is before it: an affine map of two sums, and maps of
    blocks compose. A block has as many rows as weights that grow by 1 / (1 - alpha)
    a row can stand in a double; its state is its mean, its weight at its end,
    how many values it has and how many rows it decays.
    """
    keep = 1.0 - alpha
    if not 0 < keep < 1:
        raise ValueError("alpha must lie between 0 and 1")
    size = max(1, min(rows, int(300 / -math.log(keep))))
    df = with_index(df, keys, order, "_k", rows, label)
    df = df.withColumns({"_b": F.floor(F.col("_k") / size), "_in": (F.col("_k") % size).cast("double")})
    # read twice below: block states, and rows
    df = materialize(df, f"{label}-blocks")
    some = F.col(value).isNotNull()
    grow = F.when(some, F.pow(F.lit(keep), -F.col("_in")))
    own = [*keys, "_b"]
    w = Window.partitionBy(*own).orderBy("_k").rowsBetween(FIRST, 0)
    local = df.withColumns({"_x": F.sum(F.col(value) * grow).over(w), "_w": F.sum(grow).over(w), "_c": F.count(value).over(w)})
    state = F.struct((F.sum(F.col(value) * grow) / F.sum(grow)).alias("mean"), (F.coalesce(F.sum(grow), F.lit(0.0)) * F.pow(F.lit(keep), F.max("_in"))).alias("weight"), F.count(value).alias("n"), (F.max("_in") + 1).alias("rows"))
    totals = df.groupBy(*own).agg(state.alias("_s"))
    none = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("rows"))

    def compose(a: Column, b: Column) -> Column:
        left = a["weight"] * F.pow(F.lit(keep), b["rows"])
        weight = left + b["weight"]
        mean = F.when(b["n"] == 0, a["mean"]).when(a["n"] == 0, b["mean"]).otherwise(F.coalesce(F.try_divide(a["mean"] * left + b["mean"] * b["weight"], weight), b["mean"]))
        return F.struct(mean.alias("mean"), weight.alias("weight"), (a["n"] + b["n"]).alias("n"), (a["rows"] + b["rows"]).alias("rows"))

    before = compose_states(totals, keys, "_b", "_s", none, compose).withColumnRenamed("before", "_before")
    rows_ = join_same(local, before, own)
    # in units of the block's first row: what is left of the weight before it
    left = F.col("_before.weight") * keep
    mean = F.when(F.col("_c") == 0, F.col("_before.mean")).when(F.col("_before.n") == 0, F.col("_x") / F.col("_w")).otherwise((F.col("_before.mean") * left + F.col("_x")) / (left + F.col("_w")))
    enough = F.col("_before.n") + F.col("_c") >= min_periods
    return rows_.withColumn(out, F.when(enough, mean)).drop("_k", "_b", "_in", "_x", "_w", "_c", "_before")
