"""Panel expressions: the date x symbol grid, and windows along a symbol's rows.

Factors that compare a symbol with its own past count rows of the union
calendar, so that their windows run over a dense grid (`densify`). Timing
factors count the symbol's own rows and use the bars as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scratch import materialize, stored

FAR = Window.unboundedPreceding
#: Rows of a part of a panel, about.
PART_ROWS = 60_000


def by_date(*keys: str) -> WindowSpec:
    """Rows of one symbol (or of other keys) in time."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def calendar(df: DataFrame) -> DataFrame:
    """date_idx (from 0) and date of every date present; one row a day, made from one array."""
    days = df.select(F.col("date")).where("date is not null").distinct()
    return days.agg(F.sort_array(F.collect_list("date")).alias("d")).select(F.posexplode("d").alias("date_idx", "date"))


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by keys (symbol, if none) into as many parts as hold about PART_ROWS rows each.

    Rows of bars are short, and windows by symbol sort and keep them several times
    in one task: parts merged by their bytes, or a fixed number of them, would give a
    task more memory with every further symbol. rows: the number of rows, if it is known; else df is stored and counted.
    """
    if rows is None:
        df = stored(df, "dealt")
        rows = df.count()
    return df.repartition(max(1, math.ceil(rows / PART_ROWS)), *(keys or ("symbol",)))


def by_symbol_already(df: DataFrame) -> bool:
    """Whether df reads a table that is stored in buckets, as bars by symbol are: their number is the store's, and no rows need to move."""
    nodes = [df._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation" and node.relation().bucketSpec().isDefined():
            return True
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return False


def densify(df: DataFrame, *values: str, days_of: DataFrame | None = None) -> DataFrame:
    """symbol, date_idx, date and values of every (calendar day, symbol); null where df has no row. The days are those of days_of, or of df.

    Each row of df stands for its own day and for the days after it without a row,
    a symbol's first one also for those before. So the grid takes one shuffle of df's
    rows by symbol, of which windows by symbol make use. Days and rows are
    readings of df: what is more than a stored table with filters is written once before, so that its sources are read once.
    """
    values = values or tuple(c for c in df.columns if c not in ("date", "symbol"))
    df = stored(df.select("date", "symbol", *values), "bars")
    days = materialize(calendar(df if days_of is None else days_of).withColumn("date_idx", F.col("date_idx").cast("int")), "calendar")
    n = days.count()
    symbols = df.agg(F.approx_count_distinct("symbol")).first()[0] + 1
    # a row without a symbol matches no day, but its symbol has days, as any other
    at = df.join(F.broadcast(days), (df["date"] == days["date"]) & df["symbol"].isNotNull(), "left").select(df["symbol"], "date_idx", *[df[c] for c in values])
    if not by_symbol_already(df):
        at = dealt(at, rows=max(df.count(), symbols * n))
    w = Window.partitionBy("symbol").orderBy("date_idx")
    i, following = F.col("date_idx"), F.lead("date_idx").over(w)
    low = F.when(i.isNull() | F.lag("date_idx").over(w).isNull(), 0).otherwise(i)
    high = F.when(i.isNull(), n - 1).otherwise(F.greatest(i, F.coalesce(following - 1, F.lit(n - 1))))
    spans = at.withColumns({"_low": low, "_high": high, "_more": F.lead(F.lit(1)).over(w)}).where(F.col("date_idx").isNotNull() | F.col("_more").isNull())
    if not n:
        spans = spans.where(F.lit(False))
    grid = spans.withColumn("_i", F.explode(F.sequence("_low", "_high"))).select("symbol", F.col("_i").alias("date_idx"), *[F.when(F.col("_i") == i, F.col(c)).alias(c) for c in values])
    return grid.join(F.broadcast(days), "date_idx").select("symbol", "date_idx", "date", *values)


def melt(df: DataFrame, keys: list[str], values: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    """Wide to long, without nulls."""
    return df.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def clean(c: Column) -> Column:
    """Null for NaN and infinities: they are never carried."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip_lower(c: Column, low: float = 0.0) -> Column:
    """max(c, low), null for null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def ffill(c: Column, w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    return F.last(c, ignorenulls=True).over(w.rowsBetween(FAR, 0))


def shift(c: Column, k: int, w: WindowSpec | None = None) -> Column:
    """k rows back; forward if k is negative."""
    w = w or by_date()
    return F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w)


def diff(c: Column, w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    return c - F.lag(c, 1).over(w)


def pct_change(df: DataFrame, value: str, out: str, n: int = 1, fill: str | None = "pad", w: WindowSpec | None = None) -> DataFrame:
    """df with column out: value over the one n rows before, less 1; gaps are padded first unless fill is None."""
    w = w or by_date()
    if fill == "pad":
        df = df.withColumn("_pad", ffill(F.col(value), w))
        return df.withColumn(out, F.try_divide(F.col("_pad"), F.lag("_pad", n).over(w)) - 1).drop("_pad")
    return df.withColumn(out, F.try_divide(F.col(value), F.lag(value, n).over(w)) - 1)


def rolling(c: Column, n: int, agg, w: WindowSpec | None = None) -> Column:
    """agg over the last n rows, null unless all n are there and not null."""
    w = w or by_date()
    part = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(part) == n, agg(c).over(part))


def rolling_mean(c: Column, n: int, w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    return rolling(c, n, F.avg, w)


def rolling_std(c: Column, n: int, ddof: int = 1, w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    return rolling(c, n, F.stddev_samp if ddof else F.stddev_pop, w)


def rolling_corr(a: Column, b: Column, n: int, w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    part = w.rowsBetween(-(n - 1), 0)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_samp(a, b).over(part), F.stddev_samp(a).over(part) * F.stddev_samp(b).over(part))
    return F.when(F.count(a).over(part) == n, r)


def with_ewm_mean(df: DataFrame, value: str, out: str, alpha: float, min_periods: int, w: WindowSpec | None = None, keys: tuple[str, ...] = ("symbol",), segment: int | None = None) -> DataFrame:
    """df with column out: exponentially weighted mean with normalised weights over each key's rows, for histories of any length.

    Two running sums with weights that grow by 1 / (1 - alpha) a row. They would
    overflow a double, so that they begin anew every `segment` rows; what earlier
    segments leave, a mean and a weight each, is folded into one pair. Gaps count
    as rows. Null until min_periods values are there, then never.
    """
    w = w or by_date(*keys)
    keep = 1.0 - alpha
    if keep <= 0:  # only the last value counts
        return df.withColumn(out, F.when(F.count(value).over(w.rowsBetween(FAR, 0)) >= min_periods, ffill(F.col(value), w)))
    # at 1e+200 the sums are far from both ends of a double
    segment = segment or max(1, int(460 / -math.log(keep)))
    df = df.withColumn("_k", F.row_number().over(w) - 1)
    df = df.withColumns({"_in": F.col("_k") % segment, "_seg": F.floor(F.col("_k") / segment)})
    df = df.withColumn("_w", F.pow(F.lit(keep), -F.col("_in").cast("double")))
    own = Window.partitionBy(*keys, "_seg").orderBy("_k").rowsBetween(FAR, 0)
    some = F.col(value).isNotNull()
    df = df.withColumns({"_top": F.coalesce(F.sum(F.col(value) * F.col("_w")).over(own), F.lit(0.0)), "_bottom": F.coalesce(F.sum(F.when(some, F.col("_w"))).over(own), F.lit(0.0))})
    # a segment's last row tells its mean and what its weight is worth by then
    ends = F.when(F.col("_in") == segment - 1, F.struct(F.try_divide("_top", "_bottom").alias("mean"), (F.col("_bottom") * F.pow(F.lit(keep), F.lit(float(segment - 1)))).alias("weight")))
    earlier = F.collect_list(ends).over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(FAR, -1))
    none = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("weight"))
    whole = keep**segment

    def fold(a: Column, x: Column) -> Column:
        weight = a["weight"] * whole + x["weight"]
        mean = F.when(x["weight"] > 0, (F.coalesce(a["mean"] * a["weight"], F.lit(0.0)) * whole + x["mean"] * x["weight"]) / weight).otherwise(a["mean"])
        return F.struct(mean.alias("mean"), weight.alias("weight"))

    df = df.withColumn("_c", F.aggregate(earlier, none, fold))
    left = F.col("_c.weight") * keep
    mean = (F.coalesce(F.col("_c.mean") * left, F.lit(0.0)) + F.col("_top")) / (left + F.col("_bottom"))
    enough = F.count(value).over(w.rowsBetween(FAR, 0)) >= min_periods
    df = df.withColumn(out, F.when(enough, F.when(F.col("_bottom") > 0, mean).otherwise(F.col("_c.mean"))))
    return df.drop("_k", "_in", "_seg", "_w", "_top", "_bottom", "_c")


def cumprod(c: Column, w: WindowSpec | None = None) -> Column:
    """Running product of the rows that aren't null; null where c is."""
    w = w or by_date()
    return F.when(c.isNotNull(), F.product(c).over(w.rowsBetween(FAR, 0)))


def drawdown(nav: str, w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    return F.try_divide(F.col(nav), F.max(nav).over(w.rowsBetween(FAR, 0))) - 1


def longest_run(df: DataFrame, keys: list[str], order: str, on: Column, out: str = "longest") -> DataFrame:
    """Per key, the longest run of rows in a row on which `on` holds (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    df = df.withColumn("_island", F.sum(F.when(~F.col("_on"), 1).otherwise(0)).over(w.rowsBetween(FAR, 0)))
    runs = df.groupBy(*keys, "_island").agg(F.sum(F.col("_on").cast("long")).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias(out))


def period_end(freq: str, date: str = "date") -> Column:
    """The bucket of a date: its period's last day. W-FRI (any weekday), ME / M, QE / Q, YE / Y, or D."""
    d = F.col(date)
    if freq.startswith("W"):
        return F.next_day(F.date_sub(d, 1), freq[2:] or "SUN")
    kinds = {"D": d, "M": F.last_day(d), "Q": F.last_day(F.add_months(F.trunc(d, "quarter"), 2)), "Y": F.last_day(F.add_months(F.trunc(d, "year"), 11))}
    key = freq[:1]
    if freq not in ("D", "M", "ME", "Q", "QE", "Y", "YE"):
        raise ValueError(f"unknown frequency: {freq}")
    return kinds[key]


def last_dates(days: DataFrame, freq: str) -> DataFrame:
    """date: the last one present in each period, the last period included even if not over."""
    return days.select("date").distinct().groupBy(period_end(freq).alias("_p")).agg(F.max("date").alias("date")).select("date")
