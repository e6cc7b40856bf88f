"""Rolling moments whose cost doesn't grow with the window.

A frame of n rows that is aggregated anew in every row costs n a row. Here a key's
rows are cut into blocks of n: the window that ends in a row is what its block
holds up to the row, and what the block before holds from the row n - 1 back on.
Both are running moments, one forward and one backward, in which a row adds one
value; and moments of two parts merge exactly (counts, means, sums of squared and
of crossed deviations), without differences of large sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows from which on this costs less than frames do, about.
LONG = 64


def _moments(x: Column, y: Column | None, w) -> Column:
    n = F.count(x).over(w)
    parts = {"n": n.cast("double"), "mx": F.avg(x).over(w), "sx": F.var_pop(x).over(w) * n}
    if y is not None:
        parts |= {"my": F.avg(y).over(w), "sy": F.var_pop(y).over(w) * n, "c": F.covar_pop(x, y).over(w) * n}
    return F.struct(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()])


def merged(a: Column, b: Column, both: bool) -> Column:
    """Moments of two parts together; an empty part changes nothing."""
    n = a["n"] + b["n"]
    share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
    cross = a["n"] * share
    dx = b["mx"] - a["mx"]
    parts = {"n": n, "mx": a["mx"] + dx * share, "sx": a["sx"] + b["sx"] + dx * dx * cross}
    if both:
        dy = b["my"] - a["my"]
        parts |= {"my": a["my"] + dy * share, "sy": a["sy"] + b["sy"] + dy * dy * cross, "c": a["c"] + b["c"] + dx * dy * cross}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def with_rolling_moments(df: DataFrame, x: str, n: int, out: str = "_m", y: str | None = None, keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """df with out: count, mean and sum of squared deviations (n, mx, sx) of x over the last n rows of a key; with y also my, sy and c, over rows in which both are there.

    Fewer rows than n give the moments of what is there; nulls are left out.
    """
    if n < 1:
        raise ValueError("a window has one row at least")
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_k", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_k") / n))
    vx, vy = F.col(x), None if y is None else F.col(y)
    if vy is not None:
        some = vx.isNotNull() & vy.isNotNull()
        vx, vy = F.when(some, vx), F.when(some, vy)
    block = Window.partitionBy(*keys, "_b")
    up = block.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    down = block.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_up": _moments(vx, vy, up)}).withColumns({"_down": _moments(vx, vy, down)})
    # n - 1 rows back: in the block before, unless the row ends its own
    df = df.withColumn("_back", F.lag("_down", n - 1).over(w))
    whole = merged(F.col("_back"), F.col("_up"), y is not None)
    ends = (F.col("_k") + 1) % n == 0
    return df.withColumn(out, F.when(ends | F.col("_back").isNull(), F.col("_up")).otherwise(whole)).drop("_k", "_b", "_up", "_down", "_back")


def mean_of(m: str, n: int) -> Column:
    """Of a column of moments; null unless all n values of the window are there."""
    return F.when(F.col(f"{m}.n") == n, F.col(f"{m}.mx"))


def std_of(m: str, n: int, ddof: int = 1) -> Column:
    return F.when((F.col(f"{m}.n") == n) & (F.col(f"{m}.n") > ddof), F.sqrt(F.greatest(F.col(f"{m}.sx"), F.lit(0.0)) / (F.col(f"{m}.n") - ddof)))


def corr_of(m: str, n: int) -> Column:
    """Null too where a side doesn't vary."""
    return F.when(F.col(f"{m}.n") == n, F.try_divide(F.col(f"{m}.c"), F.sqrt(F.col(f"{m}.sx")) * F.sqrt(F.col(f"{m}.sy"))))
