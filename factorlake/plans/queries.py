"""The registered queries, each over whole tables, and the DuckDB SQL that must give the same rows.

Both sides round what is computed in floating point at the very end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import moments as M
from ..functions import panel as P
from ..functions import scan
from ..functions import stats as S
from ..functions.scratch import scratch_dir, stored
from ..operators import analyze as A
from ..operators import boost as B
from ..operators import factors as FA
from ..operators import gram as G
from ..operators import portfolio as PF
from ..operators import selection as SE
from ..operators import timing as T
from ..operators.ml import Lasso, Ridge, row_numbers, time_folds
from ..operators.simulate import CashAccountEngine
from ..schema import RAW_BARS, TABLES
from ..sources import etl, loaders
from ..sources import fixtures as X
from ..sources.barstore import BarStore
from ..sources.tablelog import TableLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FACTORS = [FA.Momentum(5), FA.Momentum(20), FA.Volatility(20), FA.HighLowSpread(20)]


def query(sql: str | None = None, name: str | None = None):
    def take(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return take


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: X.half_up(F.col(c), digits) for c in names})


def _calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that most queries start from: derived from the trades once a query, and stored for its several readings."""
    return stored(X.calm_bars(spark, sf_dir), "bars")


# --- SQL pieces -------------------------------------------------------------------


def bars_sql(bucket: str = "week") -> str:
    return f"""SELECT CAST(date_trunc('{bucket}', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS symbol,
  arg_min(u, k) AS open, max(u) AS high, min(u) AS low, arg_max(u, k) AS close, sum(l_quantity) AS volume, floor(sum(l_extendedprice) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS amount
FROM (SELECT *, floor(l_extendedprice / l_quantity * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS u, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem WHERE l_quantity <> 0)
GROUP BY 1, 2"""


USER_SQL = """SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""
CALM = f"""bars AS ({bars_sql()}),
calm AS (SELECT date, symbol, floor((100 + ln(open)) * 1e6 + 0.5) / 1e6 AS open, floor((100 + ln(high)) * 1e6 + 0.5) / 1e6 AS high, floor((100 + ln(low)) * 1e6 + 0.5) / 1e6 AS low, floor((100 + ln(close)) * 1e6 + 0.5) / 1e6 AS close, volume, amount FROM bars),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM calm)),
grid AS (SELECT s.symbol, c.date_idx, c.date, b.open, b.high, b.low, b.close, b.volume,
    last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.date_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc,
    last_value(b.volume IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.date_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv
  FROM (SELECT DISTINCT symbol FROM calm) s CROSS JOIN cal c LEFT JOIN calm b ON b.symbol = s.symbol AND b.date = c.date)"""
WS = "OVER (PARTITION BY symbol ORDER BY date_idx)"
WB = "OVER (PARTITION BY symbol ORDER BY date)"


def win(n: int, w: str = WS) -> str:
    return w[:-1] + f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def chg(c: str, n: int, w: str = WS) -> str:
    return f"({c} / nullif(lag({c}, {n}) {w}, 0) - 1)"


def full(agg: str, c: str, n: int, w: str = WS) -> str:
    return f"CASE WHEN count({c}) {win(n, w)} = {n} THEN {agg} {win(n, w)} END"


def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


MOM = lambda n: f"SELECT date, symbol, {chg('pc', n)} AS value FROM grid"
VOL = lambda n: f"SELECT date, symbol, {full('stddev_samp(x)', 'x', n)} AS value FROM (SELECT *, {chg('pc', 1)} AS x FROM grid)"
HLS = lambda n: f"SELECT date, symbol, {full('avg(x)', 'x', n)} AS value FROM (SELECT *, (high - low) / nullif(close, 0) AS x FROM grid)"
ALPHA = f"""SELECT date, symbol, CASE WHEN count(a) {win(20)} = 20 THEN covar_samp(a, b) {win(20)} / nullif(stddev_samp(a) {win(20)} * stddev_samp(b) {win(20)}, 0) END AS value
FROM (SELECT date, symbol, date_idx, CASE WHEN p IS NOT NULL AND v IS NOT NULL THEN p END AS a, CASE WHEN p IS NOT NULL AND v IS NOT NULL THEN v END AS b
  FROM (SELECT *, {chg("pc", 5)} AS p, {chg("pv", 5)} AS v FROM grid))"""
MA = f"SELECT date, symbol, CAST(coalesce(sign({full('avg(close)', 'close', 5, WB)} - {full('avg(close)', 'close', 20, WB)}), 0) AS INTEGER) AS value FROM calm"
RSI = f"""SELECT date, symbol, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS value FROM (
  SELECT *, CASE WHEN al = 0 THEN 0.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM (
    SELECT date, symbol, CASE WHEN count(g) {WB[:-1]} ROWS UNBOUNDED PRECEDING) >= 14 THEN sum(g * w) {WB[:-1]} ROWS UNBOUNDED PRECEDING) / sum(CASE WHEN g IS NOT NULL THEN w END) {WB[:-1]} ROWS UNBOUNDED PRECEDING) END AS ag,
      CASE WHEN count(l) {WB[:-1]} ROWS UNBOUNDED PRECEDING) >= 14 THEN sum(l * w) {WB[:-1]} ROWS UNBOUNDED PRECEDING) / sum(CASE WHEN l IS NOT NULL THEN w END) {WB[:-1]} ROWS UNBOUNDED PRECEDING) END AS al
    FROM (SELECT date, symbol, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS l, w
      FROM (SELECT date, symbol, close - lag(close) {WB} AS d, pow(1 - 1.0 / 14, -CAST(row_number() {WB} - 1 AS DOUBLE)) AS w FROM calm))))"""
FACTOR_SQL = f"""fac AS (SELECT date, symbol, factor, value AS raw, floor(value * 1e10 + 0.5) / 1e10 AS value FROM (SELECT 'momentum_5' AS factor, * FROM ({MOM(5)}) UNION ALL SELECT 'momentum_20', * FROM ({MOM(20)})
  UNION ALL SELECT 'volatility_20', * FROM ({VOL(20)}) UNION ALL SELECT 'highlow_spread_20', * FROM ({HLS(20)})) WHERE value IS NOT NULL)"""


def fwd_sql(price: str, periods=SE.PERIODS) -> str:
    parts = " UNION ALL ".join(f"SELECT date, symbol, {p} AS period, lead({price}, {1 + p}) {WS} / nullif(lead({price}, 1) {WS}, 0) - 1 AS ret FROM grid" for p in periods)
    return f"fwd AS (SELECT * FROM ({parts}) WHERE ret IS NOT NULL)"


def ic_sql(method: str, factors: str = "fac", returns: str = "fwd", name: str = "ic") -> str:
    keys = "factor, period, date"
    if method == "rank":
        rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
        src = f"(SELECT {keys}, {rank('value')} AS a, {rank(r('ret', 10))} AS b FROM {factors} JOIN {returns} USING (date, symbol))"
    else:
        src = f"(SELECT {keys}, raw AS a, ret AS b FROM {factors} JOIN {returns} USING (date, symbol))"
    return f"{name} AS (SELECT {keys}, CASE WHEN count(*) >= 3 THEN covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) END AS ic FROM {src} GROUP BY ALL)"


#: Interpolated quantile edges, by the value's place among n sorted ones.
QCUT = """both5 AS (SELECT *, row_number() OVER (PARTITION BY factor, period, date ORDER BY value, symbol) - 1 AS r, count(*) OVER (PARTITION BY factor, period, date) AS n FROM fac JOIN fwd USING (date, symbol)),
kept AS (SELECT * FROM both5 WHERE n >= 5),
edge AS (SELECT factor, period, date, list_distinct(list(DISTINCT e)) AS es FROM (
  SELECT k.factor, k.period, k.date, s.q, max(CASE WHEN k.r = floor((k.n - 1) * s.q) THEN k.value END) AS lo, max(CASE WHEN k.r = ceil((k.n - 1) * s.q) THEN k.value END) AS hi, any_value((k.n - 1) * s.q) AS pos,
    CASE WHEN floor(any_value((k.n - 1) * s.q)) = ceil(any_value((k.n - 1) * s.q)) THEN max(CASE WHEN k.r = floor((k.n - 1) * s.q) THEN k.value END)
      ELSE (ceil(any_value((k.n - 1) * s.q)) - any_value((k.n - 1) * s.q)) * max(CASE WHEN k.r = floor((k.n - 1) * s.q) THEN k.value END) + (any_value((k.n - 1) * s.q) - floor(any_value((k.n - 1) * s.q))) * max(CASE WHEN k.r = ceil((k.n - 1) * s.q) THEN k.value END) END AS e
  FROM kept k CROSS JOIN (VALUES (0.0::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) s(q) GROUP BY k.factor, k.period, k.date, s.q) GROUP BY ALL),
grp AS (SELECT k.*, CASE WHEN len(es) > 1 THEN greatest(len(list_filter(es, lambda x: x < k.value)), 1) END AS grp FROM kept k JOIN edge USING (factor, period, date)),
gret AS (SELECT factor, period, date, grp, avg(ret) / period AS ret FROM grp WHERE grp IS NOT NULL GROUP BY factor, period, date, grp)"""
SPREAD = """spread AS (SELECT factor, period, date, max(CASE WHEN grp = 5 THEN ret END) - max(CASE WHEN grp = 1 THEN ret END) AS ls, max(CASE WHEN grp = 5 THEN ret END) - avg(ret) AS te FROM gret GROUP BY ALL),
wealth AS (SELECT *, CASE WHEN ls IS NOT NULL THEN product(1 + ls) OVER w END AS wl, CASE WHEN te IS NOT NULL THEN product(1 + te) OVER w END AS we FROM spread WINDOW w AS (PARTITION BY factor, period ORDER BY date ROWS UNBOUNDED PRECEDING)),
dds AS (SELECT *, wl / max(wl) OVER w - 1 AS dl, we / max(we) OVER w - 1 AS de FROM wealth WINDOW w AS (PARTITION BY factor, period ORDER BY date ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT factor, period, pow(product(1 + ls), 252.0 / greatest(count(*), 1)) - 1 AS ls_annual, CASE WHEN avg(ls) IS NOT NULL THEN CASE WHEN stddev_samp(ls) > 0 THEN avg(ls) / stddev_samp(ls) * sqrt(252) ELSE 0.0 END / sqrt(period) END AS ls_sharpe,
  min(dl) AS ls_max_drawdown, pow(product(1 + te), 252.0 / greatest(count(*), 1)) - 1 AS top_excess_annual, min(de) AS top_excess_max_drawdown FROM dds GROUP BY factor, period),
spread_metrics AS (SELECT *, CASE WHEN top_excess_max_drawdown < 0 THEN top_excess_annual / abs(top_excess_max_drawdown) WHEN top_excess_annual IS NOT NULL THEN 0.0 END AS top_excess_calmar FROM sm)"""
TURN = """tdays AS (SELECT factor, date, row_number() OVER (PARTITION BY factor ORDER BY date) AS i FROM (SELECT DISTINCT factor, date FROM fac)),
ttop AS (SELECT factor, date, symbol, 1.0 / count(*) OVER (PARTITION BY factor, date) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY value, symbol) - 1 AS r, count(*) OVER (PARTITION BY factor, date) AS n FROM fac) WHERE r * 5 > 4 * (n - 1) AND n >= 5),
tchange AS (SELECT factor, i, symbol, sum(w) AS d FROM (SELECT factor, i, symbol, w FROM ttop JOIN tdays USING (factor, date) UNION ALL SELECT factor, i + 1, symbol, -w FROM ttop JOIN tdays USING (factor, date)) GROUP BY ALL),
turn AS (SELECT t.factor, t.date, CASE WHEN t.i = 1 THEN 0.0 ELSE coalesce(c.t, 0.0) END AS turnover FROM tdays t LEFT JOIN (SELECT factor, i, sum(abs(d)) / 2 AS t FROM tchange GROUP BY ALL) c USING (factor, i))"""
STATS = """st AS (SELECT factor, period, count(ic) AS n, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) AS ic_positive,
  avg(ic) / nullif(stddev_samp(ic), 0) / sqrt(period) * sqrt(252) AS icir, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) / sqrt(period) AS t_stat FROM ic GROUP BY factor, period)"""


def w_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join([CALM, *parts]) + "\n" + select


# --- bars and sources ---------------------------------------------------------------

for _b in ("week", "month", "day"):
    QUERIES[f"bars_supplier_{_b}"] = lambda s, d, b=_b: X.supplier_bars(s, d, b)
    ORACLE_SQL[f"bars_supplier_{_b}"] = bars_sql(_b)


@query(USER_SQL)
def bars_user_day(spark, sf_dir):
    return X.user_bars(spark, sf_dir)


@query(f"WITH b AS ({bars_sql()}) SELECT symbol, count(*) AS n FROM b GROUP BY symbol HAVING count(*) >= 80")
def universe_min_obs(spark, sf_dir):
    return loaders.universe_by_history(X.supplier_bars(spark, sf_dir), 80)


def _securities(spark, sf_dir):
    """Suppliers as securities: listed and delisted by their first and last shipment, every third one still listed."""
    b = X.supplier_bars(spark, sf_dir).groupBy("symbol").agg(F.min("date").alias("list_date"), F.max("date").alias("_last"))
    k = F.col("symbol").cast("int")
    return b.select("symbol", F.lit("A_stock").alias("market"), F.when(k % 7 == 0, "index").otherwise("stock").alias("asset_type"), F.concat(F.lit("S"), "symbol").alias("name"), "list_date", F.when(k % 3 != 0, F.date_sub("_last", k % 200)).alias("delist_date"), F.lit("SSE").alias("exchange"))


SEC = f"""sec AS (SELECT symbol, CASE WHEN CAST(symbol AS INTEGER) % 7 = 0 THEN 'index' ELSE 'stock' END AS asset_type, min(date) AS list_date,
  CASE WHEN CAST(symbol AS INTEGER) % 3 <> 0 THEN max(date) - CAST(symbol AS INTEGER) % 200 END AS delist_date FROM ({bars_sql()}) GROUP BY symbol)"""


@query(f"WITH {SEC} SELECT symbol FROM sec WHERE asset_type = 'stock' AND (list_date IS NULL OR list_date <= DATE '1998-09-01') AND (delist_date IS NULL OR delist_date >= DATE '1998-09-01')")
def active_universe(spark, sf_dir):
    return loaders.active_securities(_securities(spark, sf_dir), "1998-09-01", "1998-09-01")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(l_extendedprice * (1 - l_discount), 6) AS adj_close FROM lineitem")
def adj_close_round(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("adjust_factor", 1 - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", loaders.adjusted_close("l_extendedprice").alias("adj_close"))


@query("""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey % 10 AS VARCHAR), 1, '0') || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code FROM customer),
d AS (SELECT *, code || CASE left(code, 1) WHEN '6' THEN '.SH' WHEN '0' THEN '.SZ' WHEN '3' THEN '.SZ' WHEN '4' THEN '.BJ' WHEN '8' THEN '.BJ' ELSE '.SZ' END AS symbol FROM c)
SELECT c_custkey, code, symbol, lower(right(symbol, 2)) || '.' || code AS vendor, symbol AS back, code AS bare FROM d""")
def symbol_code_convert(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    code = F.concat((F.col("c_custkey") % 10).cast("string"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    c = c.select("c_custkey", code.alias("code")).withColumn("symbol", C.with_exchange_suffix(F.col("code")))
    c = c.withColumn("vendor", C.to_vendor_code(F.col("symbol")))
    return c.select("*", C.from_vendor_code(F.col("vendor")).alias("back"), C.bare_code(F.col("symbol")).alias("bare"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y%m%d') AS compact, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(CASE WHEN last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) = CAST(o_orderdate AS DATE) THEN CAST(o_orderdate AS DATE) ELSE CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 END AS DATE) AS quarter_end FROM orders")
def date_convert(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", day.alias("day"), C.compact_date(day).alias("compact"))
    return o.select("o_orderkey", C.as_date(F.col("compact")).alias("day"), "compact", F.year("day").cast("long").alias("y"), F.month("day").cast("long").alias("m"), etl.last_quarter_end(F.col("day")).alias("quarter_end"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events")
def safe_number(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", C.safe_double(F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string"))).alias("v"))


@query(f"""WITH {SEC}, b AS ({bars_sql()}) SELECT b.date, b.symbol, b.close FROM b WHERE symbol IN (SELECT symbol FROM sec WHERE asset_type = 'stock' AND list_date <= DATE '1997-12-31' AND (delist_date IS NULL OR delist_date >= DATE '1996-01-01')) AND b.date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def panel_filter(spark, sf_dir):
    own = loaders.active_securities(_securities(spark, sf_dir), "1996-01-01", "1997-12-31")
    return loaders.filter_panel(X.supplier_bars(spark, sf_dir), own, "1996-01-01", "1997-12-31").select("date", "symbol", "close")


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS revenue FROM orders GROUP BY 1, 2),
q AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS symbol, CAST(date_trunc('year', o_orderdate) AS DATE) AS date FROM orders)
SELECT q.symbol, q.date, r.revenue FROM q ASOF LEFT JOIN r ON q.symbol = r.symbol AND q.date >= r.d""")
def reports_point_in_time(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    reports = o.groupBy("symbol", F.col("d").alias("report_date")).agg(F.max("o_totalprice").alias("revenue")).withColumn("publish_date", F.col("report_date"))
    days = o.select("symbol", F.trunc("d", "year").alias("date")).distinct()
    return loaders.point_in_time(days, reports, ["revenue"]).select("symbol", "date", "revenue")


# --- panel primitives ------------------------------------------------------------------


def _grid(spark, sf_dir, *cols):
    return P.densify(_calm(spark, sf_dir), *(cols or ("close",)))


@query(w_(select="SELECT symbol, date_idx, date, close, volume FROM grid"))
def dense_grid(spark, sf_dir):
    return _grid(spark, sf_dir, "close", "volume").withColumn("date_idx", F.col("date_idx").cast("long"))


@query(w_(select="SELECT symbol, date, pc AS close FROM grid"))
def ffill_close(spark, sf_dir):
    return _grid(spark, sf_dir).select("symbol", "date", P.ffill(F.col("close")).alias("close"))


@query(w_(select=f"SELECT symbol, date, {r(chg('pc', 5))} AS x FROM grid"))
def pct_change_pad_5(spark, sf_dir):
    return rounded(P.pct_change(_grid(spark, sf_dir), "close", "x", 5), "x").select("symbol", "date", "x")


@query(w_(select=f"SELECT symbol, date, {r(chg('close', 5))} AS x FROM grid"))
def pct_change_nofill_5(spark, sf_dir):
    return rounded(P.pct_change(_grid(spark, sf_dir), "close", "x", 5, None), "x").select("symbol", "date", "x")


def _expr(name: str, expr, sql: str, cols=("close",), digits: int = 6):
    QUERIES[name] = lambda s, d: rounded(_grid(s, d, *cols).withColumn("x", expr()), "x", digits=digits).select("symbol", "date", "x")
    ORACLE_SQL[name] = w_(select=f"SELECT symbol, date, {r(sql, digits)} AS x FROM grid")


_expr("shift_back_1", lambda: P.shift(F.col("close"), 1), f"lag(close, 1) {WS}")
_expr("shift_ahead_5", lambda: P.shift(F.col("close"), -5), f"lead(close, 5) {WS}")
_expr("diff_close", lambda: P.diff(F.col("close")), f"close - lag(close) {WS}")
_expr("rolling_mean_20", lambda: P.rolling_mean(F.col("close"), 20), full("avg(close)", "close", 20), digits=8)
_expr("rolling_std_20", lambda: P.rolling_std(F.col("close"), 20), full("stddev_samp(close)", "close", 20))
_expr("rolling_std_pop_20", lambda: P.rolling_std(F.col("close"), 20, 0), full("stddev_pop(close)", "close", 20))
_expr("clip_lower", lambda: P.clip_lower(F.col("close") - 105), "CASE WHEN close IS NOT NULL THEN greatest(close - 105, 0) END")
_expr("replace_inf", lambda: P.clean(F.try_divide(F.col("close"), F.col("volume") - 50)), "close / nullif(volume - 50, 0)", ("close", "volume"))
_PAIR = lambda c: f"CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN {c} END"
QUERIES["rolling_corr_20"] = lambda s, d: rounded(_grid(s, d, "close", "volume").withColumn("x", P.rolling_corr(F.col("close"), F.col("volume"), 20)), "x").select("symbol", "date", "x")
ORACLE_SQL["rolling_corr_20"] = w_(select=f"SELECT symbol, date, {r(f'CASE WHEN count(a) {win(20)} = 20 THEN covar_samp(a, b) {win(20)} / nullif(stddev_samp(a) {win(20)} * stddev_samp(b) {win(20)}, 0) END')} AS x FROM (SELECT *, {_PAIR('close')} AS a, {_PAIR('volume')} AS b FROM grid)")


@query(w_(select=f"""SELECT symbol, date, {r(f"CASE WHEN count(g) {WB[:-1]} ROWS UNBOUNDED PRECEDING) >= 14 THEN sum(g * w) {WB[:-1]} ROWS UNBOUNDED PRECEDING) / sum(CASE WHEN g IS NOT NULL THEN w END) {WB[:-1]} ROWS UNBOUNDED PRECEDING) END")} AS x
FROM (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS g FROM (SELECT date, symbol, close - lag(close) {WB} AS d, pow(1 - 1.0 / 14, -CAST(row_number() {WB} - 1 AS DOUBLE)) AS w FROM calm))"""))
def ewm_gain_14(spark, sf_dir):
    df = _calm(spark, sf_dir).withColumn("g", P.clip_lower(P.diff(F.col("close"))))
    return rounded(P.with_ewm_mean(df, "g", "x", 1 / 14, 14), "x").select("symbol", "date", "x")


RETS = f"rets AS (SELECT symbol, date_idx, date, {chg('pc', 1)} AS ret FROM grid)"
NAV = f"nav AS (SELECT *, CASE WHEN ret IS NOT NULL THEN product(1 + ret) {WS[:-1]} ROWS UNBOUNDED PRECEDING) END AS nav FROM rets)"


def _nav(spark, sf_dir):
    df = P.pct_change(_grid(spark, sf_dir), "close", "ret")
    return df.withColumn("nav", P.cumprod(1 + F.col("ret")))


@query(w_(RETS, NAV, select=f"SELECT symbol, date, {r('nav')} AS nav FROM nav"))
def cumprod_nav(spark, sf_dir):
    return rounded(_nav(spark, sf_dir), "nav").select("symbol", "date", "nav")


DD = f"dd AS (SELECT *, nav / max(nav) {WS[:-1]} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM nav)"


@query(w_(RETS, NAV, DD, select=f"SELECT symbol, date, {r('dd')} AS dd FROM dd"))
def drawdown(spark, sf_dir):
    return rounded(_nav(spark, sf_dir).withColumn("dd", P.drawdown("nav")), "dd").select("symbol", "date", "dd")


@query(w_(RETS, NAV, DD, select=f"""SELECT symbol, CAST(max(n) AS BIGINT) AS longest FROM (SELECT symbol, island, sum(CASE WHEN dd < -1e-9 THEN 1 ELSE 0 END) AS n FROM (
  SELECT *, sum(CASE WHEN coalesce(dd < -1e-9, false) THEN 0 ELSE 1 END) {WS[:-1]} ROWS UNBOUNDED PRECEDING) AS island FROM dd) GROUP BY ALL) GROUP BY symbol"""))
def drawdown_duration(spark, sf_dir):
    # a hair below zero: products of one value may differ in their last bit
    df = _nav(spark, sf_dir).withColumn("dd", P.drawdown("nav"))
    return P.longest_run(df, ["symbol"], "date", F.col("dd") < -1e-9)


# --- keys of any size: a return flag holds up to half of all trades ----------------------

#: Rows of a segment here, so that small tables go over several too.
SEGMENT = 10_000
TRADES = "trades AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, 1 + l_discount / 10000 AS growth, floor(l_extendedprice / l_quantity * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS u FROM lineitem WHERE l_quantity <> 0)"
WT = "OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)"
TRADE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _trades(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity != 0")
    return li.select("l_returnflag", *TRADE, "l_quantity", (1 + F.col("l_discount") / 10000).alias("growth"), X.half_up(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("u"))


@query(f"WITH {TRADES} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY u) + (count(*) OVER (PARTITION BY l_returnflag, u) - 1) / 2.0 AS r FROM trades")
def rank_trades(spark, sf_dir):
    """Average rank of each trade's price among all trades of its return flag."""
    return scan.average_rank(_trades(spark, sf_dir).select("l_returnflag", *TRADE, "u"), "u", ["l_returnflag"], "r", SEGMENT).select(*TRADE, "r")


@query(f"WITH {TRADES} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, sum(l_quantity) {WT} AS volume, max(u) {WT} AS peak, {r(f'product(growth) {WT}', 4)} AS nav, {r(f'u / max(u) {WT} - 1', 4)} AS dd FROM trades")
def running_trades(spark, sf_dir):
    """Running volume, peak price and product of growth over all trades of a return flag, and the fall from the peak."""
    values = {"volume": scan.Running("sum", "l_quantity"), "peak": scan.Running("max", "u"), "nav": scan.Running("product", "growth")}
    df = scan.running(_trades(spark, sf_dir), ["l_returnflag"], TRADE, values, SEGMENT).withColumn("dd", F.col("u") / F.col("peak") - 1)
    return rounded(df, "nav", "dd", digits=4).select(*TRADE, "volume", "peak", "nav", "dd")


@query(f"""WITH {TRADES} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN k >= 4 THEN {r(f'sum(u * w) {WT} / sum(w) {WT}', 2)} END AS x
FROM (SELECT *, pow(0.999, -CAST(k AS DOUBLE)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k FROM trades))""")
def ewm_trades(spark, sf_dir):
    """Exponential mean of price over all trades of a return flag."""
    df = scan.ewm_mean(_trades(spark, sf_dir).select("l_returnflag", *TRADE, "u"), ["l_returnflag"], TRADE, "u", "x", 0.001, 5, SEGMENT)
    return rounded(df, "x", digits=2).select(*TRADE, "x")


# --- long windows -------------------------------------------------------------------------


@query(w_(select=f"SELECT symbol, date, {r(full('avg(close)', 'close', 150), 8)} AS m, {r(full('stddev_samp(close)', 'close', 150))} AS sd FROM (SELECT symbol, date, date_idx, pc AS close FROM grid)"))
def rolling_long_150(spark, sf_dir):
    """Mean and deviation over 150 days from merged moments of blocks."""
    df = _grid(spark, sf_dir).withColumn("close", P.ffill(F.col("close")))
    df = M.with_rolling_moments(df, "close", 150)
    df = rounded(df.withColumns({"m": M.mean_of("_m", 150), "sd": M.std_of("_m", 150)}), "m", digits=8)
    return rounded(df, "sd").select("symbol", "date", "m", "sd")


# --- factors ----------------------------------------------------------------------------


def _factor(f, sql: str, name: str | None = None):
    key = name or f.name
    digits = 6
    timing = isinstance(f, FA.BaseTimingFactor)
    QUERIES[key] = lambda s, d: f.generate_signals(_calm(s, d)) if timing else rounded(f.generate_signals(_calm(s, d)), "value", digits=digits)
    ORACLE_SQL[key] = w_(select=sql if timing else f"SELECT date, symbol, {r('value', digits)} AS value FROM ({sql})")


for _n in (5, 10, 20):
    _factor(FA.Momentum(_n), MOM(_n))
for _n in (5, 20):
    _factor(FA.Volatility(_n), VOL(_n))
_factor(FA.HighLowSpread(20), HLS(20))
_factor(FA.PriceVolumeCorrelation(), ALPHA)
_factor(FA.Volatility(100), VOL(100))
_factor(FA.PriceVolumeCorrelation(100, 5, "price_volume_100"), ALPHA.replace(win(20), win(100)).replace("= 20 THEN", "= 100 THEN"))
_factor(FA.MACross(), MA)
_factor(FA.RSI(), RSI)


@query(w_(select=f"SELECT date, symbol, {r('value')} AS value FROM ({MOM(20)})"))
def momentum_20_bucketed(spark, sf_dir):
    """momentum_20 over bars that are stored by symbol: no shuffle by symbol after the write."""
    import uuid

    key = uuid.uuid4().hex
    store = BarStore(spark, f"bars_{key}", f"{scratch_dir(spark)}/bars-by-symbol-{key}").write(X.calm_bars(spark, sf_dir))
    return rounded(FA.Momentum(20).generate_signals(store.read()), "value")


def _panel(spark, sf_dir):
    return FA.factor_panel(_calm(spark, sf_dir), FACTORS)


def _settled_panel(spark, sf_dir):
    """Values settled as everywhere that they are compared: the last bits of a window's sum don't pick a digit."""
    return _panel(spark, sf_dir).withColumn("value", S.settled(F.col("value")))


@query(w_(FACTOR_SQL, select=f"SELECT date, symbol, factor, {r('value')} AS value FROM fac"))
def factor_panel_all(spark, sf_dir):
    return rounded(_settled_panel(spark, sf_dir), "value")


@query(w_(FACTOR_SQL, select=f"SELECT date, symbol, {', '.join(f'{r(chr(109) + chr(97) + chr(120) + chr(40) + f"CASE WHEN factor = {chr(39)}{f.name}{chr(39)} THEN value END" + chr(41))} AS {f.name}' for f in FACTORS)} FROM fac GROUP BY date, symbol"))
def factor_outer_join(spark, sf_dir):
    names = [f.name for f in FACTORS]
    wide = _settled_panel(spark, sf_dir).groupBy("date", "symbol").pivot("factor", names).agg(F.first("value"))
    return rounded(wide, *names)


# --- selection ------------------------------------------------------------------------------


def _returns(spark, sf_dir, price="close", periods=SE.PERIODS):
    return SE.forward_returns(_calm(spark, sf_dir), periods, price)


@query(w_(fwd_sql("close"), select=f"SELECT date, symbol, period, {r('ret')} AS ret FROM fwd"))
def forward_returns(spark, sf_dir):
    return rounded(_returns(spark, sf_dir), "ret")


def _ic(spark, sf_dir, method="rank"):
    if method == "rank":
        return SE.cross_sections(*SE.wide_pairs(_calm(spark, sf_dir), FACTORS)).select("factor", "period", "date", "ic")
    return SE.ic_series(_panel(spark, sf_dir), _returns(spark, sf_dir), method)


for _m in ("rank", "pearson"):
    QUERIES[f"ic_{_m}"] = lambda s, d, m=_m: rounded(_ic(s, d, m), "ic")
    ORACLE_SQL[f"ic_{_m}"] = w_(FACTOR_SQL, fwd_sql("close"), ic_sql(_m), select=f"SELECT factor, period, date, {r('ic')} AS ic FROM ic")


@query(w_(FACTOR_SQL, fwd_sql("close"), ic_sql("rank"), STATS, select=f"SELECT factor, period, n, {r('ic_mean')} AS ic_mean, {r('ic_std')} AS ic_std, {r('ic_positive')} AS ic_positive, {r('icir')} AS icir, {r('t_stat')} AS t_stat FROM st"))
def icir(spark, sf_dir):
    return rounded(SE.ic_stats(_ic(spark, sf_dir)), "ic_mean", "ic_std", "ic_positive", "icir", "t_stat")


@query(w_(FACTOR_SQL, fwd_sql("close"), ic_sql("rank"), select=f"SELECT factor, period, count(ic) AS n, {r('CASE WHEN count(ic) > 1 THEN avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) END')} AS t FROM ic GROUP BY factor, period"))
def t_stat(spark, sf_dir):
    return rounded(SE.t_stat(_ic(spark, sf_dir)).drop("p_value"), "t")


#: Two-sided p of Student's t for whole degrees of freedom, as a finite sum over powers of cos(atan(t / sqrt(v))).
P_VALUE = """tt AS (SELECT factor, period, count(ic) AS n, CASE WHEN count(ic) > 1 THEN avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) END AS t FROM ic GROUP BY factor, period),
ang AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS th FROM tt WHERE t IS NOT NULL),
term AS (SELECT factor, period, k, pow(cos(th), 2 * k + v % 2) * product(CASE WHEN k = 0 THEN 1.0 WHEN v % 2 = 0 THEN (2.0 * k - 1) / (2 * k) ELSE 2.0 * k / (2 * k + 1) END) OVER (PARTITION BY factor, period ORDER BY k) AS x
  FROM (SELECT *, unnest(range(0, (v + 1) // 2 + 1)) AS k FROM ang) WHERE k <= (v - 2 - v % 2) / 2),
pv AS (SELECT a.factor, a.period, 1 - CASE WHEN v % 2 = 0 THEN sin(th) * coalesce(s, 0) ELSE 2 / pi() * (th + sin(th) * coalesce(s, 0)) END AS p_value FROM ang a LEFT JOIN (SELECT factor, period, sum(x) AS s FROM term GROUP BY ALL) USING (factor, period))"""


@query(w_(FACTOR_SQL, fwd_sql("close"), ic_sql("rank"), P_VALUE, select=f"SELECT factor, period, tt.n, {r('t')} AS t, {r('p_value')} AS p_value FROM tt LEFT JOIN pv USING (factor, period)"))
def p_value(spark, sf_dir):
    return rounded(SE.t_stat(_ic(spark, sf_dir)), "t", "p_value")


@query(w_(FACTOR_SQL, fwd_sql("close", (1,)),
    "rgrid AS (SELECT s.symbol, c.date, c.i, f.ret FROM (SELECT DISTINCT symbol FROM fwd) s CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM fwd)) c LEFT JOIN fwd f ON f.symbol = s.symbol AND f.date = c.date)",
    "lagged AS (SELECT date, symbol, lag AS period, ret FROM (SELECT d.date, g.symbol, l.lag, g.ret FROM rgrid g CROSS JOIN (SELECT unnest(range(1, 21)) AS lag) l JOIN (SELECT DISTINCT date, i FROM rgrid) d ON d.i = g.i - l.lag + 1) WHERE ret IS NOT NULL)",
    ic_sql("rank", "fac", "lagged"), select=f"SELECT factor, period AS lag, {r('avg(ic)')} AS ic FROM ic GROUP BY factor, period"))
def ic_decay(spark, sf_dir):
    pairs, names, rets = SE.wide_pairs(_calm(spark, sf_dir), FACTORS, (1,))
    leads, lags = SE.with_leads(pairs, names, rets[1])
    sections = SE.cross_sections(leads, names, lags)
    out = sections.groupBy("factor", F.col("period").alias("lag")).agg(F.avg("ic").alias("ic"))
    return rounded(out, "ic").withColumn("lag", F.col("lag").cast("long"))


@query(w_(FACTOR_SQL, TURN, select=f"SELECT factor, date, {r('turnover')} AS turnover FROM turn"))
def turnover(spark, sf_dir):
    return rounded(SE.turnover(_panel(spark, sf_dir)), "turnover")


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, select="SELECT factor, period, date, symbol, CAST(grp AS INTEGER) AS grp FROM grp"))
def qcut_groups(spark, sf_dir):
    keys = ["factor", "period", "date"]
    both = _panel(spark, sf_dir).join(_returns(spark, sf_dir), ["date", "symbol"])
    both = both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n >= 5")
    return S.quantile_groups(both, "value", keys, 5).select(*keys, "symbol", "grp")


def _groups(spark, sf_dir, price="close"):
    # a few rows a date, which several measures read
    return stored(SE.groups_in(SE.cross_sections(*SE.wide_pairs(_calm(spark, sf_dir), FACTORS, price=price), n_groups=5, ranks=False)), "groups")


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, select=f"SELECT factor, period, date, CAST(grp AS INTEGER) AS grp, {r('ret')} AS ret FROM gret"))
def layered_group_returns(spark, sf_dir):
    return rounded(_groups(spark, sf_dir), "ret")


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, select=f"SELECT factor, period, date, CAST(grp AS INTEGER) AS grp, {r('product(1 + ret) OVER (PARTITION BY factor, period, grp ORDER BY date ROWS UNBOUNDED PRECEDING) - 1')} AS cumulative FROM gret"))
def layered_cumulative(spark, sf_dir):
    return rounded(SE.cumulative_returns(_groups(spark, sf_dir)), "cumulative")


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, select=f"""SELECT factor, period, CAST(grp AS INTEGER) AS grp, {r("pow(product(1 + ret), 252.0 / max(nd)) - 1")} AS annual_return, {r("avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) / sqrt(period)")} AS sharpe_ratio
FROM gret JOIN (SELECT factor, period, count(DISTINCT date) AS nd FROM gret GROUP BY ALL) USING (factor, period) GROUP BY factor, period, grp"""))
def layered_annual(spark, sf_dir):
    return rounded(SE.group_metrics(_groups(spark, sf_dir)), "annual_return", "sharpe_ratio")


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, SPREAD, select=f"SELECT factor, period, date, {r('ls')} AS long_short, {r('te')} AS top_excess FROM spread"))
def long_short(spark, sf_dir):
    return rounded(SE.spread_series(_groups(spark, sf_dir)), "long_short", "top_excess")


_SM = ["ls_annual", "ls_sharpe", "ls_max_drawdown", "top_excess_annual", "top_excess_max_drawdown", "top_excess_calmar"]


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, SPREAD, select=f"SELECT factor, period, {', '.join(f'{r(c)} AS {c}' for c in _SM)} FROM spread_metrics"))
def top_excess(spark, sf_dir):
    return rounded(SE.spread_metrics(SE.spread_series(_groups(spark, sf_dir))).drop("n"), *_SM)


_REPORT = ["ic_mean", "ic_std", "icir", "t_stat", "ic_positive", "turnover", *_SM]


@query(w_(FACTOR_SQL, fwd_sql("open"), ic_sql("rank"), STATS, QCUT, SPREAD, TURN, select=f"SELECT factor, period, {', '.join(f'{r(c)} AS {c}' for c in _REPORT)} FROM st LEFT JOIN (SELECT factor, avg(turnover) AS turnover FROM turn GROUP BY factor) USING (factor) LEFT JOIN spread_metrics USING (factor, period)"))
def factor_report(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    report = SE.FactorReport.of_bars(bars, FACTORS)
    return rounded(report.summary(12, p_values=False), *_REPORT)


@query(w_(FACTOR_SQL, fwd_sql("close"), ic_sql("rank"), select="""SELECT factor, period, bin, count(*) AS n FROM (SELECT factor, period, CAST(least(coalesce(floor((ic - lo) / nullif(hi - lo, 0) * 50 + 1e-9) + 1, 1), 50) AS INTEGER) AS bin
FROM ic JOIN (SELECT factor, period, min(ic) AS lo, max(ic) AS hi FROM ic GROUP BY ALL) USING (factor, period) WHERE ic IS NOT NULL) GROUP BY ALL"""))
def ic_histogram(spark, sf_dir):
    return SE.ic_histogram(_ic(spark, sf_dir))


@query(w_(FACTOR_SQL, fwd_sql("close"), ic_sql("rank"), select=f"SELECT factor, period, date, {r('ic')} AS ic, {r('CASE WHEN count(ic) OVER w = 20 THEN avg(ic) OVER w END')} AS ma FROM ic WINDOW w AS (PARTITION BY factor, period ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def ic_chart(spark, sf_dir):
    return rounded(SE.ic_chart(_ic(spark, sf_dir)), "ic", "ma")


@query(w_(FACTOR_SQL, fwd_sql("close"), "whole AS (SELECT factor, period, DATE '2000-01-01' AS date, value, floor(ret * 1e10 + 0.5) / 1e10 AS ret FROM fac JOIN fwd USING (date, symbol))",
    select=f"SELECT factor, period, {r('covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0)')} AS ic FROM (SELECT factor, period, rank() OVER (PARTITION BY factor, period ORDER BY value) + (count(*) OVER (PARTITION BY factor, period, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor, period ORDER BY ret) + (count(*) OVER (PARTITION BY factor, period, ret) - 1) / 2.0 AS b FROM whole) GROUP BY factor, period"))
def ic_of_all_rows(spark, sf_dir):
    # the grid stores its own bars, with the columns that the factors need
    return rounded(SE.ic_of_all(*SE.wide_pairs(X.calm_bars(spark, sf_dir), FACTORS)), "ic")


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, select=f"SELECT factor, period, date, {', '.join(f'{r(f"max(CASE WHEN grp = {g} THEN ret END)")} AS g{g}' for g in range(1, 6))} FROM gret GROUP BY factor, period, date"))
def layered_wide(spark, sf_dir):
    wide = SE.LayeredResult.of_groups(_groups(spark, sf_dir)).wide()
    return rounded(wide.withColumnsRenamed({str(g): f"g{g}" for g in range(1, 6)}), *[f"g{g}" for g in range(1, 6)])


@query(w_(FACTOR_SQL, fwd_sql("close"), QCUT, SPREAD, select=f"SELECT factor, period, date, {r('wl - 1')} AS long_short_cumulative FROM wealth"))
def long_short_cumulative(spark, sf_dir):
    return rounded(SE.LayeredResult.of_groups(_groups(spark, sf_dir)).spread_cumulative, "long_short_cumulative")


@query(w_(FACTOR_SQL, fwd_sql("open"), ic_sql("rank"), STATS, select=f"""SELECT factor, period, {r('icir')} AS icir, {r('tp')} AS t, CASE WHEN abs(ic_mean) >= 0.05 THEN 'strong' WHEN abs(ic_mean) >= 0.03 THEN 'good' WHEN abs(ic_mean) >= 0.02 THEN 'weak' ELSE 'none' END AS ic_label
FROM st JOIN (SELECT factor, period, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS tp FROM ic GROUP BY factor, period) USING (factor, period)"""))
def report_accessors(spark, sf_dir):
    """The report's parts by themselves, and the label of the mean IC's strength."""
    bars = _calm(spark, sf_dir)
    report = SE.FactorReport.of_bars(bars, FACTORS)
    label = SE.grade(SE.ic_stats(report.ic_series())).select("factor", "period", "ic_label")
    out = report.icir().join(report.t_stat().select("factor", "period", "t"), ["factor", "period"]).join(label, ["factor", "period"])
    return rounded(out, "icir", "t")


# --- timing ----------------------------------------------------------------------------------

TROWS = f"""sig AS (SELECT 'ma_cross_timing' AS factor, * FROM ({MA}) UNION ALL SELECT 'rsi_timing', * FROM ({RSI})),
trows AS (SELECT s.factor, s.symbol, s.date, s.value AS signal, c.close AS price, c.close / nullif(lag(c.close) OVER (PARTITION BY s.factor, s.symbol ORDER BY s.date), 0) - 1 AS ret FROM sig s JOIN calm c USING (symbol, date)),
tnav0 AS (SELECT *, coalesce(sign(lag(signal, 2) OVER w), 0.0) * coalesce(ret, 0.0) AS sret FROM trows WINDOW w AS (PARTITION BY factor, symbol ORDER BY date)),
tnav AS (SELECT *, product(1 + sret) OVER (PARTITION BY factor, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS nav FROM tnav0),
bench AS (SELECT date, price / nullif(lag(price) OVER (ORDER BY date), 0) - 1 AS b, price / first_value(price) OVER (ORDER BY date) AS bnav FROM (SELECT date, arg_min(close, symbol) AS price FROM calm GROUP BY date))"""


def _trows(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    return T.joined(FA.factor_panel(bars, [FA.MACross(), FA.RSI()]), bars)


@query(w_(TROWS, select=f"SELECT factor, symbol, {r('avg(CASE WHEN sign(signal) = sign(ret) THEN 1 ELSE 0 END)')} AS direction_win_rate FROM trows WHERE ret IS NOT NULL AND signal <> 0 GROUP BY ALL"))
def direction_win_rate(spark, sf_dir):
    return rounded(T.direction_win_rate(_trows(spark, sf_dir)), "direction_win_rate")


@query(w_(TROWS, select=f"SELECT factor, symbol, date, {r('sret')} AS ret, {r('nav')} AS nav FROM tnav"))
def timing_nav(spark, sf_dir):
    return rounded(T.strategy_returns(_trows(spark, sf_dir)), "ret", "nav")


@query(w_(TROWS, select=f"SELECT date, {r('b')} AS ret, {r('bnav')} AS nav FROM bench"))
def benchmark_nav(spark, sf_dir):
    return rounded(T.buy_and_hold(T.benchmark_close(_calm(spark, sf_dir))), "ret", "nav")


@query(w_(TROWS, select=f"SELECT factor, symbol, date, {r('sret - b')} AS excess FROM tnav JOIN bench USING (date) WHERE b IS NOT NULL"))
def excess_returns(spark, sf_dir):
    bench = T.buy_and_hold(T.benchmark_close(_calm(spark, sf_dir)))
    return rounded(T.excess_returns(T.strategy_returns(_trows(spark, sf_dir)), bench), "excess")


@query(w_(TROWS, select=f"SELECT factor, symbol, date, {r('100 * product(1 + sret - b) OVER (PARTITION BY factor, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS value FROM tnav JOIN bench USING (date) WHERE b IS NOT NULL"))
def excess_curve(spark, sf_dir):
    bench = T.buy_and_hold(T.benchmark_close(_calm(spark, sf_dir)))
    return rounded(T.excess_curve(T.excess_returns(T.strategy_returns(_trows(spark, sf_dir)), bench)), "value")


UNDER = """tdd AS (SELECT *, nav / greatest(1.0, max(nav) OVER (PARTITION BY factor, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM tnav)"""


@query(w_(TROWS, UNDER, select=f"SELECT factor, symbol, date, {r('dd')} AS drawdown FROM tdd"))
def timing_underwater(spark, sf_dir):
    return rounded(T.underwater(T.strategy_returns(_trows(spark, sf_dir))), "drawdown")


@query(w_(TROWS, select=f"""SELECT factor, symbol, date, {r('price')} AS price, CAST(sign(pos) AS INTEGER) AS position, CASE WHEN pos > before THEN 'buy' ELSE 'sell' END AS action FROM (
  SELECT *, coalesce(lag(pos) OVER (PARTITION BY factor, symbol ORDER BY date), 0.0) AS before FROM (SELECT *, coalesce(sign(lag(signal) OVER (PARTITION BY factor, symbol ORDER BY date)), 0.0) AS pos FROM trows)) WHERE pos <> before"""))
def timing_trades(spark, sf_dir):
    return rounded(T.trades(_trows(spark, sf_dir)), "price")


def _tm(ret: str, n: str, name: str, src: str) -> str:
    return f"""{name}0 AS (SELECT factor, symbol, date, {ret} AS x, product(1 + {ret}) OVER (PARTITION BY factor, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM {src}),
{name}1 AS (SELECT *, v / greatest(1.0, max(v) OVER (PARTITION BY factor, symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS d FROM {name}0),
{name} AS (SELECT factor, symbol, count(*) AS n, pow(product(1 + x), 252.0 / ({n})) - 1 AS annual, abs(min(d)) AS mdd, avg(x) / nullif(stddev_samp(x), 0) * sqrt(252) AS sharpe FROM {name}1 GROUP BY ALL)"""


@query(w_(TROWS, "ex AS (SELECT factor, symbol, date, sret - b AS e FROM tnav JOIN bench USING (date) WHERE b IS NOT NULL)", _tm("sret", "count(*)", "ma_", "tnav"), _tm("e", "count(*) + 1", "me_", "ex"),
    select=f"""SELECT a.factor, a.symbol, {r('w.v', 4)} AS direction_win_rate, {r('a.annual', 4)} AS annual_return, {r('a.mdd', 4)} AS max_drawdown, {r('a.sharpe', 4)} AS sharpe, {r('a.annual / nullif(a.mdd, 0)', 4)} AS calmar,
  {r('e.annual', 4)} AS excess_annual_return, {r('e.annual / nullif(e.mdd, 0)', 4)} AS excess_calmar FROM ma_ a LEFT JOIN (SELECT * FROM me_ WHERE n >= 2) e ON e.factor = a.factor AND e.symbol = a.symbol
  LEFT JOIN (SELECT factor, symbol, avg(CASE WHEN sign(signal) = sign(ret) THEN 1 ELSE 0 END) AS v FROM trows WHERE ret IS NOT NULL AND signal <> 0 GROUP BY ALL) w ON w.factor = a.factor AND w.symbol = a.symbol"""))  # fmt: skip
def timing_summary(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    out = T.summary(FA.factor_panel(bars, [FA.MACross(), FA.RSI()]), bars, bars)
    return rounded(out, *out.columns[2:], digits=4)


# --- strategy -----------------------------------------------------------------------------------

REB = "reb AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM calm) GROUP BY last_day(date))"
PICK = f"""m20 AS ({MOM(20)}),
pick AS (SELECT date, symbol, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (SELECT m.date, m.symbol, row_number() OVER (PARTITION BY m.date ORDER BY m.value DESC, m.symbol) AS k
  FROM m20 m JOIN calm c ON c.date = m.date AND c.symbol = m.symbol AND c.close IS NOT NULL AND c.volume > 0 JOIN reb ON reb.date = m.date WHERE m.value > 0) WHERE k <= 5),
held AS (SELECT g.symbol, g.date_idx, g.date, coalesce(last_value(CASE WHEN p.weight IS NOT NULL THEN p.weight WHEN b.date IS NOT NULL THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date_idx ROWS UNBOUNDED PRECEDING), 0.0) AS weight
  FROM grid g LEFT JOIN reb b ON b.date = g.date LEFT JOIN pick p ON p.date = g.date AND p.symbol = g.symbol)"""


@query(w_(select="SELECT date, symbol, (close IS NOT NULL AND coalesce(volume, 0) > 0) AS tradable FROM calm"))
def tradable_mask(spark, sf_dir):
    return PF.tradable(_calm(spark, sf_dir))


@query(w_(REB, select="SELECT date FROM reb"))
def rebalance_dates(spark, sf_dir):
    return PF.rebalance_dates(_calm(spark, sf_dir), "ME")


@query(f"WITH u AS ({USER_SQL}) SELECT max(date) AS date FROM (SELECT DISTINCT date FROM u) GROUP BY date_trunc('week', date + 2)")
def rebalance_dates_weekly(spark, sf_dir):
    return PF.rebalance_dates(X.user_bars(spark, sf_dir), "W-FRI")


def _weights(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    return PF.TopKPortfolio(5, 0.0, "ME").generate_target_weights(FA.Momentum(20).generate_signals(bars), bars)


@query(w_(REB, PICK, select=f"SELECT date, symbol, {r('weight')} AS weight FROM held"))
def topk_weights(spark, sf_dir):
    return rounded(_weights(spark, sf_dir), "weight")


@query(w_(REB, PICK, select=f"SELECT date, symbol, {r(f'coalesce(lag(weight) {WS}, 0.0)')} AS weight FROM held"))
def target_shifted(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("date")
    return rounded(_weights(spark, sf_dir).withColumn("weight", F.coalesce(F.lag("weight").over(w), F.lit(0.0))), "weight")


@query()
def topk_dropout(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    return rounded(PF.topk_dropout(FA.Momentum(20).generate_signals(bars), bars, 10, 2), "weight")


def _simulation(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    return CashAccountEngine(initial_capital=1_000_000.0).run_simulation(_weights(spark, sf_dir), bars)


@query()
def simulate_nav(spark, sf_dir):
    return rounded(_simulation(spark, sf_dir).equity_curve, "equity", digits=8)


@query()
def simulate_ledger(spark, sf_dir):
    return _simulation(spark, sf_dir).trades


@query()
def simulate_positions(spark, sf_dir):
    return _simulation(spark, sf_dir).positions


@query()
def trade_details(spark, sf_dir):
    return _simulation(spark, sf_dir).trade_details


#: Every symbol as a strategy of its own, fully invested from its second day on: the account as a recursion over days.
SINGLES = """days AS (SELECT symbol, date, pc AS price, row_number() OVER (PARTITION BY symbol ORDER BY date_idx) AS i FROM grid WHERE pc IS NOT NULL),
sim(symbol, i, date, price, cash, shares, equity, moved) AS (
  SELECT symbol, i, date, price, 10000.0::DOUBLE, 0::BIGINT, 10000.0::DOUBLE, 0::BIGINT FROM days WHERE i = 1
  UNION ALL
  SELECT symbol, i, date, price, c, shares + moved, c + (shares + moved) * price, moved FROM (SELECT *, CASE WHEN moved < 0 THEN cash - moved * price * (1 - 0.002) ELSE cash - moved * price * 1.002 END AS c
  FROM (SELECT *, CASE WHEN goal < shares THEN goal - shares ELSE greatest(least(goal - shares, CAST(floor(cash / (price * 1.002)) AS BIGINT)), 0) END AS moved
    FROM (SELECT d.symbol, d.i, d.date, d.price, s.cash, s.shares, CAST(floor((s.cash + s.shares * d.price) / (d.price * 1.002)) AS BIGINT) AS goal FROM sim s JOIN days d ON d.symbol = s.symbol AND d.i = s.i + 1)))),
book AS (SELECT s.symbol AS strategy, c.date, coalesce(x.equity, 10000.0) AS value, coalesce(x.moved, 0) AS moved, x.price, coalesce(x.shares, 0) AS shares, coalesce(x.cash, 10000.0) AS cash, x.i
  FROM (SELECT DISTINCT symbol FROM calm) s CROSS JOIN cal c LEFT JOIN sim x ON x.symbol = s.symbol AND x.date = c.date),
led AS (SELECT *, value / lag(value, 1, 10000.0) OVER w - 1 AS ret, value / 10000.0 AS nav, abs(moved) * coalesce(price, 0) AS notional, abs(moved) * coalesce(price, 0) / (value + abs(moved) * coalesce(price, 0) * 0.002) AS turn FROM book WINDOW w AS (PARTITION BY strategy ORDER BY date)),
ldd AS (SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM led)"""


def sim_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CALM, SINGLES, *parts]) + "\n" + select


def _singles(spark, sf_dir, bars=None):
    bars = _calm(spark, sf_dir) if bars is None else bars
    weights = bars.select("date", "symbol", F.col("symbol").alias("strategy"), F.lit(1.0).alias("weight"))
    return CashAccountEngine(0.001, 0.001, initial_capital=10_000.0).run_simulation(weights, bars)


@query(sim_(select=f"SELECT strategy, date, shares, {r('value', 4)} AS equity FROM led WHERE i IS NOT NULL"))
def simulate_single(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    first = bars.groupBy(F.col("symbol").alias("strategy")).agg(F.min("date").alias("_from"))
    run = _singles(spark, sf_dir, bars)
    held = run.trades.join(run.names.select("strategy", "date", "shares"), ["strategy", "date"], "left").join(first, "strategy").where("date >= _from")
    return rounded(held.select("strategy", "date", F.coalesce("shares", F.lit(0)).alias("shares"), F.col("portfolio_value").alias("equity")), "equity", digits=4)


@query(sim_(select=f"SELECT strategy, date, {r('turn')} AS turnover, {r('notional', 4)} AS trade_notional, {r('notional * 0.002', 4)} AS total_cost, CAST(greatest(moved, 0) AS DOUBLE) AS buy_shares, CAST(greatest(-moved, 0) AS DOUBLE) AS sell_shares, {r('cash', 4)} AS cash, {r('ret')} AS net_return FROM led"))
def ledger_by_symbol(spark, sf_dir):
    t = _singles(spark, sf_dir).trades
    t = rounded(rounded(t, "turnover", "net_return"), "trade_notional", "total_cost", "cash", digits=4)
    return t.select("strategy", "date", "turnover", "trade_notional", "total_cost", "buy_shares", "sell_shares", "cash", "net_return")


@query(sim_(select=f"SELECT strategy, date, strategy AS symbol, shares, {r('shares * price / value')} AS weight FROM led WHERE shares > 0"))
def positions_by_symbol(spark, sf_dir):
    return rounded(_singles(spark, sf_dir).positions, "weight")


def _analyzer(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    return A.StrategyAnalyzer(_singles(spark, sf_dir, bars), A.equal_weight_benchmark(bars))


_ANNUAL = lambda p, n: f"CASE WHEN {p} <= 0 THEN -1.0 ELSE pow({p}, 252.0 / ({n})) - 1 END"
_SHARPE = lambda m, sd: f"CASE WHEN {sd} > 0 THEN {m} / {sd} * sqrt(252) ELSE 0.0 END"


@query(sim_("runs AS (SELECT strategy, max(n) AS longest FROM (SELECT strategy, island, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS n FROM (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM ldd) GROUP BY ALL) GROUP BY strategy)",
    f"""agg AS (SELECT strategy, arg_max(value, date) AS ending_value, arg_max(nav, date) - 1 AS total_return, {_ANNUAL('product(1 + ret)', 'count(*)')} AS annual_return, stddev_pop(ret) * sqrt(252) AS annual_volatility,
  {_SHARPE('avg(ret)', 'stddev_pop(ret)')} AS sharpe_ratio, abs(min(dd)) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS win_rate,
  CASE WHEN avg(CASE WHEN ret > 0 THEN ret END) IS NULL THEN 0.0 ELSE avg(CASE WHEN ret > 0 THEN ret END) / nullif(abs(avg(CASE WHEN ret < 0 THEN ret END)), 0) END AS profit_loss_ratio, avg(turn) AS turnover FROM ldd GROUP BY strategy)""",
    select=f"""SELECT strategy, 10000.0::DOUBLE AS initial_capital, {r('ending_value', 4)} AS ending_value, {', '.join(f"{r(c)} AS {c}" for c in ('total_return', 'annual_return', 'annual_volatility', 'sharpe_ratio'))},
  {r('CASE WHEN max_drawdown > 0 THEN annual_return / max_drawdown ELSE 0.0 END')} AS calmar_ratio, {r('max_drawdown')} AS max_drawdown, CAST(longest AS BIGINT) AS max_drawdown_duration, {', '.join(f"{r(c)} AS {c}" for c in ('win_rate', 'profit_loss_ratio', 'turnover'))} FROM agg JOIN runs USING (strategy)"""))  # fmt: skip
def strategy_stats(spark, sf_dir):
    s = _analyzer(spark, sf_dir).summary_stats()
    names = [c for c, k in s.dtypes if k == "double" and c not in ("ending_value", "initial_capital")]
    return rounded(rounded(s, *names), "ending_value", digits=4)


EW = "ew AS (SELECT date, coalesce(m / nullif(lag(m) OVER (ORDER BY date), 0) - 1, 0.0) AS ret FROM (SELECT date, avg(close) AS m FROM calm GROUP BY date))"


@query(sim_(EW, "ex AS (SELECT l.strategy, l.date, l.ret - coalesce(e.ret, 0.0) AS e FROM led l LEFT JOIN ew e USING (date))", "exn AS (SELECT *, product(1 + e) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM ex)",
    "exd AS (SELECT *, v / max(v) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM exn)",
    select=f"SELECT strategy, 'EW' AS benchmark, {r(_ANNUAL('product(1 + e)', 'count(*) + 1'))} AS excess_annual_return, {r(_SHARPE('avg(e)', 'stddev_pop(e)'))} AS information_ratio, {r('abs(min(d))')} AS excess_max_drawdown FROM exd GROUP BY strategy"))
def strategy_benchmark_stats(spark, sf_dir):
    s = _analyzer(spark, sf_dir).benchmark_stats()
    return rounded(s, *[c for c, k in s.dtypes if k == "double"])


@query(sim_(select=f"SELECT strategy, date, 0 AS seq, strategy AS symbol, CASE WHEN moved > 0 THEN '买入' ELSE '卖出' END AS action, abs(moved) AS shares, {r('price')} AS price, {r('notional', 4)} AS notional, {r('cash', 4)} AS balance FROM led WHERE moved <> 0"))
def rebalance_records(spark, sf_dir):
    return rounded(rounded(_analyzer(spark, sf_dir).rebalance_records(), "price"), "notional", "balance", digits=4)


@query(sim_(select=f"SELECT strategy, CAST(date_trunc('month', date) AS DATE) AS month, {r('product(1 + ret) - 1')} AS ret FROM led GROUP BY ALL"))
def strategy_monthly(spark, sf_dir):
    return rounded(_analyzer(spark, sf_dir).monthly_returns(), "ret")


_MONTH = lambda m: r(f"product(CASE WHEN month(date) = {m} THEN 1 + ret END) - 1")


@query(sim_(select=f"SELECT strategy, CAST(year(date) AS BIGINT) AS year, {', '.join(f'{_MONTH(m)} AS m{m}' for m in range(1, 13))} FROM led GROUP BY ALL"))
def strategy_monthly_table(spark, sf_dir):
    t = _analyzer(spark, sf_dir).monthly_table().withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})
    return rounded(t, *[f"m{m}" for m in range(1, 13)]).withColumn("year", F.col("year").cast("long"))


@query(sim_(select=f"SELECT strategy, date, {r('CASE WHEN count(ret) OVER w = 60 AND stddev_pop(ret) OVER w > 1e-9 THEN avg(ret) OVER w / stddev_pop(ret) OVER w * sqrt(252) END', 4)} AS sharpe FROM led WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def strategy_rolling_sharpe(spark, sf_dir):
    return rounded(_analyzer(spark, sf_dir).rolling_sharpe(), "sharpe", digits=4)


@query(w_(EW, select=f"SELECT date, {r('ret')} AS ret FROM ew"))
def benchmark_equal_weight(spark, sf_dir):
    return rounded(A.equal_weight_benchmark(_calm(spark, sf_dir)), "ret").select("date", "ret")


@query(w_(select=f"SELECT date, symbol, {r(f'coalesce({chg(chr(112) + chr(99), 1)}, 0.0)')} AS ret FROM grid"))
def benchmark_returns(spark, sf_dir):
    return rounded(A.benchmark_returns(_calm(spark, sf_dir)), "ret")


@query(w_(EW, select=f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {r('product(1 + ret) - 1')} AS ret FROM ew GROUP BY 1"))
def monthly_returns(spark, sf_dir):
    r_ = A.equal_weight_benchmark(_calm(spark, sf_dir))
    return rounded(r_.groupBy(F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")), "ret")


@query(w_(EW, select=f"SELECT date, {r('CASE WHEN count(ret) OVER w = 60 THEN avg(ret) OVER w / nullif(stddev_pop(ret) OVER w, 0) * sqrt(252) END')} AS sharpe FROM ew WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"))
def rolling_sharpe_60(spark, sf_dir):
    e = A.equal_weight_benchmark(_calm(spark, sf_dir))
    x = F.try_divide(P.rolling_mean(F.col("ret"), 60), P.rolling_std(F.col("ret"), 60, 0)) * F.sqrt(F.lit(252.0))
    return rounded(e.withColumn("sharpe", x), "sharpe").select("date", "sharpe")


# --- ETL ---------------------------------------------------------------------------------------------


@query(f"""WITH b AS ({bars_sql()}), u AS (SELECT symbol, date, close, 0 AS batch FROM b UNION ALL SELECT symbol, date, close * 2, 1 FROM b WHERE CAST(symbol AS INTEGER) % 5 = 0)
SELECT symbol, date AS trade_date, close FROM u QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY batch DESC) = 1""")
def upsert_keep_last(spark, sf_dir):
    old = X.supplier_bars(spark, sf_dir).select("symbol", F.col("date").alias("trade_date"), "close")
    new = old.where(F.col("symbol").cast("int") % 5 == 0).withColumn("close", F.col("close") * 2)
    return etl.keep_last(old, new, ["symbol", "trade_date"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-10-01')")
def todo_symbols(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("symbol"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_shipdate >= timestamp_ntz'1998-10-01 00:00:00'")
    done = li.select(F.lit("t").alias("task"), F.col("l_suppkey").cast("string").alias("symbol")).distinct()
    return etl.to_do(s, done, "t")


@query(f"""WITH {SEC}, b AS ({bars_sql()}), seen AS (SELECT symbol, max(date) AS last_date, count(*) AS n FROM b WHERE date < DATE '1998-11-01' GROUP BY symbol),
j AS (SELECT coalesce(s.symbol, c.symbol) AS symbol, s.last_date, s.n, c.list_date, c.delist_date FROM seen s FULL JOIN sec c ON c.symbol = s.symbol)
SELECT symbol, last_date, coalesce(n, 0) AS n, CASE WHEN coalesce(list_date > DATE '1998-12-31', false) OR coalesce(delist_date < DATE '1993-01-01', false)
  OR coalesce(last_date >= (CASE WHEN delist_date < DATE '1998-12-31' THEN delist_date ELSE DATE '1998-12-31' END) - 60, false) THEN 'done' ELSE 'stale' END AS status
FROM j WHERE n IS NOT NULL OR coalesce(list_date > DATE '1998-12-31', false) OR coalesce(delist_date < DATE '1993-01-01', false)""")
def progress_status(spark, sf_dir):
    bars = X.supplier_bars(spark, sf_dir).select("symbol", F.col("date").alias("trade_date")).where("trade_date < date'1998-11-01'")
    return etl.progress_status(bars, _securities(spark, sf_dir), "1993-01-01", "1998-12-31", 60, "1999-06-01")


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SH' ELSE lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.SZ' END AS symbol, 'A_stock' AS market, CASE WHEN s_nationkey % 3 = 1 THEN 'stock' WHEN s_nationkey % 3 = 2 THEN 'index' ELSE 'other' END AS asset_type, s_name AS name, DATE '2001-08-27' AS list_date, CASE WHEN s_nationkey > 12 THEN DATE '2020-01-31' END AS delist_date, CASE WHEN s_suppkey % 2 = 0 THEN 'SSE' ELSE 'SZSE' END AS exchange FROM supplier")
def securities_parse(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    code = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "sh.").otherwise("sz."), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    raw = s.select(code.alias("code"), F.col("s_name").alias("code_name"), F.lit("2001-08-27").alias("ipoDate"), F.when(F.col("s_nationkey") > 12, "2020-01-31").otherwise(" ").alias("outDate"), (F.col("s_nationkey") % 3).cast("string").alias("type"))
    return etl.parse_securities(raw)


@query("SELECT CAST(p_partkey AS VARCHAR) AS symbol, DATE '2024-01-05' AS trade_date, CAST(NULL AS DOUBLE) AS pe, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS pe_ttm, CAST(p_size AS DOUBLE) AS pb, CAST(NULL AS DOUBLE) AS ps, CAST(NULL AS DOUBLE) AS ps_ttm, CAST(NULL AS DOUBLE) AS total_mv, CAST(NULL AS DOUBLE) AS circ_mv FROM part")
def valuation_parse(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = p.select(F.col("p_partkey").cast("string").alias("symbol"), F.lit("2024-01-05").alias("date"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice").cast("string")).otherwise("").alias("peTTM"), F.col("p_size").cast("string").alias("pbMRQ"), F.lit("NaN").alias("psTTM"))
    return etl.parse_valuation(raw)


# --- stored tables ---------------------------------------------------------------------------------------


def _lake(spark, sf_dir):
    """A fresh folder with the bars written in two batches, of which the second repeats a part of the first with other prices; with securities."""
    import uuid

    root = f"{scratch_dir(spark)}/lake-{uuid.uuid4().hex}"
    raw = X.supplier_bars(spark, sf_dir).withColumnRenamed("date", "trade_date").withColumn("adjust_flag", F.lit("2")).select(*RAW_BARS.names)
    etl.create_tables(spark, root)
    etl.upsert_bars(spark, raw, root)
    again = raw.where("trade_date between date'1994-03-01' and date'1995-06-30'").withColumn("close", F.col("close") * 2)
    etl.upsert_bars(spark, again, root)
    etl.upsert_table(spark, _securities(spark, sf_dir).select(*TABLES["securities"].names), root, "securities")
    return root


TWICE = f"b AS (SELECT date, symbol, open, high, low, CASE WHEN date BETWEEN DATE '1994-03-01' AND DATE '1995-06-30' THEN close * 2 ELSE close END AS close, volume, amount FROM ({bars_sql()}))"


@query(f"WITH {TWICE}, {SEC} SELECT b.date, b.symbol, open, high, low, close, volume, amount, '2' AS adjust_flag FROM b JOIN sec USING (symbol) WHERE asset_type = 'stock' AND list_date <= DATE '1996-12-31' AND (delist_date IS NULL OR delist_date >= DATE '1994-01-01') AND b.date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'")
def lake_load(spark, sf_dir):
    """Bars stored by year, upserted, and loaded for some years and active securities."""
    return loaders.LakeLoader(spark, _lake(spark, sf_dir)).load_market_data(None, "1994-01-01", "1996-12-31")


@query(f"WITH {TWICE} SELECT CAST(year(date) AS BIGINT) AS y, count(*) AS n, {r('sum(close)', 4)} AS total FROM b GROUP BY 1")
def lake_years(spark, sf_dir):
    df = TableLog(spark, f"{_lake(spark, sf_dir)}/market_data").read()
    return rounded(df.groupBy(F.col("year").cast("long").alias("y")).agg(F.count("*").alias("n"), F.sum("close").alias("total")), "total", digits=4)


@query("""WITH v AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS pe_ttm, CAST(p_size AS DOUBLE) AS pb FROM part)
SELECT symbol, DATE '2024-01-05' AS date, CASE WHEN CAST(symbol AS BIGINT) % 3 = 0 THEN -1.0 ELSE pe_ttm END AS pe_ttm, pb FROM v WHERE CAST(symbol AS BIGINT) % 2 = 0""")
def valuation_load(spark, sf_dir):
    """Valuation rows upserted by key, and loaded for a list of symbols."""
    import uuid

    root = f"{scratch_dir(spark)}/lake-{uuid.uuid4().hex}"
    rows = valuation_parse(spark, sf_dir)
    etl.upsert_table(spark, rows, root, "daily_valuation")
    etl.upsert_table(spark, rows.where(F.col("symbol").cast("long") % 3 == 0).withColumn("pe_ttm", F.lit(-1.0)), root, "daily_valuation")
    even = rows.where(F.col("symbol").cast("long") % 2 == 0).select("symbol")
    return loaders.LakeLoader(spark, root).load_fundamental_data(even, "2024-01-01", "2024-12-31").select("symbol", "date", "pe_ttm", "pb")


@query("SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS report_date, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 30 END AS publish_date, o_totalprice AS revenue, CAST(NULL AS DOUBLE) AS eps, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 4 END AS roe FROM orders WHERE o_orderkey % 7 > 0")
def reports_parse(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    raw = o.select(F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(day.cast("string")).alias("报告期"), F.when(F.col("o_orderkey") % 3 > 0, F.date_add(day, 30).cast("string")).alias("公告日期"),
        F.col("o_totalprice").cast("string").alias("营业收入"), F.lit("--").alias("基本每股收益"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_totalprice") / 4).cast("string")).alias("净资产收益率"))
    return etl.parse_reports(raw).select("symbol", "report_date", "publish_date", "revenue", "eps", "roe")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date, 'A_stock' AS market, isodow(CAST(o_orderdate AS DATE)) < 6 AS is_open FROM orders")
def calendar_parse(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(day.cast("string").alias("calendar_date"), F.when(F.weekday(day) < 5, "1").otherwise("0").alias("is_trading_day")).distinct()
    return etl.parse_calendar(raw)


@query(f"WITH {SEC} SELECT symbol FROM sec WHERE asset_type = 'stock' AND list_date <= DATE '1998-09-01' AND (delist_date IS NULL OR delist_date >= DATE '1998-09-01') ORDER BY symbol LIMIT 20")
def universe_first(spark, sf_dir):
    """The first 20 active securities: a limit is what the operator is for."""
    return loaders.universe(_securities(spark, sf_dir), "1998-09-01", "1998-09-01", 20)


@query(f"WITH {SEC} SELECT symbol, 'A_stock' AS market, asset_type, list_date FROM sec WHERE CAST(symbol AS INTEGER) % 2 = 0")
def market_refresh(spark, sf_dir):
    """One market's rows replaced in full, another's kept."""
    import uuid

    root, rows = f"{scratch_dir(spark)}/lake-{uuid.uuid4().hex}", _securities(spark, sf_dir)
    etl.replace_market(spark, rows, root, "securities")
    etl.replace_market(spark, rows.withColumn("market", F.lit("US")), root, "securities", "US")
    etl.replace_market(spark, rows.where(F.col("symbol").cast("int") % 2 == 0), root, "securities")
    return TableLog(spark, f"{root}/securities_by_market").read().where("market = 'A_stock'").select("symbol", "market", "asset_type", "list_date")


@query("SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS symbol, value AS close, event_type FROM events")
def panel_standardize(spark, sf_dir):
    """Columns renamed by a mapping, text dates and numeric symbols made DATE and STRING."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("string").alias("when"), F.col("user_id").alias("code"), F.col("value").alias("last"), "event_type")
    return loaders.standardize(e, {"when": "date", "code": "symbol", "last": "close"})


# --- models ---------------------------------------------------------------------------------------------


def _model_data(spark, sf_dir):
    bars = _calm(spark, sf_dir)
    return FA.factor_grid(bars, FACTORS).join(SE.forward_returns(bars, [5], "close").select("date", "symbol", F.col("ret").alias("target")), ["date", "symbol"]).dropna()


@query(w_("n AS (SELECT date, symbol, row_number() OVER (ORDER BY date, symbol) - 1 AS i, count(*) OVER () AS n FROM calm)", "s AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS first FROM n)",
    select="SELECT fold, part, count(*) AS n, min(i) AS low, max(i) AS high, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, CASE WHEN i < first + (fold - 1) * size THEN 'train' WHEN i < first + fold * size THEN 'val' END AS part FROM s CROSS JOIN (SELECT unnest(range(1, 6)) AS fold)) WHERE part IS NOT NULL GROUP BY ALL"))
def ts_cv_folds(spark, sf_dir):
    f = time_folds(_calm(spark, sf_dir).select("date", "symbol"))
    out = f.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("low"), F.max("_i").alias("high"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return out.withColumn("fold", F.col("fold").cast("long"))


@query(w_(select="SELECT date, symbol, row_number() OVER (ORDER BY date, symbol) - 1 AS i FROM calm"))
def time_row_numbers(spark, sf_dir):
    return row_numbers(_calm(spark, sf_dir).select("date", "symbol")).withColumnRenamed("_i", "i")


def _model_sql(target: str = "close") -> str:
    parts = " JOIN ".join(f"(SELECT date, symbol, value AS {f.name} FROM ({q}) WHERE value IS NOT NULL){'' if i == 0 else ' USING (date, symbol)'}".replace(" USING (date, symbol)", f" f{i} USING (date, symbol)" if i else "") for i, (f, q) in enumerate(zip(FACTORS, (MOM(5), MOM(20), VOL(20), HLS(20)))))
    return f"""model AS (SELECT *, row_number() OVER (ORDER BY date, symbol) - 1 AS i, count(*) OVER () AS n FROM {parts} JOIN (SELECT date, symbol, ret AS target FROM fwd) t USING (date, symbol)),
cut AS (SELECT *, CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE 1 + (i - (n - 5 * (n // 6))) // (n // 6) END AS stretch FROM model)"""


_NAMES = ["1", *[f.name for f in FACTORS], "target"]
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i:]]


@query(w_(fwd_sql("close", [5]), _model_sql(), select=" UNION ALL ".join(f"SELECT CAST(stretch AS INTEGER) AS stretch, '{a}' AS a, '{b}' AS b, {r(f'sum(CAST({a} AS DOUBLE) * {b})', 6)} AS total FROM cut GROUP BY stretch" for a, b in _PAIRS)))
def gram_by_stretch(spark, sf_dir):
    """Sums of products of features and target over the stretches of time that folds are made of."""
    rows = Ridge(cv_splits=5)._in_stretches(_model_data(spark, sf_dir), [f.name for f in FACTORS], "target")
    return rounded(G.gram_sums(rows, [f.name for f in FACTORS], "target"), "total")


@query(w_(fwd_sql("close", [5]), _model_sql(), """f AS (SELECT stretch + 1 AS fold, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(z) OVER w AS z, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xz) OVER w AS xz, sum(zz) OVER w AS zz, sum(xy) OVER w AS xy, sum(zy) OVER w AS zy
  FROM (SELECT stretch, count(*) AS n, sum(momentum_20) AS x, sum(volatility_20) AS z, sum(target) AS y, sum(momentum_20 * momentum_20) AS xx, sum(momentum_20 * volatility_20) AS xz, sum(volatility_20 * volatility_20) AS zz, sum(momentum_20 * target) AS xy, sum(volatility_20 * target) AS zy FROM cut GROUP BY stretch)
  WINDOW w AS (ORDER BY stretch ROWS UNBOUNDED PRECEDING)),
c AS (SELECT fold, n, x / n AS mx, z / n AS mz, y / n AS my, xx - x * x / n + 1 AS a, xz - x * z / n AS b, zz - z * z / n + 1 AS d, xy - x * y / n AS p, zy - z * y / n AS q FROM f WHERE fold <= 5),
s AS (SELECT *, (p * d - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM c)""",
    select=f"SELECT CAST(fold AS INTEGER) AS fold, feature, {r('coefficient')} AS coefficient FROM (SELECT fold, 'momentum_20' AS feature, w1 AS coefficient FROM s UNION ALL SELECT fold, 'volatility_20', w2 FROM s UNION ALL SELECT fold, '', my - w1 * mx - w2 * mz FROM s)"))
def ridge_folds(spark, sf_dir):
    """Coefficients of each fold's ridge regression on two of the factors, from one pass over the rows."""
    return rounded(Ridge({"alpha": 1.0}, cv_splits=5).fold_coefficients(_model_data(spark, sf_dir), ["momentum_20", "volatility_20"], "target"), "coefficient")


@query(w_(fwd_sql("close", [5]), _model_sql(), "ends AS (SELECT " + ", ".join(f"min({f.name}) AS lo_{i}, max({f.name}) AS hi_{i}" for i, f in enumerate(FACTORS)) + ", avg(target) AS base FROM cut)",
    select=" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS feature, CAST(len(list_filter(list_transform(range(1, 16), lambda k: lo_{i} + (hi_{i} - lo_{i}) * k / 16), lambda e: e < {f.name})) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n, {r('sum(base - target)')} AS g FROM cut CROSS JOIN ends GROUP BY ALL" for i, f in enumerate(FACTORS))))
def boost_histogram(spark, sf_dir):
    """Rows and gradients by feature and bin, from which the first split of boosted trees is picked."""
    names = [f.name for f in FACTORS]
    data = stored(_model_data(spark, sf_dir).select(*names, "target"), "boost-data")
    base = data.agg(F.avg("target")).first()[0]
    rows = B.binned(data, names, B.bin_edges(data, names, 16, "width")).withColumn("_score", F.lit(base))
    return rounded(B.histograms(rows, "target", [], B.Tree(), {}, len(names), 16), "g").select("feature", "bin", "n", "g")


@query()
def ridge_cv_ic(spark, sf_dir):
    return rounded(Ridge(cv_splits=5).cross_validate(_model_data(spark, sf_dir), [f.name for f in FACTORS], "target"), "train_ic", "val_ic", digits=4)


@query()
def lasso_importance(spark, sf_dir):
    data = _model_data(spark, sf_dir)
    return rounded(Lasso({"alpha": 1e-5}).fit(data, [f.name for f in FACTORS], "target").get_feature_importance(spark), "importance")
