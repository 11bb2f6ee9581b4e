"""Every operator as a query over the event log, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.adapters import lineitem_to_ticks, pairs, table, ticks
from tickspark.functions import decimals, text, times
from tickspark.operators import candles as C
from tickspark.operators import clean, dictionary, filters, info, sets, shape, validate
from tickspark.operators import snapshots as S

DAY = 86400
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TICKS_SQL = """ticks AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS sym, CAST(user_id + 1 AS INTEGER) AS idx, ts, event_id AS seq,
 CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'error' THEN 5 ELSE 0 END AS ttf,
 CAST(value AS DECIMAL(18,4)) AS px, CAST(json_extract_string(props, '$.k') AS DECIMAL(18,4)) AS sz FROM events)"""
PAIRS_SQL = TICKS_SQL + ", pairs AS (SELECT sym, idx, ts, seq, px AS bp, CAST(CAST(px AS DECIMAL(18,4)) + CAST(CAST(sz AS BIGINT) AS DECIMAL(18,4)) * 0.01 AS DECIMAL(18,4)) AS ap FROM ticks)"
PRICES = ("px", "sz", "o", "h", "l", "c", "bp", "ap", "bq", "aq", "tvpr", "tq", "vwap", "twap", "lo", "hi", "bid", "ask")


def plain(df: DataFrame) -> DataFrame:
    """Prices as doubles, so that either engine's decimals print alike."""
    return df.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def bucket(length: int, modulus: int = 0, ts: str = "ts", closed: bool = False) -> str:
    shift = " - INTERVAL '1 microsecond'" if closed else ""
    origin = f"TIMESTAMP '1970-01-01' + INTERVAL '{modulus} seconds'"
    return f"(time_bucket(INTERVAL '{length} seconds', {ts}{shift}, {origin}) + INTERVAL '{length} seconds')"


def candle_cte(name: str, source: str, length: int, modulus: int = 0, closed: bool = False) -> str:
    b = bucket(length, modulus, closed=closed)
    return f"""{name} AS (SELECT sym, ttf AS side, {b} AS ts, {b} - INTERVAL '{length} seconds' AS sta_ts, arg_min(px, (ts, seq)) AS o, max(px) AS h, min(px) AS l,
 arg_max(px, (ts, seq)) AS c, count(*) AS cnt FROM {source} WHERE ttf IN (1, 2, 3) AND px IS NOT NULL GROUP BY ALL)"""


OHLC = "sym, side, ts, sta_ts, CAST(o AS DOUBLE) AS o, CAST(h AS DOUBLE) AS h, CAST(l AS DOUBLE) AS l, CAST(c AS DOUBLE) AS c, CAST(cnt AS BIGINT) AS cnt"
NARROW = "sym, idx, ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq"
VWAP_SQL = "CAST(CAST(sum(CAST({p} * 10000 AS BIGINT)::HUGEINT * CAST({q} * 10000 AS BIGINT)) // nullif(sum(CAST({q} * 10000 AS BIGINT)), 0) AS DOUBLE) / 10000 AS DOUBLE)"


def snap_cte(name: str, source: str, length: int, modulus: int = 0) -> str:
    v = "sum(CASE WHEN ttf = 3 THEN CAST(px * 10000 AS BIGINT)::HUGEINT * CAST(sz * 10000 AS BIGINT) END) // nullif(sum(CASE WHEN ttf = 3 THEN CAST(sz * 10000 AS BIGINT) END), 0)"
    return f"""{name} AS (SELECT sym, {bucket(length, modulus)} AS ts, arg_max(px, (ts, seq)) FILTER (WHERE ttf = 1) AS bp, arg_max(sz, (ts, seq)) FILTER (WHERE ttf = 1) AS bq,
 arg_max(px, (ts, seq)) FILTER (WHERE ttf = 2) AS ap, arg_max(sz, (ts, seq)) FILTER (WHERE ttf = 2) AS aq, CAST({v} AS DOUBLE) / 10000 AS tvpr, sum(sz) FILTER (WHERE ttf = 3) AS tq
 FROM {source} WHERE ttf IN (1, 2, 3) AND px IS NOT NULL GROUP BY ALL)"""


SNAP = ", ".join(["sym", "ts", *(f"CAST({c} AS DOUBLE) AS {c}" for c in ("bp", "bq", "ap", "aq", "tvpr", "tq"))])

# ---- candles ----------------------------------------------------------------


@query("candle_ticks_day", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    return C.candles(ticks(spark, sf), DAY)


@query("candle_modulus_offset", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', 3600, 900)} SELECT {OHLC} FROM k")
def _(spark, sf):
    return C.candles(ticks(spark, sf), 3600, 900)


@query(
    "candle_zero_fill",
    f"""WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)}, q AS (SELECT sym, ts, sta_ts, min(side) AS side FROM k WHERE side < 3 GROUP BY ALL HAVING count(*) = 1)
 SELECT {OHLC} FROM k UNION ALL SELECT sym, 3 - side, ts, sta_ts, 0.0, 0.0, 0.0, 0.0, 0 FROM q""",
)
def _(spark, sf):
    return C.candles(ticks(spark, sf), DAY, zero_fill=True)


SIDED_SQL = "sided AS (SELECT sym, ts, seq, 1 AS ttf, bp AS px FROM pairs UNION ALL SELECT sym, ts, seq, 2, ap FROM pairs)"


@query("candle_pairs", f"WITH {PAIRS_SQL}, {SIDED_SQL}, {candle_cte('k', 'sided', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    return C.candles_of_pairs(pairs(ticks(spark, sf)), DAY)


SNAP_SIDED = "sided AS (SELECT sym, ts - INTERVAL '1 microsecond' AS ts, 0 AS seq, 1 AS ttf, bp AS px FROM s WHERE bp <> 0 UNION ALL SELECT sym, ts - INTERVAL '1 microsecond', 0, 2, ap FROM s WHERE ap <> 0)"


@query("candle_snapshots", f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', 3600)}, {SNAP_SIDED}, {candle_cte('k', 'sided', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    return C.candles_of_snapshots(S.snapshots(ticks(spark, sf), 3600).withColumn("seq", F.lit(0)), DAY)


ROLL = f"""SELECT sym, side, {bucket(DAY, closed=True)} AS ts, arg_min(sta_ts, (ts, sta_ts)) AS sta_ts, CAST(arg_min(o, (ts, sta_ts)) AS DOUBLE) AS o, CAST(max(h) AS DOUBLE) AS h, CAST(min(l) AS DOUBLE) AS l,
 CAST(arg_max(c, (ts, sta_ts)) AS DOUBLE) AS c, CAST(sum(cnt) AS BIGINT) AS cnt FROM k GROUP BY sym, side, {bucket(DAY, closed=True)}"""


@query("candle_rollup", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', 3600)} {ROLL}")
def _(spark, sf):
    return C.roll_up(C.candles(ticks(spark, sf), 3600), DAY)


@query("candle_join", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    t = ticks(spark, sf)
    noon = F.hour("ts") < 12
    halves = [C.candles(t.where(c), DAY) for c in (noon, ~noon)]
    joined = C.join_candles(halves[0], halves[1].withColumn("sta_ts", F.col("sta_ts") + F.expr("INTERVAL 12 HOURS")))
    return joined.withColumn("sta_ts", F.col("ts") - F.expr("INTERVAL 1 DAY"))


def _pivot_sql() -> str:
    cols = ", ".join(f"CAST(max({c}) FILTER (WHERE side = {s}) AS DOUBLE) AS {n}_{c}" for s, n in ((1, "b"), (2, "a"), (3, "t")) for c in "ohlc")
    return f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT sym, ts, {cols} FROM k GROUP BY sym, ts"


@query("candle_pivot", _pivot_sql())
def _(spark, sf):
    return C.pivot_sides(C.candles(ticks(spark, sf), DAY))


@query(
    "candle_volume",
    f"""WITH {TICKS_SQL} SELECT sym, {bucket(DAY)} AS ts, CAST(sum(sz) AS DOUBLE) AS vol, {VWAP_SQL.format(p='px', q='sz')} AS vwap,
 CAST(sum(CAST(px * 10000 AS BIGINT)) // count(*) AS DOUBLE) / 10000 AS twap, count(*) AS cnt FROM ticks WHERE ttf = 3 AND px IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return C.volume_candles(ticks(spark, sf), DAY)


LI_SQL = """li AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS sym, CAST(l_shipdate AS TIMESTAMP) AS ts, 3 AS ttf, CAST(floor(l_extendedprice * 100 / l_quantity) / 100 AS DECIMAL(18,4)) AS px,
 CAST(l_quantity AS DECIMAL(18,4)) AS sz, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq FROM lineitem)"""


@query("candle_lineitem_month", f"WITH {LI_SQL}, {candle_cte('k', 'li', 30 * DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    return C.candles(lineitem_to_ticks(table(spark, sf, "lineitem")), 30 * DAY)


# ---- snapshots ----------------------------------------------------------------


@query("snapshot_day", f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', DAY)} SELECT {SNAP} FROM s")
def _(spark, sf):
    return S.snapshots(ticks(spark, sf), DAY)


@query("snapshot_5min", f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', 300)} SELECT {SNAP} FROM s")
def _(spark, sf):
    return S.snapshots(ticks(spark, sf))


@query(
    "snapshot_pairs",
    f"WITH {PAIRS_SQL}, sided AS (SELECT sym, ts, seq, 1 AS ttf, bp AS px, CAST(0 AS DECIMAL(18,4)) AS sz FROM pairs UNION ALL SELECT sym, ts, seq, 2, ap, CAST(0 AS DECIMAL(18,4)) FROM pairs), {snap_cte('s', 'sided', DAY)} SELECT {SNAP} FROM s",
)
def _(spark, sf):
    return S.snapshots(S.quotes_of_pairs(pairs(ticks(spark, sf))), DAY)


@query(
    "snapshot_candles",
    f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', 3600)}, quotes AS (SELECT sym, ts - INTERVAL '1 microsecond' AS ts, side AS ttf, c AS px, CAST(cnt AS DECIMAL(18,4)) AS sz, 0 AS seq FROM k), {snap_cte('s', 'quotes', DAY)} SELECT {SNAP} FROM s",
)
def _(spark, sf):
    return S.snapshots(S.quotes_of_candles(C.candles(ticks(spark, sf), 3600)), DAY)


@query(
    "snapshot_of_snapshots",
    f"""WITH {TICKS_SQL}, {snap_cte('s', 'ticks', 3600)} SELECT sym, {bucket(DAY, closed=True)} AS ts, CAST(arg_max(bp, ts) FILTER (WHERE bp IS NOT NULL) AS DOUBLE) AS bp, CAST(arg_max(bq, ts) FILTER (WHERE bq IS NOT NULL) AS DOUBLE) AS bq,
 CAST(arg_max(ap, ts) FILTER (WHERE ap IS NOT NULL) AS DOUBLE) AS ap, CAST(arg_max(aq, ts) FILTER (WHERE aq IS NOT NULL) AS DOUBLE) AS aq,
 CAST(sum(CAST(round(tvpr * 10000) AS BIGINT) * CAST(tq AS BIGINT)) // nullif(sum(CASE WHEN tvpr IS NOT NULL OR tq IS NOT NULL THEN CAST(tq AS BIGINT) END), 0) AS DOUBLE) / 10000 AS tvpr, CAST(sum(tq) AS DOUBLE) AS tq FROM s GROUP BY sym, {bucket(DAY, closed=True)}""",
)
def _(spark, sf):
    return S.resnap(S.snapshots(ticks(spark, sf), 3600), DAY)


@query("snapshot_merge", f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', DAY)} SELECT sym, ts, " + ", ".join(f"CAST(nullif({c}, 0) AS DOUBLE) AS {c}" for c in ("bp", "bq", "ap", "aq", "tvpr", "tq")) + " FROM s")
def _(spark, sf):
    s = S.snapshots(ticks(spark, sf), DAY)
    none = lambda *cs: s.withColumns({c: F.lit(None).cast(s.schema[c].dataType) for c in cs})
    return S.merge_halves(none("ap", "aq").unionByName(none("bp", "bq", "tvpr", "tq")))


@query(
    "snapshot_carry_forward",
    f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', DAY)} SELECT sym, ts, " + ", ".join(f"CAST(last_value({c} IGNORE NULLS) OVER w AS DOUBLE) AS {c}" for c in ("bp", "bq", "ap", "aq")) + ", CAST(tvpr AS DOUBLE) AS tvpr, CAST(tq AS DOUBLE) AS tq FROM s WINDOW w AS (PARTITION BY sym ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def _(spark, sf):
    return S.carry_forward(S.snapshots(ticks(spark, sf), DAY))


@query("vwap_trunc", f"WITH {TICKS_SQL} SELECT sym, {VWAP_SQL.format(p='px', q='sz')} AS vwap, CAST(sum(sz) AS DOUBLE) AS tq FROM ticks WHERE ttf = 3 GROUP BY sym")
def _(spark, sf):
    return ticks(spark, sf).where("ttf = 3").groupBy("sym").agg(decimals.vwap(F.col("px"), F.col("sz")).alias("vwap"), F.sum("sz").alias("tq"))


@query("vwap_fraction", f"WITH {TICKS_SQL} SELECT sym, {VWAP_SQL.format(p='px', q='(sz * 0.25)')} AS vwap FROM ticks WHERE ttf = 3 GROUP BY sym")
def _(spark, sf):
    rows = ticks(spark, sf).where("ttf = 3").withColumn("sz", (F.col("sz") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,4)"))
    return rows.groupBy("sym").agg(decimals.vwap(F.col("px"), F.col("sz")).alias("vwap"))


# ---- info ------------------------------------------------------------------------


@query("info_type_set", f"WITH {TICKS_SQL} SELECT sym, bit_or(CAST(1 AS BIGINT) << ttf) AS types, count(DISTINCT ttf) AS n_types FROM ticks GROUP BY sym")
def _(spark, sf):
    return info.type_sets(ticks(spark, sf))


@query("info_interval", f"WITH {TICKS_SQL} SELECT sym, {bucket(7 * DAY)} - INTERVAL '{7 * DAY} seconds' AS from_ts, {bucket(7 * DAY)} AS to_ts, bit_or(CAST(1 AS BIGINT) << ttf) AS types FROM ticks GROUP BY ALL")
def _(spark, sf):
    return info.type_sets_by_interval(ticks(spark, sf), 7 * DAY)


@query(
    "candle_width",
    f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', 3600)}, {candle_cte('d', 'ticks', DAY)}, every AS (SELECT * FROM k UNION ALL SELECT * FROM d WHERE side = 1) SELECT sym, side, CAST(CASE WHEN min(epoch(ts) - epoch(sta_ts)) = max(epoch(ts) - epoch(sta_ts)) THEN min(epoch(ts) - epoch(sta_ts)) ELSE -1 END AS BIGINT) AS width FROM every GROUP BY sym, side",
)
def _(spark, sf):
    t = ticks(spark, sf)
    return info.candle_widths(C.candles(t, 3600).unionByName(C.candles(t, DAY).where("side = 1")))


WIDTH_CASE = "CASE " + " ".join(f"WHEN gap <= {w} THEN {w}" for w in info.WIDTHS) + " ELSE 86400 END"


@query(
    "candle_width_guess",
    f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', 300)}, g AS (SELECT sym, side, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY sym, side ORDER BY ts)) AS gap FROM k), m AS (SELECT sym, side, min(gap) AS gap FROM g GROUP BY ALL) SELECT sym, side, CASE WHEN gap IS NOT NULL THEN CAST({WIDTH_CASE} AS BIGINT) END AS width FROM m",
)
def _(spark, sf):
    return info.guessed_widths(C.candles(ticks(spark, sf), 300))


@query(
    "snapshot_frequency",
    f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', 300)}, g AS (SELECT sym, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY sym ORDER BY ts)) AS gap FROM s) SELECT sym, CAST(min(gap) AS BIGINT) AS freq FROM g WHERE gap > 0 GROUP BY sym",
)
def _(spark, sf):
    return info.snapshot_frequencies(S.snapshots(ticks(spark, sf), 300))


LABEL_SQL = "CASE WHEN n <= 0 THEN '???' WHEN n >= 86400 THEN 'eod' WHEN n % 3600 = 0 THEN lpad(CAST(n // 3600 AS VARCHAR), 2, '0') || 'h' WHEN n % 60 = 0 THEN lpad(CAST(n // 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST(n AS VARCHAR) || 's' END"


@query("interval_label", f"SELECT event_id, {LABEL_SQL} AS label FROM (SELECT event_id, (event_id % 25) * 300 + (event_id % 3) * 10 AS n FROM events)")
def _(spark, sf):
    n = (F.col("event_id") % 25) * 300 + (F.col("event_id") % 3) * 10
    return table(spark, sf, "events").select("event_id", info.interval_label(n).alias("label"))


@query("tick_counts", f"WITH {TICKS_SQL} SELECT count(*) AS n_ticks, count(*) AS n_cells, count(DISTINCT sym) AS n_syms, CAST(ceil(count(*) / 262144.0) AS BIGINT) AS n_pages FROM ticks")
def _(spark, sf):
    return info.counts(ticks(spark, sf))


# ---- shape ------------------------------------------------------------------------


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN CAST({b} AS DOUBLE) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END, 6)"


@query(
    "shape_stats",
    f"""WITH {TICKS_SQL}, s AS (SELECT sym, arg_min(px, (ts, seq)) AS o, arg_max(px, (ts, seq)) AS c, min(px) AS lo, max(px) AS hi, arg_min(ts, (px, ts, seq)) AS lt, arg_min(ts, (-px, ts, seq)) AS ht FROM ticks WHERE ttf = 1 GROUP BY sym)
 SELECT sym, CAST(o AS DOUBLE) AS o, CAST(c AS DOUBLE) AS c, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CASE WHEN lt < ht THEN 'M' WHEN lt > ht THEN 'N' ELSE '-' END AS shape,
 {_ratio('c - o', 'o')} AS ret, {_ratio('hi - lo', 'lo')} AS span, {_ratio('c - o', 'c + o')} AS rel_ret, {_ratio('hi - lo', 'hi + lo')} AS rel_span FROM s""",
)
def _(spark, sf):
    return shape.shapes(ticks(spark, sf))


SAMPLE_SQL = """q AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY sym) AS t0, max(epoch_us(ts)) OVER (PARTITION BY sym) AS t1 FROM ticks WHERE ttf IN (1, 2)),
 g AS (SELECT sym, CAST(floor(CAST((us - t0) * {n} AS DOUBLE) / greatest(t1 - t0, 1)) AS INTEGER) AS slot, arg_min(px, (ts, seq)) FILTER (WHERE ttf = 1) AS bid, arg_min(px, (ts, seq)) FILTER (WHERE ttf = 2) AS ask FROM q GROUP BY ALL),
 f AS (SELECT sym, slot, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM g WINDOW w AS (PARTITION BY sym ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT * FROM f WHERE bid IS NOT NULL AND ask IS NOT NULL)"""


@query("resample_grid", f"WITH {TICKS_SQL}, {SAMPLE_SQL.format(n=63)} SELECT sym, slot, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask FROM s")
def _(spark, sf):
    return shape.sample(ticks(spark, sf), 64)


@query(
    "hold_map",
    f"""WITH {TICKS_SQL}, {SAMPLE_SQL.format(n=15)} SELECT a.sym, a.slot AS enter, b.slot AS leave, round(CASE WHEN a.ask <> 0 THEN CAST(b.bid AS DOUBLE) / CAST(a.ask AS DOUBLE) - 1 END, 6) AS long,
 round(CASE WHEN b.ask <> 0 THEN CAST(a.bid AS DOUBLE) / CAST(b.ask AS DOUBLE) - 1 END, 6) AS short FROM s a JOIN s b ON a.sym = b.sym AND a.slot <= b.slot""",
)
def _(spark, sf):
    return shape.hold_map(ticks(spark, sf), 16)


# ---- filters ------------------------------------------------------------------------

SELECT_NARROW = f"WITH {TICKS_SQL} SELECT {NARROW} FROM ticks"


@query("slab_symbol", f"{SELECT_NARROW} WHERE sym IN ('U1', 'U2', 'U3')")
def _(spark, sf):
    return filters.by_symbol(ticks(spark, sf), ["U1", "U2", "U3"])


@query("slab_index", f"{SELECT_NARROW} WHERE idx IN (3, 5, 8)")
def _(spark, sf):
    return filters.by_index(ticks(spark, sf), [3, 5, 8])


@query("slab_symbol_or_index", f"{SELECT_NARROW} WHERE idx IN (3, 5, 8) OR sym IN ('U1', 'U9')")
def _(spark, sf):
    return filters.by_symbol_or_index(ticks(spark, sf), ["U1", "U9"], [3, 5, 8])


@query("slab_time_range", f"{SELECT_NARROW} WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 12:00:00'")
def _(spark, sf):
    return filters.by_time(ticks(spark, sf), "2024-01-05 06:00:00", "2024-01-09 12:00:00")


@query("slab_symbol_time", f"{SELECT_NARROW} WHERE sym IN ('U1', 'U2', 'U3', 'U4') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def _(spark, sf):
    return filters.grep(ticks(spark, sf), ["U1", "U2", "U3", "U4"], "2024-01-05", "2024-01-20")


@query("slab_day", f"{SELECT_NARROW} WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08'")
def _(spark, sf):
    return filters.by_day(ticks(spark, sf), "2024-01-07")


@query("symbol_projection", f"WITH {TICKS_SQL} SELECT DISTINCT idx, sym FROM ticks WHERE ttf = 3")
def _(spark, sf):
    return filters.symbols_of(ticks(spark, sf).where("ttf = 3"))


@query("point_access", f"{SELECT_NARROW} ORDER BY ts, idx, ttf, seq LIMIT 1 OFFSET 100")
def _(spark, sf):
    return filters.at(ticks(spark, sf), 100)


@query("key_search", f"WITH {TICKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts, seq) AS n FROM ticks WHERE ts > TIMESTAMP '2024-01-10') SELECT sym, ts, seq, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz FROM r WHERE n = 1")
def _(spark, sf):
    return filters.first_after(ticks(spark, sf), "2024-01-10")


@query("proper_ticks", f"{SELECT_NARROW} WHERE seq % 7 <> 0")
def _(spark, sf):
    t = ticks(spark, sf).withColumn("flow", F.when(F.col("seq") % 7 == 0, "halt"))
    return filters.proper(t).drop("flow")


@query("market_orders", f"{SELECT_NARROW} WHERE ttf IN (1, 2) AND px < 20")
def _(spark, sf):
    t = ticks(spark, sf).withColumn("is_mkt", F.col("px") < 20)
    return t.where(filters.is_market_order()).drop("is_mkt")


@query("type_dispatch", "SELECT event_id, CAST(t AS INTEGER) AS ttf, ((t & 16) <> 0 AND t <> 28) AS candle, t = 28 AS snapshot, CAST(CASE WHEN (t & 16) <> 0 AND (t & 32) <> 0 THEN 0 WHEN (t & 32) <> 0 THEN 4 WHEN (t & 16) <> 0 THEN 2 ELSE 1 END AS INTEGER) AS width FROM (SELECT event_id, event_id % 64 AS t FROM events)")
def _(spark, sf):
    t = (F.col("event_id") % 64).cast("int")
    return table(spark, sf, "events").select("event_id", t.alias("ttf"), filters.is_candle(t).alias("candle"), filters.is_snapshot(t).alias("snapshot"), filters.width(t).alias("width"))


BOOK_SQL = "b AS (SELECT sym, ttf, px, arg_max(sz, (ts, seq)) AS sz, max(ts) AS ts FROM (SELECT sym, ttf, round(px, 0) AS px, sz, ts, seq FROM ticks) WHERE ttf IN (1, 2) GROUP BY sym, ttf, px), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY sym, ttf ORDER BY CASE WHEN ttf = 1 THEN -px ELSE px END) AS INTEGER) AS level FROM b WHERE sz > 0)"


@query("book_levels", f"WITH {TICKS_SQL}, {BOOK_SQL} SELECT sym, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, ts, level FROM k WHERE level <= 3")
def _(spark, sf):
    t = ticks(spark, sf).withColumn("px", F.round("px", 0))
    return filters.book_levels(t, 3, bid=1, ask=2)


# ---- dictionaries ------------------------------------------------------------------

DICT_SQL = "dict AS (SELECT CAST(row_number() OVER (ORDER BY sym) AS INTEGER) AS idx, sym FROM (SELECT DISTINCT sym FROM ticks))"


@query("dict_assign", f"WITH {TICKS_SQL}, {DICT_SQL} SELECT idx, sym FROM dict")
def _(spark, sf):
    return dictionary.assign(ticks(spark, sf))


@query("dict_lookup", f"WITH {TICKS_SQL}, {DICT_SQL} SELECT t.seq, CAST(d.idx AS DOUBLE) AS idx, t.sym FROM ticks t LEFT JOIN dict d ON t.sym = d.sym AND d.idx % 3 <> 0")
def _(spark, sf):
    t = ticks(spark, sf)
    return dictionary.lookup_index(t.select("seq", "sym", "idx"), dictionary.assign(t).where("idx % 3 <> 0")).select("seq", F.col("idx").cast("double").alias("idx"), "sym")


@query("dict_symbol", f"WITH {TICKS_SQL}, {DICT_SQL} SELECT t.seq, t.idx, d.sym FROM ticks t LEFT JOIN dict d ON t.idx = d.idx")
def _(spark, sf):
    t = ticks(spark, sf)
    return dictionary.lookup_symbol(t.select("seq", "idx", "sym"), dictionary.assign(t)).select("seq", "idx", "sym")


@query("dict_remap", f"WITH {TICKS_SQL}, {DICT_SQL} SELECT t.seq, d.idx, t.sym FROM ticks t LEFT JOIN dict d ON t.sym = d.sym")
def _(spark, sf):
    t = ticks(spark, sf)
    return dictionary.remap(t.select("seq", "idx", "sym"), filters.symbols_of(t), dictionary.assign(t))


@query("dict_extend", f"WITH {TICKS_SQL}, {DICT_SQL}, base AS (SELECT * FROM dict WHERE idx <= 5), new AS (SELECT DISTINCT sym FROM ticks WHERE sym NOT IN (SELECT sym FROM base)) SELECT idx, sym FROM base UNION ALL SELECT CAST(5 + row_number() OVER (ORDER BY sym) AS INTEGER), sym FROM new")
def _(spark, sf):
    t = ticks(spark, sf)
    return dictionary.extend(dictionary.assign(t).where("idx <= 5"), t)


@query("dict_dump", f"WITH {TICKS_SQL}, {DICT_SQL} SELECT CAST(idx AS VARCHAR) || chr(9) || sym AS value FROM dict")
def _(spark, sf):
    return dictionary.dump(dictionary.assign(ticks(spark, sf)))


# ---- series rules --------------------------------------------------------------------

SERIES = "(PARTITION BY sym, ttf ORDER BY ts, seq)"
BEFORE = "(PARTITION BY sym, ttf ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND {})"


@query("dedupe_consecutive", f"WITH {TICKS_SQL}, c AS (SELECT * REPLACE (round(px / 50, 0) AS px, CAST(CAST(sz AS BIGINT) % 2 AS DECIMAL(18,4)) AS sz) FROM ticks), p AS (SELECT *, lag(px) OVER {SERIES} AS lp, lag(sz) OVER {SERIES} AS ls, row_number() OVER {SERIES} AS n FROM c) SELECT {NARROW} FROM p WHERE n = 1 OR px <> lp OR sz <> ls")
def _(spark, sf):
    coarse = ticks(spark, sf).withColumns({"px": F.round(F.col("px").cast("double") / 50, 0), "sz": (F.col("sz").cast("bigint") % 2).cast("decimal(18,4)")})
    return clean.drop_repeats(coarse)


@query("fill_missing_price", f"WITH {TICKS_SQL}, m AS (SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN px END AS px, CASE WHEN seq % 5 <> 0 THEN sz END AS sz) FROM ticks), f AS (SELECT sym, idx, ts, ttf, last_value(px IGNORE NULLS) OVER w AS px, last_value(sz IGNORE NULLS) OVER w AS sz, seq FROM m WINDOW w AS {BEFORE.format('CURRENT ROW')}) SELECT {NARROW} FROM f")
def _(spark, sf):
    holes = ticks(spark, sf).withColumns({"px": F.when(F.col("seq") % 3 != 0, F.col("px")), "sz": F.when(F.col("seq") % 5 != 0, F.col("sz"))})
    return clean.fill_missing(holes)


@query("repeated_size_drop", f"WITH {TICKS_SQL}, m AS (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN px END AS px, CAST(CAST(sz AS BIGINT) % 3 AS DECIMAL(18,4)) AS sz) FROM ticks), f AS (SELECT *, last_value(sz IGNORE NULLS) OVER w AS ls FROM m WINDOW w AS {BEFORE.format('1 PRECEDING')}) SELECT {NARROW} FROM f WHERE px IS NOT NULL OR ls IS NULL OR sz <> ls")
def _(spark, sf):
    rows = ticks(spark, sf).withColumns({"px": F.when(F.col("seq") % 2 == 0, F.col("px")), "sz": (F.col("sz").cast("bigint") % 3).cast("decimal(18,4)")})
    return clean.drop_repeated_sizes(rows)


@query("inter_row_gap", f"WITH {TICKS_SQL} SELECT {NARROW}, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER {SERIES}) AS DOUBLE) AS gap_us FROM ticks")
def _(spark, sf):
    return clean.gaps(ticks(spark, sf)).withColumn("gap_us", F.col("gap_us").cast("double"))


@query("stamp_fallback", f"WITH {TICKS_SQL}, m AS (SELECT sym, seq, CASE WHEN seq % 4 <> 0 THEN ts END AS ts, CASE WHEN seq % 8 <> 0 THEN ts - INTERVAL '1 hour' END AS ts2 FROM ticks), f AS (SELECT sym, seq, coalesce(ts, greatest(ts2, last_value(ts IGNORE NULLS) OVER (PARTITION BY sym ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS ts FROM m) SELECT sym, seq, ts FROM f")
def _(spark, sf):
    rows = ticks(spark, sf).select("sym", "seq", F.when(F.col("seq") % 4 != 0, F.col("ts")).alias("ts"), F.when(F.col("seq") % 8 != 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts2"))
    return clean.repair_stamps(rows).select("sym", "seq", "ts")


@query("receive_lag", f"WITH {TICKS_SQL}, m AS (SELECT sym, seq, ts, CAST(sz AS DOUBLE) AS lag_us FROM ticks) SELECT a.sym, a.seq, round(list_reduce([0.0::DOUBLE] || l, lambda acc, x: (acc + x) / 2), 4) AS offset_us FROM (SELECT sym, seq, list(lag_us) OVER (PARTITION BY sym ORDER BY ts, seq ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS l FROM m) a")
def _(spark, sf):
    rows = clean.receive_lag(ticks(spark, sf).withColumn("lag_us", F.col("sz")))
    return rows.select("sym", "seq", F.round("offset_us", 4).alias("offset_us"))


@query("auction_state", f"WITH {TICKS_SQL}, m AS (SELECT *, CASE WHEN ttf = 4 THEN true WHEN ttf = 5 THEN false END AS mark FROM ticks), f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY sym ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM m) SELECT sym, seq, CAST(CASE WHEN ttf = 3 AND seq % 2 = 0 AND coalesce(state, false) THEN 6 ELSE ttf END AS INTEGER) AS ttf FROM f")
def _(spark, sf):
    t = ticks(spark, sf).withColumn("px", F.when(F.col("seq") % 2 != 0, F.col("px")))
    rows = t.withColumns({"opens_auction": F.col("ttf") == 4, "closes_auction": F.col("ttf") == 5})
    return clean.route_auctions(rows).select("sym", "seq", "ttf")


SHUFFLED = "(seq * 7919) % 1009"


@query("unsorted_check", f"WITH {TICKS_SQL}, m AS (SELECT * REPLACE ({SHUFFLED} * 100000 + seq AS seq) FROM ticks), p AS (SELECT *, lag(ts) OVER (PARTITION BY sym ORDER BY seq) AS prev_ts FROM m) SELECT {NARROW}, prev_ts FROM p WHERE ts < prev_ts")
def _(spark, sf):
    return clean.unsorted(ticks(spark, sf).withColumn("seq", F.expr(f"{SHUFFLED} * 100000 + seq")))


# ---- order and sets -----------------------------------------------------------------


@query("sort_ticks", f"{SELECT_NARROW}")
def _(spark, sf):
    return sets.chronological(ticks(spark, sf))


@query("sort_within_ranges", f"{SELECT_NARROW}")
def _(spark, sf):
    return sets.chronological_within(ticks(spark, sf), 8)


@query("top_prices", f"WITH {TICKS_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sym ORDER BY px DESC, ts, idx, ttf, seq) AS INTEGER) AS rank FROM ticks) SELECT {NARROW}, rank FROM r WHERE rank <= 3")
def _(spark, sf):
    return sets.top(ticks(spark, sf), 3, "px", per_symbol=True)


@query("top_overall", f"{SELECT_NARROW} ORDER BY px DESC, ts, idx, ttf, seq LIMIT 20")
def _(spark, sf):
    return sets.top(ticks(spark, sf), 20, "px")


@query("union_ticks", f"WITH {TICKS_SQL}, {LI_SQL} SELECT sym, ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq FROM ticks UNION ALL SELECT sym, ts, ttf, CAST(px AS DOUBLE), CAST(sz AS DOUBLE), seq FROM li")
def _(spark, sf):
    return sets.union(ticks(spark, sf), lineitem_to_ticks(table(spark, sf, "lineitem"))).drop("idx")


@query("diff_ticks", f"WITH {TICKS_SQL} SELECT {NARROW}, '<' AS side FROM ticks WHERE ttf = 1 UNION ALL SELECT {NARROW}, '>' AS side FROM ticks WHERE ttf = 3")
def _(spark, sf):
    t = ticks(spark, sf)
    return sets.difference(t.where("ttf in (1, 2)"), t.where("ttf in (2, 3)"))


@query("intersect_ticks", f"{SELECT_NARROW} WHERE ttf = 2")
def _(spark, sf):
    t = ticks(spark, sf)
    return sets.common(t.where("ttf in (1, 2)"), t.where("ttf in (2, 3)"))


@query("validate_issues", f"WITH {TICKS_SQL}, m AS (SELECT * REPLACE (CASE WHEN seq % 50 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN seq % 70 = 0 THEN 48 ELSE ttf END AS ttf) FROM ticks), p AS (SELECT *, lag(ts) OVER (PARTITION BY sym ORDER BY seq) AS prev FROM m) SELECT seq, sym, 'no stamp' AS issue FROM p WHERE ts IS NULL UNION ALL SELECT seq, sym, 'bad type' FROM p WHERE ttf = 48 UNION ALL SELECT seq, sym, 'unsorted' FROM p WHERE ts < prev")
def _(spark, sf):
    rows = ticks(spark, sf).withColumns({"ts": F.when(F.col("seq") % 50 != 0, F.col("ts")), "ttf": F.when(F.col("seq") % 70 == 0, 48).otherwise(F.col("ttf"))})
    return validate.issues(rows)


# ---- scalar functions -------------------------------------------------------------


@query("decimal_parse", "SELECT event_id, CAST(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS DOUBLE) AS narrow, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS wide, CAST(trunc(CAST(value AS DECIMAL(18,2))) AS BIGINT) AS whole FROM events")
def _(spark, sf):
    s = F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit(", 1.44"))
    return table(spark, sf, "events").select("event_id", decimals.parse_narrow(s).alias("narrow"), decimals.parse_wide(s).alias("wide"), decimals.parse_whole(s).alias("whole"))


@query("decimal_show", "SELECT event_id, CASE WHEN v = 0 THEN '0' ELSE CAST(CAST(v AS DECIMAL(31,4)) AS VARCHAR) END AS shown, CAST(CAST(v * 10000 AS BIGINT) AS BIGINT) AS mantissa, CAST(sign(v - 50) AS INTEGER) AS cmp FROM (SELECT event_id, CAST(value AS DECIMAL(18,2)) AS v FROM events)")
def _(spark, sf):
    s = F.col("value").cast("decimal(18,2)").cast("string")
    v, code = decimals.parse_narrow(s), decimals.narrow_scale(s)
    return table(spark, sf, "events").select("event_id", decimals.show(v, code).alias("shown"), decimals.mantissa(v, code).alias("mantissa"), decimals.compare(v, F.lit(50).cast("decimal(21,8)")).alias("cmp"))


@query("decimal_arithmetic", f"WITH {TICKS_SQL} SELECT seq, CAST(px + sz AS DOUBLE) AS added, CAST(px * sz AS DOUBLE) AS multiplied, trunc(CAST(px AS DOUBLE) * 10) / 10 AS cut, CAST(seq % 100000 AS DOUBLE) / 100000 AS points FROM ticks")
def _(spark, sf):
    t = ticks(spark, sf)
    return t.select("seq", (F.col("px") + F.col("sz")).alias("added"), (F.col("px") * F.col("sz")).alias("multiplied"), decimals.truncated(F.col("px"), 1).alias("cut"), decimals.feed_points(F.col("seq") % 100_000).alias("points"))


@query("time_parse", "SELECT event_id, date_trunc('millisecond', ts) AS a, date_trunc('second', ts) - INTERVAL '2 hours' AS b, date_trunc('day', ts) + INTERVAL '86399 seconds' AS c, date_trunc('second', ts) AS d FROM events")
def _(spark, sf):
    f = lambda p: F.date_format("ts", p)
    return table(spark, sf, "events").select(
        "event_id", times.parse_iso(F.concat(f("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).alias("a"), times.parse_iso(F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("b"), times.parse_iso(f("yyyy-MM-dd")).alias("c"), times.parse_compact(f("yyyyMMddHHmmss")).alias("d")
    )


@query("time_show", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS shown, CAST(epoch_us(ts) AS DOUBLE) / 86400000000.0 + 719529 AS datenum, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS sec FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", times.show_iso(F.col("ts")).alias("shown"), times.datenum(F.col("ts")).alias("datenum"), times.seconds(F.col("ts")).cast("bigint").alias("sec"))


@query("time_zones", "SELECT event_id, (ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS utc, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, 37 AS tai, 18 AS gps FROM events")
def _(spark, sf):
    sec = times.seconds(F.col("ts"))
    return table(spark, sf, "events").select("event_id", times.to_utc(F.col("ts"), "Europe/Berlin").alias("utc"), times.from_utc(F.col("ts"), "America/New_York").alias("ny"), times.tai_offset(sec).alias("tai"), times.gps_offset(sec).alias("gps"))


@query("bucket_align", f"SELECT event_id, {bucket(900)} AS plain, {bucket(3600, 600)} AS shifted, {bucket(900, closed=True)} AS span FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", times.bucket_end(ts, 900).alias("plain"), times.bucket_end(ts, 3600, 600).alias("shifted"), times.bucket_end(ts, 900, closed_end=True).alias("span"))


@query("candle_spec", "SELECT event_id, CAST(n * CASE u WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END AS INTEGER) AS width, 'c' || CAST(n AS VARCHAR) || u AS spec FROM (SELECT event_id, CAST(event_id % 23 + 1 AS INTEGER) AS n, substr('smhd', CAST(event_id % 4 AS INTEGER) + 1, 1) AS u FROM events) WHERE true")
def _(spark, sf):
    n, u = (F.col("event_id") % 23 + 1).cast("int"), F.substring(F.lit("smhd"), (F.col("event_id") % 4).cast("int") + 1, F.lit(1))
    width = times.candle_width(F.concat(F.lit("c"), n.cast("string"), u))
    return table(spark, sf, "events").select("event_id", width.alias("width"), times.show_candle_width(width).alias("spec"))


@query("text_helpers", "SELECT event_id, event_id AS parsed, lpad(printf('%x', event_id), 8, '0') AS shown, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(strpos(event_type, 'c') - 1 AS INTEGER) AS place, CAST(round(value, 2) AS DECIMAL(18,2))::DOUBLE AS bid FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    hexed = text.int_to_hex(F.col("event_id"), 8)
    line = F.concat(F.lit("1.5 SYM b"), F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit(" a12.5"))
    return e.select("event_id", text.hex_to_int(F.concat(hexed, F.lit("|x"))).alias("parsed"), hexed.alias("shown"), text.leading_int(text.json_value(F.col("props"), "k")).alias("k"), text.find(F.col("event_type"), "c").alias("place"), text.cell(line, "b").cast("double").alias("bid"))
