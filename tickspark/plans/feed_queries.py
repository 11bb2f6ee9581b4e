"""Sources, sinks and streams as queries: feeds are written as lines of the event log's ticks and read back."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark import sinks, streaming
from tickspark.adapters import pairs, ticks
from tickspark.functions import times
from tickspark.operators import asof, planned_sort
from tickspark.operators import candles as C
from tickspark.operators import snapshots as S
from tickspark.plans.tick_queries import DAY, NARROW, OHLC, PAIRS_SQL, SNAP, TICKS_SQL, bucket, candle_cte, plain, snap_cte
from tickspark.schema import tick_columns
from tickspark.sinks import container as container_sink
from tickspark.sources import TEXT, binary, container, xml
from tickspark.work import shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def full(t: DataFrame) -> DataFrame:
    """The narrow columns as the whole tick row, stamps cut to milliseconds."""
    given = {c: F.col(c) for c in t.columns} | {"ts": F.date_trunc("millisecond", "ts"), "msec": F.lit(0)}
    return t.select(*tick_columns(**given))


def lines(t: DataFrame, value) -> DataFrame:
    return t.select(value.alias("value"), "seq")


MS = "date_trunc('millisecond', ts)"
AT_MS = f"sym, {MS} AS ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq"
SEC = "(CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT))"


@query("source_ticktext_points", f"WITH {TICKS_SQL} SELECT sym, idx, {MS} AS ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq FROM ticks")
def _(spark: SparkSession, sf: str):
    t = full(ticks(spark, sf))
    text = sinks.tick_text(t.orderBy("seq")).select("value").withColumn("n", F.lit(0))
    # The printed line carries no arrival number; the stamp and index bring it back.
    back = TEXT["ticktext"](text.withColumn("seq", F.monotonically_increasing_id()).drop("n")).drop("seq")
    where = t.select("sym", "ts", "ttf", "px", "sz", "seq")
    return back.select("sym", "idx", "ts", "ttf", "px", "sz").join(where, ["sym", "ts", "ttf", "px", "sz"]).select("sym", "idx", "ts", "ttf", "px", "sz", "seq")


@query("source_ticktext_candles", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    k = C.candles(ticks(spark, sf), DAY)
    rows = k.select(*tick_columns(sym=F.col("sym"), idx=F.lit(1), ts=F.col("ts"), msec=F.lit(0), ttf=F.col("side") + 16, o=F.col("o"), h=F.col("h"), l=F.col("l"), c=F.col("c"), sta_ts=F.col("sta_ts"), cnt=F.col("cnt"), seq=F.lit(0)))
    back = TEXT["ticktext"](sinks.tick_text(rows).withColumn("seq", F.lit(0).cast("long")))
    return back.select("sym", (F.col("ttf") - 16).alias("side"), "ts", "sta_ts", "o", "h", "l", "c", "cnt")


def _number_sql(x: str) -> str:
    """A number with the decimals of its scale: 8 below 5 if it has 4 or more, 4 below 50,000, else none."""
    return f"CASE WHEN coalesce({x}, 0) = 0 THEN '0' WHEN abs({x}) < 5 AND CAST({x} AS DECIMAL(18,3)) <> {x} THEN CAST(CAST({x} AS DECIMAL(21,8)) AS VARCHAR) WHEN abs({x}) < 50000 THEN CAST(CAST({x} AS DECIMAL(18,4)) AS VARCHAR) ELSE CAST(CAST({x} AS DECIMAL(18,0)) AS VARCHAR) END"


@query("sink_ticktext", f"WITH {TICKS_SQL} SELECT sym || chr(9) || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' || chr(9) || printf('%x', idx) || chr(9) || printf('%x', ttf) || chr(9) || {_number_sql('px')} || chr(9) || {_number_sql('sz')} AS value FROM ticks")
def _(spark, sf):
    return sinks.tick_text(full(ticks(spark, sf)))


def _matrix_sql() -> str:
    cells = ", ".join(f"CAST(max({c}) FILTER (WHERE side = {s}) AS DOUBLE) AS {c}{s}" for s in (1, 2, 3) for c in "ohlc")
    return f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT CAST(epoch_us(ts) AS DOUBLE) / 86400000000.0 + 719529 AS day, sym, {cells} FROM k GROUP BY ts, sym"


@query("sink_candle_matrix", _matrix_sql())
def _(spark, sf):
    return sinks.candle_matrix(C.candles(ticks(spark, sf), DAY))


@query("sink_snapshot_matrix", f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', DAY)} SELECT CAST(epoch_us(ts) AS DOUBLE) / 86400000000.0 + 719529 AS day, sym, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in ("bp", "ap", "bq", "aq", "tvpr", "tq")) + " FROM s")
def _(spark, sf):
    return sinks.snapshot_matrix(S.snapshots(ticks(spark, sf), DAY))


@query("explode_interval", f"WITH {TICKS_SQL} SELECT {NARROW}, strftime({bucket(DAY)} - INTERVAL '1 day', '%Y-%m-%dT%H:%M:%S') AS bucket FROM ticks")
def _(spark, sf):
    return sinks.with_interval(ticks(spark, sf), DAY)


@query("source_truefx", f"WITH {PAIRS_SQL} SELECT sym, {MS} AS ts, 1 AS ttf, CAST(bp AS DOUBLE) AS px, 0.0::DOUBLE AS sz, seq FROM pairs UNION ALL SELECT sym, {MS}, 2, CAST(ap AS DOUBLE), 0.0::DOUBLE, seq FROM pairs")
def _(spark, sf):
    value = F.concat_ws(",", "sym", F.date_format("ts", "yyyyMMdd HH:mm:ss.SSS"), F.col("bp").cast("string"), F.col("ap").cast("string"))
    return TEXT["truefx"](lines(pairs(ticks(spark, sf)), value), every=True).select("sym", "ts", "ttf", "px", "sz", "seq")


@query("source_truefx_changes", f"WITH {TICKS_SQL}, m AS (SELECT sym, {MS} AS ts, seq, round(px / 50, 0) AS bp, CAST(CAST(sz AS BIGINT) % 2 AS DOUBLE) AS ap FROM ticks), s AS (SELECT sym, ts, seq, 1 AS ttf, bp AS px FROM m UNION ALL SELECT sym, ts, seq, 2, ap FROM m), p AS (SELECT *, lag(px) OVER (PARTITION BY sym, ttf ORDER BY ts, seq) AS lp FROM s) SELECT sym, ts, ttf, CAST(px AS DOUBLE) AS px, seq FROM p WHERE lp IS NULL OR lp <> px")
def _(spark, sf):
    t = ticks(spark, sf)
    value = F.concat_ws(",", "sym", F.date_format("ts", "yyyyMMdd HH:mm:ss.SSS"), F.round(F.col("px").cast("double") / 50, 0).cast("string"), (F.col("sz").cast("bigint") % 2).cast("string"))
    return TEXT["truefx"](lines(t, value)).select("sym", "ts", "ttf", "px", "seq")


#: Central European summer time begins and ends on the last Sundays of March and October, at 3 on the clock.
SUMMER = "ts >= {a} AND ts < {b}".format(**{k: f"make_date(year(ts), {m}, 31) - CAST(dayofweek(make_date(year(ts), {m}, 31)) AS INTEGER) + INTERVAL '3 hours'" for k, m in (("a", 3), ("b", 10))})


@query("source_fxstreet", f"WITH {PAIRS_SQL} SELECT sym, date_trunc('second', ts) - CASE WHEN {SUMMER} THEN INTERVAL '2 hours' ELSE INTERVAL '1 hour' END AS ts, CAST(bp AS DOUBLE) AS bp, CAST(ap AS DOUBLE) AS ap, CAST(bp AS DOUBLE) AS tvpr, seq FROM pairs")
def _(spark, sf):
    p = pairs(ticks(spark, sf))
    value = F.concat_ws("\t", F.lit("1700000000.5"), "sym", F.date_format("ts", "yyyy-M-d H:m:s"), F.col("bp").cast("string"), F.col("ap").cast("string"), F.col("bp").cast("string"))
    return TEXT["fxstreet"](lines(p, value)).select("sym", "ts", "bp", "ap", "tvpr", "seq")


@query("source_forexfactory", f"WITH {PAIRS_SQL} SELECT 'EURUSD.' || sym AS sym, {MS} AS ts, CAST(bp AS DOUBLE) AS bp, CAST(ap AS DOUBLE) AS ap, seq FROM pairs")
def _(spark, sf):
    epoch = F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lit("."), F.date_format("ts", "SSS"))
    json = F.to_json(F.struct(F.col("sym").alias("platform"), F.col("bp").cast("string").alias("bid"), F.col("ap").cast("string").alias("ask")))
    value = F.concat(epoch, F.lit(" x PRIVMSG #ffEURUSD :"), json)
    return TEXT["forexfactory"](lines(pairs(ticks(spark, sf)), value)).select("sym", "ts", "bp", "ap", "seq")


@query("source_ariva", f"WITH {TICKS_SQL} SELECT sym, {MS} AS ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq FROM ticks WHERE ttf IN (1, 2, 3) AND px > 0 AND sz > 0")
def _(spark, sf):
    t = ticks(spark, sf).where("ttf in (1, 2, 3) and px > 0 and sz > 0")
    epoch = F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lit("."), F.date_format("ts", "SSS"))
    k = F.element_at(F.array(F.lit("b"), F.lit("a"), F.lit("p")), F.col("ttf"))
    value = F.concat(epoch, F.lit(" "), F.col("sym"), F.lit(" "), k, F.col("px").cast("string"), F.lit(" "), F.upper(k), F.col("sz").cast("string"))
    return TEXT["ariva"](lines(t, value)).select("sym", "ts", "ttf", "px", "sz", "seq")


@query("source_fieldlist", f"WITH {TICKS_SQL} SELECT {AT_MS} FROM ticks WHERE ttf = 3")
def _(spark, sf):
    t = ticks(spark, sf).where("ttf = 3")
    value = F.concat_ws("|", F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:mm:ss:SSS"), F.lit("Q"), "sym", F.concat(F.lit("f6="), F.col("px").cast("string")), F.concat(F.lit("f9="), F.col("sz").cast("string")))
    return TEXT["fieldlist"](lines(t, value)).select("sym", "ts", "ttf", "px", "sz", "seq")


@query("source_rtdump", f"WITH {TICKS_SQL}, m AS (SELECT sym, {MS} AS ts, ttf, CASE WHEN seq % 3 <> 0 THEN px END AS px, sz, seq FROM ticks WHERE ttf IN (1, 2, 3)) SELECT sym, ts, ttf, CAST(last_value(px IGNORE NULLS) OVER (PARTITION BY sym, ttf ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq FROM m")
def _(spark, sf):
    t = ticks(spark, sf).where("ttf in (1, 2, 3)")
    px = F.when(F.col("seq") % 3 != 0, F.col("px").cast("string")).otherwise(F.lit("\\N"))
    value = F.concat_ws("\t", "sym", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "SSS"), F.lit("1"), px, F.col("sz").cast("string"), F.col("ttf").cast("string"))
    return TEXT["rtdump"](lines(t, value)).select("sym", "ts", "ttf", "px", "sz", "seq")


@query("container_ticks", f"WITH {TICKS_SQL} SELECT sym, idx, {MS} AS ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz FROM ticks")
def _(spark, sf):
    at = f"{shared_folder(spark, 'container')}/ticks"
    container_sink.write_container(full(ticks(spark, sf)), at, packed=True)
    return container.container(spark, at).select("sym", "idx", "ts", "ttf", "px", "sz")


@query("container_candles", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    k = C.candles(ticks(spark, sf), DAY)
    rows = k.select(*tick_columns(sym=F.col("sym"), idx=F.substring("sym", 2, 9).cast("int") + 1, ts=F.col("ts"), msec=F.lit(0), ttf=F.col("side") + 16, o=F.col("o"), h=F.col("h"), l=F.col("l"), c=F.col("c"), sta_ts=F.col("sta_ts"), cnt=F.col("cnt"), seq=F.lit(0)))
    at = f"{shared_folder(spark, 'container')}/candles"
    container_sink.write_container(rows, at, order="big")
    return container.container(spark, at).select("sym", (F.col("ttf") - 16).alias("side"), "ts", "sta_ts", "o", "h", "l", "c", "cnt")


@query("container_stream", f"WITH {TICKS_SQL} SELECT sym, idx, {MS} AS ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz FROM ticks")
def _(spark, sf):
    at = shared_folder(spark, "container")
    container_sink.write_container(full(ticks(spark, sf)), f"{at}/ticks", pages=1)
    streaming.run_to_parquet(container.stream(spark, f"{at}/ticks"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("sym", "idx", "ts", "ttf", "px", "sz")


@query("stream_candles", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT {OHLC} FROM k")
def _(spark, sf):
    at = shared_folder(spark, "stream")
    streaming.maintain(streaming.read_events(spark, sf), lambda t: C.candles(t, DAY), at, DAY)
    return streaming.maintained(spark, at)


@query("stream_snapshots", f"WITH {TICKS_SQL}, {snap_cte('s', 'ticks', DAY)} SELECT {SNAP} FROM s")
def _(spark, sf):
    at = shared_folder(spark, "stream")
    streaming.maintain(streaming.read_events(spark, sf), lambda t: S.snapshots(t, DAY), at, DAY)
    return streaming.maintained(spark, at)


@query("stream_clean", f"WITH {TICKS_SQL}, c AS (SELECT sym, ttf, ts, round(px / 50, 0) AS px, CAST(CAST(sz AS BIGINT) % 2 AS DECIMAL(18,4)) AS sz, seq FROM ticks), p AS (SELECT *, lag(px) OVER w AS lp, lag(sz) OVER w AS ls, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY sym, ttf ORDER BY ts, seq)) SELECT sym, ttf, ts, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq FROM p WHERE n = 1 OR px <> lp OR sz <> ls")
def _(spark, sf):
    coarse = streaming.read_events(spark, sf).withColumns({"px": F.round(F.col("px").cast("double") / 50, 0).cast("decimal(18,4)"), "sz": (F.col("sz").cast("bigint") % 2).cast("decimal(18,4)")})
    at = shared_folder(spark, "stream")
    streaming.run_to_parquet(streaming.stream_clean(coarse), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("asof_join", f"WITH {TICKS_SQL}, q AS (SELECT sym, ts, arg_max(px, seq) AS px FROM ticks WHERE ttf = 1 GROUP BY sym, ts) SELECT t.sym, t.ts, t.seq, CAST(t.px AS DOUBLE) AS px, q.ts AS q_ts, CAST(q.px AS DOUBLE) AS q_px FROM (SELECT * FROM ticks WHERE ttf = 3) t ASOF LEFT JOIN q ON t.sym = q.sym AND t.ts >= q.ts")
def _(spark, sf):
    t = ticks(spark, sf)
    return asof.as_of(t.where("ttf = 3"), t.where("ttf = 1")).select("sym", "ts", "seq", "px", "q_ts", "q_px")


def _spans(cte: str) -> str:
    return f"{cte} SELECT sym, sta_ts, ts, CAST(arg_min(px, (t, seq)) AS DOUBLE) AS o, CAST(max(px) AS DOUBLE) AS h, CAST(min(px) AS DOUBLE) AS l, CAST(arg_max(px, (t, seq)) AS DOUBLE) AS c, count(*) AS cnt FROM s GROUP BY sym, sta_ts, ts"


GAP = 6 * 3600


@query("session_candles", _spans(f"WITH {TICKS_SQL}, b AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {GAP}000000 THEN 0 ELSE 1 END AS new FROM ticks WHERE px IS NOT NULL WINDOW w AS (PARTITION BY sym ORDER BY ts, seq)), n AS (SELECT *, sum(new) OVER (PARTITION BY sym ORDER BY ts, seq) AS k FROM b), s AS (SELECT sym, seq, px, ts AS t, min(ts) OVER (PARTITION BY sym, k) AS sta_ts, max(ts) OVER (PARTITION BY sym, k) + INTERVAL '{GAP} seconds' AS ts FROM n)"))
def _(spark, sf):
    return asof.sessions(ticks(spark, sf), GAP)


@query("sliding_candles", _spans(f"WITH {TICKS_SQL}, s AS (SELECT sym, seq, px, ts AS t, to_timestamp(0)::TIMESTAMP + INTERVAL (k * 43200) SECONDS AS sta_ts, to_timestamp(0)::TIMESTAMP + INTERVAL (k * 43200 + {DAY}) SECONDS AS ts FROM (SELECT *, CAST(floor(epoch_us(ts) / 43200000000.0) AS BIGINT) - j AS k FROM ticks, range(0, 2) AS r(j) WHERE px IS NOT NULL))"))
def _(spark, sf):
    return asof.sliding(ticks(spark, sf), DAY, DAY // 2)


@query("sort_store", f"WITH {TICKS_SQL} SELECT sym, idx, ts, ttf, CAST(px AS DOUBLE) AS px, CAST(sz AS DOUBLE) AS sz, seq FROM ticks")
def _(spark, sf):
    at = f"{shared_folder(spark, 'store')}/ticks"
    ticks(spark, sf).repartition(8, F.pmod(F.hash("seq"), F.lit(3)), F.date_trunc("week", "ts")).write.parquet(at)
    planned_sort.sort_store(spark, at)
    return spark.read.parquet(at).select("sym", "idx", "ts", "ttf", "px", "sz", "seq")


_LEAPS = ", ".join(f"({s}, {10 + k})" for k, s in enumerate(times.LEAP_SECONDS))


@query("leap_seconds", f"WITH leaps(since, tai) AS (VALUES {_LEAPS}), o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) - o_orderkey % 3 AS sec FROM orders), t AS (SELECT o_orderkey, sec, sec + (SELECT coalesce(max(tai), 9) FROM leaps WHERE since <= sec) AS tai FROM o) SELECT o_orderkey, sec, tai, tai - 19 - 315964800 AS gps, sec AS back, false AS leap FROM t")
def _(spark, sf):
    sec = times.seconds(F.col("o_orderdate").cast("timestamp_ntz")) - F.col("o_orderkey") % 3
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", sec.cast("bigint").alias("sec"))
    rows = rows.withColumn("tai", times.to_tai(F.col("sec")).cast("bigint"))
    return rows.select("o_orderkey", "sec", "tai", times.to_gps(F.col("sec")).cast("bigint").alias("gps"), times.from_tai(F.col("tai")).cast("bigint").alias("back"), times.is_leap(F.col("tai")).alias("leap"))


SIX = "translate(lpad(substr(sym, 2), 6, '0'), '0123456789', 'ABCDEFGHIJ')"


def six_letters() -> Column:
    """Symbols as the paths of binary feeds have them."""
    return F.translate(F.lpad(F.substring("sym", 2, 9), 6, "0"), "0123456789", "ABCDEFGHIJ")


def hour_path(hour: Column, kind: str) -> Column:
    return F.concat_ws("/", six_letters(), F.date_format(hour, "yyyy"), F.lpad((F.month(hour) - 1).cast("string"), 2, "0"), F.date_format(hour, "dd"), F.concat(F.date_format(hour, "HH"), F.lit(f"h_{kind}.bi5")))


def _quote_files(batches):
    """Files of quotes that come in order of paths, stamps and arrival; a file may go on in the next batch."""
    import numpy as np
    import pandas as pd

    last, pieces = None, []
    for part in batches:
        records = np.zeros(len(part), binary.QUOTE)
        for c in ("ms", "bid", "ask"):
            records[c] = part[c]
        records["bq"] = records["aq"] = part["millions"]
        path, data, width = part["path"].to_numpy(), records.tobytes(), binary.QUOTE.itemsize
        bounds = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(part)]
        done = []
        for start, end in pairwise(bounds if len(part) else ()):
            if pieces and path[start] != last:
                done.append((last, b"".join(pieces)))
                pieces = []
            last = path[start]
            pieces.append(data[start * width : end * width])
        yield pd.DataFrame(done, columns=["path", "content"])
    if pieces:
        yield pd.DataFrame({"path": [last], "content": [b"".join(pieces)]})


@query("source_dukas", f"WITH {PAIRS_SQL} SELECT {SIX} AS sym, {MS} AS ts, 1 AS ttf, CAST(bp AS DOUBLE) AS px, CAST(t.sz AS DOUBLE) AS sz FROM pairs JOIN (SELECT seq, sz FROM ticks) t USING (seq) UNION ALL SELECT {SIX}, {MS}, 2, CAST(ap AS DOUBLE), CAST(t.sz AS DOUBLE) FROM pairs JOIN (SELECT seq, sz FROM ticks) t USING (seq)")
def _(spark, sf):
    points = lambda c: (c * 100_000).cast("bigint")
    hour = F.date_trunc("hour", "ts")
    ms = ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(hour.cast("timestamp"))) / 1000).cast("bigint")
    t = ticks(spark, sf)
    rows = t.select(hour_path(hour, "ticks").alias("path"), ms.alias("ms"), points(F.col("px")).alias("bid"), points((F.col("px") + F.col("sz") / 100).cast("decimal(18,4)")).alias("ask"), (F.col("sz").cast("double") / 1_000_000).alias("millions"), "seq")
    files = rows.repartition("path").sortWithinPartitions("path", "ms", "seq").mapInPandas(_quote_files, "path string, content binary")
    return binary.quotes(spark, files, every=True).select("sym", "ts", "ttf", "px", "sz")


def _bar_file(batches):
    import numpy as np
    import pandas as pd

    for part in batches:
        records = np.zeros(len(part), binary.BAR)
        for c in "oclh":
            records[c] = part[c]
        yield pd.DataFrame({"path": part["path"], "content": [r.tobytes() for r in records]})


@query("source_dukas_bars", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT {SIX} AS sym, ts, sta_ts, CAST(o AS DOUBLE) AS o, CAST(h AS DOUBLE) AS h, CAST(l AS DOUBLE) AS l, CAST(c AS DOUBLE) AS c FROM k WHERE side = 1")
def _(spark, sf):
    k = C.candles(ticks(spark, sf), DAY, sides=(1,))
    rows = k.select(hour_path(F.col("sta_ts"), "bars").alias("path"), *((F.col(c) * 100_000).cast("bigint").alias(c) for c in "ohlc"))
    return binary.bars(spark, rows.mapInPandas(_bar_file, "path string, content binary")).select("sym", "ts", "sta_ts", "o", "h", "l", "c")


@query("source_ibhist", f"WITH {TICKS_SQL}, {candle_cte('k', 'ticks', DAY)} SELECT sym, side, ts, sta_ts, CAST(o AS DOUBLE) AS o, CAST(h AS DOUBLE) AS h, CAST(l AS DOUBLE) AS l, CAST(c AS DOUBLE) AS c FROM k")
def _(spark, sf):
    k = C.candles(ticks(spark, sf), DAY)
    side = F.element_at(F.array(F.lit("BID"), F.lit("ASK"), F.lit("TRADES")), F.col("side"))
    second = F.floor(F.unix_micros(F.col("sta_ts").cast("timestamp")) / 1_000_000).cast("string")
    attr = lambda n, c: F.concat(F.lit(f' {n}="'), c.cast("string"), F.lit('"'))
    doc = F.concat(F.lit("<r><query"), attr("whatToShow", side), F.lit(' barSizeSetting="1 day"/><reqContract'), attr("symbol", F.col("sym")), F.lit("/><row"), attr("date", second), *(attr(n, F.col(n[0])) for n in ("open", "high", "low", "close")), F.lit("/></r>"))
    at = f"{shared_folder(spark, 'history')}/docs"
    k.select(doc.alias("value")).write.option("lineSep", "\f").text(at)
    return xml.history(spark, at).select("sym", (F.col("ttf") - 16).alias("side"), "ts", "sta_ts", "o", "h", "l", "c")


@query("calendar", "SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS INTEGER) AS yday, dayofyear(make_date(year(o_orderdate), 12, 31)) = 366 AS leap, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400) AS ts FROM orders")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("o_orderkey") % 86_400)
    return rows.select("o_orderkey", times.day_of_year(F.col("o_orderdate")).alias("yday"), times.is_leap_year(F.col("o_orderdate")).alias("leap"), times.parse_as(F.date_format(at, "d-M-yyyy H:m:s"), "%d-%m-%Y %H:%M:%S").alias("ts"))
