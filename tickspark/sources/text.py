"""Line formats.  Each parser takes (value, seq) and stays within built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.decimals import narrow_parts, number_text, wide_parts
from tickspark.functions.text import cell, hex_to_int, json_value
from tickspark.functions.times import from_seconds, is_date_only, parse_iso, to_utc
from tickspark.operators import clean
from tickspark.schema import ASK, AUC, BID, FIX, HALT, MIL24, OI, PAIR, SNAPSHOT, TRA, VOL, VOL_CANDLE, VPR, WIDE_CODE, flow_of, tick_columns

#: Types of one wide number.
WIDE = (VOL, VPR, 10, OI, 15, VOL_CANDLE)


def _number(s: Column) -> Column:
    text = number_text(s)
    return F.when(text.rlike("[0-9]"), text.try_cast("decimal(31,8)"))


def _epoch(s: Column) -> Column:
    """``SEC.NSEC`` as a stamp; nanoseconds beyond the microsecond are cut."""
    sec, nano = F.regexp_extract(s, r"^([0-9]{1,11})(?![0-9])", 1), F.regexp_extract(s, r"^[0-9]+\.([0-9]+)", 1)
    us = F.substring(F.rpad(nano, 9, "0"), 1, 6)
    return F.when(sec != "", F.timestamp_micros(sec.cast("bigint") * 1_000_000 + F.coalesce(us.try_cast("bigint"), F.lit(0))).cast("timestamp_ntz"))


def _millis(ts: Column) -> Column:
    return (F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) / 1000).cast("int")


def tick_text(lines: DataFrame) -> DataFrame:
    """Tab-separated ticks: symbol, stamp, index (hex or ?), type (hex), and the payload of the type.

    Point ticks have price and size; single-number types one wide number; pairs
    bid and ask; snapshots bid, ask, their sizes, trade price and size (``hex|number`` or plain); candles
    h, l, o, c, start (``hex|iso`` or ``hex|cNNu``) and count (hex); a volume
    candle its volume for h and l.  Numbers take the scale that their text says,
    and codes keeps it.
    """
    # Numbers are parsed by a function over their fields: once in the code, however many there are.
    rows = lines.select("seq", F.split("value", "\t").alias("p"))
    rows = rows.select("seq", *(F.get("p", F.lit(i)).alias(f"f{i}") for i in (0, 1, 2, 3, 4, 7, 8, 9)), F.slice("p", 5, 6).alias("numbers"))
    rows = rows.withColumns({"at": parse_iso(F.col("f1")), "type": hex_to_int(F.col("f3")).try_cast("int"), "from": hex_to_int(F.col("f8"))}).where("at is not null and type is not null")
    rows = rows.withColumn("numbers", F.transform("numbers", lambda x: narrow_parts(F.regexp_replace(x, r"^[0-9A-Fa-f]+\|", ""))))
    rows = rows.withColumn("wide", F.when(F.col("type").isin(*WIDE), wide_parts(F.col("f4"))))
    field = lambda i: F.col(f"f{i}")
    ttf, ts, stamp, start = F.col("type"), F.col("at"), field(1), F.col("from")
    number = lambda i: F.get("numbers", F.lit(i - 4))["v"]
    when = lambda cond, c: F.when(cond, c)
    candle, volume, snap, pair = (ttf >= 0x11) & (ttf <= 0x16), ttf == VOL_CANDLE, ttf == SNAPSHOT, ttf == PAIR
    point = ttf.isin(1, 2, 3, 4, 5, 6, 7, 13, 14)
    sta = F.when(start < 100_000, ts - F.make_dt_interval(secs=start)).when(start.isNotNull(), from_seconds(F.when(start < 1 << 33, start)))
    sta = sta.otherwise(parse_iso(F.get(F.split(field(8), r"\|"), F.lit(1))))
    # A volume candle has one wide number where others have high and low, so all behind it stand one field before.
    early = hex_to_int(field(7))
    early = F.when(early < 100_000, ts - F.make_dt_interval(secs=early)).otherwise(from_seconds(F.when(early < 1 << 33, early)))
    msec = F.when(is_date_only(stamp), MIL24).otherwise(_millis(ts)).cast("int")
    index = F.when(field(2) == "?", None).otherwise(hex_to_int(field(2)).try_cast("int"))
    many = F.when(candle | snap, 6).when(pair | point, 2).when(volume, 3).otherwise(0)
    # Of a number that isn't there the code is 0.
    codes = F.aggregate(F.slice("numbers", 1, many), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("at")), lambda acc, x: F.struct((acc["sum"] + F.call_function("shiftleft", F.coalesce(x["code"], F.lit(0)).cast("bigint"), acc["at"])).alias("sum"), (acc["at"] + 2).alias("at")), lambda acc: acc["sum"])
    codes = codes + F.coalesce(F.shiftleft(F.col("wide.code").cast("bigint"), WIDE_CODE), F.lit(0))
    return rows.select(
        *tick_columns(
            sym=F.when(field(0) != "", field(0)), idx=index, ts=ts, msec=msec, flow=flow_of(msec), ttf=ttf,
            px=when(point, number(4)), sz=when(point, number(5)), is_mkt=field(4) == "mkt", w=F.col("wide.v"),
            bp=when(pair | snap, number(4)), ap=when(pair | snap, number(5)), bq=when(snap, number(6)), aq=when(snap, number(7)), tvpr=when(snap, number(8)), tq=when(snap, number(9)),
            h=when(candle, number(4)), l=when(candle, number(5)), o=when(candle, number(6)), c=when(candle, number(7)), vwap=when(volume, number(5)), twap=when(volume, number(6)),
            sta_ts=F.when(candle, sta).when(volume, early), cnt=F.when(candle, hex_to_int(field(9))).when(volume, hex_to_int(field(8))), codes=codes, seq=F.col("seq"),
        )
    )


def ariva(lines: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """``SEC.NSEC SYM kVAL ...`` with keys p P trade, b B bid, a A ask, k auction (each price, size), v volume, V value, t T stamps.

    One line gives up to six ticks, or a halt if a quote is zero.  A price or
    size that is missing comes from the last tick of the symbol and type; stamps
    within the line are local to zone, the one in front is UTC.
    """
    line = F.col("value")
    get = lambda k: _number(cell(line, k))
    head = F.regexp_extract(line, r"^([0-9]+\.?[0-9]*)\s+(\S+)", 1)
    clock = cell(line, "t")
    own = to_utc(from_seconds(clock.try_cast("decimal(17,6)")), zone)
    rows = lines.select("seq", _epoch(head).alias("got"), F.regexp_extract(line, r"^([0-9]+\.?[0-9]*)\s+(\S+)", 2).alias("sym"), F.when(clock.try_cast("double") > 0, own).alias("own"), *(get(k).alias(f"k_{i}") for i, k in enumerate("pPbBaAkvV")))
    rows = rows.where("got is not null and sym <> ''").withColumn("ts", F.coalesce("own", "got"))
    p, ps, b, bs, a, as_, k, v, w = (F.col(f"k_{i}") for i in range(9))
    halted = (b == 0) | (a == 0) | ((bs == 0) & (as_ == 0))
    none = F.lit(None).cast("decimal(31,8)")

    def tick(cond: Column, ttf: int, px: Column, sz: Column, wide: Column = none) -> Column:
        return F.when(cond, F.struct(F.lit(ttf).alias("ttf"), px.alias("px"), sz.alias("sz"), wide.alias("w")))

    halt = F.coalesce(halted, F.lit(False))
    every = F.array(
        tick(halt, 0, none, none),
        tick(~halt & k.isNull() & (p.isNotNull() | ps.isNotNull()), TRA, p, ps),
        tick(~halt & (b.isNotNull() | bs.isNotNull()), BID, b, bs),
        tick(~halt & (a.isNotNull() | as_.isNotNull()), ASK, a, as_),
        tick(~halt & k.isNotNull(), AUC, k, ps),
        tick(~halt & v.isNotNull(), VOL, none, none, v),
        tick(~halt & w.isNotNull(), VPR, none, none, w),
    )
    ticks = rows.select("sym", "ts", "seq", F.posexplode(F.filter(every, lambda x: x.isNotNull())).alias("_n", "t")).select("sym", "ts", (F.col("seq") * 8 + F.col("_n")).alias("seq"), "t.*")
    ticks = clean.fill_missing(ticks)
    msec = F.when(F.col("ttf") == 0, HALT).otherwise(_millis(F.col("ts")))
    return ticks.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=msec, flow=flow_of(msec), ttf=F.col("ttf"), px=F.col("px"), sz=F.col("sz"), w=F.col("w"), seq=F.floor(F.col("seq") / 8)))


def truefx(lines: DataFrame, every: bool = False) -> DataFrame:
    """``SYM,YYYYMMDD HH:MM:SS.mmm,bid,ask``; a side only where it changes, unless every."""
    p = F.split("value", ",")
    ts = F.try_to_timestamp(F.get(p, F.lit(1)), F.lit("yyyyMMdd HH:mm:ss.SSS")).cast("timestamp_ntz")
    sides = F.array(*[F.struct(F.lit(t).alias("ttf"), _number(F.get(p, F.lit(i))).alias("px")) for t, i in ((BID, 2), (ASK, 3))])
    rows = lines.select(F.get(p, F.lit(0)).alias("sym"), ts.alias("ts"), "seq", F.inline(sides)).where("ts is not null and px is not null")
    rows = rows if every else clean.drop_repeats(rows, ("px",))
    return rows.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=_millis(F.col("ts")), ttf=F.col("ttf"), px=F.col("px"), sz=F.lit(0), seq=F.col("seq")))


def fxstreet(lines: DataFrame, zone: str = "CET") -> DataFrame:
    """``SEC.NSEC<TAB>SYM<TAB>Y-m-d H:M:S<TAB>bid<TAB>ask<TAB>trade`` with a local stamp, as snapshots."""
    p = F.split("value", "\t")
    field = lambda i: F.get(p, F.lit(i))
    ts = to_utc(F.try_to_timestamp(field(2), F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz"), zone)
    rows = lines.select(F.trim(field(1)).alias("sym"), ts.alias("ts"), _number(field(3)).alias("bp"), _number(field(4)).alias("ap"), _number(field(5)).alias("tvpr"), "seq").where("ts is not null and (bp is not null or ap is not null)")
    return rows.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=F.lit(0), ttf=F.lit(SNAPSHOT), bp=F.col("bp"), ap=F.col("ap"), tvpr=F.col("tvpr"), seq=F.col("seq")))


def forexfactory(lines: DataFrame) -> DataFrame:
    """``SEC.NSEC ... PRIVMSG #xxABCDEF :{json}`` with platform, bid and ask, as pairs of ``ABCDEF.platform``."""
    line = F.col("value")
    json = F.regexp_extract(line, r":(\{.*\})", 1)
    pair = F.regexp_extract(line, r"PRIVMSG #..([A-Za-z]{6})", 1)
    rows = lines.select(_epoch(F.regexp_extract(line, r"^([0-9.]+)", 1)).alias("ts"), F.concat_ws(".", pair, json_value(json, "platform")).alias("sym"), pair.alias("pair"), _number(json_value(json, "bid")).alias("bp"), _number(json_value(json, "ask")).alias("ap"), "seq")
    rows = rows.where("ts is not null and pair <> '' and bp is not null and ap is not null")
    return rows.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=_millis(F.col("ts")), ttf=F.lit(PAIR), bp=F.col("bp"), ap=F.col("ap"), seq=F.col("seq")))


def field_list(lines: DataFrame) -> DataFrame:
    """``dd/mm/YYYY|HH:MM:SS:mmm|Q|SYM|f2=..|f3=..``: f2 bid, f3 ask, f6 trade, f7 f8 f9 their sizes, f16 volume, f21 open interest."""
    p = F.split("value", r"\|")
    field = lambda i: F.get(p, F.lit(i))
    ts = F.try_to_timestamp(F.concat_ws(" ", field(0), field(1)), F.lit("dd/MM/yyyy HH:mm:ss:SSS")).cast("timestamp_ntz")
    cells = F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0)))
    # Of a key that comes twice in a line the first counts.
    get = lambda k: _number(F.substring_index(F.get(F.filter(cells, lambda x: x.startswith(f"{k}=")), F.lit(0)), "=", -1))
    none = F.lit(None).cast("decimal(31,8)")
    tick = lambda t, px, sz, w=none: F.when(px.isNotNull() | sz.isNotNull() | w.isNotNull(), F.struct(F.lit(t).alias("ttf"), px.alias("px"), sz.alias("sz"), w.alias("w")))
    every = F.array(tick(BID, get("f2"), get("f7")), tick(ASK, get("f3"), get("f8")), tick(TRA, get("f6"), get("f9")), tick(VOL, none, none, get("f16")), tick(OI, none, none, get("f21")))
    rows = lines.where(F.size(p) >= 5).select(field(3).alias("sym"), ts.alias("ts"), "seq", F.inline(F.filter(every, lambda x: x.isNotNull()))).where("ts is not null")
    rows = clean.fill_missing(clean.drop_repeated_sizes(rows.where("w is null"))).unionByName(rows.where("w is not null"))
    return rows.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=_millis(F.col("ts")), ttf=F.col("ttf"), px=F.col("px"), sz=F.col("sz"), w=F.col("w"), seq=F.col("seq")))


def rt_dump(lines: DataFrame) -> DataFrame:
    r"""Tab-separated SYM, stamp, ms, sequence, price, size, type (1 bid, 2 ask, 3 trade, 8 volume), ``\N`` for null."""
    p = F.split("value", "\t")
    field = lambda i: F.when(F.get(p, F.lit(i)) != r"\N", F.get(p, F.lit(i)))
    ts = F.try_to_timestamp(field(1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") + F.make_dt_interval(secs=F.coalesce(field(2).try_cast("int"), F.lit(0)) / 1000)
    ttf = field(6).try_cast("int")
    rows = lines.select(field(0).alias("sym"), ts.alias("ts"), "seq", ttf.alias("ttf"), _number(field(4)).alias("px"), _number(field(5)).alias("sz")).where("ts is not null and ttf in (1, 2, 3, 8)")
    rows = clean.fill_missing(rows)
    volume = F.col("ttf") == VOL
    return rows.select(*tick_columns(sym=F.col("sym"), ts=F.col("ts"), msec=_millis(F.col("ts")), ttf=F.col("ttf"), px=F.when(~volume, F.col("px")), sz=F.when(~volume, F.col("sz")), w=F.when(volume, F.col("sz")), seq=F.col("seq")))


def fixings(rows: DataFrame) -> DataFrame:
    """(day, currency, rate) as fixing ticks at the end of the day."""
    ts = F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 86399 SECONDS")
    return rows.select(*tick_columns(sym=F.concat(F.lit("EUR"), F.col("currency")), ts=ts, msec=F.lit(MIL24), flow=F.lit("mil24"), ttf=F.lit(FIX), px=F.col("rate"), sz=F.lit(0), seq=F.monotonically_increasing_id()))


def first_of_symbol(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("sym").orderBy("ts", "seq"))).where("_n = 1").drop("_n")
