"""The binary container: bytes laid by hand, round trips, and what broken or growing files give."""

import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark import sources
from tickspark.functions import decimals
from tickspark.schema import TICKS, tick_columns
from tickspark.sinks import container as sink
from tickspark.sources import cells, container


def key(order, old, sec, msec, idx, ttf):
    k = idx << 48 | ttf << 42 | msec << 32 | sec if old else sec << 32 | msec << 22 | idx << 6 | ttf
    return struct.pack(f"{order}Q", k)


def m30(mant, code):
    return code << 30 | mant & 0x3FFFFFFF


def m62(mant, code):
    return code << 62 | mant & ((1 << 62) - 1)


def by_hand(order="<", old=False):
    """One tick of each width and of numbers that a float doesn't hold."""
    word = lambda *w: struct.pack(f"{order}{len(w)}I", *w)
    k = lambda *x: key(order, old, *x)
    return [
        k(1300000000, 250, 1, 1) + word(m30(770560, 1), m30(5, 2)),
        k(1300000000, 251, 1, 2) + word(0xE0000000, m30(-123456789, 0)),
        k(1300000001, 1021, 2, 0) + word(0, 0),
        k(1300000002, 0, 2, 8) + struct.pack(f"{order}Q", m62(2305843009213693951, 0)),
        # The second cell of a candle begins with a zero word: open and close are 0.
        k(1300000060, 0, 2, 0x11) + word(m30(40000, 1), m30(10000, 1)) + word(0, 0) + word(60, 7),
        k(1300000061, 0, 2, 0x18) + struct.pack(f"{order}Q", m62(-17, 3)) + word(m30(15000, 1), m30(25000, 1)) + word(1300000000, 9),
        k(1300000062, 999, 1, 0x1C) + word(m30(1, 0), m30(2, 0), m30(3, 2), m30(4, 3), m30(-5, 1), m30(536870911, 3)),
        k(1300000063, 0, 1, 12) + word(m30(11, 1), m30(12, 1)),
    ]


def seen(df):
    columns = [c for c in TICKS.names if c not in ("seq", "codes")]
    return [tuple(r) for r in df.orderBy("ts", "msec", "idx", "ttf", "seq").select(*columns).collect()]


def file_of(pages, order="<", old=False, flags=0, names=None, footer=False, place=64):
    table = cells.symbol_table(names) if names else b""
    body, at = [], place
    for page in pages:
        body.append((at, len(page), page))
        at += len(page)
    foot = b"".join(struct.pack(f"{order}QII", a, n, n // 16) for a, n, _ in body) if footer else b""
    head = cells.Header(order, old, flags, place, len(table), len(names or ()), len(pages) if footer else 0, len(foot)).pack()
    return head.ljust(place, b"\0") + b"".join(p for *_, p in body) + table.ljust(-(-len(table) // 16) * 16, b"\0") + foot


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("order, old", [("<", False), (">", False), ("<", True), (">", True)])
def test_layouts(spark, tmp_path, order, old, whole):
    data = b"".join(by_hand(order, old)) + b"\xff" * 48
    (tmp_path / "c.ticks").write_bytes(file_of([data], order, old, names={"AB": 1, "CD": 2}))
    got = sources.read(spark, "container", str(tmp_path / "c.ticks"), whole_files=whole).orderBy("seq").collect()
    assert [(r["sym"], r["idx"], r["ttf"], r["msec"], r["flow"]) for r in got] == [("AB", 1, 1, 250, None), ("AB", 1, 2, 251, None), ("CD", 2, 0, 1021, "halt"), ("CD", 2, 8, 0, None), ("CD", 2, 0x11, 0, None), ("CD", 2, 0x18, 0, None), ("AB", 1, 0x1C, 999, None), ("AB", 1, 12, 0, None)]
    assert (got[0]["px"], got[0]["sz"], str(got[0]["ts"])) == (Decimal("77.056"), 5, "2011-03-13 07:06:40.250000")
    assert (got[1]["px"], got[1]["is_mkt"], got[1]["sz"]) == (None, True, Decimal("-1.23456789"))
    assert got[3]["w"] == Decimal("23058430092.13693951")
    assert (got[4]["h"], got[4]["l"], got[4]["o"], got[4]["c"], got[4]["cnt"], str(got[4]["sta_ts"])) == (4, 1, 0, 0, 7, "2011-03-13 07:06:40")
    assert (got[5]["w"], got[5]["vwap"], got[5]["twap"], got[5]["cnt"], str(got[5]["sta_ts"])) == (-170000, Decimal("1.5"), Decimal("2.5"), 9, "2011-03-13 07:06:40")
    assert [got[6][c] for c in ("bp", "ap", "bq", "aq", "tvpr", "tq")] == [Decimal("0.00000001"), Decimal("0.00000002"), 3, 40000, Decimal("-0.0005"), Decimal(5368709110000)]
    assert (got[7]["bp"], got[7]["ap"]) == (Decimal("0.0011"), Decimal("0.0012"))


@pytest.mark.parametrize("footer", [True, False])
@pytest.mark.parametrize("order", ["<", ">"])
def test_packed_pages(spark, tmp_path, order, footer):
    parts = by_hand(order)
    pages = [cells.pack_page(b"".join(parts[:3]), order), cells.pack_page(b"".join(parts[3:6]), order), b"".join(parts[6:])]
    (tmp_path / "c").write_bytes(file_of(pages, order, flags=cells.PACKED, names={"AB": 1, "CD": 2}, footer=footer))
    (tmp_path / "plain").write_bytes(file_of([b"".join(parts)], order, names={"AB": 1, "CD": 2}))
    df = sources.read(spark, "container", str(tmp_path / "c"))
    assert df.rdd.getNumPartitions() == 3
    assert seen(df) == seen(sources.read(spark, "container", str(tmp_path / "plain")))
    assert seen(sources.read(spark, "container", str(tmp_path / "c"), whole_files=True)) == seen(df)


def test_a_dictionary_and_no_table(spark, tmp_path):
    (tmp_path / "c").write_bytes(file_of([by_hand()[0]]))
    names = spark.createDataFrame([(1, "XY")], "idx int, sym string")
    assert sources.read(spark, "container", str(tmp_path / "c")).first()["sym"] is None
    assert sources.read(spark, "container", str(tmp_path / "c"), dictionary=names).first()["sym"] == "XY"


@pytest.mark.parametrize("data", [b"", b"x" * 100, b"UTE+v0.2??" + b"\0" * 60])
def test_what_is_no_container(spark, tmp_path, data):
    (tmp_path / "c").write_bytes(data)
    with pytest.raises(Exception, match="container|byte order"):
        sources.read(spark, "container", str(tmp_path / "c")).collect()


def test_header_only_and_cut_tick(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1").write_bytes(file_of([]))
    (tmp_path / "a" / "2").write_bytes(file_of([by_hand()[0] + by_hand()[4][:16]]))
    assert sources.read(spark, "container", str(tmp_path / "a")).count() == 1


def test_files_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 700 pages; only one has ticks, and it alone is read whole."""
    tick, at = by_hand()[0], 650 * cells.PAGE
    pages = [(64, 16, 1), (at, 32, 2)]
    foot = cells.pack_footer(pages, "<")
    head = cells.Header("<", False, cells.ORDERED, 64, 0, 0, 2, len(foot))
    with open(tmp_path / "big", "wb") as f:
        f.write(head.pack() + tick)
        f.seek(at)
        f.write(tick + by_hand()[7])
        f.seek(700 * cells.PAGE)
        f.write(foot)
    assert (tmp_path / "big").stat().st_size > 1 << 31
    assert [r["ttf"] for r in sources.read(spark, "container", str(tmp_path / "big")).orderBy("seq").collect()] == [1, 1, 12]


def test_starts_of_any_widths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        step, want, at = rng.choice([1, 2, 4], n), [], 0
        while at < n:
            want.append(at)
            at += int(step[at])
        assert cells.starts(step).tolist() == want


def test_symbol_tables():
    import random

    rng = random.Random(1)
    for n in (1, 2, 300, 3000):
        names = {}
        while len(names) < n:
            names.setdefault("".join(rng.choice("ABCxyz09@. ") for _ in range(rng.randint(1, 12))), len(names) + 1)
        assert {s: i for i, s in cells.read_symbols(cells.symbol_table(names) + b"\0" * 9).items()} == names
        # Free cells are one ring, so that symbols can be added.
        table = cells.symbol_table(names)
        arrays = np.frombuffer(table, ">i4", 2 * struct.unpack_from(">I", table, 4)[0]).reshape(-1, 2)
        at, ring = -int(arrays[1, 1]), 0
        while at != 1:
            assert arrays[-int(arrays[at, 1]), 0] == -at
            at, ring = -int(arrays[at, 1]), ring + 1
        assert ring == sum(1 for b, c in arrays[3:] if c < 0)
    for bad in ({"é": 1}, {"": 1}, {"x" * 64: 1}, {"A": 0}, {"A": 70000}):
        with pytest.raises(cells.ContainerError):
            cells.symbol_table(bad)


def test_large_symbol_tables():
    """As many symbols as an index can tell apart; places that were tried in vain are not tried again."""
    import time

    names = {f"U{i + 60_000}": i for i in range(1, cells.MOST_SYMBOLS + 1)}
    began = time.process_time()
    table = cells.symbol_table(names)
    assert time.process_time() - began < 30
    assert len(table) < 40 * len(names)
    assert {s: i for i, s in cells.read_symbols(table).items()} == names


@pytest.mark.parametrize("options", [{}, {"order": "big", "packed": True, "pages": 1}])
def test_more_indices_than_a_file_can_tell_apart(spark, tmp_path, options):
    n = 140_000
    # Indices of three blocks and one far beyond, a tick without any, and symbols of four fifths of them.
    index = F.when(F.col("seq") == 5, 2_147_483_647).when(F.col("seq") != 6, F.col("seq") * 7919 % n + 1).cast("int")
    ticks = many(spark, n).withColumn("idx", index).withColumn("sym", F.when(F.col("idx") % 5 != 0, F.concat(F.lit("S"), F.col("idx").cast("string"))))
    sink.write_container(ticks, str(tmp_path / "c"), **options)
    want = ticks.withColumn("idx", F.coalesce("idx", F.lit(0)))
    back = sources.read(spark, "container", str(tmp_path / "c"))
    compared = [c for c in TICKS.names if c not in ("seq", "codes")]
    assert back.select(*compared).exceptAll(want.select(*compared)).count() == 0 and back.count() == n
    assert sources.read(spark, "container", str(tmp_path / "c"), whole_files=True).select(*compared).exceptAll(want.select(*compared)).count() == 0
    bases = {container.header_of(f)[0].base for f in container.files_of(str(tmp_path / "c"))}
    assert bases == {0, 65_535, 131_070, 2_147_483_647 // 65_535 * 65_535}
    # Within a file ticks are in order, and of one block.
    for f in container.files_of(str(tmp_path / "c"))[:3]:
        for page in container.pages_of(f):
            t = cells.decode_page(cells.unpack_page(container.read_range(f, *page)), container.header_of(f)[0].order)
            assert (np.diff(t["sec"] * 1000 + t["msec"]) >= 0).all()
    names = spark.createDataFrame([(70_001, "XY")], "idx int, sym string")
    assert sources.read(spark, "container", str(tmp_path / "c"), dictionary=names).where("sym = 'XY'").select("idx").distinct().collect() == [(70_001,)]


def test_indices_of_one_file(spark, tmp_path):
    """A single file has one block of indices; more are refused, and nothing is left."""
    ticks = many(spark, 200)
    higher = ticks.withColumn("idx", F.col("idx") + 70_000)
    sink.write_single(higher, str(tmp_path / "one"))
    assert seen(sources.read(spark, "container", str(tmp_path / "one"))) == seen(higher)
    two = ticks.withColumn("idx", F.when(F.col("sym") == "S1", F.col("idx")).otherwise(F.col("idx") + 70_000))
    with pytest.raises(cells.ContainerError, match="several blocks"):
        sink.write_single(two, str(tmp_path / "two"))
    with pytest.raises(Exception, match="an index that isn't"):
        sink.write_container(ticks.withColumns({"idx": F.lit(-1), "sym": F.lit("A")}), str(tmp_path / "three"))
    assert sorted(p.name for p in tmp_path.iterdir() if p.name != "three" or list(p.iterdir())) == ["one"]


def test_words(spark):
    values = [None, "0", "77.056", "-77.056", "4.32117", "-5.36870911", "53687.0911", "53687.0912", "536870911", "-5368709110000", "0.00000001", "12345678", "5.368709115", "43211.01"]
    df = spark.createDataFrame([(None if v is None else Decimal(v),) for v in values], "v decimal(21,8)")
    got = [r[0] for r in df.select(decimals.narrow_value(decimals.narrow_word(F.col("v")))).collect()]
    assert got == [0, 0, *map(Decimal, ("77.056", "-77.056", "4.32117", "-5.36870911", "53687.0911", "53687", "536870911", "-5368709110000", "0.00000001", "12345678", "5.3687", "43211.01"))]
    wide = ["23058430092.13693951", "-230584300921369.3951", "2305843009213693951", "-23058430092136939510000", "0.5"]
    df = spark.createDataFrame([(Decimal(v),) for v in wide], "v decimal(31,8)")
    assert [r[0] for r in df.select(decimals.wide_value(decimals.wide_word(F.col("v")))).collect()] == list(map(Decimal, wide))
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(Decimal("5368709120000"),)], "v decimal(21,8)").select(decimals.narrow_word(F.col("v"))).collect()


def many(spark, n):
    i = F.col("id")
    ttf = F.when(i % 7 == 0, 0x11).when(i % 7 == 1, 0x1C).when(i % 11 == 2, 8).when(i % 11 == 3, 12).otherwise(1 + i % 3)
    number = lambda k: ((i * k) % 100_003 + 1).cast("decimal(21,8)") / 10_000
    point, candle, snap = ttf.isin(1, 2, 3), ttf == 0x11, ttf == 0x1C
    when = F.when
    ts = F.timestamp_micros(F.lit(1_300_000_000_000_000) + i * 250_000).cast("timestamp_ntz")
    row = tick_columns(
        sym=F.concat(F.lit("S"), (i % 50).cast("string")), idx=i % 50 + 1, ts=ts, msec=(i * 250) % 1000, ttf=ttf, px=when(point, number(3)), sz=when(point, number(5)), is_mkt=F.lit(False), w=when(ttf == 8, number(7)), bp=when(snap | (ttf == 12), number(2)), ap=when(snap | (ttf == 12), number(9)),
        **{c: when(snap, number(k)) for k, c in enumerate(("bq", "aq", "tvpr", "tq"), 11)}, **{c: when(candle, number(k)) for k, c in enumerate("hloc", 21)}, sta_ts=when(candle, F.lit("2011-03-01 00:00:00").cast("timestamp_ntz")), cnt=when(candle, i), seq=i,
    )
    return spark.range(n).select(*row)


@pytest.mark.parametrize("options", [{}, {"order": "big"}, {"packed": True}, {"pages": 1}])
def test_folder_round_trip(spark, tmp_path, options):
    ticks = many(spark, 3000)
    sink.write_container(ticks, str(tmp_path / "c"), **options)
    back = sources.read(spark, "container", str(tmp_path / "c"))
    assert seen(back) == seen(ticks)
    sink.write_container(many(spark, 10), str(tmp_path / "c"), append=True)
    assert back.count() + 10 == sources.read(spark, "container", str(tmp_path / "c")).count()
    sink.write_container(many(spark, 10), str(tmp_path / "c"))
    assert sources.read(spark, "container", str(tmp_path / "c")).count() == 10


def test_pages_and_files_roll(spark, tmp_path):
    n = 600_000
    ticks = spark.range(0, n, 1, 1).select(*tick_columns(sym=F.lit("A"), idx=F.lit(1), ts=F.timestamp_micros(F.lit(1_300_000_000_000_000) + F.col("id") * 1000).cast("timestamp_ntz"), msec=F.col("id") % 1000, ttf=F.when(F.col("id") % 2 == 0, 3).otherwise(0x11), px=F.when(F.col("id") % 2 == 0, 1), seq=F.col("id"))).coalesce(1)
    sink.write_container(ticks, str(tmp_path / "c"), pages=2)
    for f in container.files_of(str(tmp_path / "c")):
        for k, (offset, length) in enumerate(container.pages_of(f)):
            assert offset == (k * cells.PAGE or 64) and length <= cells.PAGE_CELLS * 16
    back = sources.read(spark, "container", str(tmp_path / "c"))
    assert (back.count(), back.select("ts").distinct().count()) == (n, n)
    sink.write_single(ticks, str(tmp_path / "one"))
    assert [p[0] for p in container.pages_of(str(tmp_path / "one"))] == [64, cells.PAGE, 2 * cells.PAGE, 3 * cells.PAGE][: len(container.pages_of(str(tmp_path / "one")))]
    one = sources.read(spark, "container", str(tmp_path / "one"))
    assert one.count() == n and one.rdd.getNumPartitions() == len(container.pages_of(str(tmp_path / "one")))
    assert seen(one.where("ts < '2011-03-13 07:06:41'")) == seen(back.where("ts < '2011-03-13 07:06:41'"))
    # Without its footer the file gives the same pages, by their span.
    raw = (tmp_path / "one").read_bytes()
    header = cells.read_header(raw)
    bare = cells.Header(header.order, False, header.flags, 64, header.table, header.symbols, 0, 0)
    (tmp_path / "bare").write_bytes(bare.pack() + raw[64 : cells.footer_at(header, len(raw))])
    assert [p[0] for p in container.pages_of(str(tmp_path / "bare"))] == [p[0] for p in container.pages_of(str(tmp_path / "one"))]
    assert sources.read(spark, "container", str(tmp_path / "bare")).where("sym = 'A'").count() == n


@pytest.mark.parametrize("packed", [False, True])
def test_single_file(spark, tmp_path, packed):
    ticks = many(spark, 2000)
    sink.write_single(ticks, str(tmp_path / "one"), order="big", packed=packed)
    assert seen(sources.read(spark, "container", str(tmp_path / "one"))) == seen(ticks)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one"]
    sink.write_single(ticks.limit(0), str(tmp_path / "none"))
    assert sources.read(spark, "container", str(tmp_path / "none")).count() == 0


def test_pages_outside_a_range_are_left_out(spark, tmp_path):
    ticks = many(spark, 3000)
    sink.write_container(ticks.repartition(4), str(tmp_path / "c"))
    first, last = 1_300_000_000, 1_300_000_000 + 3000 // 4
    sink.write_single(ticks, str(tmp_path / "one"))
    df = sources.read(spark, "container", str(tmp_path / "one"), start=first + 700, end=last)
    assert df.where("unix_micros(cast(ts as timestamp)) >= 1300000700000000").count() == ticks.where("unix_micros(cast(ts as timestamp)) >= 1300000700000000").count()
    pages = [container.Page(str(tmp_path / "one"), *p, 0) for p in container.pages_of(str(tmp_path / "one"))]
    kept = container._Reader._between(pages, str(first + 700), None)
    assert 0 < len(kept) < len(pages) or len(pages) == 1


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    bad = many(spark, 500).withColumn("px", F.when(F.col("seq") == 400, F.lit("5368709120000").cast("decimal(21,8)")).otherwise(F.col("px"))).withColumn("ttf", F.when(F.col("seq") == 400, 1).otherwise(F.col("ttf")))
    with pytest.raises(Exception, match="out of range"):
        sink.write_container(bad, str(tmp_path / "c"))
    assert not (tmp_path / "c").exists() or list((tmp_path / "c").iterdir()) == []
    two = many(spark, 200).withColumn("idx", F.lit(1))
    with pytest.raises(Exception, match="several symbols"):
        sink.write_container(two, str(tmp_path / "d"))
    assert not (tmp_path / "d").exists() or list((tmp_path / "d").iterdir()) == []


def test_a_growing_file_as_a_stream(spark, tmp_path):
    parts, path = by_hand(), tmp_path / "live"
    grown = b""

    def write(n, cut=0):
        nonlocal grown
        grown = b"".join(parts[:n])
        path.write_bytes(file_of([(grown + parts[n][:cut] if cut else grown).ljust(4096, b"\0")], flags=cells.GROWING, names={"AB": 1, "CD": 2}))

    def step():
        q = container.stream(spark, str(path)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    write(2)
    assert step().count() == 2
    write(4, cut=16)  # the first cell of a candle: not a tick yet
    assert step().count() == 4
    assert step().count() == 4
    write(8)
    got = step()
    (tmp_path / "all").write_bytes(file_of([b"".join(parts)], names={"AB": 1, "CD": 2}))
    assert seen(got) == seen(sources.read(spark, "container", str(tmp_path / "all")))


@pytest.mark.parametrize("name", ["container_candles", "container_stream", "container_ticks"])
def test_queries_with_large_indices(spark, tmp_path, sf, name):
    """Users of three blocks of indices, against the query's SQL."""
    import duckdb

    from tickspark.plans import queries

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (user_id * 9973 AS user_id) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert con.sql("SELECT max(user_id) > 131070 FROM events").fetchall()[0][0]
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
