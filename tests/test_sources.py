import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickspark import sinks, sources
from tickspark.operators import dictionary, shape
from tickspark.sources import binary, xml


def frame(spark, lines):
    return spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq long")


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("seq", "ttf").select(*cols).collect()]


def test_tick_text_and_bad_lines(spark):
    lines = ["AB\t2011-03-01T10:00:02.766+00:00\t0001\t01\t77.0560\t1500000", "AB\t2011-03-01\t?\t02\t77.06\t75", "nonsense", "AB\t2011-03-01T10:30:00Z\t1\t11\t4\t1\t2\t3\t00000708|c30m\t00000005|5", ""]
    src = frame(spark, lines)
    out = sources.TEXT["ticktext"](src)
    got = out.orderBy("seq").collect()
    assert [r["ttf"] for r in got] == [1, 2, 0x11]
    assert (got[0]["msec"], float(got[0]["px"]), got[1]["flow"], got[1]["idx"]) == (766, 77.056, "mil24", None)
    assert (str(got[2]["sta_ts"]), got[2]["cnt"], float(got[2]["o"])) == ("2011-03-01 10:00:00", 5, 2.0)
    assert sorted(r["value"] for r in sources.bad_records(src, out).collect()) == ["", "nonsense"]
    assert "24:00:00.000+00:00" in sinks.tick_text(out).collect()[1]["value"]


HOSTILE = ["", "\t" * 9, "A\t2011-13-45T99:00:00Z\t1\t1\t1\t1", "A\t2011-03-01T10:00:00Z\tfffffffffffffffffffff\tffffffffffff\t1\t1", "A\t2011-03-01T10:00:00Z\t1\t1\t" + "9" * 60 + "\t1.2.3", "A\t2011-03-01T10:00:00Z\t1\t11\t1\t1\t1\t1\tffffffffffffffff|x\tffffffffffffffffff", "99999999999999999999.1 S b1.2.3 t9.9.9.9", "1.5 S b" + "8" * 50, "A,B,C", "a|b|c|d|f2=x|f3", "1 PRIVMSG #xxABCDEF :{bad", "A\t2011-03-01 10:00:00\tx\ty\t1\t1\t99999999999"]


@pytest.mark.parametrize("fmt", ["ticktext", "ariva", "truefx", "fxstreet", "forexfactory", "fieldlist", "rtdump"])
def test_hostile_lines_fail_nothing(spark, fmt):
    sources.TEXT[fmt](frame(spark, HOSTILE)).collect()


def test_tick_text_round_trip_of_files(spark, tmp_path):
    lines = ["AB\t2011-03-01T10:00:02.766+00:00\t1\t1\t77.0560\t1500000", "AB\t2011-03-01T10:00:03.000+00:00\t1\tc\t77.0560\t1.23450000"]
    sinks.write_text(sources.TEXT["ticktext"](frame(spark, lines)), str(tmp_path / "out"))
    back = sources.read(spark, "ticktext", str(tmp_path / "out"))
    assert sorted(r["value"] for r in sinks.tick_text(back).collect()) == sorted(lines)


PRINTED = [
    # What is read and what is printed: numbers keep the scale of their text.
    ("TESJPY\t2012-01-15T22:00:02.998+00:00\t1\t2\t77.1000\t1690000", None),
    ("A\t2011-03-01T10:00:02.000+00:00\tff\t11\t4.0000\t1\t2.5\t3.00\t4d6cc640|2011-03-01T10:11:12.000+00:00\t00000005|5", "4.00000000\t1.0000\t2.5000\t3.0000\t4d6cc640|2011-03-01T10:11:12.000+00:00\t00000005|5"),
    ("A\t2011-03-01T10:00:02.000+00:00\ta\t1c\t77.0000\t78.0000\t5.0000\t6.0000\t400bc5a0|77.1488\t40004e20|2.0", "77.0000\t78.0000\t5.0000\t6.0000\t400bc5a0|77.1488\t40004e20|2.0000"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t1\t4.9800\t4.98", "4.98000000\t4.9800"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t1\t12345678\t-12349999", "12340000\t-12340000"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t3\t93211.99\t43211.01999", "93211\t43211.0200"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t3\tmkt\t0.00", "mkt\t0"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t18\t1234.5\t1.5000\t2.5\t00000708|c30m\t0000000a|10", "1234.5000\t1.50000000\t2.5000\t4d6cbc9a|2011-03-01T09:30:02.000+00:00\t0000000a|10"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t8\t12.0210", "12.02100000"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t9\t123456789012345678901", "123456789012345670000"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\tf\t-12345678", "-12345678.0000"),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\t0\t", ""),
    ("A\t2011-03-01T10:00:02.000+00:00\t1\tc\t1.0956\t1.1", "1.09560000\t1.1000"),
]


def test_printed_numbers(spark, tmp_path):
    from tickspark.sinks import container as sink

    back = sources.TEXT["ticktext"](frame(spark, [line for line, _ in PRINTED]))
    want = [line if shown is None else "\t".join([*line.split("\t")[:4], shown]) for line, shown in PRINTED]
    assert [r["value"] for r in sinks.tick_text(back.orderBy("seq")).collect()] == want
    # The container keeps the scales too; without them the size of a number decides.
    rows = back.withColumn("idx", F.when(F.col("sym") == "A", 1).otherwise(2)).where("ttf <> 24").withColumn("sta_ts", F.when(F.col("ttf") == 17, F.col("sta_ts")))
    sink.write_container(rows, str(tmp_path / "c"))
    again = sinks.tick_text(sources.read(spark, "container", str(tmp_path / "c"))).collect()
    assert sorted(r["value"] for r in again) == sorted(r["value"] for r in sinks.tick_text(rows).collect())
    assert sinks.tick_text(back.where("seq = 3").drop("codes")).first()["value"].endswith("\t4.9800\t4.9800")


def test_summer_time_as_in_sql(spark):
    import duckdb

    from tickspark.plans.feed_queries import SUMMER

    stamps = [f"{y}-{m:02d}-{d:02d} {h:02d}:30:00" for y in (2023, 2024) for m, d in ((1, 5), (3, 25), (3, 26), (3, 27), (3, 30), (3, 31), (7, 1), (10, 26), (10, 27), (10, 28), (10, 29), (10, 30)) for h in (0, 1, 2, 3, 12)]
    lines = [f"1700000000.5\tA\t{x}\t1.5\t1.6\t1.5" for x in stamps]
    got = [r["ts"] for r in sources.TEXT["fxstreet"](frame(spark, lines)).orderBy("seq").collect()]
    want = [duckdb.sql(f"SELECT ts - CASE WHEN {SUMMER} THEN INTERVAL '2 hours' ELSE INTERVAL '1 hour' END FROM (SELECT TIMESTAMP '{x}' AS ts)").fetchall()[0][0] for x in stamps]
    assert got == want


def test_field_list_of_many_and_repeated_cells(spark):
    line = "01/03/2011|10:00:00:500|Q|SYM|f2=1.5|f2=9|" + "|".join(f"g{i}=0" for i in range(120)) + "|f7=3|f12=8"
    got = [(r["ttf"], float(r["px"]), float(r["sz"])) for r in sources.TEXT["fieldlist"](frame(spark, [line])).collect()]
    assert got == [(1, 1.5, 3.0)]


def test_field_list_of_a_hundred_thousand_cells(spark):
    long = "01/03/2011|10:00:00:500|Q|SYM|" + "|".join(f"g{i}=0" for i in range(100_000)) + "|f2=1.5|f7=3|x"
    got = [(r["seq"], r["ttf"], float(r["px"]), float(r["sz"])) for r in sources.TEXT["fieldlist"](frame(spark, [long, "|" * 100_000, "f2=1|f2=2|f2=3|f2=4|f2=5"])).collect()]
    assert got == [(0, 1, 1.5, 3.0)]


def test_ariva(spark):
    out = sources.TEXT["ariva"](frame(spark, ["1300000000.5 SYM@POT p10.5 P3 b10 B1 a11 A2 v100 V1000", "1300000001.0 SYM@POT b10.1", "1300000002.0 SYM@POT b0 B0", "1300000003.0 SYM@POT k9 P1", "bad"]))
    got = [(r["seq"], r["ttf"], None if r["px"] is None else float(r["px"]), None if r["sz"] is None else float(r["sz"])) for r in out.orderBy("seq", "ttf").collect()]
    assert got == [(0, 1, 10.0, 1.0), (0, 2, 11.0, 2.0), (0, 3, 10.5, 3.0), (0, 8, None, None), (0, 9, None, None), (1, 1, 10.1, 1.0), (2, 0, None, None), (3, 6, 9.0, 1.0)]
    assert out.where("flow = 'halt'").count() == 1


def test_binary_quotes_and_bars(spark, tmp_path):
    at = tmp_path / "EURUSD" / "2010" / "00" / "04"
    at.mkdir(parents=True)
    q = np.array([(0, 140010, 140000, 1.5, 2.0), (500, 140010, 140005, 1.5, 2.0)], binary.QUOTE)
    (at / "10h_ticks.bi5").write_bytes(q.tobytes())
    out = sources.read(spark, "dukas", str(at / "10h_ticks.bi5"))
    assert [(r["sym"], r["ttf"], float(r["px"]), float(r["sz"]), str(r["ts"])) for r in out.orderBy("ts", "ttf").collect()] == [
        ("EURUSD", 1, 1.4, 2e6, "2010-01-04 10:00:00"),
        ("EURUSD", 2, 1.4001, 1.5e6, "2010-01-04 10:00:00"),
        ("EURUSD", 1, 1.40005, 2e6, "2010-01-04 10:00:00.500000"),
    ]
    old = np.array([(1262599200000, 1.4001, 1.4, 1.0, 1.0), (1262599201000, 1.4002, 1.4, 1.0, 1.0)], binary.OLD_QUOTE)
    assert binary.quote_rows(old.tobytes(), 0)[0].tolist() == [1262599200000e3, 1262599201000e3]
    bars = np.array([(0, 100000, 100200, 99900, 100300, 1.0), (60, 100200, 100100, 100000, 100300, 1.0)], binary.BAR)
    (tmp_path / "bars").write_bytes(bars.tobytes())
    got = sources.read(spark, "dukas_bars", str(tmp_path / "bars"), flavour="a", name="X", refdate=1262599200).orderBy("ts").collect()
    assert [(r["ttf"], str(r["ts"]), float(r["o"]), float(r["h"]), float(r["vol"])) for r in got] == [(0x12, "2010-01-04 10:01:00", 1.0, 1.003, 1e6), (0x12, "2010-01-04 10:02:00", 1.002, 1.003, 1e6)]
    assert binary.human_readable(out).count() == 3


def test_many_quote_files(spark):
    """Files of either layout, packed, empty or cut off, in far fewer frames than there are files, and with the numbers that each gives alone."""
    import lzma

    from tickspark.plans.feed_queries import _quote_files

    rng = np.random.default_rng(1)
    files = {}
    for k in range(2000):
        n = int(rng.integers(0, 5))
        data = np.zeros(n, binary.QUOTE)
        for c in data.dtype.names:
            data[c] = np.sort(rng.integers(0, 3_600_000, n))
        files[f"EURUSD/2010/{k % 12:02d}/{k // 288 + 1:02d}/{k // 12 % 24:02d}h_ticks.bi5"] = data.tobytes()
    old = np.array([(1262599200000, 1.4001, 1.4, 1.0, 2.0), (1262599201000, 1.4002, 1.4, 1.0, 2.0)], binary.OLD_QUOTE).tobytes()
    paths = sorted(files)
    files[paths[3]], files[paths[5]], files[paths[7]], files[paths[9]] = old, lzma.compress(files[paths[5]]), old[:41], old[:40]
    want = []
    for p, data in files.items():
        us, bid, ask, bq, aq = binary.quote_rows(data, binary.guess(p)[1])
        want += [x for i in range(us.size) for x in ((int(us[i]), i, 1, round(bid[i], 5), round(bq[i])), (int(us[i]), i, 2, round(ask[i], 5), round(aq[i])))]
    table = spark.createDataFrame([(p, bytearray(data)) for p, data in files.items()], "path string, content binary").coalesce(1)
    got = binary.quotes(spark, table, every=True).select(F.unix_micros(F.col("ts").cast("timestamp")), "seq", "ttf", F.col("px").cast("double"), F.col("sz").cast("double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    # Files are laid from rows in order, across batches, and one by one the same.
    frame_of = lambda a, b: pd.DataFrame({"path": [f"P{i // 7}" for i in range(a, b)], "ms": range(a, b), "bid": 1, "ask": 2, "millions": 0.5})
    cut = pd.concat(_quote_files(frame_of(a, b) for a, b in ((0, 10), (10, 10), (10, 14), (14, 20), (20, 30))))
    one = pd.concat(_quote_files([frame_of(0, 30)]))
    assert cut.values.tolist() == one.values.tolist() and [len(c) for c in one["content"]] == [140, 140, 140, 140, 40]
    assert [int(np.frombuffer(c, binary.QUOTE)["ms"][0]) for c in one["content"]] == [0, 7, 14, 21, 28]


def test_quotes_of_many_small_files_take_few_frames(spark, sf):
    """A frame or a call for each file is what took the time."""
    from tickspark.plans import queries

    part = pd.DataFrame({"path": [f"EURUSD/2010/00/04/{k % 24:02d}h_{k}" for k in range(5000)], "content": [bytes(20)] * 5000})
    assert [len(f) for f in binary.quote_frames([part])] == [5000]
    large = pd.DataFrame({"path": part["path"][:5], "content": [bytes(binary.CHUNK // 2)] * 5})
    assert len(list(binary.quote_frames([large]))) < 5
    assert "FlatMapGroups" not in queries.QUERIES["source_dukas"](spark, sf)._jdf.queryExecution().toString()


def test_xml(spark, tmp_path):
    doc = '<r><query whatToShow="BID" barSizeSetting="5 mins" formatDate="1"/><reqContract symbol="ZN" secType="FUT" exchange="ECBOT"/><row date="20110301  10:00:00" open="1" high="3" low="0.5" close="2"/></r>'
    (tmp_path / "h.xml").write_text(doc + "\f<broken\f" + doc.replace("10:00:00", "10:05:00"))
    got = sources.read(spark, "ibhist", str(tmp_path / "h.xml")).orderBy("ts").collect()
    assert [(r["sym"], str(r["ts"]), str(r["sta_ts"]), float(r["h"])) for r in got] == [("ZN FUT ECBOT", "2011-03-01 09:05:00", "2011-03-01 09:00:00", 3.0), ("ZN FUT ECBOT", "2011-03-01 09:10:00", "2011-03-01 09:05:00", 3.0)]
    (tmp_path / "fx.xml").write_text("<Envelope><Cube><Cube time='2024-01-02'><Cube currency='USD' rate='1.0956'/><Cube currency='JPY' rate='155.68'/></Cube></Cube></Envelope>")
    assert xml.bar_seconds("1 hour") == 3600
    rates = sources.read(spark, "gesmes", str(tmp_path / "fx.xml")).collect()
    assert sorted((r["sym"], float(r["px"]), str(r["ts"])) for r in rates) == [("EURJPY", 155.68, "2024-01-02 23:59:59"), ("EURUSD", 1.0956, "2024-01-02 23:59:59")]


def test_large_history_files(spark, tmp_path):
    """A file of many documents goes to many tasks, in pieces; documents that a split cuts are whole, and each is there once."""
    doc = '<r><query whatToShow="BID" barSizeSetting="1 day"/><reqContract symbol="S{0}"/><row date="{1}" open="1" high="3" low="0.5" close="2"/>{2}</r>'
    n, row = 20_000, '<row date="1300000000" open="1" high="3" low="0.5" close="2"/>'
    at = tmp_path / "docs"
    at.mkdir()
    body = "\f".join(doc.format(i, 1_300_000_000 + i, row * 30_000 if i == 7 else "\n\r\n") for i in range(n)).encode()
    (at / "a.xml").write_bytes(body + b"\f" + doc.format("\xff", 1_300_000_000, "").encode("latin-1") + b"\f")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        out = sources.read(spark, "ibhist", str(at))
        assert out.rdd.getNumPartitions() > 4
        assert (out.count(), out.where("sym = 'S7'").count(), out.select("sym").distinct().count()) == (n + 30_001, 30_001, n + 1)
        assert out.where("unix_micros(cast(sta_ts as timestamp)) / 1000000 = 1300000000 + try_cast(substr(sym, 2, 9) as int)").count() == n
        assert out.orderBy("seq").first()["sym"] == "S0" and out.where("sym = 'S\ufffd'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = pd.DataFrame({"value": [doc.format(1, 2, row * 30_000).encode()] * 2})
    assert [len(f) for f in xml.history_frames([parts])] == [xml.FRAME] * 6 + [2]


def test_registry_and_dictionary(spark):
    sources.register_source("own", lambda lines: lines.withColumn("ttf", F.lit(1)))
    assert "own" in sources.TEXT
    d = spark.createDataFrame([(1, "A"), (2, "B")], "idx int, sym string")
    assert [tuple(r) for r in dictionary.replace(d, {"B": "C"}).orderBy("idx").collect()] == [(1, "A"), (2, "C")]
    assert [tuple(r) for r in dictionary.set_index(d, "B", 1).collect()] == [(1, "B")]


def test_writes(spark, tmp_path):
    t = sources.TEXT["ticktext"](frame(spark, ["A\t2011-03-01T10:00:00Z\t1\t1\t1\t1", "B\t2011-03-01T11:00:00Z\t2\t1\t1\t1"]))
    sinks.write_ticks(sinks.with_interval(t, 3600), str(tmp_path / "x"), by=("bucket",))
    sinks.write_ticks(t, str(tmp_path / "y"))
    sinks.write_ticks(t, str(tmp_path / "y"), append=True)
    assert spark.read.parquet(str(tmp_path / "x")).select("bucket").distinct().count() == 2
    assert sources.read(spark, "parquet", str(tmp_path / "y")).count() == 4


def test_png():
    assert shape.png([[None, 0.5], [1.0, 0.0]])[:8] == b"\x89PNG\r\n\x1a\n"
