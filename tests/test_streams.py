"""Streams: what comes late, what comes twice, halts, and joins and sessions as their batch forms."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tickspark import streaming
from tickspark.operators import asof, candles, snapshots

TICK = "sym string, idx int, ts timestamp_ntz, ttf int, px decimal(18,4), sz decimal(18,4), seq long"
START = dt.datetime(2024, 1, 1)
D = Decimal


def tick(seq, minutes, ttf=1, px=1, sz=1, sym="A"):
    return (sym, 1, START + dt.timedelta(minutes=minutes), ttf, None if px is None else D(px), None if sz is None else D(sz), seq)


class Feed:
    """A folder that gets files, and the stream over it."""

    def __init__(self, spark, path, schema=TICK):
        self.spark, self.path, self.schema = spark, str(path / "feed"), schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self):
        return streaming.read_ticks(self.spark, self.path, self.spark.createDataFrame([], self.schema).schema, files_per_trigger=1)

    def every(self):
        return self.spark.read.parquet(self.path)


def same(a, b):
    assert sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_late_ticks_change_stored_candles(spark, tmp_path):
    feed, at = Feed(spark, tmp_path), str(tmp_path / "kept")
    length = 3600
    run = lambda: streaming.maintain(feed.read(), lambda t: candles.candles(t, length), at, length)
    feed.add([tick(1, 5), tick(2, 30, px=3), tick(3, 60 * 24 * 3)])
    run()
    same(streaming.maintained(spark, at), candles.candles(feed.every(), length))
    feed.add([tick(4, 60 * 24 * 4), tick(5, 70, sym="B")])
    run()
    # Three days late: an earlier open, and a symbol that wasn't there.
    feed.add([tick(6, 1, px=9), tick(7, 2, sym="C"), tick(8, 60 * 24 - 1)])
    run()
    got = streaming.maintained(spark, at)
    same(got, candles.candles(feed.every(), length))
    assert got.where("sym = 'A' and ts = '2024-01-01 01:00:00'").first()["o"] == 9


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    import shutil

    feed, at = Feed(spark, tmp_path), tmp_path / "kept"
    run = lambda: streaming.maintain(feed.read(), lambda t: snapshots.snapshots(t, 300), str(at), 300)
    feed.add([tick(1, 5, 3), tick(2, 6, 3, px=5)])
    feed.add([tick(3, 7, 2)])
    run()
    want = sorted(map(tuple, streaming.maintained(spark, str(at)).collect()), key=repr)
    # As after a crash between the last batch's writes and its commit.
    commits = sorted((at / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (at / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    run()
    assert sorted(map(tuple, streaming.maintained(spark, str(at)).collect()), key=repr) == want
    same(streaming.maintained(spark, str(at)), snapshots.snapshots(feed.every(), 300))
    shutil.rmtree(at / "result")


def test_clean_up_keeps_state_and_forgets_at_halts(spark, tmp_path):
    schema = TICK + ", flow string"
    feed = Feed(spark, tmp_path, schema)
    row = lambda *a, flow=None, **k: (*tick(*a, **k), flow)

    def run():
        streaming.run_to_parquet(streaming.stream_clean(feed.read()), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted((r["seq"], r["px"], r["sz"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    feed.add([row(1, 1, px=5), row(2, 2, px=None, sz=2), row(3, 3, px=5, sz=2), row(4, 3, ttf=2, px=8), row(5, 4, px=None, sz=None)])
    assert run() == [(1, 5, 1), (2, 5, 2), (4, 8, 1)]
    # Held over batches, and a second symbol of its own.
    feed.add([row(6, 5, px=5, sz=2), row(7, 6, px=6, sz=None), row(8, 7, ttf=2, px=8), row(9, 7, sym="B", px=None, sz=3)])
    assert run()[3:] == [(7, 6, 2), (9, None, 3)]
    # A halt forgets: the same price comes again, and a size alone has none.
    feed.add([row(10, 8, px=6, sz=2), row(11, 9, ttf=0, px=None, sz=None, flow="halt"), row(12, 10, px=6, sz=2), row(13, 11, ttf=2, px=None, sz=4)])
    assert run()[5:] == [(12, 6, 2), (13, None, 4)]
    feed.add([row(14, 12, px=6, sz=2), row(15, 13, ttf=2, px=1, sz=None)])
    assert run()[7:] == [(15, 1, 4)]


def rows_of(stream, tmp_path, spark, name):
    streaming.run_to_parquet(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"))
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_quotes_at_trades_of_streams(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([tick(1, 1, 1, 10), tick(2, 3, 3, 50), tick(3, 0, 3, 51), tick(4, 4, 3, 52, sym="B"), tick(5, 3, 1, 11)])
    feed.add([tick(6, 6, 1, 12), tick(7, 8, 3, 53), tick(8, 5, 3, 54), tick(9, 7, 1, 13, sym="B")])
    feed.add([tick(10, 600, 1, 99, sym="Z"), tick(11, 600, 3, 99, sym="Z")])
    feed.add([tick(12, 601, 1, 99, sym="Z"), tick(13, 601, 3, 99, sym="Z")])
    t = feed.read()
    got = rows_of(streaming.stream_as_of(t.where("ttf = 3"), t.where("ttf = 1"), "1 hour", "5 minutes"), tmp_path, spark, "asof").where("sym <> 'Z'")
    every = feed.every()
    want = asof.as_of(every.where("ttf = 3"), every.where("ttf = 1")).where("sym <> 'Z'").select("sym", "ts", "seq", "px", "sz", "q_ts", "q_px")
    same(got, want)


def test_sessions_of_streams(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([tick(1, 1), tick(2, 3, px=4), tick(3, 30)])
    feed.add([tick(4, 12, px=9), tick(5, 14, sym="B")])
    feed.add([tick(6, 900, sym="Z")])
    feed.add([tick(7, 901, sym="Z")])
    got = rows_of(streaming.stream_sessions(feed.read(), 600, "1 hour"), tmp_path, spark, "sessions").where("sym <> 'Z'")
    same(got, asof.sessions(feed.every(), 600).where("sym <> 'Z'"))
    assert got.where(F.col("sym") == "A").count() == 2
