"""MAT files, read back by a reader of its own."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.adapters import ticks
from tickspark.operators import candles, dictionary, snapshots
from tickspark.sinks import candle_matrix, matfile


def read_mat(data):
    assert data[124:126] == b"\x00\x01" and data[126:128] == b"IM"
    out, at = {}, 128
    while at < len(data):
        kind, size = struct.unpack_from("<II", data, at)
        assert kind == 14
        end, at = at + 8 + size, at + 8
        fields = []
        while at < end:
            kind, n = struct.unpack_from("<II", data, at)
            fields.append((kind, data[at + 8 : at + 8 + n]))
            at += 8 + -(-n // 8) * 8
        assert at == end and [k for k, _ in fields] == [6, 5, 1, 9]
        assert fields[0][1][0] == 6
        rows, columns = struct.unpack("<ii", fields[1][1])
        out[fields[2][1].decode()] = np.frombuffer(fields[3][1], "<f8").reshape(columns, rows).T
    return out


@pytest.mark.parametrize("most", [matfile.MOST_BYTES, 256 + 8 * 3 * 100])
def test_rows_of_all_tasks(spark, tmp_path, most):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") / 3).alias("b"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("c")).repartition(7)
    matfile.write_matrix(df, str(tmp_path / "m.mat"), ("a",), "x", most)
    got = read_mat((tmp_path / "m.mat").read_bytes())
    want = np.array([[r["a"], r["b"], r["c"] or 0] for r in df.orderBy("a").collect()], float)
    assert list(got) == (["x"] if most > 1 << 20 else [f"x{k}" for k in range(1, 11)])
    assert np.array_equal(np.concatenate(list(got.values())), want)
    assert [p.name for p in tmp_path.iterdir()] == ["m.mat"]


def test_candles_and_snapshots(spark, sf, tmp_path):
    t = ticks(spark, sf)
    names = dictionary.assign(t)
    k = candles.candles(t, 86400)
    matfile.write_candles(k, names, str(tmp_path / "k.mat"))
    got = read_mat((tmp_path / "k.mat").read_bytes())["candles"]
    want = candle_matrix(k).join(names, "sym").orderBy("day", "idx").select("day", "idx", *(f"{c}{s}" for s in (1, 2, 3) for c in "ohlc")).toPandas().fillna(0).to_numpy(float)
    assert got.shape == want.shape and np.array_equal(got, want)
    matfile.write_snapshots(snapshots.snapshots(t, 86400), names, str(tmp_path / "s.mat"))
    assert read_mat((tmp_path / "s.mat").read_bytes())["snapshots"].shape[1] == 6


def test_no_rows(spark, tmp_path):
    matfile.write_matrix(spark.createDataFrame([], "a double, b double"), str(tmp_path / "n.mat"), ("a",))
    assert read_mat((tmp_path / "n.mat").read_bytes())["ticks"].shape == (0, 2)
