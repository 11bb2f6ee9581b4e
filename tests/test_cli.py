from tickspark.__main__ import main

LINES = ["A\t2011-03-01T10:00:00Z\t1\t1\t10\t5", "A\t2011-03-01T10:01:00Z\t1\t2\t11\t5", "B\t2011-03-01T11:00:00Z\t2\t3\t7\t5"]


def test_commands(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join(LINES))
    at = lambda n: str(tmp_path / n)
    assert main(["mux", at("in.txt"), "-o", at("t")], spark) == 0
    assert main(["candles", at("t"), "-o", at("c"), "-i", "3600"], spark) == 0
    assert main(["snapshots", at("t"), "-o", at("s")], spark) == 0
    assert main(["slab", at("t"), "--symbols", "A", "-o", at("x"), "--explode", "sym"], spark) == 0
    assert main(["slab", at("t"), "--day", "2011-03-01", "-o", at("y"), "--explode", "interval"], spark) == 0
    assert main(["print", at("t"), "-o", at("p")], spark) == 0
    assert main(["print", at("t"), "--into", at("p")], spark) == 0
    assert main(["diff", at("t"), at("x"), "-o", at("d")], spark) == 0
    for c in ("info", "shapes", "symbols", "sort"):
        assert main([c, at("t"), "-o", at(c)], spark) == 0
    assert main(["check", at("t"), "-o", at("issues")], spark) == 0
    assert spark.read.parquet(at("c")).count() == 3
    assert spark.read.parquet(at("x")).count() == 2
    assert spark.read.text(at("p")).count() == 6
    assert [r["sym"] for r in spark.read.parquet(at("symbols")).orderBy("idx").collect()] == ["A", "B"]


def test_containers(spark, tmp_path):
    from tickspark.sources import cells, container

    (tmp_path / "in.txt").write_text("\n".join(LINES))
    at = lambda n: str(tmp_path / n)
    assert main(["mux", at("in.txt"), "-o", at("folder"), "--as", "container"], spark) == 0
    assert main(["mux", "-f", "container", at("folder"), "-o", at("big"), "--as", "file", "--order", "big", "--packed"], spark) == 0
    header, _ = container.header_of(at("big"))
    assert header.order == ">" and header.flags & cells.PACKED
    assert main(["mux", "-f", "container", at("big"), "-o", at("plain"), "--as", "file"], spark) == 0
    assert main(["mux", "-f", "container", at("plain"), "-o", at("t")], spark) == 0
    assert sorted((r["sym"], r["ttf"], float(r["px"])) for r in spark.read.parquet(at("t")).collect()) == [("A", 1, 10.0), ("A", 2, 11.0), ("B", 3, 7.0)]
    assert main(["mux", at("in.txt"), "--into", at("folder"), "--as", "container"], spark) == 0
    assert container.container(spark, at("folder")).count() == 6
