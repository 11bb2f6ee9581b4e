"""Command line: ``python -m tickspark COMMAND IN... -o OUT``; tick tables are Parquet folders.

``mux``, ``slab`` and ``sort`` also write containers, so ``mux -f container`` turns
one into another byte order, the present layout, or packed and plain pages.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark import sinks, sources
from tickspark.operators import candles, dictionary, filters, info, sets, shape, snapshots, validate
from tickspark.sinks import container


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *, interval: int | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("input", nargs="+")
        where = c.add_mutually_exclusive_group()
        where.add_argument("-o", "--output", help="write here, in place of what is there")
        where.add_argument("--into", help="append to this")
        if name in ("mux", "slab", "sort"):
            c.add_argument("--as", dest="kind", choices=("parquet", "container", "file"), default="parquet", help="a folder of Parquet or of containers, or one container file")
            c.add_argument("--order", choices=("little", "big"), default="little", help="byte order of containers")
            c.add_argument("--packed", action="store_true", help="pack pages of containers")
        if interval is not None:
            c.add_argument("-i", "--interval", type=int, default=interval, help="seconds")
            c.add_argument("-m", "--modulus", type=int, default=0, help="offset of intervals in seconds")
        return c

    c = command("mux", "read feeds")
    c.add_argument("-f", "--format", default="ticktext")
    c.add_argument("--name")
    c = command("print", "write as text")
    c.add_argument("-f", "--format", default="ticktext")
    c = command("slab", "select by symbol, index and time")
    c.add_argument("--symbols", nargs="*", default=[])
    c.add_argument("--indices", nargs="*", type=int, default=[])
    c.add_argument("--start")
    c.add_argument("--end")
    c.add_argument("--day")
    c.add_argument("--explode", choices=("sym", "interval"))
    c.add_argument("--interval", type=int, default=86400)
    command("candles", "candles of ticks", interval=300)
    command("snapshots", "snapshots of ticks", interval=300)
    c = command("info", "types of ticks per symbol", interval=0)
    command("shapes", "shape of each series")
    command("symbols", "the dictionary")
    command("check", "issues of a tick table")
    command("sort", "chronological order")
    command("diff", "ticks of only one of two tables")
    return p


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command == "mux":
        options = {"name": a.name} if a.name else {}
        return reduce(sets.union, (sources.read(spark, a.format, path, **options) for path in a.input))
    tables = [spark.read.parquet(path) for path in a.input]
    if a.command == "diff":
        return sets.difference(tables[0], tables[1])
    ticks = sets.union(*tables)
    if a.command == "print":
        return sinks.PRINTERS[a.format](sets.chronological(ticks) if "seq" in ticks.columns else ticks)
    if a.command == "slab":
        if a.symbols or a.indices:
            ticks = filters.by_symbol_or_index(ticks, a.symbols, a.indices)
        ticks = filters.by_day(ticks, a.day) if a.day else filters.by_time(ticks, a.start, a.end)
        return sinks.with_interval(ticks, a.interval) if a.explode == "interval" else ticks
    if a.command == "candles":
        return candles.candles(ticks, a.interval, a.modulus)
    if a.command == "snapshots":
        return snapshots.snapshots(ticks, a.interval, a.modulus)
    if a.command == "info":
        return info.type_sets_by_interval(ticks, a.interval, a.modulus) if a.interval else info.type_sets(ticks)
    if a.command == "shapes":
        return shape.shapes(ticks)
    if a.command == "symbols":
        return dictionary.assign(ticks)
    if a.command == "check":
        return validate.issues(ticks)
    return sets.chronological(ticks)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or for ``check`` 1 if there are issues."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tickspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = result(spark, a)
    to = a.output or a.into
    if to is None:
        out.show(100, truncate=False)
    else:
        mode = "overwrite" if a.output else "append"
        by = {"sym": ["sym"], "interval": ["bucket"]}.get(getattr(a, "explode", None) or "", [])
        kind = getattr(a, "kind", "parquet")
        if kind == "container":
            container.write_container(out, to, append=a.into is not None, order=a.order, packed=a.packed)
        elif kind == "file":
            container.write_single(out, to, order=a.order, packed=a.packed)
        elif a.command == "print" and out.columns == ["value"]:
            out.write.mode(mode).text(to)
        else:
            writer = out.write.mode(mode)
            (writer.partitionBy(*by) if by else writer).parquet(to)
    return int(a.command == "check" and out.where(F.lit(True)).limit(1).count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
