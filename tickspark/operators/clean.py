"""Rules over a series in order of arrival.

A series is not sorted in one task, since one symbol can hold a third of all
ticks.  It is cut into slices (a day, or a million arrivals); what a rule needs
from before a slice is the last value of an earlier one, which one aggregation
with a row per slice gives.  Windows then run within slices.  Ticks without a
symbol are no series: rules see them slice by slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.times import micros
from tickspark.schema import AUC, TRA

DAY_US = 86_400_000_000
ARRIVALS = 1_000_000


def _by_day() -> Column:
    return F.floor(micros(F.col("ts")) / DAY_US)


def _by_arrival() -> Column:
    return F.floor(F.col("seq") / ARRIVALS)


class _Slices:
    """Rows with the last value before each slice, and windows within slices."""

    def __init__(self, ticks: DataFrame, by: tuple[str, ...], values: dict[str, Column], cut: Column, order: tuple[str, ...] = ("ts", "seq"), skip_nulls: bool = False):
        if not skip_nulls:  # a null value is a value, other than no row before
            values = {n: F.struct(v.alias("v")) for n, v in values.items()}
        self.by, self.order, self.values, self.skip_nulls = (*by, "_slice"), order, values, skip_nulls
        rows = ticks.withColumn("_slice", cut)
        key = F.struct(*order)
        ends = rows.groupBy(*self.by).agg(*(F.max_by(v, F.when(v.isNotNull(), key) if skip_nulls else key).alias(f"_end_{n}") for n, v in values.items()))
        earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        before = ends.select(*self.by, *(F.last(f"_end_{n}", skip_nulls).over(earlier).alias(f"_before_{n}") for n in values))
        self.rows = rows.join(before, list(self.by), "left")

    def _window(self, last: int):
        return Window.partitionBy(*self.by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, last)

    def previous(self, name: str) -> Column:
        """The value of the row before; without nulls, the last one before that isn't null."""
        here = F.last(self.values[name], self.skip_nulls).over(self._window(-1))
        value = F.coalesce(here, F.col(f"_before_{name}"))
        return value if self.skip_nulls else value["v"]

    def latest(self, name: str) -> Column:
        """The last value that isn't null, this row's included."""
        return F.coalesce(F.last(self.values[name], True).over(self._window(0)), F.col(f"_before_{name}"))

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop("_slice", *(f"_before_{n}" for n in self.values))


def drop_repeats(ticks: DataFrame, columns: tuple[str, ...] = ("px", "sz")) -> DataFrame:
    """Only ticks that differ from the one before of the same symbol and type."""
    now = F.struct(*columns)
    s = _Slices(ticks, ("sym", "ttf"), {"now": now}, _by_day())
    rows = s.rows.withColumn("_previous", s.previous("now"))
    return s.done(rows.where(F.col("_previous").isNull() | ~now.eqNullSafe(F.col("_previous"))).drop("_previous"))


def fill_missing(ticks: DataFrame) -> DataFrame:
    """A tick without price or size takes the last one of its symbol and type."""
    s = _Slices(ticks, ("sym", "ttf"), {c: F.col(c) for c in ("px", "sz")}, _by_day(), skip_nulls=True)
    return s.done(s.rows.withColumns({c: s.latest(c) for c in ("px", "sz")}))


def drop_repeated_sizes(ticks: DataFrame) -> DataFrame:
    """Ticks with a size only go if the size is the last one known."""
    s = _Slices(ticks, ("sym", "ttf"), {"sz": F.col("sz")}, _by_day(), skip_nulls=True)
    rows = s.rows.withColumn("_last", s.previous("sz"))
    return s.done(rows.where(F.col("px").isNotNull() | F.col("_last").isNull() | (F.col("sz") != F.col("_last"))).drop("_last"))


def gaps(ticks: DataFrame) -> DataFrame:
    """Microseconds since the tick before of the same symbol and type."""
    s = _Slices(ticks, ("sym", "ttf"), {"us": micros(F.col("ts"))}, _by_day())
    return s.done(s.rows.withColumn("gap_us", micros(F.col("ts")) - s.previous("us")))


def repair_stamps(ticks: DataFrame, second: str = "ts2") -> DataFrame:
    """A tick without stamp takes the later of its second stamp and the last stamp of its symbol."""
    s = _Slices(ticks, ("sym",), {"ts": F.col("ts")}, _by_arrival(), ("seq",), skip_nulls=True)
    rows = s.rows.withColumn("_last", s.previous("ts"))
    return s.done(rows.withColumn("ts", F.coalesce("ts", F.greatest(F.col(second), F.col("_last")))).drop("_last"))


#: With weights 2 ** -k so many lags, or slices, decide a running mean to a float's precision.
HALVINGS = 62


def receive_lag(ticks: DataFrame, lag: str = "lag_us") -> DataFrame:
    """Running offset per symbol: half of the last offset and half of the lag.

    Each tick maps an offset x to (x + lag) / 2, and a slice of n ticks to
    x / 2 ** n + b.  So a slice starts from nothing, the maps of the slices before
    it give what it should have started from, and that halves with each tick: a
    symbol's ticks are one task nowhere.  Ticks without lag leave the offset.
    """
    by = ("sym", "_slice")
    rows = ticks.withColumn("_slice", _by_day())
    within = Window.partitionBy(*by).orderBy("ts", "seq")
    halve = lambda acc, x: (acc + x) / 2
    recent = F.collect_list(F.col(lag).cast("double")).over(within.rowsBetween(-HALVINGS, 0))
    rows = rows.withColumns({"_own": F.aggregate(recent, F.lit(0.0), halve), "_n": F.count(lag).over(within.rowsBetween(Window.unboundedPreceding, 0))})
    ends = rows.groupBy(*by).agg(F.max_by("_own", F.struct("ts", "seq")).alias("b"), F.max("_n").alias("n"))
    earlier = Window.partitionBy("sym").orderBy("_slice").rowsBetween(-HALVINGS, -1)
    maps = F.collect_list(F.struct("n", "b")).over(earlier)
    start = F.aggregate(maps, F.lit(0.0), lambda acc, m: m["b"] + acc * F.pow(F.lit(2.0), -m["n"]))
    rows = rows.join(ends.select(*by, start.alias("_start")), list(by), "left")
    return rows.withColumn("offset_us", F.col("_own") + F.coalesce("_start", F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("_n"))).drop("_slice", "_own", "_n", "_start")


def route_auctions(ticks: DataFrame, opens: str = "opens_auction", closes: str = "closes_auction") -> DataFrame:
    """Size-only trades after an auction mark are auction ticks until a trade mark."""
    mark = F.when(F.col(opens), True).when(F.col(closes), False)
    s = _Slices(ticks, ("sym",), {"mark": mark}, _by_day(), skip_nulls=True)
    rows = s.rows.withColumn("_state", s.latest("mark"))
    routed = F.when((F.col("ttf") == TRA) & F.col("px").isNull() & F.coalesce("_state", F.lit(False)), AUC).otherwise(F.col("ttf"))
    return s.done(rows.withColumn("ttf", routed).drop("_state"))


def with_previous_stamp(ticks: DataFrame, name: str = "prev_ts") -> DataFrame:
    """Add the stamp of the tick that arrived before of the same symbol."""
    s = _Slices(ticks, ("sym",), {"ts": F.col("ts")}, _by_arrival(), ("seq",))
    return s.done(s.rows.withColumn(name, s.previous("ts")))


def unsorted(ticks: DataFrame) -> DataFrame:
    """Ticks that arrive with a smaller stamp than the one before of their symbol."""
    return with_previous_stamp(ticks).where("ts < prev_ts")
