"""Sharding by a minimax contiguous partition of atomic groups (DataFrame only).

Rows with equal text form a group that is never split.  Groups are ordered by a
60-bit hash of their text; a partition into contiguous runs is sought whose
largest run is as small as possible.  The smallest feasible capacity is found
by binary search with a greedy check, and the greedy cuts at it are the shards.

No group list reaches the driver.  The hash order is a radix tree, and one
aggregation per level gives the byte sums of its blocks: cuts at block borders
bound the capacity from above, cuts anywhere inside blocks of several groups
bound it from below, and only the blocks that a cut between the two bounds can
touch are opened at the next level.  When the bounds meet, the answer is exact.
The number of collected sums depends on the number of shards, not on the data.

Groups above an equal share ("giants", fewer than the shards) come first in the
order and each gets a shard of its own, so that one of them doesn't leave other
shards empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch, read_table, text_or_empty

KEY_BITS, FIRST_BITS, STEP_BITS = 60, 12, 4
ROWS_PER_SLOT_BUCKET = 4000


def group_key(text: Column) -> Column:
    """60-bit order key of a group; texts that collide are kept together, which is harmless."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


class _Blocks:
    """Ordered blocks (first key, bytes, atomic) with prefix sums."""

    def __init__(self, rows: list[tuple[int, int, bool]]):
        self.rows = rows
        self.ends = []
        total = 0
        for _, size, _ in rows:
            total += size
            self.ends.append(total)
        self.total = total

    def cut(self, start: int, capacity: int, inside: bool) -> int:
        """Greedy end of a run from byte position start; inside: blocks of several groups may be cut anywhere."""
        to = start + capacity
        if to >= self.total:
            return self.total
        i = bisect_right(self.ends, to)
        before = self.ends[i - 1] if i else 0
        if inside and not self.rows[i][2]:
            return to
        return max(before, start)

    def cuts(self, capacity: int, shards: int, inside: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.cut(at, capacity, inside)
            out.append(at)
        return out

    def smallest(self, shards: int, inside: bool) -> int:
        low, high = -(-self.total // shards), max(self.total, 1)
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, inside)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(sized: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """(giant keys, first keys of the second and later of the other shards, capacity) for columns g, size."""
    total = sized.agg(F.sum("size").alias("s")).first()["s"] or 0
    giants: dict[int, int] = {}
    while total and len(giants) < shards - 1:
        share = (total - sum(giants.values())) / (shards - len(giants))
        new = {r["g"]: r["s"] for r in sized.groupBy("g").agg(F.sum("size").alias("s")).where(F.col("s") > share).collect() if r["g"] not in giants}
        if not new:
            break
        for g, s in sorted(new.items(), key=lambda x: (-x[1], x[0])):
            if len(giants) < shards - 1:
                giants[g] = s
    rest = sized.where(~F.col("g").isin(list(giants))) if giants else sized
    left = shards - len(giants)

    def blocks(of: DataFrame, bits: int) -> dict[int, tuple[int, int, bool]]:
        rows = of.groupBy(F.shiftright("g", KEY_BITS - bits).alias("b")).agg(F.sum("size").alias("s"), F.min("g").alias("lo"), F.max("g").alias("hi")).collect()
        return {r["lo"]: (r["lo"], r["s"], r["lo"] == r["hi"]) for r in rows}

    bits = FIRST_BITS
    found = blocks(rest, bits)
    while True:
        now = _Blocks([found[k] for k in sorted(found)])
        if not now.total:
            return list(giants), [], 0
        low, high = now.smallest(left, True), now.smallest(left, False)
        if low == high:
            break
        touched: set[int] = set()
        for a, b in zip(now.cuts(low, left, False), now.cuts(high, left, True), strict=True):
            first, last = bisect_right(now.ends, a), bisect_right(now.ends, b)
            touched.update(k for k, _, atomic in now.rows[first : last + 1] if not atomic)
        if not touched:
            break
        prefixes = [k >> (KEY_BITS - bits) for k in touched]
        inner = rest.where(F.shiftright("g", KEY_BITS - bits).isin(prefixes))
        bits += STEP_BITS
        for k in touched:
            del found[k]
        found |= blocks(inner, bits)
    firsts, at = [], 0
    for end in now.cuts(high, left, False)[:-1]:
        at = end
        if at < now.total:
            firsts.append(now.rows[bisect_right(now.ends, at)][0])
    return list(giants), firsts, high


def assign_shards(df: DataFrame, sized: DataFrame, shards: int, id_col: str = "doc_id", names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """Add shard (int) and slot (long, gapless from 0 within the shard) to df.

    df and sized have columns ``_g`` / ``g`` (group key), and id_col; sized also
    ``size``; both describe the same rows.  Slots follow a hash of the id, so no
    shard is sorted in one task: counts of small buckets give each bucket's
    first slot.
    """
    giants, firsts, _ = minimax_cuts(sized, shards)

    def shard_of(g: Column) -> Column:
        out = F.lit(len(giants))
        for first in firsts:
            out = out + (g >= F.lit(first)).cast("int")
        for i, giant in enumerate(giants):
            out = F.when(g == F.lit(giant), F.lit(i)).otherwise(out)
        return out.cast("int")

    rows = sized.count()
    buckets = max(1, rows // (shards * ROWS_PER_SLOT_BUCKET))
    spread = lambda g: F.pmod(F.xxhash64(F.col(id_col), g), F.lit(buckets)).cast("int")
    counts = sized.select(shard_of(F.col("g")).alias("_s"), spread(F.col("g")).alias("_b")).groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    shard, slot = names
    within = Window.partitionBy("_s", "_b").orderBy(id_col)
    return (
        df.withColumns({"_s": shard_of(F.col("_g")), "_b": spread(F.col("_g"))})
        .withColumn("_r", F.row_number().over(within))
        .join(counts, ["_s", "_b"])
        .withColumns({shard: F.col("_s"), slot: (F.col("_first") + F.col("_r") - 1).cast("long")})
        .drop("_s", "_b", "_r", "_first", "_g")
    )


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 40, overhead: int = 16) -> DataFrame:
    """All documents in shards of nearly equal bytes; equal texts stay together.

    Null and empty texts have 0 bytes and form one group; repeated rows are rows
    of their group; an empty table gives no rows.
    """
    return shard_table(read_table(spark, sf_dir, "documents"), shards, overhead)


def shard_table(docs: DataFrame, shards: int, overhead: int = 16) -> DataFrame:
    spark = docs.sparkSession
    text = text_or_empty()
    slim = Scratch(spark, "sharding").save(
        docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), group_key(text).alias("g")), "slim"
    )
    out = assign_shards(slim.withColumnRenamed("g", "_g"), slim.select("doc_id", "g", "size"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int, overhead: int = 16) -> DataFrame:
    """docs with columns shard and slot; columns of these names are replaced."""
    text = text_or_empty()
    sized = Scratch(docs.sparkSession, "sharding").save(docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), group_key(text).alias("g")), "slim")
    rows = docs.select("doc_id", group_key(text).alias("_g"), F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("row"))
    return assign_shards(rows, sized, shards).select("row.*", "shard", "slot")


QUERIES = {"op10_sharding": op10_sharding}
ORACLE: dict[str, str] = {}
