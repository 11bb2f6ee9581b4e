"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words.  Every document gets the whole copies
that are certain (target divided by the source's words, rounded down); the rest
of the target is drawn.  For the draw a document with inclusion probability p
and a uniform number u (a hash of its id) is ranked by the odds of u divided by
the odds of p, and the documents of lowest rank are taken until the words are
filled: a sample of fixed size in words with unequal probabilities, p growing
with the logarithm of a document's length.

No source is sorted in one task.  Ranks fall into fine buckets, twice over; word
sums by bucket show where each source's cut lies, and only the documents of that
one bucket are ordered.  The remainder, smaller than the document at the cut, is
closed by the untaken document whose size is nearest to it, if that helps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickspark.llm.common import Scratch, n_words, read_table

BUCKETS = 4096


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add target (double) to rows (source, source_size): weights by code point order, null last, with a cap.

    min(cap, level * weight) is what resharing the excess by weight ends in; the
    level comes from one running sum over the sources in the order they reach
    their cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("_at", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    by = Window.orderBy("_at", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_open", F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("_full")) / F.col("_open"))
    level = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(every)["_level"]
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_at", "_full", "_open", "_level")


def _uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from a hash of the id."""
    return (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(slim table of units, function that adds size, source_size, target and copies to docs).

    docs has doc_id, text and source.  Null and empty texts have size 0 and are
    taken whole times only; null is a source of its own.  Rows that agree in
    doc_id, source and size are one unit and decided alike.  Reruns agree: all
    randomness is a hash of doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    slim = scratch.save(docs.select("doc_id", "source", n_words().alias("size")), "slim")
    x = F.log1p(F.col("size"))
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(x * F.col("size")).alias("_xs"))
    sources = targets(by_source, weights, share, cap)
    rho = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("_whole", F.floor(rho).cast("int")).withColumn("_f", rho - F.col("_whole")).withColumn("_mean", F.col("_xs") / F.col("source_size"))
    sources = scratch.save(sources.withColumn("_draw", F.col("target") - F.col("_whole") * F.col("source_size")).drop("_xs"), "sources")

    def ranked(df: DataFrame, src: DataFrame) -> DataFrame:
        """Join the source's row and add the rank _z in (0, 1), even over each source's documents, and its two buckets."""
        df = df.withColumnRenamed("source", "_source").join(src, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_f") * F.log1p(F.col("size")) / F.col("_mean")))
        u = _uniform(F.col("doc_id"), seed)
        odds = u / (1 - u) * (1 - p) / p * F.col("_f") / (1 - F.col("_f"))
        df = df.withColumn("_z", F.coalesce(odds / (1 + odds), F.lit(0.0)))
        df = df.withColumn("_b1", F.floor(F.col("_z") * BUCKETS).cast("int"))
        return df.withColumn("_b2", F.floor((F.col("_z") * BUCKETS - F.col("_b1")) * BUCKETS).cast("int"))

    def cut(sums: DataFrame, bucket: str) -> DataFrame:
        """The bucket of each source in which the words run out, and the words before it."""
        run = Window.partitionBy("source").orderBy(bucket)
        after = sums.withColumn("_after", F.sum("_words").over(run)).where(F.col("_after") > F.col("_draw"))
        first = after.groupBy("source").agg(F.min(F.struct(F.col(bucket), (F.col("_after") - F.col("_words")).alias("_words"))).alias("c"))
        return first.select(F.col("source").alias("_s"), F.col(f"c.{bucket}").alias(f"_cut{bucket}"), F.col("c._words").alias(f"_before{bucket}"))

    units = ranked(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m")), sources).where("_draw > 0 and size > 0")
    units = units.withColumn("_all", F.col("size") * F.col("_m"))
    one = cut(units.groupBy("source", "_draw", "_b1").agg(F.sum("_all").alias("_words")), "_b1")
    with_one = sources.join(one, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    with_one = with_one.withColumn("_draw", F.when(F.col("_cut_b1").isNotNull(), F.col("_draw") - F.col("_before_b1")).otherwise(F.col("_draw")))
    with_one = scratch.save(with_one, "cut1")
    edge = ranked(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m")), with_one).where("_b1 = _cut_b1 and size > 0").withColumn("_all", F.col("size") * F.col("_m"))
    two = cut(edge.groupBy("source", "_draw", "_b2").agg(F.sum("_all").alias("_words")), "_b2")
    cuts = with_one.join(two, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    cuts = scratch.save(cuts.withColumn("_draw", F.col("_draw") - F.coalesce(F.col("_before_b2"), F.lit(0))), "cut2")
    last = ranked(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m")), cuts).where("_b1 = _cut_b1 and _b2 = _cut_b2 and size > 0").withColumn("_all", F.col("size") * F.col("_m"))
    run = Window.partitionBy("source").orderBy("_z", "doc_id", "size")
    last = last.withColumn("_sum", F.sum("_all").over(run)).select("doc_id", "source", "size", "_draw", "_sum", "_all", (F.col("_sum") <= F.col("_draw")).alias("_in"))
    last = scratch.save(last, "last")
    rest = last.groupBy("source").agg((F.first("_draw") - F.coalesce(F.max(F.when(F.col("_in"), F.col("_sum"))), F.lit(0))).alias("_rest"))
    cuts = scratch.save(cuts.join(rest.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "cuts")
    below = F.when(F.col("_cut_b1").isNull(), F.col("_draw") > 0).otherwise((F.col("_b1") < F.col("_cut_b1")) | ((F.col("_b1") == F.col("_cut_b1")) & (F.col("_b2") < F.col("_cut_b2"))))
    flags = last.select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("_in"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size"))
    # The closing document: not taken so far, nearest in size to what is left.
    untaken = ranked(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m")), cuts).where(F.col("_rest").isNotNull() & ~below & (F.col("size") > 0))
    untaken = untaken.join(flags, same, "left").where(~F.coalesce(F.col("_in"), F.lit(False))).withColumn("_gap", F.abs(F.col("size") * F.col("_m") - F.col("_rest")))
    near = untaken.where(F.col("_gap") < F.col("_rest")).groupBy("source").agg(F.min(F.struct("_gap", "_z", "doc_id", "size")).alias("c"))
    closing = near.select(F.col("c.doc_id").alias("_id"), F.col("source").alias("_s"), F.col("c.size").alias("_size"), F.lit(True).alias("_in"))
    edges = scratch.save(flags.where("_in").union(closing), "edges")

    def copies(df: DataFrame) -> DataFrame:
        """df (doc_id, source, size, ...) with source_size, target and copies (int)."""
        out = ranked(df, cuts).join(edges, same, "left")
        out = out.withColumn("copies", F.col("_whole") + F.when(F.col("size") <= 0, F.lit(0)).otherwise((F.coalesce(below, F.lit(False)) | F.coalesce(F.col("_in"), F.lit(False))).cast("int")))
        return out.drop(*[c for c in out.columns if c.startswith("_")])

    return slim, copies


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes."""
    return mix_table(read_table(spark, sf_dir, "documents"))


def mix_table(docs: DataFrame) -> DataFrame:
    slim, copies = mix(docs)
    return copies(slim).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of docs with all their columns, each as often as it is taken."""
    _, copies = mix(docs)
    out = copies(docs.select("doc_id", "source", n_words().alias("size"), F.struct("*").alias("row")))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


QUERIES = {"op1_mix": op1_mix}
ORACLE: dict[str, str] = {}
