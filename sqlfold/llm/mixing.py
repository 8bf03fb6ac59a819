"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's key is an exponential variable over its quality weight; ascending keys are a
weighted sample without replacement. A source's target is spent in complete epochs first;
what is left goes to the documents of the smallest keys, by prefix sums of sizes. Prefix
sums never gather a source: keys fall into buckets of bounded row counts, sizes are summed
within each bucket, and the buckets' totals are summed per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Bucket edges follow the mean of exponential distributions of these rates. For weights
#: from the first to the last, no bucket expects over ten times the mean rows.
RATES = (0.1, 0.2, 0.4, 0.8, 1.0)
SYMBOLS = "*%#$&!|@<>{}~^="


def plainness(text: Column) -> Column:
    """Quality weight from 0.1 to 1: falls with the share of symbols in the text."""
    share = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.nullif(F.length(text), F.lit(0))
    return F.coalesce(F.greatest(F.lit(RATES[0]), F.lit(1.0) - share * 4), F.lit(1.0))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, rows, target) for ``sources`` (source, source_size, rows).

    Sources in code point order, null last, have the weights in turn and share ``share`` of
    all sizes; targets stop at ``cap`` times the source's size and the excess goes to the
    others by weight. Filled in the order of cap over weight, a source is capped exactly if
    the level of what is left over the weights left reaches it. One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*map(F.lit, weights))[(rank - 1) % len(weights)]
    given = sources.withColumn("weight", turn).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - before("most")
    given = given.withColumn("level", left / (F.sum("weight").over(every) - before("weight")))
    capped = F.col("most") <= F.col("level") * F.col("weight")
    given = given.withColumn("level", F.max(F.when(~capped, F.col("level"))).over(every)).withColumn("capped", F.col("most") <= F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("level") * F.col("weight"))
    return given.select("source", "source_size", "rows", target.alias("target"))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, bucket_rows: int = 4096, carry: list[str] | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per input row, and the
    columns of ``carry`` as ``carry_<name>``.

    ``size`` counts words (null text: 0), ``copies`` is how often the mix takes the document
    whole, ``taken`` is copies times size. ``weight`` (default: ``plainness`` of the text)
    must lie from 0.1 to 1. Documents are taken whole: the one that the budget ends in is
    taken if more than half of it fits. Keys come from the id, so reruns agree; equal keys
    go by id and size; null ids share one key. The null source is a source. Documents
    without words are taken as their keys fall, and count nothing.
    """
    common.session(df)
    text = F.col(text_col).cast("string")
    spin = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    uniform = (spin + 1) / F.lit(float(2**52 + 1))
    sized = df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform) / (plainness(text) if weight is None else weight)).alias("key"),
        *[F.col(f"`{c}`").alias(f"carry_{c}") for c in carry or []],
    )
    narrow = common.stage(sized.select("id", "source", "size", "key"), "mix")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goals = targets(sources, weights, share, cap)
    goals = goals.withColumn("buckets", F.ceil(F.col("rows") / F.lit(bucket_rows)))
    goals = common.stage(goals, "mix-targets")

    def bucketed(rows: DataFrame) -> DataFrame:
        same = rows["source"].eqNullSafe(goals["source"])
        place = sum((1 - F.exp(-F.col("key") * r) for r in RATES), F.lit(0.0)) / len(RATES)
        both = rows.join(goals, same).drop(goals["source"])
        return both.withColumn("bucket", F.least(F.floor(place * F.col("buckets")), F.col("buckets") - 1))

    totals = bucketed(narrow).groupBy("source", "bucket").agg(F.sum("size").alias("within"))
    lower = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("within").over(lower), F.lit(0)).alias("below"))
    placed = bucketed(narrow).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    earlier = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("below") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    placed = placed.withColumn("start", start).withColumn("epochs", epochs).withColumn("rest", F.col("target") - epochs * F.col("source_size"))
    more = (F.col("start") < F.col("rest")) & (F.col("rest") - F.col("start") > F.col("size") / 2)
    placed = placed.withColumn("more", more)
    result = ["id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    if not carry:
        return placed.withColumn("copies", (F.col("epochs") + F.col("more").cast("long")).cast("long")).select(result)
    return _carried(sized, placed, goals).select(*result, *[f"`carry_{c}`" for c in carry])


def _carried(sized: DataFrame, placed: DataFrame, goals: DataFrame) -> DataFrame:
    """``sized``, whole rows, with their copies. What a source takes once more is a beginning of its
    order by key, id and size, so the last place taken says it for every row: whole rows are
    neither sorted nor shuffled. Only rows at that very place, of one id, are counted off where not all fit."""
    place = F.struct("key", "id", "size")
    ties = placed.groupBy("source", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.count_if("more").alias("taken")).where("taken > 0")
    last = ties.groupBy("source").agg(F.max(F.struct("place", "n", "taken")).alias("last"))
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    ends = goals.join(last.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source")), "left")
    ends = common.stage(ends.select(F.col("source").alias("e_source"), "source_size", "target", epochs.alias("epochs"), "last"), "mix-ends")
    rows = sized.join(ends, F.col("source").eqNullSafe(F.col("e_source"))).drop("e_source")
    split = F.coalesce((place == F.col("last.place")) & (F.col("last.n") > F.col("last.taken")), F.lit(False))
    more = F.coalesce(place <= F.col("last.place"), F.lit(False))
    if not ends.where("last.n > last.taken").isEmpty():
        number = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in sized.columns])))
        some = rows.where(split).withColumn("more", number <= F.col("last.taken"))
        rows = rows.where(~split).withColumn("more", more).unionByName(some)
    else:
        rows = rows.withColumn("more", more)
    return rows.withColumn("copies", (F.col("epochs") + F.col("more").cast("long")).cast("long"))
