"""Sharding by a k-d tree over metadata.

Each node is split at the weighted median, in bytes, of the dimension that is widest in
it, until the leaves reach the target bytes. Medians are found for all nodes of a level
at once by histograms that are grouped where the rows lie and refined around the median:
no sort, no text moved, one row per node back at the driver. Ties on the dimension go by
the text's checksum, so equal texts stay together unless a cut must part them, then by a
hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

_BINS = 1024


def text_code(value: Column) -> Column:
    """A number that keeps the order of strings as far as their first seven bytes tell it; null first."""
    padded = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(padded, 16, 10).cast("long"), F.lit(-1).cast("long"))


def _walk(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Add ``node``, the first shard of the leaf that a row has come to after ``levels`` of cuts."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for cuts in levels:
        key = F.struct(F.element_at("dims", F.col("c_dim")).alias("a"), F.col("crc").alias("b"), F.col("spin").alias("c"))
        cut = F.struct(F.col("c_a").alias("a"), F.col("c_b").alias("b"), F.col("c_c").alias("c"))
        rows = rows.join(F.broadcast(cuts), rows["node"] == cuts["c_node"], "left")
        rows = rows.withColumn("node", F.when(F.col("c_node").isNotNull() & (key >= cut), F.col("c_right")).otherwise(F.col("node")))
        rows = rows.drop(*cuts.columns)
    return rows


def _cuts(spark, at: DataFrame, nodes: dict[int, int], widths: list[int], slack: float) -> DataFrame:
    """One cut per node of ``nodes`` (first shard -> number of shards) as a table of as many rows."""
    n = len(widths)
    extents = at.where(F.col("node").isin(list(nodes))).groupBy("node").agg(
        F.sum("size").alias("size"), *[F.min(F.col("dims")[i]).alias(f"lo{i}") for i in range(n)], *[F.max(F.col("dims")[i]).alias(f"hi{i}") for i in range(n)])
    open_, done = {}, []
    for e in extents.collect():
        k = nodes[e["node"]]
        dim = max(range(n), key=lambda i: ((e[f"hi{i}"] - e[f"lo{i}"]) / max(1, widths[i]), -i))
        open_[e["node"]] = {"dim": dim + 1, "level": 0, "eq": [0, 0], "lo": e[f"lo{dim}"], "hi": e[f"hi{dim}"], "want": e["size"] * (k // 2) / k, "near": slack * e["size"] / k, "right": e["node"] + k // 2}
    schema = "s_node long, s_dim int, s_level int, s_a long, s_b long, s_lo long, s_hi long, s_step long, s_want double"
    lowest = -(2**63)
    while open_:
        state = spark.createDataFrame([(x, s["dim"], s["level"], s["eq"][0], s["eq"][1], s["lo"], s["hi"], (s["hi"] - s["lo"]) // _BINS + 1, float(s["want"])) for x, s in open_.items()], schema)
        both = at.join(F.broadcast(state), at["node"] == state["s_node"])
        value, level = F.element_at("dims", F.col("s_dim")), F.col("s_level")
        key = F.when(level == 0, value).when(level == 1, F.col("crc")).otherwise(F.col("spin"))
        inside = ((level < 1) | (value == F.col("s_a"))) & ((level < 2) | (F.col("crc") == F.col("s_b")))
        both = both.withColumn("key", key).where(inside & F.col("key").between(F.col("s_lo"), F.col("s_hi")))
        bins = both.groupBy("s_node", "s_want", F.floor((F.col("key") - F.col("s_lo")) / F.col("s_step")).alias("bin")).agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        order = Window.partitionBy("s_node").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("size").over(order)).withColumn("next", F.lead("lo").over(order))
        crossing = bins.where("upto >= s_want").groupBy("s_node").agg(F.min_by(F.struct("size", "lo", "hi", "upto", "next"), "bin").alias("x"))
        for row in crossing.collect():
            node, x = row["s_node"], row["x"]
            s = open_[node]
            below, above = x["upto"] - x["size"], x["upto"]
            key = s["eq"][: s["level"]]
            short, over = s["want"] - below, above - s["want"]
            if min(short, over) <= s["near"] or (x["lo"] == x["hi"] and s["level"] == 2):
                # all keys from here on go right; past the last key of a prefix, the prefix itself is raised
                if short <= over:
                    cut = [*key, x["lo"]]
                elif x["next"] is not None:
                    cut = [*key, x["next"]]
                else:
                    cut = [*key, x["hi"] + 1]
                done.append((node, s["dim"], *(cut + [lowest, lowest])[:3], s["right"]))
                del open_[node]
            elif x["lo"] == x["hi"]:
                s["eq"][s["level"]] = x["lo"]
                s |= {"level": s["level"] + 1, "lo": 0, "hi": 2**32 - 1 if s["level"] == 0 else 2**62 - 1, "want": short}
            else:
                s |= {"lo": x["lo"], "hi": x["hi"], "want": short}
    return spark.createDataFrame(done, "c_node long, c_dim int, c_a long, c_b long, c_c long, c_right long")


def kd_shards(df: DataFrame, id_col: str, text_col: str, dimensions: list[Column], shards: int | None = None, target_bytes: int | None = None, slack: float = 0.005, bucket_rows: int = 4096) -> DataFrame:
    """(id, size, crc32, shard, slot), one row per input row.

    ``dimensions`` are integer columns (``text_code`` makes one of a string); null is the
    smallest value. ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, checksum 0).
    Give ``shards``, or ``target_bytes`` for as many shards as that takes. Cuts stop within
    ``slack`` of a shard's bytes, or at rows that nothing tells apart (one id, one text).
    Slots count from 0 in each shard without gaps. The tree, of one node per shard, is held
    by the driver. An empty table gives an empty result.
    """
    spark = common.session(df)
    text = F.encode(F.col(text_col).cast("string"), "UTF-8")
    rows = df.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
        F.array(*[F.coalesce(d.cast("long"), F.lit(-1).cast("long")) for d in dimensions]).alias("dims"),
    )
    # rows of one id, or of none, are told apart by their texts
    rows = common.stage(rows.withColumn("spin", F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 2)), "shard-rows")
    n = len(dimensions)
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), *[(F.max(F.col("dims")[i]) - F.min(F.col("dims")[i])).alias(f"w{i}") for i in range(n)]).first()
    count = shards or max(1, -(-(whole["size"] or 0) // target_bytes))
    levels, nodes = [], {0: count} if whole["rows"] else {}
    while nodes := {x: k for x, k in nodes.items() if k > 1}:
        levels.append(_cuts(spark, _walk(rows, levels), nodes, [whole[f"w{i}"] for i in range(n)], slack))
        nodes = {y: k for x, m in nodes.items() for y, k in ((x, m // 2), (x + m // 2, m - m // 2))}
    buckets = max(1, -(-whole["rows"] // (count * bucket_rows)))
    placed = _walk(rows, levels).withColumn("bucket", F.pmod("spin", F.lit(buckets)))
    totals = placed.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("node", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"))
    number = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("spin", "id", "crc", "size"))
    placed = placed.join(totals, ["node", "bucket"])
    return placed.select("id", "size", F.col("crc").alias("crc32"), F.col("node").cast("int").alias("shard"), (F.col("below") + number - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, id_col: str, sharded: DataFrame, path: str) -> None:
    """Write the rows of ``df`` (one row per id) to ``path/shard=<n>``, with their slots."""
    placed = df.join(sharded.select(F.col("id").alias(id_col), "shard", "slot"), id_col)
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
