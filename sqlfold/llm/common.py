"""Helpers the operators share: staged tables, packed tiles, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlfold.session import ensure_checkpoint_dir, prepare

#: Separators of words, as fixed by the operators' contracts: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, and later
    jobs reread files that outlive any executor. The folder belongs to the application."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no lazy result refers to any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Arrow batches between Spark and Python hold this many bytes, however long the texts are.
BATCH_BYTES = 4 * 1024 * 1024


def settle() -> None:
    """Give the memory of past batches back to the system: a worker outlives its stage."""
    pa.default_memory_pool().release_unused()


def lean(run):
    """``run``, a function of Arrow batches, with :func:`settle` after each batch it yields."""

    def settled(batches):
        for out in run(batches):
            yield out
            del out
            settle()

    return settled


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, ready for jobs: checkpoint folder, package on the executors, bounded batches."""
    spark = prepare(df.sparkSession)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit).rstrip("b") == str(64 * 1024 * 1024):  # Spark's own, so not set by the user
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark


def bucket_of(ids: Column, buckets: Column | int) -> Column:
    """A bucket below ``buckets`` that depends on the id alone."""
    return F.pmod(F.xxhash64(ids), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("long")


# --- tiles: bounded blocks of rows, packed into one binary record each -------------------


def number_tiles(df: DataFrame, key: str, row_id: str, tile_rows: int) -> DataFrame:
    """Add ``tile``: groups of ``key`` above ``tile_rows`` are spread over several tiles by a
    hash of the row id, so that no tile grows with a hot key."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).alias("_tiles"))
    return df.join(sizes, key).withColumn("tile", bucket_of(F.col(row_id), F.col("_tiles"))).drop("_tiles")


def pack_tiles(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per tile; each column of ``columns`` (name -> numpy type, or 'bytes' for binary
    values of one width) becomes one binary value."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: [pdf[k].iloc[0]] for k in keys}
        for name, kind in columns.items():
            out[name] = [b"".join(pdf[name]) if kind == "bytes" else pdf[name].to_numpy(kind).tobytes()]
        return pd.DataFrame(out | {"n": [len(pdf)]})

    schema = ", ".join([f"{k} long" for k in keys] + [f"{c} binary" for c in columns] + ["n long"])
    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(pack, schema)


def pair_up(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Join ``pairs`` (``a``, ``b``: tile ids) with the packed tiles of both sides; their
    columns come back with ``a_`` and ``b_`` in front."""
    for side, tiles in (("a", left), ("b", right)):
        pairs = pairs.join(tiles.select(F.col("tile_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in tiles.columns if c != "tile_id"]), side)
    return pairs


# --- connected components ----------------------------------------------------------------


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b and, for each, the smallest node of its component."""
    nodes, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = pos[: len(a)], pos[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        # the larger root of each link goes under the smallest root it meets; members follow theirs
        new = label.copy()
        np.minimum.at(new, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        label = new
        live = label[i] != label[j]
        i, j = i[live], j[live]
    return nodes, nodes[label]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per node, to the smallest node, that connect what the links a-b connect."""
    nodes, root = roots(a, b)
    own = nodes != root
    return nodes[own], root[own]


def _contract(batches):
    """Links of a partition to spanning links; holds one link per node it has seen."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    for pdf in batches:
        held = spanning(np.concatenate([held[0], pdf["a"].to_numpy()]), np.concatenate([held[1], pdf["b"].to_numpy()]))
    yield pd.DataFrame({"a": held[0], "b": held[1]})


def connected_components(links: DataFrame, spanned: bool = False, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``links`` (a long, b long) reaches.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) on tables in the
    shared folder, after each partition has replaced its links by spanning ones (``spanned``:
    the links come so; a second Python worker beside theirs would do nothing). A round is
    a grouping with partial aggregation and a join on the node; nothing but two sums reaches
    the driver, which stops when a round changes no link.
    """
    spark = session(links)
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage((ends if spanned else ends.mapInPandas(_contract, "a long, b long")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the smaller neighbours of u, and u, move to the smallest of them
        large = stage(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        unstage(large)
        unstage(now)
        now = after
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == seen:
            break
        seen = tuple(total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tips = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tips)
