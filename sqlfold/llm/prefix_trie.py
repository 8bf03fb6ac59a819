"""Prefix trie of conversations, screened by a count-min sketch.

Every prefix of a conversation has a digest that chains those of its turns. A count-min
sketch over all prefix digests never estimates too low, so an estimate of one proves that no
other conversation has the prefix: from there on a conversation is a chain of its own, and its
nodes are emitted where they lie. Only prefixes that may be shared are shuffled, and
grouped exactly. What is asked of a node's subtree is a sum over the node's members, as each
conversation owns the nodes whose smallest member it is, from one depth on: no subtree is
ever gathered, and the work is one row per conversation and shared turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Cells of a sketch row per prefix, and the most a row may have: 4 MB a row at two rows.
CELLS, MOST_CELLS = 4, 1 << 22
_BLOCK = 1 << 16
#: A node with more than 1 / HEAVY of all rows is one of fewer than HEAVY nodes.
HEAVY = 1000


def turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, x, chars) of each row: ``x`` is a digest of role and text (null: empty). Rows
    without a conversation's id belong to no conversation and have none."""
    common.session(df)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    x = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), x.alias("x"), F.char_length(text).cast("long").alias("chars"))
    return rows.where("conv is not null")


def regrown(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Rows of :func:`turns` with every conversation c rebuilt: the first h turns of the conversation
    c - c % ``group`` (all if fewer, none if absent), then its own after its first h; h is the
    CRC-32 of c's digits modulo ``most``. Order: ``part`` (0: taken over), turn (null first), x."""
    rows = common.stage(rows, "turns")
    convs = rows.select("conv").distinct().withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "x"))
    # at most ``most`` - 1 turns of every ``group``-th conversation
    heads = rows.where(F.col("conv") % group == 0).withColumn("place", place).where(F.col("place") < most)
    heads = heads.select(F.col("conv").alias("lead"), "place", "x", "chars")
    taken = convs.withColumn("lead", F.col("conv") - F.col("conv") % group).join(heads, "lead").where("place <= h")
    kind = rows.schema["turn"].dataType
    taken = taken.select("conv", F.lit(0).alias("part"), F.lit(None).cast(kind).alias("turn"), "place", "x", "chars", "h")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = rows.select("conv", F.lit(1).alias("part"), "turn", F.lit(0).alias("place"), "x", "chars", h.alias("h"))
    return taken.unionByName(own)


_PREFIXES = "conv long, depth long, node binary, parent binary, turns long, rest long"


def _chained(batches):
    """One row per prefix of each conversation; holds the digests of one conversation."""
    now, own, nodes, chars = None, 0, [], []
    out: list[list] = [[] for _ in range(6)]

    def flush():
        rest = np.cumsum(chars[::-1])[::-1].tolist()  # code points from each turn on
        n = len(nodes)
        for column, values in zip(out, ([now] * n, range(n), nodes, [None, *nodes[:-1]], [n - 1] * n, rest)):
            column.extend(values)

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["conv", "depth", "node", "parent", "turns", "rest"])
        for column in out:
            column.clear()
        return made

    for b in batches:
        for conv, part, x, size, h in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv", "part", "x", "chars", "h"))):
            if conv != now:
                if nodes:
                    flush()
                now, own, nodes, chars = conv, 0, [hashlib.sha256(b"").digest()[:16]], [0]
            own += part
            if part and own <= h:
                continue
            nodes.append(hashlib.sha256(nodes[-1] + x).digest()[:16])
            chars.append(size)
        if len(out[0]) >= 10_000:
            yield batch()
    if nodes:
        flush()
    yield batch()


def _cells(column, width: int) -> np.ndarray:
    """The cells of 16-byte digests in the two rows of a sketch, side by side."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)
    return (words % np.uint64(width)).astype(np.int64) + np.array([0, width])


def _add(sketch: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Counts stop at two: more is not asked of them."""
    return np.minimum(sketch + more, 2).astype(np.uint8)


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the column ``node``: two rows of ``width`` cells, each 0, 1 or 2 (2 or more)."""

    def count(batches):
        own = np.zeros(2 * width, np.uint8)
        for b in batches:
            if b.num_rows:
                cell, n = np.unique(_cells(b.column(0), width), return_counts=True)
                own[cell] = _add(own[cell], np.minimum(n, 2).astype(np.uint8))
        for at in range(0, 2 * width, _BLOCK):
            block = own[at : at + _BLOCK]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block.tobytes()], pa.binary())], ["at", "block"])

    def merge(pdf):
        total = np.zeros(len(pdf["block"].iloc[0]), np.uint8)
        for block in pdf["block"]:
            total = _add(total, np.frombuffer(block, np.uint8))
        return pdf.iloc[:1].assign(block=[total.tobytes()])

    # one block of each task and range of cells: two merges by groups of tasks hold few blocks at a time
    blocks = prefixes.select("node").mapInArrow(count, "at long, block binary").withColumn("some", F.spark_partition_id() % 64)
    for keys in (["at", "some"], ["at"]):
        blocks = blocks.groupBy(*keys).applyInPandas(merge, blocks.schema)
    out = np.zeros(2 * width, np.uint8)
    for r in blocks.collect():  # 2 * width bytes in all
        out[r["at"] : r["at"] + len(r["block"])] = np.frombuffer(r["block"], np.uint8)
    return out


def _screened(prefixes: DataFrame, cells: np.ndarray, width: int) -> DataFrame:
    """Adds ``sure`` and ``parent_sure``: the sketch proves that one conversation alone has the prefix."""
    shared = prefixes.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            table = shared.value
            sure = [table[_cells(c, width)].min(axis=1) == 1 for c in (b.column(2), b.column(3).fill_null(b"\0" * 16))]
            sure[1] |= np.asarray(b.column(3).is_null())
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sure)], [*b.schema.names, "sure", "parent_sure"])

    return prefixes.mapInArrow(run, f"{_PREFIXES}, sure boolean, parent_sure boolean")


def _packed_ids(batches, most: int = 32_768):
    """Sorted rows (node, conv) to runs of one node: its ids, joined, with the first of them."""
    node, ids, size = None, [], 0
    rows: list[tuple] = []

    def batch():
        made = pa.RecordBatch.from_pylist(rows, pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))
        rows.clear()
        return made

    for b in batches:
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if n != node or size >= most:
                if ids:
                    rows.append({"node": node, "first": ids[0], "ids": ",".join(map(str, ids))})
                node, ids, size = n, [], 0
            ids.append(c)
            size += len(str(c)) + 1
        if len(rows) >= 500:
            yield batch()
    if ids:
        rows.append({"node": node, "first": ids[0], "ids": ",".join(map(str, ids))})
    yield batch()


def _hashed_ids(batches):
    """Runs of :func:`_packed_ids`, sorted, to one hash per node; holds one run."""
    node, state = None, None
    done: list[tuple] = []
    for b in batches:
        for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if n != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["node", "ends"])
            done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends"])


def _ends(rows: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of the conversations that end at a node, rising, comma-joined.

    The ids of a node that many share are joined where they are sorted, over many tasks; one task
    then hashes the joined runs, as a hash needs their order."""
    found = rows.where("depth = turns").select("node", "conv")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = found.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_packed_ids, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed_ids, "node binary, ends string")


def trie(rows: DataFrame, width: int | None = None) -> DataFrame:
    """One row per node of the trie of the conversations of ``rows`` (from :func:`regrown`):

    conv_id (smallest member), depth, parent_conv_id (the parent's; root: null), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members
    less one times code points of the node's last text), ends_sha256 (ids of the members that
    end there). ``width``: cells of a sketch row; by default by the rows, up to MOST_CELLS. It
    changes how much is shuffled, never the result. A conversation is chained by one task, which
    streams its turns' digests. An empty table gives an empty result.
    """
    common.session(rows)
    order = [F.col("conv"), F.col("part"), F.col("place"), F.col("turn").asc_nulls_first(), F.col("x")]
    chained = rows.repartition("conv").sortWithinPartitions(*order).select("conv", "part", "x", "chars", "h").mapInArrow(_chained, _PREFIXES)
    prefixes = common.stage(chained, "prefixes")
    total = prefixes.count()
    width = width or min(MOST_CELLS, max(1 << 10, 1 << (CELLS * total).bit_length()))
    screened = common.stage(_screened(prefixes, sketch(prefixes, width), width), "screened")
    common.unstage(prefixes)

    nobody = F.sha2(F.lit("").cast("binary"), 256)
    alone = [
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("turns"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nobody).alias("ends_sha256"),
    ]
    tails = screened.where("sure and parent_sure").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv"))).select(*alone)
    edges, shared = screened.where("sure and not parent_sure"), screened.where("not sure")

    groups = shared.groupBy("node").agg(F.min(F.struct("conv", "rest")).alias("own"), F.min("depth").alias("depth"), F.max("turns").alias("most"), F.count(F.lit(1)).alias("n"))
    groups = common.stage(groups.select("node", "depth", "n", "most", F.col("own.conv").alias("conv"), F.col("own.rest").alias("rest")), "nodes")
    # from which depth on a conversation owns its nodes, and whether it owns a leaf
    owners = groups.select("conv", "depth", "rest", (F.col("most") == F.col("depth")).alias("leaf"))
    owners = owners.unionByName(edges.select("conv", "depth", "rest", F.lit(True).alias("leaf")))
    owners = owners.groupBy("conv").agg(F.min(F.struct("depth", "rest")).alias("from"), F.max("leaf").alias("leaf"))
    own = F.col("from.depth")
    summed = shared.join(owners, "conv", "left").groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("turns") > F.col("depth")) & (own <= F.col("depth") + 1)).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(own <= F.col("depth"), 0).otherwise(F.col("rest") - F.coalesce("from.rest", F.lit(0)))).cast("long").alias("saved_tokens"),
        F.coalesce(F.max(own < F.col("depth")), F.lit(False)).alias("same_parent"),
    )
    summed = common.stage(summed.join(_ends(shared), "node", "left").withColumn("ends_sha256", F.coalesce("ends", nobody)).drop("node", "ends"), "summed")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    plain = summed.where("same_parent or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))

    # at most one node of each conversation has a parent that is not its own: it is looked up,
    # and parents of very many such nodes, fewer than HEAVY, are sent to every task
    heavy = F.col("n") * HEAVY > total
    parents = lambda which: groups.where(which).select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))

    def looked_up(branches: DataFrame) -> DataFrame:
        found = branches.join(F.broadcast(parents(heavy)), "parent", "left")
        rest = found.where("parent_conv_id is null").drop("parent_conv_id").join(parents(~heavy), "parent")
        return found.where("parent_conv_id is not null").unionByName(rest)

    branches = looked_up(summed.where("not same_parent and depth > 0"))
    return tails.unionByName(looked_up(edges).select(*alone)).unionByName(plain.select(*result)).unionByName(branches.select(*result))
