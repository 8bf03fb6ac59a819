"""SimHash near-duplicates by tiled exact comparison.

Fingerprints come from whole texts in one pass. Equal fingerprints are one
node from then on, so a group of exact copies costs one comparison however
large it is. Distinct fingerprints are cut into tiles by the population counts
of their four 16-bit quarters; two fingerprints within the radius differ by at
most the radius in the sum of those counts, so tile pairs that differ by more
are never formed. The remaining pairs are compared in full by exclusive-or and
bit counts; a task hands on at most one link per node, whatever the number of
matches.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, textvec

_QUARTERS = 4
_BLOCK = 100_000


def _fingerprints(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """64-bit fingerprints of texts, given as their bytes and offsets, as signed integers."""
    raw = textvec.lowered(raw)
    start, end, first_word = textvec.words(raw, offsets)
    n_words = np.diff(first_word)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    total = int(n_shingles.sum())
    counts = np.zeros((len(n_words), 64), np.int64)
    row_at = np.cumsum(n_shingles) - n_shingles
    for lo in range(0, total, _BLOCK):
        hi = min(total, lo + _BLOCK)
        rows = np.arange(np.searchsorted(row_at + n_shingles, lo, "right"), np.searchsorted(row_at, hi, "left"))
        rows = rows[n_shingles[rows] > 0]
        row = np.repeat(rows, np.minimum(row_at[rows] + n_shingles[rows], hi) - np.maximum(row_at[rows], lo))
        head = first_word[row] + np.arange(lo, hi) - row_at[row]
        tail = np.minimum(head + shingle, first_word[row + 1]) - 1
        a, z = int(start[head[0]]), int(end[tail[-1]])
        # the block's words, with one space after each in place of what separates them
        own = slice(int(head[0]), int(tail[-1]) + 1)
        width = end[own] - start[own] + 1
        to = np.cumsum(width) - width
        text = np.full(int(width.sum()), 0x20, np.uint8)
        solid = np.zeros(z - a + 1, np.int8)
        solid[start[own] - a] += 1
        solid[end[own] - a] -= 1
        keep = np.ones(len(text), bool)
        keep[to + width - 1] = False
        # words that touch (rows without a separator between them) cancel out in solid, and rightly
        text[keep] = raw[a:z][np.cumsum(solid[:-1], dtype=np.int8).astype(bool)]
        at = to[head - own.start]
        size = to[tail - own.start] + width[tail - own.start] - 1 - at
        bits = np.unpackbits(textvec.xxh64(text, at, size).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        counts[row[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > n_shingles[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(ones).view("<u8").ravel().view(np.int64)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """(id, fp, carried columns): one row per input row, in one pass over the texts without a shuffle.

    A-Z is lower-cased, words are runs of other than space and tab to carriage return, a
    shingle is ``shingle`` words joined by one space (repeats count; a text with fewer words
    is one shingle). A bit is set if more than half of the shingles' XXH64 (seed 42) have it.
    Null and wordless texts: fingerprint zero.
    """

    carry = carry or []

    def run(batches):
        for batch in batches:
            fp = np.concatenate([np.empty(0, np.int64), *[_fingerprints(raw, at, shingle) for raw, at in textvec.slices(batch.column(1))]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:]], ["id", "fp", *carry])

    common.session(df)
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *carry)
    fields = [f"id {picked.schema['id'].dataType.simpleString()}", "fp long", *[f"{c} {picked.schema[c].dataType.simpleString()}" for c in carry]]
    return picked.mapInArrow(common.lean(run), ", ".join(fields))


def _compare(radius: int):
    limit = np.uint8(min(radius, 64))

    def run(batches):
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        size = 0
        for pdf in batches:
            for x, y in zip(pdf["a_fp"], pdf["b_fp"]):
                strip = max(1, 500_000 // len(y))
                for lo in range(0, len(x), strip):
                    part = x[lo : lo + strip]
                    near = np.bitwise_count(part.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= limit
                    i, j = np.nonzero(near)
                    i, j = part[i], y[j]
                    own = i != j
                    if own.any():
                        held.append((i[own], j[own]))
                        size += int(own.sum())
                    if size > 500_000:
                        held = [common.spanning(*(np.concatenate(v) for v in zip(*held)))]
                        size = 0
        links = common.spanning(*(np.concatenate(v) for v in zip(*held)))
        yield pd.DataFrame({"a": links[0], "b": links[1]})

    return run


def links(prints: DataFrame, radius: int = 2, tile_rows: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (fp long) that connect all
    fingerprints at ``radius`` or fewer differing bits; not every such pair is listed."""
    width = 64 // _QUARTERS
    spread = prints.select("fp").distinct()
    mask = (1 << width) - 1
    side = 1 + width
    code = sum(F.bit_count(F.shiftrightunsigned("fp", q * width).bitwiseAND(F.lit(mask))).cast("long") * side**q for q in range(_QUARTERS))
    # tiles are many and mostly small: Spark gathers them, without a Python call for each
    tiles = common.number_tiles(spread.withColumn("counts", code), "counts", "fp", tile_rows).groupBy("counts", "tile").agg(F.collect_list("fp").alias("fp"))
    tiles = common.stage(tiles.withColumn("tile_id", F.concat_ws("/", "counts", "tile")), "simhash-tiles")
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=_QUARTERS) if sum(map(abs, d)) <= radius]
    steps = [d for d in steps if d >= (0,) * _QUARTERS]
    counts = [F.floor(F.col("counts") / side**q).cast("long") % side for q in range(_QUARTERS)]
    meta = tiles.select(F.col("tile_id").alias("a"), F.array(*counts).alias("at"))
    step = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in steps])).alias("step")
    near = meta.select("a", "at", step).select("a", F.zip_with("at", "step", lambda x, y: x + y).alias("to"))
    near = near.where(F.forall("to", lambda x: x.between(0, width)))
    near = near.select("a", sum(F.col("to")[q] * side**q for q in range(_QUARTERS)).alias("counts"))
    other = tiles.select(F.col("tile_id").alias("b"), "counts")
    # both orders of two tiles with equal counts come up: one of them is enough
    pairs = near.join(other, "counts").where((F.substring_index("a", "/", 1) != F.substring_index("b", "/", 1)) | (F.col("a") <= F.col("b"))).select("a", "b")
    packed = tiles.select("tile_id", "fp")
    return common.pair_up(pairs, packed, packed).select("a_fp", "b_fp").mapInPandas(_compare(radius), "a long, b long")


def _rooted(prints: DataFrame, radius: int, least: Column) -> DataFrame:
    """(fp, least, root): each distinct fingerprint of ``prints``, the smallest ``least`` of its
    rows, and the smallest fingerprint that chains of fingerprints within ``radius`` bits reach."""
    groups = prints.groupBy("fp").agg(F.min(least).alias("least"))
    comps = common.connected_components(links(prints, radius), spanned=True)
    return groups.join(comps, groups["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): one row per input row; ``component`` is the smallest id of the
    rows that chains of fingerprints within ``radius`` bits reach.

    Rows of equal id stay separate rows. A null id never names a component that has another
    id. An empty table gives an empty result.
    """
    prints = common.stage(fingerprints(df, id_col, text_col, shingle), "simhash")
    rooted = _rooted(prints, radius, F.col("id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def _row_key(df: DataFrame) -> Column:
    """Two hashes of the whole row, maps apart: rows of equal keys are the same row twice."""
    given = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    # a null leaves a hash as it is, so which columns are null is hashed as well
    nulls = F.concat(F.lit("-"), *[F.col(c).isNull().cast("int").cast("string") for c in given])
    return F.struct(F.xxhash64(*given, nulls).alias("a"), F.xxhash64(nulls, *given).alias("b"))


def representatives(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``df``, all columns, that stand for their groups: exactly one row of each.

    It is the row with the smallest id (null ids last), then the smallest hash of the row;
    other rows of its id stay if they stand for their own groups. Columns may have any names:
    a row travels as one column.
    """
    keyed = df.select(_row_key(df).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    narrow = keyed.select("key", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    prints = common.stage(fingerprints(narrow, "id", "text", shingle, ["key"]), "simhash")
    rooted = _rooted(prints, radius, F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    best = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("best"))
    again = prints.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    keep = common.stage(best.join(again, F.col("best") == F.col("key"), "left").drop("key"), "simhash-kept")
    common.unstage(prints)
    # the keys are the side that is hashed: texts are shuffled, but neither sorted nor held
    kept = keyed.join(keep.hint("shuffle_hash"), F.col("key") == F.col("best"))
    single = kept.where("copies is null")
    if not keep.where("copies is not null").isEmpty():
        single = single.unionByName(kept.where("copies is not null").dropDuplicates(["key"]))
    return single.select("row.*")
