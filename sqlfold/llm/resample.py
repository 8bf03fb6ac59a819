"""Target-distribution importance resampling of documents.

A document's weight is the mean log ratio of its hashed unigrams and bigrams between a
target corpus and the documents themselves; with Gumbel noise on top, the highest scores are
a sample without replacement in proportion to the weights. Features are hashed and scored as
whole arrays. The cutoff key of the draw is found by weighted median-of-medians: each
partition tells the median of the keys it has left, their median weighted by the partitions'
sizes is the pivot, and what lies on its wrong side is discarded, at least a quarter each
round. Only the winners are sorted.
"""

from __future__ import annotations

import itertools
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common, textvec

_LONGEST = 64  # bytes of words that are hashed as arrays; longer ones go one by one
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 by one byte, and for each n up to _LONGEST + 1 what n zero bytes make of each register byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    over = [now]
    for _ in range(_LONGEST + 1):
        now = step[now & 0xFF] ^ (now >> np.uint32(8))
        over.append(now)
    return step, np.stack(over)


_STEP, _OVER = _tables()


def _crc_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of ``raw``, all spans of one length at a time."""
    out = np.empty(len(start), np.uint32)
    kind = np.minimum(size, _LONGEST + 1).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=_LONGEST + 2))
    for n in np.unique(kind):
        at = order[(ends[n - 1] if n else 0) : ends[n]]
        if n > _LONGEST:
            for i in at:
                out[i] = zlib.crc32(raw[start[i] : start[i] + size[i]])
            continue
        register, p = np.full(len(at), 0xFFFFFFFF, np.uint32), start[at]
        for k in range(int(n)):
            register = _STEP[(register ^ raw[p + k]) & 0xFF] ^ (register >> np.uint32(8))
        out[at] = ~register
    return out


def _joined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of x + y from those of x and y and the bytes of y."""
    for k in range(4):
        b = b ^ _OVER[size, k, (a >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return b


_SPACE = np.uint32(zlib.crc32(b" "))


def _hashed(raw: np.ndarray, offsets: np.ndarray, longest_run: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For runs of 1 to ``longest_run`` words: CRC-32 of each and the row it lies in; and each row's word count."""
    raw = textvec.lowered(raw)
    solid = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    cut = np.diff(solid, prepend=False, append=False)
    both = edge[:-1] & solid
    both[1:] &= solid[:-1]
    both[:1] = False
    start = np.flatnonzero((cut[:-1] & solid) | both)
    end = np.sort(np.concatenate([np.flatnonzero(cut[1:] & solid) + 1, np.flatnonzero(both)]))
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    size = end - start
    single = _crc_of(raw, start, size)
    hashes, rows = [single], [row]
    run = single
    for k in range(1, longest_run):
        # the run so far, one space, and the word k places on
        run = run[:-1] if len(run) else run
        nxt, long = single[k:], size[k:]
        spaced = _joined(run, np.full(len(run), _SPACE), np.ones(len(run), np.int64))
        run = _joined(spaced, nxt, np.minimum(long, _LONGEST))
        for i in np.flatnonzero(long > _LONGEST):
            run[i] = zlib.crc32(raw[start[i + k] : end[i + k]], int(spaced[i]))
        same = row[k:] == row[: len(row) - k] if len(row) > k else np.zeros(len(run), bool)
        hashes.append(run[same])
        rows.append(row[k:][same] if len(row) > k else row[:0])
    return hashes, rows, np.diff(first)


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest_run: int) -> np.ndarray:
    """How often features of ``df`` fall into each bucket. Each task sums its own texts into one
    array; what reaches the driver has ``buckets`` numbers, however large the table is."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw, at in textvec.slices(batch.column(0)):
                for h in _hashed(raw, at, longest_run)[0]:
                    total += np.bincount(h % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored log ratio of each bucket's smoothed shares of the target and of the source, times ``scale``."""
    n = float(len(source))
    ratio = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weigh(df: DataFrame, id_col: str, text_col: str, gain: np.ndarray, longest_run: int) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each row's features (none: 0)."""

    def run(batches):
        for batch in batches:
            words, features, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for raw, at in textvec.slices(batch.column(1)):
                hashes, rows, n = _hashed(raw, at, longest_run)
                count, total = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                for h, r in zip(hashes, rows):
                    count += np.bincount(r, minlength=len(n))
                    prefix = np.concatenate([[0], np.cumsum(gain[h % np.uint32(len(gain))])])
                    edge = np.searchsorted(r, np.arange(len(n) + 1))
                    total += prefix[edge[1:]] - prefix[edge[:-1]]
                words.append(n)
                features.append(count)
                weight.append(total // np.maximum(count, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.concatenate(x)) for x in (words, features, weight)]], ["id", "n_words", "n_features", "weight"])

    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


class Cutoff(NamedTuple):
    """The last key drawn: rows above it are all drawn, of those equal to it as many as are left."""

    score: int
    id: int | None
    above: int


def cutoff(keys: DataFrame, draw: int, few: int = 2_000, rounds: list | None = None) -> Cutoff:
    """The ``draw``-th key of ``keys`` (score long, id long) in the order of falling score, then
    rising id, null last. 1 <= draw <= rows. ``rounds`` gets the rows left after each round.

    The keys between two bounds are left in each round; every partition gives the median of its
    own and how many it has. Half of the partitions' weight has medians on either side of their
    weighted median, and half of each of these partitions' keys lie beyond, so either side
    of the pivot has a quarter of the keys at least. At ``few`` keys or less, or when all left
    are equal, those left are read.
    """
    # one number orders ids: null comes after all
    keys = keys.select((-F.col("score")).alias("s"), F.col("id").isNull().cast("int").alias("z"), F.coalesce("id", F.lit(0).cast("long")).alias("i"))
    low = high = None  # both outside of what is left

    def medians(batches):
        parts = [np.empty((0, 3), np.int64)]
        for b in batches:
            parts.append(np.stack([np.asarray(b.column(k)).astype(np.int64) for k in range(3)], axis=1))
        left = np.concatenate(parts)
        if len(left):
            order = np.lexsort((left[:, 2], left[:, 1], left[:, 0]))
            s, z, i = left[order[(len(left) - 1) // 2]].tolist()
            yield pa.RecordBatch.from_pylist([{"s": s, "z": z, "i": i, "n": len(left)}])

    own = F.struct("s", "z", "i")

    def as_key(edge):
        return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(edge, ("long", "int", "long"), "szi")])

    above = 0  # keys before those left
    while True:
        left = keys
        if low is not None:
            left = left.where(own > as_key(low))
        if high is not None:
            left = left.where(own < as_key(high))
        told = sorted((tuple(r[c] for c in "szi"), r["n"]) for r in left.mapInArrow(medians, "s long, z long, i long, n long").collect())
        total = sum(n for _, n in told)
        if rounds is not None:
            rounds.append(total)
        if total <= few:
            rest = sorted(tuple(r[c] for c in "szi") for r in left.collect())
            s, z, i = rest[draw - above - 1]
            return Cutoff(-s, None if z else i, above + rest.index((s, z, i)))
        reach = itertools.accumulate(n for _, n in told)
        pivot = next(key for (key, _), r in zip(told, reach) if 2 * r >= total)
        n_less, n_same = left.agg(F.count_if(own < as_key(pivot)), F.count_if(own == as_key(pivot))).first()
        if draw - above <= n_less:
            high = pivot
        elif draw - above <= n_less + n_same:
            s, z, i = pivot
            return Cutoff(-s, None if z else i, above + n_less)
        else:
            low, above = pivot, above + n_less + n_same


def _ranked(winners: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 1 in a total order: ranges are sorted each by itself and placed by their counts."""
    spark = winners.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = common.stage(winners.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "winners")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(counts), "_range").withColumn(name, number.cast("long")).drop("_range", "_before")


def resample(df: DataFrame, id_col: str, text_col: str, target: DataFrame, target_text: str, share: float = 0.25, seed: int = 7, buckets: int = 10_000, longest_run: int = 2, least_words: int = 20, scale: int = 1000) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row per row of ``df``.

    A-Z is lower-cased; words are runs of 0-9, a-z and all characters beyond ASCII; features
    are runs of 1 to ``longest_run`` words joined by one space, in buckets by CRC-32. Of the
    rows with ``least_words`` or more words, the ``share`` (floored) of highest score is drawn
    and ranked from 1; others have a null rank. Noise depends on ``seed`` and the id.

    Null and wordless texts have no features, weight 0, and are never drawn. Ties go to the
    smaller id, null last (a null id's noise is that of an empty id); rows that repeat an id
    and a score are drawn as they come, as many as there is room for. ``id_col`` must be an integer.
    Empty tables give an empty result; an empty target is a target without features.
    """
    common.session(df)
    source, wanted = (bucket_counts(t, c, buckets, longest_run) for t, c in ((df, text_col), (target, target_text)))
    weighed = weigh(df, id_col, text_col, gains(source, wanted, scale), longest_run)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log(uniform)))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
    # the row number is written once, so it can settle which of equal rows is drawn
    scored = common.stage(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    draw = int(scored.where(able).count() * round(share * 100) // 100)
    drawn = F.lit(None).cast("long").alias("rank")
    columns = ["id", "n_words", "n_features", "weight", "score"]
    if not draw:
        return scored.select(*columns, drawn)
    last = cutoff(scored.where(able).select("score", F.col("id").cast("long").alias("id")), draw)
    key = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().cast("int").alias("z"), F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")).alias("i"))
    edge = F.struct(F.lit(-last.score).cast("long").alias("s"), F.lit(int(last.id is None)).alias("z"), F.lit(last.id or 0).cast("long").alias("i"))
    wins = able & (key <= edge)
    ranked = _ranked(scored.where(wins), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_row")], "rank")
    ranked = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return scored.where(~wins).select(*columns, drawn).unionByName(ranked)
