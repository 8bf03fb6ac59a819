"""Quality classifier from weak labels.

Heuristic labellers vote junk, clean or abstain on each document, from shares that one
vectorised pass over the texts computes. Expectation-maximisation over the counts of vote
patterns (all documents count; a pattern is at most 3 ** labellers rows) estimates how
often each labeller votes what on junk and on clean documents, within the bounds that
``estimate`` sets: a labeller that alone calls many documents junk is believed. The posterior labels of a
bounded sample train a linear scorer on hashed features of words, word shapes and
repetitions, which then scores every document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, textvec

#: Shares of a document's words, and the values at and beyond which a labeller votes
#: (clean at or below the first, junk at or above the second; abstains between).
LABELLERS = {
    "symbol_ends": (0.02, 0.2),  # words that end in a symbol no sentence ends in
    "bare": (0.02, 0.15),  # words without a letter or digit
    "capitals": (0.1, 0.4),  # words of capitals only
    "shouts": (0.01, 0.15),  # words with two exclamation marks
    "repeats": (0.02, 0.15),  # words that equal the one before
    "echoes": (0.1, 0.4),  # runs of three words seen before in the document
    "long_words": (0.02, 0.2),  # words of more than 30 bytes
}
_STATS = [*LABELLERS]
#: Words of no kind that every document is taken to have besides its own: a few words tell little.
_EXTRA = 8
#: A labeller's largest share of junk votes among clean documents.
_FALSE = 0.002

#: Feature space: word shapes, then words, then repetition flags.
SHAPES, WORDS, FLAGS = 1024, 3064, 8
DIMENSIONS = SHAPES + WORDS + FLAGS

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*%#$&|~^@<>{}=+_\\/`"]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("a")


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> dict:
    """Words of a batch with what labellers and features need of each."""
    start, end, first = textvec.words(raw, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = textvec.xxh64(textvec.lowered(raw), start, end - start)

    def inside(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return upto[end] - upto[start]

    capital = (raw >= 65) & (raw <= 90)
    small = (raw >= 97) & (raw <= 122)
    shout = np.zeros(len(raw), bool)
    shout[:-1] = (raw[:-1] == 33) & (raw[1:] == 33)
    capitals = inside(capital)
    repeats = np.zeros(len(start), bool)
    repeats[1:] = (low[1:] == low[:-1]) & (row[1:] == row[:-1])
    with np.errstate(over="ignore"):
        run = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (np.roll(low, -1) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.roll(low, -2) * np.uint64(0x165667B19E3779F9))
        run = run + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    echoes = np.ones(len(start), bool)
    echoes[np.unique(run, return_index=True)[1]] = False
    whole = np.zeros(len(start), bool)
    whole[: max(0, len(start) - 2)] = row[2:] == row[: max(0, len(start) - 2)]
    return {
        "start": start, "end": end, "first": first, "row": row, "low": low,
        "symbol_ends": _SYMBOL[raw[end - 1]] if len(end) else np.zeros(0, bool),
        "bare": inside(_ALNUM[raw]) == 0,
        "capitals": (capitals >= 2) & (inside(small) == 0),
        "shouts": inside(shout) > 0,
        "repeats": repeats, "echoes": echoes & whole, "long_words": end - start > 30,
    }


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return upto[first[1:]] - upto[first[:-1]]


def _shares(t: dict) -> np.ndarray:
    """[document, labeller]"""
    return np.stack([_per_row(t[s], t["first"]) for s in _STATS], axis=1) / (np.diff(t["first"]) + _EXTRA)[:, None]


def _features(raw: np.ndarray, t: dict) -> list[np.ndarray]:
    """Feature numbers of each word: its shape, itself, and what it repeats."""
    if not len(t["end"]):
        return [np.zeros(0, np.int64)] * 3
    shape = np.concatenate([np.zeros(4, np.uint8), _SHAPE[raw]])
    last = np.ndarray((len(shape) - 3,), "<u4", shape, strides=(1,))[t["end"]]
    short = np.minimum(4, t["end"] - t["start"]).astype(np.uint32)
    last = last >> ((4 - short) * 8).astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = (last.astype(np.uint64) * np.uint64(256) + _SHAPE[raw[t["start"]]]) * np.uint64(0x9E3779B97F4A7C15)
    flags = t["repeats"] + 2 * t["echoes"] + 4 * t["bare"]
    return [(mixed >> np.uint64(40)).astype(np.int64) % SHAPES, SHAPES + (t["low"] % np.uint64(WORDS)).astype(np.int64), SHAPES + WORDS + flags]


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_words, one share per labeller), one row per document, in one pass; ``key`` is the
    MD5 of the text."""

    def run(batches):
        for batch in batches:
            counts, shares = [np.zeros(0, np.int64)], [np.zeros((0, len(_STATS)))]
            for raw, at in textvec.slices(batch.column(1)):
                t = _tokens(raw, at)
                counts.append(np.diff(t["first"]))
                shares.append(_shares(t))
            n, s = np.concatenate(counts), np.concatenate(shares)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), *[pa.array(s[:, i]) for i in range(len(_STATS))]], ["id", "key", "n_words", *_STATS])

    text = F.col(text_col).cast("string")
    picked = df.select(F.col(id_col).alias("id"), text.alias("text"), _key(text).alias("key"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(common.lean(run), f"id {kind}, key binary, n_words long, " + ", ".join(f"{s} double" for s in _STATS))


def votes(stats: DataFrame) -> DataFrame:
    """Add ``votes``: a letter per labeller, j(unk), c(lean) or a dot; no words: all dots."""
    letter = [F.when(F.col("n_words") == 0, ".").when(F.col(s) >= hi, "j").when(F.col(s) <= lo, "c").otherwise(".") for s, (lo, hi) in LABELLERS.items()]
    return stats.withColumn("votes", F.concat(*letter))


def estimate(patterns: list[tuple[str, int]], rounds: int = 500) -> tuple[dict[str, float], np.ndarray]:
    """Posterior probability of junk per pattern, and P(junk, clean | class, voted) as
    [class, labeller, vote]; an abstention tells nothing.

    Class 0 is clean. Junk comes in kinds, one class for each labeller, that starts as what
    the labeller calls junk. Two limits fix what the classes mean: a labeller calls most of
    its own kind junk, and at most ``_FALSE`` of the clean documents.
    So documents of one source that trip one labeller are junk, whatever the others vote.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {}, np.zeros((0, 0, 2))
    code = np.array([["jc.".index(v) for v in p] for p, _ in patterns])
    many = np.array([n for _, n in patterns], float)
    n_labellers = code.shape[1]
    hot = np.eye(3)[code][:, :, :2]
    calls = (code == 0).astype(float)
    any_junk = calls.any(axis=1)
    kinds = np.where(any_junk[:, None], 0.95 * calls / np.maximum(1, calls.sum(axis=1))[:, None], 0.02 / n_labellers)
    post = np.concatenate([1 - kinds.sum(axis=1, keepdims=True), kinds], axis=1)
    own = np.arange(n_labellers)
    for _ in range(rounds):
        weight = post * many[:, None]
        prior = (weight.sum(axis=0) + 0.5) / (many.sum() + 0.5 * (n_labellers + 1))
        table = np.einsum("pc,plv->clv", weight, hot) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        junk = table[:, :, 0]
        junk[0] = np.minimum(junk[0], _FALSE)
        junk[own + 1, own] = np.maximum(junk[own + 1, own], 0.5)
        table[:, :, 1] = 1 - junk
        score = np.log(prior)[None, :] + np.einsum("clv,plv->pc", np.log(table), hot)
        new = np.exp(score - score.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-9:
            break
    return {p: float(1 - v) for (p, _), v in zip(patterns, post[:, 0])}, table


def _vectors(batches):
    for batch in batches:
        rows = []
        for raw, at in textvec.slices(batch.column(1)):
            t = _tokens(raw, at)
            n = np.diff(t["first"])
            m = np.zeros((len(n), DIMENSIONS), np.float32)
            for f in _features(raw, t):
                np.add.at(m, (t["row"], f), 1.0)
            m /= (n + 2 * _EXTRA)[:, None]
            rows += [r.tobytes() for r in m]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["junk", "x"])


def fit(x: np.ndarray, junk: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps on balanced classes; (weights, bias)."""
    scale = 1 / np.maximum(np.sqrt((x * x).mean(axis=0)), 1e-3)
    z = x * scale.astype(np.float32)  # products in single precision: in double, numpy would copy z each time
    weight = np.where(junk, 0.5 / max(1, junk.sum()), 0.5 / max(1, (~junk).sum()))
    y = junk.astype(float)
    rate = 4.0 / (float(weight @ np.einsum("ij,ij->i", z, z)) + 1)
    w = v = np.zeros(x.shape[1])
    b = vb = 0.0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v.astype(np.float32) + vb, -50, 50)))
        g = weight * (p - y)
        w2, b2 = v - rate * (g.astype(np.float32) @ z + penalty * v), vb - rate * g.sum()
        step = k / (k + 3)
        v, vb = w2 + step * (w2 - w), b2 + step * (b2 - b)
        w, b = w2, b2
    return w * scale, float(b)


class Model:
    """Weights of the scorer, with what was estimated on the way."""

    def __init__(self, weights: np.ndarray, bias: float, posteriors: dict[str, float], table: np.ndarray):
        self.weights, self.bias, self.posteriors, self.table = weights, bias, posteriors, table

    def of(self, raw: np.ndarray, t: dict) -> np.ndarray:
        """Probability that a text is clean; 0 for texts without words."""
        n = np.diff(t["first"])
        total = sum(_per_row(self.weights[f], t["first"]) for f in _features(raw, t))
        p = 1 / (1 + np.exp(np.clip(total / (n + 2 * _EXTRA) + self.bias, -50, 50)))
        return np.where(n > 0, p, 0.0)

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.of(raw, _tokens(raw, at)) for raw, at in textvec.slices(column)]])


def train(df: DataFrame, id_col: str, text_col: str, sample: int = 1000) -> tuple[Model, DataFrame]:
    """A model from ``df`` alone, without labels, and the staged statistics with votes.

    The scorer is fitted on at most ``sample`` different texts of each class: those of the
    smallest hashes among posteriors of at least 0.9, whatever their ids. Votes and their
    accuracies come from all documents. Without a document of a class, the scorer calls everything the
    other class.
    """
    spark = common.session(df)
    stats = common.stage(votes(statistics(df, id_col, text_col)), "quality")
    patterns = [(r["votes"], r["n"]) for r in stats.where("n_words > 0").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()]
    posteriors, table = estimate(patterns)
    chosen = []
    for junk in (True, False):
        sure = [p for p, v in posteriors.items() if (v if junk else 1 - v) >= 0.9]
        rows = stats.where(F.col("votes").isin(sure) & (F.col("n_words") > 0)) if sure else stats.limit(0)
        # a text may have any number of rows: it counts once, and is read once
        chosen += [(r["key"], junk) for r in rows.select("key").distinct().orderBy("key").limit(sample).collect()]
    n_junk = sum(j for _, j in chosen)
    if n_junk in (0, len(chosen)):
        return Model(np.zeros(DIMENSIONS), 50.0 if n_junk else -50.0, posteriors, table), stats
    keys = F.broadcast(spark.createDataFrame(chosen, "key binary, junk boolean"))
    texts = df.select(F.col(text_col).cast("string").alias("text")).withColumn("key", _key(F.col("text")))
    once = texts.join(keys, "key").groupBy("key", "junk").agg(F.first("text").alias("text"))
    found = once.select("junk", "text").mapInArrow(_vectors, "junk boolean, x binary").collect()
    found.sort(key=lambda r: (r["junk"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found])
    weights, bias = fit(x, np.array([r["junk"] for r in found]))
    # fitted on as much junk as clean text; the corpus has them at the posteriors' odds
    share = min(0.5, max(0.01, sum(posteriors[p] * n for p, n in patterns) / sum(n for _, n in patterns)))
    return Model(weights, bias + math.log(share / (1 - share)), posteriors, table), stats


def keep_clean(df: DataFrame, text_col: str, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, all columns, that the model scores at ``threshold`` or above."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) >= threshold))

    return df.mapInArrow(common.lean(run), df.schema)


def classify(df: DataFrame, id_col: str, text_col: str, sample: int = 1000, threshold: float = 0.5) -> DataFrame:
    """(id, votes, posterior_junk, score, keep), one row per document.

    Null texts and texts without words score 0 and are not kept. An empty table gives an empty result.
    """
    model, _ = train(df, id_col, text_col, sample)

    def run(batches):
        for batch in batches:
            score, share, counts = [np.zeros(0)], [np.zeros((0, len(_STATS)))], [np.zeros(0, np.int64)]
            for raw, at in textvec.slices(batch.column(1)):
                t = _tokens(raw, at)
                counts.append(np.diff(t["first"]))
                share.append(_shares(t))
                score.append(model.of(raw, t))
            n, share, score = np.concatenate(counts), np.concatenate(share), np.concatenate(score)
            low, high = (np.array([v[i] for v in LABELLERS.values()]) for i in (0, 1))
            code = np.where(n[:, None] == 0, ".", np.where(share >= high, "j", np.where(share <= low, "c", ".")))
            rows = ["".join(r) for r in code]
            post = [model.posteriors.get(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string()), pa.array(post, pa.float64()), pa.array(score), pa.array(score >= threshold)], ["id", "votes", "posterior_junk", "score", "keep"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(common.lean(run), f"id {kind}, votes string, posterior_junk double, score double, keep boolean")
