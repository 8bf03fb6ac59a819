"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from sqlfold.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def plain(rows, target, share=25, least=20):
    """(id, n_features, weight, score, rank) of each row."""
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    n, m = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        words, own = features(x)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((len(words), [i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]))
    able = sorted((o for n, o in out if n >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    ranks = {id(o): k for k, o in enumerate(able[: share * len(able) // 100], 1)}
    return collections.Counter((*o, ranks.get(id(o))) for _, o in out)


def words(n, seed):
    return " ".join(np.random.default_rng(seed).choice(["Alpha", "beta", "é1", "x" * 64, "y" * 65, "z9", "of"], n))


@pytest.mark.parametrize("extra", [0, 1])
def test_equals_plain_python(spark, extra):
    rows = [(k, words(10 + k, k)) for k in range(60)]
    # nulls, empty and very long texts, words that touch row edges, ties and repeated rows
    rows += [(100, None), (101, ""), (102, "--- ..."), (103, words(60_000, 1)), (104, "q" * 300_000), (None, words(30, 2)), (None, words(30, 3))]
    rows += [(105, words(30, 4))] * 5 + [(105, words(30, 4).upper())] * 3
    target = [words(50, 9), "of of of", None, ""][: 4 if extra else 0]
    df = spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "id long, text string, score string, rank int")
    tdf = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(df.repartition(5), "id", "text", tdf, "text")
    assert collections.Counter((r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == plain(rows, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert resample.resample(none, "id", "text", none, "text").collect() == []
    one = resample.resample(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text", none, "text").collect()
    assert [(r["id"], r["n_features"], r["rank"]) for r in one] == [(1, 1, None)]


@pytest.mark.parametrize("hot", [False, True])
def test_cutoff_is_the_exact_key(spark, hot):
    rng = np.random.default_rng(4)
    rows = [(int(s), None if i % 9 == 0 else int(i % 50)) for i, s in enumerate(rng.integers(-40, 40, 3000))]
    if hot:  # a third of all rows share one key
        rows[:1000] = [(7, 3)] * 1000
    order = sorted((-s, i is None, i or 0) for s, i in rows)
    keys = spark.createDataFrame(rows, "score long, id long").repartition(9).cache()
    for draw in (1, 2, 1100, 2999, 3000):
        left = []
        c = resample.cutoff(keys, draw, few=10, rounds=left)
        assert (-c.score, c.id is None, c.id or 0) == order[draw - 1] and c.above == order.index(order[draw - 1])
        assert all(4 * b <= 3 * a for a, b in zip(left, left[1:]))  # a quarter goes each round
