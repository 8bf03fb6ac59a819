"""Repeated passages against a count of every string, and on planted cases."""

import collections
import hashlib

import numpy as np
import pytest

from sqlfold.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain(rows, length):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(hash(r[i : i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, np.int64)
        for k in range(len(r) - length + 1):
            if seen[hash(r[k : k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(r)] > 0
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def found(spark, rows, length, parts=4):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "id long, text string, key string, copies int").repartition(parts)
    got = suffix_dedup.strip_repeats(df, "id", "text", length)
    return collections.Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect())


def test_covers():
    for length in (16, 60, 400, 1000):
        period, residues = suffix_dedup.difference_cover(length)
        assert period < length and len({(a - b) % period for a in residues for b in residues}) == period


@pytest.mark.parametrize("length", [16, 40, 400])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh é"])
def test_equals_a_count_of_all_strings(spark, length, letters):
    rng = np.random.default_rng(length)
    word = lambda n: "".join(rng.choice(list(letters), n))
    passages = [word(int(n)) for n in rng.integers(length // 2, 3 * length, 12)]
    rows = []
    for i in range(60):
        parts = [word(int(rng.integers(0, length)))]
        for p in rng.choice(len(passages), int(rng.integers(0, 4))):
            a, z = sorted(rng.integers(0, len(passages[p]) + 1, 2)) if rng.random() < 0.3 else (0, None)
            parts += [passages[p][a:z], word(int(rng.integers(0, 2 * length)))]
        rows.append((i, "".join(parts)))
    near = word(6 * length)
    for i in range(100, 130):  # near copies, with edits at different places
        at = int(rng.integers(0, len(near)))
        rows.append((i, near[:at] + "#" + near[at + int(rng.integers(0, 3)) :]))
    rows += [(200, None), (201, ""), (202, "a" * (length - 1)), (203, "x" * length), (204, "xy" * length), (205, word(length)), (None, rows[3][1]), (None, rows[4][1] + "!")]
    rows += [(206, rows[5][1])] * 3  # copies, repeated rows
    assert found(spark, rows, length) == plain(rows, length)


def test_a_third_of_all_rows_share_text(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    hot, passage = word(900), word(450)
    rows = [(i, hot) for i in range(300)] + [(i, word(int(rng.integers(0, 300))) + passage + word(200)) for i in range(300, 600)] + [(i, word(700)) for i in range(600, 900)]
    assert found(spark, rows, 400, parts=9) == plain(rows, 400)


def test_long_text_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1000)
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 123, 30_000, dtype=np.uint8)
    raw[20_000:20_900] = raw[500:1400]
    place = suffix_dedup._sampled(np.array([0, 12_345, len(raw)]), 183, suffix_dedup.difference_cover(400)[1], 218)
    assert place.tolist() == [i for i in range(len(raw)) if (i - 12_345 * (i >= 12_345)) % 183 in set(suffix_dedup.difference_cover(400)[1].tolist()) and (12_345 if i < 12_345 else len(raw)) - i >= 218]
    f = suffix_dedup.prints(raw, np.arange(len(raw) - 400), 400)
    assert (f[20_000:20_501] == f[500:1001]).all() and len(np.unique(f)) == len(f) - 501


def test_empty_table(spark):
    assert not found(spark, [], 400)


def test_query_equals_a_count_of_all_strings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_suffix_array(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = plain([tuple(r) for r in docs], 400)
    assert collections.Counter(tuple(r) for r in got.collect()) == want and sum(r[2] > 0 for r in want) > 20
