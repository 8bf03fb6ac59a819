"""The trie of rebuilt conversations against plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from sqlfold.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth int"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - int(np.fmod(c, 100))
        built[c] = own.get(lead, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((
            min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(len(m) > len(n) and m[: len(n)] == n for m in below) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(spark, rows, width=None, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    told = prefix_trie.turns(df, "conv_id", "turn", "role", "text")
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.regrown(told), width).collect()), key=str)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(-130, -100, 7), *range(n), *range(500, 500 + n // 2), 5000, 5001, 5003]:
        common = int(rng.integers(0, 4))
        for t in range(int(rng.integers(1, 9))):
            text = f"shared {t}" if t < common or c % 3 == 0 else f"own {rng.integers(0, 3)} é" * int(rng.integers(0, 3))
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text, "x", 1))
    return rows


@pytest.mark.parametrize("width", [None, 1, 64])
def test_equals_plain_python(spark, width):
    rows = sample(90, 3)
    # null turns, roles and texts, ties, repeated rows, a conversation without an id, a very long one
    rows += [(7, None, None, None, "x", 1), (7, 0, "user", "tie", "x", 1), (7, 0, "user", "tie", "x", 1), (None, 0, "user", "lost", "x", 1)]
    rows += [(901, t, "user", "y" * (t % 5) + ("z" * 200_000 if t == 9 else ""), "x", 1) for t in range(300)]
    assert nodes(spark, rows, width) == plain(rows)


def test_a_third_of_all_conversations_are_equal(spark):
    rows = [(c, t, "user", f"t{t}" if c % 3 == 0 else f"c{c} {t}", "x", 1) for c in range(3000, 3400) for t in range(7)]
    assert nodes(spark, rows, 256) == plain(rows)


def test_edge_tables(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "a", "x", 1)]) == []
    one = [(3, 0, "user", "a", "x", 1)]
    assert nodes(spark, one) == plain(one)


def test_long_runs_of_ids_hash_like_one(spark):
    ids = list(range(-5, 9000))
    batches = [__import__("pyarrow").RecordBatch.from_pydict({"node": [b"n"] * len(ids), "conv": ids})]
    packed = list(prefix_trie._packed_ids(batches, most=1000))
    assert sum(b.num_rows for b in packed) > 10
    (done,) = prefix_trie._hashed_ids(packed)
    assert done.to_pylist() == [{"node": b"n", "ends": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}]
