"""Operators on tables: components, near copies, searches, packing, mixing, shards."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sqlfold.llm import common, embed_join, mixing, packing, queries, sharding, simhash, textvec, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closure(ids, linked):
    """Smallest id that each id reaches over the boolean matrix ``linked``."""
    lab = np.array(ids)
    linked = linked | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(linked, lab[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == lab).all():
            return lab.tolist()
        lab = new


# --- helpers ---------------------------------------------------------------------------------


def test_xxh64_equals_the_library():
    rng = np.random.default_rng(1)
    spans = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [*range(0, 140), 200, 5000, 31, 32, 33] * 2]
    raw = np.frombuffer(b"".join(spans), np.uint8)
    size = np.array([len(s) for s in spans])
    got = textvec.xxh64(raw, np.cumsum(size) - size, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


@pytest.mark.parametrize("shape", ["random", "path", "star", "pairs"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    n = 400
    a, b = {
        "random": (rng.integers(0, n, 380), rng.integers(0, n, 380)),
        "path": (p := rng.permutation(n), np.roll(p, 1)),
        "star": (np.full(n, 7), np.arange(n)),
        "pairs": (np.arange(0, n, 2), np.arange(1, n, 2)),
    }[shape]
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in common.connected_components(links).collect()}
    m = np.zeros((n, n), bool)
    m[a, b] = m[b, a] = True
    want = closure(list(range(n)), m)
    assert all(got.get(i, i) == want[i] for i in range(n))
    nodes, root = common.roots(np.asarray(a), np.asarray(b))
    assert all(want[i] == r for i, r in zip(nodes, root))


def test_components_of_nothing(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- simhash ------------------------------------------------------------------------------------


def fingerprint(text, shingle=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    own = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(rows, texts, radius):
    prints = [fingerprint(t) for _, t in texts]
    assert sorted((r["fp"] & (2**64 - 1)) for r in rows) == sorted(prints)
    v = np.array(prints, np.uint64)
    want = dict(zip([i for i, _ in texts], closure([i for i, _ in texts], np.bitwise_count(v[:, None] ^ v[None, :]) <= radius)))
    assert {r["id"]: r["component"] for r in rows} == want


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = simhash.near_duplicates(docs, "doc_id", "text").collect()
    check_simhash(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2)


def test_simhash_large_groups_in_small_tiles(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        words = list(base)
        if i % 3:
            words[int(rng.integers(300))] = f"x{i}"
        texts.append((i, " ".join(words) if i < 120 else f"other text number {i} " * 3))
    df = spark.createDataFrame(texts, "id long, text string")
    prints = common.stage(simhash.fingerprints(df, "id", "text"), "t")
    found = {r["node"]: r["root"] for r in common.connected_components(simhash.links(prints, 3, tile_rows=16)).collect()}
    v = np.array(sorted({r["fp"] for r in prints.collect()}))
    near = np.bitwise_count(v.view(np.uint64)[:, None] ^ v.view(np.uint64)[None, :]) <= 3
    assert [found.get(x, x) for x in v.tolist()] == closure(v.tolist(), near)


def test_simhash_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "A\x0bb", 5), (None, "a b", 5), (4, "é" * 3000 + " É x y", 5), (4, "é" * 3000 + "  É\tx y", 5), (5, "a  b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["id"] is None, r["id"] or 0), r["component"]) for r in simhash.near_duplicates(df, "doc_id", "text").collect())
    assert [c for _, c in got] == [1, 1, 3, 4, 4, 3, 3]
    kept = simhash.representatives(df, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").collect() == []
    assert simhash.representatives(df.limit(0), "doc_id", "text").collect() == []


def test_columns_of_any_name_come_back(spark):
    names = ["doc_id", "text", "_row_a", "_row_b", "_copies", "_keep_row_a", "key", "row", "best", "copies", "id", "fp", "a.b", "root"]
    rows = [(k // 2, f"one two three {k // 4}", *[f"{n}{k}" for n in names[2:]]) for k in range(24)]
    df = spark.createDataFrame([*rows, rows[0]], names)
    got = simhash.representatives(df, "doc_id", "text")
    assert got.columns == names and {tuple(r) for r in got.collect()} <= set(rows) and got.count() == 6


def test_one_row_of_each_group_stays(spark):
    """Whatever the ids: missing, repeated over groups, or of a copy and a leader."""
    words = lambda k: " ".join(f"{k}word{i}" for i in range(40))
    rows = [(None, words("a"), 1), (None, words("b"), 1), (None, words("b"), 1), (None, None, 1), (None, words("c"), None), (8, words("c"), 2)]
    rows += [(1, words("d"), 1), (1, words("e"), 1), (2, words("d"), 1), (2, words("f"), 1), (3, words("g"), 1), (3, words("g"), 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted((r["text"] or "", r["doc_id"]) for r in simhash.representatives(df, "doc_id", "text").collect())
    assert [t for t, _ in kept] == ["", *[words(k) for k in "abcdefg"]]
    assert [i for _, i in kept] == [None, None, None, 8, 1, 1, 2, 3]


def test_simhash_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    texts = ["a b c d e f g h i j k l m n o p q r s t", "", "x", "x y", "one two three four  five\nsix seven", "b c d e f g h i"]
    import pyarrow as pa

    raw, at = textvec.text_bytes(pa.array(texts))
    assert [int(x) & (2**64 - 1) for x in simhash._fingerprints(raw, at, 3)] == [fingerprint(t) for t in texts]


# --- embeddings ---------------------------------------------------------------------------------


def vectors_with_groups(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[: n // 3] = x[0] + 0.18 * rng.normal(size=(n // 3, dim))  # a third of the rows around one point
    x[n // 3 : n // 3 + 20] = x[n // 2]  # exact copies
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("cell_rows,max_pivots", [(32, 1024), (50, 2), (1000, 1)])
def test_range_join_equals_brute_force(spark, cell_rows, max_pivots):
    x = vectors_with_groups(2, 240, 12)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, node int")
    got = embed_join.range_join(df, "vec_id", "embedding", 0.9, cell_rows=cell_rows, max_pivots=max_pivots).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = closure(list(range(len(x))), near)
    assert sorted((r["id"], r["n_links"], r["component"]) for r in got) == [(i, int(near[i].sum()), comp[i]) for i in range(len(x))]
    assert near.sum() > 2000


ODD = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1]), (7, [1.0, 0.0]), (None, [2.0, 0.0]),
       (8, [1e300, 1e300]), (9, [1.0, 1.0]), (10, [1.0]), (20, []), (40, [3.0, 2.0]), (40, [3.0, 2.0])]


def test_range_join_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    got = sorted((r["id"] or 0, r["n_links"], r["component"]) for r in embed_join.range_join(df, "vec_id", "embedding").collect())
    assert got == [(0, 3, 5), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 3, 5), (6, 3, 5), (7, 3, 5), (8, 3, 8), (9, 3, 8), (10, 0, 10), (20, 0, 20), (40, 3, 8), (40, 3, 8)]
    assert embed_join.range_join(df.limit(0), "vec_id", "embedding").collect() == []


@pytest.mark.parametrize("k", [3, 20])
def test_top_k_equals_brute_force(spark, k):
    x = np.round(vectors_with_groups(4, 230, 6), 1)  # many equal scores
    df = spark.createDataFrame([(int(i) * 5, v.tolist(), 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score double")
    got = topk.top_k(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=k, query_rows=16, tile_rows=13).collect()
    z, ids = np.floor(64 * x), np.arange(len(x)) * 5
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = (z @ z[i]).astype(int)
        best = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        want += [(int(ids[i]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=3).collect()))
    # repeated rows are candidates of each other; 1e300 is beyond a long and held at its end
    assert got == [(40, 1, 8, 2**63 - 1)] * 2 + [(40, 2, 40, 53248)] * 2 + [(40, 3, 9, 20480)] * 2
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 20 == 0).collect() == []
    few = df.where("vec_id in (5, 6, 40)").dropDuplicates(["vec_id"])
    assert topk.top_k(few, "vec_id", "embedding", F.col("id") == 40, k=20).count() == 2


# --- packing ------------------------------------------------------------------------------------


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


def check_pieces(p, want, capacity=1024):
    for doc, g in p.sort_values("start").groupby("id"):
        assert b"".join(g["ids"]) == want[doc].tobytes()
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and (g["doc_tokens"] == len(want[doc])).all()
        assert [zlib.crc32(x) for x in g["ids"]] == g["crc32"].tolist()
    assert set(p["id"]) == set(want)
    s = p.sort_values(["sequence_id", "offset"])
    by = s.groupby("sequence_id")["length"]
    assert (s["offset"] == by.cumsum() - s["length"]).all() and by.sum().max() <= capacity
    assert s["sequence_id"].nunique() == s["sequence_id"].max() + 1


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = packing.pack(docs, "doc_id", "text").toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_pieces(p, dict(zip(texts, token_ids(texts.values()))))
    full = p["length"].groupby(p["sequence_id"]).sum()
    # beside one unfinished sequence per class, a sequence wastes at most its class's share
    assert (full < 1024 - 8).sum() <= len(packing.classes(1024, 1 / 128))


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_packing_small_capacities(spark, capacity):
    texts = {i: "word " * i + "é\n  <|endoftext|>" * (i % 3) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    p = packing.pack(df, "id", "text", capacity=capacity).toPandas()
    check_pieces(p, dict(zip(texts, token_ids(texts.values()))), capacity)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2**60 + 1, "a", None)], "doc_id long, text string, length int")
    got = packing.pack(df, "doc_id", "text").collect()
    assert sorted((r["id"] or 0, r["doc_tokens"]) for r in got) == [(0, 1), (1, 1), (2**60 + 1, 2)]
    assert packing.pack(df.limit(0), "doc_id", "text").collect() == []
    twice = packing.pack(df.unionAll(df), "doc_id", "text", with_ids=False)
    assert twice.count() == 6 and "ids" not in twice.columns


def test_encoder_equals_the_tokenizer():
    import random

    import public_tokenizers

    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), held=50)
    r = random.Random(1)
    texts = ["".join(r.choice(" \n\t \x1c\x85　 ab's1!中é") for _ in range(r.randint(0, 14))) + r.choice(["", "<|endoftext|>", "'ll"]) for _ in range(3000)]
    assert enc.encode(texts) == [x[:-1].tobytes() for x in token_ids(texts)]


# --- mixing -------------------------------------------------------------------------------------


def water_fill(sizes, weights, share, cap):
    """Targets by repeated resharing of the excess."""
    total, capped = share * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [cap * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and t[i] > cap * sizes[i]}
        if not over:
            return t
        capped |= over


def test_mix_targets_and_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs, "doc_id", "text", "source", bucket_rows=3).toPandas()
    names = sorted(got["source"].unique())
    by = got.groupby("source")
    sizes = by["size"].sum()[names].tolist()
    want = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0)
    assert np.allclose(by["target"].first()[names], want) and by["source_size"].first()[names].tolist() == sizes
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert dict(zip(got["id"], got["size"])) == words
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    miss = (by["taken"].sum() - by["target"].first()).abs()
    assert (miss <= by["size"].max() / 2 + 1e-6).all()
    again = mixing.mix(docs.repartition(5), "doc_id", "text", "source", bucket_rows=50).toPandas()
    assert dict(zip(got["id"], got["copies"])) == dict(zip(again["id"], again["copies"]))


def test_mix_prefers_better_documents(spark):
    rows = [(i, "good words here now" if i % 2 else "b** $$$ %%% ###") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("source", F.lit("a"))
    got = mixing.mix(df, "id", "text", "source", share=0.5, cap=2.0).toPandas()
    odd = got["id"] % 2 == 1
    assert got["copies"][odd].mean() > 2 * got["copies"][~odd].mean()


def test_mix_odd_rows(spark):
    rows = [(1, None, "a", 1), (1, None, "a", 1), (2, "x y", None, 1), (None, "x y z", None, 1), (3, "", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df, "doc_id", "text", "source", carry=["size", "doc_id"]).collect()
    assert sorted((r["size"], r["source_size"], r["target"]) for r in got) == [(0, 0, 0.0)] * 3 + [(2, 5, 7.5), (3, 5, 7.5)]
    assert sorted(r["carry_doc_id"] or 0 for r in got) == [0, 1, 1, 2, 3]
    assert mixing.mix(df.limit(0), "doc_id", "text", "source").collect() == []


def test_mix_is_native(spark):
    plan = queries.op8_mix(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- shards ---------------------------------------------------------------------------------------


def check_shards(got, texts, n, slack):
    by = got.groupby("shard")
    assert by["slot"].max().tolist() == (by.size() - 1).tolist() and by["slot"].nunique().tolist() == by.size().tolist()
    for r in got.itertuples():
        raw = (texts[r.id] or "").encode()
        assert (r.size, r.crc32) == (len(raw) + 1, zlib.crc32(raw))
    even = got["size"].sum() / n
    assert (by["size"].sum() - even).abs().max() <= slack * even + got["size"].max()


def test_shards_are_even(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dims = [F.col("n_chars"), sharding.text_code(F.col("lang"))]
    got = sharding.kd_shards(docs, "doc_id", "text", dims, shards=8, bucket_rows=5).toPandas()
    check_shards(got, {r["doc_id"]: r["text"] for r in docs.collect()}, 8, 0.05)
    parted = got.groupby("crc32")["shard"].nunique()
    assert (parted > 1).sum() <= 7  # only a cut can part copies


def test_shards_of_one_hot_value(spark):
    texts = {i: "same" if i % 3 else f"text {i} " * (i % 7) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = sharding.kd_shards(df, "id", "text", [F.lit(5), F.lit(None)], shards=5).toPandas()
    check_shards(got, texts, 5, 0.05)
    byte = sharding.kd_shards(df, "id", "text", [F.length("text")], target_bytes=500).toPandas()
    assert byte["shard"].nunique() == -(-byte["size"].sum() // 500)


def test_shards_odd_rows_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "x", None), (3, "é", 2)], "doc_id long, text string, shard int")
    got = sharding.kd_shards(df, "doc_id", "text", [F.col("shard")], shards=2).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 3]
    assert sharding.kd_shards(df.limit(0), "doc_id", "text", [F.col("shard")], shards=2).collect() == []
    one = df.where("doc_id = 3").drop("shard")
    sharding.write_shards(one, "doc_id", sharding.kd_shards(one, "doc_id", "text", [F.length("text")], shards=1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["text"] == "é"


def test_shards_without_ids(spark):
    """No id, or one id on all rows: the texts tell rows apart."""
    for given in (None, 7):
        df = spark.createDataFrame([(given, f"text {i % 900}", i % 5) for i in range(1200)], "id long, text string, d int")
        got = sharding.kd_shards(df, "id", "text", [F.col("d")], shards=4, bucket_rows=10).toPandas()
        assert len(got) == 1200 and (got["size"] == got["crc32"].map({zlib.crc32(f"text {i}".encode()): len(f"text {i}") + 1 for i in range(900)})).all()
        for _, part in got.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
        by = got.groupby("shard")["size"].sum()
        assert (by - by.mean()).abs().max() <= 0.05 * by.mean()


def test_text_code_keeps_order(spark):
    words = [None, "", "a", "ab", "abc", "b", "é", "中", "src0", "src1", "src10"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "s string").select(sharding.text_code(F.col("s"))).collect()]
    order = sorted(range(1, len(words)), key=lambda i: words[i].encode())
    assert got[0] == -1 and [got[i] for i in order] == sorted(got[1:])


def test_mix_carries_rows_of_equal_places(spark):
    """Rows that repeat an id and a size lie at one place of the order: as many as fit are taken, whatever they carry."""
    rows = [(7, f"a b {k % 3}", "s", k) for k in range(30)] + [(None, "x y z", None, k) for k in range(9)] + [(k, "w " * (k % 4), "t", k) for k in range(100, 140)] + [(1, None, "u", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `size.x` int").repartition(4)
    narrow = mixing.mix(df, "doc_id", "text", "source", share=1.3).collect()
    wide = mixing.mix(df, "doc_id", "text", "source", share=1.3, carry=["text", "size.x", "source"])
    got = wide.collect()
    key = lambda r: (str(r["source"]), str(r["id"]), r["size"], r["copies"], r["taken"], r["target"], r["source_size"])
    assert sorted(map(key, got)) == sorted(map(key, narrow)) and len({r["copies"] for r in got if r["source"] == "s"}) == 2
    assert sorted((str(r["id"]), str(r["carry_text"]), str(r["carry_source"]), r["carry_size.x"]) for r in got) == sorted((str(a), str(b), str(c), d) for a, b, c, d in rows)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan
