"""One registered query per operator, over whole tables, in the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, embed_join, html_text, mixing, packing, pii, prefix_trie, quality, resample, sharding, simhash, suffix_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dimensions that copies of a text share, so that they meet in one shard
    dimensions = [F.col("n_chars"), sharding.text_code(F.col("lang"))]
    found = sharding.kd_shards(_table(spark, sf_dir, "documents"), "doc_id", "text", dimensions, shards=8)
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", shingle=3, radius=2)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_join.range_join(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", cosine=0.9)
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"), "page_id", "html", carry=["url"])


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", capacity=1024, with_ids=False)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, k=20, scale=64)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: A conversation whose texts look like marks, which the query formats beside the table's.
PROBE = r"\### Assistant: </turn> ok"


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    found = chat.digests(chat.windows(told.unionByName(probe), "conv_id", "turn", "role", "text", budget=1024, history=256))
    return found.withColumnRenamed("conv", "conv_id")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", weights=(3, 1, 2), share=1.5, cap=2.0)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"), "doc_id", "text")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.strip_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text", length=400)
    return found.drop("spans").withColumnRenamed("id", "doc_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = prefix_trie.turns(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.regrown(told, group=100, most=6))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = resample.resample(docs, "doc_id", "text", target, "text", share=0.25, seed=7, buckets=10_000, longest_run=2, least_words=20)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_simhash": op2_simhash,
    "op3_embedding_join": op3_embedding_join,
    "op4_html_text": op4_html_text,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_exact_topk": op6_exact_topk,
    "op7_chat_windows": op7_chat_windows,
    "op8_mix": op8_mix,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_suffix_array": op11_suffix_array,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_resample": op13_resample,
}

ORACLE: dict[str, str] = {
    "op6_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_embedding_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CASE WHEN embedding IS NULL OR list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
                THEN NULL ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e
            FROM embeddings
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(a, b) AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (
            SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM v
        )
        SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op8_mix": """
        WITH d AS (
            SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - ((length(text) - length(translate(text, '*%#$&!|@<>{}~^=', ''))) / nullif(length(text), 0)::DOUBLE) * 4), 1.0::DOUBLE) AS w,
                   (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 1) / 4503599627370497::DOUBLE AS u
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most,
                   [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM d GROUP BY source
        ), l AS (
            SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER o, 0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
            FROM s WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), m AS (
            SELECT *, max(CASE WHEN most > level * weight THEN level END) OVER () AS final FROM l
        ), t AS (
            SELECT source, source_size, CASE WHEN most <= coalesce(final * weight, most) THEN most ELSE final * weight END AS target FROM m
        ), p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS epochs,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               ((epochs + CASE WHEN start < target - epochs * source_size AND target - epochs * source_size - start > size / 2.0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
        FROM p""",
    "op12_prefix_trie": """
        WITH s AS (  -- CRC-32 by one byte
            SELECT list(x ORDER BY i) AS step FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS x FROM range(256) r(i))
        ), t AS (
            SELECT conv_id AS c, x, len(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS n FROM (
                SELECT conv_id, turn, coalesce(text, '') AS text, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL)
        ), k AS (
            SELECT c, c - c % 100 AS lead, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(CAST(c AS VARCHAR))), lambda i: ascii(substr(CAST(c AS VARCHAR), i + 1, 1))::BIGINT)),
                                      lambda r, b: xor(r // 256, step[xor(r % 256, b) + 1])), 4294967295) % 6 AS h
            FROM (SELECT c, count(*) AS n FROM t GROUP BY c), s
        ), r AS (
            SELECT k.c, t.n AS d, x, chars FROM k JOIN t ON t.c = k.lead AND t.n <= k.h
            UNION ALL
            SELECT k.c, t.n - k.h + least(k.h, coalesce(l.n, 0)), x, chars FROM k JOIN t ON t.c = k.c AND t.n > k.h LEFT JOIN k l ON l.c = k.lead
        ), p AS (
            SELECT c, d, chars, md5(string_agg(x, ',') OVER (PARTITION BY c ORDER BY d)) AS node FROM r UNION ALL SELECT c, 0, 0, '' FROM k
        ), m AS (
            SELECT *, lag(node) OVER w AS parent, max(d) OVER (PARTITION BY c) AS turns FROM p WINDOW w AS (PARTITION BY c ORDER BY d)
        ), g AS (
            SELECT node, min(parent) AS parent, min(c) AS c, min(d) AS d, count(*) AS n, min(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = turns), '') AS ends FROM m GROUP BY node
        ), ch AS (
            SELECT parent AS node, count(*) AS n FROM g WHERE parent IS NOT NULL GROUP BY parent
        ), sub AS (
            SELECT a.node, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((g.n - 1) * g.chars) AS saved
            FROM g LEFT JOIN ch USING (node) JOIN m a ON a.c = g.c AND a.d <= g.d GROUP BY a.node
        )
        SELECT g.c::BIGINT AS conv_id, g.d::BIGINT AS depth, up.c::BIGINT AS parent_conv_id, g.n::BIGINT AS n_convs, coalesce(ch.n, 0)::BIGINT AS n_children,
               leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(g.ends) AS ends_sha256
        FROM g LEFT JOIN g up ON up.node = g.parent LEFT JOIN ch ON ch.node = g.node JOIN sub ON sub.node = g.node""",
    "op13_resample": """
        WITH t AS (  -- CRC-32 by one byte
            SELECT list(x ORDER BY i) AS step FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS x FROM range(256) r(i))
        ), w AS (
            SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
            UNION ALL
            SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
        ), f AS (
            SELECT side, row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS f FROM w
        ), n AS (
            SELECT side, row, f, count(*) AS n FROM f GROUP BY ALL
        ), h AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda k: CAST('0x' || substr(hex(encode(f)), 2 * k + 1, 2) AS BIGINT))),
                                      lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT f FROM n), t
        ), c AS (
            SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n JOIN h USING (f) GROUP BY bucket
        ), g AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c
        ), d AS (
            SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
            FROM n JOIN h USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row
        ), s AS (
            SELECT id AS doc_id, row, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM w LEFT JOIN d USING (row) WHERE side = 'd'
        ), r AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM r) THEN rank END AS rank FROM s LEFT JOIN r USING (row)""",
}
