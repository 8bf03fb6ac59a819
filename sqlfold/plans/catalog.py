"""Registered queries over the driver tables, each with a DuckDB oracle.

Every query reads the given tables (dump text, scripts and ledgers are rendered
from them inside Spark), runs over whole tables and whole texts, and aliases
every computed column so the oracle's names match.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.redaction import redact_list
from ..functions.text import evidence_phrase, quoted_entries, redact
from ..operators import audit, digest, evidence, ledger, packing, queue, reconcile, replay, reports, splitplan, statements
from ..operators.scan import ordinal
from ..session import ensure_checkpoint_dir
from ..sources.text import parse_ledger
from .render import injected_text, insert_dump, numbered, sql_quote, tuple_text

# Fixed parameters of the registered queries ----------------------------------
CUTOFF = "20240115000000"
EVIDENCE_PATTERNS = [("the", 1), ("que", 2), ("und", 3), ("ion", 4), ("ent", 5)]
SECRETS = ["the", "de", "la"]
CLASS_OF_TYPE = {"click": "schema", "view": "data", "purchase": "mixed", "error": "unknown", "signup": "unknown"}
KIND_OF_TYPE = {"click": "schema", "signup": "schema", "view": "data", "purchase": "data"}
QUEUE_PATTERNS = ["*.example.com/en/*", "*.example.org/*/*", "blog.*/*/*", "*.example.com/en/*"]
IGNORE_PATTERNS = ["*.html", "*#top", "fr"]
KEEP_PATTERNS = ["*.example.org*", "*utm_source=feed"]
MARKER_HEADS = ["", f"-- {audit.DATA_MARKER}\n", f"\ufeff-- {audit.DATA_MARKER}\n\n", f"--{audit.SCHEMA_MARKER}\r\n", f"  --   {audit.SCHEMA_MARKER} and more\n",
                f"-- {audit.DATA_MARKER}\n-- {audit.SCHEMA_MARKER}\n", f"-- {audit.DATA_MARKER}x\n", f"SELECT 1; -- {audit.DATA_MARKER}\n", f"-- {audit.SCHEMA_MARKER.upper()}\n"]
LIMIT_RULES = {
    "1-URGENT": {"maxRowsPerInsert": 50},
    "2-HIGH": {"skip": True},
    "3-MEDIUM": {"maxLinesPerFile": 100, "maxBytesPerFile": 0},
    "4-NOT SPECIFIED": {"maxStatementsPerFile": 5, "maxRowsPerInsert": -3},
}
# ------------------------------------------------------------------------------


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _version(ts_col: str = "ts"):
    """``YYYYMMDDHHMMSS`` from a zone-less timestamp, independent of the session time zone."""
    return F.substring(F.regexp_replace(F.col(ts_col).cast("string"), "[^0-9]", ""), 1, 14)


def _map(col, mapping: dict):
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[col]


# ---------------------------------------------------------------------------
# dump -> statements -> rows
# ---------------------------------------------------------------------------
def _dump(df, file_id, target, key, **more):
    """Dump of all columns of ``df``: the key as a number, the rest quoted, null as NULL."""
    rest = [c for c in df.columns if c != key]
    values = [F.coalesce(sql_quote(injected_text(F.col(c)) if c == "text" else F.col(c).cast("string")), F.lit("NULL")) for c in rest]
    return insert_dump(df, file_id, target, key, values, ", ".join([key, *rest]), **more)


def _roundtrip_lines(spark, sf):
    nation, region, docs = (_t(spark, sf, t) for t in ("nation", "region", "documents"))
    return numbered(_dump(nation, "nation.sql", "public.nation", "n_nationkey"), _dump(region, "region.sql", "public.region", "r_regionkey"),
                    _dump(docs, "documents.sql", '"public"."documents"', "doc_id"))


def q_dump_roundtrip(spark, sf):
    scan = statements.dump_scan(_roundtrip_lines(spark, sf))
    rows = statements.rows_from_scan(scan)
    key = F.regexp_extract("tuple", r"^\((\d+), ", 1).cast("long")
    rest = F.regexp_extract("tuple", r"(?s)^\(\d+, (.*)\)\z", 1)
    return rows.select("target", key.alias("row_key"), F.md5(rest).alias("values_md5"), F.length(rest).cast("long").alias("n_chars"))


def q_dump_row_counts(spark, sf):
    specs = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
    lines = numbered(*[_dump(_t(spark, sf, t), f"{t}.sql", f"public.{t}", k, rows_per_stmt=100) for t, k in specs])
    return reconcile.rows_per_target(statements.statements_from_counts(statements.count_scan(lines)))


# ---------------------------------------------------------------------------
# re-chunking and packing
# ---------------------------------------------------------------------------
def q_rows_per_insert(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("target"), "o_orderkey")
    ch = packing.chunk_rows_by_count(o, ["target"], ["o_orderkey"], 200)
    return ch.groupBy("target", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def q_chunk_by_bytes(spark, sf):
    d = _t(spark, sf, "documents")
    rows = d.select(
        "source", "doc_id",
        F.octet_length(tuple_text(F.col("doc_id"), [sql_quote(F.col("text"))])).alias("tuple_bytes"),
        F.octet_length(F.concat(F.lit("INSERT INTO public."), F.col("source"), F.lit(" (doc_id, text) VALUES"))).alias("header_bytes"),
    )
    ch = packing.rechunk_rows(rows, ["source"], ["doc_id"], "header_bytes", 8, 16384)
    return ch.groupBy("source", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        (F.sum(F.col("tuple_bytes") + 2) + F.max("header_bytes") + 2).cast("long").alias("chunk_bytes"))


def q_pack_files(spark, sf):
    d = _t(spark, sf, "documents").select(F.concat(F.lit("public."), F.col("source")).alias("target"),
                                            F.col("doc_id").alias("stmt_no"), "text")
    lim = d.select("target").distinct().select(
        "target", F.lit(600.0).alias("max_lines"), F.lit(60.0).alias("max_statements"),
        F.lit(200.0).alias("max_rows"), F.lit(150000.0).alias("max_bytes"))
    plan = packing.pack_statements(d, lim)
    return plan.groupBy("file_name", "target", "table_no", "part_no").agg(
        F.count(F.lit(1)).alias("n_statements"), F.sum("_lines").cast("long").alias("n_lines"),
        F.sum("_bytes").cast("long").alias("n_bytes"), F.min("stmt_no").alias("first_doc"),
        F.max("stmt_no").alias("last_doc"),
    ).withColumn("table_no", F.col("table_no").cast("long"))


def q_limit_overrides(spark, sf):
    from ..sources.text import rules_from_json

    o = _t(spark, sf, "orders")
    tup = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"),
                   F.lit(", '"), F.col("o_orderstatus"), F.lit("')"))
    t = o.groupBy(F.col("o_orderpriority").alias("target")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.octet_length(tup)).cast("long").alias("total_bytes"))
    lim = packing.effective_limits(t, rules_from_json(spark, LIMIT_RULES))
    j = t.join(lim, "target")
    return j.select(
        "target", *[F.col(c).cast("long").alias(c) for c in packing.LIMIT_COLS], "n_rows", "total_bytes",
        F.ceil(F.col("n_rows") / F.col("max_rows")).cast("long").alias("n_chunks"),
        (F.col("total_bytes") > F.col("max_bytes")).alias("exceeds_bytes"),
    )


# ---------------------------------------------------------------------------
# reconcile
# ---------------------------------------------------------------------------
def q_reconcile_counts(spark, sf):
    o = _t(spark, sf, "orders")
    c = _t(spark, sf, "customer")
    left = o.groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    kept = o.filter(F.col("o_orderstatus") != "P").select("o_custkey", "o_orderkey")
    right = (c.filter(F.col("c_mktsegment") != "AUTOMOBILE")
             .join(kept, F.col("o_custkey") == F.col("c_custkey"), "left")
             .groupBy(F.col("c_custkey").alias("key")).agg(F.count("o_orderkey").alias("n")))
    return reconcile.reconcile_counts(left, right)


def q_first_mismatches(spark, sf):
    """The first ten problems of a reconciliation; the limit is the report's."""
    return reconcile.first_mismatches(q_reconcile_counts(spark, sf), 10)


def q_fingerprint_by_group(spark, sf):
    d = _t(spark, sf, "documents")
    return reconcile.member_fingerprint(d, ["source", "lang"], "doc_id", "text").withColumn(
        "total_bytes", F.col("total_bytes").cast("long"))


def _edited_documents(spark, sf):
    """Documents as lines, and the same with lines dropped and changed."""
    d = _t(spark, sf, "documents")
    parts = F.split("text", "\n", -1)
    orig = d.select("doc_id", F.posexplode(parts).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    kept = orig.filter(~F.col("line").startswith("The"))
    w = Window.partitionBy("doc_id").orderBy("line_no")  # one document: bounded
    edited = kept.select("doc_id", F.row_number().over(w).cast("long").alias("line_no"),
                         F.replace(F.col("line"), F.lit(" the "), F.lit(" teh ")).alias("line"))
    return orig, edited


def q_first_difference(spark, sf):
    return reconcile.first_difference(*_edited_documents(spark, sf), ["doc_id"])


def q_tree_difference(spark, sf):
    """J3 by descent in digest trees: only lines of the first leaf that differs are compared."""
    return digest.tree_difference(*_edited_documents(spark, sf), ["doc_id"], leaf_lines=8, fanout=16)


def q_digest_tree(spark, sf):
    """A6 in order: every level of the digest trees of documents and their edited copies."""
    orig, edited = _edited_documents(spark, sf)
    both = orig.withColumn("copy", F.lit("original")).unionByName(edited.withColumn("copy", F.lit("edited")))
    tree = digest.digest_tree(both, ["copy", "doc_id"], leaf_lines=4, fanout=3)
    return tree.withColumn("level", F.col("level").cast("long"))


# ---------------------------------------------------------------------------
# ledgers, cutoffs, replay
# ---------------------------------------------------------------------------
def _event_versions(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", "value", _version().alias("version"))


def q_version_max(spark, sf):
    e = _t(spark, sf, "events")
    v = (F.when(F.col("event_type") == "error", F.concat(F.lit("v"), F.col("event_id").cast("string")))
         .when(F.col("event_type") == "view", F.concat(F.lit("0"), F.col("event_id").cast("string")))
         .otherwise(F.col("event_id").cast("string")))
    x = e.select("user_id", v.alias("v"))
    ok = ledger.is_valid_version("v")
    return x.groupBy("user_id").agg(
        F.max(F.when(ok, ledger.version_key("v")))["v"].alias("latest_version"),
        F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


def _ledger_lines(spark, sf):
    e = _event_versions(spark, sf)
    loc = (F.when(F.col("value") >= 10, F.when(F.col("event_type") == "signup", F.concat(F.lit("x"), F.col("version")))
                  .otherwise(F.col("version"))).otherwise(F.lit("")))
    rem = F.when((F.col("value") <= 40) & (F.col("event_type") != "error"), F.col("version")).otherwise(F.lit(""))
    tick = F.col("event_type") == "click"
    sep = F.when(F.col("event_type") == "view", F.lit(" │ ")).otherwise(F.lit(" | "))

    def cell(c):
        return F.when(tick & (c != ""), F.concat(F.lit("`"), c, F.lit("`"))).otherwise(c)

    rows = e.select("user_id", (F.col("event_id") + 10).alias("line_no"),
                    F.concat(F.lit("   "), cell(loc), sep, cell(rem), sep, F.col("version")).alias("line"))
    users = e.select("user_id").distinct()
    head = users.select("user_id", F.lit(1).cast("long").alias("line_no"),
                        F.lit("   Local          | Remote         | Time (UTC)").alias("line"))
    rule = users.select("user_id", F.lit(2).cast("long").alias("line_no"),
                        F.lit("  ----------------|----------------|---------------------").alias("line"))
    return rows.unionByName(head).unionByName(rule)


def _alignment(spark, sf):
    rows = parse_ledger(_ledger_lines(spark, sf), keep=["user_id"])
    return ledger.alignment(rows, ["user_id"])


def q_ledger_alignment(spark, sf):
    return ledger.sync_gate(_alignment(spark, sf))


def q_cutoff_resolve(spark, sf):
    e = _event_versions(spark, sf)
    per = e.groupBy("user_id").agg(
        F.max(F.when((F.col("event_type") == "signup") & (F.col("value") > 45), F.col("version"))).alias("argument"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") < 5), F.col("version"))).alias("env_config"),
        F.min(F.when(F.col("event_type") == "view", F.concat(F.col("version"), F.when(F.col("value") > 48, F.lit("x")).otherwise(F.lit(""))))).alias("config"),
    )
    al = _alignment(spark, sf).select("user_id", "latest_aligned")
    j = per.join(al, "user_id", "left")
    r = ledger.resolve_cutoff(F.col("argument"), F.col("latest_aligned"), F.col("env_config"), F.col("config"))
    return j.select("user_id", r["value"].alias("cutoff"), r["source"].alias("source"))


def _classified_events(spark, sf):
    e = _event_versions(spark, sf)
    return e.withColumn("classification", _map(F.col("event_type"), CLASS_OF_TYPE)).withColumn(
        "phase", replay.phase(F.col("version"), F.lit(CUTOFF)))


def q_cutoff_grid(spark, sf):
    return replay.phase_grid(_classified_events(spark, sf), ["user_id"])


def q_replay_plan(spark, sf):
    e = _event_versions(spark, sf).withColumn("classification", _map(F.col("event_type"), CLASS_OF_TYPE))
    plan = replay.plan_replay(e, ["user_id"], CUTOFF, tie_cols=["event_id"])
    return plan.select("user_id", "event_id", "version", "classification", "phase", "action",
                       "policy_status", "replay_seq")


def q_snapshot_replay(spark, sf):
    e = _event_versions(spark, sf).withColumn("is_delete", F.col("event_type") == "error")
    cols = ["event_id", "event_type", "value", "version", "is_delete"]
    pre = e.filter(replay.phase(F.col("version"), F.lit(CUTOFF)) == "pre")
    snap = pre.groupBy("user_id").agg(
        F.max_by(F.struct(*cols), F.struct(ledger.version_key("version"), F.col("event_id"))).alias("s")
    ).select("user_id", "s.*").filter(~F.col("is_delete"))  # a delete is applied: its key is not in the snapshot
    return replay.snapshot_replay(snap, e.select("user_id", *cols), ["user_id"], "version", CUTOFF,
                                  delete_col="is_delete", tie_cols=["event_id"])


def q_kind_segments(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", "event_type",
                                       _map(F.col("event_type"), KIND_OF_TYPE).alias("kind"))
    runs = splitplan.kind_runs(e, ["user_id"], "event_id", "kind")
    runs = runs.withColumn("stmt", F.concat(F.col("event_type"), F.lit(":"), F.col("event_id").cast("string")))
    return splitplan.segment_bodies(runs, ["user_id"], "event_id", "stmt").select(
        "user_id", "segment_no", "kind", F.col("n_statements").alias("n_events"),
        F.col("first_no").alias("first_event"), F.col("last_no").alias("last_event"), "content")


def q_renumber(spark, sf):
    e = _event_versions(spark, sf).withColumn(
        "name", F.concat(F.col("version"), F.lit("_"), F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".sql")))
    earliest = e.filter(F.col("event_type") == "purchase").groupBy("user_id").agg(
        F.min(ledger.version_key("version"))["v"].cast("decimal(38,0)").alias("earliest"))
    is_split = F.col("event_type") == "purchase"
    outs = e.withColumn("segment_no", F.explode(F.when(is_split, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    base = F.concat(F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"))
    outs = outs.withColumn("kind", F.when(is_split, "split").otherwise("renumber")).withColumn(
        "suffix",
        F.when(is_split, F.concat(base, F.lit("_"), F.when(F.col("segment_no") == 1, "schema").otherwise("data"),
                                  F.lit("_"), F.col("segment_no").cast("string"), F.lit(".sql")))
        .otherwise(F.concat(base, F.lit(".sql"))))
    ren = splitplan.renumber(outs, ["user_id"], earliest)
    ch = splitplan.changes_by_source(ren, ["user_id"])
    return ch.select("user_id", "name", "kind", F.array_join("after_names", ",").alias("after_names"))


# ---------------------------------------------------------------------------
# audits
# ---------------------------------------------------------------------------
def q_pattern_evidence(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text")
    found = evidence.pattern_matches(d, ["doc_id"], "text", [(p, "(?i)" + p) for p, _ in EVIDENCE_PATTERNS])
    return evidence.top_evidence(found, ["doc_id"]).select("doc_id", "rank", "pattern", "line", "snippet")


SCRIPT_TEMPLATES = {
    "click": "CREATE TABLE public.t_%s (id bigint, note text DEFAULT 'insert into x');\n",
    "view": "-- note: create table in a comment\nINSERT INTO public.t VALUES (%s, 'it''s; drop table y');\n",
    "purchase": "CREATE TABLE public.p_%s (id bigint);\nINSERT INTO public.p VALUES (1);\n",
    "error": "SELECT %s;\n/* update t set a = 1 */\nSELECT $$ delete from t $$;\n",
    "signup": "-- " + audit.DATA_MARKER + "\nUPDATE public.users SET n = %s;\n",
}


def _scripts(spark, sf):
    e = _t(spark, sf, "events")
    text = None
    for t, tmpl in SCRIPT_TEMPLATES.items():
        piece = F.format_string(tmpl, F.col("event_id"))
        text = F.when(F.col("event_type") == t, piece) if text is None else text.when(F.col("event_type") == t, piece)
    return e.select("user_id", "event_id", "event_type", text.alias("text"))


def q_script_classes(spark, sf):
    keys = ["user_id", "event_id"]
    scripts = _scripts(spark, sf)
    found = evidence.script_evidence(scripts, keys, "text")
    n = evidence.top_evidence(found, keys).groupBy(*keys).agg(F.count_if(F.col("family") == "ddl").alias("n_ddl"), F.count_if(F.col("family") == "dml").alias("n_dml"))
    a = audit.classify_scripts(scripts).join(n, keys, "left")
    return a.select(*keys, "classification", "source", "recommended_marker",
                    F.coalesce("n_ddl", F.lit(0)).cast("long").alias("n_ddl"), F.coalesce("n_dml", F.lit(0)).cast("long").alias("n_dml"))


def _document_scripts(spark, sf):
    """Whole documents with statements between their paragraphs: before a line that starts like
    one of these, in comments and strings, and on a line of their own."""
    made = F.concat(F.lit("CREATE\n  TABLE t"), F.col("doc_id").cast("string"), F.lit(" (a int); update u set b = 1;\n"))
    quiet = F.lit("-- drop table x\n/* insert into y */ SELECT 'delete from z', $a$ alter table q $a$;\nselect 1 for update of t;\n")
    kept = F.replace(F.replace(F.col("text"), F.lit("'"), F.lit("")), F.lit("$"), F.lit(""))
    kept = F.replace(F.replace(F.replace(kept, F.lit('"'), F.lit("")), F.lit("--"), F.lit("")), F.lit("/*"), F.lit(""))
    body = F.replace(kept, F.lit("\n"), F.lit("\nINSERT INTO p VALUES (1);\n"))
    return _t(spark, sf, "documents").select("doc_id", F.concat(quiet, made, body, F.lit("\n  UPDATE v SET c = 2;\nDROP TABLE w;")).alias("text"))


def q_script_evidence(spark, sf):
    """D12, D13, U3, W6, X18 over whole documents: every evidence row, and the display phrase of the first three."""
    found = evidence.script_evidence(_document_scripts(spark, sf), ["doc_id"], "text")
    per = found.groupBy("doc_id", "family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line").cast("long").alias("lines"),
        F.max(F.when(F.col("pattern") == "UPDATE", F.col("snippet"))).alias("last_update"))
    lists = evidence.evidence_lists(evidence.top_evidence(found, ["doc_id"]), ["doc_id"])
    return per.join(lists, ["doc_id", "family"]).select("doc_id", "family", "n", "lines", "last_update", evidence_phrase("matches").alias("phrase"))


def _marked_scripts(spark, sf):
    """Documents with a marker line in one of several spellings in front, some after a byte order mark."""
    d = _t(spark, sf, "documents")
    head = F.element_at(F.array(*[F.lit(x) for x in MARKER_HEADS]), (F.pmod("doc_id", F.lit(len(MARKER_HEADS))) + 1).cast("int"))
    return d.select("doc_id", F.concat(head, F.replace(F.col("text"), F.lit("--"), F.lit(""))).alias("text"))


def q_marker_facts(spark, sf):
    """F2, D14, X10 on marker spellings: is there one, where, and what is left without it."""
    scripts = _marked_scripts(spark, sf)
    found = evidence.script_evidence(scripts, ["doc_id"], "text", [audit.DATA_MARKER, audit.SCHEMA_MARKER]).where("family = 'marker'")
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_markers"), F.min("line").alias("first_line"))
    c = audit.unmark(audit.classify_scripts(scripts)).join(n, "doc_id", "left")
    return c.select("doc_id", "has_data_marker", "has_schema_marker", F.coalesce("n_markers", F.lit(0)).alias("n_markers"), "first_line", "removed", F.md5("new_text").alias("left_md5"))


#: One statement of each of the 13 classes; %1$s is the part's key, %2$s its size.
SCHEMA_TEMPLATES = [
    "CREATE TABLE public.part_%1$s (\n  id bigint\n);",
    "CREATE INDEX idx_part_%1$s ON public.part (p_size);",
    "CREATE OR REPLACE FUNCTION public.fn_%1$s()\nRETURNS int AS $$\nBEGIN\n  -- CREATE TYPE in a body\n  RETURN %2$s;\nEND;\n$$ LANGUAGE plpgsql;",
    "ALTER TABLE ONLY public.part\n    ADD CONSTRAINT part_pk_%1$s PRIMARY KEY (p_partkey);",
    "GRANT SELECT ON public.part TO role_%1$s;",
    "-- promo part\nCREATE VIEW public.v_%1$s AS SELECT 1;",
    "CREATE EXTENSION IF NOT EXISTS \"ext_%1$s\";",
    "SET lock_timeout = %2$s;",
    "CREATE TYPE public.kind_%1$s AS ENUM ('a', 'b;');",
    "ALTER TABLE public.part ADD CONSTRAINT \"fk_%1$s\" FOREIGN KEY (a) REFERENCES b (c);",
    "CREATE POLICY \"p %1$s\" ON public.part;",
    "ALTER TABLE public.part OWNER TO owner_%1$s;",
    "/* a; comment */\nTRUNCATE part_%1$s;",
    "ALTER TABLE part_%1$s ENABLE ROW LEVEL SECURITY;",
]


def _schema_lines(spark, sf):
    p = _t(spark, sf, "part")
    key, n = F.col("p_partkey").cast("string"), len(SCHEMA_TEMPLATES)
    text = F.element_at(F.array(*[F.format_string(t, key, F.col("p_size").cast("string")) for t in SCHEMA_TEMPLATES]), (F.pmod("p_partkey", F.lit(n)) + 1).cast("int"))
    lines = p.select(F.lit("schema.sql").alias("file_id"), "p_partkey", F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    return ordinal(lines, ["file_id"], ["p_partkey", "i"], "line_no").select("file_id", "line_no", "line")


def q_category_sequence(spark, sf):
    st = statements.ddl_statements(_schema_lines(spark, sf))
    cat = statements.categorise(st)
    return cat.select("line_start", "line_end", "category", "object_name", F.col("cat_seq").cast("long").alias("cat_seq"), "file_name", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------------------
# queues and filters
# ---------------------------------------------------------------------------
def _paths(spark, sf):
    return _t(spark, sf, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("path")).distinct()


def q_quoted_entries(spark, sf):
    """Entries of a quoted list in a text, and the pattern that the first of them is as a glob."""
    p = _t(spark, sf, "pages")
    text = F.concat(F.lit('sql_paths = ["./'), F.col("url"), F.lit("\", 'seed/"), F.col("page_id").cast("string"), F.lit("_*.sql', \"\" ]"))
    entries = quoted_entries(text)
    return p.select("page_id", F.size(entries).cast("long").alias("n"), F.array_join(entries, "|").alias("entries"))


def q_split_scope(spark, sf):
    """Mixed scripts to split, all of them and those after the cutoff; what the strict policy says of them."""
    scripts = _scripts(spark, sf).join(_event_versions(spark, sf).select("event_id", "version"), "event_id")
    audited = audit.classify_scripts(scripts)
    every = splitplan.split_scope(audited, scope="all").select("user_id", "event_id", "version", "classification")
    later = splitplan.split_scope(audited, CUTOFF).select("event_id", F.lit(True).alias("after_cutoff"))
    both = every.join(later, "event_id", "left").withColumn("phase", replay.phase(F.col("version"), F.lit(CUTOFF)))
    return both.select("user_id", "event_id", F.coalesce("after_cutoff", F.lit(False)).alias("after_cutoff"),
                       replay.mixed_policy(F.col("phase"), F.col("classification"), strict=True).alias("strict_policy"))


def q_load_queue(spark, sf):
    q = queue.load_queue(_paths(spark, sf), QUEUE_PATTERNS)
    return q.withColumn("pattern_no", F.col("pattern_no").cast("long"))


def _page_patterns() -> list[str]:
    """Over 800 patterns: each host's pages by the letters their names begin with, later ones more general."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    named = [f"*.example.{top}/{a}{b}*" for b in letters[:6] for a in letters for top in ("com", "org")]
    deep = [f"*.example.{top}/{a}*/{b}*" for a in letters for b in letters[:6] for top in ("com", "org")]
    return [*named, *deep, "*/*", "*/*/*", *named[:9]]


def q_many_patterns(spark, sf):
    """W9/F9 with a long pattern list: paths walked down a trie of segments."""
    q = queue.load_queue(_paths(spark, sf), _page_patterns())
    return q.withColumn("pattern_no", F.col("pattern_no").cast("long"))


def _secrets() -> list[str]:
    """Over 700 literals in an order that matters: some begin others, some match a replacement's letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return ["tion", "tio", *(f"{a}{b}e" for a in letters for b in letters), "d[", "REDA", "ACTED]s", "", "the ", "]]"]


def q_redact_many(spark, sf):
    """X13 with a long list of literals, replaced in order in whole documents."""
    return _t(spark, sf, "documents").select("doc_id", redact_list("text", _secrets()).alias("text"))


def q_ignore_filter(spark, sf):
    p = _paths(spark, sf).withColumn("base_name", F.element_at(F.split("path", "/"), -1))
    kept = queue.keep_filter(p, KEEP_PATTERNS)
    return queue.ignore_filter(kept, IGNORE_PATTERNS, "base_name")


def q_redact_literals(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", redact(F.col("text"), F.array(*[F.lit(s) for s in SECRETS])).alias("text"))


def q_markers_roundtrip(spark, sf):
    """Mark, then unmark; every third text starts with a byte order mark."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text"))
    d = _t(spark, sf, "documents").select("doc_id", text.alias("text"), F.lit("data").alias("recommended_marker"))
    marked = audit.mark_candidates(d, "text")
    back = audit.unmark(marked.select("doc_id", F.col("new_text").alias("text")), "text")
    return back.select("doc_id", F.col("text").alias("marked"), F.md5("new_text").alias("unmarked_md5"), "removed")


def q_deploy_phrase(spark, sf):
    return replay.summary_row(_classified_events(spark, sf), ["user_id"], F.lit(CUTOFF))


def q_resumable_load(spark, sf):
    """Load documents, one seed file per source, in queue order and in two waves. Each file is
    one output partition, overwritten atomically; the second wave takes only the files the
    load log doesn't hold yet. Returns the loaded table."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-load-{uuid.uuid4().hex}"
    d = _t(spark, sf, "documents").withColumn("file_id", F.coalesce("source", F.lit("")))
    q = ordinal(d.select("file_id").distinct(), [], ["file_id"], "queue_no")
    half = (q.agg(F.max("queue_no")).first()[0] or 0) // 2
    queue.load_wave(d.join(q.filter(F.col("queue_no") <= half), "file_id"), root, "file_id", ["queue_no", "doc_id"])
    log = spark.read.schema("file_id string").parquet(root).distinct()
    queue.load_wave(d.join(queue.pending(q, log, "file_id"), "file_id"), root, "file_id", ["queue_no", "doc_id"])
    return spark.read.parquet(root).select("doc_id", "text", "lang", "source", "n_chars")


def q_load_commits(spark, sf):
    """One seed file per source, in queue order. The first wave commits, the second ends half-way (some
    rows of its files, no log), the third takes what the log lacks. Per file: the log's row, and how the
    folder compares with it."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-commits-{uuid.uuid4().hex}"
    data, logged = f"{root}/data", f"{root}/log"
    columns = ["doc_id", "text", "lang", "n_chars"]
    d = _t(spark, sf, "documents").withColumn("file_id", F.coalesce("source", F.lit(""))).select("file_id", *columns)
    q = ordinal(d.select("file_id").distinct(), [], ["file_id"], "queue_no")
    third = (q.agg(F.max("queue_no")).first()[0] or 0) // 3
    rows = lambda files: d.join(files.select("file_id"), "file_id")
    queue.commit_wave(rows(q.filter(F.col("queue_no") <= third)), data, logged, 1, order_cols=["doc_id"])
    queue.load_wave(rows(q.filter(F.col("queue_no").between(third + 1, 2 * third))).filter("doc_id % 2 = 0"), data, "file_id", ["doc_id"])
    left = queue.pending(q, queue.load_log(spark, logged).withColumnRenamed("path", "file_id"), "file_id")
    queue.commit_wave(rows(left), data, logged, 3, order_cols=["doc_id"])
    log = queue.load_log(spark, logged)
    checked = queue.verify_loads(spark.read.schema(d.schema).parquet(data), log, "file_id", columns)
    return log.join(checked, "path").select("path", "rows", F.col("checksum").cast("long").alias("checksum"), "wave", "status")


def q_stream_load(spark, sf):
    """R4, stream form: one text file per source, published by the members sink, loaded as they arrive with a
    log; per file its lines, their checksum and how often it was logged."""
    from ..sources.members import write_members
    from ..streaming.load import stream_load

    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-stream-{uuid.uuid4().hex}"
    d = _t(spark, sf, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".sql")).alias("file_name"), F.col("doc_id").alias("position"),
                                          F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("gap"))
    write_members(d, f"{root}/src")
    for _ in range(2):  # the second run finds nothing new
        stream_load(spark, f"{root}/src", f"{root}/data", f"{root}/state", max_files_per_trigger=7, log_dir=f"{root}/log")
    log = queue.load_log(spark, f"{root}/log")
    names = F.element_at(F.split("path", "/"), -1)
    return log.groupBy(names.alias("file_name")).agg(F.max("rows").alias("n_lines"), F.max("checksum").cast("long").alias("checksum"), F.count(F.lit(1)).alias("n_logged"))


def q_audit_summary(spark, sf):
    a = audit.classify_scripts(_scripts(spark, sf))
    return audit.audit_summary(a, ["user_id"])


SPLIT_TEMPLATES = {
    "purchase": "BEGIN;\nCREATE TABLE p_%1$s (id bigint);\nINSERT INTO p_%1$s VALUES (1);\nCOMMIT;\n",
    "click": "CREATE TABLE t_%1$s (id bigint);\n",
    "view": "INSERT INTO t VALUES (%1$s);\n",
    "error": "SELECT %1$s;\n",
    "signup": "UPDATE u SET n = %1$s;\n",
}


def _split_scripts(spark, sf):
    e = _event_versions(spark, sf)
    text = F.coalesce(*[F.when(F.col("event_type") == t, F.format_string(tmpl, F.col("event_id"))) for t, tmpl in SPLIT_TEMPLATES.items()])
    name = F.concat(F.col("version"), F.lit("_"), F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".sql"))
    return e.select("user_id", "version", text.alias("text"), name.alias("name"), "event_type")


def q_split_plan(spark, sf):
    scripts = _split_scripts(spark, sf)
    targets = scripts.filter(F.col("event_type") == "purchase").select("user_id", "name")
    plan = splitplan.split_plan(scripts.drop("event_type"), targets, ["user_id"])
    return plan.select("user_id", "name", "new_name", "kind", "content", "error")


def q_rechunk_statements(spark, sf):
    o = _t(spark, sf, "orders")
    lines = insert_dump(o, "orders.sql", "public.orders", "o_orderkey", [sql_quote(F.col("o_orderpriority"))],
                        "o_orderkey, o_orderpriority", rows_per_stmt=100)
    scan = statements.dump_scan(numbered(lines))
    rows = statements.rows_from_scan(scan)
    st = statements.statements_from_scan(scan)
    lim = rows.select("target").distinct().select(
        "target", F.lit(100.0).alias("max_rows"), F.lit(2100.0).alias("max_bytes"))
    ch = packing.rechunk_inserts(rows, st, lim)
    key = F.regexp_extract("tuple", r"^\((\d+), ", 1).cast("long")
    return ch.groupBy("stmt_no", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.sum(F.col("tuple_bytes") + 2) + F.max("header_bytes") + 2).cast("long").alias("chunk_bytes"),
        F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def q_schema_roundtrip(spark, sf):
    """Split the schema dump into per-statement members with line-range headers, read the
    members back in start-line order and compare with the original line by line."""
    lines = _schema_lines(spark, sf)
    st = statements.ddl_statements(lines)
    header = F.concat(F.lit("-- Original SQL from lines "), F.col("line_start").cast("string"), F.lit("-"),
                      F.col("line_end").cast("string"), F.lit("\n\n"))
    members = st.select("file_id", F.concat(header, F.col("text")).alias("member"))
    back = members.select(
        "file_id",
        F.regexp_extract("member", r"^-- Original SQL from lines (\d+)-(\d+)", 1).cast("long").alias("start"),
        F.regexp_replace("member", r"^-- Original SQL from lines[^\n]*\n\n", "").alias("text"))
    back_lines = back.select("file_id", "start", F.posexplode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)).alias("i", "line"))
    back_lines = ordinal(back_lines, ["file_id"], ["start", "i"], "pos")
    orig = ordinal(lines, ["file_id"], ["line_no"], "pos")
    diff = reconcile.first_difference(orig.select("file_id", "pos", "line"), back_lines.select("file_id", "pos", "line"),
                                      ["file_id"], "pos")
    fp_o = reconcile.member_fingerprint(orig, ["file_id"], "pos", "line").select(
        "file_id", F.col("n_members").alias("n_lines"), F.col("fingerprint").alias("fp_o"))
    fp_b = reconcile.member_fingerprint(back_lines, ["file_id"], "pos", "line").select(
        "file_id", F.col("n_members").alias("n_lines_back"), F.col("fingerprint").alias("fp_b"))
    n_st = st.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_statements"))
    out = n_st.join(fp_o, "file_id").join(fp_b, "file_id").join(diff.select("file_id", "first_diff_line"), "file_id", "left")
    return out.select("file_id", "n_statements", "n_lines", "n_lines_back",
                      (F.col("fp_o") == F.col("fp_b")).alias("fingerprint_equal"), "first_diff_line")


def q_schema_members(spark, sf):
    """Members of two schema dumps written, with their index, and read back."""
    from ..sources.text import read_statement_files, write_statement_files

    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-schema-{uuid.uuid4().hex}"
    lines = _schema_lines(spark, sf)
    both = lines.unionByName(lines.withColumn("file_id", F.lit("copy.sql")))
    write_statement_files(statements.categorise(statements.ddl_statements(both)), out)
    back = read_statement_files(spark, out)
    index = spark.read.json(out + "/index").select("file_id", F.col("member").alias("file_name"), "path", F.col("endLine").alias("index_end"))
    return back.join(index, ["file_id", "file_name"]).select("file_id", "file_name", "line_start", "line_end", "index_end", F.md5("text").alias("text_md5"),
                                                             F.regexp_extract("path", "category=(.*)$", 1).alias("folder_class"))


SPLIT_RULES = {"public.documents": {"maxRowsPerInsert": 7},
               "public.orders": {"maxRowsPerInsert": 30}}


def _split_dumps(spark, sf):
    return numbered(_dump(_t(spark, sf, "documents"), "documents.sql", "public.documents", "doc_id"),
                    _dump(_t(spark, sf, "orders"), "orders.sql", "public.orders", "o_orderkey"))


def q_dump_split_validate(spark, sf):
    """Split a documents + orders dump into files under rules, write them, read them back, reconcile."""
    from ..sources.text import rules_from_json
    from .split_validate import split_and_validate

    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-split-{uuid.uuid4().hex}"
    return split_and_validate(_split_dumps(spark, sf), rules_from_json(spark, SPLIT_RULES), out_dir=out)


def _customer_dump(spark, sf):
    """A dump of customers in over 1000 tables, with sequence lines."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key"), (F.col("c_custkey") % 1200).cast("long").alias("k"), "c_name", "c_mktsegment")
    row = tuple_text(F.col("key"), [sql_quote(F.col("c_name")), sql_quote(F.col("c_mktsegment"))])
    last = F.col("key") == F.max("key").over(Window.partitionBy("k"))
    rows = c.select("k", F.col("key").alias("part"), F.concat(F.lit("\t"), row, F.when(last, ";").otherwise(",")).alias("line"))
    heads = c.select("k").distinct().select("k", F.lit(-1).cast("long").alias("part"), F.concat(F.lit("INSERT INTO public.t"), "k", F.lit(" (c_custkey, c_name, c_mktsegment) VALUES")).alias("line"))
    seqs = c.select("k").distinct().filter("k % 100 = 7").select("k", F.lit(1 << 60).alias("part"), F.concat(F.lit("SELECT pg_catalog.setval('public.t"), "k", F.lit("_id_seq', 1, true);")).alias("line"))
    lines = rows.unionByName(heads).unionByName(seqs).withColumn("section", F.lit(1)).withColumn("p", F.lit(0)).withColumn("file_id", F.lit("customers.sql"))
    return numbered(lines)


def q_reassembled_stream(spark, sf):
    """S8, S11, O4, R11 by text: over 1000 tables split into files of their own names, published by the
    members sink, read back and put together in the order of their numbers; every line of the stream."""
    from ..sources.members import write_members
    from ..sources.text import read_chunk_files
    from .split_validate import file_plan, reassembled_files

    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-members-{uuid.uuid4().hex}"
    write_members(file_plan(_customer_dump(spark, sf), None), out)
    return reassembled_files(read_chunk_files(spark, out)).select("line_no", "line")


def q_stream_text(spark, sf):
    """R11 by text: the lines planned for over 1000 tables against those of the files read back, and
    against these with one line in 97 changed, by digest trees."""
    from ..session import materialize
    from ..sources.members import write_members
    from ..sources.text import read_chunk_files
    from .split_validate import file_plan, reassembled_files, reassembled_lines

    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-members-{uuid.uuid4().hex}"
    plan = materialize(file_plan(_customer_dump(spark, sf), None))
    write_members(plan, out)
    copies = F.explode(F.array(F.lit("read"), F.lit("changed"))).alias("copy")
    planned = reassembled_lines(plan).select(copies, "line_no", "line")
    back = reassembled_files(read_chunk_files(spark, out)).select(copies, "line_no", "line")
    changed = (F.col("copy") == "changed") & F.col("line").rlike("^\t\\([0-9]*97, ")
    back = back.withColumn("line", F.when(changed, F.upper("line")).otherwise(F.col("line")))
    return digest.text_report(planned, back, ["copy"], leaf_lines=64, fanout=8)


PLAN_RULES = {"public.mid": {"maxRowsPerInsert": 30}, "public.beta": {"skip": True}}


def q_dump_file_plan(spark, sf):
    """The files of two dumps, one row per statement in them. Tables come out of
    alphabetic order, one is skipped, one has only INSERT ... SELECT, one ends its statements with
    a tail; sequence lines of both dumps are in one member."""
    from ..sources.text import rules_from_json
    from .split_validate import file_plan

    nation = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    region = _t(spark, sf, "region").select("r_regionkey", "r_name")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    copied = ("INSERT INTO public.copied SELECT *", "FROM public.zeta;")
    dumps = [_dump(nation, "1-a.sql", "public.zeta", "n_nationkey", extra=copied), _dump(orders, "2-b.sql", "public.mid", "o_orderkey", tail=" ON CONFLICT DO NOTHING"),
             _dump(nation, "3-c.sql", "public.beta", "n_nationkey"), _dump(region, "4-d.sql", "public.alpha", "r_regionkey")]
    plan = file_plan(numbered(*dumps), rules_from_json(spark, PLAN_RULES))
    return plan.select("section", F.col("table_no").cast("long").alias("table_no"), "part_no", "position", "file_name", F.md5("text").alias("text_md5"))


ERROR_TEMPLATES = {
    "purchase": "BEGIN;\nCREATE TABLE p_%1$s (id bigint);\nINSERT INTO p_%1$s VALUES (1);\nCOMMIT;\n",
    "click": "BEGIN; COMMIT;\n",
    "view": "BEGIN;\nINSERT INTO t VALUES (%1$s);\n",
    "error": "SELECT %1$s;\nROLLBACK;\n",
    "signup": "UPDATE u SET n = %1$s;\nCOMMIT;\nSELECT 1;\n",
}


def _error_scripts(spark, sf):
    """Scripts of all users, by event as a target that splits, holds nothing, or breaks a rule; versions are
    event numbers, some with zeros in front."""
    e = _t(spark, sf, "events")
    text = F.coalesce(*[F.when(F.col("event_type") == t, F.format_string(tmpl, F.col("event_id"))) for t, tmpl in ERROR_TEMPLATES.items()])
    version = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("000")).otherwise(F.lit("")), (F.col("event_id") + 1).cast("string"))
    return e.select("user_id", "event_id", "event_type", version.alias("version"), F.concat(version, F.lit("_"), "event_type", F.lit(".sql")).alias("name"), text.alias("text"))


def q_split_plan_errors(spark, sf):
    """Targets that can't be split, are asked for twice or don't exist."""
    scripts = _error_scripts(spark, sf)
    asked = scripts.filter(F.col("event_id") % 3 != 0).select("user_id", "name")
    ghosts = scripts.filter(F.col("event_id") % 50 == 0).select("user_id", F.concat(F.lit("ghost_"), "name").alias("name"))
    plan = splitplan.split_plan(scripts.select("user_id", "name", "version", "text"), asked.unionByName(asked).unionByName(ghosts), ["user_id"])
    return plan.select("user_id", "name", "segment_no", "new_name", "kind", "error")


def q_split_blocked(spark, sf):
    """The ordered changes of a plan, and which of them the remote history blocks."""
    scripts = _split_scripts(spark, sf)
    targets = scripts.filter(F.col("event_type") == "purchase").select("user_id", "name")
    changes = splitplan.changes_by_source(splitplan.split_plan(scripts.drop("event_type"), targets, ["user_id"]), ["user_id"])
    versions = changes.withColumn("version", F.split("name", "_")[0])
    remote = scripts.filter(F.col("event_type") == "click").select("user_id", F.col("version").alias("remote")).distinct()
    blocked = splitplan.blocked_by_remote(versions, remote, ["user_id"]).select("user_id", "name", F.lit(True).alias("blocked"))
    # The audit knows the scripts that are no clicks
    known = audit.classify_scripts(scripts.filter(F.col("event_type") != "click"))
    marked = splitplan.class_lookup(changes.join(blocked, ["user_id", "name"], "left"), known, ["user_id"])
    return marked.select("user_id", "change_no", "name", "kind", F.size("after_names").cast("long").alias("n_after"), F.coalesce("blocked", F.lit(False)).alias("blocked"), "classification")


def q_resume_points(spark, sf):
    """A queue per language, and where each goes on from a page; null where it has none."""
    p = _t(spark, sf, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("path")).distinct()
    p = p.withColumn("lang", F.element_at(F.split("path", "/"), 2))
    q = queue.load_queue(p, QUEUE_PATTERNS, group_cols=["lang"])
    return queue.resume_points(q, " index.html ", ["lang"])


# ---------------------------------------------------------------------------
# reports over corpora
# ---------------------------------------------------------------------------
def q_reset_outcome(spark, sf):
    """How each user's reset ended; mode, status, step and messages follow from the user's events."""
    e = _event_versions(spark, sf)
    n = F.count(F.lit(1))
    outcomes = e.groupBy("user_id").agg(
        F.when(F.max("event_id") % 2 == 0, "reset").otherwise("start").alias("mode"),
        F.when(F.count_if(F.col("event_type") == "error") % 3 == 1, "failure").otherwise("success").alias("status"),
        (n % 5).alias("step"), F.concat(F.lit("load "), F.max("event_type")).alias("step_label"),
        F.concat(F.lit("first line\nlast version "), F.max("version")).alias("error_message"),
        (n % 2 == 0).alias("restored"), (F.min("event_id") % 2 == 0).alias("applied_new"))
    report = reports.reset_summary(_classified_events(spark, sf), outcomes, ["user_id"], F.lit(CUTOFF))
    return report.withColumn("error_lines", F.array_join("error_lines", "|"))


def q_cutoff_report(spark, sf):
    """Cutoff, source and both ledgers' latest of each user; some users have no ledger, some cutoffs are no number."""
    e = _event_versions(spark, sf)
    settings = e.groupBy("user_id").agg(
        F.max(F.when((F.col("event_type") == "signup") & (F.col("value") > 45), F.concat(F.lit(" "), F.col("version"), F.when(F.col("event_id") % 2 == 0, "z").otherwise("")))).alias("argument"),
        F.when(F.min("event_id") % 2 == 0, "staging").alias("env"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") < 5), F.col("version"))).alias("env_config"),
        F.min(F.when(F.col("event_type") == "view", F.col("version"))).alias("config"))
    linked = _alignment(spark, sf).where("user_id % 3 > 0")
    report = reports.cutoff_report(settings, linked, ["user_id"])
    return report.withColumn("cutoff_number", F.col("cutoff_number").cast("long"))


def q_audit_report(spark, sf):
    """The audit of every user's scripts as JSON lines, with evidence."""
    scripts = _scripts(spark, sf)
    keys = ["user_id", "event_id"]
    found = evidence.script_evidence(scripts, keys, "text", [audit.DATA_MARKER, audit.SCHEMA_MARKER])
    return reports.audit_report(audit.classify_scripts(scripts), keys, ["user_id"], found)


def q_sync_split(spark, sf):
    """Five corpora with ledgers from the events; two are aligned and have a dump."""
    from .split_validate import sync_split

    names = {"click": "region.sql", "view": "nation.sql", "purchase": "supplier.sql", "signup": "customer.sql", "error": "part.sql"}
    e = _event_versions(spark, sf).withColumn("file_id", _map(F.col("event_type"), names))
    mine = F.when((F.col("event_type") == "view") & (F.month(F.to_timestamp("version", "yyyyMMddHHmmss")) >= 2), "").otherwise(F.col("version"))
    bad = F.col("event_type") == "error"
    ledgers = e.select("file_id", F.when(bad, F.concat(F.lit("x"), F.col("version"))).otherwise(mine).alias("local"), F.when(bad, "").otherwise(F.col("version")).alias("remote"))
    lines = numbered(*[_dump(_t(spark, sf, t), f"{t}.sql", f"public.{t}", k) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"))])
    out = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-sync-{uuid.uuid4().hex}"
    return sync_split(lines, ledgers, None, out_dir=out)


def q_script_corpus(spark, sf):
    """Twenty documents a script, published as files; names without a version are passed over, or
    fail the strict form, which reads the others in a folder of their own."""
    from pyspark.errors import PySparkException

    from ..sources.members import write_members
    from ..sources.text import read_scripts

    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/sqlfold-scripts-{uuid.uuid4().hex}"
    no = F.floor(F.col("doc_id") / 20)
    name = F.when(no % 10 == 3, F.concat(F.lit("x"), no, F.lit("_a.sql"))).when(no % 10 == 4, F.concat(no, F.lit("a_b.sql"))).otherwise(F.concat(F.lpad(no.cast("string"), 8, "0"), F.lit("_docs_1.sql")))
    d = _t(spark, sf, "documents").select(name.alias("file_name"), F.col("doc_id").alias("position"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("gap"))
    write_members(d, f"{root}/all")
    write_members(d.where(F.col("file_name").rlike("^[0-9]+_")), f"{root}/good")
    try:
        fails = read_scripts(spark, f"{root}/all", strict=True).agg(F.sum(F.length("text"))).first() is None
    except PySparkException:
        fails = True
    loose = read_scripts(spark, f"{root}/all", "loose").withColumn("strict_fails", F.lit(fails))
    both = loose.unionByName(read_scripts(spark, f"{root}/good", "strict", strict=True).withColumn("strict_fails", F.lit(False)))
    return both.select("corpus_id", "name", "version", "strict_fails", F.md5("text").alias("text_md5"))


def q_replay_stubs(spark, sf):
    """The stand-in of each data script that the snapshot already holds."""
    e = _event_versions(spark, sf).withColumn("classification", _map(F.col("event_type"), CLASS_OF_TYPE))
    e = e.withColumn("name", F.concat("version", F.lit("_"), F.col("event_id"), F.lit(".sql")))
    return replay.plan_replay(e, ["user_id"], CUTOFF, tie_cols=["event_id"], name_col="name").where("action = 'skip'").select("event_id", "stub")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dump_roundtrip": q_dump_roundtrip,
    "dump_row_counts": q_dump_row_counts,
    "rows_per_insert": q_rows_per_insert,
    "chunk_by_bytes": q_chunk_by_bytes,
    "pack_files": q_pack_files,
    "limit_overrides": q_limit_overrides,
    "reconcile_counts": q_reconcile_counts,
    "fingerprint_by_group": q_fingerprint_by_group,
    "first_difference": q_first_difference,
    "tree_difference": q_tree_difference,
    "digest_tree": q_digest_tree,
    "version_max": q_version_max,
    "ledger_alignment": q_ledger_alignment,
    "cutoff_resolve": q_cutoff_resolve,
    "cutoff_grid": q_cutoff_grid,
    "replay_plan": q_replay_plan,
    "snapshot_replay": q_snapshot_replay,
    "kind_segments": q_kind_segments,
    "renumber": q_renumber,
    "pattern_evidence": q_pattern_evidence,
    "script_classes": q_script_classes,
    "script_evidence": q_script_evidence,
    "marker_facts": q_marker_facts,
    "category_sequence": q_category_sequence,
    "load_queue": q_load_queue,
    "many_patterns": q_many_patterns,
    "redact_many": q_redact_many,
    "ignore_filter": q_ignore_filter,
    "redact_literals": q_redact_literals,
    "markers_roundtrip": q_markers_roundtrip,
    "deploy_phrase": q_deploy_phrase,
    "resumable_load": q_resumable_load,
    "audit_summary": q_audit_summary,
    "split_plan": q_split_plan,
    "rechunk_statements": q_rechunk_statements,
    "schema_roundtrip": q_schema_roundtrip,
    "dump_split_validate": q_dump_split_validate,
    "reassembled_stream": q_reassembled_stream,
    "stream_text": q_stream_text,
    "load_commits": q_load_commits,
    "stream_load": q_stream_load,
    "dump_file_plan": q_dump_file_plan,
    "schema_members": q_schema_members,
    "split_plan_errors": q_split_plan_errors,
    "split_blocked": q_split_blocked,
    "resume_points": q_resume_points,
    "first_mismatches": q_first_mismatches,
    "quoted_entries": q_quoted_entries,
    "split_scope": q_split_scope,
    "reset_outcome": q_reset_outcome,
    "cutoff_report": q_cutoff_report,
    "audit_report": q_audit_report,
    "sync_split": q_sync_split,
    "script_corpus": q_script_corpus,
    "replay_stubs": q_replay_stubs,
}
