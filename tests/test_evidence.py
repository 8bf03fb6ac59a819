"""Evidence rows, statement kinds and audit documents on hand-written scripts."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from sqlfold.functions import lexer
from sqlfold.operators import audit, evidence

KEYS = ["id"]


def _df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def _rows(found, family):
    rows = found.where(F.col("family") == family).orderBy("id", "pattern_no", "match_no").collect()
    return [(r["pattern"], r["line"], r["snippet"]) for r in rows]


def test_statement_kind(spark):
    texts = ["CREATE TABLE t (a int)", "insert into t values ('create table x')", "select 1 -- drop table x",
             "select 1;\n update t set a = 1", "select * from t for update", "x update y", "update a b; update c d", None]
    masked = _df(spark, *texts).withColumn("m", evidence.mask(F.col("text")))
    got = masked.select("id", evidence.statement_kind(F.col("m")).alias("k")).orderBy("id").collect()
    assert [r["k"] for r in got] == ["schema", "data", None, "data", None, None, "data", None]


def test_matches_over_lines_and_on_one_line(spark):
    text = "create\n\ttable a; create table b;\ndrop\ntable c; create table d -- create table e\n"
    found = evidence.script_evidence(_df(spark, text), KEYS, "text")
    assert _rows(found, "ddl") == [("CREATE TABLE", 1, "create"), ("CREATE TABLE", 2, "table a; create table b;"),
                                    ("CREATE TABLE", 4, "table c; create table d"), ("DROP TABLE", 3, "drop")]
    assert [r["rank"] for r in evidence.top_evidence(found, KEYS, 2).orderBy("rank").collect()] == [1, 2]


def test_updates_that_count(spark):
    text = ("update a set x = 1; update b\n set y = 1\n; select 1 for update\n  \tUPDATE c d\n"
            "create trigger t before update on z\n update q on update w\nx update y\n")
    assert _rows(evidence.script_evidence(_df(spark, text), KEYS, "text"), "dml") == [
        ("UPDATE", 1, "update a set x = 1; update b"), ("UPDATE", 1, "update a set x = 1; update b")]
    # what follows "for" takes the next word with it, as one search over the text does
    later = "select 1 for update;\n update q z\n"
    assert _rows(evidence.script_evidence(_df(spark, later), KEYS, "text"), "dml") == [("UPDATE", 2, "update q z")]


def test_markers_and_snippets(spark):
    text = "\ufeff--  my:mark more\nselect 1;\n   -- MY:MARK\n-- my:marker\n"
    found = evidence.script_evidence(_df(spark, text, "create table " + "x" * 300), KEYS, "text", ["my:mark"])
    assert _rows(found, "marker") == [("my:mark", 1, "--  my:mark more"), ("my:mark", 3, "-- MY:MARK\n-- my:marker")]
    (snippet,) = [r[2] for r in _rows(found, "ddl")]
    assert len(snippet) == 180 and snippet.endswith("...")


def test_audit_documents(spark):
    df = _df(spark, "create table a;\ninsert into a values (1);", "select 1")
    found = evidence.script_evidence(df, KEYS, "text")
    docs = {r["id"]: json.loads(r["json"]) for r in audit.audit_documents(audit.classify_scripts(df), found, KEYS).collect()}
    assert docs[0]["classification"] == "mixed" and docs[0]["evidence"]["dml"][0]["line"] == 2
    assert docs[1]["classification"] == "unknown" and "evidence" not in docs[1]


def test_one_pass_equals_a_search_per_pattern():
    words = ["create", "CREATE ", "table", "or replace ", "view", "insert", "into", "update", "for", "on", "x", "İ", " ", "\n", ";", "\t", "drop",
             "delete from", "unique", "index", "re", "_", "--", "'"]
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(40)))
        masked = lexer.mask_sql(text)
        lines = masked.split("\n")
        expected = []
        for family, patterns in (("ddl", evidence.DDL_EVIDENCE), ("dml", [*evidence.DML_EVIDENCE, evidence.UPDATE])):
            for no, (name, rx) in enumerate(patterns):
                for k, m in enumerate(re.finditer(rx, masked, re.I | re.A)):
                    before = masked[:m.start()]
                    line = lines[before.count("\n")].strip()
                    counts = re.search(r"(?:\A|[;\n])[ \t\r]*\Z", before) and not re.search(evidence.UPDATE_NOT_DML, line, re.I)
                    if name != "UPDATE" or counts:
                        expected.append((family, no, name, k, before.count("\n") + 1, line))
        assert sorted(evidence._statement_matches(text, 10**6)) == sorted(expected), text


def test_markers_equal_a_search_of_the_pattern():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["--", "my:mark", "MY:mark", " ", "\n", "\n", "\t", " ", "x", ";"]) for _ in range(rng.randrange(25)))
        expected = [(m.group().strip(evidence._TRIM), text[:m.start()].count("\n") + 1) for m in re.finditer(evidence.marker_pattern("my:mark").replace("$", r"\Z") + ".*", text)]
        got = [(r[5], r[4]) for r in evidence._marker_matches(text, [("my:mark", evidence._marker_line("my:mark"))])]
        assert got == expected, text


def test_many_hits_in_one_script_take_linear_time(spark):
    text = "select 1 for update x;\n" * 40_000 + "update a set b = 1;\n" * 40_000
    df = _df(spark, text, "", None)
    start = time.time()
    found = evidence.script_evidence(df, KEYS, "text")
    assert found.agg(F.count("*"), F.max("line")).first()[:] == (40_000, 80_000)
    kinds = df.select(evidence.statement_kind(evidence.mask("text")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["data", None, None]
    assert time.time() - start < 60


def test_keys_keep_their_values_and_types(spark):
    df = spark.createDataFrame([(None, "a", "drop table x"), (2**60, None, "drop table y")], "pattern_key long, k string, text string")
    found = evidence.script_evidence(df, ["pattern_key", "k"], "text")
    assert {tuple(r)[:2] for r in found.collect()} == {(None, "a"), (2**60, None)}
