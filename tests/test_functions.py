"""Scalar column functions (X1-X18) on small literal rows."""

from pyspark.sql import functions as F

from sqlfold.functions import text as X


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_counts_names_padding(spark):
    assert _one(spark, X.line_count(F.lit("a\nb\n"))) == 3
    assert _one(spark, X.byte_length(F.lit("é\U0001F600"))) == 6
    assert _one(spark, X.sanitize_name(F.lit("Public.My-Table"))) == "public_my_table"
    assert _one(spark, X.padded(F.lit(1000), 3)) == "1000"
    assert _one(spark, X.padded(F.lit(7), 4)) == "0007"
    assert X.glob_to_regex("seeds/*.sql", "[^/]*") == "^seeds/[^/]*\\.sql$"


def test_trims_and_normalising(spark):
    assert _one(spark, X.js_trim_col(F.lit("﻿\t x  \n"))) == "x"
    assert _one(spark, X.normalize_script(F.lit("a\r\nb  \n\n"))) == "a\nb\n"
    assert _one(spark, X.normalize_statement(F.lit("  SELECT\n  1 "))) == "select 1"


def test_markers(spark):
    assert _one(spark, X.prepend_marker(F.lit("﻿SELECT 1;"), "m")) == "﻿-- m\n\nSELECT 1;"
    assert _one(spark, X.prepend_marker(F.lit("SELECT 1;"), "m")) == "-- m\n\nSELECT 1;"
    # exactly "-- m" or "--m", whatever is around; other spellings stay
    assert tuple(_one(spark, X.remove_marker_lines(F.lit("-- m\nSELECT 1;\n  --m\r\n--  m"), ["m"]))) == ("SELECT 1;\n--  m", True)
    assert tuple(_one(spark, X.remove_marker_lines(F.lit("\ufeff-- m\nSELECT 1;"), ["m"]))) == ("\ufeffSELECT 1;", True)
    assert tuple(_one(spark, X.remove_marker_lines(F.lit("-- mm"), ["m"]))) == ("-- mm", False)


def test_phrases_and_stubs(spark):
    row = spark.createDataFrame([(2, 0, 1, 3)], "schema long, data long, mixed long, unknown long")
    assert row.select(X.class_phrase({k: F.col(k) for k in X.CLASS_ORDER})).first()[0] == \
        "2 schema · 1 schema+data · 3 unrecognized"
    assert _one(spark, X.deploy_date_short(F.lit("20260309180959"))) == "Mar 9"
    assert _one(spark, X.strip_version_prefix(F.lit("20260101_add_x.sql"))) == "add_x.sql"
    assert _one(spark, X.quoted_entries(F.lit("[\"./a/*.sql\", './b.sql']"))) == ["./a/*.sql", "./b.sql"]
    assert _one(spark, X.noop_stub(F.lit("1_x.sql"), F.lit("2026"))).startswith("-- skipped: 1_x.sql")
    assert _one(spark, X.wrap_transaction(F.lit("X;\n"), F.lit(True))) == "BEGIN;\nX;\n\nCOMMIT;\n"
    ev = spark.createDataFrame([([("CREATE TABLE", 3, "s")],), ([],)], "m array<struct<pattern:string,line:int,snippet:string>>")
    assert [r[0] for r in ev.select(X.evidence_phrase("m")).collect()] == ["CREATE TABLE@L3", "none"]


def test_ignore_keep_guard_and_json(spark):
    import pytest

    from sqlfold.operators import queue
    from sqlfold.sources.text import guard_nonempty

    names = spark.createDataFrame([("001_setup.sql",), ("002_a.sql",), ("999_cleanup.sql",), ("x.sql",)], "name string")
    kept = queue.ignore_filter(names, ["999_*", "dir/x.sql"], "name").collect()
    assert sorted(r.name for r in kept) == ["001_setup.sql", "002_a.sql"]
    paths = spark.createDataFrame([("a/b/keep.sql",), ("a/other.sql",), ("c/keep.sql",)], "path string")
    assert sorted(r.path for r in queue.keep_filter(paths, ["keep.sql"]).collect()) == ["a/b/keep.sql", "c/keep.sql"]
    assert [r.path for r in queue.keep_filter(paths, ["a/b/keep.sql"]).collect()] == ["a/b/keep.sql"]
    assert sorted(r.path for r in queue.keep_filter(paths, ["a/*"]).collect()) == ["a/b/keep.sql", "a/other.sql"]
    with pytest.raises(ValueError):
        guard_nonempty(names.filter("false"))
