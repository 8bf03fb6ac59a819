"""Reset outcomes, cutoff reports, the audit's lines and the gates in front of a split."""

import json
import os

from pyspark.sql import functions as F

from sqlfold.operators import audit, evidence, ledger, reports
from sqlfold.plans.split_validate import sync_split

CUTOFF = "20240115000000"


def _classified(spark):
    rows = [("a", "pre", "schema"), ("a", "pre", "data"), ("a", "pre", "mixed"), ("a", "post", "data"), ("b", "pre", "schema")]
    return spark.createDataFrame(rows, "c string, phase string, classification string")


def test_reset_summary(spark):
    outcomes = spark.createDataFrame([
        ("a", "reset", "success", None, None, None, None, None),
        ("a", "start", "failure", 3, "load", "no\nluck", True, False),
        ("a", "start", "failure", 4, "check", None, False, True),
        ("b", "reset", None, None, None, "", None, None),
        ("none", "reset", "success", None, None, None, None, None),
    ], "c string, mode string, status string, step int, step_label string, error_message string, restored boolean, applied_new boolean")
    got = [r.asDict() for r in reports.reset_summary(_classified(spark), outcomes, ["c"], F.lit(CUTOFF)).orderBy("c", "headline").collect()]
    done, failed, late = got[0], got[1], got[2]
    assert (done["headline"], done["n_scripts"], done["pre_phrase"], done["skipped_phrase"], done["post_phrase"]) == ("Reset complete", 4, "1 schema · 1 schema+data", "1 data", "1 data")
    assert done["error_lines"] is None and done["restore_note"] is None and (done["pre_label"], done["post_label"]) == ("≤ Jan 15", "> Jan 15")
    assert (failed["headline"], failed["error_lines"], failed["restore_note"]) == ("Start failed at step 3 (load)", ["no", "luck"], "scripts restored")
    assert (failed["pre_phrase"], failed["post_phrase"]) == ("1 schema · 1 schema+data · 1 data", "not applied")
    assert (late["error_lines"], late["restore_note"], late["post_phrase"]) == ([""], "scripts not restored", "1 data")
    assert (got[3]["headline"], got[3]["restore_note"], got[3]["post_phrase"]) == ("Reset failed at step ? (?)", "scripts not restored", "")
    assert (got[4]["headline"], got[4]["n_scripts"], got[4]["pre_phrase"], got[4]["last_deploy"]) == ("Reset complete", 0, "", "Jan 15 2024")


def test_cutoff_report(spark):
    rows = spark.createDataFrame([("a", "20240101000000", "20240101000000"), ("a", "20240103000000", "20240102000000")], "c string, local string, remote string")
    settings = spark.createDataFrame([("a", None, "dev", "20230101000000", None), ("b", " 12x ", None, None, None), ("c", None, None, "bad", "7"), ("d", None, None, None, "bad")],
                                     "c string, argument string, env string, env_config string, config string")
    got = {r.c: r for r in reports.cutoff_report(settings, ledger.alignment(rows, ["c"]), ["c"]).collect()}
    assert (got["a"].cutoff, int(got["a"].cutoff_number), got["a"].source, got["a"].latest_local, got["a"].latest_remote) == ("20240101000000", 20240101000000, "linked", "20240103000000", "20240102000000")
    assert (got["b"].cutoff, got["b"].cutoff_number, got["b"].cutoff_error, got["b"].alignment_error) == ("12x", None, "not a number", "no ledger rows")
    assert (got["c"].cutoff, got["c"].source, got["d"].cutoff, got["d"].cutoff_error) == ("7", "config", None, "no cutoff")


def test_audit_report_lines(spark):
    df = spark.createDataFrame([("a", 1, "create table t"), ("a", 2, None), ("b", 1, "insert into t values (1)")], "c string, id int, text string")
    plain = reports.audit_report(audit.classify_scripts(df), ["c", "id"], ["c"]).orderBy("c", "section", "id").collect()
    docs = [json.loads(r.json) for r in plain]
    assert [(r.c, r.section, r.id) for r in plain] == [("a", 0, None), ("a", 1, 1), ("a", 1, 2), ("b", 0, None), ("b", 1, 1)]
    assert docs[0]["summary"] == {"data": 0, "schema": 1, "mixed": 0, "unknown": 1, "suggested_updates": 1} and docs[0]["metadata"]["verbose"] is False
    assert docs[2]["recommended_marker"] is None and "evidence" not in docs[1]
    found = evidence.script_evidence(df, ["c", "id"], "text")
    told = [json.loads(r.json) for r in reports.audit_report(audit.classify_scripts(df), ["c", "id"], ["c"], found).orderBy("c", "section", "id").collect()]
    assert told[0]["metadata"]["verbose"] is True and told[2]["evidence"] == {"ddl": [], "dml": [], "marker": []}
    assert told[4]["evidence"]["dml"] == [{"pattern": "INSERT INTO", "line": 1, "snippet": "insert into t values (1)"}]


def test_gates_in_front_of_a_split(spark, tmp_path):
    dump = ["INSERT INTO public.t (id) VALUES", "\t(1),", "\t(2);"]
    lines = spark.createDataFrame([(f, i, ln) for f in ("a.sql", "b.sql") for i, ln in enumerate(dump)] + [("e.sql", 0, "")], "file_id string, line_no long, line string")
    blocked = spark.createDataFrame([("a.sql", "2", "1"), ("e.sql", "1", "1"), ("f.sql", "x", "")], "file_id string, local string, remote string")
    out = str(tmp_path / "out")
    report = {r.target: (r.what, r.n_left, r.n_right, r.status) for r in sync_split(lines, blocked, None, out_dir=out).collect()}
    assert report == {"a.sql": ("gate", 3, 0, "blocked"), "b.sql": ("gate", 3, 0, "empty"), "e.sql": ("gate", 1, 0, "no_dump"), "f.sql": ("gate", 0, 0, "empty")}
    assert not os.path.exists(out)
    forced = {(r.what, r.target): (r.n_left, r.n_right, r.status) for r in sync_split(lines, blocked, None, force=True, out_dir=out).collect()}
    assert forced["gate", "b.sql"] == (3, 3, "ok") and forced["gate", "e.sql"] == (1, 0, "no_dump")
    assert forced["rows", "public.t"] == (4, 4, "ok") and forced["statements", "public.t"] == (2, 2, "ok")
