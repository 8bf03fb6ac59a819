"""Ledger parsing/alignment, queues, resume, redaction, markers and split plans."""

import pytest
from pyspark.sql import functions as F

from sqlfold.functions.text import deploy_date, redact
from sqlfold.operators import audit, ledger, queue, splitplan
from sqlfold.sources.text import parse_ledger


def _align(spark, text):
    lines = spark.createDataFrame([("c", i, ln) for i, ln in enumerate(text.split("\n"))], "c string, n int, line string")
    rows = parse_ledger(lines, keep=["c"])
    return rows, ledger.alignment(rows, ["c"]).collect()


def test_backticks_and_empty_remote(spark):
    rows, al = _align(spark, "\n".join([
        "`20250101000000` | `20250101000000` | `t1`",
        "`20250105000000` | `20250105000000` | `t2`",
        "`20250106000000` | ` `              | `t3`",
    ]))
    assert (al[0].latest_local, al[0].latest_remote, al[0].latest_aligned) == ("20250106000000", "20250105000000", "20250105000000")
    last = [r for r in rows.collect() if r.local == "20250106000000"][0]
    assert last.remote == "" and last.time_utc == "t3"


@pytest.mark.parametrize("sep", ["|", "│"])
def test_separators_and_gaps(spark, sep):
    _, al = _align(spark, "\n".join([
        f"Local {sep} Remote {sep} Time (UTC)",
        f"20250101000000 {sep} 20250101000000 {sep} a",
        f"20250102000000 {sep}                {sep} b",
        f"               {sep} 20250103000000 {sep} c",
    ]))
    assert (al[0].latest_local, al[0].latest_remote, al[0].latest_aligned) == ("20250102000000", "20250103000000", "20250101000000")


def test_malformed_versions(spark):
    rows, al = _align(spark, "\n".join(["` ` | ` ` | ` `", "`nope` | `nope` | `x`", "`20250101000000 | `20250101000000 | y"]))
    assert rows.count() == 2
    assert (al[0].latest_local, al[0].latest_remote, al[0].latest_aligned) == (None, None, None)


def test_queue_and_resume(spark):
    files = spark.createDataFrame([("seeds/002_orders.sql",), ("seeds/001_orders.sql",), ("other/x.sql",)], "path string")
    pats = queue.patterns_table(spark, ["./seeds/*.sql", "seeds/001_*.sql"])
    q = queue.load_queue(files, pats).orderBy("queue_no").collect()
    assert [r.path for r in q] == ["seeds/001_orders.sql", "seeds/002_orders.sql"]
    assert [r.pattern_no for r in q] == [1, 1]
    rest = queue.resume_from(queue.load_queue(files, pats), "002_orders.sql").collect()
    assert [r.path for r in rest] == ["seeds/002_orders.sql"]
    with pytest.raises(ValueError):
        queue.resume_from(queue.load_queue(files, pats), "nope.sql")


def test_redaction_in_order(spark):
    df = spark.createDataFrame([(1, "user=bob pass=hunter2 again hunter2")], "id long, text string")
    out = df.select(redact(F.col("text"), F.array(F.lit("hunter2"), F.lit("bob"), F.lit("")))).first()[0]
    assert out == "user=[REDACTED] pass=[REDACTED] again [REDACTED]"


def test_deploy_date(spark):
    df = spark.createDataFrame([("20260309180959",), ("2026",), ("20261309000000",)], "v string")
    assert [r[0] for r in df.select(deploy_date("v")).collect()] == ["Mar 9 2026", "2026", "13 9 2026"]


def test_audit_and_markers(spark):
    df = spark.createDataFrame([
        ("a", "-- sqlfold:data-migration\nUPDATE t SET a = 1;"),
        ("b", "create table x (a int);\ninsert into x values (1);"),
        ("c", "select 1 for update;"),
    ], "id string, text string")
    a = {r.id: r for r in audit.classify_scripts(df).collect()}
    assert a["a"].classification == "data" and a["a"].source == "marker" and a["a"].recommended_marker is None
    assert a["b"].classification == "mixed"
    assert a["c"].classification == "unknown"
    back = audit.unmark(df.filter("id = 'a'")).first()
    assert back.removed and back.new_text == "UPDATE t SET a = 1;"


def test_split_plan_full_and_cutoff(spark):
    scripts = spark.createDataFrame([
        ("c", "20260101000000_first.sql", "20260101000000", "CREATE TABLE a (x int);\nINSERT INTO a VALUES (1);\n"),
        ("c", "20260102000000_second.sql", "20260102000000", "BEGIN;\nCREATE TABLE b (x int);\nINSERT INTO b VALUES (1);\nCOMMIT;\n"),
    ], "corpus_id string, name string, version string, text string")
    full = spark.createDataFrame([("c", "20260101000000_first.sql"), ("c", "20260102000000_second.sql")], "corpus_id string, name string")
    plan = splitplan.split_plan(scripts, full).orderBy("new_version").collect()
    assert [r.new_name for r in plan] == ["20260101000000_first_schema_1.sql", "20260101000001_first_data_2.sql",
                                           "20260101000002_second_schema_1.sql", "20260101000003_second_data_2.sql"]
    assert plan[2].content.startswith("BEGIN;\n") and plan[2].content.endswith("COMMIT;\n")
    later = spark.createDataFrame([("c", "20260102000000_second.sql")], "corpus_id string, name string")
    plan2 = splitplan.split_plan(scripts, later).collect()
    assert len(plan2) == 2 and {r.new_version for r in plan2} == {"20260102000000", "20260102000001"}
    remote = spark.createDataFrame([("c", "20260102000000")], "corpus_id string, remote string")
    touched = scripts.filter(F.col("version") >= "20260102000000")
    assert splitplan.blocked_by_remote(touched, remote, ["corpus_id"]).count() == 1


def test_split_scope(spark):
    a = spark.createDataFrame([("1_a.sql", "20260101000000", "mixed"), ("2_b.sql", "20260102000000", "mixed"),
                               ("3_c.sql", "20260103000000", "data")], "name string, version string, classification string")
    assert splitplan.split_scope(a, scope="all").count() == 2
    assert [r.name for r in splitplan.split_scope(a, "20260101000000").collect()] == ["2_b.sql"]


def test_chunk_and_statement_files_roundtrip(spark, tmp_path):
    from sqlfold.sources.text import read_chunk_files, read_statement_files, write_statement_files

    # two dumps with members of one name: each keeps its own
    st = spark.createDataFrame([("f1.sql", "tables", "04_tables/0001_a.sql", 1, 2, "CREATE TABLE a (\n x int);\n"),
                                ("f2.sql", "tables", "04_tables/0001_a.sql", 1, 1, "CREATE TABLE a (y int);\n"),
                                ("f1.sql", "indexes", "07_indexes/0001_i.sql", 3, 3, "CREATE INDEX i ON a (x);\n")],
                               "file_id string, category string, file_name string, line_start long, line_end long, text string")
    out = str(tmp_path / "schema")
    write_statement_files(st, out)
    back = read_statement_files(spark, out).orderBy("file_id", "line_start").collect()
    assert [(r.file_id, r.category, r.line_start, r.text) for r in back] == [
        ("f1.sql", "tables", 1, "CREATE TABLE a (\n x int);\n"), ("f1.sql", "indexes", 3, "CREATE INDEX i ON a (x);\n"), ("f2.sql", "tables", 1, "CREATE TABLE a (y int);\n")]
    index = spark.read.json(out + "/index").orderBy("file_id", "startLine").collect()
    assert [(r.file_id, r.startLine) for r in index] == [("f1.sql", 1), ("f1.sql", 3), ("f2.sql", 1)]
    assert all(spark.read.parquet(f"{out}/{r.path}").filter(F.col("file_name") == r.member).count() == 1 for r in index)
    with pytest.raises(ValueError):
        write_statement_files(st.limit(0), out)
    d = tmp_path / "chunks"
    (d / "x").mkdir(parents=True)
    for name, txt in [("002_public_t_01.sql", "a;\n"), ("002_public_t_02.sql", "b;\nb2"), ("x/002_public_t_02.sql", "other;"), ("010_public_log_2024.sql", "c;\n"),
                      ("keep.txt", "x"), ("999_cleanup.sql", "RESET ALL;")]:
        (d / name).write_text(txt)
    rows = read_chunk_files(spark, str(d), ignore=["999_*"]).orderBy("table_no", "suffix_no", "file_id", "line_no").collect()
    assert [(r.table_no, r.suffix_no, r.line_no, r.line) for r in rows] == [(2, 1, 1, "a;"), (2, 2, 1, "b;"), (2, 2, 2, "b2"), (2, 2, 1, "other;"), (10, 2024, 1, "c;")]


def test_plan_replay_orders_and_stubs(spark):
    from sqlfold.operators import replay

    s = spark.createDataFrame([
        ("c", "1_s.sql", "20260101000000", "schema"), ("c", "2_d.sql", "20260102000000", "data"),
        ("c", "4_m.sql", "20260104000000", "mixed"), ("c", "3_d.sql", "20260103000000", "data"),
        ("c", "0_m.sql", "20251231000000", "mixed"),
    ], "corpus_id string, name string, version string, classification string")
    p = {r.name: r for r in replay.plan_replay(s, ["corpus_id"], "20260102000000", name_col="name").collect()}
    assert (p["1_s.sql"].action, p["2_d.sql"].action, p["3_d.sql"].action) == ("rebuild", "skip", "replay")
    assert (p["3_d.sql"].replay_seq, p["4_m.sql"].replay_seq) == (1, 2)
    assert (p["4_m.sql"].policy_status, p["0_m.sql"].policy_status) == ("needs_split", "warn")
    assert p["2_d.sql"].stub.startswith("-- skipped: 2_d.sql") and p["1_s.sql"].stub is None


def test_written_chunk_files_read_back(spark, tmp_path):
    from sqlfold.plans.split_validate import reassembled_files
    from sqlfold.sources.text import read_chunk_files, write_chunk_files

    plan = spark.createDataFrame([
        ("002_public_t_01.sql", 1, True, 1, "INSERT INTO public.t VALUES\n\t(1);"),
        ("002_public_t_01.sql", 2, True, 1, "INSERT INTO public.t VALUES\n\t(2);"),
        ("002_public_t_02.sql", 1, True, 2, "INSERT INTO public.t VALUES\n\t(3);"),
    ], "file_name string, position long, gap boolean, part_no long, text string")
    out = str(tmp_path / "split")
    write_chunk_files(plan, out)
    back = read_chunk_files(spark, out)
    assert {(r.name, r.suffix_no) for r in back.collect()} == {("002_public_t_01.sql", 1), ("002_public_t_02.sql", 2)}
    lines = [r.line for r in reassembled_files(back).orderBy("line_no").collect()]
    insert = "INSERT INTO public.t VALUES"
    assert lines == [insert, "\t(1);", "", insert, "\t(2);", "", insert, "\t(3);"]


def test_split_plan_errors_and_numbers(spark):
    tx = "BEGIN;\nCREATE TABLE b (x int);\nINSERT INTO b VALUES (1);\nCOMMIT;\n"
    scripts = spark.createDataFrame([
        ("c", "0008_z.sql", "0008", "SELECT 8;"), ("c", "0009_a.sql", "0009", tx), ("c", "10_empty.sql", "10", "BEGIN; COMMIT;"),
        ("c", "11_open.sql", "11", "BEGIN;\nSELECT 1;"), ("c", "12_back.sql", "12", "ROLLBACK;\nSELECT 1;"), ("c", "13_last.sql", "13", "SELECT 13;"),
    ], "corpus_id string, name string, version string, text string")
    names = ["0009_a.sql", "0009_a.sql", "10_empty.sql", "11_open.sql", "12_back.sql", "nowhere.sql"]
    plan = splitplan.split_plan(scripts, spark.createDataFrame([("c", n) for n in names], "corpus_id string, name string"))
    got = sorted((r.new_name or "", r.name, r.error or "", r.content or "") for r in plan.collect())
    assert [(n, e) for n, _, e, _ in got] == [
        ("", "script not found"), ("10_a_data_2.sql", ""), ("11_empty.sql", "no separable schema/data groups"), ("12_open.sql", "unbalanced BEGIN/COMMIT"),
        ("13_back.sql", "top-level ROLLBACK"), ("14_last.sql", ""), ("9_a_schema_1.sql", "")]
    assert got[-1][3] == "BEGIN;\nCREATE TABLE b (x int);\n\nCOMMIT;\n"
    changes = splitplan.changes_by_source(plan.filter("new_name is not null"), ["corpus_id"]).orderBy("change_no").collect()
    assert [(r.name, r.kind) for r in changes][:2] == [("0009_a.sql", "split"), ("10_empty.sql", "split")] and changes[-1].name == "13_last.sql"


def test_runs_keep_repeated_order_keys(spark):
    df = spark.createDataFrame([("g", 1, "schema", "a"), ("g", 1, None, "b"), ("g", 2, "data", "c"), (None, 1, None, "d")], "g string, i long, kind string, t string")
    got = splitplan.kind_runs(df, ["g"], "i").collect()
    assert sorted(r.t for r in got) == ["a", "b", "c", "d"] and {r.t: r.segment_no for r in got}["c"] == 2


def test_resume_points_of_groups(spark):
    q = spark.createDataFrame([("a", 1, "x/1.sql", "1.sql"), ("a", 2, "x/2.sql", "2.sql"), ("b", 1, "y/1.sql", "1.sql")], "g string, queue_no long, path string, base_name string")
    assert {r.g: r.resume_no for r in queue.resume_points(q, "2.sql", ["g"]).collect()} == {"a": 2, "b": None}
    assert queue.resume_from(q, "1.sql", ["g"]).count() == 3
    with pytest.raises(Exception, match="resume point not found"):
        queue.resume_from(q, "2.sql", ["g"]).collect()


def test_failed_load_resumes_without_repeating(spark, tmp_path):
    """Queue 001, 002; the load of 002 fails; the re-run takes only what the log lacks: three loads."""
    files = spark.createDataFrame([("seeds/001_orders.sql",), ("seeds/002_orders.sql",)], "path string")
    q = queue.load_queue(files, ["./seeds/*.sql"]).withColumn("file_id", F.col("base_name"))
    out = str(tmp_path / "loaded")
    attempts = []

    def run(todo, fail_on=None):
        for r in todo.orderBy("queue_no").collect():
            attempts.append(r.base_name)
            if r.base_name == fail_on:
                return  # the failing file writes nothing; later files wait
            rows = spark.createDataFrame([(r.base_name, r.queue_no)], "file_id string, queue_no long")
            queue.load_wave(rows, out)

    run(q, fail_on="002_orders.sql")
    log = spark.read.parquet(out).select(F.col("file_id").alias("file_id"))
    run(queue.pending(q, log, "file_id"))
    assert attempts == ["001_orders.sql", "002_orders.sql", "002_orders.sql"]
    assert sorted(r.file_id for r in spark.read.parquet(out).collect()) == ["001_orders.sql", "002_orders.sql"]
