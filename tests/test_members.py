"""The members sink: true files, all of them or none; the load log and its commit."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sqlfold.operators import queue
from sqlfold.plans.split_validate import file_plan, reassembled_files
from sqlfold.sources.members import FORMAT, MemberFiles, read_manifest, write_members
from sqlfold.sources.text import read_chunk_files


def plan(spark, rows):
    return spark.createDataFrame(rows, "file_name string, position long, text string, gap boolean").repartition(5)


def files(folder):
    return {n: open(os.path.join(folder, n), "rb").read() for n in sorted(os.listdir(folder)) if not n.startswith((".", "_"))}


def test_files_have_their_names_and_bytes(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(f"{n:03d}_public_t{n}.sql", p, f"INSERT é {n};\nline {p}", True) for n in range(1, 40) for p in range(1, 4)]
    write_members(plan(spark, rows), out)
    want = {f: "\n\n".join(t for g, _, t, _ in rows if g == f).encode() + b"\n" for f, *_ in rows}
    assert files(out) == want
    told = {r["name"]: (r["rows"], r["bytes"], r["sha256"]) for r in read_manifest(spark, out).collect()}
    assert told == {n: (3, len(b), hashlib.sha256(b).hexdigest()) for n, b in want.items()}
    assert sorted(os.listdir(out)) == [*sorted(want), "_members"]
    # a later plan replaces all files, those that it does not name as well
    write_members(plan(spark, [("001_a.sql", 1, "x", False)]), out)
    assert files(out) == {"001_a.sql": b"x\n"}


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    out = str(tmp_path / "out")
    write_members(plan(spark, [("001_a.sql", 1, "x", False)]), out)
    before = sorted(os.listdir(out))
    bad = plan(spark, [("002_b.sql", 1, "y", False), ("003_c.sql", 1, "z", False)]).withColumn("text", F.when(F.col("file_name") == "003_c.sql", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        write_members(bad, out)
    with pytest.raises(Exception, match="no name of a member"):
        write_members(plan(spark, [("../x.sql", 1, "y", False)]), out)
    # rows of one file in two tasks: nothing is published
    apart = plan(spark, [("004_d.sql", p, "y", False) for p in range(40)]).select("file_name", F.col("text").alias("value"))
    spark.dataSource.register(MemberFiles)
    with pytest.raises(Exception, match="came apart"):
        apart.write.format(FORMAT).mode("overwrite").option("path", out).save()
    with pytest.raises(Exception, match="members exist"):
        apart.limit(1).withColumn("file_name", F.lit("001_a.sql")).write.format(FORMAT).mode("append").option("path", out).save()
    with pytest.raises(ValueError, match="empty"):
        write_members(plan(spark, []), out)
    assert sorted(os.listdir(out)) == before and files(out) == {"001_a.sql": b"x\n"}


def test_members_beyond_number_999_stay_in_order(spark, tmp_path):
    n = 1005
    text = [ln for k in range(n) for ln in (f"INSERT INTO public.t{k:04d} (a) VALUES", f"\t({k});")] + ["SELECT pg_catalog.setval('s', 1, true);"]
    lines = spark.createDataFrame([("d.sql", i + 1, ln) for i, ln in enumerate(text)], "file_id string, line_no long, line string")
    out = str(tmp_path / "out")
    write_members(file_plan(lines, None), out)
    back = [r["line"] for r in reassembled_files(read_chunk_files(spark, out)).orderBy("line_no").collect()]
    tables = [ln for k in range(n) for ln in ("", f"INSERT INTO public.t{k:04d} (a) VALUES", f"\t({k});")]
    assert back[2:] == [*tables, "", "-- Sequence values", text[-1], "", "-- Cleanup", "RESET ALL;"]
    assert f"{n + 3}_cleanup.sql" in files(out)


def test_a_wave_counts_once_it_is_logged(spark, tmp_path):
    data, log = str(tmp_path / "data"), str(tmp_path / "log")
    rows = spark.createDataFrame([(f"f{i % 4}", i, None if i % 5 == 0 else f"t{i}") for i in range(40)], "file_id string, n long, text string")
    q = rows.select(F.col("file_id").alias("path")).distinct()
    of = lambda names: rows.join(names.select(F.col("path").alias("file_id")), "file_id")
    assert queue.load_log(spark, log).count() == 0 and queue.pending(q, queue.load_log(spark, log)).count() == 4
    queue.commit_wave(of(q.filter("path = 'f0'")), data, log, 1, order_cols=["n"])
    queue.load_wave(of(q.filter("path = 'f1'")).filter("n > 20"), data, "file_id", ["n"])  # ends before its log
    checked = lambda: {r["path"]: r["status"] for r in queue.verify_loads(spark.read.schema(rows.schema).parquet(data), queue.load_log(spark, log), "file_id", ["n", "text"]).collect()}
    assert checked() == {"f0": "ok", "f1": "unlogged"}
    left = queue.pending(q, queue.load_log(spark, log))
    assert sorted(r["path"] for r in left.collect()) == ["f1", "f2", "f3"]
    queue.commit_wave(of(left), data, log, 2, order_cols=["n"])
    assert checked() == dict.fromkeys(["f0", "f1", "f2", "f3"], "ok")
    assert {r["path"]: (r["rows"], r["wave"]) for r in queue.load_log(spark, log).collect()} == {"f0": (10, 1), "f1": (10, 2), "f2": (10, 2), "f3": (10, 2)}
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).parquet(data).select("n").collect()) == [(i,) for i in range(40)]
    queue.load_wave(of(q.filter("path = 'f2'")).filter("n < 5"), data, "file_id", ["n"])
    assert checked()["f2"] == "changed"
