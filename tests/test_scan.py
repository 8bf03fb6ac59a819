"""Partition invariance of the parallel folds: same answer for 1, 3 and 17 partitions."""

import random

import pytest
from pyspark.sql import Window, functions as F

from sqlfold.operators import packing, scan, statements
from sqlfold.operators.scan import greedy_pack, ordinal


def _dump_lines(spark):
    rng = random.Random(7)
    lines = ["-- header", "SET x = 1;", ""]
    expect = []
    for s in range(12):
        tbl = f"public.t{s % 3}"
        lines.append(f"INSERT INTO {tbl} (id, body) VALUES")
        n = rng.randint(1, 9)
        for i in range(n):
            parts = [rng.choice(["a", "b;c", "it''s", "x -- y", "$$", "/* z */"]) for _ in range(rng.randint(1, 3))]
            body = "\n".join(parts)
            expect.append((tbl, f"({s * 100 + i}, '{body}')"))
            txt = f"\t({s * 100 + i}, '{body}')" + (";" if i == n - 1 else ",")
            lines.extend(txt.split("\n"))
        lines.append("")
    lines.append("SELECT pg_catalog.setval('public.t0_id_seq', 3, true);")
    rows = [("dump.sql", i + 1, ln) for i, ln in enumerate(lines)]
    return spark.createDataFrame(rows, "file_id string, line_no long, line string"), expect


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_dump_scan_partition_invariant(spark, parts):
    lines, expect = _dump_lines(spark)
    scan = statements.dump_scan(lines, num_partitions=parts)
    rows = statements.rows_from_scan(scan).select("target", "tuple").collect()
    assert sorted((r.target, r.tuple) for r in rows) == sorted(expect)
    st = statements.statements_from_scan(scan).collect()
    assert len(st) == 12 and sum(r.n_rows for r in st) == len(expect)
    assert statements.sequence_lines(scan).count() == 1


def _greedy(ws, base, limit, maxc):
    out, chunk, cnt, size = [], 0, 0, base
    for w in ws:
        if cnt > 0 and (cnt >= maxc or size + w > limit):
            chunk, cnt, size = chunk + 1, 0, base
        if cnt == 0 and chunk == 0:
            chunk = 1
        cnt += 1
        size += w
        out.append(chunk)
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_greedy_pack_matches_sequential(spark, parts):
    rng = random.Random(parts)
    data = []
    for g in range(4):
        n = rng.randint(1, 300) if g else 400  # one hot group
        for i in range(n):
            data.append((g, i, float(rng.randint(1, 60))))
    df = spark.createDataFrame(data, "g int, i int, w double")
    got = greedy_pack(df, ["g"], ["i"], ["w"], [100.0], 5, num_partitions=parts).collect()
    got = {(r.g, r.i): r.chunk_no for r in got}
    for g in range(4):
        ws = [w for gg, i, w in data if gg == g]
        exp = _greedy(ws, 0.0, 100.0, 5)
        assert [got[(g, i)] for i in range(len(ws))] == exp


@pytest.mark.parametrize("parts", [1, 5])
def test_ordinal_equals_row_number(spark, parts):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 500).alias("o"))
    got = ordinal(df, ["g"], ["o"], "n", num_partitions=parts)
    exp = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(tuple, got.select("g", "o", "n").collect())) == sorted(map(tuple, exp.collect()))


def test_rechunk_rows_gate_and_bytes(spark):
    rows = spark.createDataFrame([("t", i, 10 + i, 20) for i in range(10)], "target string, row_no int, tuple_bytes long, header_bytes long")
    out = packing.rechunk_rows(rows, ["target"], ["row_no"], "header_bytes", 3, 70).orderBy("row_no").collect()
    # open at 22; +12 +13 +14 = 61; +15 > 70 -> new chunk, etc.
    assert [r.chunk_no for r in out] == _greedy([12 + i for i in range(10)], 22.0, 70.0, 3)


def test_scan_outputs_survive_union_renumbering(spark):
    """Per-partition state is keyed on the stamped range partition, not the task index:
    putting another DataFrame first in a union renumbers tasks and must not change results."""
    rng = random.Random(3)
    data = [(g, i, float(rng.randint(1, 60))) for g in range(3) for i in range(400)]
    df = spark.createDataFrame(data, "g int, i int, w double")
    packed = greedy_pack(df, ["g"], ["i"], ["w"], [100.0], 5, num_partitions=7)
    filler = spark.range(0, 50, numPartitions=5).select(
        F.lit(-1).alias("g"), F.col("id").cast("int").alias("i"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("chunk_no"))
    both = filler.unionByName(packed).filter("g >= 0").collect()
    got = {(r.g, r.i): r.chunk_no for r in both}
    for g in range(3):
        ws = [w for gg, i, w in data if gg == g]
        assert [got[(g, i)] for i in range(len(ws))] == _greedy(ws, 0.0, 100.0, 5)
    pos = ordinal(df, ["g"], ["i"], "n", num_partitions=7)
    both = filler.drop("chunk_no").withColumn("n", F.lit(0).cast("long")).unionByName(pos).filter("g >= 0").collect()
    assert all(r.n == r.i + 1 for r in both)


def test_dump_scan_ignores_input_order(spark):
    lines, expect = _dump_lines(spark)
    shuffled = lines.orderBy(F.rand(11)).repartition(5)
    rows = statements.rows_from_scan(statements.dump_scan(shuffled, num_partitions=4)).select("target", "tuple").collect()
    assert sorted((r.target, r.tuple) for r in rows) == sorted(expect)


def test_many_small_files_skip_speculation(spark):
    """Files that never span a partition cut need no speculative pass; results stay exact."""
    from sqlfold.operators import scan as S

    rows, expect = [], []
    for f in range(40):
        rows.append((f"f{f:02d}.sql", 1, f"INSERT INTO public.t{f % 3} (a) VALUES ({f}, 'x;y'), ({f + 100}, 'z');"))
        expect += [(f"public.t{f % 3}", f"({f}, 'x;y')"), (f"public.t{f % 3}", f"({f + 100}, 'z')")]
    df = spark.createDataFrame(rows, "file_id string, line_no long, line string")
    before = S.STATS["speculated_partitions"]
    got = statements.rows_from_scan(statements.dump_scan(df, num_partitions=4)).select("target", "tuple").collect()
    assert sorted((r.target, r.tuple) for r in got) == sorted(expect)
    assert S.STATS["speculated_partitions"] == before  # one-line files never continue across partitions


@pytest.mark.parametrize("parts", [1, 5])
def test_counts_equal_the_full_scan(spark, parts):
    lines = ["INSERT INTO public.f (id) VALUES", "\t(1), (2),", "\t('a;", "b');", "SELECT pg_catalog.setval('x', 1);", "INSERT INTO public.g SELECT 1;",
             "INSERT INTO public.f (id) VALUES (1) ON CONFLICT DO NOTHING;"]
    df = spark.createDataFrame([("d.sql", i + 1, ln) for i, ln in enumerate(lines)], "file_id string, line_no long, line string")
    full = statements.statements_from_scan(statements.dump_scan(df, num_partitions=parts))
    counts = statements.count_scan(df, num_partitions=parts)
    cols = ["stmt_no", "line_start", "line_end", "target", "n_lines", "n_bytes", "n_rows"]
    assert sorted(map(tuple, statements.statements_from_counts(counts).select(cols).collect())) == sorted(map(tuple, full.select(cols).collect()))
    assert counts.filter("stmt_no is null").count() == 1


def test_rows_of_one_huge_insert_join_nothing_shuffled(spark):
    """Tuples, header and tail over many lines and partitions; rows are neither grouped nor joined by statement."""
    tuples = [f"({i}, 'v{i}\nmore; of it'{', NULL' * (i % 3)})" for i in range(2500)]
    text = 'INSERT INTO "public"."big"\n  (a,\n   b) VALUES\n' + ",\n".join(tuples) + "\n ON CONFLICT\n DO NOTHING;\nINSERT INTO public.small (a) VALUES (1), (2);\n"
    lines = spark.createDataFrame([("f", i + 1, ln) for i, ln in enumerate(text.split("\n"))], "file_id string, line_no long, line string")
    for parts in (1, 7):
        scan = statements.dump_scan(lines, num_partitions=parts)
        rows = statements.rows_from_scan(scan)
        got = sorted((r["stmt_no"], r["row_no"], r["target"], r["header"], r["tuple"]) for r in rows.collect())
        head = 'INSERT INTO "public"."big"\n  (a,\n   b) VALUES'
        assert [(s, n, t) for s, n, t, _, _ in got] == [(1, i + 1, "public.big") for i in range(2500)] + [(2, 1, "public.small"), (2, 2, "public.small")]
        assert [t for *_, t in got[:2500]] == tuples and {h.strip() for *_, h, _ in got[:2500]} == {head}
        assert scan.filter("kind in ('piece', 'head')").count() < 20 * parts + 10
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        one = {r["stmt_no"]: (r["n_rows"], r["target"]) for r in statements.statements_from_scan(scan).collect()}
        assert one == {1: (2500, "public.big"), 2: (2, "public.small")}


@pytest.mark.parametrize("limit, most, wmax", [(100.0, 5, 60), (700.0, 0, 60), (10.0**9, 37, 60), (10.0**9, 0, 60), (4000.0, 150, 9), (50.0, 0, 60)])
def test_greedy_pack_by_the_forest(spark, monkeypatch, limit, most, wmax):
    """No table may go to the driver: chunks of a few rows, of several partitions, and of all of them."""
    monkeypatch.setattr(scan, "DRIVER_ENTRIES", 0)
    rng = random.Random(int(limit) + most)
    sizes = [3, 900, 1, 700, 40, 0, 300]
    data = [(g, i, float(rng.randint(1, wmax))) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "g int, i int, w double")
    before = scan.STATS["greedy_forests"]
    got = {(r.g, r.i): r.chunk_no for r in greedy_pack(df, ["g"], ["i"], ["w"], [limit], most, num_partitions=13).collect()}
    assert scan.STATS["greedy_forests"] == before + 1
    for g, n in enumerate(sizes):
        assert [got[(g, i)] for i in range(n)] == _greedy([w for gg, _, w in data if gg == g], 0.0, limit, most or 10**12)


def test_greedy_pack_driver_bytes_do_not_grow_with_the_limit(spark, monkeypatch):
    monkeypatch.setattr(scan, "DRIVER_ENTRIES", 400)
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") % 7 + 1).cast("double").alias("w"))
    told, chunks = [], []
    for most in (100, 3000, 10**9):
        chunks.append(greedy_pack(df, ["g"], ["i"], ["w"], [10.0**12], most, num_partitions=4).agg(F.max("chunk_no")).first()[0])
        told.append(scan.STATS["greedy_bytes"])
    assert chunks == [200, 7, 1] and max(told) < 2000 and max(told) - min(told) < 50  # numbers of more digits


@pytest.mark.parametrize("between", [0, 30])
def test_many_long_quotes_are_folded_again_together(spark, between):
    """Quotes at depths that nothing foresees, each through several partitions: all are tried in one job."""
    lines, expect = [], []
    for k in range(2, 10):
        quote = "\n".join(f"word {i}; '' ) -- " for i in range(40))
        value = "(" * (k - 1) + f"'{quote}'" + ")" * (k - 1)
        expect.append(f"({k}, {value})")
        lines += [f"INSERT INTO public.q{k} (id, body) VALUES", *f"\t({k}, {value});".split("\n")]
        for i in range(between):
            lines.append(f"INSERT INTO public.plain (id) VALUES ({i});")
            expect.append(f"({i})")
    df = spark.createDataFrame([("dump.sql", i + 1, t) for i, t in enumerate(lines)], "file_id string, line_no long, line string")
    before = scan.STATS["refolds"]
    rows = statements.rows_from_scan(statements.dump_scan(df, num_partitions=40)).select("tuple").collect()
    assert sorted(r.tuple for r in rows) == sorted(expect)
    assert 1 <= scan.STATS["refolds"] - before <= 2


def test_states_tried_again_are_bounded_but_exact(spark, monkeypatch):
    monkeypatch.setattr(scan, "REFOLD_STATES", 1)
    deep = [(f"({k}, " + "(" * k + "'" + "\n".join(["a;"] * 12) + "'" + ")" * k + ")") for k in range(1, 6)]
    lines = ["INSERT INTO public.d (id, body) VALUES", *("\t" + ",\n\t".join(deep) + ";").split("\n")]
    df = spark.createDataFrame([("dump.sql", i + 1, t) for i, t in enumerate(lines)], "file_id string, line_no long, line string")
    rows = statements.rows_from_scan(statements.dump_scan(df, num_partitions=9)).select("tuple").collect()
    assert sorted(r.tuple for r in rows) == sorted(deep)


def test_whole_tuple_lines_scan_alike():
    from sqlfold.functions.lexer import _BETWEEN, _WHOLE_TUPLE, InsertFold

    fold, bits = InsertFold(), ["\t(1, 'a;,(')", "(2, 'it''s -- no')", "(-3, 4/2)", "(E'\\'x')", "(e'')", "(1, $$a$$)", "(1 -- c)", "((1))", "(1) x", "(1,\t/* c */ 2)", '("a")', "('a", "(NULL, '')"]
    lines = [b + e for b in bits for e in (",", ";", "", ", ", ";x")]
    assert sum(bool(_WHOLE_TUPLE.fullmatch(ln)) for ln in lines) == 8
    for line in lines:
        assert fold.feed(_BETWEEN, line) == fold._scan(_BETWEEN, line, [("in", None)]), line


def test_greedy_pack_of_many_small_groups_in_a_batch(spark):
    """Groups of few rows with limits of their own, across batches and partitions, rows that travel along unread."""
    import datetime

    rows = [(None if g == 7 else f"g{g:04d}", i, (g * 31 + i * 17) % 40 + 1, float(20 + g % 90), g % 5, datetime.datetime(2024, 1, 1 + i), None) for g in range(1500) for i in range(g % 9 + 1)]
    df = spark.createDataFrame(rows, "g string, i long, w long, lim double, most long, at timestamp, note string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.g, r.i): (r.c, r["at"]) for r in greedy_pack(df, ["g"], ["i"], ["w"], ["lim"], "most", chunk_col="c", num_partitions=6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    chunk = count = size = 0
    for g, i, w, lim, most, at, _ in rows:
        if i == 0:
            chunk, count = 0, 0
        if not count or (most and count >= most) or size + w > lim:
            chunk, count, size = chunk + 1, 0, 0
        count, size = count + 1, size + w
        assert got[g, i] == (chunk, at)
    assert len(got) == len(rows)


def test_packing_statements_sorts_no_table_in_one_task(spark):
    """The sides with a row per table go to the tasks: no shuffle by the table, which may be all statements."""
    from sqlfold.operators import packing

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stmts = spark.range(400).selectExpr("'public.one' AS target", "id AS stmt_no", "concat('INSERT ', id) AS text")
        limits = packing.effective_limits(stmts.select("target"), None)
        plan = packing.pack_statements(stmts, limits)
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.select("part_no").distinct().count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_speculation_gives_up_runs_that_never_meet():
    """A run from inside a quote never meets the others; it is dropped, and folded again where it is the true one."""
    from sqlfold.functions.lexer import InsertFold
    from sqlfold.operators import scan
    from sqlfold.operators.statements import _InsertCounters

    spec = scan._Speculation(InsertFold(), _InsertCounters, InsertFold.candidates)
    for line in (["\t(1, 'a'),"] * 40 + ["\t(2, 'b');", "INSERT INTO public.t (k, v) VALUES"]) * 30:
        spec.feed(line)
    table = spec.result()
    assert spec.met is not None and InsertFold.initial in table and (2, "'", False, None, 0, 1, False, False) not in table
    assert table[2, None, False, None, 0, 0, False, False] == (table[InsertFold.initial][0], (30, 41, 0))
    assert table[InsertFold.initial][1] == (30, 0, 0)


def test_partitions_of_long_texts_are_small(spark):
    """40 MB of texts in one partition may be one Arrow batch, held several times by each task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.range(2500).select("id", F.repeat(F.format_string("%08d", "id"), F.lit(2048)).alias("text"))
        parts = scan.range_sorted(df, ["id"]).groupBy(scan.PID).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r.n for r in parts) == 2500 * 16384
    assert max(r.n for r in parts) < 32 * 1024 * 1024
