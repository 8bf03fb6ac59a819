"""Partition-parallel ordered scans.

Three sequential-looking computations are run here without ever putting a
whole group (a file, a table, a statement) into one task:

* :func:`ordinal` -- row number within a group in a given order.
* :func:`fold_lines` -- a line fold with a small control state (SQL lexers),
  run as a two-pass *speculative* scan: pass 1 folds every partition from a
  handful of plausible entry states at once (runs that meet are merged), the
  driver chains the few summary rows per partition, and pass 2 folds each
  partition from its true entry state. Partitions whose true entry state was
  not speculated are folded again, all in one job, from the states that earlier
  ones may leave open (exact, rarely needed).
* :func:`greedy_pack` -- first-fit greedy chunking under a count limit and
  additive size limits, exact, via per-partition *jump tables* (the next chunk
  start from every position). Where the tables are large they stay on the
  executors as a forest of jumps, whose path from the first chunk is found by
  pointer doubling; the driver sees a bounded number of entries at any limit.

All three range-partition the input on (group, order) and pin it with a
reliable checkpoint so both passes see identical partitions.
"""

from __future__ import annotations

import itertools
import pickle
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize

_SUMMARY = T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("blob", T.BinaryType())])


# Target bytes per range partition when the count is derived from the input size. A partition of long texts
# may go to Python as one Arrow batch (Spark's limit is 64 MB), of which an executor holds several copies for
# each task: where it is filled, sent and read back, and the worker's own. Small partitions bound all of them.
TARGET_PARTITION_BYTES = 16 * 1024 * 1024


def _nparts(cached: DataFrame, num_partitions: int | None) -> int:
    """Explicit count, else ~16 MB per partition of a cached input, whose size Spark has measured;
    at least the cluster's default parallelism, or ``spark.sql.shuffle.partitions`` where that is less."""
    if num_partitions:
        return num_partitions
    spark = cached.sparkSession
    lower = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cached.count()  # fills the cache, which the range bounds' sample reads next
    size = cached.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(lower, -(-int(str(size)) // TARGET_PARTITION_BYTES))


PID = "_pid"
# driver-side counters for observability (e.g. how often speculation missed)
STATS = {"refolds": 0, "speculated_partitions": 0, "greedy_bytes": 0, "greedy_forests": 0}
#: Jump table entries that all partitions of one greedy_pack may send to the driver together.
DRIVER_ENTRIES = 65536


def range_sorted(df: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``keys``, sort inside partitions and pin the result for multi-pass use.

    Each row carries its range partition number in ``_pid``; later passes key their
    per-partition state on that column, never on the task's partition index (a union
    or coalesce downstream renumbers tasks).
    """
    # the range bounds are sampled by a separate job: keep the input so it isn't computed twice
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = _nparts(src, num_partitions)
        ranged = src.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        return materialize(ranged.withColumn(PID, F.spark_partition_id()))
    finally:
        src.unpersist()


def _runs(batches, group_cols):
    """Yield (pid, key, frame) for contiguous runs of one (partition, group key) across Arrow batches."""
    cols = [PID] + list(group_cols)
    for pdf in batches:
        if pdf.empty:
            continue
        keys = list(zip(*(pdf[c].tolist() for c in cols)))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start][0], keys[start][1:], pdf.iloc[start:i]
                start = i


def _by_partition(batches, group_cols):
    """Yield (pid, runs) per partition block, lazily: ``runs`` iterates (key, frame) in order."""
    for pid, grp in itertools.groupby(_runs(batches, group_cols), key=lambda t: t[0]):
        yield pid, ((key, part) for _, key, part in grp)


def _collect_summaries(x: DataFrame, fn) -> dict[int, object]:
    rows = x.mapInPandas(fn, _SUMMARY).collect()
    return {r.pid: pickle.loads(r.blob) for r in rows}


def _emit_summary(pid, obj):
    return pd.DataFrame({"pid": [int(pid)], "blob": [pickle.dumps(obj)]})


def _neighbour_groups(x: DataFrame, group_cols: Sequence[str], with_bounds: bool = False):
    """(ordered pids, {pid: (continues_in, continues_out)}) from each partition's first/last group key."""
    key = F.struct(*group_cols)
    bounds = {
        r[PID]: (tuple(r["lo"]), tuple(r["hi"]))
        for r in x.groupBy(PID).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    }
    order = sorted(bounds)
    flags = {}
    for i, pid in enumerate(order):
        cont_in = i > 0 and bounds[order[i - 1]][1] == bounds[pid][0]
        cont_out = i + 1 < len(order) and bounds[pid][1] == bounds[order[i + 1]][0]
        flags[pid] = (cont_in, cont_out)
    if with_bounds:
        return order, flags, bounds
    return order, flags


def _edge_rows(x: DataFrame, group_cols: Sequence[str], pids, bounds: dict) -> DataFrame:
    """Rows of the first and the last group of each of these partitions, in their order: the JVM drops the others."""
    rows = {(int(p), *key) for p in pids for key in bounds[p]}
    schema = T.StructType([T.StructField("_edge", T.IntegerType())] + [T.StructField(f"_edge_{i}", x.schema[c].dataType) for i, c in enumerate(group_cols)])
    edges = F.broadcast(x.sparkSession.createDataFrame(sorted(rows, key=repr), schema))  # two per partition at most
    on = F.col(PID) == F.col("_edge")
    for i, c in enumerate(group_cols):
        on &= F.col(c).eqNullSafe(F.col(f"_edge_{i}"))
    return x.join(edges, on, "left_semi")


def _heads(batch: pa.RecordBatch, cols: Sequence[str]):
    """Yield (rows of one partition, where runs of equal keys begin in them) of an Arrow batch."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, dtype=bool)
    for i, c in enumerate(cols):
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
        if i == 0:
            edges = [0, *np.flatnonzero(new).tolist(), len(new)]
    new[0] = True
    for a, z in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, z - a), np.flatnonzero(new[a:z])


# ---------------------------------------------------------------------------
# ordinal
# ---------------------------------------------------------------------------
def ordinal(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    name: str = "ordinal",
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its group, ordered by ``order_cols``.

    Equivalent to ``row_number() over (partition by group order by order)`` but a
    hot group is spread over many range partitions instead of one task.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    if not group_cols:
        return ordinal(df.withColumn("_g0", F.lit(0)), ["_g0"], order_cols, name, num_partitions).drop("_g0")
    x = range_sorted(df, group_cols + order_cols, num_partitions)

    # Bases come from the JVM: partition bounds say which partitions share a group with a
    # neighbour; the row counts of those edge groups (at most two per partition) come from a
    # semi join with a table of at most 2 x partitions rows.
    order, flags, bounds = _neighbour_groups(x, group_cols, with_bounds=True)
    need = [pid for pid in order if flags[pid][0] or flags[pid][1]]
    counts: dict = {}
    if need:
        rows = set()
        for pid in need:
            lo, hi = bounds[pid]
            rows.add((int(pid), *lo))
            rows.add((int(pid), *hi))
        edge_schema = T.StructType([T.StructField(PID, T.IntegerType())] + [x.schema[c] for c in group_cols])
        edges = x.sparkSession.createDataFrame(sorted(rows, key=repr), edge_schema)
        picked = (x.select(PID, *group_cols).join(F.broadcast(edges), [PID, *group_cols], "left_semi")
                  .groupBy(PID, *group_cols).count().collect())
        counts = {(r[PID], tuple(r[c] for c in group_cols)): r["count"] for r in picked}
    bases: dict[int, int] = {}
    carry_n = 0
    for pid in order:
        cont_in, cont_out = flags[pid]
        lo, hi = bounds[pid]
        base = carry_n if cont_in else 0
        if cont_in:
            bases[pid] = base
        if cont_out:
            carry_n = base + counts.get((pid, lo), 0) if lo == hi else counts.get((pid, hi), 0)
        else:
            carry_n = 0

    schema = T.StructType(x.schema.fields + [T.StructField(name, T.LongType(), False)])

    def apply(batches):
        last, n = None, 0  # (partition, group) of the row before, and its number
        for batch in batches:
            for part, heads in _heads(batch, [PID, *group_cols]):
                pid, *key = (part.column(c)[0].as_py() for c in (PID, *group_cols))
                out = np.arange(part.num_rows) + 1 - np.repeat(heads, np.diff(np.append(heads, part.num_rows)))
                # the first group of a partition may go on from the one before
                before = n if last == (pid, key) else bases.get(pid, 0) if last is None or last[0] != pid else 0
                out[: heads[1] if len(heads) > 1 else None] += before
                last, n = (pid, [part.column(c)[part.num_rows - 1].as_py() for c in group_cols]), int(out[-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], [*part.schema.names, name])

    return x.mapInArrow(apply, schema).drop(PID)


# ---------------------------------------------------------------------------
# speculative line folds
# ---------------------------------------------------------------------------
#: Lines after which runs that have not met the one that started outside are given up.
SYNC_LINES = 1024


class _Speculation:
    """Fold one line stream from many entry states at once, merging runs that meet."""

    def __init__(self, fold, counters, entries):
        self.fold, self.counters = fold, counters
        self.entries = list(entries)
        self.buckets: dict = {}
        for r, s in enumerate(self.entries):
            self.buckets.setdefault(s, []).append(r)
        self.cnt = [counters.zero() for _ in self.entries]
        self.met = None  # (state, counters since) once all runs have met
        self.kept, self.lines = range(len(self.entries)), 0

    def feed(self, line):
        if self.met is not None:
            state, cnt = self.met
            state, out = self.fold.feed(state, line)
            self.met = state, self.counters.add(cnt, self.counters.delta(out))
            return
        new: dict = {}
        for s, runs in self.buckets.items():
            s2, out = self.fold.feed(s, line)
            delta = self.counters.delta(out)
            for r in runs:
                self.cnt[r] = self.counters.add(self.cnt[r], delta)
            new.setdefault(s2, []).extend(runs)
        self.buckets = new
        self.lines += 1
        if len(new) > 1 and self.fold.syncs and self.lines % SYNC_LINES == 0 and self.cnt[0] != self.counters.zero() and self.entries[0] == self.fold.initial:
            # the run from outside has found its way in: those that have not met it by now hardly will, and are
            # folded again from the true entry state should it be one of theirs
            self.kept = next(runs for runs in new.values() if 0 in runs)
            self.buckets = new = {s: runs for s, runs in new.items() if runs is self.kept}
        if len(new) == 1:
            self.met = next(iter(new)), self.counters.zero()

    def result(self):
        if self.met is not None:
            state, since = self.met
            return {self.entries[r]: (state, self.counters.add(self.cnt[r], since)) for r in self.kept}
        exit_of = {}
        for s, runs in self.buckets.items():
            for r in runs:
                exit_of[r] = s
        return {self.entries[r]: (exit_of[r], self.cnt[r]) for r in range(len(self.entries))}


#: States that a refold tries on one partition, the nearest partitions' first; others wait for another job.
REFOLD_STATES = 32


def _likely_entries(order, flags, summ, state) -> dict:
    """Entry states not yet folded, of the first partition of ``order``, whose entry is ``state``, and of all later
    ones: what any partition before them in their group leaves open (a tag, a long quote), from
    whichever entry, may run on to them. Where a group begins inside a partition, its exit is known."""
    wave, likely = {}, {state: None}
    for pid in order:
        if pid not in summ or not (flags[pid][0] or pid == order[0]):
            likely = {}
        if pid not in summ:
            continue
        _, table, groups, _, last_state, _ = summ[pid]
        tried = [s for s in reversed(likely) if s not in table][:REFOLD_STATES]
        if tried:
            wave[pid] = tried
        if groups > 1:
            likely = {last_state: None}
            continue
        for left, _ in table.values():
            likely.pop(left, None)  # the latest go last
            likely[left] = None
    return wave


def fold_lines(
    lines: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    line_col: str,
    fold_factory,
    counters,
    emit,
    out_schema: T.StructType,
    num_partitions: int | None = None,
    extra_candidates=None,
    pin: bool = False,
    payload: Sequence[str] = (),
    emit_per_partition: bool = False,
) -> DataFrame:
    """Run a line fold over ordered lines of many groups, partition-parallel.

    ``payload`` columns travel along for ``emit``, which then needs no join back.

    ``pin=True`` checkpoints the fold output so several consumers read it without
    re-running the Python pass.

    ``counters`` describes additive counters the fold advances (``zero``,
    ``delta(out)``, ``add``, ``origin``, ``chain``); ``emit(key, row, state_before,
    out, counters_before)`` returns output records (lists in ``out_schema`` order)
    for one line in pass 2. With ``emit_per_partition`` it is a factory of such functions, one for
    each partition, whose ``flush()`` gives the records still held at the partition's end.
    """
    group_cols = list(group_cols)
    x = range_sorted(lines.select(*group_cols, order_col, line_col, *payload), group_cols + [order_col], num_partitions)
    fold0 = fold_factory()

    def summarize_for(forced: dict | None):
        def summarize(batches):
            for pid, runs in _by_partition(batches, group_cols):
                if forced is not None and pid not in forced:
                    continue
                exact = forced.get(pid) if forced is not None else None
                fold = fold_factory()
                first_key = last_key = None
                first_spec = None
                last_state, last_cnt = None, None
                groups = 0
                for key, part in runs:
                    texts = part[line_col].tolist()
                    if first_key is None:
                        first_key, groups = key, 1
                        if exact is not None:
                            entries = exact
                        else:
                            entries = list(fold.candidates)
                            if extra_candidates is not None:
                                entries += [e for e in extra_candidates(texts) if e not in entries]
                        first_spec = _Speculation(fold, counters, entries)
                    if key == first_key and groups == 1:
                        for t in texts:
                            first_spec.feed(t)
                        continue
                    if key != last_key:
                        groups += 1
                        last_key, last_state, last_cnt = key, fold.initial, counters.zero()
                    for t in texts:
                        last_state, out = fold.feed(last_state, t)
                        last_cnt = counters.add(last_cnt, counters.delta(out))
                yield _emit_summary(pid, (first_key, first_spec.result(), groups, last_key, last_state, last_cnt))

        return summarize

    # Which partitions share a group with a neighbour? Only those need the speculative pass
    # (many small files: almost none do). A JVM aggregation over the group columns decides.
    order, flags = _neighbour_groups(x, group_cols)
    need: dict = {}
    for pid in order:
        cont_in, cont_out = flags[pid]
        if cont_in:
            need[pid] = None  # entry unknown: speculate
        elif cont_out:
            need[pid] = [fold0.initial]  # starts fresh, but its last group runs on
    def only(pids):
        # the JVM drops other partitions' rows before anything reaches Python
        return x.filter(F.col(PID).isin([int(p) for p in pids]))

    summ = _collect_summaries(only(need), summarize_for(need)) if need else {}
    STATS["speculated_partitions"] += len(need)
    entries: dict[int, tuple] = {}
    while True:
        missing = None
        carry = None  # (key, state, counters)
        for pid in order:
            if pid not in summ:
                entries[pid] = (fold0.initial, counters.origin())
                carry = None
                continue
            first_key, table, groups, last_key, last_state, last_cnt = summ[pid]
            if carry is not None and carry[0] == first_key:
                entry_state, entry_cnt = carry[1], carry[2]
            else:
                entry_state, entry_cnt = fold0.initial, counters.origin()
            entries[pid] = (entry_state, entry_cnt)
            hit = table.get(entry_state)
            if hit is None:
                missing = (pid, entry_state)
                break
            exit_state, delta = hit
            if groups == 1:
                carry = (first_key, exit_state, counters.chain(entry_cnt, delta))
            else:
                carry = (last_key, last_state, counters.chain(counters.origin(), last_cnt))
        if missing is None:
            break
        # one job folds every later partition from all states that those before it may leave open
        wave = _likely_entries(order[order.index(missing[0]):], flags, summ, missing[1])
        extra = _collect_summaries(only(wave), summarize_for(wave))
        for p in wave:
            summ[p][1].update(extra[p][1])
        STATS["refolds"] += 1

    def frame(recs):
        # columns of objects: no types are guessed, so whole numbers beside nulls stay what they are
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(out_schema.fieldNames(), zip(*recs))})

    def apply(batches):
        fold = fold_factory()
        for pid, runs in _by_partition(batches, group_cols):
            first = True
            state = cnt = None
            cur, recs = None, []
            told = emit() if emit_per_partition else emit
            for key, part in runs:
                if key != cur:
                    if first:
                        state, cnt = entries.get(pid, (fold.initial, counters.origin()))
                        first = False
                    else:
                        state, cnt = fold.initial, counters.origin()
                    cur = key
                for row, line in zip(part.itertuples(index=False), part[line_col].tolist()):
                    before = state
                    state, out = fold.feed(state, line)
                    recs.extend(told(key, row, before, out, cnt))
                    cnt = counters.chain(cnt, counters.delta(out))
                    if len(recs) >= 4096:
                        yield frame(recs)
                        recs = []
            if emit_per_partition:
                recs.extend(told.flush())
            if recs:
                yield frame(recs)

    out = x.mapInPandas(apply, out_schema)
    return materialize(out) if pin else out


# ---------------------------------------------------------------------------
# greedy packing
# ---------------------------------------------------------------------------
def _next_starts(w: np.ndarray, base: np.ndarray, limits: np.ndarray, max_count) -> np.ndarray:
    """nxt[j] = first item that must open a new chunk when a chunk opens at item j; limits and
    count are one for all items, or a row for each."""
    n = w.shape[0]
    idx = np.arange(n)
    limits, most = np.broadcast_to(limits, w.shape), np.broadcast_to(max_count or 0 if np.isscalar(max_count) or max_count is None else max_count, n)
    nxt = np.where(most > 0, np.minimum(idx + most, n), n)
    for k in range(w.shape[1]):
        if not np.isfinite(limits[:, k]).any():
            continue
        p = np.concatenate([[0.0], np.cumsum(w[:, k])])
        # smallest m > j with base + p[m+1] - p[j] > limit
        pos = np.searchsorted(p, p[:-1] + (limits[:, k] - base[k]), side="right") - 1
        pos = np.maximum(pos, idx + 1)
        nxt = np.minimum(nxt, pos)
    return np.minimum(nxt, n)


def _first_boundary(w, entry_count, entry_sums, limits, max_count):
    """Index of the first item that flushes a chunk entered with (count, sums); n if none."""
    n = w.shape[0]
    if entry_count == 0:
        return 0
    j = n
    if max_count and max_count > 0:
        j = min(j, max(max_count - entry_count, 0))
    for k in range(w.shape[1]):
        if not np.isfinite(limits[k]):
            continue
        p = np.cumsum(w[:, k])
        hit = np.nonzero(entry_sums[k] + p > limits[k])[0]
        if hit.size:
            j = min(j, int(hit[0]))
    return j


def _chains(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the chain of chunks from every position: their number and the start of the last, by pointer doubling."""
    n = nxt.shape[0]
    count, last, to = np.ones(n, dtype=np.int64), np.arange(n), nxt.copy()
    live = np.flatnonzero(to < n)
    while live.size:
        t = to[live]
        more, end, beyond = count[t], last[t], to[t]
        count[live] += more
        last[live] = end
        to[live] = beyond
        live = live[beyond < n]
    return count, last


def _jump_nodes(w: np.ndarray, base, lim, mc):
    """What can be entered: of each position where the first chunk to open here may open, the chunks of its
    chain and the state (count, sums) that the last is left in; and the sums before each position."""
    n = w.shape[0]
    nxt = _next_starts(w, base, lim, mc)
    count, last = _chains(nxt)
    sums = np.concatenate([np.zeros((1, w.shape[1])), np.cumsum(w, axis=0)])
    heads = min(n, int(nxt[0]) + 1)
    return count[:heads], n - last[:heads], base + sums[n] - sums[last[:heads]], sums[:heads]


class _Run:
    """Partitions that one group goes through: the one it starts in, those it fills, the one it ends in."""

    def __init__(self, pids: list[int], summ: dict, lim, mc: int):
        self.pids, self.lim, self.mc = pids, lim, mc
        self.index = {p: i for i, p in enumerate(pids)}
        self.rows = np.cumsum([summ[p]["n"] for p in pids])
        self.sums = np.cumsum([summ[p]["total"] for p in pids], axis=0)

    def enter(self, pid: int, count: np.ndarray, sums: np.ndarray):
        """Chunks left open at the end of ``pid``: the partition in which each ends (-1: none that the group
        fills) and the state in which it is entered."""
        i = self.index[pid]
        at = np.full(len(count), len(self.pids))
        if self.mc > 0:
            at = np.minimum(at, np.searchsorted(self.rows, self.rows[i] + self.mc - count, side="right"))
        for k in np.flatnonzero(np.isfinite(self.lim)):
            at = np.minimum(at, np.searchsorted(self.sums[:, k], self.sums[i, k] + self.lim[k] - sums[:, k], side="right"))
        at = np.maximum(at, i + 1)
        before = np.minimum(at, len(self.pids)) - 1
        inner = at < len(self.pids) - 1
        return (np.where(inner, np.asarray(self.pids)[np.minimum(at, len(self.pids) - 1)], -1), count + self.rows[before] - self.rows[i],
                sums + self.sums[before] - self.sums[i])


def _forest_path(x: DataFrame, runs: dict[int, _Run], roots: list[tuple], first_weights, base) -> dict[int, tuple]:
    """{partition: (chunks, open count, open sums)} of the chunks that open first in the partitions that
    a group fills, given the state in which each group leaves its first one (``roots``).

    A node is a place where a partition's first chunk may open; it leads to the node where the chunk
    that its chain leaves open ends. All nodes stay on the executors; each round doubles the jumps and the
    part of the paths that is known, so it takes the logarithm of a run's partitions in rounds.
    """
    spark, width = x.sparkSession, len(base)
    sums_t = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        T.StructField("s", T.LongType()), T.StructField("j", T.LongType()), T.StructField("before", sums_t), T.StructField("chunks", T.LongType()),
        T.StructField("open_count", T.LongType()), T.StructField("open_sums", sums_t),
        T.StructField("q", T.LongType()), T.StructField("q_count", T.LongType()), T.StructField("q_sums", sums_t)])

    def nodes_of(batches):
        for pid, w in first_weights(batches):
            run = runs[pid]
            chunks, count, sums, before = _jump_nodes(w, base, run.lim, run.mc)
            q, q_count, q_sums = run.enter(pid, count, sums)
            for lo in range(0, len(chunks), 65536):
                at = slice(lo, lo + 65536)
                yield pd.DataFrame({"s": pid, "j": np.arange(len(chunks))[at], "before": list(before[at]), "chunks": chunks[at], "open_count": count[at],
                                    "open_sums": list(sums[at]), "q": q[at], "q_count": q_count[at], "q_sums": list(q_sums[at])})

    nodes = x.where(F.col(PID).isin([int(p) for p in runs])).mapInPandas(nodes_of, schema)
    first = []
    for k, (pid, run, count, sums) in enumerate(roots):
        q, q_count, q_sums = run.enter(pid, np.array([count]), np.array([sums], dtype=float))
        first.append((-1 - k, 0, [0.0] * width, 0, int(count), [float(v) for v in sums], int(q[0]), int(q_count[0]), q_sums[0].tolist()))
    nodes = materialize(nodes.unionByName(spark.createDataFrame(first, schema)))

    def ends(asked, entered):
        """Where in partition q do the chunks end that enter it in these states?"""
        if asked.empty:
            return pd.DataFrame({"s": [], "j": [], "q": [], "j2": []})
        q = int(asked["q"].iloc[0])
        run = runs[q]
        before = np.stack(entered.sort_values("j")["before"].to_numpy())
        sums = np.stack(asked["q_sums"].to_numpy())
        at = np.full(len(asked), len(before) - 1)
        if run.mc > 0:
            at = np.minimum(at, np.maximum(run.mc - asked["q_count"].to_numpy(), 0))
        for k in np.flatnonzero(np.isfinite(run.lim)):
            at = np.minimum(at, np.searchsorted(before[1:, k], run.lim[k] - sums[:, k], side="right"))
        return pd.DataFrame({"s": asked["s"], "j": asked["j"], "q": q, "j2": at})

    asked = nodes.where("q >= 0").select("s", "j", "q", "q_count", "q_sums")
    entered = nodes.where("s >= 0").select("s", "j", "before")
    jumps = materialize(asked.groupBy("q").cogroup(entered.groupBy("s")).applyInPandas(ends, "s long, j long, q long, j2 long"))
    known = {(r[0], r[1]) for r in first}

    def of_known(df):
        path = spark.createDataFrame(sorted(known), "s long, j long")
        return df.join(F.broadcast(path), ["s", "j"])  # one row per partition at most

    while True:
        found = {(r["q"], r["j2"]) for r in of_known(jumps).select("q", "j2").collect()}
        if not found:
            break
        known |= found
        on = jumps.select(F.col("s").alias("q"), F.col("j").alias("j2"), F.col("q").alias("q3"), F.col("j2").alias("j3"))
        jumps = materialize(jumps.join(on, ["q", "j2"]).select("s", "j", F.col("q3").alias("q"), F.col("j3").alias("j2")))
    STATS["greedy_forests"] += 1
    return {r["s"]: (r["chunks"], r["open_count"], r["open_sums"]) for r in of_known(nodes).where("s >= 0").select("s", "chunks", "open_count", "open_sums").collect()}


def greedy_pack(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    size_cols: Sequence[str],
    limits: Sequence[float],
    max_count: int | None,
    base: Sequence[float] | None = None,
    chunk_col: str = "chunk_no",
    num_partitions: int | None = None,
) -> DataFrame:
    """Assign ``chunk_col`` (1-based per group) by first-fit greedy packing in order.

    A chunk opens with ``base`` sizes; an item joins the open chunk unless the
    chunk already holds ``max_count`` items or one of ``size + item > limit``
    (an item never shares a chunk with nothing: a lone oversized item is kept).
    Limits may be per-group columns: pass column names in ``limits`` and the
    value is read from the first row of each group.

    ``max_count`` may be None. A partition can be entered in as many states as a chunk that opens at its
    start has rows. All partitions together send at most ``DRIVER_ENTRIES`` of these to the driver; where
    there are more (large limits, many partitions), they stay on the executors, see :func:`_forest_path`.
    Sizes add up as doubles, so whole numbers below 2^53 are exact.
    """
    group_cols, order_cols, size_cols = list(group_cols), list(order_cols), list(size_cols)
    base = np.asarray(base if base is not None else [0.0] * len(size_cols), dtype=float)
    lim_cols = [c for c in limits if isinstance(c, str)]
    cnt_col = max_count if isinstance(max_count, str) else None
    x = range_sorted(df, group_cols + order_cols, num_partitions)

    def group_limits(part):
        lim = np.array(
            [float(part[c].iloc[0]) if isinstance(c, str) else float(c) for c in limits], dtype=float
        )
        lim = np.where(lim > 0, lim, np.inf)
        mc = int(part[cnt_col].iloc[0]) if cnt_col else (max_count or 0)
        return lim, mc

    def weights(part):
        return part[size_cols].to_numpy(dtype=float).reshape(len(part), len(size_cols))

    order, flags, bounds = _neighbour_groups(x, group_cols, with_bounds=True)
    need = {pid for pid, (cin, cout) in flags.items() if cin or cout}

    most = DRIVER_ENTRIES // max(len(need), 1)

    def summarize(batches):
        for pid, runs in _by_partition(batches, group_cols):
            if pid not in need:
                continue
            first_key = None
            first_parts, last_key, last_parts = [], None, []
            groups = 0
            for key, part in runs:
                if first_key is None:
                    first_key, groups = key, 1
                if key == first_key and groups == 1:
                    first_parts.append(part)
                    continue
                if key != last_key:
                    groups += 1
                    last_key, last_parts = key, []
                last_parts.append(part)
            if first_key is None:
                continue
            fp = pd.concat(first_parts)
            lim, mc = group_limits(fp)
            w = weights(fp)
            told = {"key": first_key, "groups": groups, "n": w.shape[0], "total": w.sum(axis=0), "lim": lim, "mc": mc}
            if groups > 1:
                lp = pd.concat(last_parts)
                lw = weights(lp)
                llim, lmc = group_limits(lp)
                chunks, count, sums, _ = _jump_nodes(lw, base, llim, lmc)
                told |= {"last_key": last_key, "fresh": (int(chunks[0]), int(count[0]), sums[0].tolist()), "lim": llim, "mc": lmc}
            else:
                chunks, count, sums, _ = _jump_nodes(w, base, lim, mc)
                told["fresh"] = (int(chunks[0]), int(count[0]), sums[0].tolist())
                # a group that goes through: every state in which the partition may be entered
                if flags[pid] == (True, True):
                    told["through"] = (w[:len(chunks)], chunks, count, sums) if len(chunks) <= most else None
            yield _emit_summary(pid, told)

    def first_weights(batches):
        for pid, runs in _by_partition(batches, group_cols):
            yield pid, weights(pd.concat([part for _, part in runs]))

    cols = [PID, *group_cols, *order_cols, *size_cols, *lim_cols, *([cnt_col] if cnt_col else [])]
    # of a partition that shares a group with a neighbour, its first and its last group are all that matters
    summ = _collect_summaries(_edge_rows(x.select(*cols), group_cols, need, bounds), summarize) if need else {}
    STATS["greedy_bytes"] = sum(len(pickle.dumps(v)) for v in summ.values())

    path = None
    if any(t.get("through", ()) is None for t in summ.values()):
        runs, roots = {}, []
        for i, pid in enumerate(order):
            # a group starts here (alone or behind others) and goes on
            if pid in summ and flags[pid][1] and (summ[pid]["groups"] > 1 or not flags[pid][0]):
                within = [pid, *itertools.takewhile(lambda p: "through" in summ[p], order[i + 1:])]
                if len(within) > 1:
                    run = _Run([*within, order[i + len(within)]], summ, summ[pid]["lim"], summ[pid]["mc"])
                    runs |= {p: run for p in within[1:]}
                    roots.append((pid, run, *summ[pid]["fresh"][1:]))
        path = _forest_path(x.select(*cols), runs, roots, first_weights, base)

    def through(pid, count, sums):
        """(chunks, open count, open sums) that a partition filled by a group adds; None: it ends no chunk."""
        if path is not None:
            return path.get(pid)
        w, chunks, counts, open_sums = summ[pid]["through"]
        j = _first_boundary(w, count, sums, summ[pid]["lim"], summ[pid]["mc"])
        return (int(chunks[j]), int(counts[j]), open_sums[j]) if j < len(chunks) else None

    entries: dict[int, tuple] = {}
    carry = None  # (chunks so far, open count, open sums) of the group that goes on
    for pid in order:
        if pid not in summ:  # no group crosses its edges: every group starts fresh
            carry = None
            continue
        told = summ[pid]
        done, count, sums = carry if carry is not None and flags[pid][0] else (0, 0, base)
        entries[pid] = (done, count, [float(v) for v in sums])
        if not flags[pid][1]:
            carry = None
        elif told["groups"] > 1 or not flags[pid][0]:
            carry = told["fresh"]
        else:
            added = through(pid, count, np.asarray(sums))
            carry = (done + added[0], added[1], added[2]) if added else (done, count + told["n"], np.asarray(sums) + told["total"])

    schema = T.StructType(x.schema.fields + [T.StructField(chunk_col, T.LongType(), False)])

    def columns_of(batch, names, default):
        """One column per name (a number stands for itself in every row), as doubles."""
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) if isinstance(c, str) else np.full(batch.num_rows, float(c)) for c in names] or
                        [np.full(batch.num_rows, default)], axis=1)

    def apply(batches):
        cur, done, cnt, sums = None, 0, 0, base  # the group of the row before, its chunks and the state of the open one
        lim, mc = None, 0
        for batch in batches:
            for part, heads in _heads(batch, [PID, *group_cols]):
                n = part.num_rows
                pid, *key = (part.column(c)[0].as_py() for c in (PID, *group_cols))
                w = columns_of(part, size_cols, 0.0)[:, : len(size_cols)]
                lims = columns_of(part.take(pa.array(heads)), limits, 0.0)[:, : len(limits)]
                lims = np.where(lims > 0, lims, np.inf)
                mcs = part.column(cnt_col).take(pa.array(heads)).to_numpy(zero_copy_only=False).astype(np.int64) if cnt_col else np.full(len(heads), max_count or 0)
                if cur == (pid, key):
                    lims[0], mcs[0] = lim, mc  # limits are those of a group's first row
                else:
                    done, cnt, sums = entries.get(pid, (0, 0, base)) if cur is None or cur[0] != pid else (0, 0, base)
                sums = np.asarray(sums, dtype=float)
                ends = np.append(heads[1:], n)
                sizes = ends - heads
                nxt = _next_starts(w, base, np.repeat(lims, sizes, axis=0), np.repeat(mcs, sizes))
                nxt = np.minimum(nxt, np.repeat(ends, sizes)).tolist()
                j = j0 = _first_boundary(w[: ends[0]], cnt, sums, lims[0], int(mcs[0]))
                opens = []
                while j < n:  # a group's last chunk leads to the next group's first row
                    opens.append(j)
                    j = nxt[j]
                opened = np.zeros(n, dtype=np.int64)
                opened[opens] = 1
                opened = np.cumsum(opened)
                before = np.append(0, opened)[heads]
                before[0] -= done
                out = opened - np.repeat(before, sizes)
                start = max(int(heads[-1]), opens[-1] if opens else 0)  # the open chunk's first row here
                if len(heads) == 1 and j0 >= n:
                    cnt, sums = cnt + n, sums + w.sum(axis=0)
                else:
                    cnt, sums = n - start, base + w[start:].sum(axis=0)
                done, lim, mc = int(out[-1]), lims[-1], int(mcs[-1])
                cur = (pid, [part.column(c)[n - 1].as_py() for c in group_cols])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], [*part.schema.names, chunk_col])

    return x.mapInArrow(apply, schema).drop(PID)
