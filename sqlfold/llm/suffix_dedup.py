"""Repeated passages by the distributed difference-cover algorithm, to a bounded depth.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. As in
suffix sorting with a difference cover, only positions whose place modulo the period lies
in the cover are sampled: any two positions have a common distance k below the period at which
both are sampled. Sampled blocks of ``length - period + 1`` bytes are sorted and named by
their ranks; a sampled suffix whose name is its own starts no repeat and is left out. The
recursion sorts triples of names, one period apart: where a triple comes again, every string
that starts within a period before its middle is repeated. Only what the names leave
open is merged: the suffixes between sampled places whose block is shared but whose triple is
not, and one carrier of each triple that meets them. Their prefixes of ``length`` bytes are
sorted, and neighbours compared.

Sorting is by value ranges: tasks sort and pack their own records, equal ones as one record
that says so, so that a passage in a third of all documents costs one record a task. Records
are ordered by fingerprints (two polynomial hashes modulo 2^64), as only equality counts. What
is left out is left out by unequal fingerprints, so nothing is missed; names agree by 64 bits among
neighbours that agree, and merged prefixes by 96 bits.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textvec

_BLOCK = 1 << 19
#: Bytes of text whose records are sorted together before they are sent, and of records in a value range.
CHUNK_BYTES, RANGE_BYTES = 4_000_000, 2_000_000
#: A text that more than 1 / HEAVY of all rows have is one of fewer than HEAVY texts.
HEAVY = 1000
_MESSAGE = "to long, chunk long, kind int, a binary, b binary, c binary, d binary"
_FIELDS = pa.schema([("to", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcd"]])
_RECORDS, _STATE, _OTHERS = 0, 1, 2
_NONE = np.uint32(0xFFFFFFFF)


@lru_cache
def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(period, residues): every difference modulo the period is one of two residues.

    The period is q * q + q + 1 for the largest prime q that keeps it below half of ``length`` (2 at
    least); the residues are the zeros of a linear recurrence modulo q, q + 1 of them."""
    fits = [q for q in range(2, 40) if all(q % d for d in range(2, q)) and 2 * (q * q + q + 1) < length] or [2]
    q = fits[-1]
    period = q * q + q + 1
    for a, b, c in itertools.product(range(q), repeat=3):
        s = [0, 0, 1]
        while len(s) < period:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        zeros = [i for i, x in enumerate(s) if x == 0]
        if len(zeros) == q + 1 and len({(x - y) % period for x in zeros for y in zeros}) == period:
            return period, np.array(zeros)
    raise ValueError("no cover")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, and the powers of the base and of its inverse, of one of the two hashes."""
    table = np.random.default_rng(which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[which]
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return table, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def prints(raw: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64-bit fingerprints of the ``size`` bytes at each place of ``at`` (rising); holds a block of the text."""
    out = np.empty(len(at), np.uint64)
    table, up, down = _powers(which, _BLOCK + size + 1)
    for lo in range(0, len(raw), _BLOCK):
        a, z = np.searchsorted(at, [lo, lo + _BLOCK])
        if a == z:
            continue
        part = raw[lo : lo + _BLOCK + size]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=total[1:])
        p = at[a:z] - lo
        out[a:z] = _mixed((total[p + size] - total[p]) * down[p])
    return out


def _sampled(offsets: np.ndarray, period: int, residues: np.ndarray, reach: int) -> np.ndarray:
    """Places of the sampled blocks: their place in their own text is in the cover, and ``reach`` bytes follow."""
    chosen = np.zeros(period, bool)
    chosen[residues] = True
    found = [np.empty(0, np.int64)]
    for lo in range(0, int(offsets[-1]), _BLOCK):
        hi = min(lo + _BLOCK, int(offsets[-1]))
        rows = np.arange(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left"))
        many = np.minimum(offsets[rows + 1], hi) - np.maximum(offsets[rows], lo)
        place = np.arange(lo, hi)
        own = place - np.repeat(offsets[rows], many)
        left = np.repeat(offsets[rows + 1], many) - place
        found.append(place[chosen[own % period] & (left >= reach)])
    return np.concatenate(found)


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit key: ranges are equal parts of all values, in their order."""
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal values, both ends included."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): rows sorted by the keys, the first one first, and the edges of rows with equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        new |= k[order][1:] != k[order][:-1]
    return order, np.concatenate([[0], np.flatnonzero(new) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)


def _row(to, chunk, kind, *parts):
    return dict(zip(("to", "chunk", "kind", "a", "b", "c", "d"), (int(to), int(chunk), kind, *[p.tobytes() if isinstance(p, np.ndarray) else p for p in parts], *[None] * (4 - len(parts)))))


def _sent(rows: list[dict]):
    """Messages as batches of a few megabytes."""
    batch, size = [], 0
    for r in rows:
        batch.append(r)
        size += sum(len(r[c]) for c in "abcd" if r[c])
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(batch, _FIELDS)
            batch, size = [], 0
    if batch:
        yield pa.RecordBatch.from_pylist(batch, _FIELDS)


def _others(order: np.ndarray, edges: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(first, other) for every further member of the groups: 32-bit pairs of places."""
    sizes = np.diff(edges)
    head = np.repeat(order[edges[:-1]], sizes)
    rest = np.ones(len(order), bool)
    rest[edges[:-1]] = False
    return np.stack([places[head[rest]], places[order[rest]]], axis=1).astype(np.uint32)


def _with_others(places: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``places`` and the others that stand behind one of them; and of which place each is."""
    at = np.searchsorted(places, pairs[:, 0])
    there = at < len(places)
    there[there] = places[at[there]] == pairs[there, 0]
    return np.concatenate([places, pairs[there, 1]]), np.concatenate([np.arange(len(places)), at[there]])


def _u4(blob) -> np.ndarray:
    return np.frombuffer(blob or b"", np.uint32)


def _blocks_out(length: int, ranges: int):
    """Texts to records of their sampled blocks, sorted, for the value ranges."""
    period, residues = difference_cover(length)
    reach = length - period + 1

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, first = batch.column(0).to_pylist(), 0
            for raw, at in textvec.slices(batch.column(1), CHUNK_BYTES):
                chunk, own = chunk + 1, keys[first : first + len(at) - 1]
                first += len(own)
                place = _sampled(at, period, residues, reach)
                f = prints(raw, place, reach)
                order, edges = _grouped(f)
                lead = order[edges[:-1]]
                many = (np.diff(edges) > 1).astype(np.uint8)
                cut = _cuts(to := _ranges(f[lead], ranges))
                rows = [_row(to[i], chunk, _RECORDS, f[lead[i:j]], place[lead[i:j]].astype(np.uint32), many[i:j]) for i, j in zip(cut[:-1], cut[1:])]
                rows.append(_row(chunk % ranges, chunk, _STATE, b"".join(own), at.astype(np.uint32), _others(order, edges, place)))
                yield from _sent(rows)

    return run


def _split(table: pa.Table) -> tuple[list[dict], list[dict]]:
    """Records and states of a group of messages, in an order that does not depend on their arrival."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["chunk"], r["to"]))
    return [r for r in rows if r["kind"] != _STATE], [r for r in rows if r["kind"] == _STATE]


def _answers(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _FIELDS)


def _named(table: pa.Table) -> pa.Table:
    """A value range: blocks that come again, with their ranks as names, back to their chunks."""
    records, states = _split(table)
    out = [r | {"to": r["chunk"]} for r in states]
    if records:
        f = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in records])
        many = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in records]) > 0
        _, name, n = np.unique(f, return_inverse=True, return_counts=True)
        again = (n + np.bincount(name, many, minlength=len(n)) > 1)[name]
        name = (name + (records[0]["to"] << 32)).astype(np.uint64)
        end = 0
        for r in records:
            start, end = end, end + len(r["a"]) // 8
            if (mine := again[start:end]).any():
                out.append(_row(r["chunk"], r["chunk"], _RECORDS, _u4(r["b"])[mine], name[start:end][mine]))
    return _answers(out)


def _triples(length: int):
    """A chunk: triples of names, one period apart in one text, as records for the ranges of their middle names."""
    period, _ = difference_cover(length)

    def run(table: pa.Table) -> pa.Table:
        records, (state,) = _split(table)
        if not records:
            return _answers([])
        place, name = np.concatenate([_u4(r["a"]) for r in records]), np.concatenate([np.frombuffer(r["b"], np.uint64) for r in records])
        order = np.argsort(place)
        place, name = place[order], name[order]
        place, of = _with_others(place, _u4(state["c"]).reshape(-1, 2))
        order = np.argsort(place)
        place, name = place[order].astype(np.int64), name[of[order]]
        text = np.searchsorted(_u4(state["b"]), place, "right")
        full, key = np.ones(len(place), bool), name
        for step in (-period, period):
            i = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
            full &= (place[i] == place + step) & (text[i] == text)
            key = _mixed(key * np.uint64(3) + _mixed(name[i] + np.uint64(step % 7 + 1)))
        key = np.where(full, key | np.uint64(1), np.uint64(0))
        # one record for equal triples; blocks without one are told by name alone
        order, edges = _grouped(name, key)
        lead = order[edges[:-1]]
        many = (np.diff(edges) > 1).astype(np.uint8)
        pairs = _others(order, edges, place)
        pairs = pairs[full[np.searchsorted(place, pairs[:, 0])]]
        cut = _cuts(to := (name[lead] >> np.uint64(32)).astype(np.int64))
        out = [_row(to[i], state["chunk"], _RECORDS, name[lead[i:j]], key[lead[i:j]], place[lead[i:j]].astype(np.uint32), many[i:j]) for i, j in zip(cut[:-1], cut[1:])]
        out.append(_row(state["to"], state["chunk"], _STATE, state["a"], state["b"], pairs, place[~full].astype(np.uint32)))
        return _answers(out)

    return run


_LOOSE, _AGAIN, _CARRIER = 1, 2, 3


def _judged(table: pa.Table) -> pa.Table:
    """A range of names: which triples come again, and who carries them to those that do not."""
    records, states = _split(table)
    out = [r | {"to": r["chunk"]} for r in states]
    if records:
        name, key = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in records]) for c in "ab")
        many = np.concatenate([np.frombuffer(r["d"], np.uint8) for r in records]) > 0
        order, edges = _grouped(name, key)  # records of equal keys stay in their order, by chunk
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        again = ((np.diff(edges) + np.bincount(group, many, minlength=len(edges) - 1)) > 1)[group] & (key != 0)
        _, of = np.unique(name, return_inverse=True)
        mixed = np.bincount(of, ~again) > 0
        first = np.zeros(len(order), bool)
        first[order[edges[:-1]]] = True
        verdict = np.where(again, np.where(first & mixed[of], _CARRIER, _AGAIN), _LOOSE).astype(np.uint8)
        verdict[key == 0] = 0
        end = 0
        for r in records:
            start, end = end, end + len(r["a"]) // 8
            told = verdict[start:end] > 0
            if told.any():
                out.append(_row(r["chunk"], r["chunk"], _RECORDS, _u4(r["c"])[told], verdict[start:end][told]))
    return _answers(out)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of [start, end), sorted by start, as rows (start, end); ranges that touch are one."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    far = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > far[:-1]])
    return np.stack([start[new], far[np.concatenate([new[1:], [True]])]], axis=1)


def _per_text(offsets: np.ndarray, place: np.ndarray, before: int, after: int, last: int) -> dict[int, np.ndarray]:
    """Of each text with places, the union of [p - before, p + after) in its own counting, within its
    bytes less ``last``; as 32-bit pairs."""
    place = np.sort(place)
    text = np.searchsorted(offsets, place, "right") - 1
    cut, out = _cuts(text), {}
    for i, j in zip(cut[:-1], cut[1:]):
        t = int(text[i])
        own = place[i:j] - offsets[t]
        most = offsets[t + 1] - offsets[t] - last
        spans = _spans(np.maximum(own - before, 0), np.minimum(own + after, most))
        out[t] = spans[spans[:, 1] > spans[:, 0]].astype(np.uint32)
    return out


def _marked(length: int):
    """A chunk: of each text, the starts known to be repeated, and those still to be merged."""
    period, _ = difference_cover(length)
    schema = pa.schema([("key", pa.binary()), ("known", pa.binary()), ("open", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        records, states = _split(table)
        if not states:
            return schema.empty_table()
        (state,) = states
        offsets = _u4(state["b"]).astype(np.int64)
        place = np.concatenate([_u4(r["a"]) for r in records]) if records else np.empty(0, np.uint32)
        told = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in records]) if records else np.empty(0, np.uint8)
        again, _ = _with_others(np.sort(place[told >= _AGAIN]), _u4(state["c"]).reshape(-1, 2))
        loose = np.concatenate([_u4(state["d"]), place[told == _LOOSE]])
        known, left, carried = (_per_text(offsets, p.astype(np.int64), period - 1, 1, length - 1) for p in (again, loose, place[told == _CARRIER]))
        keys, rows = state["a"], set()
        for t in known.keys() | left.keys():
            rows.add((keys[16 * t : 16 * t + 16], *[x[t].tobytes() if t in x else b"" for x in (known, left)]))
        rows |= {(keys[16 * t : 16 * t + 16], b"", x.tobytes()) for t, x in carried.items()}
        return pa.Table.from_pylist([dict(zip(("key", "known", "open"), r)) for r in sorted(rows)], schema)

    return run


def _union(blobs) -> np.ndarray:
    pairs = np.concatenate([_u4(b).reshape(-1, 2) for b in blobs] or [np.empty((0, 2), np.uint32)]).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return _spans(pairs[:, 0], pairs[:, 1])


def _listed(spans: np.ndarray) -> np.ndarray:
    """Every whole number of the ranges."""
    size = spans[:, 1] - spans[:, 0]
    return np.repeat(spans[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _prefixes_out(length: int, ranges: int):
    """Texts with open starts to records of the prefixes there."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, known_in, open_in, first = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            for raw, at in textvec.slices(batch.column(1), CHUNK_BYTES):
                n, chunk = len(at) - 1, chunk + 1
                known = [_union(known_in[first + t]) for t in range(n)]
                place = np.concatenate([np.empty(0, np.int64), *[_listed(_union(open_in[first + t])) + at[t] for t in range(n)]])
                sure = np.concatenate([np.empty((0, 2), np.int64), *[k + at[t] for t, k in enumerate(known)]])
                i = np.searchsorted(sure[:, 0], place, "right") - 1
                asked = np.ones(len(place), bool)
                asked[i >= 0] = place[i >= 0] >= sure[i[i >= 0], 1]
                f, g = prints(raw, place, length), (prints(raw, place, length, 1) >> np.uint64(32)).astype(np.uint32)
                order, edges = _grouped(f, g, ~asked)  # a group's first is one that asks, if any does
                same = np.concatenate([[True], (f[order][1:] != f[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(order) else np.zeros(0, bool)
                edges = np.concatenate([np.flatnonzero(same), [len(order)]])
                lead = order[edges[:-1]]
                many = (np.diff(edges) > 1).astype(np.uint8)
                to = _ranges(f[lead], ranges)
                rows = []
                for kind, mine in ((_RECORDS, asked[lead]), (_OTHERS, ~asked[lead])):
                    own, where, more = lead[mine], to[mine], many[mine]
                    cut = _cuts(where)
                    for a, z in zip(cut[:-1], cut[1:]):
                        parts = (f[own[a:z]], g[own[a:z]], *((place[own[a:z]].astype(np.uint32), more[a:z]) if kind == _RECORDS else ()))
                        rows.append(_row(where[a], chunk, kind, *parts))
                pairs = _others(order, edges, place)
                state = _row(chunk % ranges, chunk, _STATE, b"".join(keys[first : first + n]), at.astype(np.uint32), pairs, sure.astype(np.uint32))
                yield from _sent([*rows, state])
                first += n

    return run


def _compared(table: pa.Table) -> pa.Table:
    """A value range of sorted prefixes: those equal to a neighbour."""
    records, states = _split(table)
    out = [r | {"to": r["chunk"]} for r in states]
    if records:
        f, g = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in records]), np.concatenate([_u4(r["b"]) for r in records])
        many = np.concatenate([np.frombuffer(r["d"], np.uint8) if r["d"] else np.zeros(len(r["a"]) // 8, np.uint8) for r in records]) > 0
        order, edges = _grouped(f, g)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        again = ((np.diff(edges) + np.bincount(group, many, minlength=len(edges) - 1)) > 1)[group]
        end = 0
        for r in records:
            start, end = end, end + len(r["a"]) // 8
            if r["kind"] == _RECORDS and (mine := again[start:end]).any():
                out.append(_row(r["chunk"], r["chunk"], _RECORDS, _u4(r["c"])[mine]))
    return _answers(out)


def _covered(length: int):
    """A chunk: of each text, the bytes that repeated strings cover."""
    schema = pa.schema([("key", pa.binary()), ("spans", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        records, states = _split(table)
        if not states:
            return schema.empty_table()
        (state,) = states
        offsets = _u4(state["b"]).astype(np.int64)
        place = np.concatenate([np.empty(0, np.uint32), *[_u4(r["a"]) for r in records]])
        place, _ = _with_others(np.sort(place), _u4(state["c"]).reshape(-1, 2))
        known = _u4(state["d"]).reshape(-1, 2).astype(np.int64)
        start, end = np.concatenate([place.astype(np.int64), known[:, 0]]), np.concatenate([place.astype(np.int64) + 1, known[:, 1]])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order] - 1 + length
        text = np.searchsorted(offsets, start, "right") - 1
        cut, rows = _cuts(text), []
        for i, j in zip(cut[:-1], cut[1:]):
            t = int(text[i])
            rows.append({"key": state["a"][16 * t : 16 * t + 16], "spans": (_spans(start[i:j], end[i:j]) - offsets[t]).astype(np.uint32).tobytes()})
        return pa.Table.from_pylist(rows, schema)

    return run


def _rest(batches):
    """What is left of each text, hashed."""
    for batch in batches:
        rows = []
        for key, text, blob in zip(*(c.to_pylist() for c in batch.columns)):
            raw, spans = text.encode(), _u4(blob).reshape(-1, 2).tolist()
            kept, at = hashlib.sha256(), 0
            for a, z in spans:
                kept.update(raw[at:a])
                at = z
            kept.update(raw[at:])
            rows.append((key, sum(z - a for a, z in spans), len(spans), kept.hexdigest(), blob))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated(texts: DataFrame, total_bytes: int, rows_of: DataFrame, length: int) -> DataFrame:
    """(key, text, copies, spans) of the texts that hold a string of ``length`` bytes that starts
    elsewhere; spans: 32-bit pairs of the bytes such strings cover. ``texts``: key (16 bytes, equal
    for equal texts only), id, text; ``rows_of``: key, copies, id of one of its rows."""
    period, residues = difference_cover(length)
    ranges = max(1, -(-int(total_bytes * len(residues) / period * 13) // RANGE_BYTES))
    blocks = texts.select("key", "text").mapInArrow(_blocks_out(length, ranges), _MESSAGE)
    named = blocks.groupBy("to").applyInArrow(_named, _MESSAGE)
    triples = named.groupBy("chunk").applyInArrow(_triples(length), _MESSAGE)
    judged = triples.groupBy("to").applyInArrow(_judged, _MESSAGE)
    marked = judged.groupBy("chunk").applyInArrow(_marked(length), "key binary, known binary, open binary")
    # equal texts have equal marks but for what they carry
    marks = marked.distinct().groupBy("key").agg(F.collect_list("known").alias("known"), F.collect_list("open").alias("open"))
    marks = common.stage(marks.join(rows_of, "key"), "marks").withColumnRenamed("id", "_id").withColumnRenamed("key", "_key")
    # the marks are the side that is hashed: texts are shuffled, but neither sorted nor held
    found = texts.join(marks.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    found = common.stage(found.select("key", "text", "known", "open", "copies"), "marked-texts")
    n_open = found.agg(F.sum(F.aggregate("open", F.lit(0).cast("long"), lambda s, b: s + F.octet_length(b)))).first()[0] or 0
    ranges = max(1, -(-max(int(n_open) * 200, total_bytes) // (8 * RANGE_BYTES)))
    sent = found.select("key", "text", "known", "open").mapInArrow(_prefixes_out(length, ranges), _MESSAGE)
    compared = sent.groupBy("to").applyInArrow(_compared, _MESSAGE)
    covered = compared.groupBy("chunk").applyInArrow(_covered(length), "key binary, spans binary").dropDuplicates(["key"])
    return found.select("key", "text", "copies").join(covered.hint("shuffle_hash"), "key")


def strip_repeats(df: DataFrame, id_col: str, text_col: str, length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of ``df``.

    Texts are taken as UTF-8 bytes (null: none). Every byte goes that a string of ``length`` bytes covers
    which also starts elsewhere in the input: in another text, the same text at another place,
    or another row with the same text. No string crosses texts; overlaps count; texts shorter than
    ``length`` stay. ``n_spans`` counts maximal runs, ``spans`` lists them as 32-bit pairs of start
    and end. Rows that repeat an id are rows of their own. An empty table gives an empty result.
    """
    common.session(df)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    narrow = docs.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    narrow = common.stage(narrow, "texts")
    total, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("n_bytes") >= length, F.col("n_bytes"))), F.lit(0))).first()
    copies = common.stage(narrow.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id"), F.min("n_bytes").alias("n_bytes")), "copies")
    found = repeated(docs.where(F.octet_length("text") >= length), size, copies.select("key", "copies", "id"), length)
    # a text with a copy goes as a whole, so only texts without one are cut
    cut = found.where("copies = 1").select("key", "text", "spans").mapInArrow(_rest, "key binary, n_removed long, n_spans long, kept_sha256 string, spans binary")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    both = F.unhex(F.concat(F.lit("00000000"), F.hex(F.reverse(F.unhex(F.lpad(F.hex("n_bytes"), 8, "0"))))))
    whole = copies.where("copies > 1").select("key", "copies", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), nothing.alias("kept_sha256"), both.alias("spans"))
    columns = ["key", "n_removed", "n_spans", "kept_sha256", "spans"]
    heavy = F.col("copies") * HEAVY > total
    often = F.broadcast(whole.where(heavy).select(columns))
    light = whole.where(~heavy).select(columns).unionByName(cut)
    seldom = narrow.join(often.select("key"), "key", "left_anti").join(light, "key", "left")
    rows = narrow.join(often, "key").unionByName(seldom)
    none = F.lit(0).cast("long")
    return rows.select(
        "id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("spans", F.lit(b"")).alias("spans"),
    )
