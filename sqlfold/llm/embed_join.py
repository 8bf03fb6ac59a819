"""Embedding near-duplicates: an exact range join in the angle metric.

Pivots partition the vectors into cells. A vector also goes, as a replica, to
each cell in which the triangle inequality allows a partner: cell j of pivot
p_j and radius R_j can hold one only if its angle to p_j is at most R_j + r and
at most its angle to its own pivot + 2r. Of two cells only one takes replicas
from the other, so each pair is compared once. Cells join independently, in
tiles of bounded size; within a tile pair, rows are sorted by their angle to the
pivot and only windows within r are multiplied out (the triangle inequality
again). Equal vectors are one node with a count from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, vectors

_SLACK = 1e-7
_STRIP = 1024


def packed_vectors(df: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """(id, dim, v): the components packed as ``kind``; v is null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            packed, dims = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for at, m in vectors.blocks(batch.column(1)):
                some = m.any(axis=1)
                at, m = at[some], (m[some] + 0.0).astype(kind)
                dims[at] = m.shape[1]
                for i, r in zip(at, m):
                    packed[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims), pa.array(packed, pa.binary())], ["id", "dim", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, dim long, v binary")


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _units(packed: bytes, dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square is beyond a double."""
    m = np.frombuffer(packed, kind).reshape(-1, dim).astype(np.float64)
    m = m / np.abs(m).max(axis=1, initial=0)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _homes(pivots: dict[int, np.ndarray], kind: str):
    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                own = pivots.get(int(dim))
                angle = _angles(_units(b"".join(part["v"]), int(dim), kind), own) if own is not None else np.zeros((len(part), 1))
                cell = angle.argmin(axis=1)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "many": part["many"].to_numpy(), "dim": dim, "cell": cell, "angle": angle[np.arange(len(part)), cell], "v": part["v"].to_numpy()})

    return run


def _replicas(pivots: dict[int, np.ndarray], kind: str, radii: dict[tuple[int, int], float], r: float):
    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                own = pivots.get(int(dim))
                if own is None or len(own) < 2:
                    continue
                angle = _angles(_units(b"".join(part["v"]), int(dim), kind), own)
                home = part["cell"].to_numpy()[:, None]
                j = np.arange(len(own))[None, :]
                reach = np.array([radii.get((int(dim), c), -math.inf) for c in range(len(own))]) + r + _SLACK
                takes = (home != j) & ((home > j) == ((home + j) % 2 == 0))
                i, j = np.nonzero(takes & (angle <= reach[None, :]) & (angle <= part["angle"].to_numpy()[:, None] + 2 * r + _SLACK))
                for lo in range(0, len(i), 20_000):
                    a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
                    yield pd.DataFrame({"node": part["node"].to_numpy()[a], "many": part["many"].to_numpy()[a], "dim": dim, "cell": b, "angle": angle[a, b], "v": part["v"].to_numpy()[a]})

    return run


def _join(cosine: float, kind: str):
    r = math.acos(cosine) + _SLACK

    def side(t, s):
        node, many, angle = (np.frombuffer(getattr(t, f"{s}_{c}"), k) for c, k in (("node", np.int64), ("many", np.int64), ("angle", np.float64)))
        order = np.argsort(angle, kind="stable")
        packed = getattr(t, f"{s}_v")
        return node[order], many[order], angle[order], _units(packed, len(packed) // len(node) // np.dtype(kind).itemsize, kind)[order]

    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                (xn, xc, xa, x), (yn, yc, ya, y) = side(t, "a"), side(t, "b")
                same = t.a == t.b
                x_links, y_links = np.zeros(len(xn), np.int64), np.zeros(len(yn), np.int64)
                held, size = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
                for lo in range(0, len(xn), _STRIP):
                    hi = min(len(xn), lo + _STRIP)
                    left, right = np.searchsorted(ya, [xa[lo] - r, xa[hi - 1] + r])
                    near = x[lo:hi] @ y[left:right].T >= cosine
                    if same:
                        d = np.arange(max(lo, left), min(hi, right))
                        near[d - lo, d - left] = False
                    i, j = np.nonzero(near)
                    if len(i):
                        x_links[lo:hi] += near @ yc[left:right]
                        if not same:
                            y_links[left:right] += xc[lo:hi] @ near
                        held.append((xn[lo + i], yn[left + j]))
                        size += len(i)
                    if size > 1_000_000:
                        held, size = [common.spanning(*(np.concatenate(v) for v in zip(*held)))], 0
                a, b = common.spanning(*(np.concatenate(v) for v in zip(*held)))
                x_at, y_at = np.flatnonzero(x_links), np.flatnonzero(y_links)
                counted = np.concatenate([xn[x_at], yn[y_at]])
                yield pd.DataFrame({"a": np.concatenate([counted, a]), "b": np.concatenate([counted, b]), "n": np.concatenate([x_links[x_at], y_links[y_at], np.zeros(len(a), np.int64)])})

    return run


def range_join(df: DataFrame, id_col: str, vec_col: str, cosine: float = 0.9, cell_rows: int = 8192, max_pivots: int = 1024) -> DataFrame:
    """(id, n_links, component): one row per input row.

    ``n_links`` counts the other rows at ``cosine`` or above (a row that repeats the vector
    is one); ``component`` is the smallest id that chains of links reach. Null vectors, zero
    vectors and vectors with null or non-finite components link with nothing; vectors of
    different dimensions neither. A row alone keeps its own id, null included. Pivots are at
    most ``max_pivots`` vectors, those of the smallest hashes; their number changes the cost,
    not the result: cells of more than ``cell_rows`` rows are joined tile by tile.
    """
    common.session(df)
    r = math.acos(cosine)
    # single-precision input travels as it is, and becomes double where it is used
    kind = "float32" if df.schema[vec_col].dataType.elementType.simpleString() == "float" else "float64"
    rows = common.stage(packed_vectors(df, id_col, vec_col, kind), "vectors")
    usable = rows.where("v is not null")
    groups = usable.groupBy("dim", "v").agg(F.count(F.lit(1)).alias("many"))
    groups = common.stage(groups.withColumn("node", F.monotonically_increasing_id()), "vector-groups")

    wanted = min(max_pivots, -(-groups.count() // cell_rows))
    chosen = groups.orderBy(F.xxhash64("v"), "v").select("dim", "v").limit(wanted).collect()
    pivots = {dim: _units(b"".join(p.v for p in chosen if p.dim == dim), dim, kind) for dim in {p.dim for p in chosen}}
    schema = "node long, many long, dim long, cell long, angle double, v binary"
    homes = common.stage(groups.mapInPandas(_homes(pivots, kind), schema), "vector-homes")
    # at most max_pivots rows, and one per dimension that has no pivot
    radii = {(x.dim, x.cell): x.r for x in homes.where(F.col("dim").isin(list(pivots))).groupBy("dim", "cell").agg(F.max("angle").alias("r")).collect()}
    copies = homes.mapInPandas(_replicas(pivots, kind, radii, r), schema)

    def packed(part: DataFrame, kind: str) -> DataFrame:
        keyed = part.withColumn("key", F.concat_ws("/", "dim", "cell"))
        tiles = common.number_tiles(keyed, "key", "node", cell_rows)
        tiles = common.pack_tiles(tiles, ["dim", "cell", "tile"], {"node": "int64", "many": "int64", "angle": "float64", "v": "bytes"})
        return common.stage(tiles.withColumn("tile_id", F.concat_ws("/", F.lit(kind), "dim", "cell", "tile")), "vector-tiles")

    own, sent = packed(homes, "home"), packed(copies, "sent")
    a = own.select("dim", "cell", F.col("tile_id").alias("a"), F.col("tile").alias("a_no"))
    b = own.select("dim", "cell", F.col("tile_id").alias("b"), F.col("tile").alias("b_no"))
    inside = a.join(b, ["dim", "cell"]).where("a_no <= b_no").select("a", "b")
    across = a.join(sent.select("dim", "cell", F.col("tile_id").alias("b")), ["dim", "cell"]).select("a", "b")
    columns = ["tile_id", "node", "many", "angle", "v"]
    both = own.select(columns).unionByName(sent.select(columns))
    found = common.pair_up(inside.unionByName(across), own.select(columns), both).mapInPandas(_join(cosine, kind), "a long, b long, n long")
    found = common.stage(found, "vector-links")

    counted = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comps = common.connected_components(found.where("n = 0").select("a", "b"))
    per_node = groups.join(counted, "node", "left").join(comps, "node", "left")
    per_node = per_node.select("v", "dim", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    linked = usable.join(per_node, ["dim", "v"]).select("id", "root", "n_links")
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.join(least, "root").select("id", "n_links", "component").unionByName(alone)
