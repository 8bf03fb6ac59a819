"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging.

Queries and candidates are packed into tiles of bounded size; every query tile
meets every candidate tile once, each meeting hands on the tile's best ``k``
per query, and lists are merged eight at a time until one per query tile is left.
No step holds more than a tile product or eight lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, vectors

_FAN_IN = 8
_LISTS = "dim long, q long, c long, ids binary, scores binary, found binary, query_ids binary, n long"


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, row, dim, v): floor(scale * x) of each usable vector as packed doubles. Null vectors,
    vectors with null or non-finite components, and rows without an id take no part."""

    def run(batches):
        for batch in batches:
            for at, m in vectors.blocks(batch.column(2)):
                q = np.floor(m * float(scale))
                at = at[good := np.isfinite(q).all(axis=1)]
                packed = pa.array([r.tobytes() for r in q[good]], pa.binary())
                idx = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), batch.column(1).take(idx), pa.array(np.full(len(at), m.shape[1])), packed], ["id", "row", "dim", "v"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).alias("v"))
    return picked.where("id is not null and v is not null").mapInArrow(run, "id long, row long, dim long, v binary")


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products as doubles, or as Python integers where doubles can't hold them."""
    top = lambda m: float(np.abs(m).max(initial=0))
    if top(x) * top(y) * max(1, x.shape[1]) * max(1, len(y)) < 2**53:
        return x @ y.T
    whole = lambda m: np.array([[int(v) for v in r] for r in m], object).reshape(m.shape)
    return whole(x) @ whole(y).T


def _best(k: int):
    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                x = np.frombuffer(t.a_v).reshape(t.a_n, t.dim)
                ids, rows = np.frombuffer(t.b_id, np.int64), np.frombuffer(t.b_row, np.int64)
                order = np.argsort(ids, kind="stable")
                y = np.frombuffer(t.b_v).reshape(t.b_n, t.dim)[order]
                ids, rows, m = ids[order], rows[order], len(order)
                own_rows = np.frombuffer(t.a_row, np.int64)
                s = _product(x, y)
                exact = s.dtype != object
                # score first, then the smaller id: one number for both, different for all columns
                key = s * m + np.arange(m - 1, -1, -1)
                by_row = np.argsort(rows)
                at = by_row[np.minimum(np.searchsorted(rows, own_rows, sorter=by_row), m - 1)]
                own = rows[at] == own_rows
                lowest = -np.inf if exact else min(key.min(initial=0), 0) - 1
                key[np.flatnonzero(own), at[own]] = lowest
                w = min(k, m)
                if exact:
                    cols = np.argpartition(key, m - w, axis=1)[:, m - w :]
                else:
                    cols = np.argsort(key, axis=1)[:, m - w :]
                picked = np.take_along_axis(s, cols, 1)
                found = (np.take_along_axis(key, cols, 1) != lowest).astype(np.uint8)
                if not exact:
                    picked = np.clip(picked, -(2**63) + 1, 2**63 - 1)
                yield _row(t.dim, t.q, t.c // _FAN_IN, *_cut(ids[cols], picked.astype(np.int64), found, k), t.a_id, t.a_n)

    return run


def _cut(ids, scores, found, k):
    """The best k of each row: those found, highest score, smallest id; ascending in rank."""
    order = np.lexsort((ids, -scores, 1 - found), axis=1)[:, :k]
    return tuple(np.take_along_axis(v, order, 1) for v in (ids, scores, found))


def _row(dim, q, c, ids, scores, found, query_ids, n):
    return pd.DataFrame({"dim": [dim], "q": [q], "c": [c], "ids": [ids.tobytes()], "scores": [scores.tobytes()], "found": [found.tobytes()], "query_ids": [query_ids], "n": [n]})


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.iloc[0]
        side = [np.concatenate([np.frombuffer(v, kind).reshape(t.n, -1) for v in pdf[name]], axis=1) for name, kind in (("ids", np.int64), ("scores", np.int64), ("found", np.uint8))]
        return _row(t.dim, t.q, t.c // _FAN_IN, *_cut(*side, k), t.query_ids, t.n)

    return run


def _ranked(batches):
    for pdf in batches:
        for t in pdf.itertuples(index=False):
            ids, scores = (np.frombuffer(v, np.int64).reshape(t.n, -1) for v in (t.ids, t.scores))
            i, j = np.nonzero(np.frombuffer(t.found, np.uint8).reshape(t.n, -1))
            yield pd.DataFrame({"query_id": np.frombuffer(t.query_ids, np.int64)[i], "rank": (j + 1).astype(np.int32), "id": ids[i, j], "score": scores[i, j]})


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 20, scale: int = 64, query_rows: int = 1024, tile_rows: int = 4096) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of the highest integer inner product with
    each query row, ties to the smaller id; all other rows if fewer than ``k``.

    ``is_query`` is a condition on ``id``. A row is no candidate of its own, but a row that
    repeats its id is. Only vectors of one dimension are compared. Scores beyond a long are
    held at its ends. An empty table gives an empty result.
    """
    common.session(df)
    rows = common.stage(quantised(df, id_col, vec_col, scale), "topk-rows")
    total, asked = rows.agg(F.count(F.lit(1)), F.sum(is_query.cast("long"))).first()
    n_tiles, n_blocks = -(-total // tile_rows) or 1, -(-(asked or 0) // query_rows) or 1
    columns = {"id": "int64", "row": "int64", "v": "bytes"}
    tiles = common.pack_tiles(rows.withColumn("tile", common.bucket_of(F.col("row"), n_tiles)), ["dim", "tile"], columns)
    blocks = common.pack_tiles(rows.where(is_query).withColumn("q", common.bucket_of(F.col("row"), n_blocks)), ["dim", "q"], columns)
    left = blocks.select("dim", "q", *[F.col(c).alias(f"a_{c}") for c in ("id", "row", "v", "n")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))).alias("c"))
    right = tiles.select("dim", F.col("tile").alias("c"), *[F.col(c).alias(f"b_{c}") for c in ("id", "row", "v", "n")])
    lists = left.join(right, ["dim", "c"]).mapInPandas(_best(k), _LISTS)
    while True:
        lists = lists.groupBy("dim", "q", "c").applyInPandas(_merge(k), _LISTS)
        n_tiles = -(-n_tiles // _FAN_IN)
        if n_tiles <= 1:
            break
    return lists.mapInPandas(_ranked, "query_id long, rank int, id long, score long")
