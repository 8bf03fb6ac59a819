"""Harmonic packing of token ids into fixed-length sequences.

Class k takes pieces of exactly ``capacity // k`` ids, k to a sequence. A document's
ids are cut from the front: full sequences first (class 1), then, of what is left, the
largest class that fits and wastes at most ``max_waste`` of a sequence, and so on down to
single ids. As all pieces of a class have one length, a piece's sequence and place
follow from its number within the class: workers number their own pieces, and the only
thing they share is the count of pieces per worker and class.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Unicode's White_Space, which the tokenizer's pattern splits at.
_WS = "\t-\r \x85\xa0  -     　"
#: No token crosses these segments: a run of other characters with one space before it, or white space.
_SEGMENT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_SPECIAL = "<|endoftext|>"
#: Rows of three numbers that are sent to every task at most: some 5 MB.
MOST_SENT = 100_000
_WS_SET = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c))


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers. Each new segment is encoded once;
    what is held is forgotten at ``held`` segments. Texts that spell the special token go to the
    tokenizer of ``vocabulary``, which is read when the first of them comes."""

    def __init__(self, vocabulary: str, ranks: str, held: int = 60_000):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.vocabulary, self.slow = vocabulary, None
        self.line = table[b"\n"]
        self.known: dict[str, bytes] = {}
        self.held = held

    def _learn(self, new: list[str]) -> None:
        """Encodes segments without line ends in one call, one to a line: a line end is a token of its own."""
        ids = np.array(self.fast.encode_ordinary("\n".join(new) + "\n"), "<u4")
        raw, at = ids.tobytes(), 0
        for segment, end in zip(new, (np.flatnonzero(ids == self.line) * 4).tolist(), strict=True):
            self.known[segment] = raw[at:end]
            at = end + 4

    def _whole(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if _SPECIAL in t else _SEGMENT.findall(t) for t in texts]
        if len(self.known) >= self.held:
            self.known.clear()
        new = {s for c in cut if c for s in c}.difference(self.known)
        odd = {s for s in new if s[-1] in _WS_SET}
        for s in odd:
            self.known[s] = np.array(self.fast.encode_ordinary(s), "<u4").tobytes()
        if words := list(new - odd):
            self._learn(words)
        get = self.known.__getitem__
        return [self._whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One per Python worker."""
    if (vocabulary, ranks) not in _ENCODERS:
        _ENCODERS[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _ENCODERS[vocabulary, ranks]


def classes(capacity: int, max_waste: float) -> list[tuple[int, int]]:
    """(k, piece length) by falling length: the lengths capacity // k that waste little, and always 1."""
    best = {}
    for k in range(1, capacity + 1):
        size = capacity // k
        if capacity - k * size <= max_waste * capacity or size == 1:
            best[size] = max(k, best.get(size, 0))
    return sorted(((k, s) for s, k in best.items()), key=lambda x: -x[1])


def cut_table(capacity: int, max_waste: float) -> list[list[tuple[int, int]]]:
    """For each remainder below the capacity, the (k, length) of its pieces."""
    of = classes(capacity, max_waste)
    table: list[list[tuple[int, int]]] = [[]]
    for n in range(1, capacity):
        k, s = next(c for c in of if c[1] <= n)
        table.append([(k, s), *table[n - s]])
    return table


def _cut(capacity: int, max_waste: float, vocabulary: str, ranks: str, end_id: int, with_ids: bool, batch_pieces: int = 2_000):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        codes, cuts = encoder(vocabulary, ranks), cut_table(capacity, max_waste)
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = {}
        rows: list[tuple] = []
        for pdf in batches:
            for doc, ids in _encoded(codes, pdf):
                ids += end
                n = len(ids) // 4
                at = 0
                for k, size in [(1, capacity)] * (n // capacity) + cuts[n % capacity]:
                    own = ids[4 * at : 4 * (at + size)]
                    no = seen.get(k, 0)
                    seen[k] = no + 1
                    rows.append((doc, at, size, zlib.crc32(own), n, k, no, own if with_ids else None))
                    at += size
                if len(rows) >= batch_pieces:
                    yield _pieces(rows, part)
                    rows = []
            common.settle()
        if rows:
            yield _pieces(rows, part)

    return run


def _encoded(codes: Encoder, pdf: pd.DataFrame, chars: int = 1_000_000):
    """(id, ids) of each row; texts are encoded together up to ``chars`` characters."""
    docs, texts, size = [], [], 0
    for doc, text in zip(pdf["id"], pdf["text"]):
        docs.append(doc)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= chars:
            yield from zip(docs, codes.encode(texts))
            docs, texts, size = [], [], 0
    yield from zip(docs, codes.encode(texts))


def _pieces(rows: list[tuple], part: int) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "start", "length", "crc32", "doc_tokens", "k", "no", "ids"])
    out["part"] = part
    return out


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 1024, max_waste: float = 1 / 128, end_id: int = 0, with_ids: bool = True, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, crc32 (of the ids as little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id, offset and, unless ``with_ids`` is off, ids (binary).

    A document is its text's ids and ``end_id``; null texts are empty, so every row has at
    least one id. Rows that repeat an id are packed each. Sequences hold ``capacity`` ids but
    for the waste of their class and the last one of each class. ``vocabulary`` (a tokenizers
    file) and ``ranks`` (the same vocabulary as ranks) default to byte_bpe_50k. An empty table
    gives an empty result.
    """
    common.session(df)
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # ids stay exact when some are null: pandas would turn the column to doubles
    picked = picked.withColumn("id", F.col("id").cast("string"))
    schema = "id string, start long, length long, crc32 long, doc_tokens long, k long, no long, ids binary, part long"
    pieces = common.stage(picked.mapInPandas(_cut(capacity, max_waste, vocabulary, ranks, end_id, with_ids), schema), "pieces")
    counts = pieces.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("k", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    filled = pieces.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / F.col("k")).alias("sequences"))
    # one row per class, of which there are fewer than the capacity has ids
    lower = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select("k", F.coalesce(F.sum("sequences").over(lower), F.lit(0)).alias("first"))
    # a row for each task and class: sent to every task while it is small, else shuffled with the pieces
    counts = common.stage(counts, "piece-counts")
    counts = F.broadcast(counts) if counts.count() <= MOST_SENT else counts
    placed = pieces.join(counts, ["k", "part"]).join(F.broadcast(filled), "k")
    number = F.col("before") + F.col("no")
    return placed.select(
        F.col("id").cast("long").alias("id"), "start", "length", "crc32", "doc_tokens",
        (F.col("first") + F.floor(number / F.col("k"))).cast("long").alias("sequence_id"),
        (number % F.col("k") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
