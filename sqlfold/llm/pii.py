"""Personal data by fixed patterns and a semi-Markov conditional random field.

One vectorised pass cuts each text into islands: words with a digit or an at sign, and the
brackets, dots and hyphens between them. No pattern reaches beyond an island, so patterns and
model work on islands alone. Pattern matches ("base") stay as they are. In what is left
of an island, the model scores every candidate segment of up to ``MAX_ATOMS`` atoms as a
whole, for each kind, and dynamic programming over segment ends picks boundaries and kinds
together. It is trained here, by likelihood: on made-up entities and look-alikes, alone
and next to each other, and on a bounded sample of the corpus whose labels are the patterns'.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textvec

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 24

# The base patterns, written so that no input makes them backtrack far.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(s: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind, then start."""
    out, last = [], 0
    at = s.find("@")
    while at >= 0:
        if at >= last:
            i = at
            while i > last and s[i - 1] in _LOCAL:
                i -= 1
            if i < at and (m := _DOMAIN.match(s, at + 1)):
                out.append((0, i, m.end()))
                last = m.end()
        at = s.find("@", at + 1)
    for m in _IP.finditer(s):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(s):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(s):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# --- features and decoding -----------------------------------------------------------------

_CUES = [re.compile(p) for p in (r"\b(?:e-?mails?|contact|write)\W*$", r"\b(?:ip|host|server|address|ping)\W*$", r"\b(?:card|visa|credit|pan)\W*$", r"\b(?:phone|tel|call|fax|mobile)\W*$")]
_NO_CUES = (False,) * len(_CUES)
_GROUPS = re.compile(r"[0-9]+")
_FULL = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}",
    r"[0-9](?:[ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")]
N_FEATURES = 32


def features(s: str, a: int, z: int, cues: tuple[bool, ...]) -> list[float]:
    """Whole-span features of the candidate s[a:z]; ``cues`` tell which kinds the words before s announce, and
    count where the span begins s."""
    span = s[a:z]
    groups = [len(g) for g in _GROUPS.findall(span)]
    n = sum(groups)
    before, after = s[a - 1] if a else " ", s[z] if z < len(s) else " "
    full = [p.fullmatch(span) is not None for p in _FULL]
    card = full[2] and 16 <= n <= 19
    even = card and (groups == [n] or len(groups) > 1 and set(groups[:-1]) == {4})
    return [
        1.0, full[0], full[1] and all(len(p) <= 3 and int(p) <= 255 for p in span.split(".")), card and luhn(span.replace(" ", "").replace("-", "")), even,
        full[3] and 8 <= n <= 15, full[3] and not 8 <= n <= 15, full[4], full[2] and not card, n < 7, 7 <= n <= 15, 16 <= n <= 19, n > 19,
        span[0] == "+", "@" in span, span.count("(") == span.count(")") <= 1, any(c.isalpha() for c in span), " " in span,
        before.isalnum() or before in "@_", after.isalnum() or after in "@_", before in ".-+/=\"'(" , after in "/=\"'@", len(groups) > 5, len(groups) == 4 and span[0] == "+",
        bool(groups) and groups[-1] >= 3, full[3] and max(groups, default=0) > 10,
        after in ".-" and s[z + 1 : z + 2].isalnum(), before in ".-" and a > 1 and s[a - 2].isalnum(), *(cues if a == 0 else _NO_CUES),
    ]


class Candidates:
    """The segments of a string that can be an entity: atom bounds and features."""

    def __init__(self, s: str, cues: tuple[bool, ...] = _NO_CUES):
        bounds = [0, *(m.end() for m in _ATOM.finditer(s))]
        self.bounds = bounds
        rows, self.start, self.end = [], [], []
        n = len(bounds) - 1
        upto = [0]
        for i in range(n):
            upto.append(upto[-1] + (bounds[i + 1] - bounds[i] if "0" <= s[bounds[i]] <= "9" else 0))
        for i in range(n):
            c = s[bounds[i]]
            if not (c.isascii() and c.isalnum() or c in "+("):
                continue
            mark = False
            for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
                last = s[bounds[j - 1]]
                mark = mark or last == "@"
                if last in "\t\n" or not (last.isascii() and last.isalnum()):
                    continue
                if upto[j] - upto[i] < 4 and not mark or upto[j] - upto[i] > 40:
                    continue
                rows.append(features(s, bounds[i], bounds[j], cues))
                self.start.append(i)
                self.end.append(j)
        self.x = np.array(rows, float).reshape(len(rows), N_FEATURES)

    def ending(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for k, j in enumerate(self.end):
            out.setdefault(j, []).append(k)
        return out


def decode(s: str, weights: np.ndarray, cues: tuple[bool, ...] = _NO_CUES) -> list[tuple[int, int, int]]:
    """The best segmentation of ``s``: its entities as (kind number, start, end)."""
    c = Candidates(s, cues)
    if not c.start:
        return []
    scores = c.x @ weights.T
    kind, value = scores.argmax(axis=1), scores.max(axis=1)
    n = len(c.bounds) - 1
    ending = c.ending()
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            if (v := best[c.start[k]] + value[k]) > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            k = back[j]
            out.append((int(kind[k]), c.bounds[c.start[k]], c.bounds[j]))
            j = c.start[k]
    return out[::-1]


# --- training -------------------------------------------------------------------------------


def _made_up(r: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Strings with the entities in them: each kind, look-alikes, and runs of both."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def card() -> str:
        body = digits(r.choice((15, 15, 15, 16, 17, 18)))
        whole = next(body + d for d in "0123456789" if luhn(body + d))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4)) if sep else whole

    makers = [
        (0, lambda: f"{letters(r.randint(1, 8))}{r.choice(('', '.', '_'))}{r.choice(('', digits(2)))}@{letters(r.randint(2, 8))}{r.choice(('', digits(1)))}.{r.choice(('com', 'example.com', 'org', 'co.uk'))}"),
        (1, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))),
        (2, card),
        (3, lambda: f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"+{r.randint(1, 99)} {digits(2)} {digits(4)} {digits(4)}"),
        (3, lambda: f"+{digits(r.randint(9, 13))}"),
        (3, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
    ]
    others = [
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: digits(r.randint(1, 12)),
        lambda: next(d for d in iter(lambda: digits(16), "") if not luhn(d)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 40)))),
        lambda: f'"{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{r.randint(256, 999)}.{r.randint(0, 255)}.{r.randint(256, 999)}.{r.randint(0, 255)}",
        lambda: digits(r.randint(20, 30)), lambda: f"@{letters(6)}", lambda: f"{digits(1)},{digits(3)}.{digits(2)}", lambda: f"{letters(4)}@{letters(5)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
    ]
    out = []
    for _ in range(420):
        s, gold = "", []
        for _ in range(r.choice((1, 1, 2, 2, 3))):
            if s:
                s += " "
            if r.random() < 0.6:
                kind, make = r.choice(makers)
                part = make()
                gold.append((kind, len(s), len(s) + len(part)))
                s += part + r.choice(("", "", "", ".", ","))
            else:
                s += r.choice(others)()
        out.append((s, gold))
    return out


def _cued(r: random.Random) -> list[tuple[str, list[tuple[int, int, int]], tuple[bool, ...]]]:
    """Strings that are an entity where the words before announce its kind, and none without; and
    strings that no such word makes one."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    open_card = lambda: next(d for d in iter(lambda: digits(16), "") if not luhn(d))
    decided = [
        (0, lambda: f"{letters(r.randint(3, 8))}@{letters(r.randint(4, 8))}"),
        (2, lambda: (lambda d, sep: sep.join(d[i : i + 4] for i in range(0, 16, 4)))(open_card(), r.choice(("", " ", "-")))),
        (3, lambda: digits(r.randint(9, 11))), (3, lambda: digits(r.randint(9, 11))), (3, lambda: f"{digits(3)}{r.choice('- ')}{digits(4)}"),
    ]
    never = [
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}", lambda: f"@{letters(6)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 18, 40)))), lambda: digits(r.randint(20, 30)), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: digits(r.randint(1, 5)),
    ]
    out = []
    for _ in range(40):
        for kind, make in decided:
            s = make()
            told = tuple(k == kind for k in range(len(KINDS)))
            end = r.choice(("", "", ".", ","))
            out += [(s + end, [(kind, 0, len(s))], told), (s + end, [], _NO_CUES)]
        for wrong in range(len(KINDS)):
            told = tuple(k == wrong for k in range(len(KINDS)))
            out += [(make(), [], told) for make in (never[0], r.choice(never))]
    return out


def train(examples: list[tuple], rounds: int = 60, penalty: float = 0.002, rate: float = 0.25) -> np.ndarray:
    """Weights [kind, feature] of the highest penalised likelihood, by Adam on the exact gradient.
    An example is a string, its entities and, if any, its cues."""
    data = []
    for s, gold, *cues in examples:
        c = Candidates(s, *cues)
        at = {(c.bounds[i], c.bounds[j]): k for k, (i, j) in enumerate(zip(c.start, c.end))}
        if all((a, z) in at for _, a, z in gold):
            y = np.zeros((len(c.start), len(KINDS)))
            for kind, a, z in gold:
                y[at[a, z], kind] = 1
            ends, starts = c.ending(), {}
            for k, i in enumerate(c.start):
                starts.setdefault(i, []).append(k)
            data.append((c, y, np.array(c.start, int), np.array(c.end, int), {j: np.array(k) for j, k in ends.items()}, {i: np.array(k) for i, k in starts.items()}))
    w = np.zeros((len(KINDS), N_FEATURES))
    w[:, 0] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = -penalty * len(data) * w
        for c, y, start, end, ends, starts in data:
            if not len(start):
                continue
            scores = c.x @ w.T
            top = scores.max(axis=1)
            seg = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
            n = len(c.bounds) - 1
            alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                alpha[j] = alpha[j - 1]
                if (k := ends.get(j)) is not None:
                    alpha[j] = np.logaddexp(alpha[j], np.logaddexp.reduce(alpha[start[k]] + seg[k]))
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1]
                if (k := starts.get(i)) is not None:
                    beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(beta[end[k]] + seg[k]))
            p = np.exp(np.minimum(0, alpha[start][:, None] + scores + beta[end][:, None] - alpha[n]))
            grad += (y - p).T @ c.x
        grad /= max(1, len(data))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def _sample(df: DataFrame, id_col: str, text_col: str, documents: int, islands: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Islands of a bounded sample of documents, labelled by the patterns, where those explain all
    long numbers and at signs; at most ``islands`` of at most 120 characters."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    ids = [r[0] for r in rows.where("_id is not null").select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(documents).collect()]
    if not ids:
        return []
    few = df.sparkSession.createDataFrame([(i,) for i in ids], f"_chosen {rows.schema['_id'].dataType.simpleString()}")

    def run(batches):
        for batch in batches:
            found = []
            for raw, at in textvec.slices(batch.column(0)):
                found += [s for _, _, s, _ in _islands(raw, at) if len(s) <= 120]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["s"])

    found = rows.join(F.broadcast(few), F.col("_id") == F.col("_chosen")).select("text").mapInArrow(common.lean(run), "s string")
    texts = [r["s"] for r in found.distinct().orderBy(F.xxhash64("s"), "s").limit(islands).collect()]
    out = []
    for s in texts:
        gold = base_spans(s)
        rest = list(s)
        for _, a, z in gold:
            rest[a:z] = " " * (z - a)
        clash = any(a < y and x < z for i, (_, a, z) in enumerate(gold) for _, x, y in gold[:i])
        if not clash and "@" not in rest and not re.search(r"[0-9]{7}|\+[0-9]|[0-9]{3}[ )-]", "".join(rest)):
            out.append((s, gold))
    return out


def fit(df: DataFrame, id_col: str, text_col: str, documents: int = 1500, islands: int = 250) -> np.ndarray:
    return train(_made_up(random.Random(7)) + _cued(random.Random(8)) + _sample(df, id_col, text_col, documents, islands))


# --- whole texts ------------------------------------------------------------------------------

_DIGIT_AT = np.zeros(256, bool)
_DIGIT_AT[[*range(48, 58), 64]] = True
_OTHER = np.ones(256, bool)
_OTHER[[ord(c) for c in "().-"]] = False


def _islands(raw: np.ndarray, offsets: np.ndarray):
    """(row, code point offset in the row's text, the island's text, the text before it)."""
    start, end, first = textvec.words(raw, offsets)
    if not len(start):
        return
    count = lambda mask: (u := np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int32)]))[end] - u[start]
    hot = count(_DIGIT_AT) > 0
    if not hot.any():
        return
    glue = hot | (count(_OTHER) == 0)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # a word goes on the run of the one before: same row, spaces only between
    tabs = np.concatenate([[0], np.cumsum((raw >= 9) & (raw <= 13), dtype=np.int32)])
    joined = np.zeros(len(start), bool)
    joined[1:] = glue[1:] & glue[:-1] & (row[1:] == row[:-1]) & (tabs[start[1:]] == tabs[end[:-1]])
    run = np.cumsum(~joined)
    at = np.flatnonzero(hot)
    cuts = np.flatnonzero(np.diff(run[at], prepend=-1))
    heads, tails = at[cuts], at[np.append(cuts[1:], len(at)) - 1]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    for h, t in zip(heads.tolist(), tails.tolist()):
        a, z = int(start[h]), int(end[t])
        lo = max(int(offsets[row[h]]), a - 24)
        yield int(row[h]), int(points[a] - points[offsets[row[h]]]), raw[a:z].tobytes().decode(), raw[lo:a].tobytes().decode(errors="ignore").lower()


def _found(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each row, by kind, then start."""
    base = [[] for _ in range(len(offsets) - 1)]
    every = [[] for _ in range(len(offsets) - 1)]
    for row, shift, s, before in _islands(raw, offsets):
        given = base_spans(s)
        base[row] += [(k, a + shift, z + shift) for k, a, z in given]
        every[row] += [(k, a + shift, z + shift) for k, a, z in given]
        # what no pattern covers, piece by piece
        lo = 0
        for a, z in [*sorted((a, z) for _, a, z in given), (len(s), len(s))]:
            piece = s[lo:a]
            if a > lo and (sum("0" <= c <= "9" for c in piece) >= 7 or "@" in piece):
                cues = tuple(bool(p.search(before)) if lo == 0 else False for p in _CUES)
                every[row] += [(k, x + lo + shift, y + lo + shift) for k, x, y in decode(piece, weights, cues)]
            lo = max(lo, z)
    for spans in (*base, *every):
        spans.sort()
    return base, every


def _span_type() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, id_col: str, text_col: str, weights: np.ndarray | None = None) -> DataFrame:
    """(id, base, spans): spans as (kind, start, end) in code points, by kind, then start.

    ``base`` are the patterns' matches, ``spans`` these and what the model adds beside them;
    added spans overlap neither each other nor a base span. Null and empty texts have none.
    One row per input row, in one pass over whole texts.
    """
    common.session(df)
    weights = fit(df, id_col, text_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            base, every = [], []
            for raw, at in textvec.slices(batch.column(1)):
                b, e = _found(raw, at, weights)
                base += b
                every += e
            named = [pa.array([[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in row] for row in side], _span_type()) for side in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *named], ["id", "base", "spans"])

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long>>"
    return picked.mapInArrow(common.lean(run), f"id {kind}, base {spans}, spans {spans}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first."""
    out, at, upto = [], 0, -1
    for a, z, k in sorted((a, z, k) for k, a, z in spans):
        if a >= upto:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = upto = max(upto, z)
    return "".join(out) + text[at:]


def redact(df: DataFrame, id_col: str, text_col: str, length_col: str | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """The rows of ``df``, all columns, with personal data in the text replaced by its kind in
    brackets, and ``length_col`` (code points) following the text; rows without any are unchanged."""
    common.session(df)
    weights = fit(df, id_col, text_col) if weights is None else weights
    where, length = df.columns.index(text_col), df.columns.index(length_col) if length_col else None

    def run(batches):
        for batch in batches:
            every = [e for raw, at in textvec.slices(batch.column(where)) for e in _found(raw, at, weights)[1]]
            columns = list(batch.columns)
            if any(every):
                texts = [masked(t.as_py(), e) if e else t for t, e in zip(batch.column(where), every)]
                columns[where] = pa.array([t if isinstance(t, str) else t.as_py() for t in texts], pa.string())
                if length is not None:
                    sizes = [len(t) if e else n.as_py() for t, e, n in zip(texts, every, columns[length])]
                    columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(common.lean(run), df.schema)
