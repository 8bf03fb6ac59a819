"""Evidence in scripts (D11-D14, F2, F3, F5, W6, U3): one Arrow pass over the texts.

A text is masked once; one search for the verbs that evidence starts with finds where
patterns are tried; lines are numbered by binary search over the line starts. Time is
linear in the text and its hits, no line is exploded and nothing is joined.

Patterns are those of Python's ``re``; blanks, words and case are ASCII's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import lexer
from ..functions.text import BLANK

# What counts as a schema change, as a data change, and as evidence of each,
# in order (matched without regard to case); lines that make an UPDATE no data change;
# the display's rows per family and characters per snippet.
DDL_OBJECTS = "table|type|schema|extension|index|view|materialized|function|policy|trigger|publication|subscription"
DDL_ANY = r"\b(?:create\s+(?:or\s+replace\s+)?(?:unique\s+)?|alter\s+|drop\s+)(?:" + DDL_OBJECTS + r")\b"
DML_ANY = r"\b(insert\s+into|delete\s+from|merge\s+into|truncate\s+table)\b"
DDL_EVIDENCE = [
    ("CREATE TABLE", r"\bcreate\s+table\b"),
    ("ALTER TABLE", r"\balter\s+table\b"),
    ("DROP TABLE", r"\bdrop\s+table\b"),
    ("CREATE VIEW", r"\bcreate\s+(?:or\s+replace\s+)?view\b"),
    ("CREATE MATERIALIZED VIEW", r"\bcreate\s+materialized\s+view\b"),
    ("CREATE FUNCTION", r"\bcreate\s+(?:or\s+replace\s+)?function\b"),
    ("ALTER FUNCTION", r"\balter\s+function\b"),
    ("CREATE POLICY", r"\bcreate\s+policy\b"),
    ("CREATE TRIGGER", r"\bcreate\s+trigger\b"),
    ("CREATE TYPE", r"\bcreate\s+type\b"),
    ("CREATE INDEX", r"\bcreate\s+(unique\s+)?index\b"),
]
DML_EVIDENCE = [
    ("INSERT INTO", r"\binsert\s+into\b"),
    ("DELETE FROM", r"\bdelete\s+from\b"),
    ("MERGE INTO", r"\bmerge\s+into\b"),
    ("TRUNCATE TABLE", r"\btruncate\s+table\b"),
]
UPDATE = ("UPDATE", r"\bupdate\b\s+\S+")
UPDATE_NOT_DML = r"\b(?:for\s+update|on\s+update|before\s+update\s+on|after\s+update\s+on)\b"
TOP_ROWS = 3
SNIPPET_CHARS = 180

_I = "(?i)"
_FLAGS = re.IGNORECASE | re.ASCII
#: Rows of one Arrow batch of evidence.
BATCH_ROWS = 16384
_TRIM = "".join(chr(c) for c in range(0x10000) if re.match(BLANK, chr(c)))
#: What ends a line for a marker, as in the pattern that has_marker uses.
_LINE_ENDS = "\n\r\x85\u2028\u2029"

# a match: (family, pattern_no, pattern, match_no, line, snippet)
Match = tuple[str, int, str, int, int, str]
_FOUND = [("family", pa.string(), T.StringType()), ("pattern_no", pa.int32(), T.IntegerType()), ("pattern", pa.string(), T.StringType()),
          ("match_no", pa.int32(), T.IntegerType()), ("line", pa.int64(), T.LongType()), ("snippet", pa.string(), T.StringType())]


@F.pandas_udf(T.StringType())
def mask(texts):
    """Comments, strings, quoted names and dollar bodies blanked; length and line feeds kept."""
    return texts.map(lexer.mask_sql)


def marker_pattern(marker: str) -> str:
    """A comment line that starts with the marker; blanks are those a browser-side trim knows, the byte order mark too."""
    return rf"(?im)^{BLANK}*--{BLANK}*{re.escape(marker)}(?:{BLANK}|$)"


def has_marker(text: Column, marker: str) -> Column:
    """F2."""
    return F.coalesce(text.contains("--") & text.rlike(marker_pattern(marker)), F.lit(False))


def has_ddl(masked: Column) -> Column:
    return F.coalesce(masked.rlike(_I + DDL_ANY), F.lit(False))


@F.pandas_udf(T.BooleanType())
def has_update(masked):
    """Is there an UPDATE that counts as a data change? The same test as the evidence rows make."""
    return masked.map(lambda t: t is not None and any(True for _ in _updates(t, _Lines(t, SNIPPET_CHARS))))


def has_dml(masked: Column) -> Column:
    return F.coalesce(masked.rlike(_I + DML_ANY) | has_update(masked), F.lit(False))


def statement_kind(masked: Column) -> Column:
    """'schema', 'data' or null; a schema change wins."""
    return F.when(has_ddl(masked), "schema").when(has_dml(masked), "data")


class _Lines:
    """Number and snippet of the line a position lies on; the line starts are found when first asked for."""

    def __init__(self, text: str, chars: int):
        self.text, self.chars, self.starts, self.last = text, chars, None, (0, "")

    def at(self, pos: int) -> tuple[int, str]:
        if self.starts is None:
            self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        no = bisect_right(self.starts, pos)
        if self.last[0] != no:
            end = self.starts[no] - 1 if no < len(self.starts) else len(self.text)
            self.last = (no, _cut(self.text[self.starts[no - 1]:end].strip(_TRIM), self.chars))
        return self.last


def _cut(line: str, chars: int) -> str:
    return line[:chars - 3] + "..." if len(line) > chars else line


def _first_words(patterns) -> dict[str, list]:
    """The patterns of both families by the word that their matches start with."""
    by = {}
    for family, no, name, rx in patterns:
        by.setdefault(re.match(r"\\b(\w+)", rx)[1], []).append((family, no, name, re.compile(rx, _FLAGS)))
    return by


_VERBS = _first_words([("ddl", i, n, rx) for i, (n, rx) in enumerate(DDL_EVIDENCE)] + [("dml", i, n, rx) for i, (n, rx) in enumerate(DML_EVIDENCE)])
_VERB = re.compile("|".join(_VERBS))
_VERB_ANY_CASE = re.compile("|".join(_VERBS), _FLAGS)
_UPDATE = re.compile(UPDATE[1], _FLAGS)
_NOT_DML = re.compile(UPDATE_NOT_DML, _FLAGS)


def _updates(masked: str, lines: _Lines) -> Iterator[tuple[int, int, str]]:
    """(match_no, line, snippet) of each UPDATE that starts a statement (only blanks since the start, a
    semicolon or a line feed) on a line that doesn't say otherwise."""
    for k, m in enumerate(_UPDATE.finditer(masked)):
        i = m.start()
        while i and masked[i - 1] in " \t\r":
            i -= 1
        if i == 0 or masked[i - 1] in ";\n":
            no, snippet = lines.at(m.start())
            if not _NOT_DML.search(snippet):
                yield k, no, snippet


def _statement_matches(text: str, chars: int) -> Iterator[Match]:
    """D12, D13 in a raw text. All patterns are tried where one of their first words is; the matches of
    one pattern don't overlap."""
    masked = lexer.mask_sql(text)
    lines = _Lines(masked, chars)
    low = masked.lower()
    same_places = len(low) == len(masked)
    done: dict[tuple[str, int], tuple[int, int]] = {}  # (family, pattern) -> (matches, end of the last)
    for verb in _VERB.finditer(low) if same_places else _VERB_ANY_CASE.finditer(masked):
        for family, no, name, rx in _VERBS[verb[0].lower()]:
            n, end = done.get((family, no), (0, 0))
            if verb.start() >= end and (m := rx.match(masked, verb.start())):
                done[family, no] = (n + 1, m.end())
                yield (family, no, name, n, *lines.at(verb.start()))
    for k, no, snippet in _updates(masked, lines):
        yield "dml", len(DML_EVIDENCE), UPDATE[0], k, no, snippet


def _marker_matches(text: str, markers: Sequence[tuple[str, re.Pattern]]) -> Iterator[Match]:
    """Comment lines that start with a marker, with the blanks and blank lines before them."""
    if "--" not in text:
        return
    lines = _Lines(text, SNIPPET_CHARS)
    for no, (marker, rx) in enumerate(markers):
        n = end = 0
        for m in rx.finditer(text):
            q = m.start()
            while q > end and text[q - 1] in _TRIM:
                q -= 1
            # the match starts with the first line that starts in these blanks
            start = next((x for x in range(q, m.start() + 1) if _starts_line(text, x)), None)
            if start is not None and start >= end:
                yield "marker", no, marker, n, lines.at(start)[0], text[start:m.end()].strip(_TRIM)
                n, end = n + 1, m.end()


def _starts_line(text: str, pos: int) -> bool:
    return pos == 0 or (text[pos - 1] in _LINE_ENDS and text[pos - 1:pos + 1] != "\r\n")


def _marker_line(marker: str) -> re.Pattern:
    return re.compile(rf"--{BLANK}*{re.escape(marker)}(?:{BLANK}|(?=\x85)|\Z)[^{_LINE_ENDS}]*", _FLAGS)


def _arrow_pass(df: DataFrame, keys: Sequence[str], text: str, find: Callable[[str], Iterator[Match]]) -> DataFrame:
    """(keys, family, pattern_no, pattern, match_no, line, snippet) of what ``find`` yields for each text;
    rows are handed on in batches, however many one text has."""
    keys = list(keys)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, _, t in _FOUND])

    def emit(batch, at, rows):
        kept = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(keys))]
        cols = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), _FOUND)]
        return pa.RecordBatch.from_arrays(kept + cols, names=[*keys, *(n for n, _, _ in _FOUND)])

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(len(keys))):
                t = t.as_py()
                for row in find(t) if t else ():
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= BATCH_ROWS:
                        yield emit(batch, at, rows)
                        at, rows = [], []
            if rows:
                yield emit(batch, at, rows)

    return df.select(*keys, F.col(text).alias("_evidence_text")).mapInArrow(run, schema)


def pattern_matches(scripts: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[tuple[str, str]], family: str = "pattern",
                    snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """(keys, family, pattern_no, pattern, match_no, line, snippet) of every match of every pattern;
    the snippet is the trimmed line that the match starts on."""
    named = list(patterns)

    def find(t: str) -> Iterator[Match]:
        lines = _Lines(t, snippet_chars)
        for no, (name, rx) in enumerate(named):
            for k, m in enumerate(re.compile(rx, re.ASCII).finditer(t)):
                yield (family, no, name, k, *lines.at(m.start()))

    return _arrow_pass(scripts, keys, text, find)


def script_evidence(scripts: DataFrame, keys: Sequence[str], text_col: str, markers: Sequence[str] = (), snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """All evidence rows of each script; ``keys`` name a script.

    ``family`` is ddl, dml (with UPDATE after the other patterns) or marker; rows are in
    order by (pattern_no, match_no). Nothing is cut but the snippets: see :func:`top_evidence`.
    Texts that are null or empty have no rows.
    """
    marks = list(markers)

    def find(t: str) -> Iterator[Match]:
        yield from _statement_matches(t, snippet_chars)
        if marks:
            yield from _marker_matches(t, [(m, _marker_line(m)) for m in marks])

    return _arrow_pass(scripts, keys, text_col, find)


def top_evidence(evidence: DataFrame, keys: Sequence[str], limit: int = TOP_ROWS) -> DataFrame:
    """W6, the display's cut: the first ``limit`` rows of each script and family, with ``rank``."""
    first = Window.partitionBy(*keys, "family").orderBy("pattern_no", "match_no")
    return evidence.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= limit)


def evidence_lists(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per script and family: its rows as an array, for display or :func:`audit.audit_documents`."""
    rows = F.sort_array(F.collect_list(F.struct("pattern_no", "match_no", "pattern", "line", "snippet")))
    return evidence.groupBy(*keys, "family").agg(F.transform(rows, lambda r: F.struct(r["pattern"].alias("pattern"), r["line"].alias("line"), r["snippet"].alias("snippet"))).alias("matches"))
