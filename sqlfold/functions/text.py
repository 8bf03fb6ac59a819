"""Column-level scalar functions (X1-X18), all native Spark expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, functions as F

# Fixed values -----------------------------------------------------------------
# Whitespace removed by a JavaScript-style trim (Java regex class syntax).
TRIM_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same blanks, as a class inside another pattern.
BLANK = TRIM_CLASS
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
CLASS_ORDER = ["schema", "data", "mixed", "unknown"]
CLASS_LABEL = {"schema": "schema", "data": "data", "mixed": "schema+data", "unknown": "unrecognized"}
REDACTED = "[REDACTED]"
# ------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim_col(c) -> Column:
    """Trim all Unicode blanks and BOM at both ends (Spark ``trim`` only strips spaces)."""
    from .lexer import JS_SPACE

    return F.btrim(_c(c), F.lit(JS_SPACE))


def js_trim_end_col(c) -> Column:
    """Trim trailing blanks; the regex only runs on values whose last character is blank."""
    t = _c(c)
    return F.when(F.substring(t, -1, 1).rlike(TRIM_CLASS), F.regexp_replace(t, rf"{TRIM_CLASS}+\z", "")).otherwise(t)


def line_count(c) -> Column:
    """Number of LF-separated pieces."""
    return F.size(F.split(_c(c), "\n", -1))


def byte_length(c) -> Column:
    """UTF-8 byte length."""
    return F.octet_length(_c(c))


def sanitize_name(c) -> Column:
    """Non ``[A-Za-z0-9_]`` to ``_``, lower case."""
    return F.lower(F.regexp_replace(_c(c), "[^a-zA-Z0-9_]", "_"))


def padded(n, width: int) -> Column:
    """Zero padded number that never truncates (unlike ``lpad``)."""
    return F.format_string(f"%0{width}d", _c(n))


def glob_to_regex(pattern: str, star: str = ".*") -> str:
    """Anchored regex for a glob where only ``*`` is special (driver-side literal)."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(star)
        elif ch in ".+^${}()|[]\\?":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "^" + "".join(out) + "$"


def normalize_script(c) -> Column:
    """CRLF to LF, trailing blanks removed, one final LF.

    The trailing-blank regex only runs on texts whose last character is blank.
    """
    t = F.replace(_c(c), F.lit("\r\n"), F.lit("\n"))
    ends_blank = F.substring(t, -1, 1).rlike(TRIM_CLASS)
    return F.concat(F.when(ends_blank, js_trim_end_col(t)).otherwise(t), F.lit("\n"))


def normalize_statement(masked) -> Column:
    """Masked statement trimmed, lower-cased, blanks squeezed."""
    return F.regexp_replace(F.lower(js_trim_col(masked)), rf"{BLANK}+", " ")


BOM = "\ufeff"


def prepend_marker(text, marker: str) -> Column:
    """``-- marker``, a blank line, the text; a byte order mark stays in front."""
    t = _c(text)
    head = F.lit(f"-- {marker}\n\n")
    return F.when(t.startswith(BOM), F.concat(F.lit(BOM), head, F.substr(t, F.lit(2)))).otherwise(F.concat(head, t))


def remove_marker_lines(text, markers: Sequence[str]) -> Column:
    """(text, removed): the text without the lines that, trimmed, are ``-- marker`` or ``--marker``."""
    t = _c(text)
    bom = F.when(t.startswith(BOM), F.lit(BOM)).otherwise(F.lit(""))
    lines = F.split(F.when(t.startswith(BOM), F.substr(t, F.lit(2))).otherwise(t), "\n", -1)
    exact = [f"--{blank}{m}" for m in markers for blank in (" ", "")]
    keep = F.filter(lines, lambda ln: ~js_trim_col(ln).isin(exact))
    return F.struct(F.concat(bom, F.array_join(keep, "\n")).alias("text"), (F.size(keep) < F.size(lines)).alias("removed"))


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in s)


def deploy_date(v) -> Column:
    """X11: ``Mon D YYYY`` for a version starting with 8 digits, else the raw text."""
    t = js_trim_col(v)
    months = F.array(*[F.lit(m) for m in MONTHS])
    mon = F.substring(t, 5, 2).try_cast("int")
    name = F.when((mon >= 1) & (mon <= 12), F.element_at(months, mon)).otherwise(F.substring(t, 5, 2))
    day = F.substring(t, 7, 2).cast("int").cast("string")
    return F.when(t.rlike(r"^[0-9]{8}"), F.concat_ws(" ", name, day, F.substring(t, 1, 4))).otherwise(t)


def deploy_date_short(v) -> Column:
    t = js_trim_col(v)
    months = F.array(*[F.lit(m) for m in MONTHS])
    mon = F.substring(t, 5, 2).try_cast("int")
    name = F.when((mon >= 1) & (mon <= 12), F.element_at(months, mon)).otherwise(F.substring(t, 5, 2))
    day = F.substring(t, 7, 2).cast("int").cast("string")
    return F.when(t.rlike(r"^[0-9]{8}"), F.concat_ws(" ", name, day)).otherwise(t)


def class_phrase(counts: dict, keys: Sequence[str] = CLASS_ORDER) -> Column:
    """``'2 schema · 1 data'`` from per-class count columns, fixed order, zeros left out."""
    parts = [
        F.when(_c(counts[k]) > 0, F.concat(_c(counts[k]).cast("string"), F.lit(" " + CLASS_LABEL[k])))
        for k in CLASS_ORDER
        if k in keys
    ]
    return F.concat_ws(" · ", *parts)


def redact(text, secrets: Column) -> Column:
    """Replace each literal of an array column, in order, by ``[REDACTED]``."""
    return F.aggregate(
        secrets, _c(text), lambda acc, s: F.when((s.isNull()) | (s == ""), acc).otherwise(F.replace(acc, s, F.lit(REDACTED)))
    )


def strip_version_prefix(name) -> Column:
    """``'20240101_add_x.sql' -> 'add_x.sql'``."""
    return F.regexp_replace(_c(name), r"^\d+_", "")


def quoted_entries(c) -> Column:
    """Entries of a quoted array literal ``["a", 'b']``."""
    return F.regexp_extract_all(_c(c), F.lit(r"""["']([^"']+)["']"""), 1)


def noop_stub(name, cutoff) -> Column:
    """Text of a no-op stand-in for a skipped data script."""
    return F.format_string(
        "-- skipped: %s\n-- already contained in the snapshot taken at %s\nSELECT 1;\n", _c(name), _c(cutoff)
    )


def wrap_transaction(text, wrapped) -> Column:
    """``BEGIN;``/``COMMIT;`` around a body when the source was wrapped."""
    t = _c(text)
    return F.when(_c(wrapped), F.concat(F.lit("BEGIN;\n"), t, F.lit("\nCOMMIT;\n"))).otherwise(t)


def evidence_phrase(matches) -> Column:
    """``'PATTERN@Lline, ...'`` or ``'none'``."""
    s = F.array_join(F.transform(_c(matches), lambda m: F.concat(m["pattern"], F.lit("@L"), m["line"].cast("string"))), ", ")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("none"))
