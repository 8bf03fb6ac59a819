"""Script audit: class decision, markers, summaries and documents."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import prepend_marker, remove_marker_lines
from . import evidence

# Default markers (our own names; configurable per call).
DATA_MARKER = "sqlfold:data-migration"
SCHEMA_MARKER = "sqlfold:schema-migration"


def classify_scripts(scripts: DataFrame, text_col: str = "text", data_marker: str = DATA_MARKER,
                     schema_marker: str = SCHEMA_MARKER) -> DataFrame:
    """has_ddl, has_dml, markers, classification, source, reason and recommended marker per
    script. Evidence rows are :func:`evidence.script_evidence`'s."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    f = scripts.withColumn("_masked", evidence.mask(text))
    f = f.select("*", evidence.has_ddl(F.col("_masked")).alias("has_ddl"), evidence.has_dml(F.col("_masked")).alias("has_dml"),
                 evidence.has_marker(text, data_marker).alias("has_data_marker"),
                 evidence.has_marker(text, schema_marker).alias("has_schema_marker")).drop("_masked")
    both_m = F.col("has_data_marker") & F.col("has_schema_marker")
    cls = (
        F.when(both_m, "mixed")
        .when(F.col("has_ddl") & F.col("has_dml"), "mixed")
        .when(F.col("has_data_marker"), "data")
        .when(F.col("has_schema_marker"), "schema")
        .when(F.col("has_dml"), "data")
        .when(F.col("has_ddl"), "schema")
        .otherwise("unknown")
    )
    src = (
        F.when(both_m, "marker")
        .when(F.col("has_ddl") & F.col("has_dml"),
              F.when(F.col("has_data_marker") | F.col("has_schema_marker"), "marker").otherwise("heuristic"))
        .when(F.col("has_data_marker") | F.col("has_schema_marker"), "marker")
        .otherwise("heuristic")
    )
    reason = (
        F.when(both_m, F.lit("both markers present"))
        .when(F.col("has_ddl") & F.col("has_dml"), F.lit("schema statements and data statements found"))
        .when(F.col("has_data_marker"), F.lit(f"marker -- {data_marker}"))
        .when(F.col("has_schema_marker"), F.lit(f"marker -- {schema_marker}"))
        .when(F.col("has_dml"), F.lit("data statements found"))
        .when(F.col("has_ddl"), F.lit("schema statements found"))
        .otherwise(F.lit("no marker and no recognised statement"))
    )
    out = f.withColumn("classification", cls).withColumn("source", src).withColumn("reasons", F.array(reason))
    rec = (
        F.when((F.col("classification") == "data") & ~F.col("has_data_marker"), "data")
        .when((F.col("classification") == "schema") & ~F.col("has_schema_marker"), "schema")
    )
    out = out.withColumn("recommended_marker", rec)
    # what to do about it
    out = out.withColumn(
        "recommendation",
        F.when(F.col("classification") == "mixed", F.lit("split into schema-only and data-only scripts"))
        .when(F.col("recommended_marker") == "data", F.lit(f"add -- {data_marker}"))
        .when(F.col("recommended_marker") == "schema", F.lit(f"add -- {schema_marker}"))
        .when(F.col("classification") == "unknown", F.lit("review manually"))
        .otherwise(F.lit("none")),
    )
    return out


def audit_summary(audit: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A3: counts per class and the number of suggested marker updates."""
    c = F.col("classification")
    return audit.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c == "data").alias("data"),
        F.count_if(c == "schema").alias("schema"),
        F.count_if(c == "mixed").alias("mixed"),
        F.count_if(c == "unknown").alias("unknown"),
        F.count_if(F.col("recommended_marker").isNotNull()).alias("suggested_updates"),
    )


def mark_candidates(audit: DataFrame, text_col: str = "text", data_marker: str = DATA_MARKER,
                    schema_marker: str = SCHEMA_MARKER) -> DataFrame:
    """R10 (mark): scripts missing their recommended marker, with the rewritten text."""
    cand = audit.filter(F.col("recommended_marker").isNotNull())
    return cand.withColumn(
        "new_text",
        F.when(F.col("recommended_marker") == "data", prepend_marker(text_col, data_marker))
        .otherwise(prepend_marker(text_col, schema_marker)),
    )


def unmark(scripts: DataFrame, text_col: str = "text", markers: Sequence[str] = (DATA_MARKER, SCHEMA_MARKER)) -> DataFrame:
    """R10 (unmark): text without exact marker lines, and whether any was removed."""
    new = remove_marker_lines(text_col, list(markers))
    return scripts.withColumn("_new", new).withColumns({"new_text": F.col("_new.text"), "removed": F.col("_new.removed")}).drop("_new")


def audit_documents(audit: DataFrame, found: DataFrame, keys: Sequence[str], limit: int = evidence.TOP_ROWS) -> DataFrame:
    """One JSON document per script: its columns and its first evidence rows per family."""
    lists = evidence.evidence_lists(evidence.top_evidence(found, keys, limit), keys)
    per = lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", "matches"))).alias("evidence"))
    return audit.join(per, list(keys), "left").select(*keys, F.to_json(F.struct(*audit.columns, "evidence")).alias("json"))
