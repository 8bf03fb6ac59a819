"""Reports over whole corpora: a reset's outcome (R7), the cutoff with both ledgers (R1) and the audit."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import evidence
from .audit import DATA_MARKER, SCHEMA_MARKER, audit_summary
from .ledger import is_valid_version, resolve_cutoff
from .replay import summary_row
from ..functions.text import deploy_date, deploy_date_short, js_trim_col

SOURCE_LABELS = {"argument": "given as an argument", "linked": "latest version on both sides", "config": "configured fallback"}
NO_LEDGER = "no ledger rows"
NOT_APPLIED = "not applied"
NO_EVIDENCE = "array<struct<pattern:string,line:bigint,snippet:string>>"


def reset_summary(classified: DataFrame, outcomes: DataFrame, group_cols: Sequence[str], cutoff: Column, phase_col: str = "phase",
                  class_col: str = "classification") -> DataFrame:
    """One row per row of ``outcomes``: how a reset or start of a corpus ended, beside its counts.

    ``outcomes``: group columns, mode ('reset', else a start), status ('success', all else is a failure), step,
    step_label, error_message, restored (are the scripts back?), applied_new (had the scripts after the
    cutoff run?). A success tells what ran, was skipped and was applied; a failure tells the plan: all of
    the past in one phrase, and whether the new scripts were reached. Corpora without scripts count zero.
    """
    g = list(group_cols)
    counts = summary_row(classified, g, cutoff, phase_col, class_col).drop("last_deploy", "pre_label")
    j = outcomes.join(counts, g, "left")
    done = F.coalesce(F.col("status") == "success", F.lit(False))
    verb = F.when(F.col("mode") == "reset", "Reset").otherwise("Start")
    failed = F.concat(verb, F.lit(" failed at step "), F.coalesce(F.col("step").cast("string"), F.lit("?")), F.lit(" ("), F.coalesce("step_label", F.lit("?")), F.lit(")"))
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("ran_during_rebuild", "skipped_in_snapshot", "applied_after")}
    number = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("pre_total", "post_total")}
    past = F.concat_ws(" · ", F.nullif(text["ran_during_rebuild"], F.lit("")), F.nullif(text["skipped_in_snapshot"], F.lit("")))
    reached = done | F.coalesce(F.col("applied_new"), F.lit(False))
    return j.select(
        *g, "mode", "status",
        F.when(done, F.concat(verb, F.lit(" complete"))).otherwise(failed).alias("headline"),
        F.when(~done, F.split(F.coalesce("error_message", F.lit("")), "\n", -1)).alias("error_lines"),
        F.when(~done, F.when(F.col("restored"), "scripts restored").otherwise("scripts not restored")).alias("restore_note"),
        deploy_date(cutoff).alias("last_deploy"),
        (number["pre_total"] + number["post_total"]).alias("n_scripts"),
        F.concat(F.lit("≤ "), deploy_date_short(cutoff)).alias("pre_label"), number["pre_total"].alias("pre_total"),
        F.when(done, text["ran_during_rebuild"]).otherwise(past).alias("pre_phrase"),
        F.when(done, text["skipped_in_snapshot"]).alias("skipped_phrase"),
        F.concat(F.lit("> "), deploy_date_short(cutoff)).alias("post_label"), number["post_total"].alias("post_total"),
        F.when(reached, text["applied_after"]).when(number["post_total"] > 0, NOT_APPLIED).otherwise("").alias("post_phrase"))


def cutoff_report(settings: DataFrame, aligned: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """R1's report: the cutoff of each corpus, where it comes from, and both ledgers' latest versions.

    ``settings``: group columns, argument, env, env_config, config; ``aligned``: rows of :func:`ledger.alignment`.
    A corpus without ledger rows says so in ``alignment_error``, and its cutoff comes from the others; a
    cutoff that is no number is told in ``cutoff_error``.
    """
    g = list(group_cols)
    latest = ["latest_local", "latest_remote", "latest_aligned"]
    j = settings.join(aligned.select(*g, *latest, F.lit(True).alias("_known")), g, "left")
    r = resolve_cutoff(F.col("argument"), F.col("latest_aligned"), F.col("env_config"), F.col("config"))
    j = j.withColumn("_r", r)
    cutoff, source = F.col("_r.value"), F.col("_r.source")
    label = F.coalesce(*[F.when(source == k, v) for k, v in SOURCE_LABELS.items()])
    return j.select(
        *g, cutoff.alias("cutoff"), F.when(is_valid_version(cutoff), js_trim_col(cutoff).try_cast("decimal(38,0)")).alias("cutoff_number"),
        source.alias("source"), label.alias("source_label"), "env", *latest,
        F.when(F.col("_known").isNull(), NO_LEDGER).alias("alignment_error"),
        F.when(cutoff.isNull(), "no cutoff").when(~is_valid_version(cutoff), "not a number").alias("cutoff_error"))


def audit_report(audit: DataFrame, keys: Sequence[str], group_cols: Sequence[str], found: DataFrame | None = None, limit: int = evidence.TOP_ROWS,
                 data_marker: str = DATA_MARKER, schema_marker: str = SCHEMA_MARKER) -> DataFrame:
    """The audit of a run as JSON lines: (group columns, section, keys, json).

    Section 0 is one line per corpus, its metadata and summary; section 1 is one line per script. In the order of
    (group, section, keys) the lines of a corpus are its document; none holds more than one script. ``keys``
    name a script and begin with the group columns. With ``found`` (evidence rows) each result has its first
    ``limit`` matches per family, and the metadata says verbose.
    """
    g, keys = list(group_cols), list(keys)
    own = [k for k in keys if k not in g]
    as_json = lambda *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json")
    counts = [F.col(c) for c in ("data", "schema", "mixed", "unknown", "suggested_updates")]
    metadata = F.struct(*g, F.lit(data_marker).alias("data_marker"), F.lit(schema_marker).alias("schema_marker"), F.lit(found is not None).alias("verbose"))
    head = audit_summary(audit, g).select(*g, F.lit(0).alias("section"), *[F.lit(None).cast(audit.schema[k].dataType).alias(k) for k in own],
                                          as_json(metadata.alias("metadata"), F.struct(*counts).alias("summary")))
    told = [F.col(c) for c in (*own, "classification", "source", "reasons", "recommendation", "recommended_marker", "has_data_marker", "has_schema_marker")]
    if found is not None:
        families = ["ddl", "dml", "marker"]
        lists = evidence.evidence_lists(evidence.top_evidence(found, keys, limit), keys)
        per = lists.groupBy(*keys).agg(*[F.max(F.when(F.col("family") == f, F.struct("matches")))["matches"].alias(f"_{f}") for f in families])
        audit = audit.join(per, keys, "left")
        told.append(F.struct(*[F.coalesce(F.col(f"_{f}"), F.array().cast(NO_EVIDENCE)).alias(f) for f in families]).alias("evidence"))
    return head.unionByName(audit.select(*g, F.lit(1).alias("section"), *own, as_json(*told)))
