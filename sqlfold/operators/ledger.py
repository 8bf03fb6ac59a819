"""Version ledgers: latest versions, alignment, cutoff resolution and the sync gate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import js_trim_col


def version_key(v) -> Column:
    """O2: versions order by length first, then text."""
    t = js_trim_col(v)
    return F.struct(F.length(t).alias("len"), t.alias("v"))


def is_valid_version(v) -> Column:
    """digits only (after trimming)."""
    return js_trim_col(v).rlike(r"^[0-9]+\z")


def latest(v) -> Column:
    """A5: the latest version of a group (aggregate expression)."""
    return F.max(version_key(v))["v"]


def alignment(ledger: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Latest local, latest remote and latest version present on both sides, per group.

    One pass over the ledger: both sides are exploded into (group, side, version)
    rows, reduced to one row per (group, version) with side flags (the set
    intersection), then to one row per group. Groups whose rows hold no valid
    version are kept with nulls.
    """
    g = list(group_cols)
    sides = F.array(
        F.struct(F.lit(True).alias("is_local"), F.col("local").alias("raw")),
        F.struct(F.lit(False).alias("is_local"), F.col("remote").alias("raw")),
    )
    x = ledger.select(*g, F.explode(sides).alias("s")).select(*g, "s.is_local", "s.raw")
    x = x.select(*g, "is_local", F.when(is_valid_version("raw"), js_trim_col("raw")).alias("v"))
    per_v = x.groupBy(*g, "v").agg(
        F.max(F.col("is_local").cast("int")).alias("in_l"), F.max((~F.col("is_local")).cast("int")).alias("in_r"))
    key = version_key("v")
    return per_v.groupBy(*g).agg(
        F.max(F.when(F.col("v").isNotNull() & (F.col("in_l") == 1), key))["v"].alias("latest_local"),
        F.max(F.when(F.col("v").isNotNull() & (F.col("in_r") == 1), key))["v"].alias("latest_remote"),
        F.max(F.when(F.col("v").isNotNull() & (F.col("in_l") == 1) & (F.col("in_r") == 1), key))["v"].alias("latest_aligned"),
    )


def sync_gate(align: DataFrame, force: bool = False) -> DataFrame:
    """``ok`` when latest local equals latest remote (or forced); ``empty`` when nothing is known."""
    st = (
        F.when(F.col("latest_local").isNull() & F.col("latest_remote").isNull(), "empty")
        .when(F.lit(force) | F.col("latest_local").eqNullSafe(F.col("latest_remote")), "ok")
        .otherwise("blocked")
    )
    return align.withColumn("gate_status", st)


def resolve_cutoff(argument: Column, linked: Column, env_config: Column, config: Column) -> Column:
    """First usable of argument, ledger's latest common version, per-env config, config.

    Returns ``struct(value, source)``; invalid config values are skipped.
    """
    arg = js_trim_col(argument)
    envc = js_trim_col(env_config)
    conf = js_trim_col(config)
    return (
        F.when(arg.isNotNull() & (arg != ""), F.struct(arg.alias("value"), F.lit("argument").alias("source")))
        .when(linked.isNotNull(), F.struct(linked.alias("value"), F.lit("linked").alias("source")))
        .when(envc.rlike(r"^[0-9]+\z"), F.struct(envc.alias("value"), F.lit("config").alias("source")))
        .when(conf.rlike(r"^[0-9]+\z"), F.struct(conf.alias("value"), F.lit("config").alias("source")))
    )
