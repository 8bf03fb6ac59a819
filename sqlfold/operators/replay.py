"""Cutoff phases, replay plans, snapshot + replay over rows and the reset summary."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import CLASS_ORDER, class_phrase, deploy_date, deploy_date_short
from .ledger import version_key


def phase(version, cutoff) -> Column:
    """``pre`` when version <= cutoff in (length, text) order, else ``post``."""
    return F.when(version_key(version) <= version_key(cutoff), "pre").otherwise("post")


def replay_action(phase_col, classification) -> Column:
    """R2: pre-cutoff data scripts are skipped (the snapshot holds them), other pre-cutoff
    scripts rebuild the structure, post-cutoff scripts are replayed."""
    return (
        F.when((phase_col == "pre") & (classification == "data"), "skip")
        .when(phase_col == "pre", "rebuild")
        .otherwise("replay")
    )


def mixed_policy(phase_col, classification, strict: bool = False) -> Column:
    """mixed scripts after the cutoff must be split; before it they only warn (strict: both fail)."""
    mixed = classification == "mixed"
    if strict:
        return F.when(mixed, "fail").otherwise("ok")
    return F.when(mixed & (phase_col == "post"), "needs_split").when(mixed, "warn").otherwise("ok")


def phase_grid(df: DataFrame, group_cols: Sequence[str], phase_col: str = "phase",
               class_col: str = "classification") -> DataFrame:
    """A4: counts per (group, phase) for the fixed class list, plus the total.

    One conditional aggregation (the class list is fixed, so no pivot pass is needed).
    """
    g = list(group_cols)
    c = F.col(class_col)
    return df.groupBy(*g, phase_col).agg(
        *[F.count_if(c == k).alias(k) for k in CLASS_ORDER], F.count(F.lit(1)).alias("total"))


def summary_row(df: DataFrame, group_cols: Sequence[str], cutoff, phase_col: str = "phase",
                class_col: str = "classification") -> DataFrame:
    """One summary row per group (pre/post totals, per-class phrases, X11 date), from the
    classified rows in a single aggregation."""
    g = list(group_cols)
    c, ph = F.col(class_col), F.col(phase_col)
    aggs = [F.count_if((ph == p) & (c == k)).alias(f"{p}_{k}") for p in ("pre", "post") for k in CLASS_ORDER]
    aggs += [F.count_if(ph == "pre").alias("pre_total"), F.count_if(ph == "post").alias("post_total")]
    j = df.groupBy(*g).agg(*aggs)
    pre_c = {k: F.col("pre_" + k) for k in CLASS_ORDER}
    post_c = {k: F.col("post_" + k) for k in CLASS_ORDER}
    return j.select(
        *g,
        deploy_date(cutoff).alias("last_deploy"),
        "pre_total",
        "post_total",
        class_phrase(pre_c, ["schema", "mixed", "unknown"]).alias("ran_during_rebuild"),
        class_phrase(pre_c, ["data"]).alias("skipped_in_snapshot"),
        class_phrase(post_c).alias("applied_after"),
        F.concat(F.lit("≤ "), deploy_date_short(cutoff)).alias("pre_label"),
    )


def snapshot_replay(snapshot: DataFrame, changes: DataFrame, key_cols: Sequence[str], version_col: str,
                    cutoff: str, delete_col: str | None = None, tie_cols: Sequence[str] = ()) -> DataFrame:
    """state = snapshot at the cutoff, plus changes after the cutoff applied in version order.

    Changes at or before the cutoff are ignored (the snapshot already holds them);
    the last change per key wins; a winning delete removes the key. Runs as one
    partial aggregation (``max_by``), so a hot key is combined map-side.
    """
    k = list(key_cols)
    cols = [c for c in changes.columns if c not in k]
    after = changes.filter(phase(F.col(version_col), F.lit(cutoff)) == "post")
    base = snapshot.select(*k, *cols)
    both = base.unionByName(after.select(*k, *cols))
    order = F.struct(version_key(version_col), *[F.col(c) for c in tie_cols])
    won = both.groupBy(*k).agg(F.max_by(F.struct(*cols), order).alias("_w")).select(*k, "_w.*")
    if delete_col:
        won = won.filter(~F.col(delete_col)).drop(delete_col)
    return won


def plan_replay(scripts: DataFrame, group_cols: Sequence[str], cutoff, version_col: str = "version",
                class_col: str = "classification", tie_cols: Sequence[str] = (), name_col: str | None = None,
                strict: bool = False) -> DataFrame:
    """R2 end to end: phase, action, mixed-script policy, replay order and no-op stubs.

    Post-cutoff scripts are replayed in (version, ties) order, numbered per group with
    the skew-safe ordinal; skipped data scripts get the X16 stub text when
    ``name_col`` is given.
    """
    from ..functions.text import noop_stub
    from .scan import ordinal

    g = list(group_cols)
    cut = cutoff if not isinstance(cutoff, str) else F.lit(cutoff)
    e = scripts.withColumn("phase", phase(F.col(version_col), cut))
    e = e.withColumn("action", replay_action(F.col("phase"), F.col(class_col)))
    e = e.withColumn("policy_status", mixed_policy(F.col("phase"), F.col(class_col), strict))
    post = e.filter(F.col("action") == "replay").withColumn("_vlen", F.length(version_col))
    post = ordinal(post, g, ["_vlen", version_col, *tie_cols], "replay_seq").drop("_vlen")
    pre = e.filter(F.col("action") != "replay").withColumn("replay_seq", F.lit(None).cast("long"))
    out = post.unionByName(pre)
    if name_col:
        out = out.withColumn("stub", F.when(F.col("action") == "skip", noop_stub(F.col(name_col), cut)))
    return out
