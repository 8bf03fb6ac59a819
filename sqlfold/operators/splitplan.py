"""Split plans for mixed scripts: kinds, runs, transaction wrappers, renumbering."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.text import js_trim_col, normalize_statement, strip_version_prefix, wrap_transaction
from .evidence import mask, statement_kind
from .ledger import version_key
from .scan import fold_lines, ordinal


class KindFold:
    """W3 + W4 as a line fold: forward-fill unknown kinds, count runs of equal kind."""

    initial = None
    syncs = False
    candidates = (None, "schema", "data")

    def feed(self, state, kind):
        filled = kind if kind else (state if state else "schema")
        return filled, (filled, state is None or filled != state)


class _RunCounters:
    zero = staticmethod(lambda: 0)
    origin = staticmethod(lambda: 0)
    delta = staticmethod(lambda out: 1 if out[1] else 0)
    add = staticmethod(lambda a, d: a + d)
    chain = staticmethod(lambda a, d: a + d)


def kind_runs(df: DataFrame, group_cols: Sequence[str], order_col: str, kind_col: str = "kind",
              num_partitions: int | None = None) -> DataFrame:
    """``filled_kind`` and ``segment_no`` (1-based) per row.

    Runs as a partition-parallel fold (all three entry states are speculated, so it is always
    one pass) that hands on whole rows: rows of equal order key stay rows of their own, and a
    group holding a third of all rows is still spread over many tasks.
    """
    g = list(group_cols)
    schema = T.StructType(df.schema.fields + [T.StructField("filled_kind", T.StringType()), T.StructField("segment_no", T.LongType())])
    own = [c for c in df.columns if c not in (*g, order_col, kind_col)]

    def emit(key, row, before, out, cnt):
        filled, new = out
        values = dict(zip([*g, order_col, kind_col, *own], row))
        return [[*(values[c] for c in df_columns), filled, cnt + (1 if new else 0)]]

    df_columns = df.columns
    return fold_lines(df, g, order_col, kind_col, KindFold, _RunCounters, emit, schema, num_partitions, payload=own)


def segment_bodies(runs: DataFrame, group_cols: Sequence[str], order_col: str, text_col: str,
                   sep: str = "\n\n") -> DataFrame:
    """Statements of each run joined in order (a run is one output script)."""
    g = list(group_cols)
    parts = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    return runs.groupBy(*g, "segment_no").agg(
        F.first("filled_kind").alias("kind"),
        F.count(F.lit(1)).alias("n_statements"),
        F.min(order_col).alias("first_no"),
        F.max(order_col).alias("last_no"),
        F.array_join(F.transform(parts, lambda s: s["t"]), sep).alias("content"),
    )


# The statements that open, commit and undo a transaction, normalised.
_BEGIN, _COMMIT, _ROLLBACK = ([w, f"{w};", f"{w} transaction", f"{w} transaction;"] for w in ("begin", "commit", "rollback"))


def transaction_check(stmts: DataFrame, group_cols: Sequence[str], order_col: str = "stmt_no",
                      text_col: str = "statement") -> DataFrame:
    """per script, whether it is wrapped in one BEGIN ... COMMIT, or why it can't be split."""
    g = list(group_cols)
    n = F.col("_norm") if "_norm" in stmts.columns else normalize_statement(mask(F.col(text_col)))
    s = stmts.withColumn("_n", n)
    begin, commit, rollback = (F.col("_n").isin(words) for words in (_BEGIN, _COMMIT, _ROLLBACK))
    s = s.withColumn("_b", begin).withColumn("_c", commit).withColumn("_r", rollback)
    a = s.groupBy(*g).agg(
        F.min_by("_b", order_col).alias("first_begin"),
        F.max_by("_c", order_col).alias("last_commit"),
        F.count_if("_r").alias("n_rollback"),
        F.count_if("_b").alias("n_begin"),
        F.count_if("_c").alias("n_commit"),
        F.count(F.lit(1)).alias("n_statements"),
    )
    err = (
        F.when(F.col("n_rollback") > 0, "top-level ROLLBACK")
        .when(F.col("first_begin") != F.col("last_commit"), "unbalanced BEGIN/COMMIT")
        .when(~F.col("first_begin") & ((F.col("n_begin") + F.col("n_commit")) > 0), "transaction statements inside the script")
        .when(F.col("first_begin") & ((F.col("n_begin") > 1) | (F.col("n_commit") > 1)), "nested BEGIN/COMMIT")
    )
    return a.withColumn("wrapped", F.col("first_begin") & err.isNull()).withColumn("tx_error", err)


def number_key(v) -> F.Column:
    """Order of digit strings by value, whatever their length and leading zeros (W5; O2 keeps its own order)."""
    digits = F.regexp_replace(js_trim_col(v), r"^0+(?=[0-9])", "")
    return F.struct(F.length(digits).alias("len"), digits.alias("v"))


def renumber(outputs: DataFrame, corpus_cols: Sequence[str], targets_earliest: DataFrame,
             version_col: str = "version", name_col: str = "name", out_col: str = "segment_no",
             suffix_col: str = "suffix") -> DataFrame:
    """Every output from the earliest target version on gets ``earliest + position - 1``.

    ``outputs``: one row per planned output script (source version/name, segment).
    ``targets_earliest``: per corpus, column ``earliest`` (digits). Versions compare by value: position is a
    skew-safe ordinal in (version, name, segment) order; numbers are decimals of 38 digits.
    """
    c = list(corpus_cols)
    o = outputs.join(targets_earliest, c).withColumn("_key", number_key(version_col))
    o = o.filter(F.col("_key") >= number_key(F.col("earliest").cast("string")))
    o = o.withColumns({"_len": F.col("_key.len"), "_digits": F.col("_key.v")}).drop("_key")
    o = ordinal(o, c, ["_len", "_digits", name_col, out_col], "_pos")
    nv = (F.col("earliest").cast("decimal(38,0)") + F.col("_pos") - 1).cast("decimal(38,0)").cast("string")
    return o.withColumn("new_version", nv).withColumn(
        "new_name", F.concat(F.col("new_version"), F.lit("_"), F.col(suffix_col))
    ).drop("_len", "_digits", "_pos")


def changes_by_source(renumbered: DataFrame, corpus_cols: Sequence[str], source_col: str = "name",
                      kind_col: str = "kind", version_col: str = "version") -> DataFrame:
    """Before -> after names per source script; ``split`` if any of its outputs is a split;
    ``change_no`` numbers a corpus's changes by version (by value), then name."""
    c = list(corpus_cols)
    names = F.sort_array(F.collect_list(F.struct(F.col("new_version").cast("decimal(38,0)").alias("v"),
                                                 F.col("new_name").alias("n"))))
    per = renumbered.groupBy(*c, source_col).agg(
        F.transform(names, lambda s: s["n"]).alias("after_names"),
        F.when(F.max((F.col(kind_col) == "split").cast("int")) == 1, "split").otherwise("renumber").alias("kind"),
        F.min(number_key(version_col)).alias("_key"),
    )
    per = per.withColumns({"_len": F.col("_key.len"), "_digits": F.col("_key.v")}).drop("_key")
    return ordinal(per, c, ["_len", "_digits", source_col], "change_no").drop("_len", "_digits")


def blocked_by_remote(touched: DataFrame, remote_versions: DataFrame, corpus_cols: Sequence[str],
                      version_col: str = "version") -> DataFrame:
    """Touched scripts whose version is already applied remotely (must be empty to apply)."""
    c = list(corpus_cols)
    return touched.join(remote_versions.select(*c, F.col("remote").alias(version_col)), c + [version_col], "left_semi")


def missing_requests(requested: DataFrame, scripts: DataFrame, corpus_cols: Sequence[str], name_col: str = "name") -> DataFrame:
    """Requested script names not present in the corpus."""
    c = list(corpus_cols)
    return requested.join(scripts.select(*c, name_col), c + [name_col], "left_anti")


def class_lookup(names: DataFrame, audit: DataFrame, corpus_cols: Sequence[str], name_col: str = "name") -> DataFrame:
    """Classification by name, ``unknown`` when the audit has no row."""
    c = list(corpus_cols)
    found = names.join(audit.select(*c, name_col, "classification"), c + [name_col], "left")
    return found.withColumn("classification", F.coalesce("classification", F.lit("unknown")))


def split_plan(scripts: DataFrame, targets: DataFrame, corpus_cols: Sequence[str] = ("corpus_id",)) -> DataFrame:
    """End-to-end plan for splitting the target scripts of each corpus.

    ``scripts``: corpus cols, name, version, text. ``targets``: corpus cols, name; a name given
    twice is one target. Returns one row per output: source name, kind (split/renumber),
    new version, new name and content. A target that can't be split is one row without
    content whose ``error`` says why: not in the corpus (J6; it has no number), transaction
    statements in the way (F12), nothing to separate. A plan with any error is not to be applied.
    """
    from ..session import materialize
    from .statements import script_statements

    c = list(corpus_cols)
    asked = targets.select(*c, "name").distinct()
    known = scripts.select(*c, "name", "version", "text").join(asked.withColumn("_t", F.lit(True)), c + ["name"], "left")
    # four branches read the scripts: they are matched with the targets once
    known = materialize(known.withColumn("_t", F.coalesce("_t", F.lit(False))))
    earliest = known.filter("_t").groupBy(*c).agg(F.min(number_key("version"))["v"].alias("earliest"))

    # statements come from a Python split; pin them (and their kinds) once for the branches below
    st = script_statements(known.filter("_t").drop("_t"), "text").drop("text").withColumn("_masked", mask(F.col("statement")))
    st = materialize(st.withColumn("kind", statement_kind(F.col("_masked"))).withColumn("_norm", normalize_statement(F.col("_masked"))).drop("_masked"))
    tx = transaction_check(st, c + ["name"]).select(*c, "name", "wrapped", "tx_error", F.col("n_statements").alias("_last"))
    core = st.join(tx, c + ["name"]).filter(F.col("tx_error").isNull())
    core = core.filter(~(F.col("wrapped") & F.col("stmt_no").isin(F.lit(1), F.col("_last"))))
    # one shuffle: the windows and the grouping share the script
    w = Window.partitionBy(*c, "name").orderBy("stmt_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    core = core.withColumn("filled", F.coalesce(F.last("kind", ignorenulls=True).over(upto), F.lit("schema")))
    core = core.withColumn("_new", (~F.col("filled").eqNullSafe(F.lag("filled").over(w))).cast("int"))
    core = core.withColumn("segment_no", F.sum("_new").over(upto))
    core = core.withColumn("n_segments", F.max("segment_no").over(Window.partitionBy(*c, "name"))).filter("n_segments > 1")
    bodies = core.groupBy(*c, "name", "version", "wrapped", "segment_no", "n_segments").agg(
        F.first("filled").alias("seg_kind"),
        F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stmt_no", "statement"))), lambda s: s["statement"]), "\n\n"), F.lit("\n")).alias("body"),
    )
    bodies = materialize(bodies)  # for the outputs, and for what has none
    base = F.regexp_replace(strip_version_prefix("name"), r"(?i)\.sql$", "")
    columns = [*c, "name", "version", "segment_no", "n_segments", "kind", "suffix", "content", "error"]
    none = F.lit(None).cast("string")
    split_out = bodies.select(
        *c, "name", "version", "segment_no", "n_segments", F.lit("split").alias("kind"),
        F.concat(base, F.lit("_"), F.col("seg_kind"), F.lit("_"), F.col("segment_no").cast("string"), F.lit(".sql")).alias("suffix"),
        wrap_transaction("body", "wrapped").alias("content"), none.alias("error"),
    )
    failed = known.filter("_t").join(bodies.select(*c, "name").distinct(), c + ["name"], "left_anti").join(tx, c + ["name"], "left")
    failed = failed.withColumns({
        "segment_no": F.lit(1).cast("long"), "n_segments": F.lit(None).cast("long"), "kind": F.lit("split"), "suffix": strip_version_prefix("name"), "content": none,
        "error": F.coalesce("tx_error", F.lit("no separable schema/data groups"))}).select(columns)
    others = known.filter(~F.col("_t")).withColumns({
        "segment_no": F.lit(1).cast("long"), "n_segments": F.lit(None).cast("long"), "kind": F.lit("renumber"), "suffix": strip_version_prefix("name"),
        "content": F.col("text"), "error": none}).select(columns)
    plan = renumber(split_out.unionByName(failed).unionByName(others), c, earliest)
    plan = plan.select(*columns, "new_version", "new_name")
    lost = missing_requests(asked, scripts, c)
    return plan.unionByName(lost.select(*c, "name", F.lit("split").alias("kind"), F.lit("script not found").alias("error")), allowMissingColumns=True)


def split_scope(audit_df: DataFrame, cutoff: str | None = None, scope: str = "cutoff",
                version_col: str = "version") -> DataFrame:
    """Mixed scripts to split -- all of them (``scope='all'``) or only those after the cutoff."""
    if scope not in ("cutoff", "all"):
        raise ValueError("scope is 'cutoff' or 'all'")
    mixed = audit_df.filter(F.col("classification") == "mixed")
    if scope == "all":
        return mixed
    if cutoff is None:
        raise ValueError("a cutoff is needed for scope='cutoff'")
    return mixed.filter(version_key(version_col) > version_key(F.lit(cutoff)))
