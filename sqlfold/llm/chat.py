"""Chat formatting in budgeted windows.

Prefix sums of turn tokens put a grid over a conversation, of half the tokens that its
system turn leaves of the budget; a span is the run of turns that start in one cell of the
grid, so it ends at turn ends and, as long as no turn is above the grid's cell, fits the
budget together with the system turn. Each window is: the
conversation's system turn, turns before the span as far as ``history`` tokens and what
the budget leaves allow, the span. The loss mask covers the assistant turns of the span
only; what is repeated is masked.

Template: ``<turn ROLE>`` + line end + text + ``</turn>`` + line end. In roles and texts a
backslash goes before each backslash, ``<`` and ``>``, so neither can hold a mark.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common, packing

_ESCAPED = re.compile(r"([\\<>])")
_PLAIN = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>\n((?:[^\\<>]|\\.)*+)</turn>\n", re.DOTALL)


def escape(s: str) -> str:
    return _ESCAPED.sub(r"\\\1", s)


def unescape(s: str) -> str:
    return _PLAIN.sub(r"\1", s)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window; raises if anything else is in it."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _count_tokens(vocabulary: str, ranks: str):
    def run(batches):
        codes = packing.encoder(vocabulary, ranks)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes: list[int] = []
            for lo in range(0, len(texts), 500):
                sizes += [len(ids) // 4 for ids in codes.encode(texts.slice(lo, 500).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return run


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, least: tuple[str, Column] | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same ``keys``; and
    ``least`` (a name and an expression): its smallest value among the rows of the same ``keys``.

    Rows are dealt by ranges of keys and order, so one key may fill many partitions; each
    sums its own rows, and the partitions' totals (one row per key and partition) are summed
    apart. The dealt rows are staged, for both passes to see the same partitions. Rows that
    ``order`` does not tell apart must be equal.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_part", F.spark_partition_id())
    dealt = common.stage(dealt, "ranges")
    more = [] if least is None else [F.min(least[1]).alias("_least")]
    totals = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_all"), *more)
    lower = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_part").alias("_t_part"), F.coalesce(F.sum("_all").over(lower), F.lit(0)).alias("_below"), *[F.min("_least").over(Window.partitionBy(*keys)).alias("_least") for _ in more])
    match = F.col("_part") == F.col("_t_part")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    earlier = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(totals, match).withColumn(name, F.col("_below") + F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return (joined.withColumn(least[0], F.col("_least")) if least else joined).drop(*totals.columns, "_part")


def _write(batches):
    """Windows from their turns: text, loss mask, and how many turns are repeated."""
    for pdf in batches:
        texts, masks, repeated, tokens = [], [], [], []
        for turns in pdf["turns"]:
            parts, mask, at = [], [], 0
            for t in turns:
                head, body = f"<turn {escape(t['role'])}>\n", escape(t["text"])
                if t["new"] and t["role"] == "assistant":
                    mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts.append(head + body + "</turn>\n")
                at += len(parts[-1])
            texts.append("".join(parts))
            masks.append(mask)
            repeated.append(sum(not t["new"] for t in turns))
            tokens.append(sum(t["tokens"] for t in turns))
        yield pd.DataFrame({"conv": pdf["conv"], "span": pdf["span"], "text": texts, "loss": masks, "repeated": repeated, "tokens": tokens})


def windows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, budget: int = 1024, history: int = 256, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(conv, span, text, loss, repeated, tokens): one row per window.

    ``loss`` lists the (start, end) code points of ``text`` that train; ``repeated`` counts the
    turns at the window's start that earlier windows hold (the system turn, then history);
    ``tokens`` counts the tokens of roles and texts as given, without marks. Each turn
    is new in exactly one window. Turns go by ``turn_col`` (null first), ties by role and
    text; rows that repeat a turn are turns each. Null roles and texts are empty; null
    conversations are one conversation. The system turn is the first turn, if its role is
    system and it is below the budget; every later window repeats it, but those whose new turns
    leave no room for it (they have a turn above half of what it leaves of the budget). A window
    is above ``budget`` only if it has a turn above half of it; such a window repeats nothing.
    ``vocabulary`` (a tokenizers
    file) and ``ranks`` (the same as ranks) are byte_bpe_50k by default. An empty table gives no window.
    """
    common.session(df)
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    # the id travels as text: null-safe, and whatever its type
    kind = df.schema[conv_col].dataType.simpleString()
    given = df.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("counted", F.concat_ws("\n", "role", "text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    # dealing by ranges reads its input twice, so it is given counts, not the counting
    counted = common.stage(given.mapInArrow(_count_tokens(vocabulary, ranks), f"{fields}, tokens long"), "chat-tokens")
    # the first turn in order; its text matters for ties of system turns only
    opening = F.struct("turn", "role", F.when(F.col("role") == "system", F.col("text")).alias("text"), "tokens")
    turns = prefix_sums(counted, ["conv"], ["turn", "role", "text"], "tokens", "start", ("opening", opening))
    common.unstage(counted)
    # the grid leaves room for the system turn and begins after it
    fixed = F.when((F.col("opening.role") == "system") & (F.col("opening.tokens") < budget), F.col("opening.tokens")).otherwise(F.lit(0))
    grid = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("fixed")) / 2))
    turns = turns.withColumn("fixed", fixed).withColumn("span", F.floor(F.greatest(F.lit(0), F.col("start") - F.col("fixed")) / grid)).drop("opening", "fixed")
    # each turn has a token at least but an empty one; its place among equal starts is its order
    place = F.struct(F.col("start"), F.col("turn"), F.col("role"), F.col("text"))

    spans = turns.groupBy("conv", "span").agg(F.min("start").alias("first"), F.sum("tokens").alias("own"))
    ahead = Window.partitionBy("conv").orderBy("span")
    spans = spans.withColumn("is_first", F.row_number().over(ahead) == 1).withColumn("next_span", F.lead("span").over(ahead)).withColumn("next_first", F.lead("first").over(ahead)).withColumn("next_own", F.lead("own").over(ahead))
    # the first turn is the only one with nothing before it but empty ones
    first = turns.where("start = 0").groupBy("conv").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("t"))
    system = first.where(F.col("t.role") == "system").where(F.col("t.tokens") < budget).select(F.col("conv").alias("s_conv"), F.col("t").alias("system"))
    spans = spans.join(system, F.col("conv").eqNullSafe(F.col("s_conv")), "left").drop("s_conv")
    spans = spans.withColumn("system_tokens", F.coalesce(F.col("system.tokens"), F.lit(0)))

    # a span that has no room for the system turn still has its history
    beside = F.when(F.col("next_own") + F.col("system_tokens") <= budget, F.col("system_tokens")).otherwise(F.lit(0))
    keyed = spans.select(F.col("conv").alias("k_conv"), F.col("span").alias("k_span"), "next_span", "next_first", F.least(F.lit(history), F.lit(budget) - F.col("next_own") - beside).alias("room"), "system_tokens")
    both = turns.join(keyed, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("span") == F.col("k_span")))
    # a turn is history of the next span if it and all between fit the room; the system turn is there anyway
    again = (F.col("next_first") - F.col("start") <= F.col("room")) & (F.col("start") >= F.col("system_tokens"))
    turn = lambda new: F.struct(F.lit(1).alias("rank"), place.alias("place"), F.col("role").alias("role"), F.col("text").alias("text"), F.col("tokens").alias("tokens"), F.lit(new).alias("new"))
    members = both.select("conv", F.explode(F.array(F.struct(F.col("span"), turn(True).alias("t")), F.when(again, F.struct(F.col("next_span").alias("span"), turn(False).alias("t"))))).alias("m")).where("m is not null").select("conv", "m.span", "m.t")
    lead = F.struct(F.lit(0).cast("long").alias("start"), F.col("system.turn").alias("turn"), F.col("system.role").alias("role"), F.col("system.text").alias("text"))
    repeat = spans.where(~F.col("is_first") & F.col("system").isNotNull() & (F.col("own") + F.col("system_tokens") <= budget))
    repeat = repeat.select("conv", "span", F.struct(F.lit(0).alias("rank"), lead.alias("place"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"), F.lit(False).alias("new")).alias("t"))
    filled = members.unionByName(repeat).groupBy("conv", "span").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    filled = filled.select("conv", "span", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), t["new"].alias("new"))).alias("turns"))
    out = filled.mapInPandas(_write, "conv string, span long, text string, loss array<struct<start:long,end:long>>, repeated long, tokens long")
    return out.withColumn("conv", F.col("conv").cast(kind))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from
    the windows alone. Windows come sorted by conversation and span, and go through running
    hashes: a conversation is never held as a whole."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, n, turns, loss, chars, size = None, 0, None, None, 0, 0
        for pdf in batches:
            out = []
            for key, span, text, mask, repeated in zip(pdf["key"], pdf["span"], pdf["text"], pdf["loss"], pdf["repeated"]):
                if key != now:
                    if now is not None:
                        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    now, n, turns, loss, chars, size = key, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, said in read_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for m in mask:
                    trained = unescape(text[m["start"] : m["end"]])
                    loss.update(trained.encode())
                    chars += len(trained)
                size += len(text)
            yield pd.DataFrame(out, columns=["key", *names[1:]])
        if now is not None:
            yield pd.DataFrame([(now, n, turns.hexdigest(), chars, loss.hexdigest(), size)], columns=["key", *names[1:]])

    kind = formatted.schema["conv"].dataType.simpleString()
    # a null conversation is told from any text by the letter in front
    keyed = formatted.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    dealt = keyed.select("key", "span", "text", "loss", "repeated").repartition("key").sortWithinPartitions("key", "span")
    found = dealt.mapInPandas(run, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.select(F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias("conv"), *names[1:])
