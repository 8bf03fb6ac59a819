"""Long lists of patterns and literals, against one test or replacement after the other."""

import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sqlfold.functions.redaction import Redactor, redact_list, slices
from sqlfold.functions.text import redact
from sqlfold.operators import queue


def _in_turn(text, literals, marker="[REDACTED]"):
    for s in literals:
        text = text.replace(s, marker) if s else text
    return text


_piece = st.text(alphabet="abREDACT[]", max_size=4)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="abREDACT[]", max_size=30), st.lists(_piece, max_size=12))
def test_literals_equal_replacement_in_turn(text, literals):
    assert Redactor(literals)(text) == _in_turn(text, literals)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab*", max_size=20), st.lists(st.text(alphabet="ab*", max_size=3), max_size=6), st.sampled_from(["*", "**", "a*a", "ab"]))
def test_any_replacement(text, literals, marker):
    assert Redactor(literals, marker)(text) == _in_turn(text, literals, marker)


def test_ten_thousand_literals(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef[]") for _ in range(r.randint(3, 6)))
    secrets = [word() for _ in range(10_000)] + [None, "", "ED]a"]
    texts = [None, "", *(" ".join(word() for _ in range(40)) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    got = {x["i"]: x["t"] for x in df.select("i", redact_list("text", secrets).alias("t")).collect()}
    assert got == {i: None if t is None else _in_turn(t, secrets) for i, t in enumerate(texts)}
    few = secrets[:40]
    same = df.select((redact_list("text", few).eqNullSafe(redact("text", F.array(*[F.lit(s) for s in few])))).alias("same")).collect()
    assert all(x["same"] for x in same)


def test_slices_run_one_after_the_other():
    literals = ["abc", None, "b", "c" * 50, "ac", ""]
    pieces = slices(literals, 4)
    assert [s for p in pieces for s in p] == literals and [len(p) for p in pieces] == [3, 1, 2]
    text = "xabcbacc" + "c" * 60
    for p in pieces:
        want = _in_turn(text, p)
        text = Redactor(p)(text)
        assert text == want


def test_trie_equals_patterns_in_turn():
    r = random.Random(5)
    seg = lambda stars: "".join(r.choice("ab." + "*" * stars) for _ in range(r.randint(1, 3)))
    patterns = [(n + 1, r.choice(["", "./"]) + "/".join(seg(r.choice((0, 1, 3))) for _ in range(r.randint(1, 3)))) for n in range(400)]
    r.shuffle(patterns)
    trie = queue.PatternTrie(patterns)
    rx = [(n, re.compile(queue._path_regex(p)[1:-1])) for n, p in patterns]
    paths = ["", "/", "a//b", "a\nb", *("/".join(seg(0) for _ in range(r.randint(1, 4))) for _ in range(2000))]
    hits = [trie.first(p) for p in paths]
    assert hits == [min((n for n, x in rx if x.fullmatch(p)), default=None) for p in paths]
    assert any(hits) and None in hits


def test_ten_thousand_patterns(spark, monkeypatch):
    patterns = [f"dir{i}/*.sql" for i in range(9_990)] + ["dir*/z?.sql", "*/a*.sql", "*"]
    files = spark.createDataFrame([("dir7/b.sql",), ("dir9989/a.sql",), ("other/ab.sql",), ("top",), ("none/x.txt",), ("dir7/b.sql",), (None,), ("x/z?.sql",)], "path string")
    got = [(r["queue_no"], r["pattern_no"], r["path"]) for r in queue.load_queue(files, patterns).orderBy("queue_no").collect()]
    assert got == [(1, 8, "dir7/b.sql"), (2, 9990, "dir9989/a.sql"), (3, 9992, "other/ab.sql"), (4, 9993, "top")]
    some = ["*/a*.sql", "dir*/*", "*"]
    native = queue.load_queue(files, queue.patterns_table(spark, some)).collect()
    monkeypatch.setattr(queue, "NATIVE_PATTERNS", 0)
    assert sorted(native) == sorted(queue.load_queue(files, some).collect())
