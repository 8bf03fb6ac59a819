"""Operators on single texts: pages, conversations, quality, personal data; and the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlfold.llm import chat, html_text, mixing, pii, quality, queries

SF = "/root/testdata/sf0.001"


# --- pages ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>One<p>Two<div>three</div>", "One\n\nTwo\n\nthree"),
        ("a <b> b</b>\n\tc&amp;d &lt;i&gt;", "a b c&d <i>"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<table><tr><th>Name<th>n<tr><td>pear<td>10</table>", "Name  n\npear  10"),
        ("<table><tr><td colspan=2>a wide one<td>x<tr><td>b<td>c<td>d</table>", "a wide one  x\nb  c  d"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
        ("<head><title>t</title><style>s</style></head><body>b<script>if (a</p>b) x</script>c", "bc"),
        ("a<!-- no -- > --><span hidden>n</span><i style='display:none'>n</i>b", "ab"),
        ("<p style='visibility:hidden'>no<b style='visibility: visible'>yes</b></p>", "yes"),
        ("<details><summary>s</summary>no<p>no</details>z", "s\nz"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
        ("<blockquote>q</blockquote>r", "    q\n\nr"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("a < b > c <3", "a < b > c <3"),
        ('<a title="x>y" href=z>t</a> <p', "t"),
        ("</p></div></table>x</td>", "x"),
        ("<h1>a<h2>b</h3>c", "a\n\nb\n\nc"),
        ("<textarea>\n k &amp;\n l</textarea>", " k &\n l"),
        ("<table>lost<tr><td>in</table>out", "lost\n\nin\n\nout"),
        ("", ""),
        ("<html><head><title>t</title><body><p>Hello", "Hello"),
        ("<head><meta charset=utf-8><title>t</title> <noscript><p>n</noscript><p>Hello", "Hello"),
        ("<head><script>s</script> &#32; Hello <b>you</b>", "Hello you"),
        ("<ruby>x<rp>(<rt>y<rp>)</ruby>z", "xyz"),
        ("<p title=it's>Hello <b>world</b> tail", "Hello world tail"),
        ('<a href="x"">link</a> text', "link text"),
        ("""<a ' href=x"y' title = 'a>b'c>link</a> it's "text\"""", """link it's "text\""""),
        ("<p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn><annotation>x=2</annotation></math> be", "Let x=2 be"),
        ("<math><mfrac><mn>1</mn><mrow><mn>2</mn><mi>n</mi></mrow></mfrac><mspace/><mtext>if <b>so</b></mtext></math>.", "1 2nif so."),
        ("a <svg><title>t</title><desc>d</desc><defs><text>no</text></defs><path d='M0'/>no<text>one <tspan>two</tspan></text><text y=3>three</text></svg> b", "a one two three b"),
        ("<svg><style>s</style><title/><g display=none><text>no</text></g><a><text><![CDATA[1 < 2 &amp;]]></text></a><foreignObject><p>in</p></foreignObject></svg>z", "1 < 2 &amp;\n\nin\n\nz"),
        ("<svg><path d=x><p>Hello</p><svg><g></p>there", "Hello\n\nthere"),
        ("<p =\"x>a</p =' ><i style='display:none'\">no</i>b<p title=>c", "a\n\nb\n\nc"),
    ],
)
def test_render(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("bad", ["<" * 3000, '<a "' * 2000, "<div>" * 5000 + "x", "<table><tr><td>" * 800, "<ul><li>" * 1000 + "z", "<!--" * 500, "<script>" * 500, "&" * 500, "<p>" * 3000])
def test_render_takes_anything(bad):
    html_text.render(bad)


def test_pages_keep_every_visible_word(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.op4_html_text(spark, SF).collect()}
    import html

    for r in rows:
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>|<!DOCTYPE[^>]*>", "", r["html"])
        plain = html.unescape(re.sub(r"</?[a-zA-Z][^>]*(>|\Z)", lambda m: "" if re.match(r"</?(a|b)\b", m[0]) else " ", plain))
        want = re.sub(r"[ \t\n\f\r]+", " ", plain).split(" ")
        have = [w for line in got[r["page_id"]].split("\n") for w in re.sub(r"^ *- ", "", line).split(" ")]
        assert [w for w in have if w] == [w for w in want if w]


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "u"), (None, "<p>x", None), (1, "", "v")], "page_id long, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract_text(df, "page_id", "html").collect())
    assert got == [(0, "x"), (1, ""), (1, "")]
    assert html_text.extract_text(df.limit(0), "page_id", "html").collect() == []


# --- conversations -------------------------------------------------------------------------------------


def told(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(1024, 256), (64, 16), (8, 8)])
def test_windows_read_back(spark, budget, history):
    evil = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", evil), (-7, 1, "assistant", evil), (-8, None, None, None), (-8, 0, "assistant", "<turn x>\n\\"), (None, 2, "assistant", "b"), (None, 1, "user", "é"), (None, 1, "user", "é")]
    rows += [(-9, 0, "system", "be brief")] + [(-9, i, "assistant" if i % 2 else "user", "word " * (i * 7 % 40)) for i in range(1, 90)]
    rows += [(-10, i, "user", "") for i in range(5)] + [(-11, 0, "system", "long " * 600), (-11, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1)).repartition(5)
    made = chat.windows(df, "conv_id", "turn", "role", "text", budget=budget, history=history)
    got = {r["conv"]: tuple(r)[1:5] for r in chat.digests(made).collect()}
    assert got == told(rows)
    pdf = made.toPandas()
    for w in pdf[pdf["conv"] == -9].sort_values("span").itertuples():
        turns = chat.read_turns(w.text)
        if w.span and w.tokens <= budget and w.repeated:
            assert turns[0] == ("system", "be brief") or budget == 8
        trained = [chat.unescape(w.text[m["start"] : m["end"]]) for m in w.loss]
        assert trained == [t for r, t in turns[w.repeated :] if r == "assistant"]
    # above the budget only for a turn above half of it
    for w in pdf[pdf["tokens"] > budget].itertuples():
        assert w.repeated == 0


def test_long_system_turn_in_every_window_with_room(spark):
    rows = [(c, 0, "system", "long " * n) for c, n in ((1, 298), (2, 700), (3, 10), (4, 1100))]
    rows += [(c, i, "assistant" if i % 2 else "user", f"word{i} " * (i * 31 % 130)) for c in (1, 2, 3, 4) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = chat.windows(df, "conv_id", "turn", "role", "text")
    assert {r["conv"]: tuple(r)[1:5] for r in chat.digests(found).collect()} == told(rows)
    made = found.toPandas()
    for c, text in ((1, "long " * 298), (2, "long " * 700), (3, "long " * 10)):
        mine = made[made["conv"] == c].sort_values("span")
        system = len(text.split()) + 16
        for w in mine.itertuples():
            has = chat.read_turns(w.text)[0] == ("system", text)
            assert w.tokens <= 1024 and (has or w.tokens > 1024 - system)
            assert c == 2 or has
        assert len(mine) > 3
    assert (made[made["conv"] == 4]["repeated"] > 0).any()


def test_windows_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(df, "conv_id", "turn", "role", "text")).collect() == []


def test_escapes():
    for s in ("", "\\", "<", "</turn>", "\\<", "a\n\\\\>"):
        assert chat.unescape(chat.escape(s)) == s and "</turn>" not in chat.escape(s)
    with pytest.raises(ValueError):
        chat.read_turns("<turn user>\nno end")


def test_prefix_sums_split_a_hot_key(spark):
    rows = [(None if i % 3 else "b", i // 2, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    got = chat.prefix_sums(df, ["k"], ["o", "v"], "v", "before").collect()
    for key in (None, "b"):
        own = sorted((r["o"], r["v"], r["before"]) for r in got if r["k"] == key)
        assert [x[2] for x in own] == [sum(v for _, v, _ in own[:i]) for i in range(len(own))] and len(own) in (100, 200)


# --- quality ----------------------------------------------------------------------------------------------


def test_quality_against_labels(spark):
    """The labels of the table are not used in training: all of them are held out."""
    sf = "/root/testdata/sf0.01"
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text").toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), left_on="id", right_on="doc_id")
    clean = both["quality"] == 1
    assert both["keep"][clean].mean() > 0.99 and both["keep"][~clean].mean() < 0.05
    assert len(got) == 1000


@pytest.mark.parametrize("ids", ["one", "none"])
def test_the_scorer_reads_each_text_once(spark, ids, monkeypatch):
    """An id on most rows, or no ids at all, neither grow the sample nor empty it."""
    read = []
    monkeypatch.setattr(quality, "fit", lambda x, junk: read.append((len(x), int(junk.sum()))) or (np.zeros(quality.DIMENSIONS), 0.0))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    docs = docs.unionByName(docs.limit(300)).unionByName(docs.limit(300))
    quality.train(docs.withColumn("id", F.lit(7 if ids == "one" else None).cast("long")), "id", "text", sample=40)
    assert read == [(80, 40)]


def test_estimate_finds_accuracies():
    r = np.random.default_rng(1)
    n, k = 20_000, 4
    kind = np.where(r.random(n) < 0.2, r.integers(1, k + 1, n), 0)
    votes = []
    for i in range(n):
        rates = [0.85 if kind[i] == j + 1 else 0.3 if kind[i] else 0.001 for j in range(k)]
        votes.append("".join("." if r.random() < 0.1 else "j" if r.random() < p else "c" for p in rates))
    names, many = np.unique(votes, return_counts=True)
    post, table = quality.estimate(list(zip(names.tolist(), many.tolist())))
    called = np.array([post[v] > 0.5 for v in votes])
    assert (called == (kind > 0)).mean() > 0.97
    assert (table[0, :, 0] <= quality._FALSE + 1e-9).all()
    assert quality.estimate([])[0] == {}


@pytest.mark.parametrize("share, junk", [(0.001, 0.58), (0.003, 0.80), (0.01, 0.90), (0.1, 0.98), (0.333, 0.996)])
def test_a_labeller_alone_is_believed(share, junk):
    """The bound of the README: the votes of the other six do not count against one."""
    n = int(100_000 * share)
    post, _ = quality.estimate([("ccccccc", 100_000 - n), ("ccjcccc", n)])
    assert post["ccjcccc"] == pytest.approx(junk, abs=0.005)


def test_statistics_equal_a_plain_count(spark):
    texts = ["A!! AB!! c*** | the the the x", "", None, "one two three one two three", "É" * 20 + " AB1 -- ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in quality.statistics(df, "id", "text").collect():
        w = (texts[r["id"]] or "").split()
        runs = [tuple(w[i : i + 3]).__repr__().lower() for i in range(len(w) - 2)]
        want = {
            "symbol_ends": sum(x[-1] in "*%#$&|~^@<>{}=+_\\/`" for x in w), "bare": sum(not re.search("[0-9A-Za-z\x80-￿]", x) for x in w),
            "capitals": sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w), "shouts": sum("!!" in x for x in w),
            "repeats": sum(a.lower() == b.lower() for a, b in zip(w, w[1:])), "echoes": len(runs) - len(set(runs)), "long_words": sum(len(x.encode()) > 30 for x in w),
        }
        assert r["n_words"] == len(w)
        for k, v in want.items():
            assert r[k] == pytest.approx(v / (len(w) + 8)), (r["id"], k)


def test_quality_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "plain words", 1), (4, "x" * 100_000, None), (4, "a b c d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes int")
    got = quality.classify(df, "doc_id", "text").collect()
    assert sorted((r["id"] or 0, r["keep"]) for r in got) == [(0, True), (1, False), (2, False), (4, True), (4, True)]
    assert quality.classify(df.limit(0), "doc_id", "text").collect() == []


# --- personal data -------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def odd_texts(n):
    r = random.Random(11)
    bits = ["a", "é ", "@", ".", "-", " ", "+", "(", ")", "1", "23", "456", "\n", "\t", "10.0.0.1", "x@y.z", "4041894974608795", "+1 (283) 555-6500", "0" * 20, "  ", "%", "\xa0", "255.256.1.1", "+4"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_base_patterns_equal_the_plain_ones():
    for t in odd_texts(4000):
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_patterns_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1 " * 150_000, "+1" * 100_000, "1." * 150_000, "a." * 100_000 + "@b.c"):
        pii.base_spans(t)


def test_found_in_whole_texts(spark):
    texts = {i: t for i, t in enumerate(odd_texts(400))} | {r["doc_id"] + 1000: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    weights = pii.train(pii._made_up(random.Random(7))[:150], rounds=25)
    for r in pii.find(df, "id", "text", weights).collect():
        base = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base"]]
        every = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"]]
        assert base == plain_spans(texts[r["id"]])
        assert every == sorted(every) and set(base) <= set(every)
        added = [s for s in every if s not in base]
        for (_, a, z), (_, x, y) in itertools.chain(itertools.combinations(added, 2), itertools.product(added, base)):
            assert z <= x or y <= a


def test_decoding_is_the_best_segmentation():
    rng = np.random.default_rng(8)
    for s in ("+1 (2", "12-34 5678", "a1@b2.c 99", "1234 5678"):
        w = rng.normal(size=(len(pii.KINDS), pii.N_FEATURES))
        c = pii.Candidates(s)
        value = (c.x @ w.T).max(axis=1)
        spans = list(zip(c.start, c.end, value))

        def best(at, spans=spans, n=len(c.bounds) - 1):
            if at == n:
                return 0.0
            return max([best(at + 1), *(v + best(j) for i, j, v in spans if i == at)])

        got = pii.decode(s, w)
        at = {(c.bounds[i], c.bounds[j]): v for i, j, v in spans}
        assert sum(at[a, z] for _, a, z in got) == pytest.approx(best(0))


def test_model_on_held_out_entities():
    weights = pii.train(pii._made_up(random.Random(7)))
    right = wrong = missed = 0
    for s, gold in pii._made_up(random.Random(99)):
        got = set(pii.decode(s, weights))
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95
    s = "+1 (269) 555-3296 4524132264652876"  # the patterns drop both
    assert pii.base_spans(s) == [] and pii.decode(s, weights) == [(3, 0, 17), (2, 18, 34)]


def test_words_before_decide_what_a_span_is(spark):
    weights = pii.train(pii._made_up(random.Random(7)) + pii._cued(random.Random(8)))
    held = pii._cued(random.Random(99))
    right = sum(sorted(pii.decode(s, weights, cues)) == sorted(gold) for s, gold, cues in held)
    assert right >= 0.95 * len(held), (right, len(held))
    plain = pii._made_up(random.Random(99))
    gold = {(i, *g) for i, (_, spans) in enumerate(plain) for g in spans}
    got = {(i, *g) for i, (s, _) in enumerate(plain) for g in pii.decode(s, weights)}
    assert len(gold & got) >= 0.93 * len(gold) and len(gold & got) >= 0.93 * len(got), (len(gold), len(got), len(gold & got))
    texts = ["Please call 5551234567 now", "Part 5551234567 is sold out", "call 2024-11-12", "call us in 3 days about part 5551234567"]
    found = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", weights).collect()}
    assert found == {0: [("phone", 12, 22)], 1: [], 2: [], 3: []}


def test_redaction(spark):
    rows = [(1, "é me@x.org, 1.2.3.4!", 20, "k"), (2, None, None, "k"), (3, "", 0, None), (4, "clean", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.redact(df, "doc_id", "text", "n_chars", pii.train(pii._made_up(random.Random(7))[:50], rounds=5)).collect()}
    assert got[1]["text"] == "é [EMAIL], [IP]!" and got[1]["n_chars"] == 16 and got[1]["spans"] == "k"
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "clean"
    assert pii.redact(df.limit(0), "doc_id", "text").collect() == [] and pii.find(df.limit(0), "doc_id", "text").collect() == []
    assert pii.masked("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a[EMAIL]f"


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from sqlfold.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(common.stage(stage(spark, seen[-1], SF), name))
    start, good, single, masked, mixed, packed = (d.toPandas() for d in seen)
    assert all(d.dtypes == docs.dtypes for d in seen[:-1])

    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    gone = set(start["doc_id"]) - set(good["doc_id"])
    assert {d for d in gone if d in labels.index and labels[d] == 1} == set()

    from test_tables import closure, fingerprint, token_ids

    v = np.array([fingerprint(t) for t in good["text"]], np.uint64)
    comp = closure(good["doc_id"].tolist(), np.bitwise_count(v[:, None] ^ v[None, :]) <= 2)
    assert sorted(single["doc_id"]) == sorted(set(comp))

    assert sorted(masked["doc_id"]) == sorted(single["doc_id"])
    assert not any(plain_spans(t) for t in masked["text"])
    assert (masked["n_chars"] == masked["text"].str.len()).all()
    untouched = {i for i, t in zip(single["doc_id"], single["text"]) if not re.search(r"[0-9@]", t)}
    before, after = (dict(zip(d["doc_id"], d["text"])) for d in (single, masked))
    assert all(before[i] == after[i] for i in untouched)

    copies = mixing.mix(seen[3], "doc_id", "text", "source").toPandas()
    assert mixed["doc_id"].value_counts().to_dict() == {i: c for i, c in zip(copies["id"], copies["copies"]) if c}

    words = dict(zip(mixed["doc_id"], mixed["text"]))
    sizes = dict(zip(words, map(len, token_ids(words.values()))))
    assert packed["length"].sum() == sum(sizes[i] for i in mixed["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    run = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run[key].values.tolist())) == sorted(map(tuple, packed[key].values.tolist()))


def test_pipeline_of_nothing(spark):
    import corpus_pipeline
    from sqlfold.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
