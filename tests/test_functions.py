"""Column functions against their definitions in Python, over awkward strings."""

from __future__ import annotations

import html
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import markup, numbers, text
from textmill.operators import chunk, evalkit, fim, pack, rl, sampling, sft

SAMPLES = [
    "", " ", "a", " a b ", " x ", "\x1cx\x1f", "a\r\nb\rc\n", "l1\x0bl2\x0cl3\x85l4 l5 ", "\n", "\n\n", "no end", "end\n", "tab\there", "é ß 𝒳 á", "Python-3 _x", "　wide　",
]
rng = random.Random(1)
SAMPLES += ["".join(rng.choice("ab \n\r\t  \x1c\x85Zé") for _ in range(rng.randint(0, 12))) for _ in range(150)]


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(spark, values, column, kind="string"):
    return [r[1] for r in sorted(table(spark, values, kind).select("i", column.alias("y")).collect())]


@pytest.mark.parametrize(
    ("column", "python"),
    [
        (text.strip, str.strip),
        (text.rstrip, str.rstrip),
        (text.lines, str.splitlines),
        (text.collapse, lambda s: " ".join(s.split())),
        (text.normal_language, lambda s: re.sub(r"[\s_-]+", "", s.strip().lower())),
        (text.clean, str.strip),
    ],
)
def test_as_python_does(spark, column, python):
    assert results(spark, SAMPLES, column("x")) == [python(s) for s in SAMPLES]


def test_nulls(spark):
    assert results(spark, [None], text.clean("x")) == [""]
    assert results(spark, [None], text.collapse("x")) == [""]
    assert results(spark, [None], text.normal_language("x")) == [""]
    assert results(spark, [None, " "], text.first_text("x", F.lit(" b "))) == ["b", "b"]
    assert results(spark, [None, "a"], text.join_fields("x", F.lit("b"))) == ["b", "a\n\nb"]


def test_polynomial_hash(spark):
    def python(s):
        total = 0
        for c in s:
            total = (total * 131 + ord(c)) % (2**31 - 1)
        return total

    words = ["", "a", "source-1", "é𝒳z" * 9]
    assert results(spark, words, text.polynomial_hash("x")) == [python(w) for w in words]


def test_uniform_is_even(spark):
    u = [r[0] for r in spark.range(4000).select(text.uniform("7", F.col("id"), "draw")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02


def test_names(spark):
    assert results(spark, ["train[:100]", "[x]", "test"], text.base_split("x")) == ["train", "[x]", "test"]
    assert results(spark, ["module.module.w", "_orig_mod.w"], text.strip_prefixes("x", ["module.", "_orig_mod."])) == ["module.w", "w"]
    assert results(spark, ["module.module.w"], text.strip_prefixes("x", ["module.", "_orig_mod."], until_stable=True)) == ["w"]
    assert results(spark, ["a b/c", "", None], text.file_name("x")) == ["a_b_c", "default", "default"]
    assert results(spark, ["Yes", "0", "maybe"], text.boolean("x")) == [True, False, None]
    assert results(spark, ["GPT", " prompter ", "", "tool", None], text.normal_role("x")) == ["assistant", "user", "user", "tool", "user"]
    assert results(spark, [["--tasks", "a"], ["--tasks"], []], text.argument("x", "--tasks"), "array<string>") == ["a", None, None]


def test_strip_html(spark):
    pages = ["<p>a &amp; b</p>", "<pre><code>x\n  y</code></pre>z", "use <CODE>f</CODE>", "a\n\n\n\nb", "&#39;&#x41;&eacute;&amp;lt;", "<b", "", "$1 \\1 <code>$2</code>"]

    def python(s):
        s = re.sub(r"<pre><code>(.*?)</code></pre>", r"\n\1\n", s, flags=re.S | re.I)
        s = re.sub(r"<code>(.*?)</code>", r"`\1`", s, flags=re.S | re.I)
        return re.sub(r"\n{3,}", "\n\n", html.unescape(re.sub(r"<[^>]+>", " ", s))).strip()

    assert results(spark, pages, markup.strip_html("x")) == [python(p) for p in pages]


def test_character_references(spark):
    """Every named reference, with and without its semicolon and with more behind it, numbers of all kinds, and mixtures."""
    import html.entities

    r = random.Random(1)
    texts = ["&" + k + end for k in html.entities.html5 for end in ("", "x", ";", "=1")]
    texts += [f"a&#{n}{end}" for n in [*range(300), 0xD800, 0xDFFF, 0x10FFFF, 0x110000, 0x1FFFE, 0xFDD0, 0xFFFE, 10**20] for end in (";", "", " z")]
    texts += [f"&#x{n:x};&#X{n:X}q" for n in (0, 9, 13, 0x80, 0x9F, 0x41, 0x1F600, 0xFFFF, 0x10FFFF, 0x110000)]
    texts += ["".join(r.choice(["&", "amp", "lt", ";", "#", "x", "41", "notit", "not", "in", " ", "&amp;", "<", "é", "frac12", "&copy"]) for _ in range(12)) for _ in range(2000)]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "none", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", markup.unescaped("t").alias("u"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = {texts[x.i]: x.u for x in df.collect() if x.u != (None if texts[x.i] is None else html.unescape(texts[x.i]))}
    assert not wrong


def test_names_that_need_their_semicolon(spark):
    """They alone stay without it; longer names that begin like them, and all others, are decoded."""
    texts = ["&quot", "&quot;", "&quotx;", "&quot=", "&copyright", "&copysr;", "&middot &amp &lt", "&QUOT", "&amp;quot;", "&#34", None]
    assert results(spark, texts, markup.unescaped("x", closed=("copy", "middot", "quot"))) == ["&quot", '"', "&quotx;", "&quot=", "&copyright", "\u2117", "&middot & <", '"', "&quot;", '"', None]
    assert results(spark, texts, markup.unescaped("x")) == [None if x is None else html.unescape(x) for x in texts]


def test_entries_of_deep_and_long_payloads(spark):
    import json

    deep = json.dumps({"a": 1})
    for i in range(50):
        deep = f'{{"k{i}": {deep}, "x": [{i}]}}'
    wide = json.dumps({f"t{i}": {"pass@1": i / 1e6} for i in range(20_000)})
    rows = spark.createDataFrame([(1, deep), (2, wide), (3, "no json"), (4, None), (5, "[]")], "id int, p string")
    found = evalkit.flattened(rows, key="id", payload="p")
    counts = {r["id"]: r["count"] for r in found.groupBy("id").count().collect()}
    assert counts == {1: 151, 2: 40_000}
    last = found.filter("id = 1 AND name = 'a'").first()
    assert list(last["names"]) == [*(f"k{i}" for i in range(49, -1, -1)), "a"] and len(last["places"]) == 51 and last["value"] == "1"
    assert evalkit.task_score(found, "t19999", "pass@1", key="id").collect()[0]["score"] == 0.019999
    evalkit.register_entries(spark)
    rows.createOrReplaceTempView("payloads")
    told = spark.sql("SELECT id, e.* FROM payloads, LATERAL json_entries(p) e WHERE id = 1")
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(map(tuple, found.filter("id = 1").collect()), key=repr)


def test_notebooks(spark):
    book = '{"metadata": {"kernelspec": {"name": "%s"}}, "cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "markdown", "source": "m"}, {"cell_type": "code", "source": "c"}, {"cell_type": "code", "source": " "}, 3, {"cell_type": "code", "source": "[1]"}, {"cell_type": "code"}]}'
    texts = [book % "Python 3", book % "ir", "not json", "[1]", '{"cells": 3}', "", None, '{"metadata": 3, "cells": [{"cell_type": "code", "source": "x"}]}', '{"metadata": {"language_info": {"name": "  "}, "kernelspec": {"language": "R"}}, "cells": []}']
    assert results(spark, texts, markup.processed("x", markup.NOTEBOOK)) == ["a\nb\n\nc\n\n[1]", "", "not json", "", "", "", None, "x", ""]


def test_texts_that_only_begin_as_json_are_no_notebooks(spark):
    import json

    book = '{"metadata": {}, "cells": [{"cell_type": "code", "source": "x"}]%s}'
    damaged = ["8316107434564120 Thanlyan of", "1, 2", "1] 2", '1, "a"] b', "[1] [2]", '"a" b', "null x", "true\xa0", "[1]]", "1 // 2", book % "" + " x", book % "" + book % "", book % "" + "}", book % "]", "{'cells': []}", book % ', "o": [1'[:-1]]
    for x in damaged:
        with pytest.raises(ValueError):
            json.loads(x)
    assert results(spark, damaged, markup.processed("x", markup.NOTEBOOK)) == damaged
    long = '"%s"' % ("y" * 20_000_001)  # longer than the strings that Jackson reads unasked
    whole = ["12", ' "a"\n', "null", "[1]", book % "", f"\n {book % ''}\t\r\n", book % ', "o": [NaN, -Infinity]', book % f', "o": {"[" * 900}{"]" * 900}', book % f', "o": {"9" * 4300}', book % f', "o": {long}']
    assert all(json.loads(x) is not ... for x in whole)
    assert results(spark, whole, markup.processed("x", markup.NOTEBOOK)) == [""] * 4 + ["x"] * 6


def test_questions_and_issues(spark):
    qa, issue = markup.SLOTS["stackexchange_preference_qa"], markup.SLOTS["github_issue_conversation"]
    assert markup.gathered({"question": {"body": "<b>q</b>"}, "answers": [{"text": "a&lt;"}, "", {"body": "b"}, {"other": 1}, "<code>c</code>"]}, qa) == "q\n\na<\n\nb\n\n`c`"
    assert markup.gathered({"answers": {"text": "only"}}, qa) == "only" and markup.gathered({"question": {"x": "y"}, "answers": None}, qa) == "y" and markup.gathered(None, qa) == ""
    assert markup.gathered({"content": " <b>c ", "title": "t"}, issue) == "<b>c"
    assert markup.gathered({"title": "t", "body": None, "events": [{"body": "e1"}, "e2"], "comments": {"items": ["x"]}}, issue) == "t\n\ne1\n\ne2\n\nx"
    assert markup.gathered({"title": ["a", "b"], "events": "e", "comments": {"body": "c"}}, issue) == "a\n\nb\n\ne\n\nc"
    assert markup.flat({"a": [1, None, {"b": "c"}]}) == "1\n\nc"
    rows = ['{"title": "t", "comments": [{"text": "x"}]}', "bad", None]
    assert results(spark, rows, markup.processed("x", "github_issue_conversation")) == ["t\n\nx", "", None]
    d = spark.createDataFrame([("{}", "a", None), ('{"title": "t"}', "a", "b")], "x string, a string, b string")
    assert [r[0] for r in d.select(markup.processed_document("github_issue_conversation", "x", ["a", "b"])).collect()] == ["a", "t"]


def test_metrics(spark):
    values = ["12.5%", "0.5", " 3 ", "nan", "inf", "true", "", "x%"]
    assert results(spark, values, numbers.metric("x")) == [0.125, 0.5, 3.0, None, None, None, None, None]
    assert results(spark, ["Pass@1", "pass_at_1", "pass@k=1", "acc"], numbers.is_metric("x", "pass@1")) == [True, True, True, False]


def test_pass_at_k(spark):
    for n, c, k in ((5, 2, 1), (5, 2, 3), (5, 0, 2), (4, 4, 2)):
        got = spark.range(1).select(numbers.pass_at_k(F.lit(n), F.lit(c), k)).first()[0]
        assert math.isclose(got, 1 - math.comb(n - c, k) / math.comb(n, k))


MODULE = '''import os
from sys import (
    path)

@cache
def f(a):
    """Says."""
    return "\\x0c" + a + "0123456789012345678901234567890"

async def g():
    def inner():
        return 0
    return await other_function_with_a_long_name(inner)

class C(B):
    """Doc."""
    x = 1
    def m(self):
        return self.x + 1
'''


def test_chunks():
    found = chunk.chunks(MODULE, chunk.Chunking(min_chars=10, classes=True))
    assert [k for k, _ in found] == ["python_function", "python_function", "python_class", "python_method"]
    assert all(t.startswith("import os\nfrom sys import (\n    path)\n\n") and t.endswith("\n") for _, t in found)
    assert "@cache\ndef f(a):" in found[0][1] and "def inner" in found[1][1]
    assert found[3][1].endswith('class C(B):\n    """Doc."""\n    def m(self):\n        return self.x + 1\n')
    assert chunk.chunks("def (", chunk.Chunking()) == [] and chunk.chunks("x = 1", chunk.Chunking()) == []
    assert chunk.chunks("(" * 5000, chunk.Chunking()) == []
    assert len(chunk.chunks(MODULE.replace("\n", "\r\n"), chunk.Chunking(min_chars=10, max_chunks=1))) == 1
    assert chunk.chunks(MODULE, chunk.Chunking(max_parse_chars=5)) == []


def test_docstring_split(spark):
    code = 'x = 1\n\n\ndef f(a) -> int:\n    """Says."""\n    return a\n\n\ndef g(b):\n    \'\'\'Also.\'\'\'\n    return b\n'
    got = table(spark, [code, "nothing"]).select("i", fim.split_at_docstring(F.col("x"), F.lit(0.0)).alias("a"), fim.split_at_docstring(F.col("x"), F.lit(0.99)).alias("b")).orderBy("i").collect()
    assert got[0]["a"]["prompt"].endswith('"""Says."""') and got[0]["a"]["prompt"] + got[0]["a"]["rest"] == code
    assert got[0]["b"]["prompt"].endswith("'''Also.'''") and got[0]["b"]["prompt"] + got[0]["b"]["rest"] == code
    assert got[1]["a"] is None


def test_fim_keeps_tokens(spark):
    rows = [("s", i, "python_code", [f"t{j}" for j in range(n)], 10**9) for i, n in enumerate([0, 3, 8, 9, 40] * 30)]
    d = spark.createDataFrame(rows, "source_id string, seq int, category string, tokens array<string>, position long")
    settings = fim.Fim(most=1.0, ramp_tokens=1, end_fraction=0.3)
    got = {r["seq"]: r for r in fim.transform(d, settings).collect()}
    modes = set()
    for _, i, _, tokens, _ in rows:
        r = got[i]
        modes.add(r["mode"])
        marks = {settings.prefix, settings.middle, settings.suffix}
        assert sorted(t for t in r["tokens"] if t not in marks) == sorted(tokens)
        assert (r["mode"] == "standard") == (len(tokens) < 8)
        if r["mode"] == "fim_psm":
            a = r["tokens"]
            p, s, m = (a.index(x) for x in (settings.prefix, settings.suffix, settings.middle))
            assert a[p + 1 : s] + a[m + 1 :] + a[s + 1 : m] == tokens
    assert modes == {"standard", "fim_psm", "fim_spm"}


def test_part_roll(spark):
    r = random.Random(3)
    rows = [(m, i, r.choice([0, 1, 5, 30, 200])) for i in range(200) for m in "ab"]
    got = {(x["mode"], x["seq"]): x["part"] for x in pack.part_roll(spark.createDataFrame(rows, "mode string, seq int, n_tokens int"), 60).collect()}
    for m in "ab":
        part = held = 0
        for k, i, n in rows:
            if k == m and n:
                if held and held + n > 60:
                    part, held = part + 1, 0
                held += n
                assert got[m, i] == part


def test_part_roll_of_one_mode_in_many_stretches(spark):
    r = random.Random(8)
    rows = [("a", i * i * 7919, r.choice([1, 2, 9, 30, 61, 500])) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, 5, 70), (None, 6, 3)], "mode string, seq long, n_tokens long").repartition(64)
    part, held, expected = 0, 0, {(None, 5): 0, (None, 6): 1}
    for k, i, n in rows:
        if held and held + n > 60:
            part, held = part + 1, 0
        held += n
        expected[k, i] = part
    for together in (2, 16):  # hundreds of stretches, and some
        assert {(x["mode"], x["seq"]): x["part"] for x in pack.part_roll(df, 60, together=together).collect()} == expected
    assert pack.part_roll(df.filter("n_tokens < 0"), 60).collect() == []


def test_windows_any_partitioning(spark):
    rows = [("s", i, list(range(i * 10, i * 10 + i % 7))) for i in range(300)]
    flat = [t for _, _, ts in rows for t in ts]
    for n in (1, 4, 16):
        d = spark.createDataFrame(rows, "k string, seq long, tokens array<int>").repartition(n)
        got = pack.windows(d, 50, key="k", order="seq", width=32).orderBy("window").collect()
        assert [t for r in got for t in r["input_ids"]] == flat[: len(flat) // 50 * 50]


def test_labels(spark):
    conv = [[("user", "hi"), ("assistant", "well hello"), ("tool", "x")], [("user", "only")]]
    d = spark.createDataFrame([(i, [dict(zip(("role", "content"), m)) for m in c]) for i, c in enumerate(conv)], "i int, m array<struct<role:string,content:string>>")
    enc = lambda x: F.transform(text.words(x), lambda w: F.length(w))
    got = d.select("i", sft.labelled(F.col("m"), enc).alias("x")).orderBy("i").collect()
    assert got[0]["x"]["labels"] == [-100, -100, -100, -100, 4, 5, 10, -100, -100, -100] and got[1]["x"] is None
    assert len(got[0]["x"]["ids"]) == 10


def test_truncation(spark):
    labels = [-100] * 30 + [7] * 5 + [-100] * 30
    d = spark.createDataFrame([(list(range(65)), labels)], "ids array<int>, labels array<int>")
    x = F.struct("ids", "labels")
    for k in range(10):
        got = d.select(sft.truncated(x, 16, "instruction", str(k)).alias("x")).first()["x"]
        assert len(got["ids"]) == 17 and any(v != -100 for v in got["labels"][1:])
    assert d.select(sft.truncated(x, 16, "docstring_completion", "1").alias("x")).first()["x"] is None


def test_best_response(spark):
    d = spark.createDataFrame([([("a", "m1"), (" ", "m2"), ("c", "m3"), ("d", "m3")], [("m1", 1.0), ("m3", 2.0), ("m3", 5.0), ("m2", 9.0)]), ([("x", None), ("y", None)], None), ([], [])], "r array<struct<text:string,model:string>>, a array<struct<model:string,rating:double>>")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    try:
        assert [r[0] for r in d.select(sft.best_response(F.col("r"), F.col("a"))).collect()] == ["c", "x", ""]
    finally:
        spark.conf.unset("spark.sql.mapKeyDedupPolicy")


def test_tolerant_equality(spark):
    pairs = [
        ("1.0000001", "1", True), ("[1, 2.0]", "(1, 2.0)", True), ("[1]", "[1, 2]", False), ('{"a": "x  y"}', '{"a": "x y"}', True), ("a\nb", "a b", True), ("a", "b", False), (None, "", True),
        ("100000000000000000001", "100000000000000000002", False), ("true", "1", True), ('["1"]', "[1]", True), ('{"b": 1, "a": 2}', '{"a": 2, "b": 1}', True), ('{"a": 1}', '{"b": 1}', False),
        ("[[1.5], [2]]", "[[1.5000000001], [2]]", True), ("1e400", "2", False), ("[1, [2]]", "[[1], 2]", False), ("1.1", "1.2", False), ("[]", "[]", True), ("None", "null", True), ("x", "1.0", False),
    ]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in d.orderBy("i").select(rl.tolerant_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [x[2] for x in pairs]


def test_problems_and_rewards(spark):
    d = spark.createDataFrame([("q", "def f():\n    pass", '{"inputs": [1, 2], "outputs": ["3", "4.0"]}', 1), ("q", None, "{}", 2)], "question string, starter_code string, input_output string, problem_id int")
    p = rl.problems(d)
    assert [r["prompt"] for r in p.collect()] == ["<fim_prefix># q\n\ndef f():\n    \n<fim_suffix><fim_middle>"]
    with pytest.raises(ValueError):
        rl.problems(d.filter("problem_id = 2"))
    done = p.crossJoin(spark.range(2).withColumnRenamed("id", "candidate")).select("problem_id", "candidate", "tests")
    outputs = spark.createDataFrame([(1, 0, 0, "3"), (1, 0, 1, "4.0000000001"), (1, 1, 0, "5")], "problem_id int, candidate long, test int, output string")
    assert sorted(tuple(r) for r in rl.reward_of(done, outputs).collect()) == [(1, 0, 2, 2, 1.0), (1, 1, 0, 2, 0.0)]
    plain = spark.createDataFrame([("a",), (None,)], "x string").select(rl.completion_text(F.col("x"), "string"))
    assert [r[0] for r in plain.collect()] == ["a", ""]


def test_segments(spark):
    rows = [[3, 4, 0, 1, 0, 0, 1], [0, 1, 2], [5], []]
    assert results(spark, rows, pack.segment_ids(F.col("x")), "array<int>") == [[0, 0, 1, 1, 2, 3, 3], [1, 1, 1], [0], []]


def test_long_means(spark):
    x = [float(i * 7 % 13) for i in range(2000)]
    e, want = None, []
    for v in x:
        e = v if e is None else 0.9 * e + 0.1 * v
        want.append(e)
    assert results(spark, [x, [], [2.0]], evalkit.ema(F.col("x")), "array<double>") == [pytest.approx(want), [], [2.0]]


def test_newest_files(spark):
    d = spark.createDataFrame([("eval_results_step_9.json",), ("eval_results_step_10.json",), ("step_11.pt",), ("notes.json",)], "name string")
    assert evalkit.newest_result(d).first()["name"] == "eval_results_step_10.json"
    assert evalkit.newest_checkpoint(d).first()["name"] == "step_11.pt"
    assert evalkit.newest_checkpoint(d.unionByName(spark.createDataFrame([("final",)], "name string"))).first()["name"] == "final"


def test_docstrings_in_the_transform(spark):
    code = 'def f(a, b):\n    """Says it."""\n    return a + b + a + b\n'
    d = spark.createDataFrame([("s", i, "python_code", code, code.split(), 10**9, "m.py") for i in range(40)], "source_id string, seq int, category string, text string, tokens array<string>, position long, path string")
    s = fim.Fim(most=1.0, ramp_tokens=1, docstring_fraction=1.0)
    for r in fim.transform(d, s, encode=text.words, path="path", end="<eos>").collect():
        t = r["tokens"]
        assert r["mode"] == "fim_psm" and t[-1] == "<eos>" and t[t.index("<fim_middle>") + 1 :] == "return a + b + a + b <eos>".split()
        head = t[1 : t.index("<fim_suffix>")]
        assert head in ([*code.split()[:6]], ["<filename>", "m.py", *code.split()[:6]]) or head[-2:] == ['"""Says', 'it."""']


def test_rewards(spark):
    d = table(spark, ['{"inputs": [1, 2, 3], "outputs": ["a", "b"]}', '{"inputs": [], "outputs": []}', "[]", "bad", None, '{"inputs": 3, "outputs": [1]}'])
    got = [r[0] for r in d.orderBy("i").select(rl.tests("x")).collect()]
    assert list(got[0]["inputs"]) == ["1", "2"] and got[0]["fn_name"] == "" and got[1:] == [None] * 5
    assert results(spark, ["def f():\n    pass\n\n", "x\n...", "pass", "", None, "x = 1\n"], rl.without_stub("x")) == ["def f():\n    ", "x\n", "", "", "", "x = 1"]
    assert results(spark, ["a \n\n b", "", None], rl.commented("x")) == ["# a\n# \n#  b\n", "#\n", "#\n"]


def test_ema_and_failures(spark):
    rows = [(1, i, float(x)) for i, x in enumerate([5, 3, 8, 1])]
    d = spark.createDataFrame(rows, "run int, step long, value double")
    got = evalkit.ema_rows(d, run="run", order="step", value="value").orderBy("step").collect()
    e, want = None, []
    for _, _, x in rows:
        e = x if e is None else 0.9 * e + 0.1 * x
        want.append(e)
    assert [r["ema"] for r in got] == pytest.approx(want) and got[-1]["least"] == pytest.approx(min(want))
    f = evalkit.longest_failures(d, run="run", order="step", failed=F.col("value") > 2).first()
    assert f["longest"] == 3


def _best(rows):
    """The loop that keeps the best checkpoint and its tie-break."""
    out, best, at, tie, tie_at = [], None, None, None, None
    for o, p, t in rows:
        improved = p is not None and (best is None or p > best + 1e-12)
        tied = improved
        if improved:
            best, at, tie, tie_at = p, o, None, None
        elif p is not None and best is not None:
            tied = abs(p - best) <= 1e-12
        raised = tied and t is not None and (tie is None or t > tie + 1e-12)
        if raised:
            tie, tie_at = t, o
        out.append((o, improved, best, at, raised, tie, tie_at))
    return out


def test_running_best_with_scores_closer_than_the_band(spark):
    r = random.Random(4)
    runs = {
        "even": [(i, r.choice([0.5, 0.5 + 4e-13, 0.5 + 8e-13, 0.5 + 2e-12, 0.4, None]), r.choice([None, 1.0, 1.0 + 6e-13, 2.0])) for i in range(300)],
        "rising": [(i, 1 + i * 3e-13, float(i % 4)) for i in range(200)],
        "none": [(i, None, 1.0) for i in range(3)],
    }
    df = spark.createDataFrame([(k, *x) for k, rows in runs.items() for x in rows], "run string, at long, p double, t double").repartition(7)
    got = {(x["run"], x["at"]): tuple(x[c] for c in ("at", "improved", "best", "best_order", "tie_improved", "best_tie", "best_tie_order")) for x in evalkit.running_best(df, run="run", order="at", primary="p", tie="t").collect()}
    assert got == {(k, x[0]): x for k, rows in runs.items() for x in _best(rows)}
    best = {x["run"]: x["at"] for x in evalkit.best_so_far(df, run="run", order="at", primary="p", tie="t").collect()}
    last = {k: _best(rows)[-1] for k, rows in runs.items()}
    assert best == {k: x[3] if x[6] is None else x[6] for k, x in last.items() if x[3] is not None}


def test_longest_failures_in_many_buckets(spark):
    failed = [i % 97 != 0 and not 3000 <= i < 3005 for i in range(6000)]
    df = spark.createDataFrame([(i * 1000, x) for i, x in enumerate(failed)], "at long, f boolean").withColumn("run", F.lit(1)).repartition(9)
    assert evalkit.longest_failures(df, run="run", order="at", failed=F.col("f")).collect()[0]["longest"] == 96


def test_means_in_buckets_of_any_width(spark):
    r = random.Random(8)
    rows = [(k, 3 * i, None if r.random() < 0.1 else 400 - i + 90 * r.random()) for i in range(400) for k in ("a", None)]
    d = spark.createDataFrame(rows, "run string, step long, value double").repartition(5)
    for width in (7, 100, 10**6):
        got = {(x["run"], x["step"]): (x["ema"], x["least"]) for x in evalkit.ema_rows(d, run="run", order="step", value="value", width=width).collect()}
        for k in ("a", None):
            e = least = None
            for run, step, x in rows:
                if run == k:
                    if x is not None:
                        e = x if e is None else 0.9 * e + 0.1 * x
                        least = e if least is None else min(least, e)
                    assert got[k, step] == ((None, None) if e is None else (pytest.approx(e), pytest.approx(least)))


def test_choices_follow_weights(spark):
    groups = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("none", 9.0)], "group string, weight double")
    of = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0), ("b", "z", -1.0)], "group string, source_id string, weight double")
    got = sampling.choose(spark.range(4000), groups, of, key="id", seed=1).groupBy("source_id").count().collect()
    shares = {r[0]: r[1] / 4000 for r in got}
    assert set(shares) == {"x", "y"} and abs(shares["x"] - 0.75) < 0.03 and sum(shares.values()) == 1
