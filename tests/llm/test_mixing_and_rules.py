from __future__ import annotations

import collections
import math
import random
import re

import pytest

from textmill.llm import mixing
from textmill.llm.divergence import Rules, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    sizes = {"a": 100, "b": 100, "c": 100, None: 0}
    got = mixing.allot(sizes, {"a": 5, "b": 2, "c": 1, None: 5})
    assert got == {"a": 187.5, "b": 75.0, "c": 37.5, None: 0.0}
    got = mixing.allot({"a": 10, "b": 100, "c": 190}, {"a": 5, "b": 2, "c": 1})
    assert got["a"] == 30 and got["b"] == pytest.approx(180) and got["c"] == pytest.approx(90)
    assert mixing.allot({"a": 10}, {"a": 1}, 9.0)["a"] == 30


def brute_cost(patterns, targets, repeats):
    """Least cost of the largest flow, by trying all amounts in steps of one."""
    names = [(p, s) for p in patterns for s in p]
    best = (-1, 0)

    def go(i, used, filled, total):
        nonlocal best
        if i == len(names):
            cost = 0
            for p, u in used.items():
                for k in range(repeats):
                    cost += k * k * max(0, min(u - k * patterns[p], patterns[p]))
            if (total, -cost) > (best[0], -best[1]):
                best = (total, cost)
            return
        p, s = names[i]
        for x in range(min(repeats * patterns[p] - used[p], targets[s] - filled[s]) + 1):
            go(i + 1, used | {p: used[p] + x}, filled | {s: filled[s] + x}, total + x)

    go(0, dict.fromkeys(patterns, 0), dict.fromkeys(targets, 0), 0)
    return best


def test_flow_is_cheapest():
    r = random.Random(1)
    for _ in range(12):
        patterns = {p: r.randint(1, 3) for p in (("a",), ("a", "b"), ("b", "c"))}
        targets = {s: r.randint(0, 5) for s in "abc"}
        flow = mixing.min_cost_flow(patterns, targets, 2)
        used = collections.Counter()
        for (p, _), n in flow.items():
            used[p] += n
        cost = sum(k * k * max(0, min(used[p] - k * size, size)) for p, size in patterns.items() for k in range(2))
        assert (sum(flow.values()), cost) == brute_cost(patterns, targets, 2)


def test_mix(documents, corpus, nothing):
    got = mixing.mix(documents).collect()
    assert len(got) == len(corpus) and mixing.mix(nothing).count() == 0
    size = collections.Counter()
    for _, text, _, s in corpus:
        size[s] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    targets = mixing.allot(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[r["source"]] += r["taken"]
    longest = max(len(WORD.findall(t or "")) for _, t, _, _ in corpus)
    for s in order:
        assert abs(taken[s] - targets[s]) <= longest
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mixed(documents).count() == sum(r["times"] for r in got)
    assert mixing.mixed(documents).columns == documents.columns


@pytest.mark.parametrize("rows", [1, 10_000])
def test_marks_by_any_refinement(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "SORT_ROWS", rows)
    monkeypatch.setattr(mixing, "STEP_BITS", 4)
    r = random.Random(9)
    keys = [(0, r.getrandbits(60), r.randint(0, 9)) for _ in range(400)] + [(1, 5, 3), (1, 5, 3), (1, 9, 4)]
    line = spark.createDataFrame(keys, "_p int, _key long, _size long")
    wanted = [(0, 1.0), (0, 777.0), (1, 6.0), (1, 8.0), (1, 100.0)]
    got = mixing._marks(line, wanted)
    for p, t in wanted:
        own = collections.Counter()
        for q, k, n in keys:
            if q == p:
                own[k] += n
        total, mark = 0, 1 << 60
        for k in sorted(own):
            if own[k] and total + own[k] / 2 >= t:
                mark = k
                break
            total += own[k]
        taken = lambda m: sum(n for k, n in own.items() if k < m)  # noqa: E731, B023
        assert taken(got[p, t]) == taken(mark)


def test_overlapping_sources(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 30), r.choice([["a"], ["a", "b"], ["b", "c"], ["c", None], []])) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(d, weights={"a": 3.0, "b": 1.0, "c": 1.0, None: 1.0}).collect()
    assert len(got) == sum(max(1, len(s)) for _, _, s in rows)
    taken = collections.Counter()
    per_doc = collections.Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
        per_doc[x["doc_id"]] += x["times"]
        assert abs(x["target"]) >= 0
    assert max(per_doc.values()) <= 3
    for s in ("a", "b", "c"):
        target = next(x["target"] for x in got if x["source"] == s)
        assert abs(taken[s] - target) <= 90


def test_many_patterns_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 100)
    rows = [(i, "w " * 5, [f"s{i % 1500}", f"s{(i + 1) % 1500}"]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(d, weights=(1.0,)).collect()
    by = collections.Counter(x["doc_id"] for x in got)
    assert len(got) == 6000 and set(by.values()) == {2}
    assert {x["source_size"] for x in got} == {20} and {x["target"] for x in got} == {10.0}
    taken = collections.Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
    assert all(abs(n - 10) <= 10 for n in taken.values())


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_rules(documents, corpus, nothing):
    got = quality_rules(documents).collect()
    want = sorted((i, *brute_rules(text)) for i, text, *_ in corpus if i is not None)
    assert sorted(tuple(r)[:-1] for r in got if r["doc_id"] is not None) == want and len(got) == len(corpus)
    assert all(r["kept"] is not None and not (r["kept"] and r["base_failed"]) for r in got)
    prose = [r for r in got if r["doc_id"] is not None and 0 <= r["doc_id"] < 160 and not r["base_failed"]]
    assert sum(r["kept"] for r in prose) / len(prose) > 0.95
    assert quality_rules(nothing).count() == 0


def test_divergent_documents_fail(spark, documents):
    junk = [(900, "%%% ".join(f"{k}x7" for k in range(90)), "en"), (901, " ".join(f"QX{k}ZZ!!" for k in range(90)), "fr"), (902, "9 " * 5, "en")]
    d = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(d, rules=Rules(min_docs=5)).collect()}
    assert not kept[900] and not kept[901] and not kept[902]


def test_common_words_may_hold_the_separator(spark):
    r = random.Random(2)
    names = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(r.choice(["So,", "so", *names]) for _ in range(60)) + " so, so", "en") for i in range(30)]
    odd = [(99, " ".join(r.choice(["zz", "yy,"]) for _ in range(80)), "en")]
    for common in (2, 4):
        got = {x["doc_id"]: x["kept"] for x in quality_rules(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"), rules=Rules(common_words=common, min_docs=5, max_repeat_percent=100, max_word_distance=0.25, max_class_distance=1.0)).collect()}
        # the histogram of each text by hand
        words = [w.lower() for _, t, _ in rows + odd for w in t.split()]
        top = [w for w, _ in sorted(collections.Counter(words).items(), key=lambda e: (-e[1], e[0]))[:common]]
        assert "so," in top

        def bins(own, top=top):
            n = [own.count(w) for w in top]
            return [x / len(own) for x in [*n, len(own) - sum(n)]]

        q = bins(words)
        for i, t, _ in rows + odd:
            p = bins([w.lower() for w in t.split()])
            half = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
            d = math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q, strict=True)) / 2))
            assert got[i] == (d <= 0.25), (i, d)


def test_rules_are_native(documents):
    plan = quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
