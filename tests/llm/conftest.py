from __future__ import annotations

import random

import pytest

LETTERS = {"en": "the of and to in is that with".split(), "fr": "le la les des une dans pour avec".split()}


def sentence(r: random.Random, lang: str, n: int) -> str:
    end = {"en": "ing tion ly er ess".split(), "fr": "eux aux ement ié ère".split()}[lang]
    out = []
    for _ in range(n):
        out.append(r.choice(LETTERS[lang]) if r.random() < 0.4 else "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(end))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): prose, copies, near copies, junk, nulls, empty and long texts, repeated rows."""
    r = random.Random(5)
    rows: list[tuple] = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        rows.append((i, sentence(r, lang, r.randint(5, 220)) + (".\n" + sentence(r, lang, 30) if i % 4 == 0 else ""), lang, f"s{i % 5}"))
    for i in range(160, 200):
        base = rows[r.randrange(20)][1].split(" ")
        for _ in range(r.randint(0, 4)):
            base[r.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base), "en", "s0"))
    passage = sentence(r, "en", 60)
    rows += [(200 + i, f"{sentence(r, 'en', 12)} {passage} {sentence(r, 'en', 12)}", "en", "s1") for i in range(8)]
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, " \n\t ", "fr", None), (303, "é", "fr", "s2"), (304, "### $$$ 12", None, "s2"), (305, "a" * 700, "en", "s3")]
    rows += [(306, (sentence(r, "en", 400) + "\n") * 12, "en", "s3"), (307, "x y\n" * 80, "en", "s4"), (308, "Ünïcode 𝒳𝒴 " * 40, "fr", "s4"), (309, "The the THE", "en", "s4"), (310, "the The the", "en", "s4"), (311, "two words", "en", "s4")]
    rows.append(rows[3])
    rows.append((None, rows[5][1], "en", "s0"))
    rows.append((-7, rows[6][1], "fr", "s0"))
    return rows


#: Extra columns whose names clash with what operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id int, h int, component int, _text int, _id int, doc int, v int, label int, score int"


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(*x, len(x[1] or ""), 1, 2, 3, 4, 5, 6, 7, 8, 9) for x in corpus]
    return spark.createDataFrame(rows, CLASH).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
