"""Every query outside the llm subpackage: against its SQL, or for rows where SQL can't express it."""

from __future__ import annotations

import pytest

from tests.oracle import ROOT, TABLES, difference
from textmill import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], f"{ROOT}/sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, f"{ROOT}/sf0.001").limit(1).count() == 1


def test_notebook_cells_of_odd_texts(spark, tmp_path):
    """Texts that begin as JSON, are JSON, end in the query's own sign, or are missing, at ids of every kind."""
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{ROOT}/sf0.001/{t}.parquet")
    texts = ["8316107434564120 Thanlyan of", "8316107434564120", "[1] [2]", '{"cells": []} x', '{"cells": []}', "a#", "a\n\nb\n \nc#\n", '"a\n"', "", "\n", None]
    rows = [(15 * k + i, x) for k, x in enumerate(texts) for i in range(15)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    next((tmp_path / "documents").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert difference(spark, QUERIES["notebook_cells"], SQL["notebook_cells"], str(tmp_path)) == ""


def test_strip_html_full_of_cut_references(spark, tmp_path):
    """The references that the tables' pages hold, cut at each place as in a title, whatever follows."""
    for t in TABLES:
        if t != "pages":
            (tmp_path / f"{t}.parquet").symlink_to(f"{ROOT}/sf0.001/{t}.parquet")
    held = ["&amp;", "&copy;", "&middot;", "&quot;"]
    pages = [f"<h1>token = {x[:k]}{end}" for x in held for k in range(1, len(x) + 1) for end in ("", " ", "</h1><p>a &amp; b</p>", "x", "x;", "1;", "=1", "&quot;", "&quot", "&&")]
    pages += ["&amp;quot;", "&amp;quot", "&ampquot;", "&amp;amp;", "<a href='?a&quot=1'>&quot</a>", "<code>&quot</code>", "&<b>quot;</b>", "&quot", "", None]
    spark.createDataFrame([(i, "/", x) for i, x in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    next((tmp_path / "pages").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert difference(spark, QUERIES["strip_html_full"], SQL["strip_html_full"], str(tmp_path)) == ""
