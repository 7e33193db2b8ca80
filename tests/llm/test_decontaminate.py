"""Benchmark windows in documents against a plain computation."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from convolens.llm import decontaminate
from tests.conftest import plan_of

LONG = "Alpha beta, gamma delta: epsilon zeta eta theta iota kappa lambda mu"
SHORT = "Two Words"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, hit, found = tokens(text), set(), set()
        for item, body in items:
            own = tokens(body)
            n = min(window, len(own))
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        names = ",".join(sorted(found))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, LONG), (1, LONG), (20, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, SHORT), (4, None), (5, " .. "), (7, "Énorme")]
DOCS = [
    (1, f"before ({LONG}) after, TWO words. two words two"),
    (1, f"before ({LONG}) after, TWO words. two words two"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (None, "énorme and ÉNORME enorme Énorme"),
    (3, None), (4, ""), (5, "..."), (6, "nothing here"),
    (7, "x " * 500 + LONG.upper() + " y" * 500),
    (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa gamma delta epsilon zeta eta theta iota kappa lambda mu"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in DOCS], "doc_id long, text string, item_id string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("window", [10, 3, 1])
def test_against_brute_force(tables, window):
    docs, items = tables
    assert rows(decontaminate.find(docs, items, window=window).digest()) == brute(DOCS, ITEMS, window)


def test_many_grams_are_joined_by_shuffle(tables, monkeypatch):
    from convolens import runtime

    monkeypatch.setattr(decontaminate, "HASHES", 0)
    plain = runtime.join_small
    monkeypatch.setattr(decontaminate, "join_small", lambda *a, **k: plain(*a, **({"max_rows": 0} | k if len(a) < 5 else k)))
    docs, items = tables
    assert rows(decontaminate.find(docs, items).digest()) == brute(DOCS, ITEMS)


def test_no_items_and_no_documents(tables):
    docs, items = tables
    assert rows(decontaminate.find(docs, items.limit(0)).digest()) == brute(DOCS, [])
    assert decontaminate.find(docs.limit(0), items).digest().count() == 0


def test_removal(tables):
    docs, items = tables
    found = decontaminate.find(docs, items)
    left = found.without_documents()
    assert left.columns == docs.columns
    assert rows(left.select("doc_id")) == [(2,), (3,), (4,), (5,), (6,)]
    clean = rows(found.without_spans().select("doc_id", "text", "item_id"))
    assert [r[1] for r in clean if r[0] == 1] == ["before () after,  two"] * 2
    assert [r[1] for r in clean if r[0] is None] == ["énorme and  enorme "]  # É is beyond A to Z
    untouched = {(i, t) for i, t in DOCS if i in (2, 3, 4, 5, 6)}
    assert untouched <= {r[:2] for r in clean}
    assert decontaminate.find(found.without_spans(), items).digest().where("contaminated").count() == 0


def test_reserved_columns(tables):
    docs, items = tables
    with pytest.raises(ValueError):
        decontaminate.find(docs.withColumn("_doc", F.lit(1)), items)


def test_no_python_in_the_plan(tables):
    docs, items = tables
    found = decontaminate.find(docs, items)
    for df in (found.digest(), found.without_spans(), found.without_documents()):
        assert not re.search("Python|Arrow|Pandas", plan_of(df))
