"""Every stage of the pipeline, against brute force on the smallest tables and on rows made to be difficult."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.conftest import SF
from tests.llm.test_operators import EN, FR, LONG, bag, brute_lines, check_mix, jaccard
from varloom.llm import decontam, langid
from varloom.llm.queries import remainder

STAGE = dict(P.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_in_order():
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mixture"]


def test_language(spark, documents):
    made = STAGE["language"](spark, documents, SF)
    assert made.columns == documents.columns
    told = {r.doc_id: r.rejected for r in langid.identify(documents, remainder(3) != 1).collect()}
    assert {r.doc_id for r in made.collect()} == {i for i, no in told.items() if not no} and not all(told.values())


def test_lines(spark, documents):
    made = texts(STAGE["lines"](spark, documents, SF))
    want = {int(i): t for i, n, gone, t in brute_lines([(r.doc_id, r.text) for r in documents.collect()]) if t or not gone}
    assert made == want


def test_near_duplicates(spark, documents):
    made = STAGE["near_duplicates"](spark, documents, SF)
    assert made.columns == documents.columns
    rows = texts(documents)
    bags = {i: bag(t) for i, t in rows.items()}
    own = {i: i for i in rows}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in itertools.combinations(sorted(rows), 2):
        if bags[a] and bags[b] and min(bags[a].total(), bags[b].total()) >= 0.8 * max(bags[a].total(), bags[b].total()) and jaccard(bags[a], bags[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            own[y] = x
    assert {r.doc_id for r in made.collect()} == {i for i in rows if root(i) == i}


def test_benchmark(spark, documents):
    """All documents with all items, without seeds."""
    made = texts(STAGE["benchmark"](spark, documents, SF))
    items = [decontam.words_of((r.text or "").encode().lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    lost = set()
    for i, t in texts(documents).items():
        words = decontam.words_of((t or "").encode().lower())
        for item in items:
            code = {w: n for n, w in enumerate(dict.fromkeys(item))}
            there = np.array([code.get(w, -1) for w in words], np.int64)
            covered, _ = decontam.tile(there, np.array([code[w] for w in item], np.int64), 4, 0.5 * len(item))
            if covered and covered >= 0.5 * len(item):
                lost.add(i)
    assert lost and set(made) == {r.doc_id for r in documents.collect()} - lost


def test_mixture(spark, documents):
    made = STAGE["mixture"](spark, documents, SF)
    from varloom.llm.mixing import mix

    check_mix(mix(documents).collect())
    assert all(r.taken > 0 for r in made.collect()) and {"doc_id", "text", "lang", "source"} <= set(made.columns)


def test_difficult_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    rows = [
        (0, EN + "\nA line that is shared.", "en", "a", 1), (1, FR + "\nA line that is shared.  ", "fr", "b", 2), (2, None, None, None, None), (3, "", "en", "a", 0),
        (4, LONG, "en", "b", 9), (4, LONG, "en", "b", 9), (None, "no id here\na LINE that is shared.", "en", None, 3), (6, "%%% ### !!!", "fr", "c", 4), (8, "one two", "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as __hits", "2 as rid", "3 as seeds", "4 as n_lines", "5 as __lost", "6 as score", "7 as row", "8 as id")
    for name in ("lines", "near_duplicates", "benchmark", "mixture"):
        made = STAGE[name](spark, docs, SF)
        got = made.collect()
        assert len(got) <= len(rows) and (name == "mixture" or made.columns == docs.columns)
        assert name == "mixture" or all(r.row == 7 and r["__lost"] == 5 for r in got)
        assert STAGE[name](spark, docs.limit(0), SF).collect() == []
    ids = lambda name: sorted(str(r.doc_id) for r in STAGE[name](spark, docs, SF).collect())
    assert ids("lines") == sorted(str(r[0]) for r in rows) and ids("benchmark") == sorted(str(r[0]) for r in rows)
    assert ids("near_duplicates") == ["0", "1", "2", "3", "4", "6", "8", "None"]
    made = STAGE["language"](spark, docs.union(docs.filter("lang is not null and doc_id in (0, 1)").withColumn("doc_id", F.col("doc_id") + 100)), SF)
    assert {2, 3, 6}.isdisjoint(r.doc_id for r in made.collect())
    assert STAGE["language"](spark, docs.limit(0), SF).collect() == []


def test_run(spark):
    """The whole pipeline is its stages one after the other, and runs agree."""
    made = sorted(map(tuple, P.run(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert made == sorted(map(tuple, docs.collect())) and made
