"""Counted character grams against the grams one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import grams, learning

TEXTS = ["Ab  ab\n\tC", "", None, " \n ", "é", "ÄÖ ß ÄÖ x", "😀😀 a😀", "aaa aaaa", "one two one İ"]


def name(code):
    return chr(code) if code < grams.PAIR else chr(code >> grams.SHIFT & (1 << 21) - 1) + chr(code & (1 << 21) - 1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, i % 2, text) for i, text in enumerate(TEXTS)], "doc_id long, fold long, text string")


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: Counter(r.g or []) for r in docs.select("doc_id", learning.char_grams(F.col("text")).alias("g")).collect()}


def test_counts_are_those_of_the_grams(docs, plain):
    texts = [r.t for r in docs.orderBy("doc_id").select(grams.spaced(F.col("text")).alias("t")).collect()]
    got = {i: Counter() for i in plain}
    for i, code, n in zip(*grams.counted(pa.array(texts)), strict=True):
        got[i][name(int(code))] += int(n)
    assert got == plain


def test_no_texts_have_no_grams():
    assert [len(x) for x in grams.counted(pa.array(["", ""]))] == [0, 0, 0]


def test_vectors_are_tfidf_of_the_other_folds(docs, plain):
    held = grams.FoldGrams(docs, "text", [0, 1], 4)
    for fold in (0, 1):
        train = [c for i, c in plain.items() if i % 2 != fold]
        ns, texts = sum(train, Counter()), Counter(g for c in train for g in c)
        code = lambda g: ord(g) if len(g) == 1 else grams.PAIR | ord(g[0]) << grams.SHIFT | ord(g[1])
        kept = sorted(sorted(ns, key=lambda g: (-ns[g], code(g)))[:4], key=code)
        got = {r.doc_id: r.features.toArray() for r in held.features(held.counts, fold).collect()}
        assert got.keys() == plain.keys()
        for i, c in plain.items():
            x = np.array([c[g] * (np.log((1 + len(train)) / (1 + texts[g])) + 1) for g in kept])
            assert got[i] == pytest.approx(x / (np.linalg.norm(x) or 1))


def test_slices_hold_each_text_once(monkeypatch):
    monkeypatch.setattr(grams, "SLICE", 5)
    batch = pa.RecordBatch.from_pydict({"text": ["", "ab", "cde", "f" * 9, "", "gh"]})
    got = [s["text"].to_pylist() for s in grams._slices(iter([batch]), "text")]
    assert got == [["", "ab", "cde"], ["f" * 9], ["", "gh"]]
