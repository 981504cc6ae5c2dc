"""Queries over whole texts against plain Python, on texts beyond ASCII."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog, models
from tessera.sources.tables import Tables

DOCS = [
    (1, "Élodie Brûlée\n1999-01-01\nJALAN ñandú 5", "fr"),
    (2, "Müßiggang und Öl gut\n ", "de"),
    (3, "plain the text", "en"),
    (4, "éthé qui ñ", "fr"),
]
TURNS = [(1, 0, "user", "Crème brûlée à Noël"), (1, 1, "bot", "creme brulee a Noël"), (1, 2, "user", "éé"), (2, 0, "user", "señor"), (2, 1, "bot", "SEÑOR Ägypten")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], d[0] % 2, 0) for d in DOCS], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def run(spark, folder, name):
    return catalog.queries()[name](spark, folder).collect()


def lines():
    return {(d, i): line for d, text, _ in DOCS for i, line in enumerate(text.split("\n"))}


def pairs():
    return {(a[0], a[1]): (a[3], b[3]) for a, b in zip(TURNS, TURNS[1:], strict=False) if a[0] == b[0]}


def test_lengths_and_ratios(spark, folder):
    got = {(r.doc_id, r.seg_idx): (r.text_len, r.word_count, r.is_all_caps) for r in run(spark, folder, "f19_lengths")}
    assert got == {k: (len(x), len(x.split()), int(x.isupper())) for k, x in lines().items()}
    got = {(r.doc_id, r.seg_idx): (r.alpha_ratio, r.digit_ratio) for r in run(spark, folder, "f18_ratios")}
    share = lambda x, kind: pytest.approx(sum(kind(c) for c in x) / max(len(x), 1))
    assert got == {k: (share(x, str.isalpha), share(x, str.isdigit)) for k, x in lines().items()}


def test_error_rates(spark, folder):
    fold = lambda x: x.strip().lower()
    got = {(r.conv_id, r.turn): r.cer for r in run(spark, folder, "f3_cer_pairs")}
    assert got == {k: pytest.approx(edits(fold(h), fold(r)) / len(fold(r))) for k, (h, r) in pairs().items()}
    got = {(r.conv_id, r.turn): r.wer for r in run(spark, folder, "f4_wer_pairs")}
    assert got == {k: pytest.approx(edits(" ".join(fold(h).split()), " ".join(fold(r).split())) / len(r.split())) for k, (h, r) in pairs().items()}


def test_overlap(spark, folder):
    def overlap(seg, ref):
        s, r = seg.upper(), ref.upper()
        a, b = s.replace(" ", ""), r.replace(" ", "")
        if len(b) >= 4 and (b in a or edits(a, b) <= 2):
            return 1.0
        near = lambda x: any(edits(x, y) <= 1 if len(x) >= 4 else x == y for y in r.split())
        return sum(map(near, s.split())) / len(s.split())

    got = {(r.conv_id, r.turn): r.overlap for r in run(spark, folder, "f9_token_overlap")}
    assert got == {k: pytest.approx(overlap(*p)) for k, p in pairs().items()}


def test_words_end_at_unicode_letters(spark, folder):
    def first(words):
        return {d: next((i for i, w in enumerate(words) if re.search(rf"\b{w}\b", text, re.I)), None) for d, text, _ in DOCS}

    langs, found = ["en", "de", "fr", "es"], first(["the", "und", "est", "por"])
    assert {r.doc_id: r.country for r in run(spark, folder, "j10_alias_scan")} == {d: langs[i] for d, i in found.items() if i is not None}
    found = first(["the", "und", "qui", "por"])
    want = sorted((langs.index(lang), 4 if found[d] is None else found[d]) for d, _, lang in DOCS)
    assert sorted((r.y, r.yhat) for r in run(spark, folder, "a20_confusion") for _ in range(r.n)) == want


def test_number_before_a_hard_space(spark, folder):
    numbered = {(d, i): f"{1 + d % 9}{'a. ' if i % 2 == 0 else '.'}{x}".strip() for (d, i), x in lines().items()}
    match = lambda x: (re.match(r"^(\d[a-c]?)\.?\s+(.*)", x) or [""] * 2)[1]
    assert {(r.doc_id, r.seg_idx): r.field for r in run(spark, folder, "x11_numbered_fields")} == {k: match(x) for k, x in numbered.items()}


def test_every_stripped_query_has_a_twin(spark, folder):
    sql = catalog.oracle_sql()
    stripped = {name for name, text in sql.items() if "[^\\x00-\\x7F]', '', 'g'" in text}
    twins = {name.removesuffix("_whole") for name in catalog.queries() if name.endswith("_whole")}
    assert stripped == twins and not any(f"{name}_whole" in sql for name in twins)


def test_char_grams_are_of_whole_texts(spark, folder):
    grams = models.char_gram_tokens(Tables(spark, folder)).where("doc_id = 1").select(F.explode("tokens").alias("g"))
    assert {"é", " é", "û"} <= {r.g for r in grams.collect()}
