"""Documented examples, and the expressions against plain Python over sample text."""

import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, distance, geometry, text
from tessera.operators import extraction, labels, segments


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: distance.token_overlap(F.lit("SILVACOSTA"), F.lit("SILVA COSTA")), 1.0),
        (lambda: distance.token_overlap(F.lit(""), F.lit("ABCD")), 0.0),
        (lambda: distance.token_overlap(F.lit("KAD PENGENALAN"), F.lit("ALI BIN ABU")), 0.0),
        (lambda: text.strip_field_number(F.lit("1. UZORAK")), "UZORAK"),
        (lambda: dates.normalize_date_weak(F.lit("12.05.1971")), "1971-05-12"),
        (lambda: dates.normalize_date_weak(F.lit("5 OGOS 1990")), "1990-08-05"),
        (lambda: dates.normalize_date_weak(F.lit("HELLO")), "HELLO"),
        (lambda: dates.birth_date_evidence(F.lit("001230-11-0470"), F.lit("2000-12-30")), 1.0),
        (lambda: dates.normalize_date(F.lit("001230-11-0470")), "2000-12-30"),
        (lambda: dates.normalize_date(F.lit("640228")), "1964-02-28"),
        (lambda: dates.normalize_date(F.lit("nothing")), ""),
        (lambda: labels.weak_label(F.lit(1.0), F.lit(1.0), F.lit(0.0)), "name"),
        (lambda: labels.weak_label(F.lit(0.4), F.lit(0.0), F.lit(0.0)), "other"),
        (lambda: distance.cer(F.lit(""), F.lit("")), 0.0),
        (lambda: distance.cer(F.lit("x"), F.lit("")), 1.0),
        (lambda: distance.cer_field(F.lit("x"), F.lit("")), 0.0),
        (lambda: distance.cer_field(F.lit("aa john doe bb"), F.lit("john doe")), 0.0),
        (lambda: distance.wer_charlev(F.lit("john do"), F.lit("john doe")), 0.5),
        (lambda: distance.token_f1(F.lit("b a"), F.lit("a b")), 1.0),
        (lambda: text.rule_field(F.lit("1990")), "birth_date"),
        (lambda: text.rule_field(F.lit("JALAN BATU 3")), "address"),
        (lambda: text.rule_field(F.lit("MARIA SILVA")), "name"),
        (lambda: text.rule_field(F.lit("")), "other"),
        (lambda: text.validate_name(F.lit("")), "EMPTY"),
        (lambda: text.validate_name(F.lit("A1")), "CONTAINS_DIGIT"),
        (lambda: text.validate_name(F.lit("A" * 101)), "TOO_LONG"),
        (lambda: text.validate_date(F.lit("1971-13-01")), "BAD_MONTH:13"),
        (lambda: text.validate_date(F.lit("2016")), "YEAR_OUT_OF_RANGE:2016"),
        (lambda: text.validate_date(F.lit("1971")), "OK"),
        (lambda: extraction.country_of(F.lit("HENKILOKORTTI RHEINLAND ARMAS")), None),
        (lambda: geometry.confidence_bin(F.lit(0.0)), None),
        (lambda: geometry.confidence_bin(F.lit(0.1)), 0.0),
        (lambda: geometry.confidence_bin(F.lit(0.31)), 0.3),
        (lambda: geometry.confidence_bin(F.lit(1.01)), None),
        (lambda: segments.line_numbers(F.array(*[F.lit(y) for y in (0.10, 0.115, 0.13, 0.145, 0.20)])), [1, 1, 2, 2, 3]),
        (lambda: text.normalize_name(F.lit("Nama: Ali  bin-Abu MyKad")), "ALI BIN-ABU"),
        (lambda: text.given_name_first(F.lit("VAN DYK ANNE"), F.lit(True)), "ANNE VAN DYK"),
    ],
)
def test_documented(spark, column, expected):
    assert value(spark, column()) == expected


def test_glued_field_number(spark):
    assert value(spark, extraction.numbered_field(F.lit("328.02.64"))).asDict() == {"field": "3", "value": "28.02.64"}
    assert value(spark, extraction.numbered_field(F.lit("2 Anne"))).asDict() == {"field": "2", "value": "Anne"}


@pytest.mark.parametrize(("case", "expected"), [((29, "ALI", 1, 0.9), "REJECT"), ((50, "", 1, 0.9), "HUMAN_REVIEW"), ((50, "ALI", 1, 0.75), "AUTO_APPROVE"), ((50, "ALI", 0, 0.9), "REJECT"), ((50, "ALI", 1, 0.7), "HUMAN_REVIEW")])
def test_route(spark, case, expected):
    blur, name, readable, conf = case
    column = extraction.route(F.lit(blur), F.lit(100), F.lit(0.1), F.lit(name), F.lit("1980"), F.lit(readable), F.lit(False), (F.lit(conf), F.lit(0.8), F.lit(0.0)))
    assert value(spark, column) == expected


def edits(a: str, b: str) -> int:
    @cache
    def d(i: int, j: int) -> int:
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


def plain_overlap(seg: str, ref: str) -> float:
    s, r = seg.upper(), ref.upper()
    bare_s, bare_r = s.replace(" ", ""), r.replace(" ", "")
    if len(bare_r) >= 4 and (bare_r in bare_s or abs(len(bare_s) - len(bare_r)) <= 2 and edits(bare_s, bare_r) <= 2):
        return 1.0
    if not s.split() or not r.split():
        return 0.0
    near = lambda x, y: edits(x, y) <= 1 if len(x) >= 4 else x == y
    return sum(any(near(x, y) for y in r.split()) for x in s.split()) / len(s.split())


def test_overlap_against_python(spark):
    names = ["Érika Straße", "ana  maria", "ANNA MARIA LOPEZ", "x", "", "Jose Luis", "lopes ana", "marie"]
    pairs = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", distance.token_overlap(F.col("a"), F.col("b")).alias("v")).collect()
    for row in got:
        assert row.v == pytest.approx(plain_overlap(row.a, row.b)), (row.a, row.b)


def test_ratios_and_flags_against_python(spark):
    texts = ["Abc 12", "１２３ full width", "É", "", "JALAN 12345", "a12345b", "2001-02-03", "BIN ", "no", "²³"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.alpha_ratio(F.col("t")).alias("a"), text.digit_ratio(F.col("t")).alias("d"), text.has_postcode(F.col("t")).alias("p"), text.is_all_caps(F.col("t")).alias("u")
    )
    for row in got.collect():
        n = max(len(row.t), 1)
        assert row.a == pytest.approx(sum(c.isalpha() for c in row.t) / n)
        assert row.d == pytest.approx(sum(c.isdigit() for c in row.t) / n)
        assert row.p == int(bool(re.search(r"\b\d{5}\b", row.t)))
        assert row.u == int(row.t.isupper())


def test_nfkc(spark):
    frame = spark.createDataFrame([("ﬁn  ", "FIN"), (None, "")], "a string, b string")
    assert [r.v for r in frame.select(distance.cer_compatible(F.col("a"), F.col("b")).alias("v")).collect()] == [0.0, 0.0]
