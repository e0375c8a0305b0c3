"""Scalar expressions on literal examples."""

import datetime
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tabweave.functions import choices, dates, hashing, numbers, scores, text
from tabweave.operators.labels import pair_score


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm_label(spark):
    given = ["Não tem + ß ﬁ", "  Até   25% ", None, "São-Paulo (2)", "éte", "½ kg"]
    assert column(spark, given, text.norm_label) == ["NAO TEM PLUS SS FI", "ATE 25", "", "SAO PAULO 2", "ETE", "1 2 KG"]
    assert value(spark, text.norm_label(F.lit("Diamante +"), plus=False)) == "DIAMANTE"


def test_numbers(spark):
    given = ["1.234,5", "1.234", "12%", ",5", "-,5", "abc", "nan", "inf", "", "1e3"]
    assert column(spark, given, numbers.parse_number) == [1234.5, 1.234, 12.0, 0.5, -0.5, None, None, None, None, 1000.0]
    assert column(spark, ["abc", "2,5", None], numbers.lenient_number) == [0.0, 2.5, 0.0]


def test_display(spark):
    shares = column(spark, [0.200899, 0.151455, 0.647646], lambda c: numbers.display_number(c, F.lit("0%")), "double")
    assert shares == ["20%", "15%", "65%"]
    assert value(spark, numbers.display_number(F.lit(44.6747), F.lit("0.0"))) == "44,7"
    assert value(spark, numbers.display_number(F.lit(1234567.8), F.lit("#,##0.0"))) == "1.234.567,8"
    assert column(spark, [45.8419, 1 / 3, 1234567890123.0, 0.0, 5.0], numbers.value_text, "double") == [
        "45.8419", "0.333333333333", "1.23456789012e+12", "0", "5"]


def test_periods(spark):
    labels = ["2025", "Jan/26", "dez 2024", "1/2025", "Total", "1825"]
    assert column(spark, labels, lambda c: dates.is_period(text.norm_label(c, plus=False))) == [True, True, True, False, False, False]
    days = [datetime.date(2026, 11, 25), datetime.date(2026, 1, 26), datetime.date(2026, 3, 1)]
    assert column(spark, days, dates.period_label, "date") == ["Nov/25", "Jan/26", "Mar/26"]


def test_typed_cells(spark):
    kinds = column(spark, ["Nov/25", "1Q26", "001", "10-15", "45.8419", "abc", ""], lambda c: choices.typed_cell(c)["type"])
    assert kinds == ["text"] * 4 + ["number", "text", "text"]


def test_block_hints(spark):
    paths = ["slide_006/a.xlsx", "slide6/a.xlsx", "s6/a.xlsx", "006/a.xlsx", "Slide 6/a.xlsx", "x_slide6.xlsx", "x_s5.xlsx", "plain.xlsx"]
    assert column(spark, paths, text.block_hint_path) == [6, 6, 6, 6, 6, 6, 5, None]


def test_ranges_and_references(spark):
    assert column(spark, ["3, 5, 8-10", "10:8", "0", "x", ""], choices.expand_ranges) == [[3, 5, 8, 9, 10], [8, 9, 10], None, None, []]
    assert column(spark, [1, 26, 27, 702, 703], text.column_letters, "int") == ["A", "Z", "AA", "ZZ", "AAA"]
    assert column(spark, ["A1", "aa10", "ZZ3"], text.a1_col) == [1, 27, 702]


def test_criteria(spark):
    assert column(spark, ["10", "9", "x"], lambda c: choices.criteria(c, ">=10")) == [True, False, False]
    assert column(spark, ["x", "1"], lambda c: choices.criteria(c, "=abc")) == [True, False]
    assert column(spark, ["São Paulo", "Rio"], lambda c: choices.criteria(c, "sao paulo")) == [True, False]


@pytest.mark.parametrize("left, right, expected", [
    ("Norte", "nórte", 1.0), ("Uso próprio, não compro", "auto consumo", 0.9), ("Até 25%", "ATE 25", 0.96),
    ("Comparativo 2026 canal", "canal 2026", 2 / 3), ("", "canal", 0.0), ("Não tem auto consumo", "Não compro", 0.95),
])
def test_soft_score(spark, left, right, expected):
    a, b = text.norm_label(F.lit(left)), text.norm_label(F.lit(right))
    assert value(spark, scores.soft_score(a, b)) == pytest.approx(expected)
    x, y = (spark.range(1).select(k).first()[0] for k in (a, b))
    assert pair_score(x, y) == pytest.approx(expected)


def test_fingerprints_ignore_order(spark):
    one = hashing.source_signature(F.array(F.lit("b"), F.lit("Á")), F.array(F.lit("x")))
    two = hashing.source_signature(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("X")))
    assert value(spark, one) == value(spark, two) != ""
    assert value(spark, hashing.source_signature(F.array(F.lit(" ")), F.array(F.lit("")))) == ""


def test_every_compatibility_form_folds(spark):
    rows, expected = [], {}
    for code in [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]:
        whole = unicodedata.normalize("NFKD", chr(code))
        if whole != chr(code) or unicodedata.combining(chr(code)):
            plain = "".join(c for c in whole if not unicodedata.combining(c))
            expected[code] = " ".join(re.sub("[^A-Z0-9]+", " ", f"a{plain}b PLUS".upper()).split())
            rows.append((code, f"a{chr(code)}b+"))
    found = {r["code"]: r["key"] for r in spark.createDataFrame(rows, "code int, v string").select("code", text.norm_label("v").alias("key")).collect()}
    assert len(rows) > 5000 and {c: (found[c], e) for c, e in expected.items() if found[c] != e} == {}
