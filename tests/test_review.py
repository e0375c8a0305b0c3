"""The parts of the legacy score, one by one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tabweave.operators import review

BASE = {
    "headers": ["2011", "2012"], "rows": ["Norte", "Sul"], "source_headers": ["2011", "2013"], "source_rows": ["NORTE", "sul"], "variable": "", "hints": "", "opening": "",
    "opening_hints": "", "target_text": "", "question": "", "source_text": "", "graph_id": "", "target_graph_id": "", "source_graph_id": "",
}


@pytest.mark.parametrize("change, part, expected", [
    ({}, "header", (1 + .75 * .75) / 2), ({}, "row", 1.0), ({"rows": ["", "Norte Sul"]}, "row", .92), ({"rows": []}, "row", 0.0), ({"source_headers": []}, "header", 0.0),
    ({"variable": "Vendas", "question": "vendas"}, "variable_part", 1.0), ({"hints": "a b c d", "source_text": "x b c y"}, "variable_part", .5), ({"target_text": "total", "source_text": "total"}, "variable_part", .7),
    ({"opening": "2011 2013"}, "opening_part", 1.0), ({"source_graph_id": "7", "target_graph_id": "7"}, "metadata", 1.0), ({"source_graph_id": "7", "graph_id": "8"}, "metadata", 0.0), ({}, "metadata", 0.0),
])
def test_legacy_parts(spark, change, part, expected):
    row = BASE | change
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in BASE.items())
    got = review.legacy_parts(spark.createDataFrame([tuple(row.values())], schema)).select(part).first()[0]
    assert got == pytest.approx(expected)


def _legacy(a, b):
    x, y = a.replace(" ", ""), b.replace(" ", "")
    if not a or not b:
        return 0.0
    if x == y:
        return 1.0
    if len(x) > 2 and len(y) > 2 and (x in y or y in x):
        return .92
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
    p, q = set(a.split()), set(b.split())
    return max(len(p & q) / max(len(p), len(q)), .75 * (1 - row[-1] / max(len(x), len(y))))


def test_legacy_labels_score_as_the_plain_rule(spark):
    rng = random.Random(3)
    label = lambda: " ".join("".join(rng.choice("ABC") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 3)))
    rows = [tuple((BASE | {"rows": [label() for _ in range(rng.randint(0, 6))], "source_rows": [label() for _ in range(rng.randint(0, 5))], "variable": label(), "question": label()}).values())
            for _ in range(300)]
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in BASE.items())
    for r in review.legacy_parts(spark.createDataFrame(rows, schema)).select("rows", "source_rows", "variable", "question", "row", "variable_part").collect():
        asked = [v for v in r.rows if v]
        want = sum(max((_legacy(v, c) for c in r.source_rows), default=0.0) for v in asked) / len(asked) if asked else 0.0
        assert r.row == pytest.approx(want) and r.variable_part == pytest.approx(_legacy(r.variable, r.question))


def test_labels_of_an_axis_are_normalized_once(spark):
    labels = [f"Região {i} +{i % 7}" for i in range(1500)]
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in BASE.items())
    row = lambda own: tuple((BASE | {"rows": own, "source_rows": own[::-1]}).values())
    review.legacy_parts(spark.createDataFrame([row(labels[:2])], schema)).select("row").collect()
    start = time.monotonic()
    assert review.legacy_parts(spark.createDataFrame([row(labels)], schema)).select("row").first()[0] == 1.0
    assert time.monotonic() - start < 5


def test_equal_graph_ids_score_fully(spark):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in BASE.items())
    rows = [tuple((BASE | {"graph_id": g, "source_graph_id": s}).values()) for g, s in (("7", "7"), ("", ""), ("7", "8"))]
    parts = review.legacy_parts(spark.createDataFrame(rows, schema))
    score = review.legacy_score("header", "row", "variable_part", "opening_part", "metadata", "same_id")
    assert [r.s for r in parts.select(F.round(score, 6).alias("s")).collect()] == [1.0, *[pytest.approx(.44 * (1 + .75 * .75) / 2 + .34, abs=1e-6)] * 2]


def test_quality_is_measured(spark):
    jobs = spark.createDataFrame([
        ("a", ["Norte", "Região Sul", "", "x y z w"], ["2001", "2002"], ["NORTE", "Sul", None], ["2001"], 90.0), ("b", [], None, ["N"], [], None)],
        "target_id string, rows array<string>, headers array<string>, source_rows array<string>, source_headers array<string>, confidence double")
    fill = spark.createDataFrame([("a", 8, 6)], "target_id string, n_values long, n_filled long")
    found = {r.target_id: r for r in review.quality_report(review.quality_measures(jobs, fill)).collect()}
    a, b = found["a"], found["b"]
    assert (a.rows_ok, a.cols_ok, a.filled, a.rows_missing, a.cols_missing) == (66.7, 50.0, 75.0, "x y z w", "2002")
    assert (a.alerts, a.verdict) == ("rows; columns", "Review") and (b.rows_ok, b.cols_ok, b.filled) == (0.0, 0.0, 0.0)


def test_numbers_pass_kept_names(spark):
    rows = [  # block, top, shape name, id expected
        (1, 0.0, "a", "S001_T001_CHART"), (1, 1.0, "S002_T002_CHART", "S002_T002_CHART"), (1, 2.0, "S001_T004_CHART", "S001_T004_CHART"), (1, 3.0, "b", "S001_T005_CHART"),
        (2, 0.0, "c", "S002_T001_CHART"), (2, 1.0, "d", "S002_T003_CHART"), (2, 2.0, "e", "S002_T004_CHART"), (2, 3.0, "S001_T001_CHART", "S001_T001_CHART"),
        (3, 0.0, "S009_T009_X", "S003_T001_CHART"), (3, 1.0, "S009_T009_X", "S003_T002_CHART"), (4, 0.0, "f", "S004_T001_CHART"), (4, 1.0, "S004_T001_CHART", "S004_T001_CHART"),
    ]
    t = spark.createDataFrame(
        [(b, top, 0.0, i, n, "chart", want) for i, (b, top, n, want) in enumerate(rows)],
        "block_id int, top_in double, left_in double, shape_id int, shape_name string, object_type string, want string")
    assert [r.asDict() for r in review.stable_ids(t).where("stable_id <> want").collect()] == []
