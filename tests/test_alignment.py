"""Label maps and aligned axes in long form."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.functions.scores import soft_score
from tabweave.operators import alignment, labels

WORDS = ["NORTE", "SUL", "NAO", "TEM", "AUTO", "CONSUMO", "USO", "PROPRIO", "COMPRO", "ATE", "25", "26", "50", "TOTAL", "A", "AB"]


def text(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))


def test_pair_score_is_the_soft_score(spark):
    rng = random.Random(1)
    pairs = [(text(rng), text(rng)) for _ in range(1500)] + [("ATE 25", "MEU ATE 25"), ("NAO TEM AUTO CONSUMO", "NAO COMPRO"), ("USO PROPRIO NAO", "AUTO CONSUMO"), ("X", "X")]
    df = spark.createDataFrame(pairs, "l string, r string")
    for r in df.select("l", "r", soft_score("l", "r").alias("s")).collect():
        assert labels.pair_score(r.l, r.r) == r.s, (r.l, r.r)


def plain_take(wanted, keys):
    """The rule with every score at hand."""
    used, out = set(), []
    for w in wanted:
        ranked = sorted(range(len(keys)), key=lambda i: (-labels.pair_score(w, keys[i]), i))
        pick = next((i for i in ranked if keys[i] not in used), ranked[0] if ranked else None)
        if pick is not None:
            used.add(keys[pick])
        out.append(pick)
    return out


@pytest.mark.parametrize("few", [64, 0])
def test_choices_are_taken_in_order(monkeypatch, few):
    monkeypatch.setattr(labels, "FEW", few)
    rng = random.Random(2)
    for _ in range(400):
        wanted, keys = ([text(rng) for _ in range(rng.randint(0, 9))] for _ in range(2))
        if keys and rng.random() < .5:
            wanted += rng.sample(keys, rng.randint(0, len(keys)))
        choices = labels.Choices(keys, keys)
        assert choices.take(wanted) == plain_take(wanted, keys)
        required = [w for w in wanted if w]
        share = sum(max((labels.pair_score(w, k) for k in keys), default=0) >= .68 for w in required) / len(required) if required else 0
        assert labels.covered(wanted, choices) == share


def test_maps_do_not_depend_on_batches(spark):
    rng = random.Random(3)
    rows = [(f"t{t}", s, a, i, text(rng).title()) for t in range(40) for s in "ts" for a in ("row", "col") for i in range(rng.randint(0, 5))]
    df = spark.createDataFrame(rows, "target_id string, side string, axis string, ix int, label string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for size in ("10000", "3", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found.append(sorted(map(str, labels.map_labels(df).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] == found[2]
    assert sum("axis=None" in r for r in found[0]) == len({r[0] for r in rows})
    assert {r["mode"] for r in labels.map_labels(df, "transpor").collect()} == {"cross"}


def test_axis_of_100000_labels(spark):
    """Source labels in another order, a few renamed, a few new: no pair list is made."""
    n = 100_000
    ids = spark.range(n, numPartitions=8)
    name = F.concat(F.lit("Client "), F.lpad(F.col("id").cast("string"), 6, "0"))
    want = ids.select(F.lit("t").alias("target_id"), F.lit("t").alias("side"), F.lit("row").alias("axis"), F.col("id").cast("int").alias("ix"),
                      F.when(F.col("id") % 25_000 == 7, F.concat(name, F.lit(" (old)"))).otherwise(name).alias("label"))
    have = ids.select(F.lit("t").alias("target_id"), F.lit("s").alias("side"), F.lit("row").alias("axis"), (n - 1 - F.col("id")).cast("int").alias("ix"), name.alias("label"))
    new = spark.createDataFrame([("t", "s", "row", n, "Branch 1"), ("t", "s", "col", 0, "2011"), ("t", "t", "col", 0, "2011")], want.schema)
    pairs = spark.createDataFrame([("t", "s", "categories_rows_series_columns", True)], "target_id string, table_id string, orientation string, allow_growth boolean")
    aligned = alignment.align_labels(pairs, want.unionByName(have).unionByName(new))
    rows = aligned.axes.where("axis = 'row'").orderBy("ix").toArrow()
    assert rows.num_rows == n + 1 and rows.column("at").to_pylist() == list(range(n + 1))
    shown = rows.column("shown").to_pylist()
    assert shown[0] == f"Client {n - 1:06d}" and shown[-1] == "Branch 1"
    assert rows.filter(pa.array(["(old)" in x for x in rows.column("label").to_pylist()])).num_rows == 4
    assert aligned.modes.first()["mode"] == "same"


def test_words_of_a_choice_are_split_once():
    class Key(str):
        splits = 0

        def split(self, *args):
            self.splits += 1
            return super().split(*args)

    keys = [Key(f"NATION {i} OF {i % 3}") for i in range(20)]
    choices = labels.Choices(list(keys), keys)
    assert choices.take([f"REGION {i} OF {i % 3}" for i in range(30)])[:3] == [0, 1, 2] and {k.splits for k in keys} == {1}
