"""What keeps large inputs off the driver and out of repeated shuffles."""

import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tabweave.operators import candidates
from tabweave.queries.roles import SPARK_ROLES, TABLES, Roles, duck_sql
from tabweave.session import BYTES_OF_A_TASK, cut_lineage, joined_where_they_lie, prepare

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_that_its_encoding_makes_small_is_not_broadcast(spark):
    rows = spark.range(1_500_000).select(F.floor(F.col("id") / 25).alias("k"), F.concat(F.lit("NATION_"), F.col("id") % 25).alias("label"))
    kept = cut_lineage(rows, "encoded")
    files = sum(pathlib.Path(f.removeprefix("file:")).stat().st_size for f in kept.inputFiles())
    assert files < 10_000_000  # below Spark's own limit, while the rows take over 100 MB
    assert "BroadcastHashJoin" not in _plan(kept.join(kept.select("k", F.col("label").alias("other")), "k"))


def test_a_task_gets_a_bounded_part_of_files_and_shuffles(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for given, kept in (("128MB", f"{BYTES_OF_A_TASK}b"), ("134217728b", f"{BYTES_OF_A_TASK}b"), ("16k", "16k"), ("4194304", "4194304")):
            for n in names:
                spark.conf.set(n, given)
            prepare(spark)
            assert [spark.conf.get(n) for n in names] == [kept, kept]
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_roles_read_the_kept_sales(spark):
    r = Roles(spark, SF)
    for name in ("src_row", "tgt_col", "sheet_cell"):
        files = r.role(name).inputFiles()
        assert files and not any("lineitem" in f for f in files)
    plain = spark.sql(r._located("SELECT l_partkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM {lineitem} GROUP BY 1"))
    assert r.sql("SELECT k, sum(cents) AS c FROM xt GROUP BY k").exceptAll(plain).count() == 0


def test_axes_are_read_from_the_kept_cells_without_a_shuffle(spark):
    r = Roles(spark, SF)
    for name in ("src_row", "src_col", "tgt_row", "tgt_col"):
        assert "Exchange" not in _plan(r.role(name))
    # the values need their sheet's name, no axis
    assert _plan(r.role("src_value")).count("Join") == _plan(r.role("src_head")).count("Join") + 1


@pytest.mark.parametrize("name", [n for n in SPARK_ROLES if n != "src_cell"])
def test_roles_of_their_own_text_have_the_rows_of_the_sql(spark, name):
    rows = Roles(spark, SF).role(name)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(f"SELECT {', '.join(rows.columns)} FROM ({duck_sql(f'SELECT * FROM {name}')})").fetchall()
    assert want and sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, want))


def test_evidence_is_dealt_once_by_the_pair(spark):
    axes = [("1", ["a b", "c"], ["d"]), ("2", ["c", "e"], ["a b"])]
    t = spark.createDataFrame([(1, *a) for a in axes], "scope long, t_axes string, cats array<string>, sers array<string>")
    found = candidates.axis_coverage(t, t.withColumnRenamed("t_axes", "s_axes"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the rows that hits are counted from carry numbers, no texts
    counted = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert "axes" not in counted and "RepartitionByExpression" in counted
    got = {(r.t_axes, r.s_axes): (r.cc, r.cs, r.ss, r.sc) for r in found.collect()}
    assert got == {("1", "1"): (2, 0, 1, 0), ("1", "2"): (1, 1, 0, 0), ("2", "1"): (1, 0, 0, 1), ("2", "2"): (2, 0, 1, 0)}


def _axes(spark, count):
    rows = [(i % 3, f"{i:03}", [f"a {i % 5}", f"b{i % 4}", "auto consumo x"], [f"c {i % 7}", "uso proprio compro"]) for i in range(count)]
    upper = [(scope, key, [c.upper() for c in cats], [s.upper() for s in sers]) for scope, key, cats, sers in rows]
    return spark.createDataFrame(upper, "scope long, t_axes string, cats array<string>, sers array<string>")


def test_pairs_of_axes_are_counted_where_their_cells_lie(spark, monkeypatch):
    t = _axes(spark, 40)
    s = t.withColumnRenamed("t_axes", "s_axes")
    whole = sorted(map(tuple, candidates.axis_coverage(t, s).collect()))
    monkeypatch.setattr(candidates, "CELL_BITS", 1)  # scopes of many cells
    assert sorted(map(tuple, candidates.axis_coverage(t, s).collect())) == whole and len(whole) > 500
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = candidates._numbered(t, "t_axes", "t", "t_cell"), candidates._numbered(s, "s_axes", "s", "s_cell")
        counts = candidates._axis_counts(*numbered)
        with joined_where_they_lie(spark):
            exchanges = [line for line in _plan(counts).splitlines() if "Exchange" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # three sides are dealt by cells, two of them after they met their cells; no pair is moved after that
    assert len(exchanges) == 7 and sum("REPARTITION_BY_NUM" in line for line in exchanges) == 3


def test_heads_read_the_kept_parts(spark):
    """Which parts have a sale is found once, not for each role."""
    r = Roles(spark, SF)
    for name in ("src_head", "tgt_head", "learned", "job"):
        assert not any("lineitem" in f for f in r.role(name).inputFiles())


def test_names_are_split_only_where_their_counts_allow(spark):
    from tabweave.operators import similarity

    rows = [(1, "A B C"), (1, "A"), (1, "A X Y Z U V W"), (1, "NAO COMPRO USO PROPRIO")]
    left, right = spark.createDataFrame(rows, "k int, l string"), spark.createDataFrame([*rows, (1, "AUTO CONSUMO Q S T D F")], "k int, r string")
    found = similarity.similar_pairs(left, right, 0.55, ["k"])
    assert "_nl" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.l, r.r): r.score for r in found.collect()}
    assert got[("A", "A X Y Z U V W")] == 0.9 and got[("NAO COMPRO USO PROPRIO", "AUTO CONSUMO Q S T D F")] == 0.9 and ("A B C", "A X Y Z U V W") not in got


def test_headers_and_not_cells_are_repeated(spark):
    from tabweave.operators import grid

    cells = spark.createDataFrame([("t", 0, 0, "2020", None, "General")], "table_id string, row_ix int, col_ix int, raw string, num double, fmt string")
    known = grid.typed(cells)
    assert grid.typed(known) is known
    plan = grid.header_row(known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "n_header" in plan[plan.index("Generate explode"):]


def test_keys_are_split_once_for_all_contracts():
    from tabweave.operators import labels

    keys = [f"ONLY {i} HERE" for i in range(20)]
    labels._split.cache_clear()
    for _ in range(5):
        assert labels.Choices(keys, keys).take(["HERE 3 ONLY", "ONLY 7"]) == [3, 7]
    assert labels._split.cache_info().misses == 22
