"""Remembered mappings against a sequential reading of the rule."""

import random

from pyspark.sql import functions as F

from tabweave.operators import joins, learning

ENTRY = "entry_ix bigint, names array<string>, basename string, fingerprint string, signature string, cats array<string>, sers array<string>"
SOURCE = "table_id string, table_ix bigint, signature string, cats array<string>, sers array<string>"


def test_resolution_by_name_signature_and_fingerprint(spark):
    entries = spark.createDataFrame([
        (0, ["T1"], "gone.xlsx", "f1", "sigA", ["A"], ["X"]), (1, ["old"], "b.xlsx", "f2", "none", ["B"], ["X"]),
        (2, ["T1"], "c.xlsx", "f1", "none", ["C"], ["X"]), (3, ["T3"], "b.xlsx", "f3", "none", ["Z"], ["Q"])], ENTRY)
    aliases = spark.createDataFrame([("T1", "T1", 0), ("T2", "T2", 1), ("T3", "T3", 2)], "alias string, target_id string, target_ix bigint")
    prints = spark.createDataFrame([("T1", "f1"), ("T2", "f2"), ("T3", "f3")], "target_id string, fingerprint string")
    sources = spark.createDataFrame([("dir/new.xlsx", 0, "sigA", ["A"], ["X"]), ("dir/B.xlsx", 1, "sigB", ["B"], ["X"]), ("dir/c.xlsx", 2, "sigC", ["C"], ["X"])], SOURCE)
    got = learning.resolve_learned(entries, aliases, prints, sources)
    # T1 by signature, T2 by fingerprint and name; T1 is not mapped twice and B is not reused
    assert {(r["entry_ix"], r["target_id"], r["table_id"]) for r in got.collect()} == {(0, "T1", "dir/new.xlsx"), (1, "T2", "dir/B.xlsx")}


def test_upsert_keeps_what_may_not_be_replaced(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    over = spark.createDataFrame([("a", 9, False), ("b", 9, True), ("c", 9, False)], "id string, v int, replace boolean")
    got = {(r["id"], r["v"], r["origin"]) for r in joins.override_upsert(base, over, "id", "replace").collect()}
    assert got == {("a", 1, "kept"), ("b", 9, "replaced"), ("c", 9, "added")}


def test_interval_join_finds_each_pair_once(spark):
    left = spark.createDataFrame([("k", i, i + 5) for i in range(0, 40, 3)], "k string, l0 int, l1 int")
    right = spark.createDataFrame([("k", i, i + 9) for i in range(0, 40, 7)], "k string, r0 int, r1 int")
    got = sorted((r["l0"], r["r0"]) for r in joins.overlap_join(left, right, ["k"], ("l0", "l1", "r0", "r1")).collect())
    want = sorted((a, b) for a in range(0, 40, 3) for b in range(0, 40, 7) if a <= b + 9 and b <= a + 5)
    assert got == want


PLAN = "target_id string, table_id string, fingerprint string, confidence double"


def test_learning_goes_on_after_a_restart(spark, tmp_path):
    """A second process finds the current version in the store, a replayed batch changes nothing, and a lost manifest leaves the version before."""
    from tabweave.sources.keyed import KeyedTable
    from tabweave.streaming.logs import learn_stream

    root, log = str(tmp_path / "store"), str(tmp_path / "plans")

    def run(rows):
        plans = spark.createDataFrame(rows, PLAN)
        plans.coalesce(1).write.mode("append").json(log)
        learn_stream(spark.readStream.schema(plans.schema).json(log), KeyedTable(root, "entry_id", learning.ENTRIES, 16), str(tmp_path / "ckpt")).awaitTermination()
        store = KeyedTable(root, "entry_id", learning.ENTRIES, 16)
        return store, {(r["entry_id"], r["table_id"], r["range_mode"]) for r in store.read(spark).collect()}

    assert KeyedTable(root, "entry_id", learning.ENTRIES).read(spark).collect() == []
    store, got = run([("t1", "s1", "f1", 0.9), ("t2", "s2", "f2", 0.5)])
    assert got == {("t1", "s1", "exact"), ("t2", "s2", "exact")} and store.version(spark) == 0
    store, got = run([("t2", "s9", "f2", 0.5), ("t3", "s3", "f3", 0.5)])
    assert got == {("t1", "s1", "exact"), ("t2", "s9", "exact"), ("t3", "s3", "exact")} and store.version(spark) == 1
    assert {r["table_id"] for r in store.read(spark, 0).collect()} == {"s1", "s2"}
    replay = store.read(spark).where("entry_id = 't1'").withColumn("table_id", F.lit("other"))
    assert store.upsert(replay, 1) == 0 and store.version(spark) == 1
    # data of a version whose manifest never came
    replay.withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{root}/data/version=2")
    assert {r["table_id"] for r in store.read(spark).collect()} == {"s1", "s9", "s3"}
    assert store.upsert(replay, 2) == 1 and {r["table_id"] for r in store.read(spark).collect()} == {"other", "s9", "s3"}


def test_writes_grow_with_the_batch(spark, tmp_path):
    from tabweave.sources.keyed import KeyedTable

    store = KeyedTable(str(tmp_path / "t"), "id", "id long, v long", 64)
    assert store.upsert(spark.range(5000).selectExpr("id", "id v"), 0) == 64
    assert store.upsert(spark.createDataFrame([(7, -1), (9000, -2)], "id long, v long"), 1) <= 2
    written = spark.read.parquet(str(tmp_path / "t/data/version=1")).count()
    assert written < 5000 / 64 * 4
    got = {r.id: r.v for r in store.read(spark).collect()}
    assert len(got) == 5001 and got[7] == -1 and got[9000] == -2 and got[8] == 8
    assert store.upsert(spark.createDataFrame([], "id long, v long"), 2) == 0 and store.read(spark).count() == 5001


def test_entries_keep_their_order_and_can_be_read_again(spark):
    stored = spark.createDataFrame([("b", "s0", "f9", 0.1, "A1:B2", "dynamic", "0", 4, None, None, None, None, None)], learning.ENTRIES)
    plans = spark.createDataFrame([("a", "dir/x.xlsx", "f1", 0.9, 0, ["a", "alt"], "x.xlsx", "sig", ["C"], ["S"]), ("b", "dir/y.xlsx", "f2", 0.8, 1, ["b"], "y.xlsx", "sig2", ["D"], ["T"])],
                                  PLAN + ", plan_ix long, aliases array<string>, basename string, signature string, cats array<string>, sers array<string>")
    out = {r.entry_id: r for r in learning.learn_mappings(stored, plans, "1").collect()}
    assert (out["b"].entry_ix, out["b"].cell_range, out["b"].range_mode, out["a"].entry_ix) == (4, "A1:B2", "dynamic", 5)
    entries = learning.as_entries(learning.learn_mappings(stored, plans, "1"))
    # both contracts have new names, one source too
    aliases = spark.createDataFrame([("alt", "new a", 0)], "alias string, target_id string, target_ix bigint")
    prints = spark.createDataFrame([("new a", "g1"), ("new b", "f2")], "target_id string, fingerprint string")
    sources = spark.createDataFrame([("dir/renamed.xlsx", 0, "sig", ["C"], ["S"]), ("dir/y.xlsx", 1, "other", ["D"], ["T"])], SOURCE)
    got = learning.resolve_learned(entries, aliases, prints, sources).collect()
    assert {(r.target_id, r.table_id, r.step) for r in got} == {("new a", "dir/renamed.xlsx", 1), ("new b", "dir/y.xlsx", 0)}


def test_regions_meet_in_two_dimensions(spark):
    """Nested, touching, crossing and very large regions, beside single cells."""
    rng = random.Random(6)

    def box():
        r, c = rng.randint(-20, 60), rng.randint(0, 30)
        h, w = rng.choice([0, 0, 1, 3, 4, 7, 500]), rng.choice([0, 1, 2, 8, 31])
        return r, c, r + h, c + w

    left = [(i, i % 2, *box()) for i in range(120)] + [(500, 0, 0, 0, 1 << 30, 40), (501, 1, 8, 8, 15, 15)]
    right = [(i, i % 2, *box()) for i in range(120)] + [(500, 0, 16, 0, 16, 0), (501, 1, 15, 15, 15, 15), (502, 1, 16, 15, 20, 20)]
    schema = "{0} int, k int, {0}r0 int, {0}c0 int, {0}r1 int, {0}c1 int"
    hit = joins.overlap_join(spark.createDataFrame(left, schema.format("l")), spark.createDataFrame(right, schema.format("r")), ["k"],
                             ("lr0", "lr1", "rr0", "rr1"), ("lc0", "lc1", "rc0", "rc1"))
    got = sorted((r["l"], r["r"]) for r in hit.collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5])
    assert got == want and set(hit.columns) == {"k", *[f"{s}{x}" for s in "lr" for x in ("", "r0", "c0", "r1", "c1")]}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_alike_sets_are_found_among_few_candidates(spark):
    """Every set has the label TOTAL; candidates grow with the sets that are alike."""
    rng = random.Random(7)
    sets = []
    for g in range(60):
        base = {f"G{g} {i}" for i in range(rng.randint(2, 9))} | {"TOTAL"}
        sets += [base, base - {rng.choice(sorted(base))}, base | {f"X{g}"}]
    sets += [{"TOTAL"}, {"TOTAL"}, set(), {"TOTAL", "A"}]
    left = spark.createDataFrame([(f"e{i}", p, sorted(s)) for i, s in enumerate(sets) for p in "cs"], "eset string, part string, labels array<string>")
    right = spark.createDataFrame([(f"s{i}", p, sorted(s)) for i, s in enumerate(sets) for p in "cs"], "sset string, part string, labels array<string>")
    got = {(r.eset, r.sset) for r in learning.set_candidates(left, right, 0.6).collect()}
    need = {(f"e{i}", f"s{j}") for i, a in enumerate(sets) for j, b in enumerate(sets) if jaccard(a, b) >= 0.6}
    assert need <= got and len(got) < 3 * len(need) < len(sets) ** 2 / 10


def test_source_candidates_equal_all_pairs(spark):
    rng = random.Random(8)
    labels = [f"L{i}" for i in range(12)]
    pick = lambda: rng.sample(labels, rng.randint(0, 5))
    entries = [(i, "", "", pick(), pick()) for i in range(40)]
    sources = [(f"t{i}", i, "s", pick(), pick()) for i in range(40)]
    found = learning.source_candidates(
        spark.createDataFrame(entries, "entry_ix long, basename string, signature string, cats array<string>, sers array<string>"),
        spark.createDataFrame(sources, "table_id string, table_ix long, signature string, cats array<string>, sers array<string>"))
    got = {(r.entry_ix, r.table_id): r.score for r in found.collect()}
    every = {(e[0], s[0]): (jaccard(set(e[3]), set(s[3])) + jaccard(set(e[4]), set(s[4]))) / 2 for e in entries for s in sources}
    assert got == {p: w for p, w in every.items() if w >= 0.6} and got


def test_best_sources_equal_the_first_of_all_pairs(spark):
    """By name, by signature and by labels, with several sources of equal names, signatures and labels, and ties of the score."""
    rng = random.Random(9)
    labels = [f"L{i}" for i in range(6)]
    pick = lambda: rng.sample(labels, rng.randint(0, 5))
    entries = [(i, rng.choice(["", f"t{i % 9}", "gone"]), rng.choice(["", "none", f"s{i % 7}"]), pick(), pick()) for i in range(60)]
    sources = [(f"{d}/T{i % 12}", 100 - i, f"s{i % 5}", pick(), pick()) for i, d in enumerate("abcdefghij" * 4)]
    frames = (spark.createDataFrame(entries, "entry_ix long, basename string, signature string, cats array<string>, sers array<string>"),
              spark.createDataFrame(sources, "table_id string, table_ix long, signature string, cats array<string>, sers array<string>"))
    order = lambda r: (r.step, -round(r.score, 9), r.table_ix)
    want = {}
    for r in sorted(learning.source_candidates(*frames).collect(), key=order):
        want.setdefault(r.entry_ix, (r.table_id, r.step, round(r.score, 9)))
    got = learning.source_candidates(*frames, best=True).collect()
    assert {r.entry_ix: (r.table_id, r.step, r.score) for r in got} == want and len(got) == len(want)
    assert {step for _, step, _ in want.values()} == {0, 1, 2}


def test_entries_meet_the_sources_of_all_blocks(spark, monkeypatch):
    """A sheet that only another block has is found by its labels."""
    from tabweave.queries import joining

    tables = [(k, f"sales/t{k}.xlsx#Data", k, 1 + k // 6, [f"Y{i}" for i in range(4)], [f"N{i}" for i in range(9 + k // 6)]) for k in (1, 20)]

    class Given:
        def source_tables(self):
            return spark.createDataFrame(tables, "k long, table_id string, table_ix long, block_id int, categories array<string>, series array<string>")

        def targets(self):
            return spark.createDataFrame([(1, "T1", "chart", ["A"], ["B"])], "k long, target_id string, object_type string, categories array<string>, series array<string>")

        def role(self, name):
            return spark.createDataFrame([(1, "T1", "x", "gone.xlsx")], "entry_ix long, entry_id string, alias string, basename string")

    # the entry's own sheet has gone
    full = joining.with_renamed
    monkeypatch.setattr(joining, "with_renamed", lambda src: full(src).where("k <> 1"))
    assert [tuple(r) for r in joining.cascade_join(Given()).collect()] == [(1, "sales/t20.xlsx#Data", 2)]


def test_pairs_of_sets_move_as_numbers(spark, monkeypatch):
    """Labels are sent to cells of sets; pairs and scores are numbers, whatever the size of a cell."""
    rng = random.Random(10)
    pick = lambda: rng.sample([f"L{i}" for i in range(9)], rng.randint(0, 6))
    entries = spark.createDataFrame([(i, "", "", pick(), pick()) for i in range(50)], "entry_ix long, basename string, signature string, cats array<string>, sers array<string>")
    sources = spark.createDataFrame([(f"t{i}", i, "s", pick(), pick()) for i in range(50)], "table_id string, table_ix long, signature string, cats array<string>, sers array<string>")
    kept, cut = {}, learning.cut_lineage
    monkeypatch.setattr(learning, "cut_lineage", lambda df, name="step": kept.setdefault(name, cut(df, name)))
    whole = sorted(map(tuple, learning.source_candidates(entries, sources).collect()))
    assert {t for name in ("near-sets", "set-scores") for _, t in kept[name].dtypes} == {"bigint", "double"}
    kept.clear()
    monkeypatch.setattr(learning, "SET_BITS", 1)
    assert sorted(map(tuple, learning.source_candidates(entries, sources).collect())) == whole and whole
