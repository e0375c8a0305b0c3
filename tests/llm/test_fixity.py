"""The fixity audit locates every altered, lost and added record."""

from tabweave.llm import fixity


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, node long")


def test_audit_locates_damage(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE_BYTES", 64)
    monkeypatch.setattr(fixity, "FAN", 2)
    rows = [(i, f"u{i}", "x" * (i * 37 % 90)) for i in range(200)] + [(300, None, ""), (301, "", None), (None, "no id", "y"), (302, "long", "z" * 100_000)]
    damaged = [(i, u, "changed" if i in (7, 150, 302) else h) for i, u, h in rows if i not in (3, 199)] + [(999, "new", "n")]
    found = {r.page_id: r for r in fixity.audit(frame(spark, rows), frame(spark, damaged), "page_id", ["url", "html"]).collect()}
    assert set(found) == {r[0] for r in rows} | {999}
    assert {i for i, r in found.items() if not r.intact} == {3, 7, 150, 199, 302, 999}
    assert found[3].replica_hash is None and found[999].first is None and found[7].hash != found[7].replica_hash
    spans = sorted((r.first, r.past) for r in found.values() if r.first is not None)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_audit_odd_tables(spark):
    rows = [(1, "a", "b"), (1, "a", "b"), (2, None, None)]
    same = fixity.audit(frame(spark, rows), frame(spark, rows), "page_id", ["url", "html"]).collect()
    assert len(same) == 3 and all(r.intact for r in same)
    lost = fixity.audit(frame(spark, rows), frame(spark, []), "page_id", ["url", "html"]).collect()
    assert len(lost) == 3 and not any(r.intact for r in lost)
    assert fixity.audit(frame(spark, []), frame(spark, []), "page_id", ["url", "html"]).count() == 0


def test_only_damaged_ranges_are_suspected(spark, monkeypatch):
    """A lost or added record spoils its own range only, and records of other ranges reach no join."""
    monkeypatch.setattr(fixity, "RANGE_BYTES", 256)
    monkeypatch.setattr(fixity, "FAN", 3)
    rows = [(i * 10, f"u{i}", "x" * (i * 31 % 70)) for i in range(500)]
    own = fixity.layout(frame(spark, rows), "page_id", ["url", "html"])
    node = {r.id: r.node for r in own.collect()}
    bounds = own.groupBy("node").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    for gone, new, changed in (({50}, set(), set()), (set(), {1005}, set()), ({4990}, {-3, 9999}, {2000, 2010}), (set(), set(), set())):
        damaged = [(i, u, "!" if i in changed else h) for i, u, h in rows if i not in gone] + [(i, "new", "") for i in new]
        theirs = fixity.in_ranges(fixity.hashed(frame(spark, damaged), "page_id", ["url", "html"]), bounds)
        spoilt = {r.node for r in fixity.compare(own, theirs).collect()}
        near = {max((k for k in node if k <= i), default=0) for i in new}
        assert spoilt == {node[i] for i in gone | changed | near}


def test_hot_ids_and_a_replica_only(spark):
    rows = [(None, f"u{i % 3}", "x") for i in range(300)] + [(5, "a", "b")] * 50
    found = fixity.audit(frame(spark, rows), frame(spark, [r for r in rows if r[1] != "u1"]), "page_id", ["url", "html"]).collect()
    assert len(found) == 350 and sum(not r.intact for r in found) == 100
    extra = fixity.audit(frame(spark, []), frame(spark, rows), "page_id", ["url", "html"]).collect()
    assert {r.page_id for r in extra} == {None, 5} and not any(r.intact for r in extra)
