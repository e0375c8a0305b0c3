"""Classifiers by held-out accuracy, embeddings by brute force, the pipeline by its stages."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from tabweave.llm import common, languages, neighbours, quality
from tabweave.llm import queries as registered

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ------------------------------------------------------------------ languages

def test_language_held_out(spark):
    found = registered.op3_ftrl_language(spark, LARGER)
    both = found.join(common.table(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both.lang == both.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("der hund und die katze", "de")] * 30)]
    rows += [(100, None, "en"), (101, "words", None), (None, "the the", "en"), (1, "der hund und die katze", "de")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, doc string")
    model = languages.train(languages.training_rows(docs))
    asked = spark.createDataFrame([(1, "the hat"), (2, "die katze"), (3, None), (4, ""), (5, "12 !!"), (None, "und der hund " * 20_000), (1, "the hat")], "doc_id long, text string")
    found = {(r.doc.doc_id, r.lang) for r in languages.predict(asked, model, ["doc_id"]).collect()}
    assert found == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de")}
    none = languages.train(languages.training_rows(docs.limit(0)))
    assert {r.lang for r in languages.predict(asked, none, ["doc_id"]).collect()} == {"und"}
    assert languages.predict(asked.limit(0), model, ["doc_id"]).count() == 0


def test_language_leader_is_sparse():
    z, n = np.array([0.001, -5.0, 5.0]), np.ones(3)
    w = languages.weights(z, n)
    assert w[0] == 0 and w[1] > 0 > w[2] and abs(w[1] + w[2]) < 1e-12


# -------------------------------------------------------------------- quality

def test_quality_held_out(spark):
    found = registered.op4_subword_quality(spark, LARGER).join(common.table(spark, LARGER, "labels"), "doc_id").where("held_out").toPandas()
    good, bad = found.score[found.quality == 1], found.score[found.quality == 0]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.95
    assert found.predicted[found.quality == 1].mean() > 0.97


def test_quality_odd_rows(spark):
    rows = [(i, "plain words in a row" if i % 2 else "JUNK!! JUNK!! JUNK!!", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(1, "plain words in a row", None, None), (None, None, None, None)], "doc_id long, text string, doc string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, 0, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.training_labels(labels))
    asked = spark.createDataFrame([(1, "plain row"), (2, "JUNK!!"), (3, None), (4, ""), (1, "plain row"), (5, "JUNK!! " * 50_000)], "doc_id long, text string")
    found = {r.doc.doc_id: r.score for r in quality.score(asked, model, ["doc_id"]).collect()}
    assert found[1] > 0.5 > found[2] and found[3] == found[4] and found[5] < 0.5 and all(0 <= s <= 1 for s in found.values())
    none = quality.train(docs, quality.training_labels(labels.limit(0)))
    assert {r.score for r in quality.score(asked, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(asked.limit(0), model, ["doc_id"]).count() == 0


# ------------------------------------------------------------------ embeddings

def plain_links(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    ids = [i for i, _ in good]
    comp = brute.component_rows(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    return sorted((i, int(link[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids))


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 16))
    hub = rng.normal(size=16)
    x[:45] = hub + 0.25 * rng.normal(size=(45, 16))  # a crowded group, more than a list holds
    x[50] = x[51] + 0.01 * rng.normal(size=16)
    x[60:64] = x[64]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [float("inf")] * 16), (204, [None] + [1.0] * 15), (205, [1.0, 2.0]), (206, [])]
    vectors = spark.createDataFrame([(*r, 0, 1.0) for r in rows + odd], "vec_id long, embedding array<double>, id int, links double")
    found = sorted(tuple(r) for r in neighbours.near_vectors(vectors).collect())
    assert found == plain_links(rows) + [(i, 0, i, True) for i, _ in odd]


@pytest.mark.parametrize(("block", "centres"), [(1024, 4096), (8, 2)])
def test_near_vectors_between_saturated_families(spark, monkeypatch, block, centres):
    monkeypatch.setattr(neighbours, "ENLARGED", 0)  # longer lists would hold both families
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CENTRES", centres)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3):  # two families of 12, about 0.99 inside and 0.93 to each other
        x, y = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for v in (x, 0.93 * x + (1 - 0.93**2) ** 0.5 * y):
            rows += [(v + 0.01 * rng.normal(size=32)).tolist() for _ in range(12)]
    rows += rng.normal(size=(60, 32)).tolist()
    rows = list(enumerate(rows))
    found = sorted(tuple(r) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert {r[1] for r in found} == {0, 23}
    assert found == plain_links(rows)


def test_near_vectors_audit_is_not_decided_by_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ENLARGED", 0)
    monkeypatch.setattr(neighbours, "WHOLE", 50)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=32)
    rows = [(hot + 0.01 * rng.normal(size=32)).tolist() for _ in range(150)]
    pairs = [v + d for v in rng.normal(size=(20, 32)) for d in (0, 0.01 * rng.normal(size=32))]
    rows = list(enumerate(rows + [v.tolist() for v in pairs]))
    # lists that know the hot group only, as if the search had missed every pair
    plain = neighbours._refine
    monkeypatch.setattr(neighbours, "_refine", lambda *a: (plain(*a)[0].where("id < 150"), 0))
    found = sorted(tuple(r) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == plain_links(rows)


def test_near_vectors_repeated_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    vectors = spark.createDataFrame([(4, v), (4, v), (6, [2.0, 4.0, 6.0]), (None, v)], "vec_id long, embedding array<double>")
    found = neighbours.near_vectors(vectors).collect()
    assert sorted(tuple(r) for r in found if r.vec_id is not None) == [(4, 2, 4, True)] * 2 + [(6, 2, 4, False)]
    assert [tuple(r) for r in found if r.vec_id is None] == [(None, 0, None, True)]
    assert neighbours.near_vectors(vectors.limit(0)).count() == 0


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, SF, "embeddings").collect()]
    assert sorted(tuple(r) for r in registered.op10_nn_descent(spark, SF).collect()) == plain_links(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 3000).selectExpr("id * 7 % 3001 as a", "(id + 1) * 7 % 3001 as b").repartition(16)
    found = common.components(edges).collect()
    assert len(found) == 3001 and {r.component for r in found} == {0}


# -------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.kept(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality classifier":
            gone = [labels[i] for i in set(before) - set(after) if i in labels]
            assert not any(gone) and all(after[i] == before[i] for i in after)
        elif name == "MinHash near-dedup":
            assert set(after) == {r[0] for r in brute.near_duplicates(texts, 80) if r[3]}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
            assert set(after) == {r[0] for r in brute.benchmark_hits(texts, items) if not r[5]}
        else:
            spans = {r[0]: r[5] for r in brute.secret_spans(texts)}
            assert set(after) == set(before)
            assert all((after[i].text == before[i].text) == (not spans[i]) and (not spans[i] or after[i].n_chars == len(after[i].text)) for i in after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_pipeline_odd_rows(spark):
    rows = [(1, None, None), (None, "a b", "q"), (None, "a b", "q"), (2, "", None), (2, "", None), (3, "x y z", "w"), (3, "another text", "w"), (0, "a b", "v"), (7, "k l m", "u"), (6, "k l m", "t")]
    docs = spark.createDataFrame([(*r, *r[:2], r[2]) for r in rows], "doc_id long, text string, `score` string, row long, `a.b` string, `_nth` string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.kept(stage(spark, docs, SF), "test-stage")
    assert docs.columns == ["doc_id", "text", "score", "row", "a.b", "_nth"]
    left = [(1, None, None), (2, "", None), (2, "", None), (3, "x y z", "w"), (3, "another text", "w"), (0, "a b", "v"), (6, "k l m", "t")]
    assert sorted((tuple(r) for r in docs.collect()), key=str) == sorted([(*r, *r[:2], r[2]) for r in left], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(left)
