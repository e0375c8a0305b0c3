"""Embedding near duplicates by NN-descent: a neighbour graph is refined through neighbours of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept, named, prepare, stream, whole_groups
from .near_duplicates import Union

#: Neighbours of a list, random tables of the start, rows of a start leaf and members of a local join.
LIST, TABLES, LEAF, JOIN = 10, 6, 1000, 256
#: Rounds of refinement at most before lists are enlarged, and the share of changed entries that ends them sooner.
ROUNDS, CHANGED = 6, 0.001
#: Vectors of a stratum whose links are counted exactly against all vectors, and the share of a vector's links that must
#: have been found on average.
AUDIT, RECALL = 256, 0.99
#: Lists are enlarged at most so often where the audit asks for it, before all vectors are compared.
ENLARGED = 3
#: Vectors of a component compared in one block, centres of blocks compared in one lot, and vectors of a block where all are compared.
BLOCK, CENTRES, WHOLE = 1024, 4096, 4096


def unit(blobs: list[bytes], kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _best(ids: np.ndarray, v: np.ndarray, size: int, limit: np.ndarray | None = None, known: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``size`` nearest other rows: (id, other, distance).  With ``limit``, only those nearer than the
    row's limit and not yet in its list ``known``."""
    near = 1.0 - (v @ v.T).astype(float)
    near[ids[:, None] == ids[None, :]] = np.inf
    if limit is not None:
        near[near >= limit[:, None]] = np.inf
        place = {int(i): k for k, i in enumerate(ids)}
        for k, others in enumerate(known):
            at = [place[o] for o in others if o in place]
            near[k, at] = np.inf
    size = min(size, len(ids) - 1)
    if size < len(ids) - 1:
        pick = np.argpartition(near, size - 1, axis=1)[:, :size]
    else:
        pick = np.tile(np.arange(len(ids)), (len(ids), 1))
    d = np.take_along_axis(near, pick, 1)
    row, col = np.nonzero(np.isfinite(d))
    return ids[row], ids[pick[row, col]], np.round(d[row, col], 7)


def _batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, float))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "other", "d"])


EDGES = "id long, other long, d double"


def _start(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 2):
            ids, blobs, found = table.column("id").to_numpy(), table.column("v"), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for part in range(a, b, 2 * LEAF):  # hash leaves may be uneven
                    end = min(b, part + 2 * LEAF)
                    if end - part > 1:
                        found.append(_best(ids[part:end], unit(blobs[part:end].to_pylist()), size))
            yield _batch(found)

    return run


def _local_join(size: int):
    """Compare the members of each node's neighbourhood and tell each of better neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 2):
            ids, limit, v = table.column("x").to_numpy(), table.column("limit").to_numpy(), table.column("v")
            known, found = table.column("known").to_pylist(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for part in range(a, b, 2 * JOIN):
                    own, where = np.unique(ids[part:min(b, part + 2 * JOIN)], return_index=True)
                    if len(own) > 1:
                        where += part
                        found.append(_best(own, unit([v[int(w)].as_py() for w in where]), size, limit[where], [known[w] for w in where]))
            yield _batch(found)

    return run


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """The ``size`` nearest of each node's entries, of which there are boundedly many."""
    entries = F.array_sort(F.collect_set(F.struct("d", "other")))  # distances are rounded, so an entry found twice is one
    return edges.groupBy("id").agg(F.slice(entries, 1, size).alias("near"))


def _refine(nodes: DataFrame, lists: DataFrame, size: int, round_: int) -> tuple[DataFrame, int]:
    """One round: every node's neighbours, and those it is a neighbour of, meet each other."""
    limit = F.when(F.size("near") < size, F.lit(4.0)).otherwise(F.element_at("near", -1)["d"])
    state = nodes.select("id", "v").join(lists, "id", "left").select(
        F.col("id").alias("x"), "v", F.coalesce(limit, F.lit(4.0)).alias("limit"), F.coalesce(F.transform("near", lambda e: e["other"]), F.array().cast("array<long>")).alias("known"))
    state = kept(state, "neighbour-state")
    ahead = lists.select(F.col("id").alias("u"), F.explode(F.col("near")["other"]).alias("x"))
    around = ahead.union(ahead.select(F.col("x").alias("u"), F.col("u").alias("x"))).union(lists.select(F.col("id").alias("u"), F.col("id").alias("x")))
    # a node that very many have as a neighbour meets them in lots, dealt anew each round
    hubs = around.groupBy("u").count().where(F.col("count") > JOIN).select("u", F.ceil(F.col("count") / JOIN).cast("long").alias("lots"))
    dealt = around.join(kept(hubs, "neighbour-hubs"), "u", "left")
    dealt = dealt.select("u", F.pmod(F.xxhash64("x", F.lit(round_)), F.coalesce("lots", F.lit(1))).alias("lot"), "x")
    met = dealt.join(state, "x").select("u", "lot", "x", "limit", "known", "v")
    better = met.repartition("u", "lot").sortWithinPartitions("u", "lot").mapInArrow(_local_join(size), EDGES)
    better = kept(_lists(better, size), "neighbour-better")
    changed = better.agg(F.sum(F.size("near"))).first()[0] or 0
    old = lists.select("id", F.inline("near")).select("id", "other", "d")
    new = better.select("id", F.inline("near")).select("id", "other", "d")
    return kept(_lists(old.union(new), size), "neighbour-lists"), changed


def _count_links(threshold: float, keys: int = 2):
    """(id, other, links): the links of each row of a pair of blocks, where other is the id itself, and pairs without links that connect
    what the links connect.  A block's own pairs are counted where it meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            ids, own, other, copies = (table.column(c).to_numpy() for c in ("id", "own", "other", "copies"))
            exact, out = table.column("exact"), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                v, sets = unit(exact[a:b].to_pylist(), float), Union(b - a)
                for s in range(0, b - a, 256):
                    link = v[s:s + 256] @ v.T >= threshold
                    link[np.arange(len(link)), s + np.arange(len(link))] = False
                    if own[a] != other[a]:
                        link &= own[a:b][s:s + 256, None] != own[a:b][None, :]
                    out.append((ids[a + s:a + s + len(link)], ids[a + s:a + s + len(link)], link @ copies[a:b]))
                    for x in np.flatnonzero(link.any(axis=1)).tolist():
                        to = ids[a + sets.join(s + x, np.flatnonzero(link[x]))]
                        out.append((np.full(len(to), ids[a + s + x]), to, np.zeros(len(to), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], ["id", "other", "links"])

    return run


LINKS = "id long, other long, links long"


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, own, centre, reach) of each block: its mean direction and the largest angle of a member to it."""
    for table, bounds in whole_groups(batches, 2):
        exact, centres, reach = table.column("exact"), [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            v = unit(exact[a:b].to_pylist(), float)
            centre = v.sum(axis=0)
            length = np.sqrt((centre * centre).sum())
            centre = centre / length if length > 1e-6 else np.zeros_like(centre)
            centres.append(centre.tobytes())
            reach.append(math.acos(min(1.0, max(-1.0, float((v @ centre).min())))) if length > 1e-6 else math.pi)
        columns = [*(pa.array(table.column(c).to_numpy()[bounds[:-1]]) for c in ("component", "own")), pa.array(centres, pa.binary()), pa.array(reach)]
        yield pa.RecordBatch.from_arrays(columns, ["component", "own", "centre", "reach"])


def _near_centres(threshold: float):
    """(ca, oa, cb, ob): the blocks of two components that may hold a link, as the angle between their centres is at most that of a link
    and both reaches."""
    angle = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 1):
            component, own, lot, reach = (table.column(c).to_numpy() for c in ("component", "own", "lot", "reach"))
            centres = table.column("centre")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                v, c, o, r = unit(centres[a:b].to_pylist(), float), component[a:b], own[a:b], reach[a:b]
                for s in range(0, b - a, 256):
                    near = np.arccos(np.clip(v[s:s + 256] @ v.T, -1, 1)) <= r[s:s + 256, None] + r[None, :] + angle
                    near &= c[s:s + 256, None] < c[None, :]
                    if lot[a:b].min() != lot[a:b].max():
                        near &= lot[a:b][s:s + 256, None] != lot[a:b][None, :]
                    x, y = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(k) for k in (c[s + x], o[s + x], c[y], o[y])], ["ca", "oa", "cb", "ob"])

    return run


def _across(inside: DataFrame, threshold: float) -> DataFrame:
    """Links between the crowded components, as by ``_count_links``: only blocks that are near enough meet."""
    blocks = inside.select("component", "own", "exact").repartition("component", "own").sortWithinPartitions("component", "own")
    centres = kept(blocks.mapInArrow(_centres, "component long, own long, centre binary, reach double"), "neighbour-centres")
    lots = max(1, math.ceil(centres.count() / CENTRES))
    dealt = centres.withColumn("lot", F.pmod(F.xxhash64("component", "own"), F.lit(lots))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))))
    # where several lots are, the pairs of a lot are compared where it meets itself
    dealt = dealt.select((F.least("lot", "to") * lots + F.greatest("lot", "to")).alias("pair"), "component", "own", "lot", "centre", "reach")
    near = dealt.repartition("pair").sortWithinPartitions("pair").mapInArrow(_near_centres(threshold), "ca long, oa long, cb long, ob long")
    near = kept(near, "neighbour-near-blocks")
    sides = []
    for k, (c, o) in enumerate((("ca", "oa"), ("cb", "ob"))):
        side = inside.select(F.col("component").alias(c), F.col("own").alias(o), "id", "copies", "exact")
        sides.append(near.join(side, [c, o]).select("ca", "oa", "cb", "ob", "id", F.lit(k).cast("long").alias("own"), F.lit(1 - k).cast("long").alias("other"), "copies", "exact"))
    keys = ["ca", "oa", "cb", "ob"]
    return kept(sides[0].union(sides[1]).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count_links(threshold, 4), LINKS), "neighbour-across")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector scaled to length 1, in doubles and in floats."""
    for batch in batches:
        x = np.array(batch.column("vec").to_pylist(), float)
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top  # so that squares neither overflow nor vanish
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("copies"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())],
            ["id", "copies", "exact", "v"])


def _codes(bits: int, tables: int, width: int):
    """(table, leaf, id, v): the signs of each vector along random directions, in several tables."""
    axes = (((stream(width * bits * tables, 31) >> np.uint64(11)).astype(float) / 2.0**53) - 0.5).reshape(width, tables * bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signs = (unit(batch.column("v").to_pylist()) @ axes > 0).reshape(n, tables, bits)
            code = (signs * (1 << np.arange(bits))).sum(axis=2)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int64)), pa.array(code[:, t]), batch.column("id"), batch.column("v")], ["table", "leaf", "id", "v"])

    return run


def _exact_links(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The edges (a < b) whose cosine in doubles reaches the threshold."""
    far = 1 - threshold + 1e-5  # of the distances in single precision
    pairs = edges.where(F.col("d") <= far).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    left, right = (nodes.select(F.col("id").alias(c), F.col("exact").alias(f"v{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (unit(batch.column(c).to_pylist(), float) for c in ("va", "vb"))
                good = (x * y).sum(axis=1) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    return kept(both.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long"), "neighbour-links")


def _counted(links: DataFrame, lists: DataFrame, nodes: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, component), (id, links) and the crowded components.  A node whose list is full of links may have more: then the lists of its component are
    enlarged to the whole component and to the other components of such nodes near enough, and counted in blocks.  Other nodes'
    lists have all links, also those to the former."""
    members = kept(components(links, "neighbour-components").select(F.col("node").alias("id"), "component"), "neighbour-members")
    full = lists.where((F.size("near") >= size) & (F.element_at("near", -1)["d"] <= 1 - threshold + 1e-5)).select("id")
    crowded = members.join(full, "id").select("component").distinct().join(members.groupBy("component").count(), "component")
    crowded = kept(crowded.select("component", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "neighbour-crowded")
    inside = members.join(crowded, "component").join(nodes.select("id", "copies", "exact"), "id").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    inside = kept(inside, "neighbour-inside")
    met = inside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("component", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), "id", "own", "other", "copies", "exact")
    counts = met.repartition("component", "pair").sortWithinPartitions("component", "pair").mapInArrow(_count_links(threshold), LINKS)
    across = _across(inside, threshold)
    apart = links.join(members.select(F.col("id").alias("a"), "component"), "a").join(crowded.select("component"), "component", "left_anti")
    ends = apart.select(F.col("a").alias("id"), F.col("b").alias("to")).union(apart.select(F.col("b").alias("id"), F.col("a").alias("to")))
    listed = ends.join(nodes.select(F.col("id").alias("to"), "copies"), "to").select("id", F.col("copies").alias("links"))
    counts = counts.union(across).select("id", "links").union(listed).groupBy("id").agg(F.sum("links").alias("links"))
    bridges = across.where("id != other")
    if not bridges.isEmpty():
        a, b = (members.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("id", "other"))
        merged = components(bridges.join(a, "id").join(b, "other").select("cid", "cother").distinct(), "neighbour-merged")
        members = members.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
        members = kept(members.select("id", F.coalesce("least", "component").alias("component")), "neighbour-members")
        crowded = crowded.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
        crowded = crowded.select(F.coalesce("least", "component").alias("component")).distinct()
    return members, kept(counts, "neighbour-counts"), crowded


def _audited(nodes: DataFrame, members: DataFrame, crowded: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Share of its links that ``counts`` has for a vector, counted against every vector: the mean over vectors with any link, of crowded
    components or of others, whichever is less.

    A fixed number is drawn from each of crowded components, other components and vectors without found links.  The last two
    are one mean, weighted by the vectors that each stands for, so a few lost links of very many single vectors are not outweighed."""
    kinds = nodes.select("id", "exact").join(members, "id", "left").join(crowded.select("component", F.lit(0).alias("crowded")), "component", "left")
    kinds = kinds.select("id", "exact", F.coalesce("crowded", F.when(F.col("component").isNotNull(), 1).otherwise(2)).alias("kind"))
    sizes = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    asked = [r for k in sizes for r in kinds.where(F.col("kind") == k).orderBy(F.xxhash64("id"), "id").limit(AUDIT).collect()]
    if not asked:
        return 1.0
    ids, v = np.array([r.id for r in asked]), unit([bytes(r.exact) for r in asked], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = unit(batch.column("exact").to_pylist(), float) @ v.T >= threshold
                links += (near & (batch.column("id").to_numpy()[:, None] != ids[None, :])).T @ batch.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], ["id", "true_links"])

    true = nodes.select("id", "copies", "exact").mapInArrow(run, "id long, true_links long").groupBy("id").agg(F.sum("true_links").alias("n"))
    share = {r.id: r.share for r in true.where("n > 0").join(counts, "id", "left").select("id", (F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")).alias("share")).collect()}
    drawn = {k: [share.get(r.id) for r in asked if r.kind == k] for k in sizes}
    means = []
    for part in ((0,), (1, 2)):
        known = [(x, sizes[k] / len(drawn[k])) for k in part for x in drawn.get(k, ()) if x is not None]
        if known:
            means.append(sum(x * w for x, w in known) / sum(w for _, w in known))
    return min(means, default=1.0)


def _compared(nodes: DataFrame, total: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, component) and (id, links) from all pairs of blocks of all vectors."""
    blocks = max(1, math.ceil(total / WHOLE))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")
    met = nodes.select("id", "copies", "exact", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = met.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("pair"), "id", "own", "other", "copies", "exact")
    found = kept(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(_count_links(threshold, 1), LINKS), "neighbour-compared")
    members = components(found.where("id != other").select("id", "other"), "neighbour-components").select(F.col("node").alias("id"), "component")
    return kept(members, "neighbour-members"), kept(found.groupBy("id").agg(F.sum("links").alias("links")), "neighbour-counts")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", size: int = LIST) -> DataFrame:
    """One row per row of ``vectors``: (id_col, n_links, component_id, kept) under links of cosine >= ``threshold`` in doubles.

    NN-descent: lists of the nearest few start from leaves of random sign codes; in each round the neighbours of a node and those
    it is a neighbour of are compared with each other, until few entries change.  Entries over the threshold, confirmed in doubles, are
    links.  Components with a saturated list (all links) enlarge it to the component and to the other such components, whose links are counted in
    pairs of blocks; blocks too far apart by their centres and reaches do not meet.  An audit counts all links of
    256 vectors of crowded components, of other components and without links against all vectors; while a vector has under 99 % of its
    links on average, in crowded components or elsewhere, the lists are doubled and refined again, three times at most.  Lists that
    still fail are given up, and all vectors are compared in blocks.

    Equal vectors are one node with a number of copies.  n_links counts the other vectors linked directly, component_id is the smallest id reachable,
    itself included, and kept marks it.  A vector that is null, zero, of another length than the most frequent one (of ties the
    shortest), or holds null or non-finite components, links with nothing and is kept.  Rows of one id are one vector for components; a null
    id is kept without links.  An empty table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    prepare(spark)
    vec = named(vec_col).cast("array<double>")
    rows = kept(vectors.select(named(id_col).cast("long").alias("id"), vec.alias("vec")), "neighbour-rows")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(F.col("vec").isNotNull() & F.col("id").isNotNull()).where(finite & F.exists("vec", lambda x: x != 0))
    usual = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = usual.n if usual else 1
    nodes = good.where(F.size("vec") == width).groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = kept(nodes, "neighbour-classes")
    units = kept(nodes.select("id", "copies", "vec").mapInArrow(_units, "id long, copies long, exact binary, v binary"), "neighbour-units")
    total = units.count()
    bits = max(1, math.ceil(math.log2(max(2, total) / (LEAF // 4))))
    leaves = units.select("id", "v").mapInArrow(_codes(bits, TABLES, width), "table long, leaf long, id long, v binary")
    lots = F.xxhash64("table", "leaf", F.pmod(F.xxhash64("id", "table"), F.coalesce("lots", F.lit(1))))
    sizes = leaves.groupBy("table", "leaf").count().where(F.col("count") > LEAF).select("table", "leaf", F.ceil(F.col("count") / LEAF).cast("long").alias("lots"))
    dealt = leaves.join(kept(sizes, "neighbour-leaves"), ["table", "leaf"], "left").select("table", lots.alias("lot"), "id", "v")
    lists = kept(_lists(dealt.repartition("table", "lot").sortWithinPartitions("table", "lot").mapInArrow(_start(size), EDGES), size), "neighbour-lists")
    for enlarged in range(ENLARGED + 1):
        for round_ in range(ROUNDS):
            lists, changed = _refine(units, lists, size, round_ + ROUNDS * enlarged)
            if changed <= CHANGED * total * size:
                break
        edges = lists.select("id", F.inline("near")).select("id", "other", "d")
        links = _exact_links(edges, units, threshold)
        members, counts, crowded = _counted(links, lists, units, size, threshold)
        if _audited(units, members, crowded, counts, threshold) >= RECALL:
            break
        size *= 2
    else:
        members, counts = _compared(units, total, threshold)
    known = units.select("id", "copies").join(members, "id", "left").join(counts, "id", "left")
    known = known.join(nodes.select("id", "vec"), "id").select("vec", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(known, "vec", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
