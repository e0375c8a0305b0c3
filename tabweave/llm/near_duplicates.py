"""MinHash near duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, components, kept, map_texts, mix, named, pair_batch, runs_hash, stream, text_pieces, whole_groups, words_of

#: Words of a shingle.
SHINGLE = 5
#: Share of links that the distance of signatures may miss, at the threshold itself; more similar pairs are missed less.
MISSED = 1e-4
#: Signatures of a key, and bytes of shingle sets of a cluster, that one block holds.
KEY_BLOCK, SET_BLOCK_BYTES = 16_384, 16 << 20

FIELDS = "n_shingles long, set_a long, set_b long, signature binary, keys array<long>"


def signature_plan(per_cent: int) -> tuple[int, int]:
    """Symbols (one byte each, so b = 8) of a signature and chunks it is cut into.  A chunk may hold one wrong symbol, so all pairs that differ in
    fewer than twice as many symbols as there are chunks share a chunk key.  The fewest symbols are taken at which a pair of the wanted similarity differs
    in more with a probability of at most ``MISSED``; chunks have 4.5 symbols, so that keys stay rare."""
    p = 1 - per_cent / 100
    for symbols in range(32, 129, 8):
        chunks = int(symbols / 4.5)
        if sum(math.comb(symbols, k) * p**k * (1 - p) ** (symbols - k) for k in range(2 * chunks, symbols + 1)) <= MISSED:
            return symbols, chunks
    raise ValueError(f"a similarity of {per_cent} % is too low for signatures of 128 symbols")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than a shingle are one shingle, no words none."""
    _, _, row, h = words_of(data, offsets, NOT_SPACE)
    first = np.searchsorted(row, np.arange(len(offsets)))
    runs = runs_hash(h, shingle)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(runs[a:b - shingle + 1])
        else:
            yield runs_hash(h[a:b], b - a) if b > a else runs[:0]


def signature(own: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The low byte of the smallest of each seed's permutation of the set."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max)
    for i in range(0, len(own), 4096):  # a long text in slices
        least = np.minimum(least, (own[i:i + 4096] * seeds[:, None]).min(axis=1))
    return (mix(least) & np.uint64(255)).astype(np.uint8)


def chunk_keys(signs: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature and each symbol: a key of the symbol's chunk without that symbol."""
    n, symbols = signs.shape
    weights = stream(symbols, 5) | np.uint64(1)
    parts = (signs.astype(np.uint64) + np.uint64(1)) * weights
    chunk = np.arange(symbols) * chunks // symbols
    sums = np.stack([parts[:, chunk == c].sum(axis=1) for c in range(chunks)], axis=1)
    return mix(sums[:, chunk] - parts + stream(symbols, 6))


def _reader(shingle: int, symbols: int, chunks: int):
    seeds = stream(symbols, 9) | np.uint64(1)

    def read(texts: pa.Array) -> list[pa.Array]:
        n, sums, signs = [], [], []
        for _, _, data, offsets in text_pieces(texts):
            for own in shingle_sets(data, offsets, shingle):
                n.append(len(own))
                sums.append((int(own.sum()), int(mix(own).sum())) if len(own) else (0, 0))
                signs.append(signature(own, seeds))
        sums = np.array(sums, np.uint64).reshape(-1, 2).astype(np.int64)
        signs = np.stack(signs)
        keys = chunk_keys(signs, chunks).astype(np.int64)
        return [
            pa.array(n, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([s.tobytes() for s in signs], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * symbols, pa.int32()), pa.array(keys.ravel())),
        ]

    return read


class Union:
    """Disjoint sets of 0 .. n-1, with the members' roots in an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: int, others: np.ndarray) -> np.ndarray:
        """Join ``x`` with ``others``; returns one of ``others`` for each set that was apart."""
        apart = others[self.root[others] != self.root[x]]
        if len(apart):
            roots, where = np.unique(self.root[apart], return_index=True)
            self.root[np.isin(self.root, roots)] = self.root[x]
            apart = apart[where]
        return apart


def _key_links(distance: int):
    """Edges that connect what a key's members with near signatures connect, from rows (key, half, id, signature) sorted by key."""

    def close(ids: np.ndarray, signs: np.ndarray) -> list[tuple[int, int]]:
        sets, out = Union(len(ids)), []
        for x in range(len(ids) - 1):
            rest = np.flatnonzero(sets.root != sets.root[x])
            if x and not len(rest):
                break
            rest = rest[rest > x]
            near = rest[(signs[rest] != signs[x]).sum(axis=1) <= distance]
            out += [(int(ids[x]), int(ids[y])) for y in sets.join(x, near)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 1):
            ids = table.column("id").to_numpy()
            signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            good = two[(signs[two] != signs[two + 1]).sum(axis=1) <= distance]
            out = list(zip(ids[good].tolist(), ids[good + 1].tolist(), strict=True))
            for a, k in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += close(ids[a:a + k], signs[a:a + k])
            yield pair_batch(out)

    return run


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` with a column ``pair``: hot keys' rows are dealt into blocks by hash, and each pair of blocks of a key gets
    the rows of both.  ``sizes`` has (key, blocks) for the keys of more than one block."""
    dealt = rows.join(sizes, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)
    pair = F.transform(other, lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
    return dealt.withColumn("pair", F.explode(pair)).drop("blocks")


def _set_links(per_cent: int):
    """A spanning forest of the links among the rows of one (cluster, pair), confirmed on full sets."""

    def links(ids: np.ndarray, n: np.ndarray, sets_of: list[bytes]) -> list[tuple[int, int]]:
        values = np.frombuffer(b"".join(sets_of), np.uint64)
        at = np.concatenate([[0], np.cumsum(n)])
        # the shingles' own inverted index counts all overlaps of a row at once
        by_value = np.argsort(values, kind="stable")
        ranked, owner = values[by_value], np.repeat(np.arange(len(ids)), n)[by_value]
        sets, out = Union(len(ids)), []
        for x in range(len(ids) - 1):
            if not (sets.root[x + 1:] != sets.root[x]).any():
                continue
            own = values[at[x]:at[x + 1]]
            low, high = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
            many = high - low
            both = np.bincount(owner[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(ids))
            y = np.flatnonzero(100 * both >= per_cent * (n + n[x] - both))
            out += [(int(ids[x]), int(ids[v])) for v in sets.join(x, y)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 2):
            ids, n = table.column("id").to_numpy(), table.column("n_shingles").to_numpy()
            shingles, out = table.column("shingles"), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    out += links(ids[a:b], n[a:b], shingles[a:b].to_pylist())
            yield pair_batch(out)

    return run


def near_duplicates(docs: DataFrame, per_cent: int = 85, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id, kept).

    Rows are linked where ``100 * |A and B| >= per_cent * |A or B|`` over their sets of ``shingle`` words (lower-cased over A-Z, cut at white
    space).  component_id is the smallest id reachable by links, itself included; kept marks the row with that id.

    1. Equal sets are one class, led by its smallest id.  2. Each class has a signature of one byte from each of some min-hashes, cut into chunks
    (``signature_plan``: 32 and 7 at 85 %, 56 and 12 at 80 %).  Two signatures that differ in fewer than twice as many symbols as there are chunks agree in a chunk
    but for one symbol, so classes meet under the keys of "chunk without one symbol".  A link at the threshold is missed with a probability of at
    most ``MISSED``; thresholds below 67 % are refused.  3. Within a key, pairs at that distance are connected by a forest, never listed.  4. Candidate clusters are the components
    of these edges, and the links inside each are confirmed on full shingle sets, again as a forest.  5. Their components are the result.
    A hot key or cluster is dealt into blocks of a fixed size, and each pair of blocks is a group of its own.

    A null or wordless text has an empty set, is its own component and is kept.  Fewer words than a shingle are one shingle.  Rows of equal ids and texts
    share a class, and rows of one id are one document; a null id stays null and is its own component.  An empty table gives no rows; other columns are ignored."""
    symbols, chunks = signature_plan(per_cent)
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    read = map_texts(rows, lambda: _reader(shingle, symbols, chunks), FIELDS, ["id"])
    read = kept(read.select("doc.id", "n_shingles", "set_a", "set_b", "signature", "keys"), "near-signatures")
    members = read.select("id", "n_shingles", "set_a", "set_b")
    full = read.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = kept(classes, "near-classes")
    keyed = classes.select(F.explode("keys").alias("key"), "id", "signature")
    hot = keyed.groupBy("key").count().where(F.col("count") > KEY_BLOCK).select("key", F.ceil(F.col("count") / (KEY_BLOCK // 2)).cast("long").alias("blocks"))
    blocked = in_blocks(keyed, "key", kept(hot, "near-hot-keys"))
    blocked = blocked.select(F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "id", "signature")
    near = blocked.repartition("key").sortWithinPartitions("key").mapInArrow(_key_links(2 * chunks - 1), "a long, b long")
    clusters = components(kept(near, "near-candidates"), "near-clusters").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    clusters = kept(clusters, "near-clusters")
    # full sets of the classes in a cluster, from their texts
    sized = clusters.join(classes.select("id", "n_shingles", "set_a", "set_b"), "id")
    wide = sized.groupBy("cluster").agg(F.sum("n_shingles").alias("n")).where(F.col("n") * 8 > SET_BLOCK_BYTES)
    wide = wide.select("cluster", F.ceil(F.col("n") * 16 / SET_BLOCK_BYTES).cast("long").alias("blocks"))
    texts = rows.join(sized.select("id", "cluster", "set_a", "set_b"), "id")

    def sets():
        def run(part: pa.Array) -> list[pa.Array]:
            own = [s for _, _, data, offsets in text_pieces(part) for s in shingle_sets(data, offsets, shingle)]
            sums = np.array([(int(s.sum()), int(mix(s).sum())) if len(s) else (0, 0) for s in own], np.uint64).reshape(-1, 2).astype(np.int64)
            return [pa.array([len(s) for s in own], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([s.tobytes() for s in own], pa.binary())]

        return run

    held = map_texts(texts, sets, "n_shingles long, a long, b long, shingles binary", ["id", "cluster", "set_a", "set_b"])
    held = held.where("a = doc.set_a and b = doc.set_b").select("doc.id", "doc.cluster", "n_shingles", "shingles")
    blocked = in_blocks(held, "cluster", kept(wide, "near-wide")).select("cluster", "pair", "id", "n_shingles", "shingles")
    links = blocked.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair").mapInArrow(_set_links(per_cent), "a long, b long")
    linked = components(kept(links, "near-links"), "near-components")
    leaders = classes.select("n_shingles", "set_a", "set_b", F.col("id").alias("node")).join(linked, "node", "left")
    leaders = leaders.select("n_shingles", "set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = members.join(leaders, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
