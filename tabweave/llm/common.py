"""Helpers of the training-data operators: kept tables, Arrow maps over texts, word hashes and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.session import cut_lineage, ship_package

#: Texts are worked on in pieces of about this many bytes, so arrays stay in the cache.
PIECE_BYTES = 1 << 20
#: Rows of an Arrow batch; texts may be long.
BATCH_ROWS = 1000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors, let Spark drop the shuffle files of a finished query, and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    prepare(df.sparkSession)
    return cut_lineage(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---------------------------------------------------------------- Arrow maps

def text_pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets in them) for runs of rows of about
    ``limit`` bytes; a longer text is a piece of its own.  Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, whole[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def map_texts(docs: DataFrame, make: Callable[[], Callable], fields: str, keep: list[str], text: str = "text") -> DataFrame:
    """Map whole texts batch by batch.  ``make()`` runs once per task and returns
    ``fn(texts) -> list of arrays`` for ``fields``.  The result has a struct ``doc`` of the ``keep``
    columns, so names of theirs cannot clash with ``fields``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[named(c) for c in keep]).alias("doc"), named(text).alias("text"))
    made = T._parse_datatype_string(fields)
    schema = T.StructType([rows.schema["doc"], *made.fields])
    names = [f.name for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *fn(batch.column(1))], ["doc", *names])

    return rows.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the groups' bounds in them, from batches sorted by their first ``keys`` columns (longs)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        new = np.zeros(held.num_rows, bool)
        for i in range(keys):
            column = held.column(i).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        cut = np.flatnonzero(new)
        if len(cut):
            yield held.slice(0, cut[-1]), np.concatenate([[0], cut])
            held = held.slice(cut[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


# --------------------------------------------------------------------- words

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * GOLDEN)


def lowered() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False
_POWERS = stream(4096)


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of bytes of ``kind`` within a row): start and end byte, row, and a 64-bit
    hash of the ASCII-lower-cased word."""
    global _POWERS
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, np.uint64)
    lengths = np.add.reduceat(inside.view(np.uint8), starts, dtype=np.int64)
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = stream(2 * longest)
    gaps = np.diff(starts, append=n)
    place = np.arange(n, dtype=np.int64)[starts[0]:] - np.repeat(starts, gaps)
    value = np.where(kind, lowered().astype(np.uint64) + np.uint64(1), np.uint64(0))[data[starts[0]:]]
    value *= _POWERS[np.minimum(place, len(_POWERS) - 1)]
    hashes = mix(np.add.reduceat(value, starts - starts[0]))
    return starts, starts + lengths, np.searchsorted(offsets, starts, "right") - 1, hashes


def runs_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, by its first."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, r in enumerate(stream(width, 7) | np.uint64(1)):
        out += hashes[i:i + n] * r
    return mix(out)


# ---------------------------------------------------------------- components

def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: link every node of the edges read to the smallest node it reaches by them."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(up) if (r := top(x)) != x]
    for i in range(0, len(pairs), 10_000):
        part = pairs[i:i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["hi", "lo"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the graph of ``edges`` (first two long columns): the smallest node reachable.
    Nodes without edges are absent.

    Each round joins the edges of a task locally, then moves every node's neighbours to its smallest neighbour, first
    the larger ones and then the smaller ones.  That keeps the components, needs rounds in the logarithm of the number of
    nodes, and each round is written, so a lost executor repeats no earlier round.  Hot nodes
    are met by partial aggregation and by a join whose other side has one row for each node."""
    a, b = (named(c).cast("long") for c in edges.columns[:2])
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo")
    before = None
    while True:
        local = pairs.mapInArrow(forest, "hi long, lo long")
        both = local.select("hi", "lo").union(local.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("m"))
        larger = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = larger.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = larger.join(least, "hi")
        pairs = moved.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(moved.select("hi", F.col("m").alias("lo")).distinct()).distinct()
        pairs = kept(pairs, name)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
