"""Benchmark decontamination: Wu-Manber search of word windows over whole texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, kept, map_texts, mix, named, text_pieces, words_of

#: Words of a benchmark window.
WINDOW = 10
#: Words of benchmark items that one pass holds in memory on the driver and in each task.
PASS_WORDS = 250_000
#: Words that one cursor of the scan is responsible for.
REACH = 512

#: Overlapping or touching spans as one, in SQL; for results of several passes.
MERGED = """aggregate(array_sort(hits), cast(array() as array<struct<first:int,past:int>>), (done, x) -> if(
    size(done) > 0 and x.first <= done[size(done) - 1].past,
    concat(slice(done, 1, size(done) - 1), array(named_struct('first', done[size(done) - 1].first, 'past', greatest(done[size(done) - 1].past, x.past)))),
    concat(done, array(x))))"""

FIELDS = "n_words long, hits array<struct<first:int,past:int>>, items array<string>"


def _code(h: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Hash of the block of words that ends at each position."""
    code = h[ends] * np.uint64(0x9E3779B97F4A7C15)
    return mix(code + h[ends - 1]) if block == 2 else mix(code)


@dataclass
class Patterns:
    """Windows of one length with their Wu-Manber tables."""

    length: int
    hashes: np.ndarray  # one row of word hashes for each window
    strings: list[bytes]
    items: list[list[str]]

    def __post_init__(self):
        m, self.block = self.length, min(2, self.length)
        self.bits = max(12, int(np.ceil(np.log2(len(self.strings) * m + 1))) + 4)
        # shift table: how far a window end may move on, by the block that ends there
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int32)
        ends = np.arange(self.block - 1, m)
        for end in ends:
            slots = self.slot(_code(self.hashes.T, np.full(1, end), self.block).ravel())
            np.minimum.at(self.shift, slots, m - 1 - end)
        # buckets: windows by the hash of their last block
        suffix = _code(self.hashes.T, np.full(1, m - 1), self.block).ravel()
        order = np.argsort(suffix, kind="stable")
        self.buckets, first, counts = np.unique(suffix[order], return_index=True, return_counts=True)
        self.members = [order[f:f + c] for f, c in zip(first, counts, strict=True)]

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(64 - self.bits)).astype(np.int64)

    def scan(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, bucket) where a window's last block occurs and the window lies within a row.

        Many cursors walk the words at once, each over its own reach of window ends, and skip by the shift table."""
        m = self.length
        at = np.arange(m - 1, len(h), REACH)
        limit = np.minimum(at + REACH, len(h))
        found, bucket = [], []
        while len(at):
            code = _code(h, at, self.block)
            step = self.shift[self.slot(code)]
            stop = np.flatnonzero(step == 0)
            if len(stop):
                b = np.searchsorted(self.buckets, code[stop])
                b[b == len(self.buckets)] = 0
                good = (self.buckets[b] == code[stop]) & (row[at[stop]] == row[at[stop] - m + 1])
                found.append(at[stop][good] - m + 1)
                bucket.append(b[good])
            at = at + np.maximum(step, 1)
            live = at < limit
            at, limit = at[live], limit[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(bucket)


def windows(items: list[tuple[str, str]], width: int = WINDOW) -> list[Patterns]:
    """Distinct windows of the items, by length.  An item of fewer words than ``width`` is one window; one without words has none."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, _ = words_of(data, np.array([0, len(data)]), ALNUM)
        words = [data[s:e].tobytes().lower() for s, e in zip(starts, ends, strict=True)]
        for i in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(tuple(words[i:i + width]), set()).add(item)
    out = []
    for length in sorted({len(w) for w in found}):
        own = [w for w in found if len(w) == length]
        flat = np.frombuffer(b"".join(x for w in own for x in w), np.uint8)
        offsets = np.cumsum([0, *(len(x) for w in own for x in w)])
        hashes = words_of(flat, offsets, ALNUM)[3].reshape(-1, length)
        out.append(Patterns(length, hashes, [b" ".join(w) for w in own], [sorted(found[w]) for w in own]))
    return out


def _searcher(patterns: list[Patterns]):
    def search(texts: pa.Array) -> list[pa.Array]:
        n_words, hits, items = [], [], []
        for first, end, data, offsets in text_pieces(texts):
            starts, ends, row, h = words_of(data, offsets, ALNUM)
            counts = np.bincount(row, minlength=end - first)
            base = np.concatenate([[0], np.cumsum(counts)])
            spans: list[list[tuple[int, int]]] = [[] for _ in range(end - first)]
            named_items: list[set[str]] = [set() for _ in range(end - first)]
            for p in patterns:
                for w, b in zip(*(x.tolist() for x in p.scan(h, row)), strict=True):
                    text = None
                    for k in p.members[b]:
                        if not np.array_equal(p.hashes[k], h[w:w + p.length]):
                            continue
                        if text is None:  # the words themselves decide
                            text = b" ".join(data[s:e].tobytes().lower() for s, e in zip(starts[w:w + p.length], ends[w:w + p.length], strict=True))
                        if text == p.strings[k]:
                            r = row[w]
                            spans[r].append((w - int(base[r]), w - int(base[r]) + p.length))
                            named_items[r].update(p.items[k])
            n_words += counts.tolist()
            hits += spans
            items += [sorted(x) for x in named_items]
        span = pa.struct([("first", pa.int32()), ("past", pa.int32())])
        return [
            pa.array(n_words, pa.int64()),
            pa.array([[{"first": a, "past": b} for a, b in merged(x)] for x in hits], pa.list_(span)),
            pa.array(items, pa.list_(pa.string())),
        ]

    return search


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """The items in lots of about ``limit`` words; one lot at a time is on the driver."""
    lot, size = [], 0
    for r in benchmark.select(named(item_col).cast("string"), named(text_col)).where(named(text_col).isNotNull()).toLocalIterator():
        lot.append((r[0] if r[0] is not None else "", r[1]))
        size += 1 + len(r[1]) // 2
        if size >= limit:
            yield lot
            lot, size = [], 0
    yield lot


def find_benchmark(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc, n_words, hits, items) for each row of ``docs``; ``doc`` has the ``keep`` columns.

    ``hits`` are the merged word spans that lie in an occurrence of a benchmark window, ``items`` the sorted ids of the items
    with an occurring window.  Words are lower-cased over A-Z only.

    The benchmark is searched for in lots of a fixed size, each a scan of the texts without a shuffle; a benchmark of one lot
    needs one scan.  A null or wordless text has no words and no hits, a null or wordless item no windows; a null item id counts
    as an empty string; items with equal texts are all named, and repeated rows each get their row.  Empty tables give no rows
    or no hits.  Texts of any length are one row's work and are scanned whole."""
    rows = docs.select(F.struct(*[named(c) for c in keep]).alias("doc"), named(text_col).alias("text"))
    lots = _passes(benchmark, item_col, item_text, pass_words)
    lot, found = next(lots), None
    while lot is not None:
        following = next(lots, None)
        tables = docs.sparkSession.sparkContext.broadcast(windows(lot))

        def make(tables=tables):
            return _searcher(tables.value)

        carried = ["doc"] + ["text"] * (following is not None) + ["hits", "items"] * (found is not None)
        out = map_texts(rows, make, FIELDS, carried)
        both = [F.concat("doc.hits", "hits").alias("hits"), F.array_union("doc.items", "items").alias("items")] if found is not None else ["hits", "items"]
        found = out.select("doc.doc", "n_words", *both, *["doc.text"] * (following is not None))
        if following is not None:
            rows = found = kept(found, "benchmark-lot")
            several = True
        else:
            several = "hits" in carried
        lot = following
    if several:
        found = found.withColumn("hits", F.expr(MERGED)).withColumn("items", F.array_sort("items"))
    return found
