"""Repeated byte strings by a depth-limited radix sort of all suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mix, named, prepare, stream, text_pieces, whole_groups

#: Windows of one run at most; a longer run is cut.
RUN = 256
#: Contexts of a first digit that one group sorts at most; beyond it they are dealt out by window.
CELL_CONTEXTS = 20_000
PLAIN, PERIODIC, GONE = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; positions past the end count as zero."""
    v = np.zeros(len(data) + 8, np.uint64)
    v[:len(data)] = data
    for step in (1, 2, 4):
        v[:-step] = (v[:-step] << np.uint64(8 * step)) | v[step:]
        v[-step:] <<= np.uint64(8 * step)
    return v


def sliding(fn, x: np.ndarray, width: int) -> np.ndarray:
    """``fn`` (minimum or maximum) over each ``width`` consecutive values."""
    done, out = 1, x
    while 2 * done <= width:
        out = fn(out[:-done], out[done:])
        done *= 2
    return fn(out[:len(x) - width + 1], out[width - done:]) if done < width else out


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if n > len(_powers[0]):
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]))
    return _powers[0], _powers[1]


def first_digits(data: np.ndarray, offsets: np.ndarray, width: int):
    """Runs of windows that share their first digit: digit, digest of the run's bytes, row, first byte and past byte in the row, and
    whether windows of the run may repeat each other.

    The digit of a window is the least hash among its parts of 32 bytes, so equal windows have equal digits and a digit holds for
    dozens of windows in a row: one row stands for all these suffixes."""
    n, part = len(data), min(32, width // 2)
    none = np.zeros(0, np.int64)
    if n < width:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    v = eights(data)
    places = n - part + 1
    g = np.zeros(places, np.uint64)
    for at, r in zip([*range(0, part - 7, 8), part - 8], stream(part // 8 + 1, 21) | np.uint64(1), strict=False):
        g += v[at:at + places] * r
    g = mix(g)
    reach = width - part + 1
    least = sliding(np.minimum, g, reach)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(least)]
    inside = np.arange(len(least)) + width <= offsets[1:][row_of]
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (row_of[1:] != row_of[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    count = np.add.reduceat(inside.view(np.uint8), first, dtype=np.int64)
    lots = -(-count // RUN)
    if lots.max() > 1:
        nth = np.arange(lots.sum()) - np.repeat(np.cumsum(lots) - lots, lots)
        start = np.repeat(first, lots) + nth * RUN
        count = np.minimum(np.repeat(first + count, lots) - start, RUN)
        first = start
    # parts that are the least of some window, and those met again close by
    ends = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(np.maximum, ends, reach)[:places] == g)
    again, open_ = np.zeros(len(chosen), bool), np.arange(len(chosen))
    step = 1
    while len(open_ := open_[open_ + step < len(chosen)]):
        near = chosen[open_ + step] - chosen[open_] <= RUN + reach
        open_ = open_[near]
        same = g[chosen[open_ + step]] == g[chosen[open_]]
        again[open_[same]] = True
        open_ = open_[~same]
        step += 1
    sums = np.concatenate([[0], np.cumsum(again)])
    periodic = sums[np.searchsorted(chosen, first + count + reach - 1)] > sums[np.searchsorted(chosen, first)]
    p, inverse = powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n])])
    past = first + count - 1 + width
    digest = mix((total[past] - total[first]) * inverse[first] + (past - first).astype(np.uint64))
    row = row_of[first]
    return least[first], digest, row, first - offsets[row], past - offsets[row], periodic


def joined(key: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a key as one."""
    if not len(key):
        return key, first, past
    order = np.lexsort((first, key))
    key, first, past = key[order], first[order], past[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    high = int(past.max()) + 1
    reach = np.maximum.accumulate(past + group * high) - group * high
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (first[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return key[at], first[at], reach[np.append(at[1:], len(key)) - 1]


def numbered(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number of each text, in the order of (id, row), and the id and row of each number."""
    order = np.lexsort((rows, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    own = np.empty(len(ids), np.int64)
    own[order] = np.cumsum(new) - 1
    return own, ids[order][new], rows[order][new]


def _digit_rows(width: int):
    """Rows (digit, digest, id, row, first, past, kind) of whole texts.  Of equal runs in a piece only the earliest is passed on as such;
    the bytes of the others are gone at once, so a hot run costs a row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, ids, rows = numbered(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            for top, _, data, offsets in text_pieces(batch.column(2)):
                digit, digest, row, first, past, periodic = first_digits(data, offsets, width)
                if not len(digit):
                    continue
                own = number[top + row]
                order = np.lexsort((first, own, digest, digit))
                digit, digest, own, first, past, periodic = (x[order] for x in (digit, digest, own, first, past, periodic))
                late = np.zeros(len(digit), bool)
                late[1:] = (digit[1:] == digit[:-1]) & (digest[1:] == digest[:-1]) & ((own[1:] != own[:-1]) | (first[1:] != first[:-1]))
                gone = joined(own[late], first[late], past[late])
                live = ~late
                a, b = int(live.sum()), len(gone[0])
                columns = [
                    np.concatenate([digit[live].view(np.int64), mix(ids[gone[0]].astype(np.uint64) + gone[1].astype(np.uint64) * _BASE).view(np.int64)]),
                    np.concatenate([digest[live].view(np.int64), np.zeros(b, np.int64)]),
                    ids[whose := np.concatenate([own[live], gone[0]])], rows[whose], np.concatenate([first[live], gone[1]]).astype(np.int32), np.concatenate([past[live], gone[2]]).astype(np.int32),
                    np.concatenate([np.where(periodic[live], PERIODIC, PLAIN), np.full(b, GONE)]).astype(np.int32),
                ]
                for i in range(0, a + b, 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 50_000]) for c in columns], DIGITS)

    return run


DIGITS = ["digit", "digest", "id", "row", "first", "past", "kind"]


def _split_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by digit: spans to remove (cells 0), and the runs whose digit needs sorting on, with the cells of that digit."""
    for table, _ in whole_groups(batches, 1):
        digit, digest, ids, rows, first, past, kind = (table.column(c).to_numpy() for c in DIGITS)
        own, ids, rows = numbered(ids, rows)
        gone = kind == GONE
        spans = [(own[gone], first[gone], past[gone])]
        rest = np.flatnonzero(~gone)
        order = rest[np.lexsort((first[rest], own[rest], digest[rest], digit[rest]))]
        digit, digest, own, first, past, kind = (x[order] for x in (digit, digest, own, first, past, kind))
        if len(digit):
            new_digit = np.ones(len(digit), bool)
            new_digit[1:] = digit[1:] != digit[:-1]
            new_run = new_digit.copy()
            new_run[1:] |= digest[1:] != digest[:-1]
            # a later equal run goes; the same place may be listed twice where a row is repeated
            lead = np.maximum.accumulate(np.where(new_run, np.arange(len(digit)), 0))
            late = (own != own[lead]) | (first != first[lead])
            spans.append((own[late], first[late], past[late]))
            group = np.cumsum(new_digit) - 1
            runs = np.bincount(group, weights=new_run).astype(np.int64)
            odd = np.bincount(group, weights=new_run & (kind == PERIODIC)) > 0
            on = new_run & ((runs > 1) | odd)[group]
            cells = -(-runs // CELL_CONTEXTS)
        gone_own, gone_first, gone_past = joined(*(np.concatenate([s[i] for s in spans]) for i in range(3)))
        n = len(gone_own)
        more = np.flatnonzero(on) if len(digit) else np.zeros(0, np.int64)
        columns = [
            ids[whose := np.concatenate([gone_own, own[more]])], rows[whose], np.concatenate([gone_first, first[more]]).astype(np.int32), np.concatenate([gone_past, past[more]]).astype(np.int32),
            np.concatenate([np.zeros(n, np.int64), digit[more]]), np.concatenate([np.zeros(n, np.int64), cells[group[more]] if len(more) else np.zeros(0, np.int64)]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "row", "first", "past", "digit", "cells"])


def _contexts(width: int):
    """Rows (digit, cell, cells, id, row, first, context) for the runs asked for; a digit of several cells sends a run to each cell
    that one of its windows falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, asked = (batch.column(c).to_pylist() for c in ("id", "row", "asked"))
            out: list[tuple] = []
            for top, end, data, offsets in text_pieces(batch.column("text")):
                for r in range(top, end):
                    text = data[offsets[r - top]:offsets[r - top + 1]]
                    for q in asked[r]:
                        own = text[q["first"]:q["past"]]
                        cells = [0] if q["cells"] == 1 else np.unique(window_cells(own, width, q["cells"])).tolist()
                        out += [(q["digit"], c, q["cells"], ids[r], rows[r], q["first"], own.tobytes()) for c in cells]
            for i in range(0, len(out), 10_000):
                columns = list(zip(*out[i:i + 10_000], strict=True))
                kinds = [*[pa.int64()] * 5, pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digit", "cell", "cells", "id", "row", "first", "context"])

    return run


def window_cells(data: np.ndarray, width: int, cells: int) -> np.ndarray:
    p, inverse = powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)])])
    n = len(data) - width + 1
    return (mix((total[width:] - total[:n]) * inverse[:n]) % np.uint64(cells)).astype(np.int64)


def radix_passes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that are equal to another of their group, and their final groups: most significant digit first, eight bytes a
    pass, down to ``width`` bytes; a window alone in its group leaves."""
    v = eights(data)
    which = np.arange(len(starts))
    for at in range(0, width, 8):
        digit = v[starts[which] + at]
        if at + 8 > width:
            digit = digit >> np.uint64(8 * (at + 8 - width))
        order = np.lexsort((digit, group))
        which, group, digit = which[order], group[order], digit[order]
        new = np.ones(len(which), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=0)[group] > 1 if len(group) else new
        which, group = which[several], group[several]
        if not len(which):
            break
    return which, group


def _sort_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 2):
            ids, rows, first, cell, cells = (table.column(c).to_numpy() for c in ("id", "row", "first", "cell", "cells"))
            own, ids, rows = numbered(ids, rows)
            texts = table.column("context").to_pylist()
            sizes = np.array([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), np.uint8)
            base = np.cumsum(sizes) - sizes
            count = sizes - width + 1
            owner = np.repeat(np.arange(len(texts)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            if (cells > 1).any():  # a cell's own windows only
                keep = np.concatenate([window_cells(np.frombuffer(t, np.uint8), width, int(k)) == c for t, k, c in zip(texts, cells, cell, strict=True)])
                owner, place = owner[keep], place[keep]
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[owner]
            which, equal = radix_passes(data, base[owner] + place, group, width)
            doc, at = own[owner[which]], first[owner[which]] + place[which]
            order = np.lexsort((at, doc, equal))
            doc, at, equal = doc[order], at[order], equal[order]
            new = np.ones(len(doc), bool)
            new[1:] = equal[1:] != equal[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            late = (doc != doc[lead]) | (at != at[lead])
            d, a, b = joined(doc[late], at[late], at[late] + width)
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(rows[d]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["id", "row", "first", "past"])

    return run


def _cut(texts: pa.Array, spans: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], bytes]]:
    """(bytes, merged spans, bytes left) of each row."""
    lists = spans.to_pylist()
    for top, end, data, offsets in text_pieces(texts):
        for r in range(top, end):
            own = data[offsets[r - top]:offsets[r - top + 1]]
            asked = [(s["first"], min(s["past"], len(own))) for s in lists[r] or () if s["first"] < len(own)]
            if not asked:
                yield len(own), [], own.tobytes()
                continue
            a, b = np.array(asked, np.int64).T
            _, a, b = joined(np.zeros(len(a), np.int64), a, b)
            left, done = [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                left.append(own[done:x].tobytes())
                done = y
            yield len(own), list(zip(a.tolist(), b.tolist(), strict=True)), b"".join([*left, own[done:].tobytes()])


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, id, row, text): own is the id as given, and (id, row) a key of the text.  The row is a hash of the text, so rows of equal ids and texts
    are one text; a row without an id is a text of its own, with a number fixed by writing these rows once."""
    spark = docs.sparkSession
    own, text = named(id_col), named(text_col).alias("text")
    given = docs.where(own.isNotNull()).select(own.alias("own"), own.cast("long").alias("id"), F.xxhash64(named(text_col)).alias("row"), text)
    bare = docs.where(own.isNull()).select(own.alias("own"), F.lit(-(1 << 63)).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text)
    prepare(spark)
    return given.union(kept(bare, "repeats-bare"))


def repeated_spans(rows: DataFrame, width: int = 100) -> DataFrame:
    """(id, row, first, past): byte spans of ``text_rows`` that are covered by strings of ``width`` bytes which also start earlier, in a text of a
    smaller (id, row) or before in the same text.  Spans of a text may overlap.

    All suffixes are sorted by their first ``width`` bytes, most significant digit first.  The first digit is the least hash among the
    parts of a window, which neighbouring windows share: a shuffle by it carries one row for each run of windows.  A digit of one run is
    done; equal runs are told by their digests, the earliest stays.  Only runs whose digit has several different ones go on with
    their bytes, in passes of eight bytes within the digit, which end with the groups of equal windows.

    A digit of very many runs is dealt over cells by window, and equal runs of a piece of input are one row, so no group grows with
    the copies of a passage.  Null and short texts have no spans; rows of one id and text are one text, other rows of one id are texts apart; a null id
    counts as the smallest."""
    digits = rows.select("id", "row", "text").mapInArrow(_digit_rows(width), "digit long, digest long, id long, row long, first int, past int, kind int")
    split = digits.repartition("digit").sortWithinPartitions("digit").mapInArrow(_split_digits, "id long, row long, first int, past int, digit long, cells long")
    split = kept(split, "repeats-digits")
    asked = split.where("cells > 0").groupBy("id", "row").agg(F.collect_list(F.struct("first", "past", "digit", "cells")).alias("asked"))
    contexts = rows.join(asked, ["id", "row"]).select("id", "row", "text", "asked").mapInArrow(_contexts(width), "digit long, cell long, cells long, id long, row long, first int, context binary")
    sorted_ = contexts.repartition("digit", "cell").sortWithinPartitions("digit", "cell").mapInArrow(_sort_windows(width), "id long, row long, first int, past int")
    return split.where("cells = 0").select("id", "row", "first", "past").union(kept(sorted_, "repeats-windows"))


def without_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, removed, kept_sha256) for each row of ``docs``: ``removed`` are the maximal byte spans that repeat (see
    ``repeated_spans``), the digest is of the bytes left.  A null text is empty, an empty table gives no rows, other columns are ignored."""
    rows = text_rows(docs, id_col, text_col)
    spans = repeated_spans(rows, width).groupBy("id", "row").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    rows = rows.join(spans, ["id", "row"], "left").select("own", "text", "spans")
    kind = rows.schema["own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
        for batch in batches:
            n, removed, sums = [], [], []
            for size, gone, left in _cut(batch.column("text"), batch.column("spans")):
                n.append(size)
                removed.append([{"first": a, "past": b} for a, b in gone])
                sums.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(n, pa.int64()), pa.array(removed, span), pa.array(sums)], ["own", "n_bytes", "removed", "kept_sha256"])

    out = rows.mapInArrow(run, f"own {kind}, n_bytes long, removed array<struct<first:int,past:int>>, kept_sha256 string")
    return out.withColumnRenamed("own", id_col)
