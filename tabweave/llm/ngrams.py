"""Hashed character n-grams and words of whole texts, and bounded samples to train on."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, words_of
from .tokens import LETTER, unicode_classes

_STEPS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1))


@functools.cache
def letters() -> np.ndarray:
    """Each letter's lower case (where that is one character) and a blank for any other character."""
    table = np.full(0x110000, 32, np.uint32)
    for c in np.flatnonzero(unicode_classes()[0] == LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def letter_chars(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with one blank for each run of other characters: characters, row offsets, and whether rows have letters."""
    chars, at = code_points(data, offsets)
    chars = letters()[chars]
    keep = chars != 32
    total = np.concatenate([[0], np.cumsum(keep)])
    has = total[at[1:]] > total[at[:-1]]
    keep[1:] |= chars[:-1] != 32
    if len(keep):
        keep[0] = True
        keep[at[:-1][at[:-1] < len(keep)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return chars[keep], total[at], has


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars, lead[offsets]


def char_ngrams(chars: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: buckets of the n-grams that lie within a row, in order, and the row offsets in them."""
    count = np.diff(at)
    for n in sizes:
        places = len(chars) - n + 1
        if places <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
            continue
        h = np.full(places, n, np.uint32) * np.uint32(0x2545F491)
        for i in range(n):
            h = (h ^ chars[i:i + places]) * _STEPS[i]
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        inside = np.maximum(count - n + 1, 0)
        if n > 1:
            past = np.zeros(places + 1, np.int32)
            has = inside > 0
            np.add.at(past, at[:-1][has], 1)
            np.add.at(past, at[:-1][has] + inside[has], -1)
            h = h[np.cumsum(past)[:-1] > 0]
        yield h, np.concatenate([[0], np.cumsum(inside)])


def word_buckets(data: np.ndarray, offsets: np.ndarray, bits: int, back: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words between white space, buckets of each word's shape among the words just before (which of the ``back``
    words before it are the same word), and the row offsets in both."""
    _, _, row, h = words_of(data, offsets, NOT_SPACE)
    shape = np.zeros(len(h), np.uint32)
    for i in range(1, min(back, len(h) - 1) + 1):
        shape[i:] |= ((h[i:] == h[:-i]) & (row[i:] == row[:-i])).astype(np.uint32) << np.uint32(i - 1)
    shape = ((shape + np.uint32(1)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return (h >> np.uint64(64 - bits)).astype(np.uint32), shape, np.searchsorted(row, np.arange(len(offsets)))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    out = np.zeros((len(at) - 1, *values.shape[1:]))
    has = at[1:] > at[:-1]
    if has.any():
        out[has] = np.add.reduceat(values, at[:-1][has], axis=0, dtype=float)
    return out


def id_text_crc(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def bounded_sample(rows: DataFrame, label: str, limit: int) -> tuple[DataFrame, list]:
    """At most ``limit`` rows, near equal numbers of each label, picked by a hash of ``id``, and the labels with their counts.
    The labels are those of a classifier, so they are few; counts are over all rows."""
    counts = sorted((r[0], r[1]) for r in rows.groupBy(label).count().where(F.col(label).isNotNull()).collect())
    if not counts:
        return rows.limit(0), []
    each = limit // len(counts)
    share = F.lit(0.0)
    for name, n in counts:
        share = F.when(F.col(label) == F.lit(name), F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(limit + limit // 4), counts
