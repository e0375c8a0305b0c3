"""Spelling variants: words one edit apart, found by the signatures of their letter multisets."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, lowered, map_texts, mix, named, prepare, stream, text_pieces

#: Words are at least this many code points long and occur at least this often.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One occurrence in so many loses a code point.
ONE_IN = 31
#: A form occurs at least this many times as often as the word.
TIMES = 10
#: Letters are dealt into this many parts.  One edit changes at most two entries of a multiset, so two words one edit apart
#: agree on all parts but two.
PARTS, CHANGED = 4, 2
#: One edit leaves so many code points alone at one end of the word at least.
END = (LEAST_LENGTH - 1) // 2
#: Signatures of more words are split further, by the words' strings with one letter left out.
FEW = 250


# ------------------------------------------------------------------- words

def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)  # fixed value: the CRC-32 polynomial
    return table


CRC = _crc_table()


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, and row, of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8, 0xC3 and a byte)."""
    n = len(data)
    lead = data == 0xC3
    inside = lead.copy()
    inside |= (data | 32) - np.uint8(97) < 26
    inside[1:] |= lead[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, starts
    lengths = np.add.reduceat(inside.view(np.uint8), starts, dtype=np.int64)
    return starts, starts + lengths, np.searchsorted(offsets, starts, "right") - 1


def observed(data: np.ndarray, offsets: np.ndarray, ids: list[str]) -> pa.Array:
    """The words of some rows as they are observed: lower-cased, of a least length, a code point left out where the checksum says so."""
    first, past, row = runs_of(data, offsets)
    low = lowered()[data]
    starts_char = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(starts_char)])
    length = chars[past] - chars[first]
    use = length >= LEAST_LENGTH
    first, past, row, length = first[use], past[use], row[use], length[use]
    if not len(first):
        return pa.array([], pa.string())
    # CRC-32 of "<id>:<run>" for all runs at once, a byte of each at a time
    begun = np.array([zlib.crc32(f"{i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)
    crc = begun[row]
    size = past - first
    order = np.argsort(-size, kind="stable")
    left = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), "right")
    for at, n in enumerate(left.tolist()):
        some = order[:n]
        crc[some] = (crc[some] >> np.uint32(8)) ^ CRC[(crc[some] ^ low[first[some] + at]) & np.uint32(0xFF)]
    crc ^= np.uint32(0xFFFFFFFF)
    shorter = crc % np.uint32(ONE_IN) == 0
    # places of the bytes that stay
    gap = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    stays = np.ones(len(gap), bool)
    if shorter.any():
        place = np.flatnonzero(starts_char)  # byte of each code point
        gone = place[chars[first[shorter]] + (crc[shorter].astype(np.int64) % length[shorter])]
        base = np.concatenate([[0], np.cumsum(size)[:-1]])[shorter] + gone - first[shorter]
        stays[base] = False
        wide = data[gone] == 0xC3
        stays[base[wide] + 1] = False
    body = low[gap[stays]]
    word = np.repeat(np.arange(len(size)), size)[stays]
    sizes = np.bincount(word, minlength=len(size))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return made.filter(pa.array(length - shorter >= LEAST_LENGTH)).cast(pa.string())


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of all texts: one scan, counted in each piece of text before the shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), named(text).alias("text"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in text_pieces(batch.column(1)):
                counts = pc.value_counts(observed(data, offsets, ids[first:end]))
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# -------------------------------------------------------------- signatures

def signatures(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of signatures for each word, and the word's vector folded into 64 bits (one changed entry changes one bit).  A word is the set of its entries (letter, k-th occurrence), a binary vector; one edit changes two
    entries at most.  Entries are dealt into parts, and for each choice of all parts but ``CHANGED`` there is a hash of their entries, once
    with the first ``END`` letters and once with the last, as one edit does not change both."""
    chars = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    # the k-th occurrence of a letter in its word
    key = word * 256 + chars
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    letter = chars[order].astype(np.int64)
    entry = letter * 4096 + np.minimum(nth, 4095)  # later ones share an entry and count as often as they occur
    weight = mix(entry.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    part = (mix(weight) % np.uint64(PARTS)).astype(np.int64)
    sums = np.zeros((len(sizes), PARTS), np.uint64)
    np.add.at(sums, (word[order], part), weight)
    past = np.cumsum(sizes)
    ends = []
    for places in ((past - sizes)[:, None] + np.arange(END), past[:, None] - 1 - np.arange(END)):
        ends.append((chars[places].astype(np.uint64) * (stream(END, 50 + len(ends)) | np.uint64(1))).sum(axis=1, dtype=np.uint64))
    out = []
    for k, left_out in enumerate(itertools.combinations(range(PARTS), CHANGED)):
        chosen = [p for p in range(PARTS) if p not in left_out]
        seeds = stream(len(chosen), 100 + k) | np.uint64(1)
        own = (mix(sums[:, chosen]) * seeds).sum(axis=1, dtype=np.uint64)
        out += [mix(own + mix(end + np.uint64(e))) for e, end in enumerate(ends)]
    folded = np.zeros(len(sizes), np.uint64)
    np.bitwise_xor.at(folded, word[order], np.uint64(1) << (weight >> np.uint64(58)))
    return np.column_stack(out).astype(np.int64), folded.astype(np.int64)


def _keys(words: DataFrame) -> DataFrame:
    """(key, word, folded) for every signature of every word; keys of one word are left out, those of many are split by the words' strings with
    one letter left out, which two words one edit apart share and few words have in common (one for each letter and place)."""

    def run(batches):
        for batch in batches:
            made, folded = signatures(batch.column(0))
            lists = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded), lists], ["word", "folded", "keys"])

    signed = words.select("word").mapInArrow(run, "word string, folded long, keys array<long>").select("word", "folded", F.explode("keys").alias("key"))
    signed = kept(signed, "signatures")
    shared = signed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = signed.join(shared, "key")
    places = F.sequence(F.lit(1), F.length("word"))
    shorter = F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    strings = F.array_distinct(F.concat(F.array("word"), shorter))
    split = F.when(F.col("m") <= FEW, F.array("key")).otherwise(F.transform(strings, lambda s: F.xxhash64("key", s)))
    return met.select("word", "folded", F.explode(split).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a before b, of all words one inserted, deleted or replaced code point apart, each pair once."""
    keys = kept(_keys(words), "spelling-keys")
    a, b = (keys.select("key", F.col("word").alias(x), F.col("folded").alias(f"folded_{x}")) for x in "ab")
    close = F.bit_count(F.col("folded_a").bitwiseXOR(F.col("folded_b"))) <= CHANGED
    return a.join(b, (a["key"] == b["key"]) & close & (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _root(forms: DataFrame) -> DataFrame:
    """(word, root) where a word has a form.  A form is ``TIMES`` times as frequent as its word, so a chain of long counts has fewer than
    2^5 steps and five doublings reach its end."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = kept(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of all texts.

    Words are maximal runs of Latin letters, lower-cased (A-Z only), a code point left out where the checksum of id and run says so, of at least
    ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences.  ``n_near`` counts the words one edit apart; the form is the most frequent of
    them (ties: the smallest) if it is ``TIMES`` times as frequent as the word; the root follows forms to the last.

    Texts are read once, and one row for each distinct word of a megabyte of text is shuffled.  Later steps grow with the vocabulary: a word has
    12 signatures, a signature of many words is split, and the pairs of a signature are checked where they are joined, not written.
    A text is held with a few arrays of its length (about 40 bytes for each byte).

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count as often as they occur; an empty table gives no
    rows; other columns are ignored."""
    words = kept(vocabulary(docs, id_col, text), "vocabulary")
    pairs = kept(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    most: Column = -F.col("best.minus")
    taken = F.coalesce(most >= TIMES * F.col("n"), F.lit(False))
    found = kept(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, most).alias("form_n")), "forms")
    root = _root(found.where("form is not null"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
