"""Phrase collocations: fingerprints of all n-grams counted in Spark, and texts only of the frequent ones.

Words and phrases are hashed with prefix polynomials modulo 2^64.  Three counting passes (words, pairs, triples) leave a bitmap of
fixed size in which every frequent fingerprint has its bit; n-grams with an unset bit inside cannot be frequent and are not shuffled.
The last pass counts what is left by two independent fingerprints, with a pointer to a text that holds the phrase.  The pointed
texts are hashed again to take the phrases from them, which confirms every fingerprint against the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GOLDEN, kept, lowered, mix, named, prepare, stream, text_pieces

#: Words of a phrase at most, and occurrences of a candidate at least.
LONGEST, LEAST = 5, 100
#: Bits of the bitmap: its size is the same for any input.
BITMAP_BITS = 27
#: Bytes of a text that are hashed at a time, and how far the next words are looked for.
STRETCH, AHEAD = 1 << 20, 1 << 12

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = BREAK[10:14] = True
WORD = ~BREAK
WORD[[9, 32]] = False


class Polynomials:
    """Prefix polynomials: the value of any stretch from two prefix sums, for a byte's or a word's weight times a power of an odd base."""

    def __init__(self, seed: int):
        bases = stream(2, 1000 + seed) | np.uint64(1)
        self.base, self.inverse = bases[0], np.uint64(pow(int(bases[0]), -1, 1 << 64))
        self.letters = mix(lowered().astype(np.uint64) * GOLDEN + bases[1])
        self.seed = np.uint64(seed + 1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            ones = np.ones(n, np.uint64)
            self.up, self.down = ones.copy(), ones.copy()
            self.up[1:], self.down[1:] = self.base, self.inverse
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def stretches(self, weights: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        self._powers(len(weights) + 1)
        sums = np.zeros(len(weights) + 1, np.uint64)
        np.cumsum(weights * self.up[:len(weights)], out=sums[1:])
        return mix((sums[past] - sums[first]) * self.down[first] + (past - first).astype(np.uint64) * self.seed)


class Grams:
    """The words of a stretch of rows, with the fingerprints of the phrases that start at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, polynomials: tuple[Polynomials, ...]):
        n = len(data)
        inside = WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begins[edges] = inside[edges]
        self.first = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:][offsets[1:] > 0] - 1
        ends[edges] = inside[edges]
        self.past = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        # a piece's number rises at every row and break
        breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
        self.piece = self.row + breaks[self.first]
        self.langs, self.polynomials, self.low = langs, polynomials, lowered()[data]
        self.words = [p.stretches(p.letters[data], self.first, self.past) for p in polynomials]

    def starts(self, k: int) -> np.ndarray:
        """Words at which a phrase of ``k`` words starts."""
        last = len(self.first) - k
        return np.flatnonzero(self.piece[k - 1:] == self.piece[:last + 1]) if last >= 0 else np.zeros(0, np.int64)

    def prints(self, k: int, at: np.ndarray, which: int = 0) -> np.ndarray:
        """Fingerprints of the phrases of ``k`` words at the words ``at``, apart by language and length."""
        p = self.polynomials[which]
        own = p.stretches(self.words[which], at, at + k) if k > 1 else self.words[which][at]
        return mix(own + self.langs[self.row[at]] * (p.seed + np.uint64(2 * k)))


def _lang_hash(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(x.encode(), "little") % ((1 << 64) - 59) for x in set(langs)}
    return mix(np.array([known[x] for x in langs], np.uint64) * GOLDEN + np.uint64(3)) | np.uint64(1)


def _stretches(data: np.ndarray, offsets: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, past): rows in one go, or a long row in stretches that end between words and hold the next words too;
    phrases that start at ``past`` or later belong to the next one."""
    if rows > 1 or len(data) <= STRETCH:
        yield data, offsets, len(data)
        return
    first, n = 0, len(data)
    while first < n:
        past = _after_word(data, min(first + STRETCH, n))
        end = past
        for _ in range(LONGEST):  # the words after the stretch
            solid = end
            while solid < n and not len(found := np.flatnonzero(WORD[data[solid:solid + AHEAD]])):
                solid += AHEAD
            end = _after_word(data, solid + int(found[0])) if solid < n else n
        yield data[first:end], np.array([0, end - first]), past - first
        first = past


def _after_word(data: np.ndarray, at: int) -> int:
    while at < len(data):
        if len(found := np.flatnonzero(~WORD[data[at:at + AHEAD]])):
            return at + int(found[0])
        at += AHEAD
    return len(data)


def _grams(batch: pa.RecordBatch, polynomials: tuple[Polynomials, ...]) -> Iterator[tuple[int, Grams, int]]:
    """(first row, grams, past) for the pieces of a batch of (lang, text, ...)."""
    langs = batch.column(0).to_pylist()
    hashed = _lang_hash(langs) if langs else np.zeros(0, np.uint64)
    for first, end, data, offsets in text_pieces(batch.column(1)):
        for own, places, past in _stretches(data, offsets, end - first):
            yield first, Grams(own, places, hashed[first:end], polynomials), past


# ---------------------------------------------------------------- the bitmap

class Bitmap:
    """A set of fingerprints: members are always found, others by chance."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), np.uint64)

    def add(self, frequent: DataFrame) -> None:
        """Set the bits of a column ``fp``.  The words of the bitmap are put together by Spark, so no more than its size reaches the driver."""
        place = F.shiftrightunsigned("fp", 64 - self.bits)
        parts = frequent.select(F.shiftright(place, 6).alias("at"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        rows = parts.groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
        self.words[rows.column("at").to_numpy()] |= rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)

    def has(self, prints: np.ndarray) -> np.ndarray:
        place = prints >> np.uint64(64 - self.bits)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _possible(grams: Grams, bitmap: Bitmap | None, k: int, checked: int) -> np.ndarray:
    """Starts of the phrases of ``k`` words whose parts of ``checked`` words, or words where those are shorter, all have their bits."""
    at = grams.starts(k)
    if bitmap is None or not checked:
        return at
    every = grams.starts(checked)
    known = np.zeros(len(grams.first) + 1, bool)
    known[every] = bitmap.has(grams.prints(checked, every))
    for i in range(k - checked + 1):
        at = at[known[at + i]]
    return at


def _counted(docs: DataFrame, k: int, bitmap: Bitmap | None, least: int) -> DataFrame:
    """Fingerprints of phrases of ``k`` words that occur often enough; other phrases with the same fingerprint count for them."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap else None

    def run(batches):
        polynomials = (Polynomials(0),)
        for batch in batches:
            for _, grams, past in _grams(batch, polynomials):
                at = _possible(grams, sent.value if sent else None, k, k - 1)
                prints, n = np.unique(grams.prints(k, at[grams.first[at] < past]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n.astype(np.int64))], ["fp", "n"])

    found = docs.select("lang", "text").mapInArrow(run, "fp long, n long")
    return found.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("fp")


def _recounted(docs: DataFrame, bitmap: Bitmap, least: int) -> DataFrame:
    """(fp, fp2, k, a, key) of frequent phrases of 1 to ``LONGEST`` words, told apart by both fingerprints, with the key of a text that
    holds them; and as the phrases of no words (k = 0) all words of a language."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        polynomials = (Polynomials(0), Polynomials(1))
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for first, grams, past in _grams(batch, polynomials):
                for k in range(LONGEST + 1):
                    if k == 0:
                        at = np.flatnonzero(grams.first < past)
                        prints = [grams.langs[grams.row[at]]] * 2
                    else:
                        at = _possible(grams, sent.value, k, min(k, 3))
                        at = at[grams.first[at] < past]
                        prints = [grams.prints(k, at, i) for i in (0, 1)]
                    if not len(at):
                        continue
                    own = keys[first + grams.row[at]]
                    order = np.argsort(prints[0], kind="stable")
                    a, b, own = prints[0][order], prints[1][order], own[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    cut = np.flatnonzero(new)
                    counts = np.diff(cut, append=len(a))
                    columns = [a[cut].view(np.int64), b[cut].view(np.int64), np.full(len(cut), k, np.int32), counts, np.minimum.reduceat(own, cut)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "fp2", "k", "n", "key"])

    found = docs.select("lang", "text", "key").mapInArrow(run, "fp long, fp2 long, k int, n long, key long")
    return found.groupBy("k", "fp", "fp2").agg(F.sum("n").alias("a"), F.min("key").alias("key")).where((F.col("k") == 0) | (F.col("a") >= least))


def _texts(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """(lang, k, phrase, a): the counted phrases read from the texts that their pointers name.  Each such text is fetched once, however many
    copies it has; a text that only shares a key holds none of the fingerprints and gives nothing."""
    wanted = counted.groupBy("key").agg(F.collect_list(F.struct("fp", "fp2", "k", "a")).alias("wanted"))
    texts = docs.join(counted.select("key").distinct(), "key", "left_semi").groupBy("key", "lang", "text").agg(F.count("*").alias("copies"))

    def run(batches):
        polynomials = (Polynomials(0), Polynomials(1))
        for batch in batches:
            langs, lists = batch.column(0).to_pylist(), batch.column(2)
            bounds, items = lists.offsets.to_numpy(), lists.values
            fp, fp2, k, a = (items.field(i).to_numpy() for i in range(4))
            for first, grams, _ in _grams(batch, polynomials):
                own = slice(bounds[first], bounds[first + len(grams.langs)])
                made = _read(grams, langs[first:], fp[own].view(np.uint64), fp2[own].view(np.uint64), k[own], a[own])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "k", "phrase", "a"])

    made = texts.join(wanted, "key").select("lang", "text", "wanted").mapInArrow(run, "lang string, k int, phrase string, a long")
    return made.groupBy("lang", "k", "phrase").agg(F.max("a").alias("a"))


def _read(grams: Grams, langs: list[str], fp: np.ndarray, fp2: np.ndarray, k: np.ndarray, a: np.ndarray) -> list[list]:
    """Languages, lengths, texts and counts of the wanted phrases that occur here."""
    out: list[list] = [[], [], [], []]
    for size in np.unique(k).tolist():
        mine = k == size
        want = dict(zip(zip(fp[mine].tolist(), fp2[mine].tolist(), strict=True), a[mine].tolist(), strict=True))
        if size == 0:
            at = np.unique(grams.row, return_index=True)[1]
            prints = [grams.langs[grams.row[at]]] * 2
        else:
            at = grams.starts(size)
            at = at[np.isin(grams.prints(size, at), fp[mine])]
            prints = [grams.prints(size, at, i) for i in (0, 1)]
        for x, y, i in zip(prints[0].tolist(), prints[1].tolist(), at.tolist(), strict=True):
            if (count := want.pop((x, y), None)) is not None:
                words = [grams.low[b:e].tobytes().decode() for b, e in zip(grams.first[i:i + size].tolist(), grams.past[i:i + size].tolist(), strict=True)]
                for column, value in zip(out, (langs[grams.row[i]], size, " ".join(words), count), strict=True):
                    column.append(value)
    return out


# ----------------------------------------------------------------- phrases

def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, k, phrase, a): phrases of up to ``LONGEST`` words that occur at least ``least`` times in texts of a language, overlaps counted, and
    for each language a row of k = 0 with the number of all its words."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(named(lang), F.lit("und")).alias("lang"), named(text).alias("text"))
    bitmap = Bitmap(bits)
    for k in (1, 2, 3):
        bitmap.add(_counted(rows, k, bitmap if k > 1 else None, least))
    keyed = rows.withColumn("key", F.xxhash64("lang", "text"))
    counted = kept(_recounted(keyed, bitmap, least), "phrase-prints")
    return kept(_texts(keyed, counted), "phrases")


def collocations(docs: DataFrame, most: int = 2000, text: str = "text", lang: str = "lang", least: int = LEAST, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each language (the list's length is the feature).

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line breaks, and those into words at blanks and tabs.  A candidate is a phrase
    of two to ``LONGEST`` words with a >= ``least`` occurrences.  Its score is the least of floor(1000 a n / (l r)) over its cuts into two phrases of l and
    r occurrences, n being all words of the language; a candidate inside a longer one of as many occurrences goes.  A phrase is never
    more frequent than one it contains, so it is enough to look at candidates of one word more.

    Texts are read four times and once more for those pointed at.  Shuffles hold fingerprints and counts, one row for each distinct n-gram of a
    megabyte of text; beyond what the bitmap tells apart (2^27 bits) more n-grams are shuffled, with the same result.  Long texts are hashed
    a megabyte at a time.

    Null and empty texts have no words, a null language is ``und``; ties are settled by the phrase; repeated rows count as often as they occur; an
    empty table gives no rows; other columns are ignored."""
    found = frequent_phrases(docs, text, lang, least, bits)
    total = kept(found.where("k = 0").select("lang", F.col("a").alias("n")), "phrase-totals")
    known = found.where("k > 0").select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    longer = found.where("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    left = found.where("k > 1").join(longer.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = left.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]).join(total, "lang")
    wide: Column = F.expr("cast(1000 * cast(a as decimal(20)) * cast(n as decimal(20)) as decimal(38)) div (cast(l as decimal(20)) * cast(r as decimal(20)))")
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(wide.alias("score"), "cut", "l", "r")).alias("worst"))
    order = W.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
