"""Token ids of whole texts at numpy speed: texts are cut into words by array rules, and each distinct word is encoded once."""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer as Reader

from .common import mix, stream

#: Distinct words that a task remembers.
CACHE_WORDS = 1_000_000
TABLE_BITS, PROBES = 22, 4
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# fixed values: Unicode's white space
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _known_class(reader: Reader, chars: str) -> int | None:
    """Class of all of ``chars`` by where the tokenizer cuts between them, a letter before and a digit after; None if they differ."""
    cuts = {a for _, (a, _) in reader.pre_tokenizer.pre_tokenize_str(f"a{chars}1")} - {0}
    return {(len(chars) + 1,): LETTER, (1,): NUMBER, (1, len(chars) + 1): OTHER}.get(tuple(sorted(cuts)))


def _settle(reader: Reader, table: np.ndarray, first: int, past: int) -> None:
    """Set the classes of code points that Python does not know, by halves where they differ."""
    found = _known_class(reader, "".join(map(chr, range(first, past))))
    if found is not None:
        table[first:past] = found
    elif past - first > 1:
        middle = (first + past) // 2
        _settle(reader, table, first, middle)
        _settle(reader, table, middle, past)


@functools.cache
def unicode_classes() -> tuple[np.ndarray, np.ndarray]:
    """Letter, number, white space or other, for each code point, and the bounds of the runs of code points that Python does not know."""
    categories = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = categories.astype("U1")
    table[kinds == "L"], table[kinds == "N"] = LETTER, NUMBER
    table[WHITE] = SPACE
    unknown = np.concatenate([[False], categories == "Cn", [False]])
    return table, np.flatnonzero(unknown[1:] != unknown[:-1]).reshape(-1, 2)


@functools.cache
def classes(path: str) -> np.ndarray:
    """The class of each code point for a tokenizer, whose tables may be newer than Python's: it is asked about those that Python does not know."""
    table, unknown = unicode_classes()
    table, reader = table.copy(), Reader.from_file(path)
    for first, past in unknown.tolist():
        _settle(reader, table, first, past)
    return table


def word_starts(chars: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where words start: a run of letters, of numbers or of other characters with one blank before it, an apostrophe with its
    short ending, and white space up to the character before the next word."""
    n = len(chars)
    kind = table[chars]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # of a row
    first = first[:n]
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins)
    past = np.append(run[1:], n)
    starts = begins.copy()
    solid = kind[run] != SPACE
    # a blank just before belongs to the word
    at = run[solid]
    at = at[~first[at]]
    starts[at[chars[at - 1] == 32]] = False
    # the last white space before a word stands apart from the rest
    last = past[~solid] - 1
    last = last[last + 1 < n]
    starts[last[~first[last + 1]]] = True
    # an apostrophe that starts a word takes an ending along
    mark = run[(chars[run] == 39) & (past - run == 1) & starts[run]]
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1] & (kind[mark + 1] == LETTER)]
    one = mark[np.isin(chars[mark + 1], [ord(c) for c in "sdmt"])]
    two = mark[mark + 2 < n]
    two = two[~first[two + 2]]
    pair = chars[two + 1].astype(np.int64) * 256 + np.minimum(chars[two + 2], 255)
    two = two[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("ll", "ve", "re")])]
    for found, width in ((one, 2), (two, 3)):
        starts[found + 1] = False
        rest = found + width
        rest = rest[rest < n]
        starts[rest[~begins[rest]]] = True
    return np.flatnonzero(starts)


class Tokenizer:
    """Ids that ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives, for a byte-level BPE file whose ids
    are merge ranks and which has the usual word pattern.  Texts that hold a special token's string go through that call itself."""

    def __init__(self, path: str):
        self.reader, self.classes = Reader.from_file(path), classes(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # characters that stand for bytes in the file: printable ones for themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.bpe = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        # an open-addressed table of word hashes; a word that finds no free place takes its first one
        self.keys, self.slot = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.words, self.flat, self.used = 0, np.zeros(1 << 16, np.uint16), 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, key: int, word: str) -> int:
        ids = self.bpe.encode_ordinary(word)
        k, self.words = self.words, self.words + 1
        if k == len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.start[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)
        first = key >> (64 - TABLE_BITS)
        places = [(first + p) % len(self.keys) for p in range(PROBES)]
        at = next((p for p in places if self.keys[p] == 0), first)
        self.keys[at], self.slot[at] = key, k
        return k

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those not in the table."""
        first = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.keys[first] == hashes, self.slot[first], -1)
        for p in range(1, PROBES):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            at = (first[left] + p) % len(self.keys)
            out[left] = np.where(self.keys[at] == hashes[left], self.slot[at], -1)
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them) of UTF-8 rows."""
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            rows = [self.reader.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([i for r in rows for i in r], np.uint16), np.cumsum([0, *map(len, rows)])
        if self.words > CACHE_WORDS:
            self.clear()
        text = raw.decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = lead[offsets]
        starts = word_starts(chars, at, self.classes)
        sizes = np.diff(starts, append=len(chars))
        place = np.arange(len(chars)) - np.repeat(starts, sizes)
        powers = stream(int(sizes.max()), 3)
        hashes = mix(np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * powers[place], starts))
        word = self.find(hashes)
        new = np.flatnonzero(word < 0)
        if len(new):
            keys, where, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            begin = starts[new[where]]
            learned = [self.learn(k, text[a:b]) for k, a, b in zip(keys.tolist(), begin.tolist(), (begin + sizes[new[where]]).tolist(), strict=True)]
            word[new] = np.array(learned)[inverse]
        count = self.count[word]
        past = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[word] - (past - count), count) + np.arange(past[-1])]
        return ids, np.concatenate([[0], past])[np.searchsorted(starts, at)]
