"""Secret scans: a trigram inverted index picks the texts on which a rule's pattern is run."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parse
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lowered, map_texts, text_pieces


FIELDS = "spans array<struct<kind:string,first:int,past:int>>"
#: A class of more characters gives no trigram alternatives.
FEW = 4
#: More exact strings than this are split into trigram queries of their parts.
MANY = 64


@dataclass(frozen=True)
class Rule:
    """A pattern and the least length of one of its groups; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the base rules, in the order in which equal starts are listed
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

# ----------------------------------------------------- Boolean trigram queries
# A query is None (any text may match) or a set of alternatives, each a set of trigrams that all must occur.


# fixed values: ASCII letters that, without regard to case, also match another character (U+212A, U+017F, U+0130 and U+0131)
PARTNERED = "KkSsIi"


def _within(flags: int, more: int, less: int) -> int:
    """Flags inside a group that turns some on and off; a group of one alphabet leaves the others."""
    alphabets = re.ASCII | re.UNICODE | re.LOCALE
    return ((flags & ~alphabets if more & alphabets else flags) | more) & ~less


def _either(queries):
    if any(q is None for q in queries):
        return None
    return frozenset().union(*queries) if queries else None


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b)


def _grams(strings: set[str]):
    """The query of a piece of a match that is one of ``strings``."""
    found = []
    for s in strings:
        b = s.encode().lower()
        grams = frozenset(b[i:i + 3] for i in range(len(b) - 2))
        if not grams:
            return None
        found.append(grams)
    return frozenset(found)


def _alone(chars: set[str], flags: int) -> set[str] | None:
    """Characters of one place of a match, or None if without regard to case others than their ASCII cases may stand there."""
    if not flags & re.IGNORECASE or flags & re.ASCII:
        return None if flags & re.IGNORECASE and not all(c.isascii() for c in chars) else chars
    return chars if all(c.isascii() and c not in PARTNERED for c in chars) else None


def _query(parts, flags: int) -> tuple[frozenset | None, set[str] | None]:
    """The query of a parsed sequence under ``flags``, or else its exact strings where they are few."""
    query, run, whole = None, {""}, True
    for op, arg in parts:
        exact, own = None, None
        if op is sre.LITERAL:
            exact = _alone({chr(arg)}, flags)
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= FEW:
            exact = _alone({chr(a) for _, a in arg}, flags)
        elif op is sre.SUBPATTERN:
            own, exact = _query(arg[3], _within(flags, arg[1], arg[2]))
        elif op is sre.BRANCH:
            several = [_query(x, flags) for x in arg[1]]
            own = _either([q if e is None else _grams(e) for q, e in several])
            exact = set().union(*(e for _, e in several)) if all(e is not None for _, e in several) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            inner_query, inner_exact = _query(inner, flags)
            if (low, high) == (0, 1) and inner_exact is not None:
                exact = inner_exact | {""}
            elif low >= 1:
                own = inner_query if inner_exact is None else _grams(inner_exact)
        joined = {r + e for r in run for e in exact} if exact is not None else None
        if joined is not None and len(joined) <= MANY:
            run = joined
            continue
        query, whole = _both(_both(query, _grams(run)), own), False
        run = {""} if exact is None else exact
    return (None, run) if whole else (_both(query, _grams(run)), None)


def trigram_query(pattern: str) -> frozenset | None:
    """Alternatives of trigrams (ASCII lower case) of which one must occur in full where ``pattern`` matches; None if there are none."""
    parsed = sre_parse.parse(pattern)
    query, exact = _query(parsed, parsed.state.flags)
    return query if exact is None else _grams(exact)


class Index:
    """Trigrams of a piece's texts and the texts that have them.  Only trigrams that some query asks for get a posting list."""

    def __init__(self, grams: list[bytes]):
        self.slots = {g: i for i, g in enumerate(grams)}
        self.slot_of = np.zeros(1 << 24, np.uint16)
        for g, i in self.slots.items():
            self.slot_of[(g[0] << 16) | (g[1] << 8) | g[2]] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        lists = np.zeros((len(self.slots), rows), bool)
        if len(data) >= 3 and self.slots:
            b = lowered()[data].astype(np.uint32)
            slot = self.slot_of[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(slot)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[row + 1]
            lists[slot[at[inside]].astype(np.int64) - 1, row[inside]] = True
        return lists

    def candidates(self, lists: np.ndarray, query: frozenset | None) -> np.ndarray:
        """Intersect the postings of each alternative, and take all alternatives together."""
        if query is None:
            return np.arange(lists.shape[1])
        hit = np.zeros(lists.shape[1], bool)
        for grams in query:
            hit |= lists[[self.slots[g] for g in grams]].all(axis=0)
        return np.flatnonzero(hit)


def _scanner(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    index = Index(sorted({g for q in queries if q for grams in q for g in grams}))
    patterns = [re.compile(r.pattern) for r in rules]

    def scan(texts: pa.Array):
        """For each row: (first, kind number, past) of its matches, sorted."""
        for first, end, data, offsets in text_pieces(texts):
            lists = index.postings(data, offsets)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(end - first)]
            body: dict[int, str] = {}
            for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                for r in index.candidates(lists, query).tolist():
                    if r not in body:
                        body[r] = data[offsets[r]:offsets[r + 1]].tobytes().decode()
                    for m in pattern.finditer(body[r]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[r].append((m.start(), k, m.end()))
            for r, spans in enumerate(found):
                yield body.get(r), sorted(spans), (data, offsets, r)

    return scan


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", rules: tuple[Rule, ...] = BASE) -> DataFrame:
    """(doc, spans) for each row of ``docs``; spans are (kind, first, past) in code points, by start and then by the rules' order.

    Matches of a rule are leftmost and do not overlap; those of different rules may.  The index is cut by documents: each piece of
    a batch has the posting lists of the rules' trigrams for its own texts, so it needs no shuffle and grows with nothing but the batch.
    A null or empty text has no spans; repeated rows each get their row; an empty table gives no rows; other columns are ignored."""

    def make():
        scan = _scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("past", pa.int32())])

        def spans(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([[{"kind": rules[k].kind, "first": a, "past": b} for a, k, b in found] for _, found, _ in scan(texts)], pa.list_(kind))]

        return spans

    return map_texts(docs, make, FIELDS, keep, text_col)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE, mark: str = "[secret]") -> DataFrame:
    """(doc, clean): every row of ``docs`` as a struct, and its text with each run of overlapping secrets replaced by ``mark``.
    Nulls stay null; texts without secrets stay as they are."""

    def make():
        scan = _scanner(rules)

        def clean(texts: pa.Array) -> list[pa.Array]:
            valid, out = texts.is_valid().to_pylist(), []
            for (text, found, (data, offsets, r)), there in zip(scan(texts), valid, strict=True):
                if text is None:
                    text = data[offsets[r]:offsets[r + 1]].tobytes().decode()
                done, parts = 0, []
                for first, _, past in found:
                    if first >= done:
                        parts += [text[done:first], mark]
                    done = max(done, past)
                out.append("".join([*parts, text[done:]]) if there else None)
            return [pa.array(out, pa.string())]

        return clean

    return map_texts(docs, make, "clean string", docs.columns, text_col)
