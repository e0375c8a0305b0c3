"""Plain versions of the operators' contracts, over lists of (doc_id, text)."""

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile("[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def benchmark_hits(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    lengths = {len(w) for w in wins}
    out = []
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def secret_spans(docs):
    kinds = (
        ("assign", re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    out = []
    for d, text in docs:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))
        listed = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        out.append((d, *(sum(s[1] == k for s in spans) for k in range(3)), sha(listed), listed))
    return out


def check_packing(docs, pieces, encode, length=1024):
    """The pieces tile every document and every sequence."""
    ids = {d: [*encode(t or ""), 0] for d, t in docs}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = ids[d][p.start:p.start + p.length]
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p.length
        assert at == len(ids[d])
    for q, own in by_seq.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or q == max(by_seq) and at < length
    assert set(by_seq) == set(range(len(by_seq)))


def shingles(text):
    w = SOLID.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def component_rows(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(docs, per_cent=85):
    sets = {d: shingles(t) for d, t in docs}
    owners = {}
    for d, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(d)
    both = {}
    for own in owners.values():
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                both[a, b] = both.get((a, b), 0) + 1
    links = [(a, b) for (a, b), k in both.items() if 100 * k >= per_cent * (len(sets[a]) + len(sets[b]) - k)]
    comp = component_rows(sets, links)
    return [(d, len(sets[d]), comp[d], comp[d] == d) for d, _ in docs]


def repeated_bytes(docs, width=100):
    seen, out = set(), []
    for d, text in sorted(docs):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if (w := b[i:i + width]) in seen:
                gone[i:i + width] = b"\x01" * width
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def spelling_words(docs):
    n = {}
    for d, text in docs:
        for run in LETTERS.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def spelling_groups(docs):
    n = spelling_words(docs)
    lists = {}
    for w in n:
        for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            lists.setdefault(s, set()).add(w)
    near = {w: set() for w in n}
    for own in lists.values():
        for a in own:
            near[a] |= {b for b in own if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out, key=lambda r: r[0])


def collocations(rows, most=2000, least=100):
    """``rows`` of (text, lang)."""
    f, n = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i:i + k]))
                    f[key] = f.get(key, 0) + 1
    f = {key: a for key, a in f.items() if a >= least}
    inside = set()
    for (lang, w), a in f.items():
        for k in range(2, len(w)):
            inside |= {(lang, w[i:i + k], a) for i in range(len(w) - k + 1)}
    out = []
    for lang in n:
        own = []
        for (x, w), a in f.items():
            if x == lang and len(w) > 1 and not any((lang, w, b) in inside for b in [a]):
                cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                own.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:most])]
    return sorted(out)
