"""Token counts, spelling variants and phrases against plain versions."""

import random

import brute
import duckdb
import pyarrow as pa
import pytest
import sentencepiece

from tabweave.llm import common, phrases, spellings, token_counts
from tabweave.llm import queries as registered

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, doc int, id string, word string, n long, key long, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 6) for r in rows], EXTRA)


def table_rows(spark):
    return [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


# --------------------------------------------------------------- token counts

HARD = ["", " ", "\n", "x", "<s> </s> <unk>", "▁▁ a ▁", "ＡＢ" * 300, "a" * 5000, "ab9Zq" * 900, " " * 4000, "你好" * 700, "é\x00" * 500, "the cat, sat. " * 400, "😀" * 333 + "z" * 333]


def whole(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    return [len(model.encode(t)) for t in texts]


@pytest.mark.parametrize("chunk, overlap", [(8, 2), (61, 5), (1000, 16)])
def test_spliced_counts(chunk, overlap):
    counter = token_counts.Counter(token_counts.default_model(), chunk, overlap)
    assert counter.splices
    rng = random.Random(chunk)
    parts = ["a", "ab", "the ", " ", "  ", "é", "你", "\n", "Ａ", "▁", "====", "x9", "😀", "ing"]
    texts = HARD + ["".join(rng.choice(rng.sample(parts, 3)) for _ in range(rng.randint(1, 500))) for _ in range(300)]
    found = [counter.spliced(t) for t in texts]
    assert [f[0] for f in found] == whole(texts)
    assert any(f[2] for f in found) and any(f[1] > 3 and not f[2] for f in found)


def test_count_tokens(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "same"), (3, "same"), *[(10 + i, t) for i, t in enumerate(HARD)], (50, "word " * 60_000)]
    got = token_counts.count_tokens(frame(spark, rows), ["doc_id", "n"]).collect()
    want = sorted(((d, len((t or "").encode()), k) for (d, t), k in zip(rows, whole([t or "" for _, t in rows]), strict=True)), key=str)
    assert sorted(((r.doc.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert max(r.n_chunks for r in got) > 5
    assert token_counts.count_tokens(frame(spark, []), ["doc_id"]).collect() == []


def test_count_query(spark):
    rows = table_rows(spark)
    want = sorted((d, len((t or "").encode()), k, k > 4096) for (d, t), k in zip(rows, whole([t or "" for _, t in rows]), strict=True))
    assert sorted(tuple(r) for r in registered.QUERIES["op12_resynchronised_counts"](spark, SF).collect()) == want


# ------------------------------------------------------------ spelling variants

def variants():
    """Words one edit apart at every place, with accents, ties of counts, chains of forms and two edits."""
    rng = random.Random(5)
    base = ["abcdefg", "Straßenbahn", "éàüöäñç", "aaaaaaaa", "mississippi", "ÀÉÎÕÜ×÷", "abcdefgabcdefg"]
    words = ["chainworda"] * 3 + ["chainwordb"] * 40 + ["chainwordbc"] * 600
    for w in base:
        words += [w] * 150
        for _ in range(40):
            i, c = rng.randrange(len(w)), rng.choice("xyzéabc")
            words += rng.choice([[w[:i] + w[i + 1:]], [w[:i] + c + w[i:]], [w[:i] + c + w[i + 1:]], [w[:i] + c + c + w[i:]]]) * rng.choice([1, 2, 2, 13])
    rng.shuffle(words)
    seps = [" ", ", ", "-", "1", "\n", "ſ", "Ā", "’", "\x00"]
    return [(i, "".join(w + rng.choice(seps) for w in words[i * 50:i * 50 + 50])) for i in range(len(words) // 50 + 1)]


@pytest.mark.parametrize("few", [250, 2])
def test_spelling_groups(spark, monkeypatch, few):
    monkeypatch.setattr(spellings, "FEW", few)
    rows = variants() + [(None, "abcdefg abcdefg"), (None, None), (7, ""), (7, "abcdefg" * 3000), (8, "tiny words"), (9, "Á" * 8 + " " + "Á" * 8), (9, "Á" * 8 + " " + "Á" * 8)]
    got = sorted((tuple(r) for r in spellings.spelling_groups(frame(spark, rows)).collect()), key=lambda r: r[0])
    assert got == brute.spelling_groups(rows)
    assert any(r[1] is None and r[4] for r in got) and any(r[1] != r[2] for r in got if r[1])


def test_spelling_of_nothing(spark):
    assert spellings.spelling_groups(frame(spark, [])).collect() == []
    assert spellings.spelling_groups(frame(spark, [(1, None), (2, "a b c")])).collect() == []


def test_spelling_query(spark):
    got = sorted((tuple(r) for r in registered.QUERIES["op13_partenum_spellings"](spark, SF).collect()), key=lambda r: r[0])
    assert got == brute.spelling_groups(table_rows(spark))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(con.execute(registered.SQL["op13_partenum_spellings"]).fetchall(), key=lambda r: r[0]) == got


# -------------------------------------------------------------------- phrases

def phrase_rows():
    rng = random.Random(3)
    few = ["a", "B", "of the", "été", "x\x00y", "New York", "日本", "t\tu", "\x0b", "..", "; ", "a a a"]
    rows = [(" ".join(rng.choice(few) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("one", None), ("same text again and again " * 3, "de")] + [("same text again and again " * 3, "de")] * 4
    return rows + [("long winded, " * 200_000, "de"), ("ab" * 30_000 + " end", "de")]


def phrase_frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], "text string, lang string, doc int, key long, fp long, k long")


@pytest.mark.parametrize("bits, most, least", [(27, 2000, 3), (8, 5, 2)])
def test_collocations(spark, bits, most, least):
    rows = phrase_rows()
    got = sorted(tuple(r) for r in phrases.collocations(phrase_frame(spark, rows), most, least=least, bits=bits).collect())
    assert got == brute.collocations(rows, most, least) and len(got) > 20


def test_collocations_of_nothing(spark):
    assert phrases.collocations(phrase_frame(spark, [])).collect() == []
    assert phrases.collocations(phrase_frame(spark, [(None, None), ("", "en"), (" . ", "en")])).collect() == []


def test_long_texts_in_stretches(monkeypatch):
    """Stretches of a text give the same fingerprints as the whole text."""
    rng = random.Random(8)
    text = "".join(rng.choice(["word ", "a", ", ", " é", "longer\t", "." * 50, " " * 70]) for _ in range(3000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text.decode()])], ["lang", "text"])
    found = []
    for stretch, ahead in ((1 << 20, 1 << 12), (100, 7)):
        monkeypatch.setattr(phrases, "STRETCH", stretch)
        monkeypatch.setattr(phrases, "AHEAD", ahead)
        monkeypatch.setattr(common, "PIECE_BYTES", stretch)
        own = []
        for _, grams, past in phrases._grams(batch, (phrases.Polynomials(0),)):
            for k in range(1, 6):
                at = grams.starts(k)
                own += grams.prints(k, at[grams.first[at] < past]).tolist()
        found.append(sorted(own))
    assert found[0] == found[1] and len(found[0]) > 2500


def test_phrase_query(spark):
    got = sorted(tuple(r) for r in registered.QUERIES["op11_rabin_karp_phrases"](spark, SF).collect())
    assert got == brute.collocations([(r.text, r.lang) for r in common.table(spark, SF, "documents").select("text", "lang").collect()]) and got
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(con.execute(registered.SQL["op11_rabin_karp_phrases"]).fetchall()) == got
