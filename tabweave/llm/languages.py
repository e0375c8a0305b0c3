"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader, elastic-net penalties and a temperature fitted on rows left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, named, prepare, text_pieces
from .ngrams import bounded_sample, char_ngrams, id_text_crc, letter_chars, row_sums

#: Characters of the n-grams and bits of their buckets.
SIZES, BITS = (1, 2, 3), 16
#: Labelled texts that are learned from at most, and passes over them.
TRAIN_ROWS, EPOCHS = 4000, 3
#: Learning rate, its offset, and the penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 1e-3
#: Factor of the relative frequencies.
SCALE = 10.0
UNKNOWN = "und"


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): in how many of the task's texts each bucket occurs; bucket -1 counts the texts."""
    found, rows = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, _, data, offsets in text_pieces(batch.column(0)):
            chars, at, _ = letter_chars(data, offsets)
            grams = list(char_ngrams(chars, at, SIZES, BITS))
            n = len(offsets) - 1
            rows += n
            for top in range(0, n, 64):
                end = min(n, top + 64)
                seen = np.zeros((end - top, 1 << BITS), bool)
                for h, g in grams:
                    part = h[g[top]:g[end]]
                    seen[np.repeat(np.arange(end - top), np.diff(g[top:end + 1])), part] = True
                found += seen.sum(axis=0)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], rows))], ["bucket", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Weight of each bucket from its document frequency over all ``texts``: as many numbers as there are buckets."""
    counts = texts.mapInArrow(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r.bucket: r.n for r in counts}
    df = np.zeros(1 << BITS)
    for b, n in seen.items():
        if b >= 0:
            df[b] = n
    return np.log((1 + seen.get(-1, 0)) / (1 + df)) + 1


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights: zero while the summed gradient is within the absolute penalty."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: pa.Array, labels: np.ndarray, classes: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by bucket and class, biases, and the temperature.  Every fifth row only sets the temperature."""
    sparse = []
    for _, _, data, offsets in text_pieces(texts):
        chars, at, _ = letter_chars(data, offsets)
        grams = list(char_ngrams(chars, at, SIZES, BITS))
        for r in range(len(offsets) - 1):
            own = np.concatenate([h[g[r]:g[r + 1]] for h, g in grams])
            idx, count = np.unique(own, return_counts=True)
            sparse.append((idx, SCALE * count / max(1, len(own)) * idf[idx]))
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)
    order = np.random.default_rng(5)
    learn, rest = [i for i in range(len(sparse)) if i % 5], [i for i in range(len(sparse)) if not i % 5]
    for _ in range(EPOCHS):
        for i in order.permutation(learn):
            idx, x = sparse[i]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            error = softmax(x @ w + bias)
            error[labels[i]] -= 1
            g = x[:, None] * error
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx], n[idx] = zi + g - step * w, ni + g * g
            bias_n += error * error
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * error
    w = weights(z, n)
    if not rest:
        return w, bias, 1.0
    logits = np.array([sparse[i][1] @ w[sparse[i][0]] + bias for i in rest])
    heats = np.geomspace(0.2, 5, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(rest)), labels[rest]], 1e-12)).mean() for t in heats]
    return w, bias, float(heats[int(np.argmin(loss))])


def train(rows: DataFrame, limit: int = TRAIN_ROWS) -> dict:
    """A model from rows (id, text, lang).  Frequencies are counted over all of them, weights learned from at most ``limit`` texts in one task."""
    prepare(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null")
    sample, counts = bounded_sample(rows, "lang", limit)
    names = [c[0] for c in counts]
    if len(names) < 2:
        return {"names": names}
    idf = inverse_frequencies(rows.select("text"))
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("lang", pa.string())]))
        if not table.num_rows:
            return
        labels = np.array([names.index(x) for x in table.column("lang").to_pylist()])
        w, bias, heat = fit(table.column("text"), labels, len(names), shared.value)
        used = np.flatnonzero((w != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array([*w[used].tolist(), bias.tolist(), [heat]], pa.list_(pa.float64()))], ["bucket", "weights"])

    found = sample.select("text", F.col("lang").cast("string").alias("lang")).coalesce(1).mapInArrow(run, "bucket long, weights array<double>").collect()
    table = np.zeros((1 << BITS, len(names)), np.float32)
    bias, heat = np.zeros(len(names)), 1.0
    for r in found:
        if r.bucket >= 0:
            table[r.bucket] = np.array(r.weights) * idf[r.bucket] * SCALE
        elif r.bucket == -1:
            bias = np.array(r.weights)
        else:
            heat = r.weights[0]
    return {"names": names, "table": table, "bias": bias, "heat": heat}


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """(doc, lang, score) for each row.  A null text or one without letters is ``und`` with score 0, as is any text if no language was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = np.array(m["names"], object)

        def run(texts: pa.Array) -> list[pa.Array]:
            langs, scores = [], []
            for _, _, data, offsets in text_pieces(texts):
                chars, at, has = letter_chars(data, offsets)
                if len(names) > 1:
                    total, count = np.zeros((len(has), len(names))), np.zeros(len(has))
                    for h, g in char_ngrams(chars, at, SIZES, BITS):
                        total += row_sums(m["table"][h], g)
                        count += np.diff(g)
                    p = softmax((total / np.maximum(count, 1)[:, None] + m["bias"]) / m["heat"])
                    best = p.argmax(axis=1)
                    lang, score = names[best], p[np.arange(len(best)), best]
                else:
                    lang, score = np.full(len(has), names[0] if len(names) else UNKNOWN, object), np.ones(len(has)) * len(names)
                langs += np.where(has, lang, UNKNOWN).tolist()
                scores += np.where(has, score, 0.0).tolist()
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return run

    return map_texts(docs, make, "lang string, score double", keep, text_col)


def training_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 3, held_out: int = 1) -> DataFrame:
    """(id, text, lang) of the rows that may be learned from: the checksum of the id is not in the fold held out."""
    return docs.where(id_text_crc(named(id_col)) % folds != held_out).select(named(id_col).alias("id"), "text", "lang")
