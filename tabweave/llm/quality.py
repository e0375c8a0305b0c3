"""Quality classifier: supervised subword embeddings, averaged over a text and trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, named, prepare, text_pieces
from .languages import softmax
from .ngrams import bounded_sample, char_ngrams, code_points, id_text_crc, row_sums, word_buckets

#: Characters of the n-grams, bits of the buckets that they and the words share, and dimensions of a vector.
SIZES, BITS, DIMS = (3, 4), 17, 8
#: Labelled texts that are learned from at most, passes over them and the first learning rate.
TRAIN_ROWS, EPOCHS, RATE = 4000, 5, 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, of their repetitions and of character n-grams, each with row offsets."""
    chars, at = code_points(data, offsets)
    words, shapes, row = word_buckets(data, offsets, BITS)
    return [(words, row), (shapes, row), *char_ngrams(chars, at, SIZES, BITS)]


def fit(texts: pa.Array, labels: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the buckets, output weights and biases."""
    rows = []
    for _, _, data, offsets in text_pieces(texts):
        found = features(data, offsets)
        for r in range(len(offsets) - 1):
            # words and n-grams weigh the same, whatever their numbers
            parts = [h[g[r]:g[r + 1]] for h, g in found if g[r + 1] > g[r]]
            own = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            share = np.concatenate([np.full(len(p), 1 / len(parts) / len(p)) for p in parts]) if parts else np.zeros(0)
            idx, inverse = np.unique(own, return_inverse=True)
            rows.append((idx, np.bincount(inverse, weights=share, minlength=len(idx))))
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIMS)) / DIMS
    out, bias = np.zeros((DIMS, classes)), np.zeros(classes)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - done / steps)
            done += 1
            idx, x = rows[i]
            own = vectors[idx]
            hidden = x @ own
            error = softmax(hidden @ out + bias)
            error[labels[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            # each vector's own step, scaled up as its share of the mean is small
            vectors[idx] = own - rate * 20 * x[:, None] * back
    return vectors, out, bias


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from labels (id, label) and the texts of ``docs``: log-odds of each class for each bucket.  At most ``limit`` labels, about
    equally many of each kind, are drawn first, so their list is bounded and sent to the texts; one task learns from these texts.  The labels' own
    frequencies, over all of them, are added to the biases.  Of several texts of an id the largest is learned from."""
    prepare(docs.sparkSession)
    drawn, counts = bounded_sample(labels.where("label is not null"), "label", limit)
    sample = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(drawn), "id")
    sample = sample.groupBy("id", "label").agg(F.max("text").alias("text"))
    names = [c[0] for c in counts]
    prior = np.array([c[1] for c in counts], float)
    if len(names) < 2:
        return {"names": names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("label", pa.int32())]))
        if not table.num_rows:
            return
        labels = np.array([names.index(x) for x in table.column("label").to_pylist()])
        vectors, out, bias = fit(table.column("text"), labels, len(names))
        seen = np.bincount(labels, minlength=len(names))
        bias = bias + np.log(prior / prior.sum()) - np.log(np.maximum(seen, 1) / seen.sum())
        # a text's output is the mean of its buckets' outputs
        yield pa.RecordBatch.from_arrays([pa.array([(vectors @ out).astype(np.float32).tobytes()]), pa.array([bias.tolist()])], ["table", "bias"])

    made = sample.select("text", F.col("label").cast("int").alias("label")).coalesce(1).mapInArrow(run, "table binary, bias array<double>").first()
    return {"names": names, "table": np.frombuffer(made.table, np.float32).reshape(1 << BITS, len(names)), "bias": np.array(made.bias)}


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", label: int = 1) -> DataFrame:
    """(doc, score): the probability of ``label``.  A null text is empty, and an empty text's score is the labels' own frequency; without any
    labels it is 0.5, and with one kind of label 1 or 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = m["names"]
        mine = names.index(label) if label in names else None

        def run(texts: pa.Array) -> list[pa.Array]:
            scores = []
            for _, _, data, offsets in text_pieces(texts):
                n = len(offsets) - 1
                if len(names) < 2 or mine is None:
                    scores += [0.5 if not names else float(mine is not None)] * n
                    continue
                total, kinds = np.zeros((n, len(names))), np.zeros(n)
                for h, g in features(data, offsets):
                    count = np.diff(g)
                    total += row_sums(m["table"][h], g) / np.maximum(count, 1)[:, None]
                    kinds += count > 0
                p = softmax(total / np.maximum(kinds, 1)[:, None] + m["bias"])
                scores += p[:, mine].tolist()
            return [pa.array(scores, pa.float64())]

        return run

    return map_texts(docs, make, "score double", keep, text_col)


def training_labels(labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held_out: int = 0, label_col: str = "quality") -> DataFrame:
    """(id, label) of the rows that may be learned from: the checksum of the id is not in the fold held out.  Of several labels of an id the largest holds."""
    known = labels.where(id_text_crc(named(id_col)) % folds != held_out)
    return known.groupBy(named(id_col).alias("id")).agg(F.max(named(label_col)).cast("int").alias("label"))
