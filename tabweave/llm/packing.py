"""Packing along a space-filling curve: documents near each other on a Hilbert curve share sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, map_texts, named, stream, text_pieces
from .tokens import Tokenizer

#: Buckets of the hashed document vector, dimensions it is projected to, and bits of each on the curve.
BUCKETS, DIMS, BITS = 256, 3, 10
#: Token ids that one packing group holds.
GROUP_TOKENS = 1 << 22

FIELDS = "n long, ids binary, place long"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    """Path of the 50k byte-level vocabulary of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below ``1 << bits``, by Skilling's transpose
    ("Programming the Hilbert curve", 2004): undo the rotations bit by bit, Gray-encode, interleave."""
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            turned = (x[:, i] & q) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    carry = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        carry = np.where(x[:, -1] & q, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _axes() -> np.ndarray:
    """Fixed directions, one for each dimension, with entries of mean 0 and variance 1."""
    u = (stream(BUCKETS * DIMS, 11) >> np.uint64(11)).astype(float) / 2.0**53
    return ((u - 0.5) * np.sqrt(12)).reshape(BUCKETS, DIMS)


def curve_places(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each document: its token counts, hashed to buckets and scaled to length 1, projected to a few dimensions."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    bucket = ((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    vectors = np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(float)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    flat = (vectors - vectors.mean(axis=1, keepdims=True)) @ _axes()
    cells = np.clip(((np.tanh(flat) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells)


def tokenized(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text", closing: int = 0) -> DataFrame:
    """(doc, n, ids, place): ids with the ``closing`` id as little-endian 16-bit numbers, and the Hilbert key.  A null text is empty."""

    def make():
        encode = Tokenizer(tokenizer)

        def run(texts: pa.Array) -> list[pa.Array]:
            n, blobs, place = [], [], []
            for _, _, data, offsets in text_pieces(texts):
                ids, at = encode(data, offsets)
                counts = np.diff(at)
                place.append(curve_places(ids, at))
                # the closing id after each document
                full = np.full(len(ids) + len(counts), closing, np.uint16)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                ends = np.cumsum(counts + 1)
                n.append(counts + 1)
                raw = full.astype("<u2").tobytes()
                blobs += [raw[2 * a:2 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            return [pa.array(np.concatenate(n), pa.int64()), pa.array(blobs, pa.binary()), pa.array(np.concatenate(place), pa.int64())]

        return run

    return map_texts(docs, make, FIELDS, keep, text_col)


def packed(docs: DataFrame, tokenizer: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", closing: int = 0, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Documents follow each other along the Hilbert curve (equal keys by a number of the row) as one stream, cut at every ``length`` ids, so
    only the last sequence can be short.  The ids are written once; groups of near equal numbers of ids are cut from key quantiles, the
    groups' totals, one row each, give each group its place in the stream, and each group packs its documents alone.

    A null or empty text is the closing id alone.  Copies have the same key and are split over groups by the row number.  Repeated rows and
    equal ids each get their pieces; an empty table gives no rows; a very long document spans sequences and needs memory for its own ids."""
    spark = docs.sparkSession
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    # the row number breaks ties of the curve, scattered so that copies don't all come from one file
    rows = rows.withColumn("tie", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32)))
    ids = tokenized(rows, tokenizer, ["id", "tie"], "text", closing)
    ids = kept(ids.select("doc.id", (F.col("place") * (1 << 32) + F.col("doc.tie")).alias("key"), "n", "ids"), "packing-ids")
    total = ids.agg(F.sum("n")).first()[0]
    groups = max(1, -(-(total or 0) // group_tokens))
    shares = ", ".join(str(i / groups) for i in range(1, groups))
    cuts = np.array(ids.selectExpr(f"percentile_approx(key, array({shares}), {20 * groups})").first()[0] if groups > 1 else [], np.int64)

    @F.pandas_udf("int")
    def group_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "left").astype(np.int32))

    grouped = ids.withColumn("part", group_of("key"))
    # one row for each group
    starts = grouped.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    base = {r.part: r.base for r in starts.collect()}

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        n = group["n"].to_numpy()
        first = base[int(group["part"].iloc[0])] + np.cumsum(n) - n
        lots = (first + n - 1) // length - first // length + 1
        row = np.repeat(np.arange(len(group)), lots)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lots) - lots, lots)
        sequence = (first // length)[row] + nth
        begin = np.maximum(first[row], sequence * length)
        end = np.minimum((first + n)[row], (sequence + 1) * length)
        start, size = begin - first[row], end - begin
        wide = [np.frombuffer(b, "<u2").astype("<u4") for b in group["ids"]]
        crc = [zlib.crc32(wide[r][a:a + k].tobytes()) for r, a, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
        return pd.DataFrame({"id": group["id"].to_numpy()[row], "start": start, "length": size, "ids_crc32": crc, "doc_tokens": n[row], "sequence_id": sequence, "offset": begin - sequence * length})

    kind = ids.schema["id"].dataType.simpleString()
    out = grouped.groupBy("part").applyInPandas(pack, f"id {kind}, {PIECES}")
    return out.withColumnRenamed("id", id_col)
