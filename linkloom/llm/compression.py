"""Operator 13: quality as the difference of compressed sizes under two dictionaries.

Labelled texts give bytes for two zstandard dictionaries, of good and of bad texts: of each class
at most ``TEXTS`` documents, the least by hash of their id, a piece of at most ``PIECE`` bytes at
a hashed place of each. A text is cut into parts of ``PART`` bytes, and all are compressed with
either dictionary. The sizes' difference as a share of the text's bytes says which
dictionary the text is closer to; the compressed share itself tells text that repeats itself,
which both compress alike. A logistic function of the two, fitted on at most ``FITTED`` other
labelled rows, calibrates the score.

Rows are dealt by crc32 of the id as text modulo 5: 0 is held out, 1 and 2 give bytes, 3 and 4 fit
the function. The bounds are the only ones: every whole text is scored.

Defined results: a null text is empty; an empty text has the score of no difference; ids with
labels of both kinds, and null ids, teach nothing, a null id is not held out; without texts
of both classes the score is the share of label 1 among the fitting rows, or a half; repeated rows
are scored alike; an empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm import _text as tx

#: The bounds of the sample that is learned from.
TEXTS, PIECE, FITTED = 1024, 1024, 16384
#: Bytes of a dictionary, bytes that are compressed at once, and how hard.
DICTIONARY, PART, LEVEL = 65536, 512, 3
#: The score from which a text is predicted to be good.
THRESHOLD = 0.3
FOLDS, HELD, BYTES = 5, 0, (1, 2)
#: Bytes added to both sizes, so that short texts do not weigh by chance; scale of the difference.
EASE, SCALE = 8.0, 20.0


@dataclass(frozen=True)
class Model:
    """good and bad: dictionaries (bytes); weights of 1, difference and logarithm of the compressed share."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _compressor(data: bytes):
    import zstandard as zs

    if not data:
        return zs.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zs.ZstdCompressionDict(data)
    known.precompute_compress(level=LEVEL)
    return zs.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def dictionary(pieces: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained on pieces; where they are too few for that, their bytes as they are."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, pieces).as_bytes()
    except zs.ZstdError:
        return b"\n".join(pieces)[-size:]


def sizes(text: bytes, compressors) -> list[int]:
    """The compressed bytes of all parts, by each compressor."""
    parts = [text[k : k + PART] for k in range(0, len(text), PART)]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors]


def inputs(good: np.ndarray, bad: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """1, the normalised difference (over 0: closer to good), and the logarithm of the share under the good dictionary."""
    difference = SCALE * (bad - good) / np.maximum(raw, 1)
    share = np.log((good + EASE) / (raw + EASE))
    return np.stack([np.ones(len(raw)), difference, share], 1)


def calibrated(x: np.ndarray, label: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Weights of the logistic function, by Newton steps on the ridged likelihood."""
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(3), x.T @ (label - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-10:
            break
    return tuple(float(v) for v in w)


def measured(docs: DataFrame, carry: list[str], good: bytes, bad: bytes, text: str = "text") -> DataFrame:
    """The columns ``carry``, n_good, n_bad (compressed bytes) and n_raw of every row."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        both = [_compressor(good), _compressor(bad)]
        for batch in batches:
            buf, offs = tx.raw(batch.column(len(carry)))
            view = memoryview(buf)
            found = np.array([sizes(view[a:b], both) for a, b in zip(offs[:-1], offs[1:])], np.int64).reshape(-1, 2)
            columns = [batch.column(i) for i in range(len(carry))] + [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.diff(offs))]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "n_good", "n_bad", "n_raw"])

    return docs.select(*carry, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{kinds}, n_good long, n_bad long, n_raw long")


def _learned(labels: DataFrame, key: str, label: str) -> DataFrame:
    """_id, _label, _fold, _order of the ids that teach: those of one label, not held out."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_other")).filter("_label = _other")
    return one.select("_id", "_label", fold(F.col("_id")).alias("_fold"), F.xxhash64(F.col("_id").cast("string")).alias("_order")).filter(F.col("_fold") != HELD)


def _pieces(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> list[tuple[int, bytes]]:
    """(label, piece) of the chosen documents, in an order that the table's layout has no part in."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("_id"), body.alias("_body")).join(F.broadcast(chosen), "_id")
    room = F.greatest(F.octet_length("_body") - PIECE, F.lit(0)) + 1
    rows = rows.select("_label", "_order", F.substring("_body", F.pmod(F.xxhash64("_order"), room).cast("int") + 1, F.lit(PIECE)).alias("_piece"))
    # a bounded number of ids; ids that repeat give their least piece
    rows = rows.groupBy("_label", "_order").agg(F.min("_piece").alias("_piece"))
    return [(r["_label"], bytes(r["_piece"])) for r in rows.orderBy("_order", "_piece").collect() if r["_piece"]]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", texts: int = TEXTS, fitted: int = FITTED) -> Model:
    """The dictionaries and the calibration, from at most 2 * ``texts`` and ``fitted`` labelled rows."""
    known = _learned(labels, key, label)
    chosen = None
    for value in (0, 1):
        least = known.filter((F.col("_label") == value) & F.col("_fold").isin(*BYTES)).orderBy("_order", "_id").limit(texts)
        chosen = least if chosen is None else chosen.unionByName(least)
    found = _pieces(docs, chosen.select("_id", "_label", "_order"), key, text)
    by_label = {value: [p for x, p in found if x == value] for value in (0, 1)}
    good, bad = (dictionary(by_label[value]) if by_label[value] else b"" for value in (1, 0))
    rest = known.filter(~F.col("_fold").isin(*BYTES)).orderBy("_order", "_id").limit(fitted).select("_id", "_label")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_body")).join(F.broadcast(rest), "_id")  # at most ``fitted`` ids
    seen = measured(rows, ["_id", "_label"], good, bad, "_body").distinct().groupBy("_id").agg(*(F.min(c).alias(c) for c in ("_label", "n_good", "n_bad", "n_raw"))).orderBy("_id").toPandas()
    y = seen["_label"].to_numpy(float)
    if not good or not bad or len(set(y)) < 2:
        share = y.mean() if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(good, bad, (float(np.log(share / (1 - share))), 0.0, 0.0))
    x = inputs(*(seen[c].to_numpy(float) for c in ("n_good", "n_bad", "n_raw")))
    return Model(good, bad, calibrated(x, y))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted, and the sizes n_good, n_bad and n_raw that the score is made of."""
    base, by_difference, by_share = model.weights
    rows = measured(docs.select(F.col(key).alias("_key"), F.col(text).alias("_body")), ["_key"], model.good, model.bad, "_body")
    difference = SCALE * (F.col("n_bad") - F.col("n_good")) / F.greatest(F.col("n_raw"), F.lit(1))
    share = F.log((F.col("n_good") + EASE) / (F.col("n_raw") + EASE))
    score = 1 / (1 + F.exp(-(F.lit(base) + by_difference * difference + by_share * share)))
    held = F.coalesce(fold(F.col("_key")) == HELD, F.lit(False))
    return rows.select(F.col("_key").alias(key), held.alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_good", "n_bad", "n_raw")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
