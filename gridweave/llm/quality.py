"""Quality scores by compression: dictionaries of good and of bad text compete.

Two zstandard dictionaries are built from pieces of labelled good and bad
documents. Every whole text is cut into pieces and compressed with both; the
normalised size difference ``(bad - good) / (bad + good)`` says which side a text
resembles. A logistic fit on other labelled documents calibrates it to a
probability; it also sees how far the text compresses by itself (repetition
fits either dictionary) and its log length (short texts differ less).

Null and empty texts get the score of a text without evidence (difference 0,
ratio 1, length 0). Without rows of both labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import few_rows_at_once

LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionary contents, calibration weights (bias, difference, ratio, log length), piece size."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...] | None
    piece: int


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary; too few pieces to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _compressor(dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if own:
        own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)


def _pieces(text: str | None, piece: int) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + piece] for i in range(0, len(raw), piece)]


def _evidence(texts, good: bytes, bad: bytes, piece: int) -> np.ndarray:
    """A row (difference, ratio, log length) for each text."""
    to_good, to_bad, alone = _compressor(good), _compressor(bad), _compressor()
    out = np.tile([0.0, 1.0, 0.0], (len(texts), 1))
    for i, text in enumerate(texts):
        if parts := _pieces(text, piece):
            g = sum(len(to_good.compress(p)) for p in parts)
            b = sum(len(to_bad.compress(p)) for p in parts)
            n = sum(map(len, parts))
            out[i] = (b - g) / (b + g), min(1.0, len(alone.compress(text.encode())) / n), np.log1p(n) / 10
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method; both labels weigh the same."""
    x, weight = np.c_[np.ones(len(x)), x], np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(slope, x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, dictionary_bytes: int = 112_640, piece: int = 512) -> QualityModel:
    """Fits on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality 0 or 1).

    Bounded sample, chosen by a hash of doc_id: ``max_docs`` documents of each
    label, read whole. Two thirds give the pieces of the dictionaries, the others
    calibrate. Only those documents' pieces and calibration rows reach the driver.
    """
    few_rows_at_once(docs.sparkSession)
    order = F.xxhash64(F.lit(17), "doc_id")
    rows = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = [rows.where(F.col("quality") == q).orderBy(order, "doc_id").limit(max_docs) for q in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("calibrates", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0)

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _pieces(t, piece))

    parts = sample.where("not calibrates").select("doc_id", "quality", F.pandas_udf(cut, "array<binary>")("text").alias("parts")).collect()
    parts.sort(key=lambda r: (r.doc_id, [*map(bytes, r.parts)]))
    good, bad = ([bytes(x) for r in parts if r.quality == q for x in r.parts] for q in (1, 0))
    if not good or not bad:
        return QualityModel(b"", b"", None, piece)
    good, bad = _dictionary(good, dictionary_bytes), _dictionary(bad, dictionary_bytes)

    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_evidence(texts, good, bad, piece)), index=texts.index)

    seen = sample.where("calibrates").select("quality", F.pandas_udf(evidence, "array<double>")("text").alias("x")).collect()
    if len({r.quality for r in seen}) < 2:
        return QualityModel(good, bad, None, piece)
    return QualityModel(good, bad, _logistic(np.array([r.x for r in seen]), np.array([r.quality for r in seen])), piece)


def score(df: DataFrame, model: QualityModel, text: str = "text", into: str = "score") -> DataFrame:
    """Adds ``into`` (0 to 1, higher: better) computed from the whole ``text`` alone.

    A column already named ``into`` is replaced; rows and other columns stay.
    """
    few_rows_at_once(df.sparkSession)
    if model.weights is None:
        return df.withColumn(into, F.lit(0.5))

    def run(texts: pd.Series) -> pd.Series:
        x = _evidence(texts, model.good, model.bad, model.piece)
        return pd.Series(1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30))), index=texts.index)

    return df.withColumn(into, F.pandas_udf(run, "double")(text))
