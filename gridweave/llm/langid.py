"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed character n-grams is fitted; a text's margins on all bits are decoded to
the codeword of least logistic loss, each bit weighted by how well its classifier
did in training. The score is the softmax of those losses; a text whose two
nearest codewords lie close together is flagged ambiguous.

Texts that are null or hold no letter are ``und`` with score 0. Without training
rows every text is ``und``; with one language, it is always that.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.common import batches_of, mix64, text_bytes

UNKNOWN = "und"
ORDERS = (2, 3, 4)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, their codewords (+1/-1), bit weights, and a weight per n-gram bucket and bit."""

    langs: tuple[str, ...]
    codes: np.ndarray
    bit_weights: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """All distinct two-way splits for up to 6 classes, else random rows far apart."""
    if k <= 6:
        splits = [b for b in itertools.product((-1, 1), repeat=k) if b[0] == 1 and -1 in b]
        return np.array(splits, dtype=np.float32).reshape(-1, k).T
    bits, rng = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed)
    tries = [rng.choice(np.array([-1, 1], np.float32), (k, bits)) for _ in range(200)]
    return max(tries, key=lambda c: (bits - (c @ c.T - 2 * bits * np.eye(k)).max()))


def _grams(raw: np.ndarray, buckets: int):
    """Bucket of the n-gram that begins at each byte, per order; -1 where the text is too short.

    Letters of ASCII are lower-cased; digits, punctuation and white space all
    count as one blank, so that only letters speak.
    """
    kind = np.arange(256, dtype=np.uint64)
    kind[65:91] += 32
    kind[:65] = kind[91:97] = kind[123:128] = 32
    x = kind[raw]
    for n in ORDERS:
        code = np.zeros(len(x), dtype=np.uint64)
        for i in range(n):
            code[: max(0, len(x) - i)] |= x[i:] << np.uint64(8 * i)
        yield n, (mix64(code + np.uint64(n << 40)) % np.uint64(buckets)).astype(np.int64)


def _margins(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, window: int = 1 << 18) -> np.ndarray:
    """Mean weight over the n-grams of each text (a row for each), for each bit; memory is for one window."""
    total, count = np.zeros((len(offsets) - 1, weights.shape[1])), np.zeros(len(offsets) - 1)
    begin, lengths = offsets[:-1], np.diff(offsets)
    for start in range(0, len(raw), window):
        for n, at in _grams(raw[start : start + window + max(ORDERS) - 1], len(weights)):
            sums = np.zeros((min(window, len(at)) + 1, weights.shape[1]))
            np.cumsum(weights[at[:window]], axis=0, out=sums[1:])
            low, high = (np.clip(x - start, 0, len(sums) - 1) for x in (begin, begin + np.maximum(lengths - n + 1, 0)))
            total += sums[high] - sums[low]
            count += high - low
    return total / np.maximum(count, 1)[:, None]


def _counts(raw: np.ndarray, buckets: int, window: int = 1 << 18) -> np.ndarray:
    """How many n-grams of a text fall in each bucket; memory is for one window."""
    out = np.zeros(buckets, np.int64)
    for start in range(0, len(raw), window):
        for n, at in _grams(raw[start : start + window + max(ORDERS) - 1], buckets):
            out += np.bincount(at[: max(0, min(window, len(raw) - n + 1 - start))], minlength=buckets)
    return out


def _features(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, hash, bucket, n): the n-gram counts of every text, whole, without the empty buckets."""

    def run(it):
        for batch in batches_of(it, "text", 4 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            counts = [_counts(raw[a:b], buckets) for a, b in zip(offsets, offsets[1:])]
            full = [np.flatnonzero(c) for c in counts]
            off = pa.array(np.r_[0, np.cumsum([len(f) for f in full])], pa.int32())
            cols = [pa.array(np.concatenate([*full, np.zeros(0, np.int64)]), pa.int32()), pa.array(np.concatenate([*(c[f] for c, f in zip(counts, full)), np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *(pa.ListArray.from_arrays(off, c) for c in cols)], names=["doc_id", "hash", "bucket", "n"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, rows.drop("text").schema.add("bucket", T.ArrayType(T.IntegerType())).add("n", T.ArrayType(T.LongType())))


def fit(docs: DataFrame, max_docs: int = 600, buckets: int = 8192, rounds: int = 150) -> LanguageModel:
    """Fits on ``docs`` (doc_id, text, lang), rows of null lang or text aside.

    Bounded sample, chosen by a hash of doc_id: ``max_docs`` texts of each
    language, read whole; only their bucket counts reach the driver. Languages
    are few; their count is the number of classes.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    langs = tuple(sorted(r.lang for r in rows.groupBy("lang").agg(F.count("*")).collect()))
    order = F.xxhash64(F.lit(29), "doc_id")
    sample = []
    for lang in langs:
        picked = rows.where(F.col("lang") == lang).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_docs)
        of_lang = _features(rows.where(F.col("lang") == lang).join(F.broadcast(picked), "doc_id"), buckets)
        found = of_lang.orderBy("doc_id", "hash").limit(max_docs).select("bucket", "n").toArrow()
        sample += [(lang, np.array(b), np.array(n)) for b, n in zip(found["bucket"].to_pylist(), found["n"].to_pylist())]
    codes = codewords(len(langs)) if len(langs) > 1 else np.ones((len(langs), 0), np.float32)
    if codes.shape[1] == 0:
        return LanguageModel(langs, codes, np.zeros(0), np.zeros((buckets, 0), np.float32), np.zeros(0))
    x, y = np.zeros((len(sample), buckets), np.float32), codes[[langs.index(lang) for lang, _, _ in sample]]
    for row, (_, bucket, n) in zip(x, sample):
        if len(bucket):
            row[bucket] = n / n.sum()
    center = x.mean(axis=0)
    scale = 1 / np.sqrt(np.maximum(center, 1e-5))
    z, each = (x - center) * scale, 1 / np.array([sum(lang == other for other, _, _ in sample) for lang, _, _ in sample], np.float32)[:, None]
    w, rate = np.zeros((buckets, y.shape[1]), np.float32), 2.0 / max(1e-6, float((z * z).sum(axis=1).mean()))
    for _ in range(rounds):
        pull = each / each.mean() * y / (1 + np.exp(y * (z @ w)))
        w += rate * (z.T @ pull / len(z) * len(langs) - 1e-3 * w)
    right = ((z @ w) * y > 0).mean(axis=0)
    spread = 1 / np.maximum(np.abs(z @ w).mean(axis=0), 1e-6) * 3
    w = w * scale[:, None] * spread
    return LanguageModel(langs, codes, np.maximum(2 * right - 1, 1e-3), w.astype(np.float32), -(center @ w))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), gap: float = 0.2) -> DataFrame:
    """Columns ``keep`` and (lang_pred, score, ambiguous) for every row, from its whole text."""
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(it):
        for batch in batches_of(it, "__text", 4 << 20):
            raw, offsets = text_bytes(batch.column("__text"))
            known = batch.column("__known").to_numpy(zero_copy_only=False).astype(bool)
            best, score, close = np.zeros(len(known), np.int64), np.ones(len(known)), np.zeros(len(known), bool)
            if len(model.langs) > 1:
                margin = _margins(raw, offsets, model.weights) + model.bias
                loss = (np.logaddexp(0, -margin[:, None, :] * model.codes) * model.bit_weights).sum(axis=2)
                best = loss.argmin(axis=1)
                share = np.exp(loss.min(axis=1, keepdims=True) - loss)
                share = np.sort(share / share.sum(axis=1, keepdims=True), axis=1)
                score, close = share[:, -1], share[:, -1] - share[:, -2] < gap
            known &= len(model.langs) > 0
            names = np.array([*model.langs, UNKNOWN], dtype=object)
            cols = [batch.column(c) for c in keep]
            cols += [pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & close)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "ambiguous"])

    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return df.select(*keep, F.col(text).alias("__text"), known.alias("__known")).mapInArrow(run, schema)
