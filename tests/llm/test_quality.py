import numpy as np
import zstandard
from pyspark.sql import functions as F

from gridweave.llm import quality
from gridweave.llm.queries import op3_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.93
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(i, ("plain words here and there " if i % 2 else "SPAM!!! $$$ ") * 20, "x") for i in range(60)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "plain words here", "c"), (3, "plain words here", "c"), (4, "SPAM!!! $$$ " * 3, "d"), (5, "x" * 3_000_000, "e")], docs.schema)
    got = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert got[1] == got[2] and got[3] > got[4] and 0 <= got[5] <= 1
    assert quality.score(odd.limit(0), model).count() == 0
    assert quality.score(odd, quality.fit(docs, labels.where("quality = 1"))).select("score").distinct().collect()[0].score == 0.5
    assert quality.fit(docs.limit(0), labels.limit(0)).weights is None


def test_against_a_plain_fit_and_score(spark):
    """The whole query once more, text by text: same dictionaries, sizes, calibration and scores."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).withColumn("c", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0).orderBy("doc_id").collect()
    assert 100 < len(learned) < 2000
    cut = lambda raw: [raw[i : i + 512] for i in range(0, len(raw), 512)]
    books = [zstandard.train_dictionary(112_640, [x for r in learned if not r.c and r.quality == q for x in cut(docs[r.doc_id])]).as_bytes() for q in (1, 0)]
    ways = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(b), write_content_size=False, write_dict_id=False) for b in books]
    alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False)

    def evidence(raw):
        if not raw:
            return [1.0, 0.0, 1.0, 0.0]
        good, bad = (sum(len(w.compress(x)) for x in cut(raw)) for w in ways)
        return [1.0, (bad - good) / (bad + good), min(1.0, len(alone.compress(raw)) / len(raw)), np.log1p(len(raw)) / 10]

    fitted = [r for r in learned if r.c]
    x, y = np.array([evidence(docs[r.doc_id]) for r in fitted]), np.array([r.quality for r in fitted])
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    w = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (share * p * (1 - p))) @ x + 0.01 * np.eye(4), x.T @ (share * (p - y)) + 0.01 * w)
    for r in op3_quality(spark, SF).collect():
        assert abs(r.score - 1 / (1 + np.exp(-np.dot(evidence(docs[r.doc_id]), w)))) < 1e-6


def test_all_pieces_of_the_sample_are_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " + "abc " * 400 * (i % 7)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    train = quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda pieces, size: seen.extend(pieces) or train(pieces, size))
    quality.fit(docs, labels)
    picked = docs.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) != 0).collect()
    assert sum(map(len, seen)) == sum(len(r.text) for r in picked)
