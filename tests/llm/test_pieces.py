import itertools
import math
import re
from collections import Counter

import numpy as np

from gridweave.llm import pieces
from gridweave.llm.queries import op6_sentencepiece, tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path("piece_bpe_32k.model")


def every_path(vocabulary, text):
    """All segmentations of a short text whose characters all have pieces."""
    for cut in itertools.product((0, 1), repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(text)]
        parts = [vocabulary.ids.get(text[a:b]) for a, b in zip(at, at[1:])]
        if None not in parts:
            yield tuple(parts)


def test_samples_follow_the_exact_posterior():
    v = pieces.Vocabulary(PATH)
    n, text = 40_000, " the ation"
    ids, count = pieces.Sampler(v, 0.4)([text] * n, np.arange(n, dtype=np.uint64), 1)
    got = Counter(tuple(x) for x in np.split(ids, np.cumsum(count)[:-1]))
    weight = {p: math.prod((i + 1) ** -0.4 for i in p) for p in every_path(v, text)}
    total = sum(weight.values())
    assert set(got) <= set(weight) and len(weight) > 20
    for p, w in weight.items():
        want = n * w / total
        assert abs(got[p] - want) < 6 * math.sqrt(want) + 3


def test_whole_table_is_lossless_and_reproducible(spark):
    first = op6_sentencepiece(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert first.count() == docs.count() and first.where("not lossless").count() == 0
    again = pieces.encode(docs.repartition(7), PATH)
    assert first.select("doc_id", "ids").exceptAll(again.select("doc_id", "ids")).count() == 0
    back = pieces.decode(first.drop("text"), PATH).join(docs.select("doc_id", F_text(docs)), "doc_id")
    assert back.where("not (text <=> original)").count() == 0


def F_text(docs):
    from pyspark.sql import functions as F

    return F.coalesce(docs["text"], F.lit("")).alias("original")


def test_edges(spark):
    texts = [None, "", " ", "   a  b \n\n c ", "▁x▁ ▁", "日本語 \U0001f600é\x00\x7f", "x" * 50_000, "a" * 3 + " " * 40, "same", "same"]
    df = spark.createDataFrame([(i if i < 9 else 8, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = pieces.encode(df, PATH)
    assert got.where("lossless").count() == len(texts)
    back = {r.doc_id: r.text for r in pieces.decode(got, PATH).collect()}
    assert back == {i if i < 9 else 8: t or "" for i, t in enumerate(texts)}
    assert len({tuple(r.ids) for r in got.where("doc_id = 8").collect()}) == 1
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_whole_table_against_plain_filtering_and_sampling(spark):
    """Every text once more, a character at a time: masses of all paths to a place, then one piece after the other from the end."""
    v, known = pieces.Vocabulary(PATH), {}

    def edges(word):
        """Of every place but the first: (start, ids, running share) of the ways to it, by start."""
        if word not in known:
            mass, ways = [1.0], []
            for end in range(1, len(word) + 1):
                into = [(s, v.ids[word[s:end]]) for s in range(max(0, end - v.longest), end) if word[s:end] in v.ids]
                parts = [mass[s] / (i + 1) for s, i in into]
                mass.append(sum(parts) if into else mass[-1])
                run = list(itertools.accumulate(parts))
                share = [round(x / run[-1] * 2**24) / 2**24 for x in run[:-1]] + [1.0]
                bare = [(end - 1, [v.of_byte[b] for b in word[end - 1].encode()], 1.0)]
                ways.append([(s, [i], x) for (s, i), x in zip(into, share)] or bare)
            known[word] = ways
        return known[word]

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def sampled(text, key):
        out = []
        for place, word in enumerate(re.findall(r"\n|\x20*[^\x20\n]+|\x20+", text)):
            base, step, at, back = mix((mix(key) + place * 0x9E3779B97F4A7C15) % 2**64), 0, len(word), []
            while at:
                draw = (mix((base + step + 1) % 2**64) >> 40) / 2**24
                at, ids, _ = next(w for w in edges(word)[at - 1] if w[2] > draw)
                back += reversed(ids)
                step += len(ids)
            out += reversed(back)
        return out

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    got = {r.doc_id: r.ids for r in op6_sentencepiece(spark, SF).collect()}
    rows = docs.collect()
    assert len(rows) == len(got) == 1000
    for r in rows:
        assert got[r.doc_id] == sampled(r.text or "", r.key % 2**64)
