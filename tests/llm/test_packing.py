import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from gridweave.llm import packing
from gridweave.llm.queries import op4_packing, tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path("word_bpe_49k.json")


def filled(rows, capacity):
    """Total and number of sequences, after checking that each is gapless from 0."""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], r[2]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(r[2] for r in rows), len(by)


def test_whole_table_against_plain_tokenizer(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(list)
    rows = op4_packing(spark, SF).collect()
    for r in rows:
        got[r.doc_id].append(r)
    tok = Tokenizer.from_file(PATH)
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[d]) == want
    total, n = filled([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert n <= -(-total // 4096) * 1.01 + 1


def test_plans_keep_every_piece():
    rng = random.Random(3)
    for case in range(30):
        capacity = rng.choice([8, 64, 4096])
        hist = {rng.randint(1, capacity): rng.randint(1, 10 ** rng.randint(0, 4)) for _ in range(rng.randint(1, 300))}
        plan = packing.make_plan(hist, capacity)
        for v, n in hist.items():
            spans = sorted((a, b) for length, a, b, *_ in plan.rows if length == v)
            assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == n
        placed = [(s + t // each, off + t % each * v, v) for v, a, b, s, each, off in plan.rows for t in range(b - a)]
        total, n = filled(placed, capacity)
        assert n == plan.sequences


def test_encoder_equals_tokenizer():
    import pyarrow as pa

    texts = ["", None, "It's We'LL don't. a,b.", "A<|endoftext|>B", "<|EndOfText|>", "é é. naïve x\ty\r\nz\x1cq​w\u0085v", "12.5 3,4!! ..a", "ΑΣ. ΑΣ ΑΣΑ", "İI ß ǅ", " \n ", "x" * 5000]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    encode = packing._Encoder(PATH)
    for _ in range(2):
        assert [list(x) for x in encode(pa.array(texts))] == want
    # Without a special token to put between words, and with a small cache.
    for encode in (packing._Encoder(PATH), packing._Encoder(PATH, 3)):
        encode.mark = encode.mark if encode.cache_words == 3 else None
        for _ in range(3):
            assert [list(x) for x in encode(pa.array(texts))] == want


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b c", 0), (3, "a b c", 0), (4, "word " * 9000, 0)], "doc_id long, text string, sequence_id int")
    rows = packing.pack(docs, PATH, ids=True)
    assert rows.count() == 7
    filled([(r.sequence_id, r.offset, r.length) for r in rows.collect()], 4096)
    assert sum(len(r.ids) for r in packing.sequences(rows).collect()) == 1 + 1 + 4 + 4 + 9001
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_words_of_letters_are_encoded_without_marks():
    """They are told apart by the suffix of their last id; every text keeps the tokenizer's own ids."""
    import pyarrow as pa
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing._Encoder(path)
    marked = []
    plain = encode._marked
    encode._marked = lambda chunks: marked.extend(chunks) or plain(chunks)
    texts = ["İstanbul ÀÉÎ × ÷ ß Ÿ naïve don't we'll x’y", "ǅ ﬁ éa ΣΑΣ", "", None, " ", "a<|endoftext|>b <|x", "ñandú's 's're ÀÖØö x_y ab12ab 漢字", "plain words only"]
    got = encode(pa.array(texts))
    assert [x.tolist() for x in got] == [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert marked and not any(c.isascii() and c.isalpha() for c in marked)
