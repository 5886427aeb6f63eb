import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from gridweave.llm import balanced
from gridweave.llm.queries import op11_balanced_packing, tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """The rule, piece by piece over a plain list of sequences: the multiset of (size, parts) of all sequences."""
    open_ = [[0, room, room, []] for room, n in balanced.rooms_of(sum(lengths), capacity) for _ in range(n)]
    waiting = sorted(lengths, reverse=True)
    while waiting:
        v = waiting.pop(0)
        fitting = [s for s in open_ if s[1] >= v] or [s for s in open_ if s[1] > 0]
        best = min(fitting, key=lambda s: (s[0], s[1]))
        part = min(v, best[1])
        best[0] += balanced.cost_of(part)
        best[1] -= part
        best[3].append(part)
        if part < v:
            waiting = sorted([*waiting, v - part], reverse=True)
    assert all(s[1] == 0 for s in open_)
    return Counter((s[2], tuple(s[3])) for s in open_)


def test_groups_are_placed_as_one_by_one():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([8, 64, 100])
        hist = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        plan = balanced.make_plan(hist, capacity)
        places = balanced.Places(plan)
        got = defaultdict(dict)
        for v, n in hist.items():
            who, begin, m, sequence, offset = places(np.full(n, v), np.arange(n))
            at = defaultdict(int)
            for w, b, k, s, o in zip(*(x.tolist() for x in (who, begin, m, sequence, offset))):
                assert b == at[w]
                at[w] += k
                assert o not in got[s]
                got[s][o] = k
            assert dict(at) == dict.fromkeys(range(n), v)
        sizes = [room for room, n in balanced.rooms_of(sum(v * n for v, n in hist.items()), capacity) for _ in range(n)]
        for s, parts in got.items():
            ends = np.cumsum([k for _, k in sorted(parts.items())]).tolist()
            assert sorted(parts) == [0, *ends[:-1]] and ends[-1] == sizes[s]
        assert len(got) == len(sizes)
        want = one_by_one([v for v, n in hist.items() for _ in range(n)], capacity)
        assert Counter((sizes[s], tuple(k for _, k in sorted(parts.items()))) for s, parts in got.items()) == want


def test_whole_table_against_plain_tokenizer(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op11_balanced_packing(spark, SF).collect()
    tok = Tokenizer.from_file(PATH)
    by, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by.keys() == docs.keys()
    for d, text in docs.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    full = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
        full += at == 2048
    # No padding at all; few documents are cut that need not be.
    assert full == sum(r.length for r in rows) // 2048
    assert len(rows) <= 1.35 * sum(-(-r[0].doc_tokens // 2048) for r in by.values())


def test_edges(spark):
    rows = [(1, None, 0, 0), (2, "", 0, 0), (3, "a b c", 0, 0), (3, "a b c", 0, 0), (None, "x", 0, 0), (4, "word " * 9000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int, uid int")
    got = balanced.pack(docs, PATH).collect()
    count = Counter()
    for r in got:
        count[r.doc_id] += r.length
    assert count == {1: 1, 2: 1, 3: 8, None: 2, 4: 9001}
    ends = defaultdict(int)
    for r in got:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert sum(ends.values()) == sum(r.length for r in got)
    assert balanced.pack(docs.limit(0), PATH).count() == 0
