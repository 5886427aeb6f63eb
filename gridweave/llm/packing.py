"""Packing documents into fixed-length token sequences by patterns of lengths.

1. ``tokenize`` turns whole texts into ids and cuts only what exceeds a sequence.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input)
   goes to the driver. Patterns of two to four lengths that fill a sequence are
   enumerated, their repeat counts fitted to the histogram by non-negative least
   squares and rounded down; what they leave is packed best fit, longest first,
   again on the histogram alone.
3. Pieces of a length are numbered by Spark, salted so that a common length is
   not one task's work, and each number has its place in the plan.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import batches_of, few_rows_at_once, freeing, stored

CACHE_WORDS = 200_000


class _Encoder:
    """Ids of texts. Chunks between blanks are encoded once and remembered.

    The tokenizer drops white space, so chunks are independent of each other.
    ASCII letters are lower-cased first and a blank is put between a letter and
    the punctuation after it, where the tokenizer splits anyway. Texts that may hold
    a special token are encoded as they are. New chunks are encoded many at a time:
    words of letters alone with blanks in between, told apart by the suffix that the last id of a word has,
    others with a special token after each, at which the tokenizer splits before all else.
    """

    # Letters that normal forms leave alone and that have one lower case each.
    letters = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self.mark = min(((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")), default=None)
        suffix, self.last = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.seen, self.flat, self.size, self.uses = {}, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _make_room(self) -> None:
        """Forgets all chunks but those most batches had, half of the room at most; most chunks come once."""
        best = np.argsort(-self.uses, kind="stable")[: min(self.cache_words // 2, int((self.uses > 1).sum()))]
        best.sort()
        begin, size = (np.cumsum(self.size) - self.size)[best], self.size[best]
        keep, names = set(best.tolist()), list(self.seen)
        self.flat = self.flat[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]
        self.size, self.uses = size, self.uses[best] // 2
        self.seen = {c: i for i, c in enumerate(c for i, c in enumerate(names) if i in keep)}

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        parts = (texts[i : i + 4096] for i in range(0, len(texts), 4096))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _words(self, words: list[str], at_once: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, and how many each has; none if the ids do not tell as many words."""
        ids = np.concatenate(self._direct([" ".join(words[i : i + at_once]) for i in range(0, len(words), at_once)]))
        ends = np.flatnonzero(self.last[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) and ends[-1] == len(ids) - 1 else None

    def _each(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks, words of letters first, their ids end to end, and how many each has."""
        named = pa.array(chunks, pa.large_string())
        of_letters = pc.match_substring_regex(named, self.letters)
        words = named.filter(of_letters).to_pylist() if self.last is not None else []
        made = self._words(words) if words else None
        if made is None:
            return chunks, *self._marked(chunks)
        rest = named.filter(pc.invert(of_letters)).to_pylist()
        if not rest:
            return words, *made
        return words + rest, *(np.concatenate(x) for x in zip(made, self._marked(rest)))

    def _marked(self, chunks: list[str], at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any chunks end to end, and how many each has."""
        if self.mark is None:
            ids = self._direct(chunks)
            return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        number, text = self.mark
        ids = np.concatenate(self._direct([text.join(chunks[i : i + at_once]) + text for i in range(0, len(chunks), at_once)]))
        marks = ids == number
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1) - 1

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """Places of the chunks among those remembered."""
        if len(self.seen) > self.cache_words:
            self._make_room()
        new = [c for c in chunks if c not in self.seen]
        if new:
            new, ids, size = self._each(new)
            self.seen.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.size = np.r_[self.size, size]
            self.flat = np.concatenate([self.flat, ids])
            self.uses = np.r_[self.uses, np.zeros_like(size)]
        found = np.fromiter(map(self.seen.__getitem__, chunks), np.int64, len(chunks))
        self.uses[found] += 1
        return found

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.ascii_lower(texts.filter(pa.array(~special)))
        plain = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " "), r"([a-z])([.,!?;:|#$%&*]+)", r"\1 \2")
        words = pc.split_pattern(plain, " ")
        coded = pc.list_flatten(words).dictionary_encode()
        code = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        end = np.cumsum(self.size[code])
        flat = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(self.size)], self.flat).take(pa.array(code)).flatten().to_numpy()
        stop = np.r_[0, end][np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))]
        found = iter(np.split(flat, stop[:-1]) if len(stop) else [])
        direct = iter(self._direct(texts.filter(pa.array(special)).to_pylist()) if special.any() else [])
        return [next(direct) if s else next(found) for s in special]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 [, ids].

    Null texts count as empty; an empty text is the end id alone. A repeated
    doc_id gives repeated pieces. ``tokenizer`` is a path that executors can read.
    """
    few_rows_at_once(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(it):
        # One for each task: workers outlive their tasks, and would hold its memory.
        encode = _Encoder(tokenizer)
        for batch in batches_of(it, "text", 4 << 20):
            out = defaultdict(list)
            for doc, found in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                found = np.append(found, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(found), capacity)):
                    part = found[start : start + capacity]
                    row = (doc, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * ids))
                    for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), row):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in target})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select("doc_id", "text").mapInArrow(freeing(run), schema)


@dataclass
class _Plan:
    """Rows (length, first, last, sequence, each, offset): the pieces of that length numbered
    first to last - 1 go, ``each`` to a sequence, into sequences from ``sequence`` on at ``offset``."""

    rows: list
    used: dict
    sequences: int = 0

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.used[length], self.used[length] + n, sequence, each, offset))
        self.used[length] += n


def patterns_of(lengths: list[int], capacity: int, per_length: int = 12, slack: int = 0) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths whose sum is ``capacity`` less ``slack`` at most."""
    have, found = sorted(lengths), set()

    def fit(room: int) -> int:
        k = bisect.bisect_right(have, room) - 1
        return have[k] if k >= 0 else 0

    for a in have:
        for step in range(per_length):
            made, room = [a], capacity - a
            for depth in range(3):
                # Other first partners for each step: the tightest, then ever shorter ones.
                b = fit(room if depth or not step else room * (per_length - step) // per_length)
                if not b:
                    break
                made.append(b)
                room -= b
                if room <= slack:
                    break
            if 0 <= room <= slack and len(made) > 1:
                found.add(tuple(sorted(made, reverse=True)))
    return sorted(found)


def repeats_of(patterns: list[tuple[int, ...]], histogram: dict[int, int], rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats of the patterns that fit the histogram (projected gradient with momentum)."""
    lengths = {v: i for i, v in enumerate(sorted(histogram))}
    row = np.array([lengths[v] for p in patterns for v in p], np.int64)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    target = np.array([histogram[v] for v in sorted(histogram)], float)
    x = y = np.zeros(len(patterns))
    load = np.bincount(row, minlength=len(target)).astype(float)
    rate, t = 1 / max(1.0, np.bincount(col, load[row]).max()), 1.0
    for _ in range(rounds):
        gap = np.bincount(row, y[col], len(target)) - target
        new = np.maximum(0, y - rate * np.bincount(col, gap[row], len(patterns)))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def make_plan(histogram: dict[int, int], capacity: int) -> _Plan:
    left = dict(histogram)
    plan = _Plan([], {v: 0 for v in histogram})
    patterns = patterns_of(list(histogram), capacity)
    if patterns:
        fitted = repeats_of(patterns, histogram)
        for k in np.argsort(-fitted, kind="stable"):
            each = {v: patterns[k].count(v) for v in patterns[k]}
            n = min(int(fitted[k] + 1e-6), *(left[v] // m for v, m in each.items()))
            if n:
                offset = 0
                for v, m in each.items():
                    plan.put(v, n * m, plan.sequences, m, offset)
                    left[v] -= n * m
                    offset += v * m
                plan.sequences += n
    # Best fit, longest first. Sequences of equal room are handled together: room -> [(first, count)].
    rooms: list[int] = []
    groups: dict[int, list] = {}

    def leave(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for v in sorted(left, reverse=True):
        n = left[v]
        while n:
            k = bisect.bisect_left(rooms, v)
            if k < len(rooms):
                room = rooms[k]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first, count = capacity, plan.sequences, -(-n // (capacity // v))
                plan.sequences += count
            each = room // v
            full = min(count, n // each)
            some = n - full * each if full < count else 0
            plan.put(v, full * each, first, each, capacity - room)
            leave(room - each * v, first, full)
            if some:
                plan.put(v, some, first + full, some, capacity - room)
                leave(room - some * v, first + full, 1)
            leave(room, first + full + bool(some), count - full - bool(some))
            n -= full * each + some
    plan.rows = [r for r in plan.rows if r[2] > r[1]]
    return plan


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, length; length from 1 to ``capacity``).

    ``pieces`` is read twice, so hand in stored rows. Equal lengths are told
    apart by doc_id and piece; full ties may swap places with each other.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = np.array(sorted(make_plan(histogram, capacity).rows), np.int64).reshape(-1, 6)
    # (length, number) as one sorted key: numbers stay below 2^40.
    key = (rows[:, 0] << 40) + rows[:, 1]

    def find(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at = rows[np.searchsorted(key, (length.to_numpy() << 40) + number.to_numpy(), side="right") - 1]
        t = number.to_numpy() - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + t // at[:, 4], "offset": at[:, 5] + t % at[:, 4] * length.to_numpy()})

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    counts = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("__row", F.row_number().over(within)).join(counts, ["length", "__salt"])
    placed = numbered.withColumn("__at", F.pandas_udf(find, "sequence_id long, offset long")("length", F.col("__before") + F.col("__row") - 1))
    return placed.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")], "__at.sequence_id", "__at.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """``tokenize`` and ``place`` together; the pieces are stored in between."""
    return place(stored(tokenize(docs, tokenizer, capacity, end_id, ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in order (needs ``ids=True``); at most one sequence's ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
