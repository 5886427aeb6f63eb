"""Packing with balanced cost: descending pieces go to the cheapest sequence that has room.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention stays
within a piece. The sequences are as many as the tokens need: all but a last few
hold ``capacity`` tokens, and what is left over is told off to sequences of a power
of two each, which need no padding. Documents longer than ``capacity`` are cut at
its multiples; the pieces then go, longest first, to the sequence of lowest cost so
far that has room for the whole piece (equal costs: the one with less room). Where
none has, the cheapest one with any room takes as much as it holds, and the rest of
the piece waits its turn as a shorter one. So all sequences end up full.

The plan is made on the driver from the histogram of piece lengths (at most
``capacity`` rows, whatever the input): sequences in the same state are one group
and pieces of one length are placed many at a time, exactly as one by one. Spark
numbers the pieces of a length, salted so that a common length is not one task's
work, and each number has its places in the plan.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridweave.llm.common import batches_of, few_rows_at_once, freeing, maybe_among, stored
from gridweave.llm.packing import _Encoder

# Multiply-adds of a transformer layer of width d: about 6 d a token against 1 for each pair of tokens, here for d = 1024.
LINEAR, QUADRATIC = 6144, 1
# Words that a task remembers, about 100 bytes each.
CACHE_WORDS = 400_000
_NONE = np.iinfo(np.int64).max


def cost_of(n: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> int:
    return linear * n + quadratic * n * n


def rooms_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """(room, how many sequences) whose sum is ``total``: full ones, then a power of two for each bit of the rest."""
    full, rest = divmod(total, capacity)
    return [(capacity, full)] * (full > 0) + [(1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def make_plan(histogram: dict[int, int], capacity: int, linear: int = LINEAR, quadratic: int = QUADRATIC) -> np.ndarray:
    """Rows (length, first, last, begin, n, sequence, offset): of the pieces of that length those numbered first to
    last - 1 have their n tokens from ``begin`` on at ``offset`` of the sequences ``sequence``, ``sequence`` + 1 and so on."""
    rooms = rooms_of(sum(v * n for v, n in histogram.items()), capacity)
    size = np.array([r for r, _ in rooms], np.int64)
    many = np.array([n for _, n in rooms], np.int64)
    state = {"room": size.copy(), "cost": np.zeros_like(size), "size": size, "many": many, "first": np.cumsum(many) - many}
    used = len(size)
    rank, rows = count(), []
    waiting = [(-v, next(rank), v, 0, n, 0) for v, n in sorted(histogram.items(), reverse=True) if n]
    heapq.heapify(waiting)
    while waiting:
        v, _, length, first, n, begin = heapq.heappop(waiting)
        v = -v
        while n:
            room = state["room"][:used]
            key = state["cost"][:used] * (capacity + 1) + room
            fits = np.where(room >= v, key, _NONE)
            k = int(fits.argmin())
            if fits[k] == _NONE:
                k = int(np.where(room > 0, key, _NONE).argmin())
            part, m = min(v, int(room[k])), min(n, int(state["many"][k]))
            rows.append((length, first, first + m, begin, part, int(state["first"][k]), int(state["size"][k] - room[k])))
            if part < v:
                heapq.heappush(waiting, (part - v, next(rank), length, first, m, begin + part))
            if m < state["many"][k]:
                if used == len(state["room"]):
                    state = {name: np.concatenate([x, np.zeros_like(x)]) for name, x in state.items()}
                for x in state.values():
                    x[used] = x[k]
                state["many"][used] -= m
                state["first"][used] += m
                state["many"][k] = m
                used += 1
            state["room"][k] -= part
            state["cost"][k] += cost_of(part, linear, quadratic)
            first, n = first + m, n - m
    return np.array(rows, np.int64).reshape(-1, 7)


class Places:
    """The places of (length, number) in a plan, for whole columns at once."""

    def __init__(self, plan: np.ndarray):
        # Ranges of numbers in which all pieces are cut alike, and the plan's rows of each.
        key = plan[:, 0] << 40
        low, high = key + plan[:, 1], key + plan[:, 2]
        self.bounds = np.unique(np.r_[low, high])
        a, b = np.searchsorted(self.bounds, low), np.searchsorted(self.bounds, high)
        at = np.repeat(a, b - a) + _within(b - a)
        row = np.repeat(np.arange(len(plan)), b - a)
        order = np.lexsort((plan[row, 3], at))
        self.plan, self.rows = plan, row[order]
        self.size = np.bincount(at, minlength=len(self.bounds))
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of every part: which row it belongs to, begin, tokens, sequence and offset."""
        at = np.searchsorted(self.bounds, (length << 40) + number, side="right") - 1
        who = np.repeat(np.arange(len(at)), self.size[at])
        p = self.plan[self.rows[self.start[at][who] + _within(self.size[at])]]
        return who, p[:, 3], p[:, 4], p[:, 5] + number[who] - p[:, 1], p[:, 6]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the given sizes, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian unsigned 32-bit)."""
    few_rows_at_once(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(it):
        # One for each task: workers outlive their tasks, and would hold its memory.
        encode = _Encoder(tokenizer, CACHE_WORDS)
        for batch in batches_of(it, "text", 4 << 20):
            out = defaultdict(list)
            for doc, found in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                found = np.append(found, end_id).astype("<u4")
                for start in range(0, len(found), capacity):
                    part = found[start : start + capacity]
                    raw = part.tobytes()
                    for name, value in zip(target.names, (doc, start, len(part), zlib.crc32(raw), len(found), raw)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in target})

    return docs.select("doc_id", "text").mapInArrow(freeing(run), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and cost of every piece of ``docs`` (doc_id, text).

    Null texts count as empty; an empty text is the end id alone. A repeated doc_id
    gives repeated pieces, a null one is kept. Other columns are not looked at.
    ``tokenizer`` is a path that executors can read.
    """
    spark = docs.sparkSession
    pieces = stored(tokenize(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    plan = make_plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity, linear, quadratic)
    places = spark.sparkContext.broadcast(Places(plan))

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.drop("ids").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid"))
    numbered = salted.withColumn("row", within).join(counts, ["length", "salt"]).withColumn("number", F.col("before") + F.col("row") - 1)

    names = ["doc_id", "start", "ids_crc32", "doc_tokens", "uid"]
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, ids_crc32 long, doc_tokens long, uid long, begin long, length long, sequence_id long, offset long, whole boolean"

    def place(it):
        for batch in it:
            length = batch.column("length").to_numpy()
            who, begin, n, sequence, offset = places.value(length, batch.column("number").to_numpy())
            kept = batch.select(names).take(pa.array(who))
            columns = [*kept.columns, *map(pa.array, (begin, n, sequence, offset, n == length[who]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "begin", "length", "sequence_id", "offset", "whole"])

    placed = stored(numbered.select(*names, "length", "number").mapInArrow(place, fields), "placed")
    cuts = placed.where("not whole").drop("ids_crc32", "whole")

    def sums(it):
        for batch in it:
            begin, n = batch.column("begin").to_numpy(), batch.column("length").to_numpy()
            found = [zlib.crc32(memoryview(raw)[4 * b : 4 * (b + m)]) for raw, b, m in zip(batch.column("ids").to_pylist(), begin.tolist(), n.tolist())]
            yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(found, pa.int64()))

    if (plan[:, 4] < plan[:, 0]).any():
        # Only pieces that may be cut send their ids to the join.
        ids = pieces.where(maybe_among(cuts, "uid")).select("uid", "ids")
        cuts = cuts.join(ids, "uid").select(*cuts.columns, "ids").mapInArrow(sums, StructType(cuts.schema.fields).add("ids_crc32", "long"))
    else:
        cuts = cuts.withColumn("ids_crc32", F.lit(0).cast("long"))
    out = placed.where("whole").drop("whole").unionByName(cuts)
    n = F.col("length")
    return out.select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", (n * linear + n * n * quadratic).alias("cost"))
