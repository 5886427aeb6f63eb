"""Sampled subword segmentations over a SentencePiece vocabulary, and decoding.

A text is a lattice of pieces. Forward filtering sums the weights of all paths to
every position; backward sampling then draws one path from its exact posterior.
Draws come from a hash of (seed, row key, segment, step), so a row always gets the
same segmentation, on whatever partition it is read.

In the vocabulary a blank only begins a piece (or fills it), and no piece holds a
line break. Paths therefore all meet where a blank or line break follows other
characters, and a text factors into short segments whose lattices are computed
once and remembered. A piece weighs ``(id + 1) ** -alpha``: ids rank pieces by
merge order, and ``alpha`` sharpens (large: near the fewest, most frequent pieces)
or flattens the choice. Characters without a piece, and a literal U+2581, which
stands for the blank inside pieces, become their UTF-8 bytes, so decoding gives
back exactly the text.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridweave.llm.common import batches_of, mix64, text_bytes

BLANK = "▁"
GRID = 1 << 24
CACHE_EDGES = 8_000_000
_SEGMENT = re.compile(r"\n|\x20*[^\x20\n]+|\x20+")


class Vocabulary:
    """Pieces of a SentencePiece model: ids by text, bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.of_byte, table = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.of_byte[int(piece[3:-1], 16)] = i
                table.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                table.append(b"")
            else:
                self.ids[piece.replace(BLANK, " ")] = i
                table.append(piece.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        self._trie()
        self.size = np.array([len(b) for b in table], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def _trie(self) -> None:
        """Steps (node << 21 | character) -> node in sorted order, and the piece that ends at each node or -1."""
        steps, ends = {}, [-1]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                step = node << 21 | ord(c)
                if step not in steps:
                    steps[step] = len(ends)
                    ends.append(-1)
                node = steps[step]
            ends[node] = i
        self.steps = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.steps.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def matches(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (start, length, piece) of pieces in ``chars``; ``room``: characters left at each place."""
        found, at, node, length = [], np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            step = node << 21 | chars[at + length]
            k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            ok = self.steps[k] == step
            at, node, length = at[ok], self.to[k[ok]], length + 1
            piece = self.ends[node]
            hit = piece >= 0
            found.append((at[hit], np.full(hit.sum(), length), piece[hit]))
            more = room[at] > length
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces, end to end."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.arange(end[-1] if len(end) else 0) + np.repeat(self.begin[ids] - (end - size), size)]


class Sampler:
    """Forward filters of the segments seen so far, and vectorised backward sampling over them.

    A node is a place in a segment. The edges into it stand together, with the
    running share of its mass on a fixed grid: results do not depend on what else
    is remembered.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.vocabulary, self.alpha = vocabulary, alpha
        self.weight = (np.arange(len(vocabulary.size)) + 1.0) ** -alpha
        # Every path to a place covers the same characters, so a factor for each keeps sums in range.
        self.lift, self.short = 50.0**alpha, int(60 / max(1.0, alpha))
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.share, self.prev, self.piece, self.first = np.zeros(0, np.float32), *(np.zeros(0, np.int32) for _ in range(3))

    def _add(self, share, prev, piece, first) -> None:
        """Edges with their running shares (24 bits, exact in float32), and where each new node's edges begin."""
        self.first = np.concatenate([self.first, np.asarray(first, np.int32) + np.int32(len(self.share))])
        self.share = np.concatenate([self.share, np.asarray(share, np.float32)])
        self.prev, self.piece = (np.concatenate([x, np.asarray(y, np.int32)]) for x, y in ((self.prev, prev), (self.piece, piece)))

    def _filter_long(self, segment: str) -> None:
        """Forward filtering of one long segment, or one with characters that have no piece."""
        v = self.vocabulary
        node, mass, count = [-1], [1.0], len(self.first)
        share, before, pieces, first = [], [], [], []
        for end in range(1, len(segment) + 1):
            edges = []
            for start in range(max(0, end - v.longest), end):
                piece = v.ids.get(segment[start:end])
                if piece is not None:
                    edges.append((node[start], piece, mass[start] * self.weight[piece]))
            steps = [edges] if edges else [[(None, v.of_byte[b], 1.0)] for b in segment[end - 1].encode()]
            at = node[-1]
            for step in steps:
                total, run = sum(e[2] for e in step), 0.0
                first.append(len(share))
                for k, (prev, piece, weight) in enumerate(step):
                    run += weight
                    before.append(at if prev is None else prev)
                    pieces.append(piece)
                    share.append(1.0 if k == len(step) - 1 else round(run / total * GRID) / GRID)
                at, count = count, count + 1
            node.append(at)
            mass.append(sum(e[2] for e in edges) if edges else mass[-1])
            if mass[-1] < 1e-100:
                mass[-v.longest :] = [m * 1e100 for m in mass[-v.longest :]]
        self._add(share, before, pieces, first)
        self.last[segment] = node[-1]

    def _filter(self, segments: list[str]) -> None:
        """Forward filtering of many segments, place by place for all at once."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(segments)), size)
        place = np.arange(len(chars)) - begin[owner]
        start, length, piece = self.vocabulary.matches(chars, size[owner] - place)
        end = start + length - 1
        bare = np.bincount(end, minlength=len(chars)) == 0
        slow = size > self.short
        slow[owner[bare]] = True
        keep = ~slow[owner[end]]
        start, end, piece = start[keep], end[keep], piece[keep]
        order = np.lexsort((start, end))
        start, end, piece = start[order], end[order], piece[order]
        first = place[start] == 0
        gain = self.weight[piece] * self.lift ** (end - start + 1)
        mass, part = np.zeros(len(chars)), np.zeros(len(end))
        by_place = np.argsort(place[end], kind="stable")
        cut = np.searchsorted(place[end][by_place], np.arange(self.short + 1))
        for a, b in zip(cut, cut[1:]):
            e = by_place[a:b]
            part[e] = gain[e] * np.where(first[e], 1.0, mass[start[e] - 1])
            np.add.at(mass, end[e], part[e])
        new = np.r_[True, end[1:] != end[:-1]] if len(end) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        rank = np.arange(len(end)) - np.flatnonzero(new)[group]
        run = part.copy()
        for r in range(1, int(rank.max(initial=0)) + 1):
            k = np.flatnonzero(rank == r)
            run[k] += run[k - 1]
        share = np.round(run / mass[end] * GRID) / GRID
        share[np.r_[new[1:], True][: len(end)]] = 1.0
        number = np.full(len(chars), -1, np.int64)
        number[end[new]] = len(self.first) + np.arange(new.sum())
        self.last.update((segments[k], int(number[begin[k] + size[k] - 1])) for k in np.flatnonzero(~slow))
        self._add(share, np.where(first, -1, number[start - 1]), piece, np.flatnonzero(new))
        for k in np.flatnonzero(slow):
            self._filter_long(segments[k])

    def __call__(self, texts: list[str], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled ids of all texts end to end, and how many each text has."""
        words, counts = [], []
        for text in texts:
            found = _SEGMENT.findall(text)
            words += found
            counts.append(len(found))
        if len(self.share) > CACHE_EDGES:
            self.clear()
        last = self.last
        if new := [w for w in set(words) if w not in last]:
            self._filter(sorted(new))
        counts = np.array(counts, np.int64)
        node = np.fromiter(map(last.__getitem__, words), np.int64, len(words))
        begin = np.cumsum(counts) - counts
        place = np.arange(len(words)) - np.repeat(begin, counts)
        base = mix64(np.repeat(mix64(keys.astype(np.uint64) + np.uint64(seed)), counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        active, steps, size = np.arange(len(words)), [], np.zeros(len(words), np.int64)
        while len(active):
            draw = (mix64(base[active] + np.uint64(len(steps) + 1)) >> np.uint64(40)).astype(np.float32) / np.float32(GRID)
            edge = self.first[node]
            ahead = np.flatnonzero(self.share[edge] <= draw)
            while len(ahead):
                edge[ahead] += 1
                ahead = ahead[self.share[edge[ahead]] <= draw[ahead]]
            steps.append((active, self.piece[edge]))
            size[active] += 1
            node = self.prev[edge]
            active, node = active[node >= 0], node[node >= 0]
        stop = np.cumsum(size)
        out = np.zeros(stop[-1] if len(stop) else 0, np.int32)
        for k, (who, what) in enumerate(steps):
            out[stop[who] - 1 - k] = what
        return out, np.add.reduceat(np.r_[size, 0], begin) * (counts > 0) if len(counts) else counts


@functools.lru_cache(maxsize=1)
def _sampler(model: str, alpha: float) -> Sampler:
    """One for all tasks that a Python worker runs."""
    return Sampler(Vocabulary(model), alpha)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, ids, n_ids, ids_crc32, lossless) for every row of ``df``.

    ``model`` is a path that executors can read. The row key is any column; equal
    keys with equal texts get equal ids. Null and empty texts have no ids.
    ``lossless`` compares the decoded bytes with the text's.
    """
    schema = StructType([df.schema[key], *StructType.fromDDL("ids array<int>, n_ids long, ids_crc32 long, lossless boolean")])

    def run(it):
        sampler = _sampler(model, alpha)
        for batch in batches_of(it, "__text", 4 << 20):
            texts = batch.column("__text").fill_null("")
            ids, count = sampler(texts.to_pylist(), batch.column("__key").to_numpy().view(np.uint64), seed)
            stop = np.r_[0, np.cumsum(count)]
            raw, offsets = text_bytes(texts)
            made = np.r_[0, np.cumsum(sampler.vocabulary.size[ids])][stop]
            back = sampler.vocabulary.bytes_of(ids)
            if np.array_equal(made, offsets) and np.array_equal(back, raw):
                same = np.ones(len(count), bool)
            else:
                same = np.array([back[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(made, made[1:], offsets, offsets[1:])], bool)
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(stop, stop[1:])]
            cols = [batch.column(key), pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids)), pa.array(count), pa.array(crc, pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], schema=target)

    target = to_arrow_schema(schema)
    return df.select(key, F.col(text).alias("__text"), F.xxhash64(key).alias("__key")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds ``into`` (replaced if there): the text of an array of ids; null gives null."""

    def run(it):
        vocabulary = Vocabulary(model)
        for column in it:
            yield column.map(lambda x: None if x is None else vocabulary.bytes_of(np.asarray(x, np.int64)).tobytes().decode("utf-8", "replace"))

    from collections.abc import Iterator

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, "string")(ids))
