"""Packing of documents into sequences of a fixed length by linear grouping.

Texts become ids (byte-level BPE of a public vocabulary) in one pass that keeps of each
piece only its length, checksum and place. What is optimised is the histogram of lengths,
at most ``size`` numbers whatever the corpus: large lengths are split into groups of equal
cardinality and rounded up to the largest of their group; a linear program over the few
rounded sizes, solved by column generation, gives configurations and how often each is
used; the documents of a group then take the places of their rounded size; and the rest,
the small ones first of all, goes by best fit into what is left open, longest first and
tightest sequence first. All of this counts documents of equal length as one number, so
the plan is a short list of ranges: the documents number a to b of length L lie in the
sequences from s on, at offset o. Documents are numbered per length by the task that
read them plus an offset per task, and look up their range.

Rows: null and empty texts are the closing id alone; a null id is an id like any other;
repeated rows are packed once each; an empty table packs into nothing; other columns are
not read. A text is encoded as a whole, in memory of a few times its own length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import written

#: Tokens of a sequence.
SIZE = 2048
#: Groups of equal cardinality, and with them rows of the linear program.
GROUPS = 1024
#: Lengths up to a sequence's size by this number are small: they take no part in the program.
SMALL = 3
#: Words whose ids a task keeps.
KEPT_WORDS = 500_000


class _Ragged(Exception):
    """A word that its neighbours' spaces belong to."""


class Encoder(dict):
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    ``path``: a byte-level BPE vocabulary as the ``tokenizers`` library writes it. The ids
    are that library's, special strings taken as text; the merges are run by ``tiktoken``,
    which needs a quarter of the time for the same ranks. A single space between two other
    characters always begins a new token, so words are encoded once and kept.
    """

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {
            bytes(byte[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special
        }
        self.bpe = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def raw(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Ragged
        ids = self.raw(" " + word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.raw(first) + b"".join(map(self.__getitem__, rest))
            except _Ragged:
                pass
        return self.raw(text)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, to find the piece again, part and nth.

    A document is its ids and ``end``. One of more than ``size`` ids is cut; its first
    piece is the shorter one. ``keep_ids`` adds the ids of the piece as an array.
    ``nth`` numbers the pieces of one length within the task ``part`` that made them.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth")],
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        close = np.array([end], "<u4").tobytes()
        seen = [0] * (size + 1)
        for batch in batches:
            of, found, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (encode(text) if text else b"") + close
                n = len(data) // 4
                count = -(-n // size)
                start = 0
                for piece in range(count):
                    stop = n - (count - 1 - piece) * size
                    own = data[4 * start : 4 * stop]
                    of.append(i)
                    found.append((piece, start, stop - start, zlib.crc32(own), part, seen[stop - start]))
                    if keep_ids:
                        ids.append(np.frombuffer(own, "<i4"))
                    seen[stop - start] += 1
                    start = stop
            columns = zip(*found) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of, pa.int64())),
                    *[pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 5])],
                    *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(read, schema)


def equal_groups(counts: np.ndarray, large: int, groups: int) -> list[list[tuple[int, int, int]]]:
    """The lengths from ``large`` on, longest first, in groups of nearly equal cardinality.

    A group is a list of (length, from, to): the pieces from .. to of that length. Where
    there are no more lengths than groups, a group is a length and nothing is rounded.
    """
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1] if x >= large]
    if len(lengths) <= groups:
        return [[(x, 0, int(counts[x]))] for x in lengths]
    total = int(sum(int(counts[x]) for x in lengths))
    found: list[list[tuple[int, int, int]]] = [[]]
    room, made = total // groups, 1
    for x in lengths:
        at, n = 0, int(counts[x])
        while at < n:
            if room == 0:
                found.append([])
                made += 1
                room = total * made // groups - total * (made - 1) // groups
            take = min(room, n - at)
            found[-1].append((x, at, at + take))
            at, room = at + take, room - take
    return found


def configurations(sizes: list[int], demand: list[int], size: int, tolerance: float = 1e-5) -> list[tuple[list[int], int]]:
    """Patterns of groups and how often each is used in full, by column generation.

    Minimises the number of sequences that hold ``demand[g]`` pieces of ``sizes[g]``. A
    pattern is a list of group numbers; the multiplicities are the program's, rounded down.
    """
    n = len(sizes)
    if not n:
        return []
    need = np.array(demand, float)
    widths = np.array(sizes)
    basis = np.diag([float(size // s) for s in sizes])
    inverse = np.diag([1.0 / (size // s) for s in sizes])
    use = inverse @ need
    deepest = size // min(sizes)
    upward = np.argsort(widths, kind="stable")
    one = np.searchsorted(widths[upward], np.arange(size + 1), "right") - 1  # per capacity: the sizes up to it
    left = np.arange(size + 1)[None, :] - widths[:, None] if deepest > 2 else None
    for step in range(40 * n):
        price = inverse.sum(0)
        # best[w]: the dearest pattern of so many pieces for capacity w; one piece needs only the dearest up to w
        dearest = np.maximum.accumulate(price[upward])
        first = np.maximum.accumulate(np.where(price[upward] == dearest, np.arange(n), 0))
        best, pick = np.zeros(size + 1), np.full(size + 1, -1)
        worth = (one >= 0) & (dearest[one] > 0)
        best[worth], pick[worth] = dearest[one[worth]], upward[first[one[worth]]]
        choice = [pick]
        for _ in range(deepest - 2):
            value = np.where(left >= 0, best[left] + price[:, None], -1.0)
            pick = value.argmax(0)
            top = value[pick, np.arange(size + 1)]
            choice.append(np.where(top > best + 1e-12, pick, -1))
            best = np.maximum(top, best)
        if deepest > 1:  # the last piece goes into the whole capacity
            value = best[size - widths] + price
            pick = np.full(size + 1, -1)
            if value.max() > best[size] + 1e-12:
                pick[size] = value.argmax()
                best[size] = value.max()
            choice.append(pick)
        if best[size] <= 1 + tolerance:
            break
        column, w = np.zeros(n), size
        for pick in reversed(choice):
            if pick[w] >= 0:
                column[pick[w]] += 1
                w -= sizes[pick[w]]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
        use = np.maximum(inverse @ need, 0)
    found, open_ = [], list(demand)
    for j in np.argsort(-use):
        pattern = [g for g in range(n) for _ in range(int(basis[g, j]))]
        # the pieces that are still there bound it too, so rounding errors cannot overdraw a group
        times = min([int(use[j] + 1e-7), *[open_[g] // int(basis[g, j]) for g in set(pattern)]])
        if times > 0 and pattern:
            found.append((pattern, times))
            for g in set(pattern):
                open_[g] -= times * int(basis[g, j])
    return found


class _Queue:
    """The pieces of a group, as ranges, in the order in which places take them."""

    def __init__(self, ranges: list[tuple[int, int, int]]):
        self.ranges = list(reversed(ranges))

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, a, b = self.ranges.pop()
            if b - a > n:
                self.ranges.append((length, a + n, b))
                b = a + n
            out.append((length, a, b))
            n -= b - a
        return out


def plan(counts: np.ndarray, size: int = SIZE, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go, and the number of sequences.

    ``counts[L]``: pieces of length L. A row (length, from, to, sequence, per, offset)
    says that piece number from + i lies in sequence + i // per, at offset + (i % per) *
    length. Its number of rows follows from ``size`` and ``groups`` alone: a range is cut
    where a length or a use of a pattern ends, and every time best fit touches a range of
    equal sequences, what they have left is at least halved.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by tokens left: (first sequence, how many)
    made = 0
    large = size // small + 1
    grouped = equal_groups(counts, large, groups)
    queues = [_Queue(g) for g in grouped]
    patterns = configurations([g[0][0] for g in grouped], [sum(b - a for _, a, b in g) for g in grouped], size)
    for pattern, times in patterns:
        slots = [queues[g].take(times) for g in pattern]
        ends = sorted({e for s in slots for e in np.cumsum([b - a for _, a, b in s]).tolist()})
        at, done = [(0, 0)] * len(slots), 0  # per slot: which range, and how far into it
        for end in ends:
            offset = 0
            for k, slot in enumerate(slots):
                i, into = at[k]
                length, a, b = slot[i]
                rows.append((length, a + into, a + into + end - done, made + done, 1, offset))
                at[k] = (i + 1, 0) if a + into + end - done == b else (i, into + end - done)
                offset += length
            open_[size - offset].append((made + done, end - done))
            done = end
        made += times

    rest: dict[int, list[tuple[int, int]]] = {int(x): [(0, int(counts[x]))] for x in np.flatnonzero(counts) if x < large}
    for q in queues:
        for length, a, b in q.ranges:
            rest.setdefault(length, []).append((a, b))
    for length in sorted(rest, reverse=True):
        for a, b in rest[length]:
            room = length
            while a < b:
                while room <= size and not open_[room]:
                    room += 1
                if room > size:
                    per = size // length
                    first, many = made, -(-(b - a) // per)
                    made += many
                    offset, left = 0, size
                else:
                    first, many = open_[room].pop()
                    per, offset, left = room // length, size - room, room
                full = min(many, (b - a) // per)
                if full:
                    rows.append((length, a, a + full * per, first, per, offset))
                    a += full * per
                    open_[left - per * length].append((first, full))
                elif a < b:
                    rows.append((length, a, b, first, per, offset))
                    open_[left - (b - a) * length].append((first, 1))
                    a, full = b, 1
                if full < many:
                    open_[left].append((first + full, many - full))
                room = length
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6), made


def pack(
    docs: DataFrame, path: str, size: int = SIZE, end: int = 0, groups: int = GROUPS, small: int = SMALL, keep_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if kept.

    ``path``: the vocabulary, a file at the same place on every worker.
    """
    cut = written(pieces(docs, path, size, end, keep_ids))
    by_part = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = written(by_part.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("count")).collect():  # at most ``size`` rows
        counts[length] = n
    places, _ = plan(counts, size, groups, small)
    bits = max(int(counts.max()).bit_length(), 1)
    keys = (places[:, 0] << bits) + places[:, 1]

    numbered = cut.join(by_part.select("part", "length", "before"), ["part", "length"]).withColumn(
        "nth", F.col("nth") + F.col("before")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", *(["ids"] if keep_ids else [])]
    rows = numbered.select(names)
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name not in ("nth", "ids")]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
        + ([rows.schema["ids"]] if keep_ids else [])
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = places[np.searchsorted(keys, (length << bits) + nth, "right") - 1]
            i = nth - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in range(5)],
                    pa.array(row[:, 3] + i // row[:, 4]),
                    pa.array(row[:, 5] + i % row[:, 4] * length),
                    *([batch.column(6)] if keep_ids else []),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: sequence_id, ids, doc_ids.

    A group is one sequence: never more than its ``size`` tokens.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "piece", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
