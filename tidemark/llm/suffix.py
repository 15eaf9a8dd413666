"""Exact substring dedup by a logarithmic family of suffix arrays.

Documents are compared as bytes. Stretches of text that may repeat (see ``windows``)
go to the part of the key space that owns them, each distinct stretch of a batch once,
with the smallest document that has it. A part indexes its distinct stretches batch by
batch:

* a new batch gets a suffix array: its suffixes, to the depth of a window, in order,
  with the smallest document of each;
* it is merge-scanned against the levels of the index, oldest first, for suffixes that
  match to that depth; those lower the document of the older entry if theirs is smaller;
* what matched nothing becomes a new level, and levels of about equal size merge, so
  there are never more than logarithmically many.

A last scan tells each batch which of its suffixes start in a smaller document. Every
byte under such a window goes.

Comparison is byte by byte, so no hash decides a removal. A part's index holds only
distinct windows that were asked about; parts grow in number with the input.

Null and empty texts have no bytes. Rows of equal doc_id are one document; a null
doc_id takes no part and keeps its bytes. A match never spans two documents. Empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import windows
from tidemark.llm.windows import WIDTH, Batch, Exchange, Keys

INNER = 16
BATCH_SUFFIXES = 1 << 18
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def symbols(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def _stretches(batch: Batch, repeated: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
    """(row, start, text, key) of each run of windows under a repeated key, in order of rows and starts."""
    for at, s, cuts in batch.blocks(symbols):
        r = windows.runs(s, cuts, INNER)
        hit = windows.repeats_in(r, repeated)
        rows = r.doc[hit]
        starts, ends = (r.start[hit] - cuts[rows]).tolist(), (r.end[hit] - cuts[rows] + WIDTH - 1).tolist()
        for row, start, end, key in zip(rows.tolist(), starts, ends, r.key[hit].tolist()):
            yield at[row], start, batch.texts[at[row]][start:end], key


class _Asked:
    """The stretches of a batch, and the distinct ones by part, in an order of their own."""

    def __init__(self, batch: Batch, repeated: np.ndarray, parts: int):
        self.all = list(_stretches(batch, repeated))
        low: dict[bytes, int] = {}
        part: dict[bytes, int] = {}
        for row, _, text, key in self.all:  # rows come by rising doc_id
            if text not in low:
                low[text] = batch.ids[row]
                part[text] = (key >> 48) % parts
        self.low = low
        self.by_part: dict[int, list[bytes]] = {}
        for text in sorted(part):
            self.by_part.setdefault(part[text], []).append(text)

    def payloads(self) -> dict[int, bytes]:
        return {
            p: b"".join(
                (
                    len(texts).to_bytes(4, "little"),
                    np.array([len(t) for t in texts], "<u4").tobytes(),
                    np.array([self.low[t] for t in texts], "<i8").tobytes(),
                    *texts,
                )
            )
            for p, texts in self.by_part.items()
        }


class Family:
    """Suffix arrays of sizes that grow geometrically: distinct suffixes in order, and their numbers.

    ``low`` has the smallest document of each number.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.low = np.empty(0, np.int64)

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Takes a batch and returns the number of each of its suffixes."""
        order = np.argsort(suffixes, kind="stable")
        suffixes, docs = suffixes[order], docs[order]
        head = np.append(True, suffixes[1:] != suffixes[:-1])
        keys, low = suffixes[head], np.minimum.reduceat(docs, np.flatnonzero(head))
        numbers, new = np.empty(len(keys), np.int64), np.arange(len(keys))
        for held, held_numbers in self.levels:
            at, same = self.scan(held, keys[new])
            known = numbers[new[same]] = held_numbers[at[same]]
            self.low[known] = np.minimum(self.low[known], low[new[same]])
            new = new[~same]
        numbers[new] = len(self.low) + np.arange(len(new))
        self.low = np.concatenate((self.low, low[new]))
        if len(new):
            self.levels.append((keys[new], numbers[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merged(large, small))
        out = np.empty(len(order), np.int64)
        out[order] = numbers[np.cumsum(head) - 1]
        return out

    @staticmethod
    def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two levels, which share no suffix, as one: the entries of b go to their places among a's."""
        place = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
        others = np.ones(len(a[0]) + len(b[0]), bool)
        others[place] = False
        out = []
        for x, y in zip(a, b):
            z = np.empty(len(others), x.dtype)
            z[place], z[others] = y, x
            out.append(z)
        return out[0], out[1]

    @staticmethod
    def scan(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would stand in a level, and whether it stands there."""
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return at, held[at] == keys

    def smallest(self, keys: np.ndarray) -> np.ndarray:
        """The smallest document of keys that are all in some level."""
        out = np.full(len(keys), np.iinfo(np.int64).max)
        for held, numbers in self.levels:
            at, same = self.scan(held, keys)
            out[same] = self.low[numbers[at[same]]]
        return out


def _read(payload: bytes) -> tuple[list[bytes], list[int]]:
    """The stretches of a message and the document of each."""
    n = int.from_bytes(payload[:4], "little")
    at = 4 + 12 * n
    ends = (np.cumsum(np.frombuffer(payload, "<u4", n, 4), dtype=np.int64) + at).tolist()
    docs = np.frombuffer(payload, "<i8", n, 4 + 4 * n).tolist()
    return [payload[x:y] for x, y in zip([at, *ends], ends)], docs


def _suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of stretches to the depth of a window, in order, and how many each stretch has.

    A byte that is not zero ends each, since zeros at the end would not count in comparisons.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(texts), np.uint8)
    count = size - WIDTH + 1
    start = np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count) + np.arange(count.sum())
    keys = np.ones((len(start), WIDTH + 1), np.uint8)
    keys[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(text, WIDTH)[start]
    return keys.view(f"S{WIDTH + 1}").ravel(), count


def _answer(asked: pa.Table) -> pa.Table:
    """For each message a bit per suffix: whether a smaller document has it.

    A negative part is a batch's note to itself and comes back as it is.
    Equal stretches of several messages enter the index once, with their smallest
    document; the others hold nothing that document does not have.
    """
    if asked.column("part")[0].as_py() < 0:
        return asked.select(["batch", "part", "payload"])
    sent = [_read(p) for p in asked.column("payload").to_pylist()]
    low: dict[bytes, int] = {}
    for texts, docs in sent:
        for t, d in zip(texts, docs):
            if low.setdefault(t, d) > d:
                low[t] = d
    family, distinct, batches = Family(), list(low), []
    at = 0
    while at < len(distinct):
        end, size = at, 0
        while end < len(distinct) and size < BATCH_SUFFIXES:
            size += len(distinct[end]) - WIDTH + 1
            end += 1
        keys, count = _suffixes(distinct[at:end])
        docs = np.repeat(np.fromiter((low[t] for t in distinct[at:end]), np.int64, end - at), count)
        batches.append((distinct[at:end], count, docs, family.add(keys, docs)))
        at = end
    older: dict[bytes, np.ndarray] = {}
    for texts, count, docs, numbers in batches:
        smaller = family.low[numbers] < docs
        ends = np.cumsum(count).tolist()
        older.update(zip(texts, (smaller[x:y] for x, y in zip([0, *ends], ends))))
    every = np.ones(max(map(len, distinct)), bool)
    bits = [
        np.packbits(
            np.concatenate([older[t] if d == low[t] else every[: len(t) - WIDTH + 1] for t, d in zip(texts, docs)])
        ).tobytes()
        for texts, docs in sent
    ]
    return pa.table(
        {
            "batch": asked.column("batch").combine_chunks(),
            "part": asked.column("part").combine_chunks(),
            "payload": pa.array(bits, pa.binary()),
        }
    )


SCHEMA = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:int,end:int>>"


def dedup(docs: DataFrame, digest: bool = False, batch_bytes: int = windows.BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (bytes left) and spans (removed runs) of every row.

    With ``digest``, ``kept`` is the SHA-256 of the bytes left.
    """
    ex = Exchange(docs, batch_bytes)
    parts = ex.parts

    def ask_keys(left: pa.Table, mail: pa.Table) -> pa.Table:
        n, batch, _ = windows.opened(left, mail)
        return windows.messages(n, Keys.of(batch, symbols, INNER, parts).asked())

    def ask_stretches(left: pa.Table, mail: pa.Table) -> pa.Table:
        n, batch, answers = windows.opened(left, mail)
        repeated = Keys.of(batch, symbols, INNER, parts).repeated(answers[1])
        return windows.messages(n, _Asked(batch, repeated, parts).payloads() | {-1 - n: repeated.tobytes()})

    def cut(left: pa.Table, mail: pa.Table) -> pa.Table:
        n, batch, answers = windows.opened(left, mail)
        repeated = np.frombuffer(answers[2].pop(-1 - n), np.uint64)
        stretches = _Asked(batch, repeated, parts)
        gone: dict[bytes, np.ndarray] = {}  # starts, in a stretch, of windows of smaller documents
        for p, bits in answers[2].items():
            texts = stretches.by_part[p]
            flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            ends = np.cumsum([len(t) - WIDTH + 1 for t in texts]).tolist()
            for t, a, b in zip(texts, [0, *ends], ends):
                gone[t] = np.flatnonzero(flags[a:b])
        covered: dict[int, np.ndarray] = {}
        for row, start, text, _ in stretches.all:
            if batch.ids[row] > stretches.low[text]:
                first, last = [start], [start + len(text)]
            else:
                found = gone[text]
                if not len(found):
                    continue
                first, last = start + found, start + found + WIDTH
            if row not in covered:
                covered[row] = np.zeros(len(batch.texts[row]) + 1, np.int32)
            np.add.at(covered[row], first, 1)
            np.add.at(covered[row], last, -1)
        out = []
        for i, (d, text) in enumerate(zip(batch.ids, batch.texts)):
            n, runs, left_over = len(text), [], text
            if i in batch.copies and n >= WIDTH:
                runs, left_over = [(0, n)], b""
            elif i in covered:
                drop = np.cumsum(covered[i])[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0]))))
                runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                left_over = np.frombuffer(text, np.uint8)[~drop].tobytes()
            kept = hashlib.sha256(left_over).hexdigest().encode() if digest else left_over
            out.append((d, n, n - len(left_over), kept, [{"start": a, "end": b} for a, b in runs]))
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(span))
        names = ("doc_id", "n_bytes", "n_removed", "kept", "spans")
        return pa.table({name: pa.array(c, t) for name, c, t in zip(names, zip(*out), types)})

    mail = ex.send(1, ex.copies, ask_keys, windows.answer_keys)
    mail = ex.send(2, mail, ask_stretches, _answer)
    return ex.cut(mail, cut, SCHEMA)
