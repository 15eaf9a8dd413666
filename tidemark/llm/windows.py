"""What the two searches for long repeats share: batches of documents that ask about runs of text.

A window is ``WIDTH`` consecutive symbols (words or bytes) of one document. Windows of
all documents must be compared, but most occur once. So documents lie in batches, and
batches talk to parts of the key space by short messages:

1. Each window picks the smallest hash among its inner k-grams. Equal windows pick the
   same one. A batch sends each part the hashes that fell to it, each once, and gets
   one bit back for each: does another document have it too?
2. Only windows under such a hash are sent in full; what comes back says which of them
   a document with a smaller id has. The operators differ in this step.
3. The batch puts the answers together and cuts its own texts.

A batch sends a key once however many of its documents have it, so a passage that a
third of all documents share is one entry per batch in the part that owns it. Texts
are shuffled once; each step reads the same exchange. Batches are cut by size in bytes;
their keys take about ten times that in a task. For very large inputs take larger
batches (``batch_bytes`` of 256 MB cuts 100 TB into 400,000), so that the messages
between batches and at most ``MOST_PARTS`` parts hold many keys each. A row's batch
follows from its id and its text, so rows without an id, or of one id, lie in many.

Documents equal to one with a smaller id are known before (by the digest of the text)
and only wait for step 3. A null doc_id is smaller than none and larger than none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions

WIDTH = 50
BATCH_BYTES = 8 << 20
MOST_PARTS = 1 << 16
BLOCK = 1 << 20
MESSAGE = "batch int, part int, payload binary"
_MULTIPLIER = 0x9E3779B97F4A7C15
_KEY_BYTES = 6


def rolling(symbols: np.ndarray, n: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """The polynomial hash of every run of n symbols, by doubling."""
    out, have = None, 0
    part, size, left = symbols, 1, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out = part
                else:
                    m = min(len(out), len(part) - have)
                    out = out[:m] * np.uint64(pow(multiplier, size, 1 << 64)) + part[have : have + m]
                have += size
            left >>= 1
            if left:
                m = len(part) - size
                part = part[:m] * np.uint64(pow(multiplier, size, 1 << 64)) + part[size : size + m]
                size *= 2
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the entropy of all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


@dataclass
class Runs:
    """Runs of neighbouring windows that picked the same inner hash: [start, end) and key."""

    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def runs(symbols: np.ndarray, cuts: np.ndarray, inner: int, width: int = WIDTH) -> Runs:
    """Runs over documents laid end to end; ``cuts`` has their bounds, first 0."""
    if len(symbols) < width:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none.astype(np.uint64), none)
    low = sliding_min(mixed(rolling(symbols, inner)), width - inner + 1)
    valid = np.ones(len(low) + 1, bool)
    valid[-1] = False
    for c in cuts[1:-1].tolist():
        valid[max(0, c - width + 1) : c] = False
    head = valid[:-1].copy()
    head[1:] &= ~valid[:-2] | (low[1:] != low[:-1])
    start = np.flatnonzero(head)
    stop = np.flatnonzero(~valid)
    end = np.minimum(np.append(start[1:], len(low)), stop[np.searchsorted(stop, start)])
    return Runs(start, end, low[start], np.searchsorted(cuts, start, side="right") - 1)


@dataclass
class Batch:
    """The documents of a batch in an order of its own, those to be compared first to last."""

    ids: list[int | None]
    texts: list[bytes]
    copies: set[int]  # places of documents equal to one with a smaller id
    compared: list[int]

    def blocks(self, symbols: Callable[[bytes], np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Places of documents, their symbols end to end, and the cuts, about BLOCK symbols at a time."""
        at, parts, total = [], [], 0
        for i in self.compared:
            s = symbols(self.texts[i])
            if len(s) < WIDTH:
                continue
            at.append(i)
            parts.append(s)
            total += len(s)
            if total >= BLOCK:
                yield at, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                at, parts, total = [], [], 0
        if at:
            yield at, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def opened(docs: pa.Table, mail: pa.Table) -> tuple[int, Batch, dict[int, dict[int, bytes]]]:
    """A batch, and its mail by step and part. Step 0 are ids of copies."""
    batch = docs.column("batch")[0].as_py()
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    answers: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
    known = set()
    for step, part, payload in zip(*(mail.column(c).to_pylist() for c in ("step", "part", "payload"))):
        if step == 0:
            known.add(payload)
        else:
            answers[step][part] = payload
    known_ids = {k[:8] for k in known}
    names = [b"" if d is None else d.to_bytes(8, "big", signed=True) for d in ids]
    copies = {i for i, n in enumerate(names) if n in known_ids and n + hashlib.md5(texts[i]).digest() in known}
    order = sorted((i for i, d in enumerate(ids) if d is not None and i not in copies), key=lambda i: ids[i])
    return batch, Batch(ids, texts, copies, order), answers


def messages(batch: int, payloads: dict[int, bytes]) -> pa.Table:
    parts = sorted(payloads)
    return pa.table(
        {
            "batch": pa.array([batch] * len(parts), pa.int32()),
            "part": pa.array(parts, pa.int32()),
            "payload": pa.array([payloads[p] for p in parts], pa.binary()),
        }
    )


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns a key, from the bits that are not sent."""
    return ((keys >> np.uint64(8 * _KEY_BYTES)) % np.uint64(parts)).astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _KEY_BYTES)
    return out.view("<u8").ravel()


@dataclass
class Keys:
    """The inner hashes of a batch, sorted by part and value; those of one document only, and of several."""

    single: np.ndarray
    several: np.ndarray
    parts: int

    @classmethod
    def of(cls, batch: Batch, symbols: Callable[[bytes], np.ndarray], inner: int, parts: int) -> "Keys":
        keys, docs = [], []
        for at, s, cuts in batch.blocks(symbols):
            r = runs(s, cuts, inner)
            keys.append(r.key)
            docs.append(np.array([batch.ids[i] for i in at], np.int64)[r.doc])
        if not keys:
            none = np.zeros(0, np.uint64)
            return cls(none, none, parts)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        found = key[first]
        place = np.argsort(part_of(found, parts), kind="stable")
        found, several = found[place], several[place]
        return cls(found[~several], found[several], parts)

    def asked(self) -> dict[int, bytes]:
        payloads = {}
        one, more = part_of(self.single, self.parts), part_of(self.several, self.parts)
        for p in np.union1d(one, more).tolist():
            a, b = np.searchsorted(one, [p, p + 1])
            c, d = np.searchsorted(more, [p, p + 1])
            payloads[p] = int(b - a).to_bytes(4, "little") + _packed(np.concatenate((self.single[a:b], self.several[c:d])))
        return payloads

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """The hashes that another document has too, sorted."""
        part = part_of(self.single, self.parts)
        hit = np.zeros(len(self.single), bool)
        for p, bits in answers.items():
            a, b = np.searchsorted(part, [p, p + 1])
            hit[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return np.sort(np.concatenate((self.single[hit], self.several)))


def answer_keys(asked: pa.Table) -> pa.Table:
    """For each batch a bit per hash it sent as its own: whether any other batch or document has it."""
    batches, payloads = asked.column("batch").to_pylist(), asked.column("payload").to_pylist()
    keys = [_unpacked(p[4:]) for p in payloads]
    single = [int.from_bytes(p[:4], "little") for p in payloads]
    every = np.concatenate(keys)
    alone = np.concatenate([np.arange(len(k)) < n for k, n in zip(keys, single)])
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(first, len(ordered)))
    shared = (count > 1) | ~np.minimum.reduceat(alone[order], first)
    hit = np.empty(len(every), bool)
    hit[order] = np.repeat(shared, count)
    bits, at = [], 0
    for k, n in zip(keys, single):
        bits.append(np.packbits(hit[at : at + n]).tobytes())
        at += len(k)
    return pa.table(
        {
            "batch": pa.array(batches, pa.int32()),
            "part": asked.column("part").combine_chunks(),
            "payload": pa.array(bits, pa.binary()),
        }
    )


def repeats_in(r: Runs, repeated: np.ndarray) -> np.ndarray:
    """Places of the runs whose key is among the repeated."""
    if not len(repeated):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(repeated, r.key), len(repeated) - 1)
    return np.flatnonzero(repeated[at] == r.key)


class Exchange:
    """Documents in batches and the three steps between batches and parts."""

    def __init__(self, docs: DataFrame, batch_bytes: int = BATCH_BYTES):
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long"), "text")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        count = max(partitions(spark), -(-size // batch_bytes))
        self.parts = min(count, MOST_PARTS)
        digest = F.md5(F.coalesce("text", F.lit("")))
        place = lambda d: F.pmod(F.xxhash64("doc_id", d), F.lit(count)).cast("int").alias("batch")
        text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
        self.batches = rows.select(place(digest), "doc_id", text.alias("text")).repartition(count, "batch")
        digests = rows.select("doc_id", digest.alias("digest")).where("doc_id IS NOT NULL")
        first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first = first.where(F.col("first") < F.col("last")).select(F.col("digest").alias("of"), "first")
        copies = digests.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") > F.col("first"))).distinct()
        self.copies = copies.select(
            place(F.col("digest")),
            F.lit(0).alias("step"),
            F.lit(0).alias("part"),
            F.unhex(F.concat(F.lpad(F.hex("doc_id"), 16, "0"), "digest")).alias("payload"),
        )

    def send(self, step: int, mail: DataFrame, write: Callable, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """All mail so far and the answers to what the batches write, as mail of ``step``."""
        asked = self.cut(mail, write, MESSAGE)
        answered = asked.groupBy("part").applyInArrow(answer, MESSAGE)
        return mail.unionByName(answered.select("batch", F.lit(step).alias("step"), "part", "payload"))

    def cut(self, mail: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.batches.groupBy("batch").cogroup(mail.groupBy("batch")).applyInArrow(fn, schema)
