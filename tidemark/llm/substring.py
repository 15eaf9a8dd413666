"""Substring dedup on a De Bruijn graph of the corpus.

Every run of ``WIDTH`` words is an edge from its first WIDTH - 1 words to its last. An
edge's home is its smallest (document, place). Edges that only one document has are
left out beforehand (see ``windows``); the others are joined with their home through
the parts of the edge space. Where the edges of a document and their homes both step by
one word, the path does not branch, and it compacts to one span with the coordinates of
its source. A path ends at a node where documents part, or where an older document
takes over. The words of all spans whose source is a smaller document are removed.

An edge is a 64-bit hash with a check of 32 more bits that its home must share.

Null texts have no words, n_removed 0 and the digest of nothing. Rows of equal doc_id
are one document: none removes words of another. A null doc_id takes no part in the
comparison and keeps its words. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm import windows
from tidemark.llm.windows import WIDTH, Batch, Exchange, Keys

INNER = 25
_CHECK = 0xD6E8FEB86659FD93


class Hashes(dict):
    """word -> 64-bit hash, kept for the common words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 1)
        if len(self) > 300_000:
            self.clear()
        self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        found = text.split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def _edges(batch: Batch, hashes: Hashes, repeated: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (row, place, edge, check) for the windows under a repeated key."""
    for at, s, cuts in batch.blocks(hashes.of):
        r = windows.runs(s, cuts, INNER)
        hit = windows.repeats_in(r, repeated)
        if not len(hit):
            continue
        n = r.end[hit] - r.start[hit]
        start = np.repeat(r.start[hit] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        doc = np.repeat(r.doc[hit], n)
        edge = windows.mixed(windows.rolling(s, WIDTH)[start])
        check = (windows.rolling(s, WIDTH, _CHECK)[start] >> np.uint64(32)).astype(np.uint32)
        yield np.array(at)[doc], start - cuts[doc], edge, check


def _homes(edge: np.ndarray, check: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places of the smallest (doc, place) of each (edge, check), in their order."""
    order = np.lexsort((place, doc, check, edge))
    e, c = edge[order], check[order]
    return order[np.append(True, (e[1:] != e[:-1]) | (c[1:] != c[:-1]))] if len(order) else order


class _Asked:
    """The distinct edges of a batch with their home inside it, by part."""

    def __init__(self, batch: Batch, hashes: Hashes, repeated: np.ndarray, parts: int):
        blocks = list(_edges(batch, hashes, repeated))
        empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint32)]
        self.row, self.place, self.edge, self.check = (
            (np.concatenate(c) for c in zip(*blocks)) if blocks else empty
        )
        self.doc = np.array([-1 if d is None else d for d in batch.ids], np.int64)[self.row]
        mine = _homes(self.edge, self.check, self.doc, self.place)
        part = windows.part_of(self.edge[mine], parts)
        self.home = mine[np.argsort(part, kind="stable")]
        self.part = np.sort(part)

    def sent(self, part: int) -> np.ndarray:
        a, b = np.searchsorted(self.part, [part, part + 1])
        return self.home[a:b]

    def payloads(self) -> dict[int, bytes]:
        out = {}
        for p in np.unique(self.part).tolist():
            h = self.sent(p)
            doc = self.doc[h].astype("<i8").view("<u4")
            out[p] = b"".join(
                x.tobytes()
                for x in (
                    self.edge[h].astype("<u8"), self.check[h].astype("<u4"), doc[0::2], doc[1::2], self.place[h].astype("<u4"),
                )
            )
        return out


def _read(payload: bytes) -> tuple[np.ndarray, ...]:
    """edge, check, doc, place of a message."""
    n = len(payload) // 24
    edge = np.frombuffer(payload, "<u8", n)
    check, low, high, place = np.frombuffer(payload, "<u4", 4 * n, 8 * n).reshape(4, n)
    return edge, check, np.stack((low, high), 1).copy().view("<i8").ravel(), place.astype(np.int64)


def _answer(asked: pa.Table) -> pa.Table:
    """For each edge of a message, the home over all batches where it lies in another document: its place in the message, document, place."""
    sent = [_read(p) for p in asked.column("payload").to_pylist()]
    edge, check, doc, place = (np.concatenate(c) for c in zip(*sent))
    order = np.lexsort((place, doc, check, edge))
    e, c = edge[order], check[order]
    first = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (c[1:] != c[:-1])))
    home = np.empty(len(order), np.int64)
    home[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    payloads, at = [], 0
    for s in sent:
        n = len(s[0])
        h = home[at : at + n]
        other = np.flatnonzero(doc[h] < s[2])
        found = doc[h[other]].astype("<i8").view("<u4")
        payloads.append(b"".join(x.tobytes() for x in (other.astype("<u4"), found[0::2], found[1::2], place[h[other]].astype("<u4"))))
        at += n
    return pa.table(
        {
            "batch": asked.column("batch").combine_chunks(),
            "part": asked.column("part").combine_chunks(),
            "payload": pa.array(payloads, pa.binary()),
        }
    )


def _paths(row, place, doc, home_doc, home_place) -> Iterator[tuple[int, int, int, int, int]]:
    """Compacted paths with a smaller source: row, first place, edges, source document, source place."""
    older = home_doc < doc
    row, place, home_doc, home_place = (x[older] for x in (row, place, home_doc, home_place))
    order = np.lexsort((place, row))
    row, place, home_doc, home_place = (x[order] for x in (row, place, home_doc, home_place))
    if not len(row):
        return
    goes_on = (
        (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1)
        & (home_doc[1:] == home_doc[:-1]) & (home_place[1:] == home_place[:-1] + 1)
    )
    first = np.flatnonzero(np.append(True, ~goes_on))
    n = np.diff(np.append(first, len(row)))
    yield from zip(*(x[first].tolist() for x in (row, place)), n.tolist(), *(x[first].tolist() for x in (home_doc, home_place)))


SCHEMA = (
    "doc_id long, n_words long, n_removed long, kept binary,"
    " spans array<struct<start:int,n_words:int,source_doc:long,source_start:int>>"
)


def dedup(docs: DataFrame, digest: bool = False, batch_bytes: int = windows.BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by a space) and spans of every row.

    ``spans`` are the repeated paths with the coordinates of their source; a document equal
    to a smaller one has a single span without a source place. With ``digest``, ``kept`` is
    the SHA-256 of the words left.
    """
    ex = Exchange(docs, batch_bytes)
    parts = ex.parts

    def ask_keys(left: pa.Table, mail: pa.Table) -> pa.Table:
        n, batch, _ = windows.opened(left, mail)
        return windows.messages(n, Keys.of(batch, Hashes().of, INNER, parts).asked())

    def asked(left: pa.Table, mail: pa.Table) -> tuple[int, Batch, _Asked, dict[int, bytes]]:
        n, batch, answers = windows.opened(left, mail)
        hashes = Hashes()
        repeated = Keys.of(batch, hashes.of, INNER, parts).repeated(answers[1])
        return n, batch, _Asked(batch, hashes, repeated, parts), answers[2]

    def ask_edges(left: pa.Table, mail: pa.Table) -> pa.Table:
        n, _, edges, _ = asked(left, mail)
        return windows.messages(n, edges.payloads())

    def cut(left: pa.Table, mail: pa.Table) -> pa.Table:
        _, batch, edges, answers = asked(left, mail)
        # the home of each distinct edge: in this batch, unless an answer names a smaller document
        doc, place = edges.doc.copy(), edges.place.copy()
        for p, payload in answers.items():
            at, low, high, where = np.frombuffer(payload, "<u4").reshape(4, -1)
            mine = edges.sent(p)[at]
            doc[mine] = np.stack((low, high), 1).copy().view("<i8").ravel()
            place[mine] = where
        order = np.lexsort((edges.place, edges.doc, edges.check, edges.edge))
        e, c = edges.edge[order], edges.check[order]
        group = np.cumsum(np.append(True, (e[1:] != e[:-1]) | (c[1:] != c[:-1]))) - 1 if len(order) else order
        first = order[np.searchsorted(group, np.arange(group[-1] + 1))] if len(order) else order
        home = np.empty(len(order), np.int64)
        home[order] = first[group] if len(order) else order
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        for row, start, n, source, at in _paths(edges.row, edges.place, edges.doc, doc[home], place[home]):
            spans.setdefault(row, []).append((start, n + WIDTH - 1, source, at))
        out = []
        for i, (d, text) in enumerate(zip(batch.ids, batch.texts)):
            found = text.split()
            n, removed, mine = len(found), 0, spans.get(i, [])
            if i in batch.copies and n >= WIDTH:
                mine, removed, found = [(0, n, None, None)], n, []
            elif mine:
                kept, upto = [], 0
                for start, size, *_ in mine:
                    kept += found[upto:start]
                    upto = max(upto, start + size)
                found = kept + found[upto:]
                removed = n - len(found)
            left_over = b" ".join(found)
            if digest:
                left_over = hashlib.sha256(left_over).hexdigest().encode()
            out.append((d, n, removed, left_over, [dict(zip(("start", "n_words", "source_doc", "source_start"), s)) for s in mine]))
        span = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source_doc", pa.int64()), ("source_start", pa.int32())])
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(span))
        names = ("doc_id", "n_words", "n_removed", "kept", "spans")
        return pa.table({name: pa.array(c, t) for name, c, t in zip(names, zip(*out), types)})

    mail = ex.send(1, ex.copies, ask_keys, windows.answer_keys)
    mail = ex.send(2, mail, ask_edges, _answer)
    return ex.cut(mail, cut, SCHEMA)
