"""Runs of periodic words, by recompression.

A run is a stretch of consecutive words of one document that repeats itself with period q
for at least ``times`` periods, and that no neighbouring word extends. Such a stretch
holds ``times`` neighbouring points of the grid of multiples of q, and the words there are
equal: comparing a batch with itself at the grid points of every period, n / q of them for
period q and so n log n in all, leaves few candidates. How far the words around a candidate
really agree is answered by a grammar. Recompression makes it in rounds over the whole
batch: blocks of one symbol become one symbol, then pairs from one half of the alphabet
followed by the other half do, until every document is a single symbol. Equal stretches
are cut alike in every round up to a few symbols at their ends, so the longest common
extension of two places climbs the rounds while their cuts agree and descends where they
part, in steps that are the same for all candidates at once. The grammar read backwards
answers extensions to the left.

A document never leaves its row, so nothing is shuffled, and no task holds more than one
batch of documents, or one long document, and its grammar (about four times its words).

Rows: null, empty and blank texts have no words and no run; a null id is returned as it is;
repeated rows are each answered; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import let, words

#: Periods that a run has at least, and its words at least.
TIMES = 4
LEAST = 6
#: Words of a batch; a longer document is a batch of its own.
BATCH_WORDS = 1 << 19

RUNS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]), containsNull=False
)


class Round(NamedTuple):
    """One round of compression: a sequence, and how it was cut for the next."""

    symbols: np.ndarray
    up: np.ndarray  # per symbol: the symbol of the next round that holds it
    first: np.ndarray  # per symbol of the next round: its first symbol here; one more for the end
    blocks: bool  # cut into blocks of one symbol, or into pairs


def _starts(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(cut) - 1, np.append(np.flatnonzero(cut), len(cut))


def recompress(symbols: np.ndarray, free: int) -> tuple[list[Round], np.ndarray]:
    """The rounds over ``symbols``, and the sequence of the last one.

    Symbols below ``free`` may be joined; each of the others stands in one place and stays,
    as the ends of documents do. They must be first and last.
    """
    rounds = []
    fixed = symbols >= free
    new = int(symbols.max()) + 1 if len(symbols) else 0
    salt = 0
    while True:
        inner = ~fixed
        joined = inner[1:] & inner[:-1]
        if not joined.any():
            return rounds, symbols
        same = np.append(False, joined & (symbols[1:] == symbols[:-1]))
        blocks = bool(same.any())
        if blocks:
            up, first = _starts(~same)
            length = np.diff(first)
            block = length > 1
            keys, names = np.unique((symbols[first[:-1]][block] << 32) | length[block], return_inverse=True)
            after = symbols[first[:-1]].copy()
            after[block] = new + names
        else:
            # two halves by a hash of the symbol; of both directions the one that joins more
            salt += 1
            half = ((symbols.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            half = (half & np.uint64(1)).astype(bool)
            one = joined & half[:-1] & ~half[1:]
            two = joined & ~half[:-1] & half[1:]
            second = np.append(False, one if one.sum() >= two.sum() else two)
            if not second.any():
                continue
            up, first = _starts(~second)
            pair = np.diff(first) > 1
            at = first[:-1][pair]
            keys, names = np.unique((symbols[at] << 32) | symbols[at + 1], return_inverse=True)
            after = symbols[first[:-1]].copy()
            after[pair] = new + names
        new += len(keys)
        rounds.append(Round(symbols, up, first, blocks))
        symbols, fixed = after, fixed[first[:-1]]


def backwards(rounds: list[Round], last: np.ndarray) -> tuple[list[Round], np.ndarray]:
    """The same rounds with every sequence read from its end."""
    return [
        Round(r.symbols[::-1], r.up[-1] - r.up[::-1], len(r.symbols) - r.first[::-1], r.blocks) for r in rounds
    ], last[::-1]


def extensions(rounds: list[Round], last: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many symbols from ``p`` on equal those from ``q`` on, for pairs of different places."""
    begin, n = p, len(p)
    p, q = p.copy(), q.copy()
    parted = np.full(n, len(rounds))  # the round in which the symbols at p and q differ
    live = np.arange(n)
    for k, r in enumerate(rounds):
        if not len(live):
            break
        a, b = p[live], q[live]
        up_a, up_b = r.up[a], r.up[b]
        inside = (r.first[up_a] != a) | (r.first[up_b] != b)
        differ = inside & (r.symbols[a] != r.symbols[b])
        step = np.where(inside & ~differ, np.minimum(r.first[up_a + 1] - a, r.first[up_b + 1] - b), 0)
        a, b = a + step, b + step
        # both at a cut again, or one block has ended and the other goes on
        end_a, end_b = r.up[np.minimum(a, len(r.up) - 1)], r.up[np.minimum(b, len(r.up) - 1)]
        differ |= (r.first[end_a] != a) | (r.first[end_b] != b)
        p[live], q[live] = np.where(differ, a, end_a), np.where(differ, b, end_b)
        parted[live[differ]] = k
        live = live[~differ]
    while len(live):  # in the last sequence, one symbol after the other
        live = live[last[p[live]] == last[q[live]]]
        p[live] += 1
        q[live] += 1
    for k in range(len(rounds) - 1, -1, -1):
        r = rounds[k]
        below = np.flatnonzero(parted > k)
        if not len(below):
            continue
        up_a, up_b = p[below], q[below]
        a, b = r.first[up_a], r.first[up_b]
        common = np.minimum(r.first[up_a + 1] - a, r.first[up_b + 1] - b) if r.blocks else 1
        step = np.where(r.symbols[a] == r.symbols[b], common, 0)
        p[below], q[below] = a + step, b + step
    return p - begin


def candidates(symbols: np.ndarray, lengths: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): grid points from which ``times`` neighbouring ones hold equal words.

    ``lengths``: words of the documents that lie one after the other, longest first, each
    followed by a symbol of its own.
    """
    ends = np.cumsum(lengths + 1)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    longest = int(lengths[0]) if len(lengths) else 0
    for q in range(1, longest // times + 1):
        within = int(np.searchsorted(-lengths, -times * q, "right"))  # documents with room for a run
        grid = symbols[: ends[within - 1] : q]
        equal = grid[1:] == grid[:-1]
        if times > 2 and equal.any():
            for _ in range(times - 2):
                equal = equal[1:] & equal[:-1]
        found = np.flatnonzero(equal)
        if len(found):
            places.append(found * q)
            periods.append(np.full(len(found), q))
    return np.concatenate(places), np.concatenate(periods)


def runs(symbols: np.ndarray, lengths: np.ndarray, free: int, times: int, least: int) -> np.ndarray:
    """Every run as a row (start, length, period), by start, over documents laid out as for ``candidates``."""
    place, period = candidates(symbols, lengths, times)
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    whole = doc[place] == doc[place + (times - 1) * period]
    place, period = place[whole], period[whole]
    if not len(place):
        return np.zeros((0, 3), np.int64)
    # only the documents with a candidate enter the grammar
    chosen = np.zeros(len(lengths), bool)
    chosen[doc[place]] = True
    taken = np.flatnonzero(chosen[doc])
    inner = np.append(symbols.max() + 1, symbols[taken])
    inner[inner >= free] = free + np.arange(int((inner >= free).sum()))
    of = np.zeros(len(symbols), np.int64)
    of[taken] = np.arange(1, len(taken) + 1)
    a = of[place]
    b = a + period
    rounds, last = recompress(inner, free)
    ahead = extensions(rounds, last, a, b)
    rounds, last = backwards(rounds, last)
    back = extensions(rounds, last, len(inner) - a, len(inner) - b)
    found = np.column_stack([place - back, back + period + ahead, period])
    found = found[found[:, 1] >= np.maximum(least, times * period)]
    # the same stretch is found at each of its grid points and for multiples of its period
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1)) if len(found) else []
    found = found[fresh] if len(found) else found
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _measure(texts: list[bytes], times: int, least: int) -> list[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Per text: its runs, its words, and which words are kept."""
    split = [t.split() for t in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    lengths = np.array([len(split[i]) for i in order], np.int64)
    names: dict[bytes, int] = {}
    flat = np.empty(int(lengths.sum()) + len(order), np.int64)
    at = 0
    for i in order:
        own = split[i]
        flat[at : at + len(own)] = [names.setdefault(w, len(names)) for w in own]
        at += len(own) + 1
    ends = np.cumsum(lengths + 1) - 1
    flat[ends] = len(names) + np.arange(len(order))
    found = runs(flat, lengths, len(names), times, least)
    dropped = np.zeros(len(flat) + 1, np.int64)
    np.add.at(dropped, found[:, 0] + found[:, 2], 1)
    np.add.at(dropped, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    begins = ends - lengths
    cuts = np.searchsorted(found[:, 0], begins)
    stops = np.searchsorted(found[:, 0], ends)
    answer: list = [None] * len(order)
    for k, i in enumerate(order):
        own = found[cuts[k] : stops[k]] - np.array([begins[k], 0, 0])
        answer[i] = (own, split[i], kept[begins[k] : ends[k]])
    return answer


def find(docs: DataFrame, times: int = TIMES, least: int = LEAST, batch_words: int = BATCH_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text.

    The collapsed text keeps of each run its first period; a word that any run holds behind
    its first period goes. Words are joined by one space. ``digest``: instead of the text
    its SHA-256, and instead of the runs their number, their SHA-256 (a line
    ``start,length,period`` each) and the run of the greatest exponent.
    """
    rows = docs.select("doc_id", "text")
    shape = (
        [("n_runs", T.LongType()), *[(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")],
         ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]
        if digest
        else [("n_words", T.LongType()), ("runs", RUNS), ("collapsed", T.StringType())]
    )
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, t) for c, t in shape]])

    def answer(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        out = []
        for own, split, kept in _measure(texts, times, least):
            collapsed = b" ".join(split if kept.all() else [w for w, k in zip(split, kept.tolist()) if k])
            out.append(_digest(own, collapsed) if digest else (len(split), _structs(own), collapsed.decode()))
        columns = list(zip(*out)) if out else [[] for _ in shape]
        types = _arrow(digest)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            own = batch.column(0)
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                value = text.as_py() or b""
                size = len(value) // 4
                if texts and held + size > batch_words:
                    yield answer(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(own.slice(i, 1))
                texts.append(value)
                held += size
        if texts:
            yield answer(ids, texts)

    return rows.mapInArrow(read, schema)


def _structs(own: np.ndarray) -> list[dict]:
    return [dict(zip(("start", "length", "period"), r)) for r in own.tolist()]


def _arrow(digest: bool) -> list[pa.DataType]:
    if digest:
        return [*[pa.int64()] * 5, pa.string(), pa.string()]
    run = pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")])
    return [pa.int64(), pa.list_(pa.field("element", run, nullable=False)), pa.string()]


def strongest(own: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    if not len(own):
        return None
    rough = own[:, 1] / own[:, 2]
    near = own[rough >= rough.max() * (1 - 1e-12)].tolist()
    return tuple(min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def _digest(own: np.ndarray, collapsed: bytes) -> tuple:
    best = strongest(own)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
    return (
        len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document repeats itself from some word on.

    With h the CRC-32 of the id in decimals and g = floor(h / 10): if h ends in 0, each of
    the n words i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n -
    a) / (3 + g % 8)). Other texts stay as they are, those of null ids too.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeat(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def word(ap, i):
            a, p = ap["a"], ap["p"]
            return F.when(i < a, F.get(w, i.cast("int"))).otherwise(F.get(w, (a + (i - a) % p).cast("int")))

        spread = let(
            F.struct(a.alias("a"), p.alias("p")),
            lambda ap: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: word(ap, i)), " "),
        )
        return F.when(n > 0, spread).otherwise("")

    text = F.when(h % 10 == 0, let(words(F.col("text")), repeat)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


