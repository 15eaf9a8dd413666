"""Scoring texts by prediction by partial matching over bytes.

A trie of byte contexts is counted over the training documents: the ``order`` bytes
before a symbol (five in the query), and every shorter context down to none. A symbol not
seen after its longest context escapes to the next shorter one with the probability
d / (n + d), for d distinct symbols among n (method C); symbols that the longer context
had are excluded there, and at the end the rest of the 256 bytes share what is left. A
text ends with byte 0xFF, which no UTF-8 text holds, and starts after as many of them.

The trie is one table per depth: a row is a context with its symbol, and a shorter context
is counted by adding the rows of the deeper table. What a context passes on when it
escapes needs no list of its symbols: they all occur in the next shorter context, so their
counts there, summed, are what it excludes. So each depth is joined once with the one
below on the shorter run and gathered once by context, of which each has at most 256
rows. Depths up to two are a table of 2^24 code lengths (64 MB whatever the corpus).
Runs that only held-out texts have are rows too, with a count of zero, so that every run
of the corpus finds its code length.

The base model counts words. Documents lie in batches; each batch sends the parts of
the word space its distinct words with their counts and gets the corpus counts back, so
the commonest word is one entry per batch. Words are told apart by a 64-bit hash. It
sends its distinct runs of bytes too, each once, and gets their code lengths back in
single precision; a text's are summed in double precision.

Null texts count as empty: one end, no words. A null doc_id is never held out. Repeated
rows count and are scored as often as they appear. An empty table gives an empty result,
without training documents every score is that of the uniform model; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import windows
from tidemark.llm.common import held_out, written
from tidemark.llm.windows import Exchange

MOD, REMAINDER = 7, 2
END = 0xFF
GRAMS = 1 << 24
#: Bytes of the longest context in the query.
ORDER = 5
#: Bytes of text taken at a time, and distinct runs that a counting task holds.
BLOCK, HELD = 1 << 20, 1 << 22
#: Runs go to parts by their remainder modulo this prime.
_PRIME = 1_000_003
WORDS, RUNS = 0, 1
_MAIL = "kind int, batch int, part int, payload binary"


def codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``order`` + 1 bytes ending at each symbol of each text and its end, as one number, and where each text starts."""
    pad = bytes([END]) * order
    b = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8)
    runs = np.zeros(len(b) - order, np.int64)
    for k in range(order + 1):
        runs <<= 8
        runs |= b[k : len(b) - order + k]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)) * order, sizes)
    return runs[inside], np.cumsum(sizes) - sizes


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in their order, about BLOCK bytes at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _counted(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    runs = np.sort(runs)
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    return runs[first], np.diff(np.append(first, len(runs)))


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """gram, n: each run of ``order`` + 1 bytes and how often training texts have it."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate(c) for c in zip(*held))
        at = np.argsort(gram, kind="stable")
        gram, n = gram[at], n[at]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        return gram[first], np.add.reduceat(n, first)

    def row(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for weight in (0, 1):
                texts = b.column(1).filter(pc.equal(b.column(0), weight == 0)).to_pylist()
                for block in _blocks([t or b"" for t in texts]):
                    gram, n = _counted(codes(block, order)[0])
                    held.append((gram, n * weight))
                    size += len(gram)
                    if size > HELD:
                        held = [merged(held)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield row(*held[0])
                            held, size = [], 0
        if held:
            yield row(*merged(held))

    texts = docs.select(held_out(F.col("doc_id"), MOD, REMAINDER), F.col("text").cast("binary"))
    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _next_order(counts: np.ndarray, free: np.ndarray, left: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicts the free symbols of each row by counts; returns what stays free and the escaped probability.

    ``left`` is the probability that reached this order; ``p`` takes what it predicts.
    """
    counts = np.where(free, counts, 0.0)
    seen = counts > 0
    n, d = counts.sum(1), seen.sum(1)
    rest = free & ~seen
    d = np.where(rest.any(1), d, 0)  # nothing left to escape to
    total = np.maximum(n + d, 1.0)
    p += (left / total)[:, None] * counts
    return rest, np.where(n > 0, left * d / total, left)


def _predicted(*orders: np.ndarray) -> np.ndarray:
    """The probability of each symbol, for rows of counts from the longest context to the shortest."""
    shape = orders[0].shape
    p, free, left = np.zeros(shape), np.ones(shape, bool), np.ones(shape[0])
    for counts in orders:
        free, left = _next_order(counts, free, left, p)
    return p + free * (left / np.maximum(free.sum(1), 1))[:, None]


def code_lengths(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte after the first two, for all 2^24 runs.

    Contexts of two bytes that were never seen predict as the last one alone does.
    """
    one = np.bincount(grams & 0xFFFF, n, 65536).reshape(256, 256)
    zero = np.broadcast_to(one.sum(0), (256, 256))
    out = np.empty((256, 256, 256), np.float32)
    out[:] = np.log10(_predicted(one, zero))
    seen, at = np.unique(grams >> 8, return_inverse=True)
    rows = out.reshape(65536, 256)
    for start in range(0, len(seen), 2048):
        some = seen[start : start + 2048]
        mine = (at >= start) & (at < start + len(some))
        two = np.bincount((at[mine] - start) * 256 + (grams[mine] & 0xFF), n[mine], len(some) * 256).reshape(-1, 256)
        rows[some] = np.log10(_predicted(two, one[some & 0xFF], np.broadcast_to(zero[0], two.shape)))
    return out.ravel()


def _root(counts: DataFrame) -> DataFrame:
    """gram, n, total, kinds and log of contexts of two bytes; at most 2^24 rows, whose counts reach the driver."""
    rows = counts.toArrow()
    model = counts.sparkSession.sparkContext.broadcast((rows.column("gram").to_numpy(), rows.column("n").to_numpy()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = model.value
        table = None
        for b in batches:
            if table is None:  # a task without rows makes none
                table = code_lengths(gram, n)
                total = np.bincount(gram >> 8, n, 65536).astype(np.int64)
                kinds = np.bincount(gram >> 8, n > 0, 65536).astype(np.int64)
            at = b.column(0).to_numpy()
            columns = [b.column(0), b.column(1), pa.array(total[at >> 8]), pa.array(kinds[at >> 8]), pa.array(table[at].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "n", "total", "kinds", "log"])

    return counts.mapInArrow(look_up, "gram long, n long, total long, kinds long, log double")


def _deeper(counts: DataFrame, shorter: DataFrame, order: int) -> DataFrame:
    """gram, n, total, kinds and log (base 10) of contexts of ``order`` bytes, from those of one byte less.

    ``total`` and ``kinds`` are the n and d of a context. ``log`` is the probability of the
    symbol with nothing excluded. Escaped to from a longer context, the shorter one has
    ``total - out`` and ``kinds - out_kinds`` left, which changes its ``log`` by a term of its own.
    """
    below = shorter.select(F.col("gram").alias("_of"), *[F.col(c).alias(f"_{c}") for c in ("n", "total", "kinds", "log")])
    of = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
    context = Window.partitionBy(F.shiftright("gram", 8))
    rows = counts.join(below, of == F.col("_of")).select(
        "gram",
        "n",
        F.sum("n").over(context).alias("total"),
        F.count_if(F.col("n") > 0).over(context).alias("kinds"),
        F.sum(F.when(F.col("n") > 0, F.col("_n")).otherwise(0)).over(context).alias("out"),
        *[f"_{c}" for c in ("n", "total", "kinds", "log")],
    )
    n, total, kinds = (F.col(c) for c in ("n", "total", "kinds"))
    left, left_kinds = F.col("_total") - F.col("out"), F.col("_kinds") - kinds

    def log_of(part: Column, whole: Column) -> Column:
        return F.log10(part.cast("double")) - F.log10(whole.cast("double"))

    escape_before = log_of(F.col("_kinds"), F.col("_total") + F.col("_kinds"))
    change = (
        F.when(F.col("_total") == 0, 0.0)
        .when(F.col("_n") > 0, log_of(F.col("_total") + F.col("_kinds"), left + left_kinds))
        .when(left > 0, log_of(left_kinds, left + left_kinds) - escape_before)
        .otherwise(-escape_before)
    )
    log = (
        F.when(n > 0, log_of(n, total + kinds))
        .when(total > 0, log_of(kinds, total + kinds) + F.col("_log") + change)
        .otherwise(F.col("_log"))
    )
    return rows.select("gram", "n", "total", "kinds", log.alias("log"))


def trie(docs: DataFrame, order: int) -> DataFrame:
    """gram and log: the code length of every run of ``order`` + 1 bytes of the texts."""
    depths = {order: written(gram_counts(docs, order))}
    for k in range(order - 1, 1, -1):
        run = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")
        depths[k] = written(depths[k + 1].groupBy(run).agg(F.sum("n").alias("n")))
    found = _root(depths[2])
    for k in range(3, order + 1):
        found = written(_deeper(depths[k], found, k))
    return found.select("gram", "log")


class _Runs:
    """The distinct runs of bytes of a batch, from those of its blocks, sorted by value within parts."""

    def __init__(self, found: list[np.ndarray], order: int, parts: int):
        self.runs, _ = _counted(np.concatenate(found))
        part = self.runs % _PRIME % parts
        self.place = np.argsort(part, kind="stable")
        self.part, self.width = part[self.place], order + 1

    def payloads(self) -> dict[int, bytes]:
        """The runs of each part, first the lowest bytes of all, then the next."""
        some, cut = np.unique(self.part, return_index=True)
        sent = np.split(self.runs[self.place].astype("<i8"), cut[1:])
        return {p: r.view(np.uint8).reshape(-1, 8)[:, : self.width].T.tobytes() for p, r in zip(some.tolist(), sent)}

    def logs(self, answers: dict[int, bytes]) -> np.ndarray:
        """The answers in the order of the runs."""
        out = np.empty(len(self.runs), np.float32)
        out[self.place] = np.concatenate([np.frombuffer(answers[p], "<f4") for p in np.unique(self.part).tolist()])
        return out


def _code_lengths_of(sent: list[bytes], table: pa.Table, width: int) -> list[bytes]:
    """For each batch the code lengths of the runs it sent to this part."""
    gram, log = (table.column(c).to_numpy() for c in ("gram", "log"))
    at = np.argsort(gram)
    gram, log = gram[at], log[at].astype("<f4")
    out = []
    for payload in sent:
        asked = np.zeros((len(payload) // width, 8), np.uint8)
        asked[:, :width] = np.frombuffer(payload, np.uint8).reshape(width, -1).T
        out.append(log[np.searchsorted(gram, asked.view("<i8").ravel())].tobytes())
    return out


def _scores(texts: list[bytes], answers: dict[int, bytes], order: int, parts: int) -> np.ndarray:
    """The log10 probability of each text, from the code lengths its batch got back."""
    blocks = []
    for block in _blocks(texts):
        runs, starts = codes(block, order)
        found = pa.array(runs).dictionary_encode()
        blocks.append((found.dictionary.to_numpy(), found.indices.to_numpy(), starts))
    own = _Runs([distinct for distinct, _, _ in blocks], order, parts)
    logs = own.logs(answers).astype(np.float64)
    return np.concatenate([np.add.reduceat(logs[np.searchsorted(own.runs, d)][at], starts) for d, at, starts in blocks])


class _Words:
    """The distinct words of a batch with their training counts, sorted by hash within parts."""

    def __init__(self, docs: pa.Table, parts: int):
        self.ids = docs.column("doc_id").to_pylist()
        self.texts = docs.column("text").to_pylist()
        self.held = [d is not None and zlib.crc32(str(d).encode()) % MOD == REMAINDER for d in self.ids]
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__  # a new word gets the next number
        found = []
        for text in self.texts:
            words = text.lower().split()
            words.append(b"")  # the end of a text is the word without bytes
            found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.found = np.concatenate(found)
        counts = np.bincount(self.found[np.repeat(~np.array(self.held), self.sizes)], minlength=len(numbers))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in numbers), np.uint64, len(numbers))
        part = (hashes >> np.uint64(40)).astype(np.int64) % parts
        self.place = np.lexsort((hashes, part))
        self.hashes, self.part, self.counts = hashes[self.place], part[self.place], counts[self.place]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of a value of its words, given in the order of the hashes."""
        of = np.empty_like(values)
        of[self.place] = values
        return np.add.reduceat(of[self.found], np.cumsum(self.sizes) - self.sizes)

    def bounds(self, part: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.part, [part, part + 1])
        return int(a), int(b)

    def payloads(self) -> dict[int, bytes]:
        out = {}
        for p in np.unique(self.part).tolist():
            a, b = self.bounds(p)
            out[p] = self.hashes[a:b].astype("<u8").tobytes() + self.counts[a:b].astype("<u4").tobytes()
        return out


def _sum_counts(sent: list[bytes]) -> list[bytes]:
    """For each batch the corpus counts of its words; at the end all counts and distinct words."""
    sizes = [len(p) // 12 for p in sent]
    hashes = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(sent, sizes)])
    counts = np.concatenate([np.frombuffer(p, "<u4", n, 8 * n) for p, n in zip(sent, sizes)]).astype(np.int64)
    _, at = np.unique(hashes, return_inverse=True)
    total = np.bincount(at, counts).astype(np.int64)
    back, cut = total[at].astype("<i8"), np.cumsum([0, *sizes])
    totals = int(total.sum()).to_bytes(8, "big") + int((total > 0).sum()).to_bytes(8, "big")
    return [*(back[a:b].tobytes() for a, b in zip(cut, cut[1:])), totals]


def _mail(kinds: Sequence[int], batches: Sequence[int], parts: Sequence[int], payloads: Sequence[bytes]) -> pa.Table:
    return pa.table(
        {
            "kind": pa.array(kinds, pa.int32()),
            "batch": pa.array(batches, pa.int32()),
            "part": pa.array(parts, pa.int32()),
            "payload": pa.array(payloads, pa.binary()),
        }
    )


def score(docs: DataFrame, batch_bytes: int = windows.BATCH_BYTES, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``order`` is the length of the longest context in bytes, from 2 to 6.
    """
    if not 2 <= order <= 6:
        raise ValueError(f"order must lie between 2 and 6, not {order}")
    ex = Exchange(docs, batch_bytes)
    parts = ex.parts
    owner = F.pmod(F.pmod("gram", F.lit(_PRIME)), F.lit(parts)).cast("int").alias("part")
    lengths = trie(docs, order).select(owner, "gram", "log")

    def ask(left: pa.Table) -> pa.Table:
        words = _Words(left, parts)
        runs = _Runs([_counted(codes(block, order)[0])[0] for block in _blocks(words.texts)], order, parts)
        batch = left.column("batch")[0].as_py()
        sent = [(k, p, payload) for k, of in ((WORDS, words), (RUNS, runs)) for p, payload in of.payloads().items()]
        kinds, to, payloads = zip(*sent)
        return _mail(kinds, [batch] * len(sent), to, payloads)

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        for kind in (WORDS, RUNS):
            some = asked.filter(pc.equal(asked.column("kind"), kind))
            if not len(some):
                continue
            batches, sent = some.column("batch").to_pylist(), some.column("payload").to_pylist()
            if kind == WORDS:
                batches, back = [*batches, -1], _sum_counts(sent)
            else:
                back = _code_lengths_of(sent, table, order + 1)
            part = some.column("part")[0].as_py()
            out.append(_mail([kind] * len(batches), batches, [part] * len(batches), back))
        return pa.concat_tables(out) if out else _mail([], [], [], [])

    def scored(left: pa.Table, mail: pa.Table) -> pa.Table:
        batch = _Words(left, parts)
        counts = np.zeros(len(batch.hashes), np.int64)
        answers: dict[int, bytes] = {}
        for kind, p, payload in zip(*(mail.column(c).to_pylist() for c in ("kind", "part", "payload"))):
            if kind == RUNS:
                answers[p] = payload
                continue
            a, b = batch.bounds(p)
            counts[a:b] = np.frombuffer(payload, "<i8")
        columns = {
            "doc_id": pa.array(batch.ids, pa.int64()),
            "held_out": pa.array(batch.held, pa.bool_()),
            "n_tokens": pa.array(batch.sizes),
            "n_known": pa.array(batch.sums((counts > 0).astype(np.int64))),
            "log_counts": pa.array(batch.sums(np.log10(counts + 1.0))),
            "score": pa.array(_scores(batch.texts, answers, order, parts)),
        }
        return pa.table(columns)

    asked = ex.batches.groupBy("batch").applyInArrow(ask, _MAIL)
    answered = asked.groupBy("part").cogroup(lengths.groupBy("part")).applyInArrow(answer, _MAIL)
    number = lambda at: F.conv(F.hex(F.substring("payload", at, 8)), 16, 10).cast("long")
    totals = answered.where("batch = -1").agg(F.sum(number(1)).alias("n"), F.sum(number(9)).alias("v"))
    rows = ex.batches.groupBy("batch").cogroup(answered.where("batch >= 0").groupBy("batch")).applyInArrow(
        scored,
        "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double",
    )
    both = totals.select(F.struct("n", "v")).scalar()
    return rows.withColumn("t", both).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.col("t.n").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("t.n") + F.col("t.v") + 1)).alias("base_score"),
        "score",
    )
