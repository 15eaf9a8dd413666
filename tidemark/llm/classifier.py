"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters over eight bytes slide along the whole document
in steps of four. Besides the bytes, a filter sees one flag per byte: whether the eight
bytes up to it equal those a short way before. The document is cut into chunks that
overlap by half; each filter keeps its maximum in each chunk. The largest and the mean
of those over the chunks are combined, through a small hidden layer, into one
probability.

The network is trained in one task on a bounded sample of labelled rows: at most
``SAMPLE`` rows of each label, of texts up to ``SAMPLE_BYTES`` bytes, smallest hash of
the doc_id first. Scoring reads every text whole, in one pass without a shuffle; the
weights (some 40 KB) travel with the tasks.

Neither the labels nor lang, source or doc_id are inputs of a score. Null texts score as
empty ones; a null doc_id is never held out. Of contradicting labels the smaller counts;
without any labelled row every score is a half. Repeated rows score alike. An empty table
gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out

MOD, REMAINDER = 4, 2
THRESHOLD = 0.7
SAMPLE = 2000
SAMPLE_BYTES = 1 << 14
WIDE, STEP, HALF = 8, 4, 32  # bytes of a filter, bytes of a step, steps of half a chunk
PAD = 24  # zeros after each document, more than a filter and a lag
LAGS = range(2, 17)
FILTERS, EMBEDDED, HIDDEN = 16, 6, 12
BLOCK = 1 << 20


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each with zeros up to whole half chunks; half chunks of each."""
    unit = STEP * HALF
    halves = np.array([-(-(len(t) + PAD) // unit) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(n * unit, b"\0") for t, n in zip(texts, halves.tolist())), np.uint8), halves


def recurring(b: np.ndarray) -> np.ndarray:
    """Whether the eight bytes up to each place equal those some lag before."""
    out = np.zeros(len(b), bool)
    for lag in LAGS:
        same = np.zeros(len(b), bool)
        np.equal(b[lag:], b[:-lag], out=same[lag:])
        for shift in (1, 2, 4):
            same[shift:] &= same[:-shift].copy()
        out |= same
    return out & (b != 0)


@dataclass
class Network:
    """Weights; ``steps`` runs over blocks of documents and ``train`` fits them."""

    embedding: np.ndarray  # 256 x EMBEDDED
    filters: np.ndarray  # WIDE x EMBEDDED x FILTERS
    flags: np.ndarray  # WIDE x FILTERS
    bias: np.ndarray  # FILTERS
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int = 0) -> "Network":
        r = np.random.default_rng(seed)
        n = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        return cls(
            n(256, EMBEDDED, scale=0.5), n(WIDE, EMBEDDED, FILTERS, scale=0.3), n(WIDE, FILTERS, scale=0.3),
            np.zeros(FILTERS, np.float32), n(2 * FILTERS, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32),
            n(HIDDEN, scale=0.3), np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return list(vars(self).values())

    def responses(self, b: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The response of each filter at each step, before pooling."""
        tables = self.embedding @ self.filters  # WIDE x 256 x FILTERS
        n = len(b) // STEP
        ahead = np.concatenate((b, np.zeros(WIDE, np.uint8)))
        flag_ahead = np.concatenate((flags, np.zeros(WIDE, bool)))
        total = np.tile(self.bias, (n, 1))
        for j in range(WIDE):
            total += tables[j][ahead[j : j + n * STEP : STEP]]
        marked = np.stack([flag_ahead[j : j + n * STEP : STEP] for j in range(WIDE)], 1)
        some = np.flatnonzero(marked.any(1))
        total[some] += marked[some].astype(np.float32) @ self.flags
        return total

    def pooled(self, b: np.ndarray, flags: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, ...]:
        """Features of each document, and where each half chunk and chunk has its maximum."""
        r = self.responses(b, flags).reshape(-1, HALF, FILTERS)
        ends = np.cumsum(halves)
        r[ends - 1, -1] = -np.inf  # the last step of a document sees the next one
        where = r.argmax(1)
        top = np.take_along_axis(r, where[:, None], 1)[:, 0]
        after = np.minimum(np.arange(len(top)) + 1, np.repeat(ends, halves) - 1)
        chunk = np.maximum(top, top[after])  # a document of one half chunk is one chunk
        starts = ends - halves
        mean = np.add.reduceat(np.maximum(chunk, 0), starts) / halves[:, None]
        return np.concatenate((np.maximum(np.maximum.reduceat(chunk, starts), 0), mean), 1), where, top, after, chunk, starts

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(np.log1p(features) @ self.hidden + self.hidden_bias)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30))), h

    def score(self, texts: list[bytes]) -> np.ndarray:
        b, halves = laid_out(texts)
        return self.head(self.pooled(b, recurring(b), halves)[0])[0]

    def gradients(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        b, halves = laid_out(texts)
        flags = recurring(b)
        x, where, top, after, chunk, starts = self.pooled(b, flags, halves)
        p, h = self.head(x)
        d = (p - labels) * weight / len(texts)
        dh = d[:, None] * self.out * (1 - h * h)
        lx = np.log1p(x)
        dx = (dh @ self.hidden.T) / (1 + x)
        doc = np.repeat(np.arange(len(texts)), halves)
        alive = chunk > 0
        d_chunk = alive * dx[doc, FILTERS:] / halves[doc][:, None]
        best = np.maximum.reduceat(chunk, starts)
        first = alive & (chunk == best[doc])
        d_chunk = d_chunk + first * dx[doc, :FILTERS] / np.maximum(np.add.reduceat(first.astype(np.float32), starts), 1)[doc]
        own = top >= top[after]
        d_top = d_chunk * own
        rest = d_chunk * ~own
        np.add.at(d_top, after, rest)
        half, f = np.nonzero(d_top)
        g = d_top[half, f].astype(np.float32)
        at = (half * HALF + where[half, f]) * STEP
        ahead = np.concatenate((b, np.zeros(WIDE, np.uint8)))
        flag_ahead = np.concatenate((flags, np.zeros(WIDE, bool)))
        d_emb, d_filters, d_flags = np.zeros_like(self.embedding), np.zeros_like(self.filters), np.zeros_like(self.flags)
        for j in range(WIDE):
            dt = np.bincount(ahead[at + j].astype(np.int64) * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            d_emb += dt @ self.filters[j].T
            d_filters[j] = self.embedding.T @ dt
            d_flags[j] = np.bincount(f, g * flag_ahead[at + j], FILTERS)
        d_bias = np.bincount(f, g, FILTERS).astype(np.float32)
        return [d_emb, d_filters, d_flags, d_bias, lx.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    @classmethod
    def train(cls, texts: list[bytes], labels: np.ndarray, epochs: int = 16, group: int = 32, rate: float = 0.01) -> "Network":
        """Adam over groups of documents; both labels weigh alike."""
        net = cls.new()
        w = net.weights()
        m, v, r = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], np.random.default_rng(1)
        share = np.array([len(labels) / (2 * max(1, (labels == k).sum())) for k in (0, 1)])
        rounds = max(epochs, -(-600 * group // len(texts)))  # small samples need as many steps
        t = 0
        for e in range(rounds):
            order = r.permutation(len(texts))
            step = rate * (1 - e / rounds) + rate / 50
            for at in range(0, len(order), group):
                some = order[at : at + group]
                t += 1
                for x, g, a, b in zip(w, net.gradients([texts[i] for i in some], labels[some], share[labels[some]]), m, v):
                    g = g + 1e-4 * x
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    x -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return net


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text and quality of the training rows, at most ``rows`` of each label."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"), MOD, REMAINDER)).withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy("h", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select(F.col("doc_id").cast("long").alias("of"), "quality")  # 2 x rows ids at most
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).where(F.octet_length("text") <= most_bytes)


def fit(docs: DataFrame, labels: DataFrame) -> list[np.ndarray] | None:
    """The trained weights; None without both labels."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (h, t, q) for b in batches for h, t, q in zip(*(b.column(i).to_pylist() for i in range(3)))
        )
        if len({q for _, _, q in rows}) == 2:
            net = Network.train([t for _, t, _ in rows], np.array([q for _, _, q in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes() for w in net.weights()]), pa.array(range(8))], ["w", "n"])

    rows = sample(docs, labels).select("doc_id", "text", F.col("quality").cast("int"))
    got = rows.coalesce(1).mapInArrow(learn, "w binary, n long").collect()
    shapes = [w.shape for w in Network.new().weights()]
    return [np.frombuffer(w, "<f4").reshape(shapes[n]) for w, n in sorted(got, key=lambda r: r[1])] or None


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights = fit(docs, labels)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*weights) if weights else None
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            scores, at = [], 0
            while net and at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < BLOCK:
                    size += len(texts[end])
                    end += 1
                scores += net.score(texts[at:end]).astype(float).tolist()
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores or [0.5] * len(texts), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scan, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), MOD, REMAINDER).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
