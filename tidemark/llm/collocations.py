"""Collocations by stripes: what follows each phrase, how often, and what that says.

A stripe is a phrase with a counter of the words that follow it; the empty phrase has one
too, the words themselves. Texts are read once, into chunks that hold numbers for words.
Then level by level the phrases get one word longer. A task counts its chunks into
stripes (prefix, next words, counts), one per prefix, and the
stripes of all tasks are merged entry by entry. A prefix such as an article is followed by
a good part of the vocabulary, so the merged stripe is not gathered anywhere: its entries
are rows that share the prefix, added up before and after the shuffle.

From these entries comes everything else: the extensions of a phrase are the entries of
its stripe, its total is its entry in the stripe of its own beginning, and whether a longer
phrase subsumes it is a maximum over its stripe, and over the entries that end in it.

A phrase is as frequent as its rarest part at most, so longer phrases are only looked at
where both parts, without the last and without the first word, reached the threshold. And
most phrases are rare, so before a level is counted exactly its phrases are counted by a
hash of 64 bits, in the pass that counts the level before: eight bytes an entry instead of
two texts. Only phrases whose hash reached the threshold enter stripes. A task looks that
up in a bitmap of three probes a hash, whose size follows from their number up to 2^28
bits. Phrases that share a hash or its bits let too much be counted, never too little, and
what stays below the threshold goes after the merge: all counts are exact.

Rows: null and empty texts have no words; a null language is ``und``; a null id changes
nothing, as ids are not read; repeated rows count once each; an empty table gives an empty
one; other columns are not read. A long text is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shared_folder, written

#: Words of a phrase at most, and occurrences at least.
LONGEST = 5
SUPPORT = 100
#: Words that a task holds at once, numbers instead of texts.
CHUNK_WORDS = 1 << 20
#: Chunks of a file at most, as a reader may hold a file's chunks at once.
FILE_CHUNKS = 8
#: Entries of a row at most: short stripes share one, a long one takes several.
ROW_ENTRIES = 1 << 15
#: Bitmaps have at least and at most so many bits, as powers of two.
LEAST_BITS, MOST_BITS = 20, 28

#: Ends of pieces, and what separates words within them.
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")

#: A block of stripes, prefix by prefix; or counts of hashes, with neither prefix nor next words.
STRIPE = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("prefix", T.ArrayType(T.StringType())),
        T.StructField("next", T.ArrayType(T.StringType())),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)


#: Texts with numbers for words.
CHUNK = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three places of a hash in a bitmap of 2^bits bits."""
    for _ in range(3):
        yield h >> np.uint64(64 - bits)
        h = _mix(h)


class Bitmap:
    """A set of hashes, too large rather than too small; at most 2^28 bits."""

    def __init__(self, hashes: DataFrame):
        self.bits = bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy().view(np.uint64)
                found = np.concatenate(list(_probes(h, bits)))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["place"])

        at = F.col("place") + 1
        pieces = (
            hashes.mapInArrow(place, "place long")
            .groupBy(F.bitmap_bucket_number(at).alias("n"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        )
        found = bytearray(max(1 << (bits - 3), 1))
        for n, part in pieces.collect():  # at most 2^13 pieces of 4 KB
            start = (n - 1) * len(part)
            found[start : start + len(part)] = part[: max(0, len(found) - start)]
        self.held = hashes.sparkSession.sparkContext.broadcast(bytes(found))

    def has(self, h: np.ndarray) -> np.ndarray:
        held = np.frombuffer(self.held.value, np.uint8)
        answer = np.ones(len(h), bool)
        for at in _probes(h, self.bits):
            answer &= ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return answer

    def __getstate__(self):
        return self.bits, self.held

    def __setstate__(self, state):
        self.bits, self.held = state


class _Names(dict):
    """word -> number, in order of appearance; 0 and 1 are no words: nothing, and the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The texts as chunks (lang, names, ids): each a list of its words, and a number per occurrence.

    Numbers are 32 bits wide; 0 and 1 are no words, and 1 stands where a piece ends. A task
    closes its chunks once they hold ``chunk_words`` words; a longer text is one chunk.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    end = np.ones(1, np.int32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple[_Names, list[np.ndarray]]] = {}
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            for lang, (names, parts) in open_.items():
                texts = pa.array(names, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()),
                        pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts),
                        pa.array([np.concatenate(parts).astype("<i4").tobytes()], pa.binary()),
                    ],
                    names=CHUNK.names,
                )
            open_.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                names, parts = open_.setdefault(lang, (_Names({b"": 0, b"\n": 1}), []))
                tokens = text.as_py().lower().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(names.__getitem__, tokens), np.int32, len(tokens))
                ids = ids[ids > 0]
                parts += [ids, end]
                held += len(ids)
                if held >= chunk_words:
                    yield from close()
                    held = 0
        yield from close()

    return rows.mapInArrow(read, CHUNK)


def counted(
    lang: str, words: pa.StringArray, ids: np.ndarray, order: int, frequent: Bitmap | None, more: bool
) -> Iterator[pa.RecordBatch]:
    """Of one chunk: stripes of prefixes of ``order`` words, and, with ``more``, hashed counts of phrases two words longer.

    ``frequent``: hashes of phrases of ``order`` + 1 words; without it all of them count.
    """
    n = len(ids) - order
    if n < 1:
        return
    word = ids > 1
    inside = word[:n].copy()
    for k in range(1, order + 1):
        inside &= word[k : k + n]
    hashed = h = None
    if frequent is not None or more:
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        h = np.full(n, xxhash.xxh64_intdigest(lang.encode()), np.uint64)
        for k in range(order + 1):
            h ^= hashed[ids[k : k + n]]
            h = _mix(h)
    if frequent is not None:
        places = np.flatnonzero(inside)
        inside[places] = frequent.has(h[places])
    places = np.flatnonzero(inside)
    if len(places):
        yield from _stripes(lang, words, ids, places, order)
    if more:
        places = np.flatnonzero(inside[:-1] & inside[1:])  # both parts of the longer phrase
        keys, counts = np.unique(_mix(h[places] ^ hashed[ids[places + order + 1]]), return_counts=True)
        yield from _rows(None, counts, hashes=pa.array(keys.view(np.int64)))


def _stripes(lang: str, words: pa.StringArray, ids: np.ndarray, places: np.ndarray, order: int) -> Iterator[pa.RecordBatch]:
    if order == 0:
        total = np.bincount(ids[places], minlength=len(words))
        where = np.flatnonzero(total)
        counts, following = total[where], words.take(pa.array(where))
        prefix = pa.array([""], pa.string()).take(pa.array(np.zeros(len(where), np.int32)))
    else:
        # equal prefixes get equal numbers, one word at a time; entries are sorted by prefix, then next word
        first = ids[places].astype(np.int64)
        for k in range(1, order):
            _, first = np.unique((first << 32) | ids[places + k], return_inverse=True)
        _, where, counts = np.unique((first << 32) | ids[places + order], return_index=True, return_counts=True)
        where = places[where]
        following = words.take(pa.array(ids[where + order]))
        prefix = pc.binary_join_element_wise(*[words.take(pa.array(ids[where + k])) for k in range(order)], " ")
    yield from _rows(lang, counts, prefix=prefix, next=following)


def _rows(lang: str | None, counts: np.ndarray, **values: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of at most ROW_ENTRIES entries, one at a time."""
    columns = values | {"counts": pa.array(counts.astype(np.int64))}
    for start in range(0, len(counts), ROW_ENTRIES):
        own = {c: v.slice(start, ROW_ENTRIES) for c, v in columns.items()}
        row = {"lang": pa.array([lang], pa.string())}
        for c, v in own.items():
            row[c] = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        for c, t in (("prefix", pa.string()), ("next", pa.string()), ("hashes", pa.int64())):
            row.setdefault(c, pa.nulls(1, pa.list_(t)))
        yield pa.RecordBatch.from_arrays([row[c] for c in STRIPE.names], names=STRIPE.names)


def stripes(chunks: DataFrame, order: int, frequent: Bitmap | None = None, more: bool = False) -> DataFrame:
    """What ``counted`` finds in each chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), "<i4")
                yield from counted(lang, batch.column(1)[i].values, ids, order, frequent, more)

    return chunks.mapInArrow(read, STRIPE)


def merged(partial: DataFrame) -> DataFrame:
    """The stripes and hashed counts of all tasks, merged entry by entry: lang, prefix, next, hash, f."""
    values = {"prefix": "string", "next": "string", "hashes": "long"}
    none = {c: F.array_repeat(F.lit(None).cast(t), F.size("counts")) for c, t in values.items()}
    whole = partial.withColumns({c: F.coalesce(c, none[c]) for c in values})
    entries = whole.select("lang", F.explode(F.arrays_zip(*values, "counts")).alias("e"))
    entries = entries.select("lang", "e.prefix", "e.next", F.col("e.hashes").alias("hash"), "e.counts")
    return entries.groupBy("lang", "prefix", "next", "hash").agg(F.sum("counts").alias("f"))


def phrase(prefix: str = "prefix", following: str = "next") -> Column:
    return F.when(F.col(prefix) == "", F.col(following)).otherwise(F.concat_ws(" ", prefix, following))


def levels(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Merged stripes of all levels (lang, prefix, next, f, phrase, words), and n words per lang.

    Only entries of at least ``support`` stay, after each level is merged.
    """
    path = shared_folder(docs.sparkSession)
    encode(docs, chunk_words).write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(path)
    chunks = docs.sparkSession.read.schema(CHUNK).parquet(path)
    enough = F.col("f") >= support
    frequent, found, totals = None, None, None
    for order in range(longest):
        both = merged(stripes(chunks, order, frequent, order + 1 < longest))
        if order == 0:  # the empty phrase's stripe says how many words there are, the rare ones too
            both = written(both.where(enough | F.col("hash").isNull()))
            totals = written(both.where(F.col("hash").isNull()).groupBy("lang").agg(F.sum("f").alias("n")))
            both = both.where(enough)
        else:
            both = written(both.where(enough))
        level = both.where(F.col("hash").isNull()).drop("hash")
        level = level.withColumn("phrase", phrase()).withColumn("words", F.lit(order + 1))
        found = level if found is None else found.unionByName(level)
        if order + 1 < longest:
            frequent = Bitmap(both.where(F.col("hash").isNotNull()).select("hash"))
    return found, totals


def scored(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Candidates of two words and more: lang, phrase, words, a, l, r, n, k, score, subsumed.

    ``k``: the words before the cut of the lowest score floor(1000 a n / (l r)); ties go to
    the smallest. ``subsumed``: whether a longer candidate that holds it is as frequent.
    Products are decimals of 38 digits, exact up to 10^17 words.
    """
    found, totals = levels(docs, support, longest, chunk_words)
    several = found.where(F.col("words") > 1)

    # the stripe of a phrase holds what extends it to the right; what extends it to the left ends in it
    right = several.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("f").alias("longer"))
    left = several.groupBy("lang", F.regexp_replace("phrase", "^[^ ]+ ", "").alias("phrase")).agg(F.max("f").alias("longer"))
    longer = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))

    # every cut of a candidate, and the totals of its two parts
    parts = F.split("phrase", " ")
    cuts = several.select(
        "lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).select(
        "*", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
    )
    count = found.select("lang", "phrase", "f")
    heads = count.toDF("lang", "head", "l")
    tails = count.toDF("lang", "tail", "r")
    exact = [F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")]
    whole = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(totals), "lang")
    cut = F.struct(F.expr("(a38 * 1000 * n38) div (l38 * r38)").alias("score"), "k", "l", "r")
    lowest = (
        whole.withColumns(dict(zip(("a38", "n38", "l38", "r38"), exact)))
        .withColumn("cut", cut)
        .groupBy("lang", "phrase", "words", "a", "n")
        .agg(F.min("cut").alias("cut"))
    )
    return lowest.join(longer, ["lang", "phrase"], "left").select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.k", "cut.score",
        F.coalesce(F.col("longer") >= F.col("a"), F.lit(False)).alias("subsumed"),
    )


def top(candidates: DataFrame, limit: int, spread: int = 256) -> DataFrame:
    """Each language's first ``limit`` candidates, ranked from 1.

    A language is cut into ``spread`` parts by the hash of the phrase, whose own first
    ``limit`` are the only ones that can be among its first, so no task sorts a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    within = candidates.withColumn("_part", part).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    )
    few = within.where(F.col("_rank") <= limit).drop("_part", "_rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= limit)


def collocations(docs: DataFrame, limit: int = 2000, support: int = SUPPORT, longest: int = LONGEST, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Each language's first collocations: lang, rank, phrase, words, a, l, r, n, k, score.

    Subsumed candidates are left out; order is by score, a (both descending) and phrase.
    """
    kept = scored(docs, support, longest, chunk_words).where(~F.col("subsumed")).drop("subsumed")
    return top(written(kept), limit).select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "k", "score")
