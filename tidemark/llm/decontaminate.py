"""Benchmark decontamination by a positional inverted index.

The corpus is scanned once. A posting (term, document, position) is stored where the
term may be part of a test phrase: the term is in the test vocabulary, and enough of
its neighbours are too. The vocabulary travels as a bitmap of fixed size, so no test
set is too large for it.

A test phrase is looked up from its rarest term: that term's postings, shifted by its
place in the phrase, are the candidate starts. They are intersected with the shifted
list of the second-rarest term, and what is left with all the others at once. With
``slop`` 0 that is the exact phrase; with more, every word may stand up to ``slop``
places from where the phrase has it (a proximity match).

Null texts have no words and no hits; an item without words has no phrase. Equal
phrases of several items are searched once. Rows are told apart by a key of their
own, so null and repeated ids give one result row each. Empty tables give no hits.
Columns besides doc_id/item_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Known, term_set, written

PHRASE = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same cut on bytes: A-Z lowered, digits, a-z and all bytes beyond ASCII kept.
_TO_WORDS = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def phrases(benchmark: DataFrame, length: int = PHRASE) -> DataFrame:
    """item_id, phrase (its words joined), words: every run of ``length`` words of an item."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))))
    runs = items.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at"), length).alias("words"))
    return runs.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def index(docs: DataFrame, vocabulary: DataFrame, shortest: int, slop: int = 0) -> DataFrame:
    """row, doc_id, n_words, and the postings of the row as parallel arrays terms, places.

    A word is stored if some run of ``shortest + slop`` words around it has ``shortest``
    words of the vocabulary; no phrase of that length or more can lie elsewhere.
    """
    bits = docs.sparkSession.sparkContext.broadcast(term_set(vocabulary))
    span = shortest + slop

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(bits.value)
        for b in batches:
            counts, terms, places = [], [], []
            for text in b.column(2).to_pylist():
                found = (text or b"").translate(_TO_WORDS).split()
                counts.append(len(found))
                has = np.fromiter(map(known.__getitem__, found), bool, len(found))
                upto = np.concatenate(([0], np.cumsum(has)))
                starts = np.arange(max(1, len(found) - span + 1))
                full = upto[np.minimum(starts + span, len(found))] - upto[starts] >= shortest
                near = np.zeros(len(found) + 1, np.int64)
                np.add.at(near, starts[full], 1)
                np.add.at(near, np.minimum(starts[full] + span, len(found)), -1)
                live = np.flatnonzero(has & (np.cumsum(near)[:-1] > 0)).tolist()
                places.append(live)
                terms.append([found[i] for i in live])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(counts, pa.int64()),
                    pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array(places, pa.list_(pa.int32())),
                ],
                ["row", "doc_id", "n_words", "terms", "places"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("binary")
    ).mapInArrow(scan, "row long, doc_id long, n_words long, terms array<string>, places array<int>")


def postings(indexed: DataFrame) -> DataFrame:
    return indexed.select("row", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("places").alias("place")))).toDF(
        "row", "term", "place"
    )


def matches(posted: DataFrame, searched: DataFrame, slop: int = 0) -> DataFrame:
    """row, start, phrase, length of every match of the phrases (phrase, words).

    With ``slop``, start is where the phrase would begin by its rarest term.
    """
    frequency = posted.groupBy(F.col("term").alias("counted")).agg(F.count("*").alias("n"))
    parts = searched.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("off", "word"))
    plans = (
        parts.join(frequency, F.col("word") == F.col("counted"))
        .groupBy("phrase", "length")
        .agg(F.sort_array(F.collect_list(F.struct("n", "off", "word"))).alias("plan"))
        .where(F.size("plan") == F.col("length"))  # a phrase with a term that has no postings is nowhere
    )
    plans = written(plans)
    first = plans.select("phrase", "length", "plan", F.col("plan")[0]["word"].alias("term"), F.col("plan")[0]["off"].alias("off"))
    found = (
        posted.join(first, "term")
        .select("row", (F.col("place") - F.col("off")).alias("start"), "phrase", "length", "plan")
        .where((F.col("start") >= 0) if slop == 0 else F.lit(True))
    )

    def wanted(part: Column) -> list[Column]:
        at = F.col("start") + part["off"]
        near = F.array(*[at + d for d in range(-slop, slop + 1)])
        return [part["word"].alias("want"), near.alias("near")]

    there = posted.select(F.col("row").alias("in_row"), F.col("term").alias("is"), F.col("place").alias("at"))
    meets = (F.col("row") == F.col("in_row")) & (F.col("want") == F.col("is")) & (F.col("near_at") == F.col("at"))
    two = found.where(F.size("plan") > 1).select("*", *wanted(F.col("plan")[1]))
    two = two.withColumn("near_at", F.explode("near")).join(there, meets, "left_semi")
    two = two.select("row", "start", "phrase", "length", "plan").distinct() if slop else two
    rest = two.where(F.size("plan") > 2).withColumn("part", F.explode(F.slice("plan", 3, 1 << 30)))
    rest = rest.select("row", "start", "phrase", "length", "part.off", *wanted(F.col("part")))
    rest = rest.withColumn("near_at", F.explode("near")).join(there, meets, "left_semi")
    whole = (
        rest.groupBy("row", "start", "phrase", "length")
        .agg((F.count_distinct("off") if slop else F.count("*")).alias("met"))
        .where(F.col("met") == F.col("length") - 2)
    )
    columns = ["row", "start", "phrase", "length"]
    short = two.where(F.size("plan") == 2).select(*columns).unionByName(found.where(F.size("plan") == 1).select(*columns))
    return whole.select(*columns).unionByName(short)


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a phrase), items (ids as sorted strings) of every row."""
    by_item = written(phrases(benchmark, length))
    shortest = by_item.agg(F.min(F.size("words"))).first()[0] or length
    vocabulary = by_item.select(F.explode("words").alias("term"))
    indexed = written(index(docs, vocabulary, shortest))
    found = written(matches(postings(indexed), by_item.select("phrase", "words").distinct()))
    spans = found.groupBy("row", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = end - F.greatest(F.col("start"), F.least(end, F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = spans.withColumn("new", new).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    ids = by_item.select("item_id", F.col("phrase").alias("of"))
    items = (
        found.join(ids, F.col("phrase") == F.col("of"))
        .select("row", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    return (
        indexed.select("row", "doc_id", "n_words")
        .join(hits.join(items, "row"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
