"""Mixing sources to target weights by nested hash thresholds.

A source's documents get a fixed hash each. Whole passes over the source are taken
first; of the rest, the mix takes the documents whose hash lies under a threshold.
The threshold comes from histograms: words are summed by (source, hash bucket), the
bucket where the budget runs out is found, and only that bucket is divided again by
the next bits of the hash. Nothing is sorted and every document is judged by itself
against its source's threshold, so a source with a third of all rows is spread over
all tasks like any other.

A larger budget always has a larger threshold, so mixes of growing budgets nest.

Null text has size 0, a null source is a source of its own and comes last. Null and
repeated ids are told apart by their text and, where that is equal too, by number. A
repeated row is counted as often as it appears.
An empty table gives an empty mix; columns besides doc_id, text, source are ignored unless
they are to be kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2.0
#: Hash bits refined at each level, of 60 in all.
LEVEL_BITS = 12
HASH_BITS = 60
#: The columns of a mix; a document's own columns of these names are not kept beside them.
COLUMNS = ("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def _keyed(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size in words, key and part of every row, with the columns to keep as a struct ``kept``."""
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    return docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"),
        F.spark_partition_id().alias("part"), *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    )


def _offsets(pieces: DataFrame) -> DataFrame:
    """key, part and the rows of the key in the parts before."""
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(pieces.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))


def _numbered(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy("key")) - 1
    return rows.join(offsets, ["key", "part"]).withColumn("number", F.col("offset") + within).drop("offset")


def _hashed(alone: DataFrame, numbered: DataFrame) -> DataFrame:
    rows = alone.withColumn("number", F.lit(0).cast("long")).unionByName(numbered)
    own = F.md5(F.concat_ws("\x1f", "key", F.col("number").cast("string")))
    return rows.withColumn("hash", F.conv(F.substring(own, 1, 15), 16, 10).cast("long")).drop("key", "part", "number")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the row's hash of 60 bits.

    The hash is of the id and the text, so neither null nor repeated ids stand or fall
    together. Rows equal in both are numbered, and the number is hashed with them: which
    of them has which number makes no difference. A group of equal rows is numbered piece
    by piece, as the input's partitions hold it.
    """
    rows = written(_keyed(docs))
    pieces = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    several = pieces.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).where("n > 1").select("key")
    offsets = _offsets(pieces.join(several, "key", "left_semi"))
    return _hashed(rows.join(offsets, ["key", "part"], "left_anti"), _numbered(rows, offsets))


def sized_beside(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """As ``sized``, with the columns to keep as a struct ``kept``.

    Whole texts would be written with them, so a row without an equal is read anew from
    ``docs`` wherever it is used, and only equal rows are stored with their number.
    """
    rows = _keyed(docs, keep)
    several = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    same = written(rows.join(several, "key", "left_semi"))
    numbered = written(_numbered(same, _offsets(same.groupBy("key", "part").agg(F.count("*").alias("n")))))
    return _hashed(rows.join(several, "key", "left_anti"), numbered)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources with their size and their place by code point, null last.

    Places come from a range-partitioned sort: the rows of lower partitions plus the
    place within the partition.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    low = (1 << 33) - 1
    placed = written(
        per_source.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        placed.withColumn("part", part)
        .join(offsets, "part")
        .select("source", "source_size", (F.col("offset") + F.col("at").bitwiseAND(F.lit(low))).alias("place"))
    )


def targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """Adds ``target``: the share of all words by weight, at most ``most`` times a source's size.

    What goes beyond a limit is shared again by weight among the sources under theirs.
    Each round is one sum over the sources; the limited set only grows.
    """
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    rows = written(sources.withColumn("weight", weight.cast("long")))
    limit = F.col("source_size") * F.lit(float(most))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    wanted = share * total
    spent, open_weight, limited = 0.0, rows.agg(F.sum("weight")).first()[0] or 1, 0
    while True:
        level = F.lit(wanted - spent) * F.col("weight") / F.lit(float(open_weight))
        over = rows.where(limit <= level)
        n, fixed, held = over.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if n == limited:
            break
        limited, spent = n, most * (fixed or 0)
        open_weight = (rows.agg(F.sum("weight")).first()[0] or 0) - (held or 0)
        if open_weight == 0:
            return rows.withColumn("target", limit)
    return rows.withColumn("target", F.when(limit <= level, limit).otherwise(level))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: documents with a hash below it fill the source's budget.

    ``sizes``: source, size, hash; ``budgets``: source, budget. At each level the words
    are summed by source and the next bits of the hash, within the boundary bucket of the
    level before; the buckets that still fit are taken whole. The document at the boundary
    stays out.
    """
    state = budgets.select(F.col("source").alias("of"), "budget", F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        live = state if shift == HASH_BITS - LEVEL_BITS else written(state)
        inside = sizes.join(
            live,
            F.col("source").eqNullSafe(F.col("of"))
            & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")),
        )
        histogram = inside.groupBy("of", "budget", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        filled = histogram.withColumn("upto", F.sum("n").over(running))
        edge = (
            filled.where(F.col("upto") > F.col("budget"))
            .groupBy(F.col("of").alias("edge_of"))
            .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("used")), "bucket").alias("e"))
        )
        # Where every bucket fits, the threshold lies just past the last one.
        state = live.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left").select(
            "of",
            (F.col("budget") - F.coalesce(F.col("e.used"), F.lit(0))).alias("budget"),
            F.coalesce(F.col("e.bucket"), F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).alias("prefix"),
        )
    return state.select(F.col("of").alias("source"), F.col("prefix").alias("threshold"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_REPEATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and taken of every document, and its columns to keep."""
    rows = sized_beside(docs, keep) if keep else written(sized(docs))
    sizes = written(rows.drop("kept")) if keep else rows
    goals = written(targets(ranked_sources(sizes), weights, share, most))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("passes", passes)
    budgets = goals.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
    limits = written(thresholds(sizes, budgets)).withColumnRenamed("source", "limit_of")
    plan = goals.join(limits, F.col("source").eqNullSafe(F.col("limit_of"))).select(
        F.col("source").alias("of"), "source_size", "target", "passes", "threshold"
    )
    if keep:
        plan = written(plan)  # its size is known then, so a small one is broadcast and no text is shuffled
    repeats = F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("repeats", F.when(F.col("size") > 0, repeats).otherwise(F.least(repeats, F.lit(1))))
        .withColumn("taken", F.col("repeats") * F.col("size"))
        .select(*COLUMNS, *(["kept.*"] if keep else []))
    )
