"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document and leaves one bit in ``failures``
beside the measurements it used. A policy is a named, versioned mask over those
bits, so trying another policy, or leaving a rule out, never reads a text again:
both work on the histogram of bit masks, which has at most 2^rules rows.

Only built-in functions are used. All measurements of a text are taken inside its
row, so nothing is shuffled, and a very long text is one sorted array at most.

Null texts count as empty and fail ``few_words``; null ids and repeated rows are
kept as they are, one row in, one row out. An empty table gives an empty ledger.
Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, words

SYMBOLS = r"[#*$%&|<>]"
GRAM = 5

#: Rule name -> condition of failure over the measurements. The place is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > 0.25 * n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines",
    "exclamations": "n_exclamations > 0.5 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document under this name and version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


STANDARD = Policy("standard", 1, tuple(RULES))
LENIENT = Policy("lenient", 1, ("few_words", "repeated_words"))


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _grams(w: Column) -> Column:
    """A 64-bit hash of each run of five words, by place."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)])
    )
    return F.when(F.size(w) >= GRAM, hashed).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """Words inside runs whose hash is found twice: runs sorted by hash, neighbours compared."""

    def of_sorted(s: Column) -> Column:
        def equals(e: Column, at: Column) -> Column:
            return F.coalesce(e["h"] == F.get(s, at)["h"], F.lit(False))

        twin = F.filter(s, lambda e, j: equals(e, j + 1) | equals(e, j - 1))
        return let(
            F.sort_array(F.transform(twin, lambda e: e["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(GRAM)), F.lit(GRAM))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(placed, of_sorted))


def _measurements(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            let(_grams(w), _covered).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        _removed(text, SYMBOLS).cast("long").alias("n_symbols"),
        _removed(text, "!").cast("long").alias("n_exclamations"),
    )


def _failures() -> Column:
    bits = (F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items())
    return sum(bits, F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements of each whole text, and ``failures``, one bit for each failed rule."""
    measured = docs.select("doc_id", F.inline(F.array(_measurements(F.col("text")))))
    return measured.select("doc_id", "w.*", "l.*", "n_symbols", "n_exclamations").withColumn("failures", _failures())


def judged(ledger_rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy; the base rules always hold."""
    fails = F.col("failures")
    return ledger_rows.withColumns(
        {
            "base_failed": fails.bitwiseAND(F.lit(BASE)) != 0,
            "kept": fails.bitwiseAND(F.lit(BASE | policy.mask)) == 0,
        }
    )


def ablations(ledger_rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """For each rule of a policy: documents it rejects, and those that only it rejects.

    Works on counts per distinct mask, so its input is at most 2^rules rows.
    """
    masks = ledger_rows.groupBy("failures").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules])
    hit = masks.withColumn("seen", F.col("failures").bitwiseAND(F.lit(policy.mask))).select("seen", "n", F.inline(rules))
    return hit.groupBy("rule").agg(
        F.sum(F.when(F.col("seen").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("rejects"),
        F.sum(F.when(F.col("seen") == F.col("bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
    )


def passing(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a policy keeps."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.inline(F.array(_measurements(F.col("text")))))
    kept = whole.select("row", "w.*", "l.*", "n_symbols", "n_exclamations").withColumn("failures", _failures())
    return judged(kept, policy).where("kept").select("row.*")
