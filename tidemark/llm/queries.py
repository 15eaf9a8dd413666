"""The text operators as named queries, and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    classifier, collocations, decontaminate, html_main, mixing, packing, periodic, pii, ppm, quality_rules, simhash,
    substring, suffix,
)
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_exclamations", "failures",
    )


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


def _joined(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _of_kind(spans: str, kind: int) -> Column:
    """How many spans are of a kind."""
    # one parameter only: Spark hands a second one the place in the array
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_all(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_of_kind("base", k).alias(f"n_{pii.KINDS[k]}") for k in range(4)], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(table(spark, sf_dir, "documents"), digest=True)
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").cast("string").alias("kept_sha256")
    )


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), order=ppm.ORDER)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("words", "k")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find(periodic.planted(table(spark, sf_dir, "documents")), digest=True)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_decontaminate, op3_mixing, op4_classifier, op5_html_main, op6_quality_rules, op7_substring,
        op8_pii, op9_suffix, op10_ppm, op11_packing, op12_collocations, op13_periodic,
    )
}

OP3_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5(key || chr(31) || (row_number() OVER (PARTITION BY key) - 1)), 1, 15))::BIGINT AS h
  FROM (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || chr(31) || md5(coalesce(text, ''))) AS key FROM documents)),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM s GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source) AS k FROM src),
prefix AS (
  SELECT *, (SELECT sum(source_size) FROM src) AS total,
         coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY k DESC) AS open_w
  FROM ordered),
cut AS (
  SELECT *, (1.5 * total::DOUBLE - 2.0 * below::DOUBLE) * w / open_w::DOUBLE AS level FROM prefix),
first_open AS (
  SELECT min(k) AS k FROM cut WHERE 2.0 * source_size > level),
goal AS (
  SELECT p.source, p.source_size,
         CASE WHEN f.k IS NULL OR p.k < f.k THEN p.source_size * 2.0::DOUBLE
              ELSE (1.5 * p.total::DOUBLE - 2.0 * o.below::DOUBLE) * p.w / o.open_w::DOUBLE END AS target
  FROM prefix p, first_open f LEFT JOIN prefix o ON o.k = f.k),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goal),
filled AS (
  SELECT s.*, p.source_size, p.target, p.passes,
         sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (passes + CASE WHEN upto <= target - passes * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM filled
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
g AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
  FROM w WHERE len(w) >= 5),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (
  SELECT r, sum(least(5, nxt - i))::BIGINT AS n
  FROM (SELECT r, i, lead(i, 1, i + 5) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN covered c USING (r)),
f AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
            + 4 * (n_symbols > 0.25 * n_words)::BIGINT
            + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines)::BIGINT
            + 16 * (n_exclamations > 0.5 * n_words)::BIGINT
            + 32 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT AS failures
  FROM m)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f
"""

OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase
  FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM d, lengths WHERE len(w) >= n),
m AS (SELECT DISTINCT r, i, g.n, item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM m) GROUP BY r),
ids AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w, range(1, 6) t(k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.k, c.a, n.n, i, l.f AS l, r.f AS r,
         ((1000 * c.a::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN n USING (lang)
  JOIN g l ON l.lang = c.lang AND l.k = c.i AND l.phrase = array_to_string(c.p[1:c.i], ' ')
  JOIN g r ON r.lang = c.lang AND r.k = c.k - c.i AND r.phrase = array_to_string(c.p[c.i + 1:c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
alone AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = b.lang AND x.k > b.k AND 100 * x.a >= 100 * b.a
                    AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alone QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL, "op3_mixing": OP3_SQL, "op6_quality_rules": OP6_SQL, "op12_collocations": OP12_SQL,
}
