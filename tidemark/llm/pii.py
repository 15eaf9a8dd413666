"""Personal data: direct identifiers by pattern, and the terms that give them away.

Patterns find emails, addresses, cards and phone numbers. Around each of them the
neighbouring words are noted; over the whole corpus that says how strongly a term
points to one entity. A term t discloses entity e if

* t stands near e in at least ``support`` different surroundings (copies of a
  passage count once),
* P(e | t), the documents with t near e over the documents with t, is at least
  ``posterior``; documents of one text count as one, here and in all counts below,
* the pointwise mutual information log2(P(e | t) / P(e)) is at least ``bits``.

Every occurrence of such a term becomes a span of kind ``term``. Spans are removed or
generalised to a placeholder of their kind.

Candidate terms travel as a bitmap of fixed size and are compared themselves
afterwards. Pairs of term and document are made distinct by both and then counted in
every task, so a term or an entity in a third of all documents is in no task alone.

Null texts count as empty. A row is known by the hash of its id and text, so repeated
rows share their spans and are all returned; an empty table gives an empty result and
columns besides doc_id and text are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Known, term_set, written

# An address is looked for from its @: a run of characters without one costs nothing.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Kinds in the order of the contract; ``term`` is what the method adds.
KINDS = ("email", "ip", "card", "phone", "term")
AROUND = 5
SUPPORT, POSTERIOR, BITS = 3, 0.5, 4.0


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int, int]]:
    """The leftmost addresses that do not overlap: before each @ as much as is left of its run."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at][::-1]
        local = LOCAL.match(before).end()
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            found.append((at - local, 0, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255, however long it is."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the direct identifiers, in order."""
    found = []
    if "@" in text:
        found += _emails(text)
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _surroundings(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, bool]]:
    """(entity, term, surroundings, whole) for the words near each span that are in no span.

    Not whole: the term is only a piece of a word here, cut by a span or at the edge.
    """
    found = []
    all_words = set(WORD.findall(text)) if spans else set()
    for start, kind, end in spans:
        value = text[start:end].lower()
        entity = KINDS[kind] + ":" + (value if kind < 2 else _digits(value))
        left = [m[0] for m in WORD.finditer(text, max(0, start - 200), start)][-AROUND:]
        right = [m[0] for m in WORD.finditer(text, end, min(len(text), end + 200))][:AROUND]
        near = [w for w in left + right if w[0].isalpha() and not any(c.isdigit() or c == "@" for c in w)]
        mark = xxhash.xxh64_intdigest(" ".join(left + right).encode()) >> 1
        found += [(entity, t, mark, t in all_words) for t in dict.fromkeys(near)]
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("k"), F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("doc"))


def scan(docs: DataFrame) -> DataFrame:
    """k, doc_id, doc (hash of the text), spans (start, kind, end) by pattern, near (entity, term, mark, whole) of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("mark", pa.int64()), ("whole", pa.bool_())]))
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            spans = [base_spans(t) for t in texts]
            around = [_surroundings(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    b.column(3),
                    pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in spans], span),
                    pa.array([[dict(zip(("entity", "term", "mark", "whole"), s)) for s in x] for x in around], near),
                ],
                ["k", "doc_id", "doc", "spans", "near"],
            )

    schema = (
        "k long, doc_id long, doc long, spans array<struct<start:int,kind:int,end:int>>,"
        " near array<struct<entity:string,term:string,mark:long,whole:boolean>>"
    )
    return _keyed(docs).mapInArrow(find, schema)


#: Places of the table that tells a task how often a term may occur.
PLACES = 1 << 16


def _most(pairs: DataFrame, posterior: float) -> np.ndarray:
    """Per place of a term's hash: in how many documents it can be at most and still disclose an entity.

    The posterior is n_with / n_docs, so n_docs may be n_with / posterior. At most 2^16 rows
    come to the driver; terms that share a place share the larger number.
    """
    place = F.xxhash64("term").bitwiseAND(F.lit(PLACES - 1))
    found = np.zeros(PLACES, np.int64)
    for at, n in pairs.groupBy(place.alias("at")).agg(F.max("n_with")).collect():
        found[at] = int(n / posterior)
    return found


def documents_with(docs: DataFrame, pairs: DataFrame, posterior: float) -> DataFrame:
    """term, doc for the terms of ``pairs``, over all documents; equal texts once.

    A task stops naming documents of a term once they are more than any of its entities
    allows: the term is out then, however many others there are.
    """
    terms = pairs.select("term").distinct()
    spark = docs.sparkSession.sparkContext
    bits, most = spark.broadcast(term_set(terms)), spark.broadcast(_most(pairs, posterior))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, allowed = Known(bits.value), most.value
        named: dict[bytes, set[int]] = {}
        for b in batches:
            seen = dict(zip(b.column(1).to_pylist(), b.column(0).to_pylist()))
            out: list[tuple[bytes, int]] = []
            for doc, text in seen.items():
                for w in set((text or b"").split()):
                    if known[w]:
                        own = named.setdefault(w, set())
                        if doc not in own and len(own) <= allowed[xxhash.xxh64_intdigest(w, 42) & (PLACES - 1)]:
                            own.add(doc)
                            out.append((w, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in out], pa.binary()).cast(pa.string()), pa.array([d for _, d in out], pa.int64())], ["t", "doc"]
            )

    found = docs.select(F.col("text").cast("binary"), F.xxhash64("text").alias("doc")).mapInArrow(find, "t string, doc long")
    wanted = terms.select(F.col("term").alias("wanted"))
    return found.join(wanted, F.col("t") == F.col("wanted"), "left_semi").select(F.col("t").alias("term"), "doc").distinct()


def disclosing(
    docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, posterior: float = POSTERIOR, bits: float = BITS
) -> DataFrame:
    """entity, term, n_near, n_with, n_docs, posterior, bits of the pairs beyond the thresholds.

    n_near: surroundings of the term at the entity; n_with: documents with them; n_docs:
    documents with the term, exact for the pairs that are returned.
    """
    near = scanned.select("doc", F.inline("near")).distinct()
    marks = near.select("entity", "term", "mark").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_near"))
    marks = marks.where(F.col("n_near") >= support)
    together = near.select("entity", "term", "doc").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_with"))
    pairs = written(marks.join(together, ["entity", "term"]))
    entities = near.select("entity", "doc").distinct().groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("n_entity"))
    wanted = pairs.select("term").distinct()
    pieces = near.where(~F.col("whole")).select("term", "doc").join(wanted, "term", "left_semi")
    holding = documents_with(docs, pairs, posterior).unionByName(pieces).distinct()
    counts = holding.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("n_docs"))
    total = scanned.select("doc").distinct().count()
    p = F.col("n_with") / F.col("n_docs")
    return (
        pairs.join(counts, F.col("term") == F.col("t"))
        .join(entities, F.col("entity") == F.col("e"))
        .withColumn("posterior", p)
        .withColumn("bits", F.log2(F.col("posterior") * total / F.col("n_entity")))
        .where((F.col("posterior") >= posterior) & (F.col("bits") >= bits))
        .select("entity", "term", "n_near", "n_with", "n_docs", "posterior", "bits")
    )


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """k, start, end of every occurrence of the terms of a one-column table; equal rows once."""
    bits = docs.sparkSession.sparkContext.broadcast(term_set(terms))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(bits.value)
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if text and any(map(known.__getitem__, set(text.encode().split()))):
                    out += [(k, m.start(), m.end(), m[0]) for m in WORD.finditer(text) if known[m[0].encode()]]
            columns = list(zip(*out)) or [[], [], [], []]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k", "start", "end", "term"])

    (name,) = terms.columns
    seen = _keyed(docs).mapInArrow(find, "k long, start int, end int, term string")
    wanted = terms.distinct().withColumnRenamed(name, "wanted")
    return seen.join(wanted, F.col("term") == F.col("wanted"), "left_semi").select("k", "start", "end").distinct()


def find_all(docs: DataFrame, **thresholds: float) -> DataFrame:
    """k, doc_id, base (spans by pattern) and spans (with the method's), each in order."""
    scanned = written(scan(docs))
    terms = written(disclosing(docs, scanned, **thresholds).select("term").distinct())
    kind = KINDS.index("term")
    added = (
        term_spans(docs, terms)
        .groupBy(F.col("k").alias("of"))
        .agg(F.collect_list(F.struct("start", F.lit(kind).alias("kind"), "end")).alias("added"))
    )
    return scanned.join(added, F.col("k") == F.col("of"), "left").select(
        "k",
        "doc_id",
        F.col("spans").alias("base"),
        F.when(F.col("added").isNull(), F.col("spans"))
        .otherwise(F.sort_array(F.array_union("spans", "added")))
        .alias("spans"),
    )


def redact(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` with every span generalised to ``<KIND>``; all columns stay, ``n_chars`` follows the text.

    Rows without spans are not changed; a null text stays null.
    """
    spans = find_all(docs, **thresholds).where(F.size("spans") > 0).select(F.col("k").alias("_k"), F.col("spans").alias("_s"))
    spans = written(spans.dropDuplicates(["_k"]))
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    hit = keyed.join(spans, F.col("_key") == F.col("_k"), "left")

    @F.pandas_udf("string")
    def without(texts, all_spans):
        out = []
        for text, some in zip(texts, all_spans):
            parts, at = [], 0
            for s in some if text is not None and some is not None else ():
                if s["end"] > at:
                    parts += [text[at : max(at, s["start"])], f"<{KINDS[s['kind']].upper()}>"]
                    at = s["end"]
            out.append(text if text is None else "".join(parts) + text[at:])
        return texts.__class__(out, dtype=object)

    new = hit.withColumn("text", without("text", "_s"))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new = new.withColumn("n_chars", F.when(F.col("_k").isNull(), F.col("n_chars")).otherwise(length))
    return new.select(*docs.columns)
