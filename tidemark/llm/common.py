"""Helpers that the text operators share: words, written tables, loading in queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the ASCII kinds alone, as ``bytes.split()`` has them.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether a document is set aside, by the checksum of its id; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; any other raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of an action with its end, instead of some time later.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of a batch that a task hands to Python, besides the number of its rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a table of its own in the shared folder: computed once, lineage cut.

    What was shuffled for it is of no more use then and is removed, or else the shuffles of
    every round of a loop would stay on disk until the driver collects garbage. With
    ``batch_bytes``, the batches of its Arrow steps have a bound in bytes, so what tasks hold
    of them outside the heap does not follow the length of texts.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    settings = {CLEAN_UP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a term set: 2 MB whatever the number of terms.
SET_BITS = 24


def term_set(terms: DataFrame, hashed: bool = False) -> bytes:
    """The terms of a one-column table as a bitmap over their hashes.

    ``hashed``: the terms are hashes themselves, and their own low bits count.

    The size is fixed (2^24 bits, brought to the driver in at most 512 pieces of 4 KB),
    so it may be broadcast whatever the table holds. A fuller set only lets more terms
    through; who uses it compares the terms themselves afterwards.
    """
    (name,) = terms.columns
    own = F.col(name) if hashed else F.xxhash64(name)
    place = own.bitwiseAND(F.lit((1 << SET_BITS) - 1)) + 1
    pieces = (
        terms.where(F.col(name).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("n"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    )
    found = bytearray(1 << (SET_BITS - 3))
    for n, bits in pieces.collect():
        at = (n - 1) * len(bits)
        found[at : at + len(bits)] = bits
    return bytes(found)


class Known(dict):
    """word -> whether it may be in a term set; answers are kept for the common words."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: bytes) -> bool:
        place = xxhash.xxh64_intdigest(word, 42) & ((1 << SET_BITS) - 1)
        answer = bool(self.bits[place >> 3] >> (place & 7) & 1)
        if len(self) > 300_000:
            self.clear()
        self[word] = answer
        return answer
