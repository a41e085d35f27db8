"""Exact duplicates by progressive refinement: by length, then by the hash of a prefix, then by the full hash.

A first pass takes the bytes and the prefix hash of every text. Only where a length occurs twice its prefixes are
counted, and only where length and prefix occur twice a text is hashed in full. What survives a level is told to the
next pass as a bitmap of fixed size; two keys on one bit cost a needless hash and change no result. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Code points of the prefix.
PREFIX = 64
#: Bits of the bitmaps between levels: 1 MB, whatever the number of keys.
FILTER_BITS = 1 << 23
#: A group that holds more than this part of all rows is joined by broadcast; fewer than so many such groups can exist.
LARGE_PART = 1000


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """(part, bits) with the bits of all keys set; FILTER_BITS / 32768 rows of 4 KB at most."""
    x = F.pmod(key, F.lit(FILTER_BITS)) + 1
    rows = keys.select(F.bitmap_bucket_number(x).alias("part"), F.bitmap_bit_position(x).alias("bit"))
    return rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def marked(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """rows with the boolean column name: whether the bitmap may hold the key. The bitmap's fixed size is broadcast."""
    x = F.pmod(key, F.lit(FILTER_BITS)) + 1
    rows = rows.withColumns({"__part": F.bitmap_bucket_number(x), "__bit": F.bitmap_bit_position(x)})
    both = rows.join(F.broadcast(bits.select(F.col("part").alias("__its"), F.col("bits").alias("__bits"))), F.col("__part") == F.col("__its"), "left")
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return both.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__part", "__bit", "__its", "__bits")


def length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def prefix_key(text: Column) -> Column:
    return F.xxhash64(length(text), F.substring(text, 1, PREFIX))


def surviving(docs: DataFrame) -> DataFrame:
    """The bitmap of (length, prefix) keys that two rows or more have; docs: a column text without nulls."""
    rows = checkpoint(docs.select(length(F.col("text")).alias("len"), prefix_key(F.col("text")).alias("prefix")))
    lengths = rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1")
    rows = marked(rows, F.col("len"), bitmap(lengths, F.col("len")), "shared").where("shared")
    prefixes = rows.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    return bitmap(prefixes, F.col("prefix"))


def refined(docs: DataFrame) -> DataFrame:
    """docs with full, the SHA-256 of the text (32 bytes) where another row's length and prefix are the same; else null.

    docs: a column text without nulls. Rows without full have a text that no other row has.
    """
    rows = marked(docs, prefix_key(F.col("text")), checkpoint(surviving(docs)), "__asked")
    return rows.withColumn("full", F.when(F.col("__asked"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))).drop("__asked")


def beside(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined with groups, which have one row a key and its number of rows in the column size.

    Keys are hashes of 32 bytes. Groups of more than a LARGE_PART of all rows are joined by broadcast, fewer than LARGE_PART by count. All others
    meet by shuffle, where the rest of the rows has a random short key that no group has, so that no task gets a large group.
    rows is read more than once and should be checkpointed; its key may be null.
    """
    total = rows.count()
    names = [c for c in groups.columns if c != key]
    large = groups.where(F.col(size) * LARGE_PART > total).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__l_{c}") for c in names])
    small = groups.where(F.col(size) * LARGE_PART <= total).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__s_{c}") for c in names])
    first = rows.join(F.broadcast(large), F.col(key) == F.col("__key"), "left").drop("__key")
    open_ = F.col(f"__l_{size}").isNull() & F.col(key).isNotNull()
    first = first.withColumn("__open", F.when(open_, F.col(key)).otherwise(F.encode(F.rand(7).cast("string"), "UTF-8")))
    both = first.join(small, F.col("__open") == F.col("__key"), "left")
    return both.select(*rows.columns, *[F.coalesce(f"__l_{c}", f"__s_{c}").alias(c) for c in names])


def deduplicated(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) for each row of docs (doc_id, text), kept for one row of equal texts.

    digest: with text_sha256 of every text, also of those that need no full hash to be told apart. The row with the
    largest doc_id stays; a null doc_id is less than any other, and of rows that repeat the largest one stays.
    Null texts count as empty. A row without an equal keeps itself. An empty table gives no row.
    """
    rows = refined(docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")))
    sha = [F.lower(F.hex(F.coalesce("full", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))))).alias("text_sha256")] if digest else []
    rows = checkpoint(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "full", *sha))
    groups = rows.where("full is not null").groupBy("full").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1")
    got = beside(rows, groups.select("full", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row"), "n"), "full", "n")
    alone = F.col("n").isNull()
    return got.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        *(["text_sha256"] if digest else []),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: doc_id, keep_id, group_size, kept, text_sha256. For nulls, ties and repeated rows
    see deduplicated().
    """
    return deduplicated(table(spark, sf_dir, "documents"), digest=True)


ORACLE_SQL = {
    "op11_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
             row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM d WINDOW w AS (PARTITION BY t))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, kept, sha256(t) AS text_sha256 FROM r
""",
}
QUERIES = {"op11_exact_dedup": op11_exact_dedup}
