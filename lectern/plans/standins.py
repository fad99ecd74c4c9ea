"""Inputs derived from the driver tables.

The reference works on two small books, vectors from a sentence encoder and
a feedback store.  The driver ships generic tables instead, so each input is
derived from them with Spark, in a way that grows with the tables:

* books: ``documents`` grouped by ``source`` and laid out as verse books;
* vectors: ``embeddings``;
* verse metadata: ``documents`` (labelled ones, so some hits have none);
* feedback: ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.scan import running_scan
from lectern.sources.tables import read_table

# Stand-in layout constants (our own test design, not reference values).
BOOK_FILE_PREFIX = "upanishads-"
PART_WORDS = ["First", "second", "THIRD", "Fourth", "fifth", "Sixth", "II", "vii"]
ROMANS_1_12 = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
VERSES_PER_PART = 12
CHANT_LINE = "peace CHANT"
NO_PARTS = "3"           # last character of sources whose books have no parts
NO_HEADERS = "src7"      # source whose book has no headers
DUPLICATE_ID_MODULUS = 120
RELEVANT_EVENTS = ("click", "purchase")


TABLE_KEYS = {
    "documents": "doc_id", "embeddings": "vec_id", "events": "event_id",
    "benchmark": "item_id", "conversations": "conv_id", "labels": "doc_id",
    "orders": "o_orderkey", "pages": "page_id",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A driver table.  ``spread`` is for tables whose scan is followed by
    CPU-heavy work before any shuffle (tokenising, hashing, distances): a
    single-row-group file would otherwise run that work in one task."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if not spread:
        return spark.read.parquet(path)
    return read_table(spark, path, TABLE_KEYS.get(name))


def book_file(source_col="source"):
    src = F.col(source_col)
    return F.concat(F.lit(BOOK_FILE_PREFIX),
                    F.when(F.length(src) % 2 == 0, F.upper(src)).otherwise(src),
                    F.lit(".txt"))


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` -> book lines ``(file, line_no, raw)``.

    One book per ``source``; documents in ``doc_id`` order, rank ``r`` from 0.
    A document's lines are those of its text that are not blank; all but the
    last are the verse, the last is commentary (with fewer than three lines all are the
    verse).  Each document becomes::

                                (blank)
           Part <word>          <- when r % 12 = 0; word by (r div 12) % 8
                                (blank)
        <header>                <- numeral or digits of r % 12 + 1; for r % 12 = 11 the chant
                                (blank)
          <verse lines, the first one with space before and after>
                                (blank, commentary line)

    Books whose source ends in 3 have no parts, the book of ``NO_HEADERS``
    has no headers at all (and so no verse).  A book ends without a blank line.
    """
    docs = (table(spark, sf_dir, "documents")
            .select("doc_id", "text", "source", book_file().alias("file")))
    headed = F.col("source") != NO_HEADERS
    parted = headed & ~F.col("source").endswith(NO_PARTS)
    # Lines before the optional part header: their number does not depend on the rank.
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: T.py_strip(x) != "")
    docs = docs.select("doc_id", "file", headed.alias("headed"), parted.alias("parted"), lines.alias("lines"))
    docs = docs.withColumn("_size", (F.size("lines") + F.when(F.col("headed"), 3).otherwise(1)
                                     + F.when(F.size("lines") >= 3, 1).otherwise(0)).cast("long"))
    # One running scan gives both the rank and the end offset: the part
    # headers before and at rank r add 2 lines each, (r div 12 + 1) of them.
    docs = running_scan(docs, ["file"], "doc_id",
                        sums={"_n": F.lit(1).cast("long"), "_end": F.col("_size")},
                        materialize=False)
    r = F.col("_n") - 1
    word = F.element_at(F.array(*[F.lit(w) for w in PART_WORDS]),
                        (F.floor(r / VERSES_PER_PART) % len(PART_WORDS) + 1).cast("int"))
    part_block = F.when(F.col("parted") & (r % VERSES_PER_PART == 0),
                        F.array(F.concat(F.lit("   Part "), word), F.lit(""))) \
        .otherwise(F.array().cast("array<string>"))
    number = r % VERSES_PER_PART + 1
    header = (F.when(number == VERSES_PER_PART, F.lit(CHANT_LINE))
              .when(F.floor(r / VERSES_PER_PART) % 2 == 0,
                    F.element_at(F.array(*[F.lit(x) for x in ROMANS_1_12]), number.cast("int")))
              .otherwise(number.cast("string")))
    header_block = F.when(F.col("headed"), F.array(header, F.lit(""))).otherwise(F.array().cast("array<string>"))
    verse = F.transform("lines", lambda x, i: F.when(i == 0, F.concat(F.lit("  "), x, F.lit(" \t"))).otherwise(x))
    verse = F.when(F.size("lines") < 3, verse).otherwise(
        F.concat(F.slice(verse, F.lit(1), F.size("lines") - 1), F.array(F.lit(""), F.element_at("lines", -1))))
    block = F.concat(F.array(F.lit("")), part_block, header_block, verse)
    end = F.col("_end") + F.when(F.col("parted"), 2 * (F.floor(r / VERSES_PER_PART) + 1)).otherwise(0)
    docs = docs.select("file", end.alias("_end"), block.alias("block"))
    return (docs.select("file", (F.col("_end") - F.size("block")).alias("_off"),
                        F.posexplode("block").alias("_pos", "raw"))
                .select("file", (F.col("_off") + F.col("_pos") + 1).cast("long").alias("line_no"),
                        "raw"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distance kernels run right after the scan.
    return table(spark, sf_dir, "embeddings", spread=True).select("vec_id", "embedding", "label")


def labelled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse metadata for the vector table: labelled documents by
    ``doc_id = vec_id``.  Unlabelled ids have no metadata (D6 drops them)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return (docs.join(labels, "doc_id", "left_semi")
                .select(F.col("doc_id").alias("vec_id"),
                        F.col("doc_id").cast("string").alias("verse_id"),
                        "text", "source"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as feedback records."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("fid"),
                     F.col("event_type").alias("query"),
                     F.col("user_id").cast("string").alias("verse_id"),
                     F.col("event_type").isin(*RELEVANT_EVENTS).alias("is_relevant"),
                     F.col("ts").alias("timestamp"))


def raw_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as untyped feedback requests, some of them malformed."""
    ev = table(spark, sf_dir, "events")
    broken = F.col("event_id") % 10 == 0
    flag = (F.when(broken, F.lit(None).cast("string"))
             .when(F.col("event_id") % 10 == 5, F.lit("maybe"))
             .otherwise(F.when(F.col("event_type").isin(*RELEVANT_EVENTS), "true")
                        .otherwise("false")))
    return ev.select(F.col("event_id").alias("fid"),
                     F.when(broken, F.lit(None).cast("string"))
                      .otherwise(F.col("event_type")).alias("query"),
                     F.col("user_id").cast("string").alias("verse_id"),
                     flag.alias("is_relevant"),
                     F.col("ts").alias("timestamp"))


def verses_with_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verse table whose ids repeat (``doc_id % 120``), so the first-match
    rule of the pair lookup matters; ``vec_id`` is the index position."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("vec_id"),
                       (F.col("doc_id") % DUPLICATE_ID_MODULUS).cast("string").alias("verse_id"),
                       "text")
