"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import shared_folder

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: For rows of up to some MB. By default a page of a column is measured after 100 rows, and a page and the row group are what
#: a reader holds at once.
WIDE_ROWS = {
    "parquet.block.size": 4 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.block.size.row.check.max": 16,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 16,
}


def staged(rows: DataFrame, name: str, **options: int) -> DataFrame:
    """The rows, written once to the folder all executors share and read again.

    Later steps read them instead of computing them anew, and a lost executor costs
    only its running tasks. The folder belongs to the run: whoever names it in
    ``spark.checkpoint.dir`` removes it when the run is over.
    """
    path = shared_folder(rows.sparkSession, name)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.parquet(path)


def in_small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in Arrow batches of 8 MB from here on, not of 64: wide rows, as whole texts are, fill these, and
    the JVM, outside of its heap, and the worker hold one for each core."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(docs[column], F.lit(""))


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 marks the held-out rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only, so that every engine gives the same."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_text(column: Column) -> Column:
    """A text key that is never null, with null apart from every text."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def total(values: Column, kind: str = "long") -> Column:
    """The sum of an array."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, x: s + x)
