"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrunner.session import configure

# Rows handed to Python at once; texts can be very long.
BATCH_ROWS = 256
# The same where most rows are short, and the bytes at which a batch ends.
BATCH_SHORT_ROWS = 16_384
BATCH_BYTES = 1 << 22


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the options the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def prepared_for_rows(spark: SparkSession) -> SparkSession:
    """Like ``prepared``, for many short rows beside long texts: batches are bounded by bytes."""
    prepared(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_SHORT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone (null text: empty), whatever else ``docs`` has."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out of training."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def held_out(id_col: Column) -> Column:
    """Rows kept out of training; a null id is never trained on either."""
    return F.coalesce(remainder(id_col) == 2, F.lit(True))


def share(id_col: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and the salt alone."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"/{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def spare(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name
