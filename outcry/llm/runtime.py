"""Session preparation and small shared helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir, ensure_utc, materialize, scratch_path, ship_package

__all__ = ["prepare", "table", "materialize", "scratch_path", "text_or_empty", "WORD_GAP"]

#: Everything between two words: words are runs of letters, digits and marks.
WORD_GAP = r"[^\p{L}\p{N}\p{M}]+"


def prepare(spark: SparkSession) -> None:
    """UTC, the shared checkpoint folder, the package on the executors, and
    Arrow batches of bounded row count and size (texts can be long; one that is
    longer is a batch of its own).  Results are lazy, so the settings stay."""
    ensure_utc(spark)
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text):
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
