"""Artifacts against their receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def verify(artifacts: DataFrame, receipts: DataFrame) -> DataFrame:
    """(source_id, reason): the first of missing_file, missing_receipt, sha256, byte_count, downloaded_at that fails, else ok."""
    a = artifacts.select("source_id", F.sha2("content", 256).alias("own_sha"), F.length("content").alias("own_bytes"))
    both = a.join(receipts, "source_id", "full_outer")
    reason = (
        F.when(F.col("own_sha").isNull(), "missing_file").when(F.col("sha256").isNull(), "missing_receipt").when(F.lower("sha256") != F.col("own_sha"), "sha256")
        .when(F.coalesce("byte_count", F.lit(-1)) != F.col("own_bytes"), "byte_count").when(~T.is_zoned_timestamp(F.col("downloaded_at")), "downloaded_at").otherwise("ok")
    )
    return both.select("source_id", reason.alias("reason"))
