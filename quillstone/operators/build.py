"""Corpus builds: what each source of a manifest yields, staged writes that leave nothing stale behind, and traces of what filters and removal drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import remove_sources, write_chunks
from . import filters as P
from .retrieval import checked_broadcast

#: Statuses of pages whose text a reviewer must look at, and that hold none.
REVIEW, EMPTY = ("none", "insufficient"), "none"


def source_report(manifest: DataFrame, checks: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each source of the manifest (source_id, position, required), in its order by ``position``.

    checks (source_id, reason), pages (source_id, page_number, status), chunks (source_id, text). The first of these decides ``reason``: no artifact was checked, the check's own reason, no page has
    text, no chunk has text. A source without one has ``status`` succeeded; the counts of a failed one stand as found. Lists hold page numbers in order.
    """
    status = F.col("status")
    facts = pages.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(status == EMPTY).alias("empty_pages"), F.count_if(status == "ocr").alias("ocr_pages"),
        F.array_sort(F.collect_list(F.when(status.isin(*REVIEW), F.col("page_number")))).alias("scan_review"),
    )
    kept = chunks.groupBy("source_id").agg(F.count_if(F.trim("text") != "").alias("chunks"))
    rows = manifest.select("source_id", "position", "required").join(checks.select("source_id", "reason"), "source_id", "left").join(facts, "source_id", "left").join(kept, "source_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("pages", "empty_pages", "ocr_pages", "chunks")})
    reason = F.when(F.col("reason").isNull(), "not_checked").when(F.col("reason") != "ok", F.col("reason")).when(F.col("pages") == F.col("empty_pages"), "no_text").when(F.col("chunks") == 0, "no_chunks")
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "succeeded").otherwise("failed"))
    pages_to_review = F.coalesce("scan_review", F.array().cast("array<int>"))
    return rows.select("position", "source_id", "required", "status", "reason", "pages", "empty_pages", "ocr_pages", F.size(pages_to_review).cast("long").alias("scan_pages"), pages_to_review.alias("scan_review"), "chunks")


def build_summary(report: DataFrame) -> DataFrame:
    """One row: sources selected, succeeded, failed, and failed ones that are required."""
    failed = F.col("status") == "failed"
    return report.agg(F.count(F.lit(1)).alias("selected"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(failed & F.col("required")).alias("required_failures"))


def build(manifest: DataFrame, checks: DataFrame, pages: DataFrame, chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the chunks of sources that succeed, one folder a source, and returns ``source_report``.

    The output of every source of the manifest goes first, so a source that fails, or a job that breaks off, leaves no old output; sources outside the manifest stay. Files of
    a source appear when the write commits. The manifest is a reviewed list; its ids go to the driver.
    """
    spark = manifest.sparkSession
    report = source_report(manifest, checks, pages, chunks)
    remove_sources(spark, folder, [r.source_id for r in manifest.select("source_id").distinct().collect()])
    good = report.where("status = 'succeeded'").select("source_id")
    write_chunks(chunks.where(F.trim("text") != "").join(good, "source_id", "left_semi"), folder)
    return report


def with_source_metadata(chunks: DataFrame, manifest: DataFrame, receipts: DataFrame) -> DataFrame:
    """``chunks`` (source_id, ...) with the facts of their source: those of the manifest, of its receipt, and ``audit_status``, which is pending for all.

    A chunk of a source without a receipt has null receipt facts. Manifest and receipts have a row a source; the larger side is never moved if a count says that they are few.
    """
    facts = manifest.join(receipts, "source_id", "left").withColumn("audit_status", F.lit("pending"))
    return chunks.join(checked_broadcast(facts), "source_id")


def failing_filter(doc: dict[str, Column], wanted: dict[str, Column], on: Column, undated: Column, approved: Column) -> Column:
    """The first filter that a row fails, in this order: jurisdiction, language, status, act, document_type, profile, date; null if it passes all.

    A filter without a value lets all pass; a null value never meets one. ``approved`` are the profiles of the query; a row without a profile needs none.
    """
    out = F.lit(None).cast("string")
    inside = F.when(on.isNull(), True).otherwise(F.when(undated, P.in_force(doc["effective_from"], doc["effective_to"], on, True)).otherwise(P.in_force(doc["effective_from"], doc["effective_to"], on, False)))
    tests = [(c, wanted[c].isNull() | F.coalesce(F.lower(doc[c]) == F.lower(wanted[c]), F.lit(False))) for c in ("jurisdiction", "language", "status", "act", "document_type") if c in wanted]
    tests += [("profile", doc["profile"].isNull() | F.coalesce(F.array_contains(approved, doc["profile"]), F.lit(False))), ("date", inside)]
    for name, good in reversed(tests):
        out = F.when(~good, name).otherwise(out)
    return out


def exclusion_events(docs: DataFrame, filters: DataFrame, reason: Column, key: str = "doc_id") -> DataFrame:
    """(filter_id, doc_id, reason) of each row that a filter removes; queries with the same filters share one filter_id.

    Filters are the distinct ones of all queries, a short list; each document is tested against it as it is read, and nothing is shuffled.
    """
    return docs.join(F.broadcast(filters), F.lit(True)).select("filter_id", F.col(key).alias("doc_id"), reason.alias("reason")).where("reason is not null")


def dedup_events(removed: DataFrame) -> DataFrame:
    """(query_id, dropped, kept, reason) of the rows of ``overlap.greedy_dedup`` that were dropped."""
    return removed.where("kept_by is not null").select("query_id", F.col("doc_id").alias("dropped"), F.col("kept_by").alias("kept"), F.lit("overlapping_text").alias("reason"))


def trace_summary(queries: DataFrame, candidates: DataFrame, excluded: DataFrame, dropped: DataFrame, limit: int) -> DataFrame:
    """(query_id, candidates, excluded, deduplicated, underfilled) of each query, zeros too: underfilled queries keep fewer than ``limit`` candidates. Rows with a column ``n`` count for so many."""
    count = lambda rows, name: rows.groupBy("query_id").agg((F.sum("n") if "n" in rows.columns else F.count(F.lit(1))).alias(name))
    out = queries.select("query_id").distinct()
    for rows, name in ((candidates, "candidates"), (excluded, "excluded"), (dropped, "deduplicated")):
        out = out.join(count(rows, name), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out.withColumn("underfilled", F.col("candidates") - F.col("deduplicated") < limit)
