"""From texts to lines, pages and section chunks, as window functions over (source, page, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def pages(docs: DataFrame, key: str, text: str, separator: str = "\f") -> DataFrame:
    """(source, page_number from 1, text): a text split on form feeds."""
    return docs.select(F.col(key).alias("source"), F.posexplode(F.split(F.col(text), separator)).alias("pos", "text")).select("source", (F.col("pos") + 1).alias("page_number"), "text")


def sized_pages(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(source, page_number, text): pages of ``size`` characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    at = docs.select(F.col(key).alias("source"), F.col(text).alias("whole"), F.explode(F.sequence(F.lit(1), n)).alias("page_number"))
    return at.select("source", "page_number", F.substr("whole", (F.col("page_number") - 1) * size + 1, F.lit(size)).alias("text"))


def lines(paged: DataFrame) -> DataFrame:
    """(source, page_number, line_no, line): line_no runs from 0 over the whole source; a final line end starts no line."""
    parts = F.split("text", T.LINE_END)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = paged.select("source", "page_number", F.posexplode(parts).alias("pos", "line"))
    order = W.partitionBy("source").orderBy("page_number", "pos")
    return rows.select("source", "page_number", (F.row_number().over(order) - 1).alias("line_no"), "line")


def boundaries(rows: DataFrame, heading: str, contents: str, enacting: str, leader: str = r"\.{3,}\s*\d+\s*$") -> DataFrame:
    """Adds ``in_contents`` (the last marker so far is a contents one; enacting wins on its line) and ``boundary``."""
    mark = F.when(F.col("line").rlike(enacting), False).when(F.col("line").rlike(contents), True)
    so_far = W.partitionBy("source").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(False))
    rows = rows.withColumn("in_contents", inside)
    return rows.withColumn("boundary", F.col("line").rlike(heading) & ~F.col("in_contents") & ~F.col("line").rlike(leader))


def sections(rows: DataFrame, heading: Column) -> DataFrame:
    """(source, segment, heading, text, page_start, page_end, chunk_id): lines from one boundary to the next.

    What stands before the first boundary is ``Preamble``; blank segments are left out; a slug that comes again gets -2, -3.
    """
    so_far = W.partitionBy("source").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("segment", F.sum(F.col("boundary").cast("int")).over(so_far))
    seg = rows.groupBy("source", "segment").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end")
    )
    text = F.trim(F.array_join(F.transform("all", lambda x: F.rtrim(x["line"])), "\n"), F.lit(" \n\t\r"))
    seg = seg.select("source", "segment", F.col("all")[0]["line"].alias("line"), text.alias("text"), "page_start", "page_end").where("text <> ''")
    name = F.when(F.col("segment") == 0, "Preamble").otherwise(heading)
    seg = seg.withColumn("heading", name).withColumn("slug", T.slug(F.col("heading")))
    again = F.row_number().over(W.partitionBy("source", "slug").orderBy("segment"))
    number = F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise("")
    return seg.select("source", "segment", "heading", "text", "page_start", "page_end", F.concat(F.col("source").cast("string"), F.lit(":section-"), F.col("slug"), number).alias("chunk_id"))


REVIEW = ("none", "insufficient")


def page_facts(chunked: DataFrame, paged: DataFrame, status: Column) -> DataFrame:
    """Chunks with n_pages, ``ocr_used`` and ``scan_review`` (any page none or insufficient), and ordered page records, over the pages they span."""
    p = paged.select("source", "page_number", status.alias("status"))
    both = chunked.join(p, (chunked["source"] == p["source"]) & F.col("page_number").between(F.col("page_start"), F.col("page_end"))).drop(p["source"])
    records = F.array_sort(F.collect_list(F.struct("page_number", "status")))
    return both.groupBy("source", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.bool_or(F.col("status") == "ocr").alias("ocr_used"), F.bool_or(F.col("status").isin(*REVIEW)).alias("scan_review"), records.alias("pages")
    )


def document_facts(paged: DataFrame, status: Column) -> DataFrame:
    """(source, document_ocr_used, ocr_pages, scan_review_required, scan_review_pages): lists of a source's page numbers in order."""
    p = paged.select("source", "page_number", status.alias("status"))
    listed = lambda *names: F.array_sort(F.collect_list(F.when(F.col("status").isin(*names), F.col("page_number"))))
    out = p.groupBy("source").agg(listed("ocr").alias("ocr_pages"), listed(*REVIEW).alias("scan_review_pages"))
    return out.select("source", (F.size("ocr_pages") > 0).alias("document_ocr_used"), "ocr_pages", (F.size("scan_review_pages") > 0).alias("scan_review_required"), "scan_review_pages")


def page_budget(paged: DataFrame, most_pages: int = 30, most_chars: int = 100_000, status: Column | None = None) -> DataFrame:
    """(source, n_pages, text, truncated): the first pages up to a budget of characters; the page that crosses it is cut.

    With the ``status`` of pages also ``scanned_pages`` (none or insufficient) and ``ocr_pages``: those of the pages taken, at most ``most_pages``, in order.
    """
    before = W.partitionBy("source").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    rows = paged.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    cut = rows.where((F.col("page_number") <= most_pages) & (F.col("before") < most_chars))
    cut = cut.withColumn("part", F.substr("text", F.lit(1), F.greatest(F.lit(0), F.lit(most_chars) - F.col("before")).cast("int")))
    whole = paged.groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("all_pages"))
    if status is not None:
        listed = lambda *names: F.array_sort(F.collect_list(F.when(F.col("_status").isin(*names), F.col("page_number"))))
        facts = cut.withColumn("_status", status).groupBy("source").agg(listed("none", "insufficient").alias("scanned_pages"), listed("ocr").alias("ocr_pages"))
        whole = whole.join(facts, "source", "left")
    out = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "part"))), lambda x: x["part"]), "").alias("text"))
    more = [] if status is None else ["scanned_pages", "ocr_pages"]
    return out.join(whole, "source").select("source", "n_pages", "text", (F.length("text") < F.col("chars")).alias("truncated"), *more)


def joined_segments(rows: DataFrame, key: str, order: str, text: str, limit: int) -> DataFrame:
    """(key, n_segments, text, too_long): trimmed non-blank parts in order, joined by a space; too_long beyond ``limit``, without a text."""
    part = rows.select(key, order, F.trim(F.col(text)).alias("part")).where("part <> ''")
    out = part.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), (F.sum(F.length("part") + 1) - 1).alias("chars"), F.array_sort(F.collect_list(F.struct(order, "part"))).alias("all"))
    joined = F.array_join(F.transform("all", lambda x: x["part"]), " ")
    return out.select(key, "n_segments", F.when(F.col("chars") <= limit, joined).alias("text"), (F.col("chars") > limit).alias("too_long"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """(page_num, block_num, par_num, line_num, text, confidence): words joined in order; the mean of confidences from 0 to 100."""
    keys = ["page_num", "block_num", "par_num", "line_num"]
    conf = F.avg(F.when(F.col("conf").between(0, 100), F.col("conf")))
    return words.where(F.trim("text") != "").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))), lambda x: x["text"]), " ").alias("text"), conf.alias("confidence"))


def run_starts(rows: DataFrame, by: list[str], share: float = 0.55, least: int = 3) -> DataFrame:
    """(``by``, stop): where the first run of ``least`` non-blank lines begins whose letters are Devanagari to ``share`` or more."""
    devanagari, _ = T.script_counts(F.col("line"))
    letters = F.regexp_count("line", F.lit(r"\p{L}"))
    full = rows.where(F.col("line").rlike(r"(?U)\S")).withColumn("other", (letters > 0) & (devanagari >= share * letters))
    order = W.partitionBy(*by).orderBy("line_no")
    island = F.row_number().over(order) - F.row_number().over(W.partitionBy(*by, "other").orderBy("line_no"))
    runs = full.withColumn("island", island).where("other").groupBy(*by, "island").agg(F.min("line_no").alias("_start"), F.count(F.lit(1)).alias("_lines")).where(F.col("_lines") >= least)
    return runs.groupBy(*by).agg(F.min("_start").alias("stop"))


def trim_at_run(rows: DataFrame, share: float = 0.55, least: int = 3) -> DataFrame:
    """Lines of each source before its first run of lines in Devanagari (``run_starts``)."""
    first = run_starts(rows, ["source"], share, least)
    return rows.join(first, "source", "left").where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).drop("stop")
