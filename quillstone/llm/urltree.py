"""URL filters: host and path rules, and a tree of path templates judged by smoothed purity (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = 8  # tree levels; what a path has below them makes up one last node, so nothing is cut off


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z in lower case; path: from there up to ? # or the end. Else both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is put outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """Non-empty segments, with runs of digits and long hexadecimal runs as wildcards; all below LEVELS is one segment."""
    seg = F.filter(F.split(path, "/"), lambda s: s != "")
    seg = F.transform(seg, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}"))
    deep = F.concat(F.slice(seg, 1, LEVELS - 1), F.array(F.array_join(F.slice(seg, F.lit(LEVELS), F.greatest(F.size(seg), F.lit(1))), "/")))
    return F.when(F.size(seg) > LEVELS, deep).otherwise(seg)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, variable_least: int = 9, variable_share: float = 0.2, z_similar: float = 1.96, smoothing: float = 4.0, reject: float = 0.8) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each row of ``pages``.

    Rules decide the urls that they fit, and label them (block 1, allow 0) for the tree. Per host, paths become
    nodes of a tree: digit and hex runs are wildcards at once; a node's children become one wildcard if they are at
    least ``variable_least`` and more than ``variable_share`` of its urls; labelled siblings whose block rate doesn't
    differ from the other siblings' (two-proportion z below ``z_similar``) are merged. A template with b blocked of n
    labelled urls has purity (b + s/2) / (n + s), s = ``smoothing``; at ``reject`` or more its other urls are blocked, else allowed.

    Null urls and those without ``://`` have an empty host and path and are judged as such. Repeated rows are each judged.
    Urls are counted by (host, wildcard path) before any step of the tree, so a hot host costs only its distinct shapes.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("_key"), host.alias("host"), path.alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said, "seg": _segments(F.col("path"))})
    shapes = rows.groupBy("host", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked")
    )
    scratch = Scratch(pages.sparkSession)
    tree = scratch.save(shapes.withColumn("template", F.lit("")))
    depth = tree.agg(F.max(F.size("seg"))).first()[0] or 0
    for level in range(depth):  # LEVELS at most
        here = F.get("seg", F.lit(level))
        branch = tree.withColumn("child", here)
        kids = branch.where("child is not null").groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        total = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        own, rest = F.col("labelled").cast("double"), (F.col("all_labelled") - F.col("labelled")).cast("double")
        p = F.col("all_blocked") / F.nullif(F.col("all_labelled"), F.lit(0))
        gap = F.abs(F.col("blocked") / F.nullif(own, F.lit(0)) - (F.col("all_blocked") - F.col("blocked")) / F.nullif(rest, F.lit(0)))
        alike = gap <= z_similar * F.sqrt(p * (1 - p) * (1 / F.nullif(own, F.lit(0)) + 1 / F.nullif(rest, F.lit(0))))
        wild = (F.col("kids") >= variable_least) & (F.col("kids") > variable_share * F.col("all_n"))
        named = kids.join(total, ["host", "template"]).select(
            "host", "template", "child", F.when(wild, "*").when(F.coalesce(alike, F.lit(False)), "~").otherwise(F.col("child")).alias("node")
        )
        grown = branch.join(named, ["host", "template", "child"], "left").select(
            "host", "seg", "n", "labelled", "blocked", F.when(F.col("node").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "node")).alias("template")
        )
        tree = scratch.save(grown)
    judged = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    judged = judged.withColumn("purity", (F.col("b") + smoothing / 2) / (F.col("l") + smoothing)).drop("l", "b")
    of_shape = tree.select("host", "seg", "template").join(judged, ["host", "template"])
    verdict = F.coalesce("said", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    out = rows.join(of_shape, ["host", "seg"], "left")
    return out.select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.concat(F.col("host"), F.col("template")).alias("template"), "purity")
