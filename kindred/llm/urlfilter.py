"""URL filters by a tree of path templates.

Urls are cut into host and path segments. Level by level, and per host, a
segment with a digit becomes a wildcard; children whose blocked shares do not
differ from their siblings' by more than chance allows are merged into one
branch, however many children a node has. A template's purity is its blocked share of
labelled urls, smoothed towards its parent's; templates that are pure enough
are rejected. Hand-written rules go before the tree, and label the urls that
they fit. Everything works on counts of distinct templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: (verdict, host, path): fixed by the task.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, which are longer, wrap earlier ones
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out.cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, labels: Column, depth: int = 4, alike: float = 1.96, weight: float = 4.0, reject: float = 0.5) -> DataFrame:
    """``pages`` (host, path and others) with template, purity and rejected.

    ``labels`` is 1 for blocked, 0 for allowed and null for unlabelled rows.
    Segments beyond ``depth`` count as one tail, however long the path. Null
    hosts and paths count as empty ones, repeated pages count each. A purity of
    exactly ``reject`` is rejected. Without any label the purity is 0 and
    nothing is rejected.
    """
    shape = F.regexp_replace(F.regexp_replace("path", "[^/]*[0-9][^/]*?(\\.[a-z]{1,5})?(?=/|$)", "*$1"), "/+", "/")
    keyed = pages.drop("template", "purity", "rejected").withColumns({"_kindred_host": F.coalesce("host", F.lit("")), "_kindred_shape": F.coalesce(shape, F.lit(""))})
    t = keyed.groupBy("_kindred_host", "_kindred_shape").agg(F.count("*").alias("n"), F.count(labels).alias("lab"), F.coalesce(F.sum(labels), F.lit(0)).alias("blk"))
    t = written(t.withColumns({"segs": F.split("_kindred_shape", "/"), "node": F.lit("")}))
    total = t.agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk")).first()
    root = (total["blk"] or 0) / total["lab"] if total["lab"] else 0.0
    host_sums = t.groupBy("_kindred_host").agg(F.sum("lab").alias("hl"), F.sum("blk").alias("hb"))
    t = t.join(host_sums, "_kindred_host").withColumn("purity", (F.col("hb") + weight * root) / (F.col("hl") + weight)).drop("hl", "hb")
    for d in range(1, depth + 1):
        last = F.array_join(F.slice("segs", d + 1, F.greatest(F.size("segs") - d, F.lit(1))), "/") if d == depth else F.get("segs", F.lit(d))
        t = t.withColumn("seg", F.coalesce(F.when(F.size("segs") > d, last), F.lit("$")))
        kids = written(t.groupBy("_kindred_host", "node", "seg").agg(F.sum("lab").alias("kl"), F.sum("blk").alias("kb")))
        family = kids.groupBy("_kindred_host", "node").agg(F.sum("kl").alias("pl"), F.sum("kb").alias("pb"))
        kids = kids.join(family, ["_kindred_host", "node"])
        share = F.when(F.col("pl") > 0, F.col("pb") / F.col("pl")).otherwise(0.0)
        spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / F.greatest("kl", F.lit(1)))
        similar = F.abs(F.when(F.col("kl") > 0, F.col("kb") / F.col("kl")).otherwise(share) - share) <= alike * spread
        wild = F.regexp_extract("seg", r"(\.[a-z]{1,5})$", 1)
        kids = kids.withColumn("branch", F.when(F.col("seg") == "$", "$").when(similar, F.concat(F.lit("*"), wild)).otherwise(F.col("seg")))
        t = t.join(written(kids.select("_kindred_host", "node", "seg", "branch")), ["_kindred_host", "node", "seg"])
        t = t.withColumn("node", F.concat("node", F.lit("/"), "branch"))
        sums = t.groupBy("_kindred_host", "node").agg(F.sum("lab").alias("bl"), F.sum("blk").alias("bb"))
        t = t.join(sums, ["_kindred_host", "node"]).withColumn("purity", (F.col("bb") + weight * F.col("purity")) / (F.col("bl") + weight)).drop("bl", "bb", "seg", "branch")
        t = written(t)
    found = written(t.select("_kindred_host", "_kindred_shape", F.regexp_replace("node", r"(/\$)+$", "").alias("template"), "purity"))
    return keyed.join(found, ["_kindred_host", "_kindred_shape"]).withColumn("rejected", F.col("purity") >= reject).drop("_kindred_host", "_kindred_shape")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    pages = pages.withColumn("r", rule_of(RULES))
    found = judge(pages, F.when(F.col("r.verdict") == "block", 1).when(F.col("r.verdict") == "allow", 0))
    verdict = F.coalesce("r.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))
