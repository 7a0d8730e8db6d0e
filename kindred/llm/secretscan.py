"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for assignments, access keys and hexadecimal runs, and
for opaque runs that only the ownership counts can judge. Each candidate value
is hashed; the hashes are counted by distinct owners and distinct repositories
over the whole corpus. A value seen with many owners, or passed between owners
and copied over many repositories, is a copied example; one that few owners hold
looks live, and so does one that a single owner uses everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"""({_KEYWORD})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # leftmost runs of 20 characters or more: a shorter run holds no longer one
HEX = "[0-9a-f]{24,}"
OPAQUE = "[A-Za-z0-9+/_-]{32,}"
KINDS = ["assign", "access", "hex", "opaque"]  # the order of equal starts; the first three are the base kinds
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with code point offsets: texts between matches tell where each begins."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    empty = F.array().cast(_SPAN)

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["found"])
        here = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))).cast(_SPAN)
        return F.struct(end.alias("at"), F.when(F.char_length(m["value"]) >= least, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value"))
    zipped = F.slice(zipped, 1, F.size(found))  # the text after the last match is no span
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def candidates(text: Column) -> tuple[Column, Column]:
    """Base and opaque spans of a text, (start, kind, end, value) each, by kind; plain substring tests spare most texts the patterns."""
    lower, empty = F.lower(text), F.array().cast(_SPAN)
    word = F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("apikey")) | F.contains(lower, F.lit("api_key"))
    run = text.rlike("[A-Za-z0-9+/_-]{24,}")
    base = F.concat(
        F.when(word, _spans(text, ASSIGN, 0, 2, 6)).otherwise(empty),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, 0, 20)).otherwise(empty),
        F.when(run, _spans(text, HEX, 2, 0, 24)).otherwise(empty),
    )
    opaque = F.filter(
        F.when(run, _spans(text, OPAQUE, 3, 0, 32)).otherwise(empty),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 14),
    )
    return base, opaque


def ownership(hits: DataFrame) -> DataFrame:
    """(hash, owner, repository) rows to distinct owners and repositories of each hash; distinct first, so that a hot hash never meets in one task."""
    owners = hits.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repositories = hits.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = 3, example_repositories: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, owner, repository): text_key and found, an array of (start, kind, end, hash, live, owners, repositories).

    A value is an example if ``example_owners`` owners or more hold it, or if
    more than one does in ``example_repositories`` repositories or more; else
    it is live. Null texts count as empty; a text without spans has an empty
    array. Base spans always stay; an opaque span stays only if it touches no
    base span and is live. A null owner or repository counts as one more.
    Repeated rows are scanned each; other columns are ignored, and texts of
    any length are whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, opaque = candidates(F.col("text"))
    found = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), text.alias("text"))
    found = found.withColumns({"base": base, "opaque": opaque})
    free = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    found = found.withColumn("spans", F.concat("base", free))
    found = written(
        found.select(
            "doc_id", "owner", "repository",
            F.when(F.size("spans") > 0, F.sha2("text", 256)).alias("text_key"),
            F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))).alias("spans"),
        )
    )
    some = found.where("text_key IS NOT NULL")
    held = ownership(some.select("owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash")))
    one = some.groupBy("text_key").agg(F.first("spans").alias("spans"))  # spans depend on the text alone
    judged = one.select("text_key", F.explode("spans").alias("s")).select("text_key", "s.*").join(written(held), "hash")
    example = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))
    judged = judged.withColumn("live", ~example).where("kind < 3 OR live")
    judged = judged.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "live", "owners", "repositories"))).alias("found"))
    judged = written(judged)
    kind = judged.schema["found"].dataType
    return (
        some.select("doc_id", "text_key").join(judged, "text_key", "left")
        .select("doc_id", "text_key", F.coalesce("found", F.array().cast(kind)).alias("found"))
        .unionByName(found.where("text_key IS NULL").select("doc_id", "text_key", F.array().cast(kind).alias("found")))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with its own columns, where every live span of the text is replaced by ``mark``; other texts stay as they are."""
    keyed = docs.withColumn("_kindred_key", F.sha2("text", 256))
    found = written(scan(docs).where("text_key IS NOT NULL").groupBy("text_key").agg(F.first("found").alias("_kindred_found")).where(F.exists("_kindred_found", lambda s: s["live"])))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["end"] > acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], before, F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(""))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(F.filter("_kindred_found", lambda s: s["live"]), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    out = keyed.join(found.withColumnRenamed("text_key", "_kindred_key"), "_kindred_key", "left").withColumn("_kindred_text", F.when(F.col("_kindred_found").isNotNull(), cut).otherwise(F.col("text")))
    return out.select(*[F.col("_kindred_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
