"""Names, urls, dates and details, as column expressions. Nulls count as empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = " \t\n\r\x0b\x0c"


def strip(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")), F.lit(_WHITE))


def unquote(x: Column) -> Column:
    """Percent-decoding that leaves plus signs, and what can't be decoded, alone."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def _cut(x: Column) -> Column:
    return F.substring_index(F.substring_index(F.coalesce(x, F.lit("")), "?", 1), "#", 1)


def basename_from_url(url: Column) -> Column:
    return unquote(F.substring_index(_cut(url), "/", -1))


def url_basename(url: Column) -> Column:
    """Last path segment of a url; of a bare name, its last segment, or what is given where that is empty."""
    path = F.regexp_replace(_cut(url), "^(https?:)?//[^/]*", "")
    bare = F.coalesce(F.nullif(basename_from_url(url), F.lit("")), url, F.lit(""))
    return F.when(F.coalesce(url, F.lit("")).rlike("^(https?:)?//"), unquote(F.substring_index(path, "/", -1))).otherwise(bare)


def normalize_filename(x: Column) -> Column:
    s = F.substring_index(_cut(unquote(F.coalesce(x, F.lit("")))), "/", -1)
    s = F.regexp_replace(s, r"^(.*[^.].*)\.[^.]*$", "$1")
    return F.lower(strip(F.regexp_replace(F.regexp_replace(s, r"[_\-.]+", " "), r"\s+", " ")))


def same_folded(a: Column, b: Column) -> Column:
    """Equal but for case and outer white space."""
    fold = lambda x: F.replace(F.lower(strip(x)), F.lit("ß"), F.lit("ss"))
    return fold(a) == fold(b)


def resolve_asset(ref: Column, base: str, job: Column) -> Column:
    """Absolute urls pass; others name a file among the job's assets."""
    name = F.substring_index(F.regexp_replace(ref, r"^[./]+", ""), "/", -1)
    return F.when(ref.rlike("^https?://"), ref).otherwise(F.concat(F.lit(base + "/"), job, F.lit("/assets/"), name))


def sanitize_details(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(x, r"[\r\n]+", "\n"), r"[ \t\f\x0B]+", " ")
    return F.nullif(strip(s), F.lit(""))


def partial_date(x: Column) -> Column:
    """struct(y, m, d) of year, year-month or year-month-day, or of an ISO timestamp's date; null if it is none of them. No calendar check."""
    s = strip(x)
    short = r"^(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2}))?)?$"
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    part = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit("")).cast("int")
    made = lambda p: F.struct(*[part(p, i).alias(n) for i, n in enumerate("ymd", 1)])
    return F.when(s.rlike(short), made(short)).when(s.rlike(iso), made(iso))


def date_score(a: Column, b: Column) -> Column:
    """1 for the same day, 0.5 for year and month, 0.2 for the year, else 0."""
    a, b = partial_date(a), partial_date(b)
    same = lambda f: F.coalesce(a[f] == b[f], F.lit(False))
    return F.when(same("y") & same("m") & same("d"), 1.0).when(same("y") & same("m"), 0.5).when(same("y"), 0.2).otherwise(0.0)


def name_fields(x: Column) -> Column:
    """struct(title, year, season, episode, screen_size) that a file name tells by common patterns."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\.[A-Za-z0-9]{2,4}$", ""), r"[._]+", " ")
    part = lambda p, i=1: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    code = r"(?i)\bs(\d{1,2})\s?e(\d{1,3})\b"
    title = F.regexp_replace(s, r"(?i)(\bs\d{1,2}\s?e\d{1,3}\b|\b(?:19|20)\d{2}\b|\b\d{3,4}[pi]\b).*$", "")
    return F.struct(
        F.nullif(strip(F.regexp_replace(title, r"[-\s]+", " ")), F.lit("")).alias("title"), part(r"\b((?:19|20)\d{2})\b").cast("int").alias("year"),
        part(code, 1).cast("int").alias("season"), part(code, 2).cast("int").alias("episode"), F.lower(part(r"(?i)\b(\d{3,4}[pi])\b")).alias("screen_size"),
    )


#: What a field on which both names agree adds.
BONUS = {"year": 0.05, "episode": 0.05, "season": 0.03, "screen_size": 0.02}


def structured_bonus(a: Column, b: Column) -> Column:
    return sum((F.when(a[f] == b[f], F.lit(w)).otherwise(0.0) for f, w in BONUS.items()), F.lit(0.0))


def screenshot_fingerprint(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]t=([^&#]*)", 1), F.lit("")), url)


def oshash(files: Column) -> Column:
    prints = F.get(files, F.lit(0))["fingerprints"]
    return F.get(F.filter(prints, lambda p: p["type"] == "oshash"), F.lit(0))["value"]


def reference_list(images: Column, cover: Column) -> Column:
    """Cover first if it is not among the images; copies stay."""
    images = F.coalesce(images, F.array().cast("array<string>"))
    return F.when(cover.isNull() | F.array_contains(images, cover), images).otherwise(F.concat(F.array(cover), images))


def feature_references(images: Column, cover: Column) -> Column:
    """Cover and images, without nulls, empties and copies."""
    every = F.concat(F.array(cover), F.coalesce(images, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda r: r.isNotNull() & (r != "")))


def record_fingerprint(references: Column) -> Column:
    return F.array_join(F.array_sort(references), "|")


def systematic_sample(items: Column, size: int) -> Column:
    """All items, or ``size`` of them at even steps."""
    n = F.size(items)
    at = F.transform(F.sequence(F.lit(0), F.lit(max(size, 1) - 1)), lambda i: F.get(items, F.floor(i * n / F.lit(max(size, 1))).cast("int")))
    return F.when((F.lit(size) <= 0) | (F.lit(size) >= n), items).otherwise(at)
