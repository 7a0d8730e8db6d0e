"""Stand-ins for media tables, made from the test tables by the same rules in Spark and in SQL.

job = label, image = vec_id, record = four images in a row of a job, scene =
three images in a row among those whose vec_id is divisible by 7; tone and
histogram blob = components scaled to 0..255, hash = signs in two lanes (of
every ninth image, only large components count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Every ninth image is nearly flat: few bits are set in its hash.
_BIT = "if(vec_id % 9 = 0, 0.25D, 0D)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    blob = F.expr("transform(embedding, x -> floor(least(greatest((cast(x as double) + 0.6D) / 1.2D, 0D), 1D) * 255 + 0.5D))")
    lane = lambda lo: F.expr(f"aggregate(sequence(0, 31), 0L, (a, i) -> a + if(embedding[i + {lo}] > {_BIT}, shiftleft(1L, i), 0L))")
    made = e.select(F.col("vec_id").alias("ref"), F.col("label").cast("long").alias("job"), blob.alias("blob"), F.array(lane(0), lane(32)).alias("lanes"), (F.col("vec_id") % 7 == 0).alias("in_scene"))
    rank = F.row_number().over(Window.partitionBy("job").orderBy("ref")) - 1  # after the costly columns: a job's rows come to one task
    return made.select("ref", "job", F.floor(rank / 4).alias("record"), "blob", "lanes", "in_scene")


def scenes(img: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("job").orderBy("ref")) - 1
    s = img.where("in_scene").withColumn("scene_id", F.col("job") * 1000 + F.floor(rank / 3))
    return s.select("scene_id", "job", F.col("ref").alias("sref"), F.col("blob").alias("sblob"), F.col("lanes").alias("slanes"))


IMG = """img AS (
  SELECT vec_id AS ref, CAST(label AS BIGINT) AS job, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4 AS record,
    list_transform(embedding, lambda x: CAST(floor(least(greatest((CAST(x AS DOUBLE) + 0.6e0) / 1.2e0, 0e0), 1e0) * 255 + 0.5e0) AS BIGINT)) AS blob,
    CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 1] > CASE WHEN vec_id % 9 = 0 THEN 0.25e0 ELSE 0e0 END THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS l0,
    CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + 33] > CASE WHEN vec_id % 9 = 0 THEN 0.25e0 ELSE 0e0 END THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS l1,
    vec_id % 7 = 0 AS in_scene FROM embeddings)"""


def sql_ham(a: str, b: str) -> str:
    return f"greatest(0e0, 1e0 - (bit_count(xor({a}.l0, {b}.l0)) + bit_count(xor({a}.l1, {b}.l1))) / 64e0)"


def sql_guarded(a: str, b: str) -> str:
    flat = lambda x: f"(bit_count({x}.l0) + bit_count({x}.l1)) / 64e0 NOT BETWEEN 0.1e0 AND 0.9e0"
    return f"(CASE WHEN {flat(a)} OR {flat(b)} THEN 0e0 ELSE {sql_ham(a, b)} END)"


def sql_tone(a: str, b: str) -> str:
    return f"(1e0 - list_sum(list_transform(range(1, len({a}) + 1), lambda k: abs({a}[k] - {b}[k]))) / CAST(len({a}) AS DOUBLE) / 255e0)"


def sql_hist(a: str, b: str) -> str:
    return f"(CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_sum(list_transform(range(1, len({a}) + 1), lambda k: least({a}[k] / CAST(list_sum({a}) AS DOUBLE), {b}[k] / CAST(list_sum({b}) AS DOUBLE)))) ELSE 0e0 END)"


def sql_gini(h: str) -> str:
    s = f"list_sort({h})"
    return f"(CASE WHEN list_sum({h}) > 0 THEN greatest(0e0, least(1e0, 2e0 * list_sum(list_transform(range(1, len({h}) + 1), lambda k: CAST({s}[k] AS DOUBLE) * (len({h}) + 1 - k))) / (len({h}) * CAST(list_sum({h}) AS DOUBLE)))) ELSE 0e0 END)"


def sql_sharpen(m: str, base: str = "0.5e0", gamma: str = "3.5e0") -> str:
    raw = f"(({m} - {base}) / greatest(1e-9, 1e0 - {base}))"
    return f"(CASE WHEN {raw} <= 0 THEN 0e0 WHEN {raw} >= 1 THEN 1e0 ELSE pow({raw}, {gamma}) END)"


SC = "sc AS (SELECT job, job * 1000 + (row_number() OVER (PARTITION BY job ORDER BY ref) - 1) // 3 AS scene_id, ref AS sref, blob AS sblob, l0, l1 FROM img WHERE in_scene)"
MX = f"""{IMG}, {SC}, mx AS (
  SELECT scene_id, i.job, i.record, i.ref, greatest(0e0, max({sql_tone('i.blob', 's.sblob')})) AS tone, greatest(0e0, max({sql_guarded('s', 'i')})) AS ham
  FROM sc s JOIN img i ON s.job = i.job GROUP BY ALL)"""
MED = """med AS (SELECT {keys}, list(CAST(CASE WHEN t > 0 THEN round(m / t * 255) ELSE 0 END AS BIGINT) ORDER BY bin) AS hist FROM (
  SELECT {keys}, bin, m, sum(m) OVER (PARTITION BY {keys}) AS t FROM (
    SELECT {keys}, bin, median(share) AS m FROM (
      SELECT {keys}, unnest(range(1, len(blob) + 1)) AS bin, unnest(list_transform(blob, lambda v: CASE WHEN list_sum(blob) > 0 THEN v / CAST(list_sum(blob) AS DOUBLE) ELSE 0e0 END)) AS share FROM {source}) GROUP BY ALL)) GROUP BY {keys})"""


def sql_frame(m: str, quality: str = "1e0", uniq: str = "1e0", base: str = "0.5e0", source: str = "mx") -> str:
    """Frame channel over the source by scene_id, job, record."""
    mp = sql_sharpen(m, base)
    return f"""SELECT scene_id, job, record, evidence, count_conf, dist_q, evidence * count_conf * dist_q AS score FROM (
      SELECT scene_id, job, record, greatest(0e0, least(1e0, 1e0 - exp(sum(ln(greatest(1e-9, 1e0 - greatest(0e0, least(1e0, w * mp)))))))) AS evidence,
        greatest(0e0, least(1e0, 1e0 - exp(-sum(w) / 0.25e0))) AS count_conf,
        CASE WHEN count(*) FILTER (mp > 1e-9) > 1 THEN greatest(0.5e0, least(1e0, 0.5e0 + 0.5e0 * (ln(sum(mp) FILTER (mp > 1e-9)) - sum(mp * ln(mp)) FILTER (mp > 1e-9) / sum(mp) FILTER (mp > 1e-9)) / ln(count(*) FILTER (mp > 1e-9)))) ELSE 0.5e0 END AS dist_q
      FROM (SELECT scene_id, job, record, {mp} AS mp, {quality} * {uniq} AS w FROM {source}) GROUP BY ALL)"""


def sql_draws(source: str, prefix: str, means: str, whole: bool = False) -> str:
    """Pairs that sampling draws: rows with hash-chosen partners among all of their job; the 1000 with the smallest hashes count. Tables are named after the prefix. If whole, every row draws in jobs of many, too."""
    p = prefix
    few = "" if whole else " AND CAST((a.ref * 16807 + a.h * 40692) % 2147483647 AS DOUBLE) * (a.n * a.draws) < 4000e0 * 2147483647"
    return f"""{p}n AS (SELECT job, count(*) AS n FROM {source} GROUP BY job), {p}r AS (SELECT s.*, n, least(20, ceil(2000e0 / n)) AS draws, unnest(range(0, CAST(least(20, ceil(2000e0 / n)) AS BIGINT))) AS h FROM {source} s JOIN {p}n USING (job)),
{p}p AS (SELECT DISTINCT a.job, least(a.ref, b.ref) AS r1, greatest(a.ref, b.ref) AS r2 FROM {p}r a JOIN {p}r b ON a.job = b.job AND a.h = b.h AND (a.ref * 48271 + a.h * 104729) % 2147483647 % a.n = (b.ref * 69621 + b.h * 75029) % 2147483647 % b.n
  WHERE a.ref <> b.ref AND a.record <> b.record{few}),
{p}k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY (r1 * 7919 + r2 * 104729) % 2147483647, r1, r2) AS k FROM {p}p),
{p}l AS (SELECT j.job, {means} FROM (SELECT DISTINCT job FROM {source}) j LEFT JOIN (SELECT * FROM {p}k WHERE k <= 1000) q ON j.job = q.job LEFT JOIN {source} a ON a.job = q.job AND a.ref = q.r1 LEFT JOIN {source} b ON b.job = q.job AND b.ref = q.r2 GROUP BY j.job)"""


_MEANS = f"coalesce(avg({sql_tone('a.blob', 'b.blob')}), 0.5e0) AS tone, coalesce(avg({sql_guarded('a', 'b')}), 0.5e0) AS phash"
DRAWS, WHOLE_DRAWS = (sql_draws("img", "b", _MEANS, whole) for whole in (False, True))
UNIQUE = f"""nr AS (SELECT a.job, a.ref, b.record FROM img a JOIN img b ON a.job = b.job AND (a.ref = b.ref OR {sql_tone('a.blob', 'b.blob')} >= 0.9e0)),
uq AS (SELECT job, ref, greatest(count(DISTINCT record) - 1, 0) AS matches, 1e0 / (1e0 + greatest(count(DISTINCT record) - 1, 0)) AS uniqueness FROM nr GROUP BY job, ref)"""


def sql_fuzzy(source: str) -> str:
    """CTEs after the names (a, b) and titles (ta, tb) of ``source``: fz (a, b, ta, tb, naive, title). Names whose lengths differ by half or more, which count partial strings, don't occur in the test tables."""
    words = lambda s: f"list_sort(list_filter(string_split({s}, ' '), lambda t: t <> ''))"
    text = lambda s: f"array_to_string({s}, ' ')"
    both = lambda x, y: text(f"list_filter(list_sort(list_distinct({x})), lambda t: list_contains({y}, t))")
    only = lambda x, y: text(f"list_filter(list_sort(list_distinct({x})), lambda t: NOT list_contains({y}, t))")
    sets = ", ".join(f"{both(x, y)} AS {c}_both, {only(x, y)} AS {c}_l, {only(y, x)} AS {c}_r" for c, x, y in (("n", "wa", "wb"), ("t", "wta", "wtb")))
    one = lambda c, s: f"trim({c}_both || ' ' || {c}_{s})"
    row = lambda c, f, x, y: f"{{'c': '{c}', 'f': {f}, 'x': {x}, 'y': {y}}}"
    asks = lambda c, f: f"[{row(c, f, one(c, 'l'), one(c, 'r'))}], CASE WHEN {c}_both <> '' THEN [{row(c, f, c + '_both', one(c, 'l'))}, {row(c, f, c + '_both', one(c, 'r'))}] ELSE [] END"
    whole = lambda c: f"CASE WHEN {c}_both <> '' AND ({c}_l = '' OR {c}_r = '') THEN {{f}} ELSE 0e0 END"
    return f"""fz_w AS (SELECT *, {words('a')} AS wa, {words('b')} AS wb, {words('ta')} AS wta, {words('tb')} AS wtb FROM (SELECT DISTINCT a, b, ta, tb FROM {source})), fz_s AS MATERIALIZED (SELECT *, {sets} FROM fz_w),
fz_q AS MATERIALIZED (SELECT a, b, ta, tb, unnest(list_concat([{row('n', '1e0', 'a', 'b')}, {row('n', '0.95e0', text('wa'), text('wb'))}], {asks('n', '0.95e0')}, {asks('t', '1e0')})) AS q FROM fz_s),
fz_l AS MATERIALIZED (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 100e0 ELSE 200e0 * (length(x) - bit_count(list_reduce(list_prepend((CAST(1 AS HUGEINT) << length(x)) - 1,
    list_transform(string_split(y, ''), lambda c: list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN x[i + 1] = c THEN CAST(1 AS HUGEINT) << i ELSE CAST(0 AS HUGEINT) END)))),
    lambda s, m: ((s + (s & CAST(m AS HUGEINT))) | (s - (s & CAST(m AS HUGEINT)))) & ((CAST(1 AS HUGEINT) << length(x)) - 1)))) / (length(x) + length(y)) END AS r FROM (SELECT DISTINCT q.x AS x, q.y AS y FROM fz_q)),
fz_m AS (SELECT a, b, ta, tb, max(q.f * r) FILTER (q.c = 'n') AS n, max(q.f * r) FILTER (q.c = 't') AS t FROM fz_q JOIN fz_l ON q.x = x AND q.y = y GROUP BY ALL),
fz AS (SELECT a, b, ta, tb, CASE WHEN a = '' OR b = '' THEN 0e0 ELSE greatest(n, {whole('n').format(f='95e0')}) / 100 END AS naive, CASE WHEN ta = '' OR tb = '' THEN 0e0 ELSE greatest(t, {whole('t').format(f='100e0')}) / 100 END AS title FROM fz_m JOIN fz_s USING (a, b, ta, tb))"""
