"""Spelling variants by Aho-Corasick halves.

Two words that differ by one code point share a half: cut a word in two, and the
difference lies in one part, so that the other stands whole in the other word, at
its start or at its end. Automata hold the halves of all words, each half in the
shard that its hash names; a word is scanned by the shards that may hold one of
its possible halves, four at most. A half that is found must stand at the start
or the end, its owners' lengths must fit, and what is left of both words must be
one difference apart. Halves with very many owners are dealt by what is left, too.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, parts, ship, table, written

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
PREFIX, SUFFIX = 0, 1


def corpus_words(docs: DataFrame, *, cut: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text): runs of letters, A-Z lower-cased, one in ``cut`` (document, run) pairs shortened by one code point.

    Null texts have no words, a null id counts as empty text; rows of equal
    ids and texts count each. Counts are added up before the shuffle. Words
    have two halves, so that ``least_length`` is 2 or more.
    """
    if least_length < 2:
        raise ValueError("words of one code point have no halves")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", ascii_lower(F.col("run")))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    runs = runs.where(F.octet_length("run") >= least_length).withColumn("h", h)  # shorter ones can't be long enough
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % cut == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def left(word: str, kind: int, half: str) -> str:
    """What is left of a word that starts (or ends) with the half."""
    return word[len(half) :] if kind == PREFIX else word[: len(word) - len(half)]


def shortened(rest: str) -> set[str]:
    """A string and all that it becomes without one code point; two strings at most one difference apart share one of these."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _possible(word: Column) -> Column:
    """(kind, half, own) of each half that a word may share with a near one: its own, and those of words one longer or shorter."""
    n = F.char_length(word)
    k = lambda d: ((n + d) / 2).cast("int")
    start = lambda d: F.struct(F.lit(PREFIX).alias("kind"), F.substring(word, F.lit(1), k(d)).alias("half"), (k(d) == k(0)).alias("own"))
    end = lambda d: F.struct(F.lit(SUFFIX).alias("kind"), F.substring(word, n - (n + d - k(d)) + 1, n + d - k(d)).alias("half"), (n + d - k(d) == n - k(0)).alias("own"))
    return F.array_distinct(F.array(start(-1), start(0), start(1), end(-1), end(0), end(1)))


def scan_shard(rows: list[tuple[str, int, int, list | None]]) -> list[tuple[str, int, int, str]]:
    """(word, near words, largest count, its word) for the words that have near ones by halves of this shard.

    rows: (word, n, flags, mine): bit k of flags says that the word's half k is
    in this shard's automaton; mine lists (kind, half, rest) that this shard
    answers for, or is null if it answers for all.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    owners: dict[tuple, list[tuple[str, int]]] = {}
    for word, n, flags, mine in rows:
        for kind, half in enumerate(halves(word)):
            if flags >> kind & 1:
                automaton.add_word(half, half)
                rests = shortened(left(word, kind, half)) if mine is None else {r for k, h, r in mine if (k, h) == (kind, half)}
                for rest in rests:
                    owners.setdefault((kind, half, rest), []).append((word, n))
    if not owners:
        return []
    automaton.make_automaton()
    out = []
    for word, _, _, mine in rows:
        near, best = 0, None
        allowed = None if mine is None else {tuple(x) for x in mine}
        for last, half in automaton.iter(word):
            size = len(half)
            for kind, fits in ((PREFIX, last == size - 1), (SUFFIX, last == len(word) - 1)):
                # offset and length: the half is half of a word at most one longer or shorter
                owner_lengths = (2 * size, 2 * size + 1) if kind == PREFIX else (2 * size - 1, 2 * size)
                if not fits or not (owner_lengths[0] - 1 <= len(word) <= owner_lengths[1] + 1):
                    continue
                rest = left(word, kind, half)
                mine_rests = shortened(rest)
                for r in mine_rests:
                    if allowed is not None and (kind, half, r) not in allowed:
                        continue
                    for other, m in owners.get((kind, half, r), ()):
                        if not one_apart(word, other):
                            continue
                        if kind == SUFFIX and word.startswith(halves(other)[0]):
                            continue  # found by its first half
                        if r != min(mine_rests & shortened(left(other, kind, half))):
                            continue  # found by another rest
                        near += 1
                        if best is None or (-m, other) < best:
                            best = (-m, other)
        if near:
            out.append((word, near, -best[0], best[1]))
    return out


def near_words(words: DataFrame, *, shard_rows: int = 100_000, hot_owners: int = 20_000) -> DataFrame:
    """(word, n_near, near_n, near) of ``words`` (word, n) that have words one code point apart: their number, and the one of largest n (ties: smallest).

    No pair leaves a shard: a shard passes on a count and a best word for each
    word. A half of more than ``hot_owners`` words is dealt by the hash of the
    half and what is left without one code point, so that its words, however
    many, spread over all shards.
    """
    spark = words.sparkSession
    ship(spark)
    keys = words.select("word", "n", F.explode(_possible(F.col("word"))).alias("k")).select("word", "n", "k.*")
    keys = keys.groupBy("word", "n", "kind", "half").agg(F.max("own").alias("own"))  # one row a half
    hot = written(keys.where("own").groupBy("kind", "half").agg(F.count("*").alias("owners")).where(F.col("owners") > hot_owners).select("kind", "half", F.lit(True).alias("hot")))
    shards = max(parts(spark), -(-words.count() * 4 // shard_rows))
    kept = F.struct("kind", "half", "own")
    if hot.isEmpty():
        keys = keys.withColumns({"hot": F.lit(False), "rest": F.lit(None).cast("string")})
    else:
        rest = F.when(F.col("kind") == PREFIX, F.substring("word", F.char_length("half") + 1, F.char_length("word"))).otherwise(F.substring("word", F.lit(1), F.char_length("word") - F.char_length("half")))
        shorter = F.transform(F.sequence(F.lit(0), F.char_length("_rest") - 1), lambda i: F.concat(F.substring(F.col("_rest"), F.lit(1), i), F.substring(F.col("_rest"), i + 2, F.char_length("_rest"))))
        keys = keys.join(hot, ["kind", "half"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("_rest", rest)
        rests = F.when(F.col("hot"), F.array_distinct(F.concat(F.array("_rest"), F.when(F.col("_rest") != "", shorter).otherwise(F.array().cast("array<string>"))))).otherwise(F.array(F.lit(None).cast("string")))
        keys = keys.withColumn("rest", F.explode(rests)).drop("_rest")
    shard = F.pmod(F.xxhash64("kind", "half", F.coalesce("rest", F.lit(""))), F.lit(shards)) + F.when(F.col("hot"), shards).otherwise(0)
    mine = F.collect_list(F.when(F.col("hot"), F.struct("kind", "half", "rest")))
    flag = F.bit_or(F.when(F.col("own"), F.col("kind") + 1).otherwise(0))  # 1: first half, 2: second
    rows = keys.withColumn("shard", shard).groupBy("shard", "word", "n").agg(flag.alias("flags"), F.max("hot").alias("hot"), mine.alias("mine"))
    rows = rows.select("shard", "word", "n", "flags", F.when(F.col("hot"), F.col("mine")).alias("mine"))

    def run(t: pa.Table) -> pa.Table:
        mine = [x and [(k["kind"], k["half"], k["rest"]) for k in x] for x in t["mine"].to_pylist()]
        found = scan_shard(list(zip(t["word"].to_pylist(), t["n"].to_pylist(), t["flags"].to_pylist(), mine, strict=True)))
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])

    found = rows.groupBy("shard").applyInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near"))


def group(words: DataFrame, *, factor: int = 5, shard_rows: int = 100_000, hot_owners: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of the distinct ``words`` (word, n).

    The form is the near word of largest n (ties: smallest in code-point
    order) if it has at least ``factor`` times the word's n; the root is where
    forms end. Counts grow along forms, so the chain is no longer than the
    logarithm of the largest; its links are doubled in each round. An empty
    table has no rows.
    """
    words = written(words)
    near = near_words(words, shard_rows=shard_rows, hot_owners=hot_owners)
    some = F.col("near_n") >= factor * F.col("n")
    got = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(some, F.col("near")).alias("form"), F.when(some, F.col("near_n")).alias("form_n")))
    links = got.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        links = written(links.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "to")
    return got.join(links.select("word", F.col("to").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, cut: int = 199, least_length: int = 6, least_count: int = 5, factor: int = 5) -> DataFrame:
    """group() of the corpus_words() of ``docs``. Texts are whole, however long; other columns are ignored."""
    return group(corpus_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut=cut, least_length=least_length, least_count=least_count), factor=factor)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 is linear: each byte's share depends on its value and its distance from the end alone.
ORACLE_OP11 = r"""WITH RECURSIVE bits(b, k, v) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
t0 AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS m, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE strlen(run) >= 6 GROUP BY ALL),
longest AS (SELECT coalesce(max(strlen(key)), 1) AS d FROM runs),
share(d, b, v) AS (SELECT 0, b, v FROM t0 UNION ALL SELECT s.d + 1, s.b, xor(s.v >> 8, t0.v) FROM share s JOIN t0 ON t0.b = s.v % 256 WHERE s.d < (SELECT d FROM longest)),
start(d, v) AS (SELECT 0, CAST(4294967295 AS BIGINT) UNION ALL SELECT start.d + 1, xor(start.v >> 8, t0.v) FROM start JOIN t0 ON t0.b = start.v % 256 WHERE start.d < (SELECT d FROM longest)),
bytes AS (SELECT doc_id, run, strlen(key) AS len, unnest(range(strlen(key))) AS i, hex(encode(key)) AS x FROM runs),
crc AS (SELECT doc_id, run, xor(xor(bit_xor(CAST(s.v AS BIGINT)), any_value(CAST(start.v AS BIGINT))), 4294967295) AS h FROM bytes
  JOIN share s ON s.d = len - 1 - i AND s.b = CAST('0x' || x[2 * i + 1:2 * i + 2] AS INTEGER) JOIN start ON start.d = len GROUP BY doc_id, run),
w AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(runs.run, 1, h % length(runs.run)) || substr(runs.run, h % length(runs.run) + 2) ELSE runs.run END AS word, m
  FROM runs JOIN crc ON crc.run = runs.run AND crc.doc_id IS NOT DISTINCT FROM runs.doc_id) WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
gaps AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.a = b.a AND a.z = b.z WHERE a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN w ON w.word = g.a || g.z UNION SELECT w.word, g.word, g.n FROM gaps g JOIN w ON w.word = g.a || g.z),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
r(word, top) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.top AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f e ON e.word = r.top WHERE e.form IS NULL"""
