"""Quality rules on the coverage of repetition.

Rolling hashes of word n-grams of several lengths find the windows that occur
more than once in a text; the words that they cover are marked once each, so
that overlaps don't count twice, and the characters marked are held against the
characters of all words. Lines are compared whole. All texts of a batch are
done in one pass of numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship, split_words, sums, table

#: Percent of the words' characters that repeated n-grams may cover, by n, and that repeated lines may hold: fixed values.
MOST_COVERED = {5: 55, 8: 45, 12: 40}
MOST_IN_LINES = 30
#: Contract of the base rules: fixed values.
LEAST_WORDS, BASE_N, MOST_REPEATED, SYMBOLS = 20, 8, 30, "[#*$%&|<>]"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of integers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a length, from prefix sums of codes times powers of an odd base modulo 2^64."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self, codes: np.ndarray, doc: np.ndarray):
        self.codes, self.doc, n = codes, doc, len(codes)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.BASE, np.uint64))]).astype(np.uint64)
        self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(self.BASE, -1, 2**64), np.uint64))]).astype(np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes) * powers[:n], dtype=np.uint64)])
        self.salt = _mixed(_mixed(doc))

    def repeated(self, n: int, at: np.ndarray) -> np.ndarray:
        """Those of the positions ``at`` whose window of n words occurs again in its text, among ``at``; each within its text."""
        key = _mixed(((self.prefix[at + n] - self.prefix[at]) * self.back[at]) ^ self.salt[at])
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        a, b = at[order[same]], at[order[same + 1]]
        equal = self.doc[a] == self.doc[b]
        for k in range(n):
            equal &= self.codes[a + k] == self.codes[b + k]
        if equal.all():
            hit = np.zeros(len(at), bool)
            hit[order[same]] = hit[order[same + 1]] = True
            return at[hit]
        windows = np.column_stack([self.doc[at], *[self.codes[at + k] for k in range(n)]])  # hashes collide: compare the words
        _, which, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        return at[count[which.ravel()] > 1]


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of every text: words, their characters and symbols, repeated lines, words and characters in repeated n-grams."""
    codes, words, offsets = split_words(text, lower=False)
    text = pc.fill_null(text.cast(pa.large_string()), "")
    size = np.asarray(pc.utf8_length(words), dtype=np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    total = lambda v, o: sums(v, o).astype(np.int64)
    doc = np.repeat(np.arange(len(text)), np.diff(offsets))
    end = offsets[1:][doc]
    out = {"n_words": np.diff(offsets), "word_chars": total(size, offsets), "n_symbols": np.asarray(pc.count_substring_regex(text, SYMBOLS), dtype=np.int64)}

    lists = pc.split_pattern(text, "\n")
    lines, bounds = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    some = np.asarray(pc.not_equal(pc.ascii_trim_whitespace(lines), ""))
    which = np.asarray(pc.dictionary_encode(lines).indices, dtype=np.int64)
    key = np.repeat(np.arange(len(text)), np.diff(bounds)) * (which.max(initial=0) + 1) + which
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    again = some & ~first
    bare = np.asarray(pc.utf8_length(pc.replace_substring_regex(lines.filter(pa.array(again)), r"[\x20\x09-\x0D]+", "")), dtype=np.int64)
    chars = np.zeros(len(key), np.int64)
    chars[again] = bare
    out |= {"n_dup_lines": total(again, bounds), "dup_line_chars": total(chars, bounds)}

    rolling = Rolling(codes, doc)
    at = np.arange(len(codes))
    for n in sorted({*lengths, BASE_N}):
        at = rolling.repeated(n, at[at + n <= end[at]])  # a longer window repeats only where a shorter one does
        mark = _covered(len(codes), at, n)
        out[f"covered_{n}"] = total(size * mark, offsets)
        if n == BASE_N:
            out["n_repeat_words"] = total(mark, offsets)
    return out


def rules(docs: DataFrame, most_covered: dict[int, int] | None = None, most_in_lines: int = MOST_IN_LINES) -> DataFrame:
    """``docs`` (doc_id, text) with the base counts, base_failed, covered characters by n-gram length, failed rules and kept.

    ``most_covered`` gives the percentage of the words' characters that repeated
    n-grams of each length may cover, the first occurrence included;
    ``most_in_lines`` the percentage that lines equal to an earlier line may
    hold. A text at a bound passes. Null and empty texts have no words and fail
    the base rules. Texts are whole, however long; windows never cross texts.
    Every row is judged by its text alone, repeated rows each; other columns
    are ignored, and an empty table has no rows.
    """
    most = MOST_COVERED if most_covered is None else most_covered
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"covered_{n}" for n in sorted(most)]]

    def run(batches):
        for b in pieces(batches):
            got = measure(b.column("text"), tuple(most))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(got[c], pa.int64()) for c in names]], ["doc_id", *names])

    got = docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{c} long" for c in names]]))
    col = F.col
    failed = (col("n_words") < LEAST_WORDS) | (100 * col("n_repeat_words") > MOST_REPEATED * col("n_words"))
    tests = [F.when(100 * col(f"covered_{n}") > p * col("word_chars"), F.lit(f"repeated_{n}_grams")) for n, p in sorted(most.items())]
    tests.append(F.when(100 * col("dup_line_chars") > most_in_lines * col("word_chars"), F.lit("repeated_lines")))
    got = got.withColumn("base_failed", failed).withColumn("failed_rules", F.array_compact(F.array(*tests)))
    return got.withColumn("kept", ~col("base_failed") & (F.size("failed_rules") == 0))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = rules(docs).withColumn("failed_rules", F.array_join("failed_rules", ","))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *[f"covered_{n}" for n in sorted(MOST_COVERED)], "failed_rules")


def _oracle() -> str:
    lengths = sorted({*MOST_COVERED, BASE_N})
    ahead = ", ".join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, lengths[-1]))
    grams = ", ".join(f"word || {' || '.join(f"' ' || w{k}" for k in range(1, n))} AS g{n}" for n in lengths)
    dup = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 THEN 1 ELSE 0 END AS d{n}" for n in lengths)
    mark = ", ".join(f"max(d{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    cover = ", ".join(f"CAST(sum(c{n} * size) AS BIGINT) AS covered_{n}" for n in sorted(MOST_COVERED))
    zero = ", ".join(f"coalesce(covered_{n}, 0) AS covered_{n}" for n in sorted(MOST_COVERED))
    tests = [*[f"CASE WHEN 100 * covered_{n} > {p} * word_chars THEN 'repeated_{n}_grams' END" for n, p in sorted(MOST_COVERED.items())], f"CASE WHEN 100 * dup_line_chars > {MOST_IN_LINES} * word_chars THEN 'repeated_lines' END"]
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d), n AS (SELECT *, {ahead} FROM w), g AS (SELECT r, i, length(word) AS size, {grams} FROM n), u AS (SELECT r, i, size, {dup} FROM g), k AS (SELECT r, size, {mark} FROM u),
cv AS (SELECT r, CAST(sum(size) AS BIGINT) AS word_chars, CAST(sum(c{BASE_N}) AS BIGINT) AS n_repeat_words, {cover} FROM k GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
ln AS (SELECT r, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS BIGINT) AS dup_line_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY r),
a AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {zero} FROM d LEFT JOIN cv USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {', '.join(tests)}) AS failed_rules FROM a)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f"""


ORACLE_OP13 = _oracle()
