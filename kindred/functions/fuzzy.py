"""Fuzzy ratios of names, whole Arrow batches at a time. Written from the public description of these ratios; agreement in every digit isn't claimed.

All ratios rest on the length of the longest common subsequence. A batch lists
the string pairs that its ratios ask for, takes their lengths together, bit by
bit in 64-bit words, and combines them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import name_fields, normalize_filename, structured_bonus, url_basename
from kindred.sources.package import ship

#: How ratios of reordered and of partial strings count against plain ones, and the lengths' ratios that decide.
REORDERED, PARTIAL, PARTIAL_FAR, LONGER, FAR = 0.95, 0.9, 0.6, 1.5, 8


def _codes(strings: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(strings), width), filler, np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences: rows of the table as bits, one step for each character of b."""
    wide, long = max(map(len, a), default=0), max(map(len, b), default=0)
    size = np.array([len(x) for x in a], np.int64)
    if not wide or not long:
        return np.zeros(len(a), np.int64)
    words = -(-wide // 64)
    x, y = _codes(a, words * 64, -1), _codes(b, long, -2)
    state = np.full((len(a), words), ~np.uint64(0))
    for j in range(long):
        mask = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)
        u = state & mask
        total = np.empty_like(state)
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            s = state[:, w] + u[:, w]
            over = s < u[:, w]
            s2 = s + carry
            carry = (over | (s2 < s)).astype(np.uint64)
            total[:, w] = s2
        state = total | (state - u)
    inside = np.arange(words * 64)[None, :] < size[:, None]
    zeros = np.unpackbits((~state).view(np.uint8), axis=1, bitorder="little").astype(bool)
    return (zeros & inside).sum(1)


class Ratios:
    """Asks for ratios of string pairs now and answers them together, each pair taken once."""

    def __init__(self) -> None:
        self.index: dict[tuple[str, str], int] = {}

    def ask(self, a: str, b: str) -> int:
        if len(a) > len(b):
            a, b = b, a
        return self.index.setdefault((a, b), len(self.index))

    def answer(self, at_once: int = 20_000) -> np.ndarray:
        """Indel similarity 0..100 of all pairs asked for."""
        pairs = list(self.index)
        out = np.empty(len(pairs))
        order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))  # alike lengths together
        for lo in range(0, len(order), at_once):
            which = order[lo : lo + at_once]
            a, b = [pairs[i][0] for i in which], [pairs[i][1] for i in which]
            total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
            out[which] = np.where(total > 0, 200.0 * _common(a, b) / np.maximum(total, 1), 100.0)
        return out


def _windows(a: str, b: str) -> list[str]:
    """The parts of the longer string that the shorter one is held against."""
    a, b = sorted((a, b), key=len)
    n = len(a)
    return [b[max(0, i) : i + n] for i in range(1 - n, len(b))] if n else []


def _ask_partial(asked: Ratios, a: str, b: str) -> list[int]:
    short, long = sorted((a, b), key=len)
    found = [asked.ask(short, w) for w in _windows(short, long)]
    return found + [asked.ask(long, w) for w in _windows(long, short)] if len(a) == len(b) else found


def _sorted(words) -> str:
    return " ".join(sorted(words))


def _ask_set(asked: Ratios, a: str, b: str) -> list[int] | float:
    """Questions whose best answer is the ratio of token sets, or the answer if it needs none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = _sorted(x & y), _sorted(x - y), _sorted(y - x)
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return [asked.ask(one, two), *([asked.ask(both, one), asked.ask(both, two)] if both else [])]


def _ask_weighted(asked: Ratios, a: str, b: str) -> list[tuple[float, list[int] | float]]:
    """(factor, questions): the best of the factors times their best answers."""
    if not a or not b:
        return []
    x, y = _sorted(a.split()), _sorted(b.split())
    found: list[tuple[float, list[int] | float]] = [(1.0, [asked.ask(a, b)])]
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < LONGER:
        return [*found, (REORDERED, [asked.ask(x, y)]), (REORDERED, _ask_set(asked, a, b))]
    scale = PARTIAL if longer < FAR else PARTIAL_FAR
    shared = set(a.split()) & set(b.split())
    return [*found, (scale, _ask_partial(asked, a, b)), (REORDERED * scale, 100.0 if shared else _ask_partial(asked, x, y))]


def _best(answers: np.ndarray, questions: list[int] | float) -> float:
    return questions if isinstance(questions, float) else max((answers[i] for i in questions), default=0.0)


def weighted_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    asked = Ratios()
    each = [_ask_weighted(asked, a, b) for a, b in pairs]
    answers = asked.answer()
    return [max((f * _best(answers, q) for f, q in e), default=0.0) for e in each]


def token_set_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    asked = Ratios()
    each = [_ask_set(asked, a, b) for a, b in pairs]
    answers = asked.answer()
    return [float(_best(answers, q)) for q in each]


def ratio(a: str, b: str) -> float:
    asked = Ratios()
    asked.ask(a, b)
    return float(asked.answer()[0])


def partial_ratio(a: str, b: str) -> float:
    asked = Ratios()
    questions = _ask_partial(asked, a, b)
    return float(_best(asked.answer(), questions))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a.split()), _sorted(b.split()))


def token_set_ratio(a: str, b: str) -> float:
    return token_set_ratios([(a, b)])[0]


def weighted_ratio(a: str, b: str) -> float:
    return weighted_ratios([(a, b)])[0]


def filename_scores(pairs: DataFrame, scene_name: Column, record_url: Column) -> DataFrame:
    """``pairs`` with filename_naive, filename_title, filename_bonus and filename_score: 0..1, what the names say and a bonus for agreeing fields, 1 at most.

    Names are normalized and parsed as columns; pairs of equal parsed names are
    scored once, however many rows have them, and equal names need no scoring
    at all. Empty names score 0 in a channel, null ones are empty.
    """
    ship(pairs.sparkSession)
    name = url_basename(record_url)
    rows = pairs.withColumns({"_fa": name_fields(scene_name), "_fb": name_fields(name)})
    title = lambda c: F.coalesce(F.col(c)["title"], F.lit(""))
    parsed = F.struct(normalize_filename(scene_name).alias("a"), normalize_filename(name).alias("b"), title("_fa").alias("ta"), title("_fb").alias("tb"))
    rows = rows.withColumns({"_names": parsed, "filename_bonus": structured_bonus(F.col("_fa"), F.col("_fb"))}).drop("_fa", "_fb")
    keys = ["a", "b", "ta", "tb"]
    asked = rows.select("_names.*").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                b = whole.slice(lo, 2_000)
                x, y, tx, ty = (b.column(k).to_pylist() for k in keys)
                naive, title = weighted_ratios(list(zip(x, y, strict=True))), token_set_ratios(list(zip(tx, ty, strict=True)))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array([v / 100 for v in naive]), pa.array([v / 100 for v in title])], [*keys, "filename_naive", "filename_title"])

    text = ", ".join(f"{k} string" for k in keys)
    scored = asked.mapInArrow(run, f"{text}, filename_naive double, filename_title double").select(F.struct(*keys).alias("_names"), "filename_naive", "filename_title")
    got = rows.join(scored, "_names").drop("_names")
    return got.withColumn("filename_score", F.least(F.lit(1.0), F.greatest("filename_naive", "filename_title") + F.col("filename_bonus")))
