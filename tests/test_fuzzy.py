"""Fuzzy ratios of batches against plain tables of the longest common subsequence, and worked values."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import fuzzy


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    def one(s, t):
        return max((plain_ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t))), default=0.0) if s else 0.0

    s, t = sorted((a, b), key=len)
    return max(one(s, t), one(t, s)) if len(a) == len(b) else one(s, t)


def join(x):
    return " ".join(sorted(x))


def plain_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 100.0
    one, two = f"{join(x & y)} {join(x - y)}".strip(), f"{join(x & y)} {join(y - x)}".strip()
    return max(plain_ratio(one, two), *([plain_ratio(join(x & y), one), plain_ratio(join(x & y), two)] if x & y else [0.0]))


def plain_weighted(a, b):
    if not a or not b:
        return 0.0
    x, y = join(a.split()), join(b.split())
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(plain_ratio(a, b), 0.95 * max(plain_ratio(x, y), plain_set(a, b)))
    scale = 0.9 if longer < 8 else 0.6
    return max(plain_ratio(a, b), scale * plain_partial(a, b), 0.95 * scale * (100.0 if set(a.split()) & set(b.split()) else plain_partial(x, y)))


def names(seed, n, longest):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcé\U0001f600") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("longest", [3, 12, 60])  # the last: words of several lanes
def test_batches_equal_plain_tables(longest):
    pairs = list(zip(names(1, 60, longest), names(2, 60, longest), strict=True))
    pairs += [(a, a) for a, _ in pairs[:5]] + [(a, " ".join(reversed(a.split()))) for a, _ in pairs[:5]] + [(a, a + " " + b) for a, b in pairs[:5]] + [("", ""), ("", "a"), (" ", "a")]
    assert fuzzy.weighted_ratios(pairs) == pytest.approx([plain_weighted(a, b) for a, b in pairs])
    assert fuzzy.token_set_ratios(pairs) == pytest.approx([plain_set(a, b) for a, b in pairs])
    for a, b in pairs[:30]:
        assert fuzzy.ratio(a, b) == pytest.approx(plain_ratio(a, b)) and fuzzy.partial_ratio(a, b) == pytest.approx(plain_partial(a, b))


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("this is a test", "this is a test!", 200 * 14 / 29),
        ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0),
        ("yankees", "new york yankees", 90.0),
        ("new york mets", "new york mets vs atlanta braves", 90.0),
        ("abcd", "efgh", 0.0),
    ],
)
def test_weighted_ratio_of_known_pairs(a, b, want):
    assert fuzzy.weighted_ratio(a, b) == pytest.approx(want)


def test_filename_scores(spark):
    rows = [
        (1, "My.Show.S02E05.2019.720p.mkv", "http://h/x/My_Show-s02e05.2019.720p.mp4?x=1"),
        (2, "My.Show.S02E05.mkv", "http://h/My.Show.S02E06.mp4"),
        (3, "", "http://h/a.mp4"),
        (4, None, None),
        (5, "alpha beta.mkv", "gamma delta.mp4"),
        (6, "My.Show.S02E05.2019.720p.mkv", "http://h/x/My_Show-s02e05.2019.720p.mp4?x=1"),
    ]
    df = spark.createDataFrame(rows, "id int, scene string, url string")
    got = {r["id"]: r for r in fuzzy.filename_scores(df, F.col("scene"), F.col("url")).collect()}
    assert len(got) == 6 and got[1]["filename_score"] == got[6]["filename_score"] == 1.0 and got[1]["filename_bonus"] == pytest.approx(0.15)
    assert got[2]["filename_naive"] == pytest.approx(plain_weighted("my show s02e05", "my show s02e06") / 100)
    assert got[2]["filename_title"] == 1.0 and got[2]["filename_bonus"] == pytest.approx(0.03) and got[2]["filename_score"] == 1.0
    assert got[3]["filename_score"] == got[4]["filename_score"] == 0.0
    assert got[5]["filename_score"] == pytest.approx(max(plain_weighted("alpha beta", "gamma delta"), plain_set("alpha beta", "gamma delta")) / 100)
