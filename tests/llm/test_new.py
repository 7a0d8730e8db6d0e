"""Spelling variants, centroid clustering and quality rules against SQL and brute force, on small inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import centroid, quality, registry, variants

SF = "/root/testdata/sf0.001"
D = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_centroid", "op13_quality"])
def test_agrees_with_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows(got) == sorted(found, key=str)


# --- spelling variants ------------------------------------------------------------------
def brute_words(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_group(n):
    near = {w: sorted(((-n[x], x) for x in n if abs(len(x) - len(w)) < 2 and distance(x, w) == 1)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 5 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def test_variants_of_texts(spark):
    rng = random.Random(1)
    vocabulary = ["Straßeén", "colours", "colors", "abcabc", "abcabcabc", "aaaaaa", "aaaaaaa", "aaaaaaaa", "Àrbolito", "receive", "recieve", "shorts"]
    docs = [(i % 97 or None, " ".join(f"{rng.choice(vocabulary)}{rng.choice(['', ',', ' 7', '-x'])}" for _ in range(60))) for i in range(150)]
    docs += [(5, None), (6, ""), (7, "12 34 !"), (8, docs[0][1]), (8, docs[0][1]), (9, "colours " * 20_000)]
    df = spark.createDataFrame(docs, D).withColumns({"word": F.lit("w"), "n": F.lit(1), "root": F.lit("r")})
    n = brute_words(docs)
    assert any(len(w) < 8 and w.startswith("colour") for w in n)
    assert rows(variants.corpus_words(df)) == sorted(n.items(), key=str)
    assert rows(variants.spelling_variants(df)) == brute_group(n)


def test_near_words_of_every_kind_in_cold_and_hot_shards(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 9))): rng.choice([5, 5, 30, 30, 200, 1500]) for _ in range(260)}
    words |= {"template" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))): rng.choice([5, 40, 400]) for _ in range(80)}  # one half holds a third
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_group(words)
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)  # chains of forms
    assert rows(variants.group(df)) == want
    assert rows(variants.group(df, shard_rows=50, hot_owners=3)) == want
    hot = {"template" + "".join(rng.choice("klmnop") for _ in range(4)): 5 for _ in range(600)}
    got = variants.near_words(spark.createDataFrame(list(hot.items()), "word string, n long"), shard_rows=100, hot_owners=20)
    assert {r["word"]: r["n_near"] for r in got.collect()} == {w: k for w in hot if (k := sum(distance(w, x) == 1 for x in hot))}


def test_variants_of_nothing(spark):
    assert rows(variants.spelling_variants(spark.createDataFrame([], D))) == []
    assert rows(variants.spelling_variants(spark.createDataFrame([(1, None), (None, "a b")], D))) == []
    with pytest.raises(ValueError):
        variants.corpus_words(spark.createDataFrame([], D), least_length=1)


# --- centroid clustering ----------------------------------------------------------------
def brute_clusters(vectors, k, rounds, dims):
    kept = [(i, [math.floor(x * 256) if abs(x) < 2**40 else int(x) * 256 for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if of[j] else old for j, old in enumerate(c)]
    got = [(i, *nearest(v)) for i, v in kept]
    own = collections.Counter()
    for _, d, j in got:
        own[j] += d
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, j, fits(d), fits(own[j]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got), key=str)


def vectors_df(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit(1), "distance": F.lit("x"), "y": F.lit(2)})


def test_clusters_with_ties_repeats_and_odd_rows(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.randint(-2, 2) / 256 for _ in range(4)]) for i in range(120)]  # a coarse grid: many ties
    vectors += [(i, list(vectors[7][1])) for i in range(200, 260)] + [vectors[3], vectors[3], (None, [0.5, 0.1, -0.3, 0.0]), (None, [0.1, 0.1, -0.3, 0.0])]
    vectors += [(300, None), (301, [0.0] * 3), (302, [0.0] * 5), (303, [0.0, None, 0.0, 0.0]), (304, [math.inf, 0.0, 0.0, 0.0]), (305, [math.nan, 0.0, 0.0, 0.0]), (306, [])]
    assert rows(centroid.cluster(vectors_df(spark, vectors), k=9, rounds=3, dims=4)) == brute_clusters(vectors, 9, 3, 4)
    few = vectors[:3]
    assert rows(centroid.cluster(vectors_df(spark, few), k=9, rounds=3, dims=4)) == brute_clusters(few, 9, 3, 4)
    assert rows(centroid.cluster(vectors_df(spark, vectors[:0]), k=9, rounds=3, dims=4)) == []


def test_clusters_of_any_magnitude(spark):
    rng = random.Random(4)
    scale = [1e-3, 1.0, 3e4, 2e7, 1e12, 1e20, 3e38]
    vectors = [(i, [rng.choice([-1, 1]) * rng.random() * rng.choice(scale) for _ in range(4)]) for i in range(150)]
    assert rows(centroid.cluster(vectors_df(spark, vectors), k=6, rounds=3, dims=4)) == brute_clusters(vectors, 6, 3, 4)


def test_screen_is_rigorous():
    rng = np.random.default_rng(5)
    y = rng.integers(-40_000_000, 40_000_000, (400, 16)).astype(float)
    c = [[int(v) for v in y[i] + rng.integers(-2, 3, 16)] for i in rng.integers(0, 400, 30)]
    c += [[int(v) for v in r] for r in y[:20]] + [[int(v) for v in r] for r in y[:20]]
    got = centroid.Centroids(c, 16).nearest(y)
    want = [min((sum((int(a) - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))[1] for v in y]
    assert got.tolist() == want


# --- quality rules ----------------------------------------------------------------------
def brute_quality(text):
    text = text or ""
    spans = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    words = [m[0] for m in spans]
    seen, lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        bare = re.sub(r"[\x20\x09-\x0D]+", "", line)
        if bare and line in seen:
            lines, line_chars = lines + 1, line_chars + len(bare)
        seen.add(line)

    def covered(n):
        at = collections.defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        return {i + k for found in at.values() if len(found) > 1 for i in found for k in range(n)}

    chars, repeat = sum(map(len, words)), len(covered(8))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    by_n = [sum(len(words[i]) for i in covered(n)) for n in sorted(quality.MOST_COVERED)]
    broken = [f"repeated_{n}_grams" for n, c in zip(sorted(quality.MOST_COVERED), by_n) if 100 * c > quality.MOST_COVERED[n] * chars]
    broken += ["repeated_lines"] if 100 * line_chars > quality.MOST_IN_LINES * chars else []
    return (len(words), chars, len(re.findall("[#*$%&|<>]", text)), lines, repeat, failed, not failed and not broken, line_chars, *by_n, ",".join(broken))


def test_quality_against_brute_force(spark):
    rng = random.Random(6)
    pick = lambda n, m: " ".join(rng.choice(["a", "b", "éé", "x#y", "\U0001f600", "w v"]) + str(rng.randint(0, m)) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "a b\na b\n a b\n\n\na b", "x " * 19, "x " * 20, pick(20, 9**9), pick(40, 2), pick(3000, 3), "\n".join([pick(10, 99)] * 3 + [pick(9, 99)] * 2), "# * $ % & | < >\r\n# \x1c  "]
    passage = pick(12, 9**9)
    texts += [f"{passage} {pick(k, 9**9)} {passage}" for k in (1, 24, 54, 55, 56, 57, 80)] + [pick(200, 9**9) + " " + p for p in (passage, passage)]
    texts += [f"{pick(300, 9**9)}\n{passage}\n" * 2, "aa " * 50_000, pick(40_000, 9**9) + " " + pick(40_000, 3)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1, texts[-4]), (1, texts[-4]), (None, texts[8])]
    df = spark.createDataFrame(docs, D).withColumns({"n_words": F.lit(0), "kept": F.lit("no"), "word_chars": F.lit(1)})
    got = quality.rules(df).withColumn("failed_rules", F.array_join("failed_rules", ","))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *[f"covered_{n}" for n in sorted(quality.MOST_COVERED)], "failed_rules"]
    assert rows(got.select(*columns)) == sorted(((i, *brute_quality(t)) for i, t in docs), key=str)
    assert rows(quality.rules(df.limit(0))) == []


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality, "_mixed", lambda x: np.zeros(len(x), np.uint64))
    codes = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    doc = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1])
    assert quality.Rolling(codes, doc).repeated(2, np.array([0, 1, 2, 3, 4, 6, 7])).tolist() == [0, 3]


def test_clean_documents_stay():
    text = spark_free_prose()
    got = quality.measure(text, tuple(quality.MOST_COVERED))
    assert (got["covered_5"] == 0).all()


def spark_free_prose():
    import pyarrow as pa

    rng = random.Random(7)
    return pa.array([" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)) for _ in range(20)])


def test_strips_are_shuffled_once(spark):
    """op1: strips went through a shuffle to be counted and another to their shards, and both stayed on disk."""
    from kindred.llm import lmscore

    df = spark.createDataFrame([(b"same",)] * 100 + [(f"{i}".encode(),) for i in range(200)], "blob binary")
    packed = lmscore.deal(df, 10).groupBy("shard").applyInArrow(lmscore._pack, "rows binary")
    assert packed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
    rows = lmscore.deal(df, 10).collect()
    assert len({(r["shard"], r["blob"]) for r in rows}) == len(rows) < 300 and sum(r["weight"] for r in rows) == 300
    hot = [r["weight"] for r in rows if r["blob"] == b"same"]
    assert len(hot) == 10 and 8 <= min(hot) and max(hot) <= 12


def test_stars_cost_components_one_minimum(spark):
    """pipeline: every step of components() was a few more jobs, exchanges and threads in the driver, two whole rounds of them for edges that were stars."""
    from kindred.llm import common
    from kindred.llm.graph import components

    before = len(common.written_so_far())
    stars = components(spark.createDataFrame([(i, i % 5) for i in range(5, 60)] + [(3, 8), (2, 2)], "a long, b long"))
    assert dict(map(tuple, stars.collect())) == {i: i % 5 for i in range(60)} and stars.count() == 60
    assert len(common.written_so_far()) - before == 2  # the edges and the minima
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(low) and dict(map(tuple, found)) == low


def test_strips_are_cut_from_the_pieces_when_dealt():
    """op1: the strips of all training texts lay on disk beside the pieces that hold the same texts, until the end."""
    import numpy as np
    import pyarrow as pa

    from kindred.llm import attention, lmscore

    with open(lmscore.VOCABULARY, "rb") as file:
        lines = [x for x in file.read().splitlines() if int(x.split()[1]) < 512]
    shared = type("Shared", (), {"value": (lines, 512)})
    texts = [" ".join(f"word{i % 97}" for i in range(900)), "held out", None, "A short text"]
    batch = pa.record_batch({"doc_id": [1, 2, 3, 4], "held_out": [False, True, False, False], "text": texts, "train": [True, False, True, True]})
    prepared = [r for b in lmscore._prepare(shared, 12_000_000)([batch]) for r in b.to_pylist()]
    assert not any(r["blob"] for r in prepared if r["kind"] == "s")
    pieces = pa.record_batch({"blob": [r["blob"] for r in prepared if r["kind"] == "d"]})
    got = [x for b in lmscore._strips(512, 1)([pieces]) for x in b.column("blob").to_pylist()]
    subwords = lmscore.Subwords(lines, 512)
    ids = [np.r_[subwords.encode((t or "").lower().split())[0], 512].astype(np.int32) for t in (texts[0], texts[2], texts[3])]
    assert got == [x for i in ids for x in lmscore.strips(i, 512)]
    assert sum(r["n"] for r in prepared if r["kind"] == "s") == sum(-(-len(i) // attention.STEP) for i in ids)


def test_settled_groups_need_no_pairs_across(spark, monkeypatch):
    """pipeline: near_duplicates went through all its rounds, some 20 jobs, where no bucket held several components any more."""
    from kindred.llm import neardup

    def never(*_):
        raise AssertionError("no bucket holds several components")

    monkeypatch.setattr(neardup, "across", never)
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, "x"])), (4, "another text of its own words"), (5, None)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_driver_returns_freed_native_memory(spark):
    """pipeline: what compiling many plans freed stayed with the driver's process, more after each stage."""
    from kindred.llm import common

    version = [int(x) for x in spark._jvm.System.getProperty("java.version").split("-")[0].split(".")]
    if version < [17, 0, 9] or spark._jvm.System.getProperty("os.name") != "Linux":
        pytest.skip("this JVM has no such command")
    assert "rim" in common.trim(spark)
    common.sweep(spark)


def test_gradient_by_plain_exponentials():
    """op1: training went through maxima and whole-array masks that plain exponentials spare; they are taken again only where numbers get too large."""
    from kindred.llm import attention

    rng = np.random.default_rng(5)
    lens = np.array([3, 0, 200, 64, 31])
    ids = rng.integers(0, 40, lens.sum()).astype(np.int32)
    x, y, _ = attention.cut(ids, np.concatenate([[0], np.cumsum(lens)]), 40, 41)
    weight = rng.integers(1, 4, len(x)).astype(float)
    for size in (1.0, 300.0):  # the second overflows
        m = attention.Attention(41, rng.integers(0, 5, (41, 41)).astype(float), dim=4, classes=6)
        for name in ("q", "k", "c", "w"):
            m.p[name] *= np.float32(size)
        loss, g = m.gradient(x, y, weight)
        sure, exact = m.gradient(x, y, weight, careful=True)
        assert np.isfinite(loss) and loss == pytest.approx(sure, rel=1e-5)
        for name, t in g.items():
            assert t.shape == m.p[name].shape and np.isfinite(t).all(), name
            np.testing.assert_allclose(t, exact[name], rtol=1e-3, atol=1e-5)
        # careful or not, the weights are those of the softmax with maxima taken off
        s, inv, _, _, _, got = m._forward(x)
        a, _, _, _, hidden = m._attend(x)
        ok = y != m.pad
        np.testing.assert_allclose((got + m.p["r"][x[:, attention.STEP :]])[ok], hidden[ok], rtol=1e-3, atol=1e-4)
        np.testing.assert_allclose((s * inv)[ok], a[ok], rtol=1e-3, atol=1e-5)


def test_words_travel_by_bucket(spark):
    """op1: every word of every piece was a row of its own, which most of the JVM's time and an executor's memory went to."""
    import pyarrow as pa

    from kindred.llm import lmscore

    with open(lmscore.VOCABULARY, "rb") as file:
        lines = [x for x in file.read().splitlines() if int(x.split()[1]) < 512]
    shared = type("Shared", (), {"value": (lines, 512)})
    texts = [[" ".join(f"w{i} é{i % 50}" for i in range(k * 500, k * 500 + 2000)), "held only", None, "w1"] for k in range(2)]
    rows, held = [], [False, True, False, False]
    for t in texts:
        batch = pa.record_batch({"doc_id": [1, 2, 3, 4], "held_out": held, "text": t, "train": [not h for h in held]})
        mine = [r for b in lmscore._prepare(shared, 12_000_000)([batch]) for r in b.to_pylist() if r["kind"] == "w"]
        assert len(mine) <= lmscore.BUCKETS and sum(r["n"] for r in mine) == len({w for x in t for w in (x or "").split()})
        rows += mine
    want = collections.Counter(w for t in texts for x, h in zip(t, held, strict=True) if not h for w in (x or "").split())
    total = seen = 0
    for code in sorted({r["code"] for r in rows}):
        some = [r for r in rows if r["code"] == code]
        got = lmscore._count_words(None, pa.table({k: [r[k] for r in some] for k in ("part", "code", "n", "blob")})).to_pylist()
        for r, g in zip(some, got, strict=True):
            words, _ = lmscore.unpack_words([r["blob"]], [r["n"]])
            assert g["piece"] == r["part"] and [want[w] for w in words.to_pylist()] == np.frombuffer(g["blob"], np.int64).tolist()
        total, seen = total + sum(g["n"] for g in got), seen + sum(g["v"] for g in got)
    assert (total, seen) == (sum(want.values()), len(want))


def test_rows_of_an_id_are_added_in_blocks():
    """op1: the gradients of ids are sums over all places that show them, however many."""
    from kindred.llm import attention

    m = attention.Attention(41, np.ones((41, 41)), dim=4, classes=6)
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 500):
        ids, rows = rng.integers(0, 5, n) * 8, np.zeros((n + 1, 8), np.float32)
        rows[:n] = rng.standard_normal((n, 8))
        want = np.zeros((42, 8))
        np.add.at(want, ids, rows[:n])
        np.testing.assert_allclose(m._by_id(ids, rows), want, rtol=1e-4, atol=1e-5)


def test_memory_of_arrays_is_kept_within():
    """op1: arrays freed by one step were taken from the system, page by page, in the next."""
    import pathlib
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from kindred.llm.common import roomy
with roomy():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(20):
        some = [np.ones(750_000) for _ in range(5)]
        del some
    print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    if not sys.platform.startswith("linux"):
        pytest.skip("another C library")
    done = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parents[2], capture_output=True, text=True, timeout=120, check=True)
    assert int(done.stdout) < 10_000  # of 146,000 pages; 36,000 without
