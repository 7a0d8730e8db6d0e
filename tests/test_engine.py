"""Exact expectations of the matching engine on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kindred.functions import fuzzy, images, similarity, text
from kindred.operators import corpus, evaluate, match, scoring, store
from kindred.sources import assets
from kindred.streaming import lifecycle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("m, want", [(0.75, 0.25), (0.5, 0.0), (0.2, 0.0), (1.0, 1.0)])
def test_sharpen(spark, m, want):
    assert one(spark, similarity.sharpen(F.lit(m), F.lit(0.5), 2.0)) == pytest.approx(want)


def test_aggregate_channel(spark):
    assert one(spark, scoring.aggregate_channel(F.lit(0.7), F.lit(0.6), F.lit(0.5), 2.0)) == pytest.approx(0.096)


def test_compose(spark):
    c = lambda *s: one(spark, scoring.compose({n: F.lit(v) for n, v in zip("abc", s, strict=True)}, 0.3, 0.1)[0])
    assert c(0.7, 0.5, 0.4) == pytest.approx(0.9)
    assert c(0.95, 0.9, 0.9) == 1.0
    assert c(0.1, 0.2, 0.0) == 0.0


def test_frame_channel(spark):
    rows = [("s", m, 1.0, 1.0, 0.5) for m in (0.9, 0.8, 0.3)]
    got = scoring.frame_channel(spark.createDataFrame(rows, "k string, m double, quality double, uniqueness double, baseline double"), ["k"], 2.0, 2.0).first()
    mp = [0.64, 0.36, 0.0]
    e = 1 - math.prod(1 - x for x in mp)
    p = [x / sum(mp) for x in mp[:2]]
    d = 0.5 + 0.5 * -sum(x * math.log(x) for x in p) / math.log(2)
    assert got["evidence"] == pytest.approx(e) and got["count_conf"] == pytest.approx(1 - math.exp(-1.5)) and got["dist_q"] == pytest.approx(d)
    single = scoring.frame_channel(spark.createDataFrame([("s", 0.9, None, None, None)], "k string, m double, quality double, uniqueness double, baseline double"), ["k"]).first()
    assert single["dist_q"] == 0.5


def test_similarities(spark):
    a, b = F.array(F.lit(0).cast("long")), F.array(F.lit(0xFF).cast("long"))
    assert one(spark, similarity.hamming_similarity(a, b, 64)) == 1 - 8 / 64
    assert one(spark, similarity.hamming_similarity(F.lit(None).cast("array<long>"), b, 64)) == 0
    assert one(spark, similarity.degenerate_hash(a, 64)) is True
    flat, spike = F.array(*[F.lit(4)] * 64), F.array(F.lit(255), *[F.lit(0)] * 63)
    assert one(spark, similarity.gini_quality(flat)) == pytest.approx(1.0, abs=0.02)
    assert one(spark, similarity.gini_quality(spike)) < 0.05
    assert one(spark, similarity.histogram_intersection(spike, F.array(F.lit(0), F.lit(255), *[F.lit(0)] * 62))) == 0
    assert one(spark, similarity.tone_similarity(flat, flat)) == 1
    assert one(spark, similarity.tone_similarity(flat, F.array(F.lit(1)))) == 0


def test_median_aggregate_ignores_an_outlier(spark):
    rows = [(1, [10, 0, 10]), (1, [10, 0, 10]), (1, [0, 99, 0]), (2, [0, 0, 0])]
    got = {r["k"]: r["h"] for r in corpus.median_aggregate(spark.createDataFrame(rows, "k int, h array<long>"), ["k"], "h").collect()}
    assert got[1] == [128, 0, 128] and got[2] == [0, 0, 0]


def test_uniqueness_of_a_shared_logo(spark):
    base = list(range(0, 256, 4))
    rows = [(1, "a", 0, base), (1, "logo", 0, base[::-1]), (1, "b", 1, [255] * 64), (1, "logo", 1, base[::-1]), (1, "c", 2, [0] * 64)]
    got = {r["ref"]: r["uniqueness"] for r in corpus.uniqueness(spark.createDataFrame(rows, "job int, ref string, record int, blob array<long>")).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0, "logo": 0.5}


def test_baseline_without_pairs(spark):
    rows = [(1, 1, 0, [1, 2]), (2, 2, 0, [1, 2]), (2, 3, 0, [1, 2])]
    got = corpus.baseline(spark.createDataFrame(rows, "job int, ref long, record int, blob array<long>"), {"baseline": similarity.tone_similarity(F.col("blob"), F.col("blob2"))})
    assert {r["job"]: r["baseline"] for r in got.collect()} == {1: 0.5, 2: 0.5}


@pytest.mark.parametrize("a, b, want", [("2020-05-06", "2020/5/6", 1.0), ("2020-05", "2020-05-06", 0.5), ("2020-05", "2020-05", 0.5), ("2020", "2020", 0.2), ("2020", "2021", 0.0), (None, "2020", 0.0), ("2020-05-06T10:00:00", "2020-05-06", 1.0), ("x", "x", 0.0)])
def test_date_score(spark, a, b, want):
    assert one(spark, text.date_score(F.lit(a), F.lit(b))) == want


def test_names(spark):
    n = lambda x: one(spark, text.normalize_filename(F.lit(x)))
    assert n("https://h/a/My_Great-Scene%20One.mp4?x=1#y") == "my great scene one"
    assert n("a+b.mkv") == "a+b" and n("") == "" and n(None) == "" and n(".hidden") == "hidden"
    assert one(spark, text.url_basename(F.lit("https://host"))) == ""
    assert one(spark, text.sanitize_details(F.lit(" a \t b\r\n\n c "))) == "a b\n c"
    assert one(spark, text.sanitize_details(F.lit(" \n "))) is None
    f = one(spark, text.name_fields(F.lit("The.Show.S02E05.2019.1080p.mkv")))
    assert (f["title"], f["year"], f["season"], f["episode"], f["screen_size"]) == ("The Show", 2019, 2, 5, "1080p")
    assert one(spark, text.resolve_asset(F.lit("./x/y.jpg"), "http://e", F.lit("j1"))) == "http://e/j1/assets/y.jpg"
    assert one(spark, text.systematic_sample(F.array(*[F.lit(i) for i in range(10)]), 4)) == [0, 2, 5, 7]
    assert one(spark, text.same_folded(F.lit(" Straße"), F.lit("STRASSE "))) is True


def test_fuzzy():
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.ratio("abc", "xyz") == 0
    assert fuzzy.token_set_ratio("a b c", "c b a d") == 100
    assert fuzzy.token_sort_ratio("new york mets", "mets york new") == 100
    assert fuzzy.partial_ratio("yankees", "new york yankees") == 100
    assert fuzzy.weighted_ratio("", "a") == 0


def _candidates(spark, rows):
    return spark.createDataFrame(rows, "scene_id int, job_id string, result_index int, image double, code_hit boolean, title_hit boolean, date double, filename double, performer double")


def test_search_orders_limits_then_drops_zeros(spark):
    rows = [(1, "b", 0, 0.5, False, False, 0.0, 0.0, 0.0), (1, "a", 1, 0.5, False, False, 0.0, 0.0, 0.0), (1, "a", 0, 0.0, True, True, 0.0, 0.0, 0.0), (1, "c", 0, 0.0, False, False, 0.0, 0.0, 0.0)]
    got = [(r["job_id"], r["result_index"], r["score"]) for r in match.search(_candidates(spark, rows), limit=4).orderBy("rank").collect()]
    assert got == [("a", 0, 1.0), ("a", 1, 0.5), ("b", 0, 0.5)]
    assert match.search(_candidates(spark, rows[:2]), floor=0.6).count() == 0
    assert match.search(_candidates(spark, rows), floor=0.6).count() == 1


def test_scrape_takes_the_first_tier_that_fires(spark):
    rows = [(1, "a", 0, 0.9, False, False, 0.0, 0.0, 0.0), (1, "b", 0, 0.0, True, False, 0.0, 0.0, 0.0), (2, "a", 0, 0.9, False, False, 0.0, 0.0, 0.0), (2, "a", 1, 0.9, False, False, 0.0, 0.0, 0.0), (3, "a", 0, 0.1, False, False, 0.0, 0.0, 0.0)]
    c = _candidates(spark, rows)
    got = {r["scene_id"]: (r["job_id"], r["result_index"], r["tier"]) for r in match.scrape(c, c.select("scene_id", "job_id", "result_index", "image")).collect()}
    assert got == {1: ("b", 0, 1), 2: ("a", 0, 3)}


def test_signals(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, match.code_fires(F.lit(" X1 "), F.lit("X1"), t)) is True
    assert one(spark, match.code_fires(F.lit("X1"), F.lit("X1"), f)) is False
    assert one(spark, match.title_fires(F.lit(" T "), F.lit("T"))) is True
    assert one(spark, match.title_fires(F.lit("T"), F.lit(" T"))) is False
    assert one(spark, match.schema_superset(F.array(*[F.lit(x) for x in [*match.REQUIRED, "more"]]))) is True


def test_studio_narrow(spark):
    scenes = spark.createDataFrame([(1, "Acme "), (2, None), (3, "none")], "scene_id int, studio string")
    jobs = spark.createDataFrame([("j1", "ACME"), ("j2", "Other")], "job_id string, job_name string")
    got = sorted(tuple(r) for r in match.studio_narrow(scenes, jobs).collect())
    assert got == [(1, "j1", True), (2, "j1", False), (2, "j2", False)]


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, at int, v string")
    assert sorted(tuple(r) for r in store.upsert_latest(old, new, ["k"], ["at"]).collect()) == [("a", 2, "z"), ("b", 1, "y")]
    rows = spark.createDataFrame([(i, 100, None if i == 19 else f"2024-01-01 00:00:{i:02d}") for i in range(20)], "id int, bytes int, at string").withColumn("last_accessed_at", F.to_timestamp("at"))
    kept = {r["id"] for r in store.lru_evict(rows, 1000, ["id"]).collect()}
    assert kept == set(range(9, 19))
    wanted = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("d", "f")], "k string, fingerprint string")
    have = spark.createDataFrame([("a", "f", 0.5), ("b", "f", -1.0), ("c", "old", 0.5)], "k string, fingerprint string, quality double")
    assert {r["k"]: r["state"] for r in store.cache_state(wanted, have, ["k"]).collect()} == {"a": "hit", "b": "failed", "c": "miss", "d": "miss"}


def test_upserts_of_equal_times(spark):
    f = "source string, ref_id string, channel string, algorithm string, feature_blob binary, computed_at string, last_accessed_at string"
    row = lambda ref, blob, at: ("stash_cover", ref, "tone", "a", bytearray(blob), at, None)
    old = spark.createDataFrame([row("a", b"old", "1"), row("b", b"old", "2"), row("c", b"x", "1"), row("c", b"y", "1")], f)
    new = spark.createDataFrame([row("a", b"new", "1"), row("b", b"new", "1")], f)
    got = {r["ref_id"]: (bytes(r["feature_blob"]), r["last_accessed_at"]) for r in store.upsert_features(old, new.drop("last_accessed_at")).collect()}
    assert got["a"] == (b"new", "1") and got["b"] == (b"old", None) and len(got) == 3
    again = {r["ref_id"]: bytes(r["feature_blob"]) for r in store.upsert_features(old.orderBy(F.desc("feature_blob")).repartition(3), new.drop("last_accessed_at")).collect()}
    assert again["c"] == got["c"][0]


def test_near_tones_are_all_found(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 256, (12, 64))
    tones = np.clip(centres[rng.integers(0, 12, 150)] + rng.integers(-40, 41, (150, 64)), 0, 255)
    rows = [(i % 2, i, t.tolist()) for i, t in enumerate(tones)] + [(0, 900, tones[0].tolist()), (0, 901, [255] * 64), (0, 902, [250] * 63), (0, 903, [0] * 64), (0, 0, tones[0].tolist())]
    for threshold in (0.8, 0.9, 1.0):
        near = lambda a, b: len(a) == len(b) and 1 - sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a) / 255 >= threshold  # noqa: E731, B023
        want = {(j, r, s) for j, r, t in rows for k, s, u in rows if j == k and r != s and near(t, u)}
        got = [tuple(r) for r in corpus.tone_pairs(spark.createDataFrame(rows, "job int, ref int, blob array<long>"), threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_lifecycle(spark):
    states = spark.createDataFrame([("a", "ready", 1.0), ("b", "featurizing", 0.0), ("c", "failed", 0.2), ("e", "featurizing", 0.5), ("f", "ready", 1.0)], "job_id string, state string, progress double")
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job_id string")
    assert {r["job_id"] for r in lifecycle.not_ready(jobs, states).collect()} == {"b", "c", "d"}
    assert tuple(lifecycle.fleet_counts(states).first()) == (2, 1, 1, 1)
    assert {r["job_id"] for r in lifecycle.to_enqueue(jobs.union(jobs), states).collect()} == {"c", "d"}
    got = lifecycle.retry_after(states.withColumn("g", F.lit(1)), "g").first()["retry_after"]
    assert got == 40


def test_metrics(spark):
    results = spark.createDataFrame([(1, 7, 1, 0.9), (2, 8, 2, 0.5), (2, 9, 1, 0.6), (4, 1, 1, 0.3)], "scene_id int, record int, rank int, score double")
    truth = spark.createDataFrame([(1, 7, False), (2, 8, False), (3, 5, False), (4, None, True), (5, None, True)], "scene_id int, expected int, negative boolean")
    m = evaluate.match_metrics(evaluate.rank_of_expected(results, truth)).first()
    assert m["precision_at_1"] == pytest.approx(1 / 3) and m["mrr"] == pytest.approx(0.5) and m["negatives_empty"] == 1


def test_vtt(spark):
    vtt = "WEBVTT\n\n00:00:01.500 --> 00:00:02.000\nsprite.jpg#xywh=0,0,160,90\nbad\n\n00:00:03.000 --> 00:00:04.000\nsprite.jpg#xywh=160,0,160,90\n"
    got = [tuple(r) for r in assets.vtt_cues(spark.createDataFrame([("s", vtt)], "ref string, vtt string")).orderBy("position").collect()]
    assert got == [("s", 0, 1.5, 0, 0, 160, 90), ("s", 1, 3.0, 160, 0, 160, 90)]


def test_image_kernels():
    rng = np.random.default_rng(1)
    rgb = (np.linspace(0, 220, 256)[None, :, None] + rng.integers(0, 30, (256, 256, 1))).astype(np.uint8).repeat(3, 2)
    boxed = np.zeros((320, 256, 3), np.uint8)
    boxed[32:288] = rgb
    assert images.letterbox(boxed) == (32, 288, 0, 256)
    for name, f in images.HASHES.items():
        a, b = f(images.normalize(rgb), 8), f(images.normalize(boxed), 8)
        assert a.shape == (8, 8) and (a != b).sum() <= 2, name
    assert len(images.lanes(images.phash(images.normalize(rgb), 16))) == 4
    assert sum(images.colour_histogram(rgb)) == pytest.approx(255, abs=8)
    assert len(images.tone(images.normalize(rgb))) == 64


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        raw = b"".join(b"\0" + row.tobytes() for row in a)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    a = np.random.default_rng(0).integers(0, 255, (40, 60, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(a))
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = images.image_features(assets.decoded_images(spark, str(tmp_path)), size=8).collect()
    assert len(got) == 1 and len(got[0]["tone"]) == 64 and got[0]["histogram"] == images.colour_histogram(a)


def test_state_stream(spark, tmp_path):
    schema = "job_id string, kind string, progress double"
    spark.createDataFrame([Row(job_id="a", kind="enqueue", progress=0.0), Row(job_id="b", kind="progress", progress=0.5)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = lifecycle.track_states(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["job_id"]: r["state"] for r in spark.table("states").collect()} == {"a": "featurizing", "b": "absent"}


def test_change_stream(spark, tmp_path):
    schema = "job_id string, completed_at string"
    spark.createDataFrame([("a", "1"), ("a", "2")], schema).coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    lifecycle.refeaturize_on_change(spark.readStream.schema(schema).json(str(tmp_path / "in")), lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [("a", "2")]


def test_registry_runs_without_extras(spark):
    import __spark_entry__ as entry

    assert "search_ranked" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    got = entry.queries()["degenerate_hash"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0
