"""Features computed once, sprites, scenes' aggregates and the older table of hashes, on hand-made files and sheets."""

import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import images
from kindred.operators import featurize
from kindred.sources import assets

NOW = "2024-01-01"


def png(a):
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def noise(seed, h=40, w=60):
    return np.random.default_rng(seed).integers(0, 255, (h, w, 3), dtype=np.uint8)


def key(r):
    return r["source"], r["ref_id"], r["fingerprint"], r["channel"]


@pytest.fixture
def folder(tmp_path):
    for name, a in (("a", noise(1)), ("b", noise(2)), ("other", noise(3, 30, 30)), ("flat", np.full((30, 30, 3), 90, np.uint8))):
        (tmp_path / f"{name}.png").write_bytes(png(a))
    (tmp_path / "broken.png").write_bytes(b"no image")
    return tmp_path


def wanted(spark, folder, rows):
    return spark.createDataFrame([("extractor_image", ref, fp, f"{folder}/{file}") for ref, fp, file in rows], "source string, ref_id string, fingerprint string, path string")


def test_features_are_computed_once(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    pictures = assets.decoded_images(spark, str(folder / "*.png"), broken=True)
    want = wanted(spark, folder, [("1:a", "f", "a.png"), ("2:a", "f", "a.png"), ("1:a", "f", "a.png"), ("1:b", "f", "b.png"), ("1:flat", "f", "flat.png"), ("1:bad", "f", "broken.png"), ("1:gone", "f", "gone.png"), ("1:no", "", "other.png"), ("1:null", None, "other.png")])
    assert featurize.featurize_into(store, want, pictures, size=8, now=NOW) == 18  # six references, three channels
    got = {key(r)[1::2]: r for r in featurize.stored_features(spark, store).collect()}
    expected = images.features_of(np.stack([noise(1)]), "phash", 8)[0]
    for ref in ("1:a", "2:a"):
        assert got[ref, "phash"]["feature"] == expected[0] and got[ref, "phash"]["quality"] == pytest.approx(expected[1])
        assert got[ref, "color_hist"]["feature"] == expected[2] and got[ref, "tone"]["feature"] == expected[3]
    assert {k for k, r in got.items() if r["quality"] == -1} == {("1:flat", "phash")} | {(x, c) for x in ("1:bad", "1:gone") for c in ("phash", "color_hist", "tone")}
    assert {r["algorithm"] for r in got.values()} == {"phash:8", "color_hist:hsv:4x4x4", "tone:gray:8x8"}

    assert featurize.featurize_into(store, want, pictures, size=8, now=NOW) == 0  # the second run computes nothing
    none = assets.decoded_images(spark, str(folder / "other.png")).limit(0)
    assert featurize.featurize(want, featurize.stored_features(spark, store), none, size=8).count() == 0
    # another size lacks its hashes only, a new fingerprint everything
    assert {r["channel"] for r in featurize.featurize(want, featurize.stored_features(spark, store), pictures, size=16).collect()} == {"phash"}
    changed = wanted(spark, folder, [("1:a", "new", "b.png"), ("1:b", "f", "b.png")])
    assert featurize.featurize_into(store, changed, pictures, size=8, now=NOW) == 3

    states = featurize.resolve(want.dropDuplicates(), featurize.stored_features(spark, store), featurize.algorithm_keys(size=8)).collect()
    of = {(r["ref_id"], r["channel"]): r["state"] for r in states}
    assert of["1:a", "tone"] == "hit" and of["1:flat", "phash"] == "failed" and of["1:flat", "tone"] == "hit" and of["1:no", "tone"] == "miss"
    assert all((r["feature"] is not None) == (r["state"] == "hit") for r in states)


def test_only_lacking_channels_are_computed(spark, folder):
    stored = spark.createDataFrame([("extractor_image", "1:a", "f", "tone", "tone:gray:8x8", [7], 0.5, None), ("extractor_image", "1:b", "f", "color_hist", "color_hist:hsv:4x4x4", [], -1.0, None)], featurize.STORED)
    lack = featurize.missing(wanted(spark, folder, [("1:a", "f", "a.png"), ("1:b", "f", "b.png")]), stored, featurize.algorithm_keys())
    assert {r["ref_id"]: sorted(r["channels"]) for r in lack.collect()} == {"1:a": ["color_hist", "phash"], "1:b": ["phash", "tone"]}


SHEET = np.concatenate([np.concatenate([noise(10, 20, 30), np.full((20, 30, 3), 200, np.uint8)], 1), np.concatenate([noise(11, 20, 30), noise(12, 20, 30)], 1)], 0)
TILES = [SHEET[:20, :30], SHEET[:20, 30:], SHEET[20:, :30], SHEET[20:, 30:]]
BOXES = [(0, 0), (30, 0), (0, 20), (30, 20)]
VTT = "WEBVTT\n\n" + "\n\n".join(f"00:00:{i:02d}.000 --> 00:00:{i + 1:02d}.000\nsheet.jpg#xywh={x},{y},30,20" for i, (x, y) in enumerate(BOXES)) + "\n"


def sheets(spark, *rows):
    return spark.createDataFrame([(ref, *a.shape, bytearray(a[:, :, ::-1].tobytes())) if a is not None else (ref, -1, -1, -1, None) for ref, a in rows], "ref string, height int, width int, channels int, pixels binary")


def test_sprite_tiles_have_the_features_of_their_pixels(spark):
    cues = assets.vtt_cues(spark.createDataFrame([("s", VTT), ("t", "data:text/vtt;base64," + base64.b64encode(VTT.encode()).decode()), ("broken", VTT), ("empty", "")], "ref string, vtt string"))
    got = {(r["ref"], r["position"]): r for r in images.sprite_features(sheets(spark, ("s", SHEET), ("t", SHEET), ("broken", None), ("empty", SHEET)), cues, sample=0, size=8).collect()}
    assert set(got) == {(s, i) for s in "st" for i in range(4)}
    for i, tile in enumerate(TILES):
        want = images.features_of(tile[None], "phash", 8, refuse_flat=False)[0]
        for s in "st":
            r = got[s, i]
            assert (r["start"], r["lanes"], r["histogram"], r["tone"]) == (float(i), want[0], want[2], want[3])
            assert r["hash_quality"] == pytest.approx(want[1]) and r["tone_quality"] == pytest.approx(want[4])
    assert got["s", 1]["lanes"] is not None and got["s", 1]["hash_quality"] == 0  # an even tile is hashed too
    some = images.sprite_features(sheets(spark, ("s", SHEET)), cues, sample=3, size=8).collect()
    assert sorted(r["position"] for r in some) == [0, 1, 2]


def test_boxes_beyond_the_sheet_are_black_there(spark):
    a = noise(20, 10, 10)
    assert (images.crop(a, 6, 7, 8, 6)[:3, :4] == a[7:, 6:]).all() and images.crop(a, 6, 7, 8, 6)[3:].sum() == 0 and images.crop(a, 6, 7, 8, 6)[:, 4:].sum() == 0
    assert (images.crop(a, -2, -1, 5, 4)[1:, 2:] == a[:3, :3]).all() and images.crop(a, -2, -1, 5, 4)[0].sum() == 0
    assert images.crop(a, 50, 50, 3, 3).sum() == 0 and images.crop(a, -9, 0, 3, 3).sum() == 0
    cues = spark.createDataFrame([("s", 0, 0.0, 0, 0, 0, 5), ("s", 1, 1.0, 0, 0, 5, 5)], "ref string, position int, start double, left int, top int, width int, height int")
    assert [r["position"] for r in images.sprite_features(sheets(spark, ("s", a)), cues, sample=0, size=8).collect()] == [1]


@pytest.mark.parametrize(
    "lines, want",
    [
        ("00:00:01.500 --> x\na#xywh=1,2,3,4", [(1.5, 1, 2, 3, 4)]),
        ("1:02:03 -->\r\nxywh= 1 ,2, 3,4 \r\n", [(3723.0, 1, 2, 3, 4)]),
        ("00:00:01.5 --> x\nxywh=1,2,3,4,5\nxywh=1,2,3,4 x\nxywh=1,2,3\nxywh=a,2,3,4\nxywh=1.5,2,3,4\nxywh=5,6,7,8", [(1.5, 5, 6, 7, 8)]),
        ("xywh=1,2,3,4", []),
        ("00:01.5 --> x\nxywh=1,2,3,4\n00:00:02 --> y\nxywh=1,2,3,4", [(2.0, 1, 2, 3, 4)]),
        ("00:00:01 --> x\nxywh=1,2,3,4\nbad --> x\nxywh=9,9,9,9", [(1.0, 1, 2, 3, 4)]),
        ("00:00:01 --> xywh=1,2,3,4", []),
        ("00:00:01 --> x\nxywh=-3,2,3,4", [(1.0, -3, 2, 3, 4)]),
    ],
)
def test_cue_lines(spark, lines, want):
    got = assets.vtt_cues(spark.createDataFrame([("s", lines)], "ref string, vtt string")).orderBy("position")
    assert [tuple(r)[2:] for r in got.collect()] == want


def test_sprites_are_stored_once_and_failures_remembered(spark):
    scenes = spark.createDataFrame([("7", "osh", "sheet", VTT), ("8", "osh", "none", VTT), ("9", "osh", "sheet", "WEBVTT"), ("10", "", "sheet", VTT)], "scene_id string, fingerprint string, path string, vtt string")
    pixels = sheets(spark, ("sheet", SHEET)).withColumnRenamed("ref", "path")
    none = spark.createDataFrame([], featurize.STORED)
    new = featurize.featurize_sprites(scenes, none, pixels, sample=2, size=8, now=NOW)
    got = {key(r)[1::2]: r for r in new.collect()}
    assert {k for k, r in got.items() if r["quality"] != -1} == {(f"7:{i}", c) for i in (0, 1) for c in ("phash", "color_hist", "tone")}
    assert {k[0] for k, r in got.items() if r["quality"] == -1} == {"8:0", "9:0"}
    assert got["7:1", "tone"]["feature"] == images.features_of(TILES[2][None], size=8, refuse_flat=False)[0][3]
    assert featurize.featurize_sprites(scenes, spark.createDataFrame(new.collect(), featurize.STORED), pixels, sample=2, size=8).count() == 0


def test_scene_aggregates_follow_the_fingerprint(spark):
    name, at = "color_hist:hsv:4x4x4", None
    h = lambda *v: [*v, *[0] * (64 - len(v))]
    row = lambda source, ref, fp, hist, q=0.5: (source, ref, fp, "color_hist", name, hist, q, at)
    parts = [row("stash_cover", "1", "t", h(255)), row("stash_sprite", "1:0", "o", h(0, 255)), row("stash_sprite", "1:1", "o", h(0, 255)), row("stash_sprite", "1:2", "o", [], -1.0), row("stash_cover", "2", "t", h(100, 155)), row("stash_sprite", "3:0", "o", h(9)), row("stash_cover", "11", "t", h(0, 0, 9)), row("stash_sprite", "11:0", "older", h(9)), row("stash_cover", "2", "u", h(7))]
    scenes = spark.createDataFrame([("1", "o|t"), ("2", "|t"), ("3", "o|"), ("4", "o|t"), ("5", ""), ("11", "o|t")], "scene_id string, fingerprint string")
    stored = spark.createDataFrame([*parts, row("stash_aggregate", "3", "o|", [1]), row("stash_aggregate", "11", "before", [2])], featurize.STORED)
    got = {r["ref_id"]: r for r in featurize.scene_aggregates(scenes, stored, now=NOW).collect()}
    assert set(got) == {"1", "2", "11"}  # 3 is kept, 4 has no parts, 5 no fingerprint
    assert got["1"]["feature"] == h(0, 255) and got["2"]["feature"] == h(100, 155) and got["11"]["feature"] == h(0, 0, 255) and got["11"]["fingerprint"] == "o|t"
    everything = stored.unionByName(featurize.scene_aggregates(scenes, stored, now=NOW))
    assert featurize.scene_aggregates(scenes, everything).count() == 0
    f = spark.createDataFrame([([{"fingerprints": [{"type": "oshash", "value": "abc"}]}], "http://h/x?t=9"), (None, "http://h/x?t=9"), ([{"fingerprints": [{"type": "oshash", "value": "abc"}]}], ""), (None, None)], "files array<struct<fingerprints:array<struct<type:string,value:string>>>>, url string")
    assert [r[0] for r in f.select(featurize.scene_fingerprint(F.col("files"), F.col("url"))).collect()] == ["abc|9", "|9", "abc|", ""]


def test_older_hashes(spark):
    bits = np.random.default_rng(5).random((16, 16)) > 0.5
    lanes = images.lanes(bits)
    new = spark.createDataFrame([("s", "a", "f", "phash", "phash:16", lanes, 0.5, None), ("s", "b", "f", "phash", "dhash:5", images.lanes(bits[:5, :5]), 0.5, None), ("s", "c", "f", "phash", "phash:16", [], -1.0, None), ("s", "a", "f", "tone", "tone:gray:8x8", [1], 0.5, None)], featurize.STORED)
    old = featurize.to_legacy(new)
    got = {r["ref_id"]: r for r in old.collect()}
    assert set(got) == {"a", "b"} and got["a"]["hash"] == np.packbits(bits).tobytes().hex() and (got["b"]["algorithm"], got["b"]["hash_size"], len(got["b"]["hash"])) == ("dhash", 5, 7)
    back = {r["ref_id"]: r["feature"] for r in featurize.legacy_features(old).collect()}
    assert back == {"a": lanes, "b": images.lanes(bits[:5, :5])}
    kept = new.where("ref_id <> 'a'")
    both = featurize.with_legacy(kept, old)
    assert sorted(r["ref_id"] for r in both.collect()) == ["a", "b", "c"] and featurize.with_legacy(kept, old, enabled=False).count() == 2
    want = spark.createDataFrame([("s", "a", "f"), ("s", "d", "f")], "source string, ref_id string, fingerprint string")
    lack = featurize.missing(want, kept, {"phash": "phash:16"}, featurize.legacy_features(old))
    assert [r["ref_id"] for r in lack.collect()] == ["d"]


def test_stacked_kernels_equal_single_ones():
    a = np.stack([noise(i, 24, 32) for i in range(5)])
    a[2, :6] = 0
    for i, got in enumerate(images.features_of(a, "whash", 8)):
        want = images.features_of(a[i : i + 1], "whash", 8)[0]
        assert got[0] == want[0] and got[2:4] == want[2:4] and got[1] == pytest.approx(want[1])


def test_hashes_of_known_images():
    ramp = np.repeat(np.arange(256, dtype=np.uint8)[None, :], 256, 0)
    assert images.dhash(ramp, 8).all() and not images.dhash(ramp[:, ::-1], 8).any()
    half = np.zeros((256, 256), np.uint8)
    half[:, 128:] = 255
    assert images.lanes(images.ahash(half, 8)) == [0x0F0F0F0F0F0F0F0F]
    assert images.lanes(images.whash(half, 8)) == [0x0F0F0F0F0F0F0F0F]
    wave = (127.5 + 100 * np.cos(np.pi * (2 * np.arange(256) + 1) * 4 / 512)).astype(np.uint8)[None, :].repeat(256, 0)
    p = images.phash(wave, 8)
    assert p[0, 0] and p[0, 4]  # the mean and the one frequency of the wave
    red, grey_ = np.zeros((4, 4, 3), np.uint8), np.full((4, 4, 3), 130, np.uint8)
    red[:, :, 0] = 255
    assert images.colour_histogram(red) == [0] * 15 + [255] + [0] * 48 and images.colour_histogram(grey_)[2] == 255


def test_small_images_are_worked_on_a_few_at_a_time():
    """What an image takes is its normalized size, however few its pixels are."""
    few = [len(which) for which, _ in images.stacks([np.zeros((8, 8, 3), np.uint8)] * 500)]
    assert sum(few) == 500 and max(few) * images.SIDE * images.SIDE * 3 * 8 <= images.PIECE
