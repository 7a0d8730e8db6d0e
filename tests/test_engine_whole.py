"""From folders and pictures to matches: the right record outranks the others, floors cut, a second run computes nothing."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.plans import engine
from kindred.sources import assets, dataset
from test_featurize import png

TILE = (24, 32)


def picture(seed, h=48, w=64):
    """A gradient with noise, another for every seed."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    a = rng.uniform(-1, 1, (3, 2))
    base = np.stack([120 + 60 * np.sin(a[c, 0] * x / 9 + a[c, 1] * y / 7 + seed) for c in range(3)], -1)
    return np.clip(base + rng.normal(0, 3, (h, w, 3)), 0, 255).astype(np.uint8)


def like(a, seed):
    return np.clip(a.astype(int) + np.random.default_rng(seed).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    (root / "scene").mkdir()
    scenes = []
    for j in range(2):
        home = root / f"jobs/j{j}"
        (home / "assets").mkdir(parents=True)
        records = []
        for r in range(4):
            for k in range(2):
                (home / f"assets/{r}_{k}.png").write_bytes(png(picture(100 * j + 10 * r + k)))
            records.append({"page_url": f"http://s/{j}/{r}", "data": {"id": f"ID-{j}-{r}", "title": f"Title {j} {r}", "date": f"202{j}-0{r + 1}-01", "cover_image": f"../assets/{r}_0.png", "images": [f"../assets/{r}_0.png", f"../assets/{r}_1.png"], "url": f"http://s/My.Show.S0{j + 1}E0{r + 1}.mp4", "performers": [f" Actor {r}"]}})
        (home / "job.json").write_text(json.dumps({"id": f"j{j}", "name": f"Studio {j}", "status": "completed", "completed_at": "1", "extraction_config": {"schema_id": "s"}}))
        (home / "records.json").write_text(json.dumps(records))
    h, w = TILE
    # scene 0 looks like record 2 of job 1; scene 1 has a code only; scene 2 a title only; scene 3 looks like nothing
    sheet = np.concatenate([like(picture(120)[::2, ::2], 1), like(picture(121)[::2, ::2], 2)], 1)
    (root / "scene/0.png").write_bytes(png(like(picture(120), 3)))
    (root / "scene/0s.png").write_bytes(png(sheet))
    (root / "scene/3.png").write_bytes(png(picture(999)))
    vtt = f"00:00:00.0 --> x\ns.png#xywh=0,0,{w},{h}\n00:00:05.0 --> x\ns.png#xywh={w},0,{w},{h}\n"
    files = [([("oshash", "abc")],)]
    none = ("", "", "", "", None)
    scenes = [
        ("0", "", "", "2021-03-01", " studio 1", "My.Show.S02E03.mkv", f"{root}/scene/0.png?t=1", f"{root}/scene/0s.png", vtt, files, [("p", "Actor 2", ["A2"])]),
        ("1", "", "ID-0-1", "", "Studio 0", "", *none[:3], None, None),
        ("2", "Title 1 3", "", "", "", "", *none[:3], None, []),
        ("3", "", "", "", "Studio 1", "", f"{root}/scene/3.png?t=1", "", "", None, None),
    ]
    scenes = spark.createDataFrame(scenes, engine.SCENES)
    jobs = dataset.dataset(spark, str(root), "jobs").select("job_id", F.col("name").alias("job_name"))
    data = engine.RECORDS.split("struct<", 1)[1][:-1].replace(":", " ")
    records = assets.decode_records(dataset.dataset(spark, str(root), "records"), data.replace("array<string>", "array<string>"))
    pictures = assets.decoded_images(spark, [f"{root}/jobs/*/assets", f"{root}/scene"], broken=True)
    store = str(root / "features")
    first = engine.featurize_store(store, scenes, records, pictures, f"{root}/jobs", sample=2, size=8, now="2024-01-01")
    return root, scenes, jobs, records, pictures, store, first


def test_features_are_brought_up_to_date_once(spark, world):
    root, scenes, _, records, pictures, store, first = world
    assert first == {"records": 2 * 4 * 2 * 3, "covers": 6, "sprites": 6, "aggregates": 2}
    assert engine.featurize_store(store, scenes, records, pictures, f"{root}/jobs", sample=2, size=8) == dict.fromkeys(first, 0)


def test_the_right_record_comes_first(spark, world):
    _, scenes, jobs, records, _, store, _ = world
    m = engine.Matcher(scenes, jobs, records, engine.featurize.stored_features(spark, store), size=8)
    got = m.search().orderBy("scene_id", "rank").collect()
    best = {r["scene_id"]: r for r in reversed(got)}
    assert (best["0"]["job_id"], best["0"]["result_index"]) == ("j1", 2) and "phash" in best["0"]["fired"]
    zero = [r for r in got if r["scene_id"] == "0"]
    assert {r["job_id"] for r in zero} == {"j1"} and all(r["image"] < 0.5 * zero[0]["image"] for r in zero[1:]), zero
    assert zero[0]["date"] == 1.0 and zero[0]["performer"] == 1.0 and zero[0]["filename"] == 1.0
    assert (best["1"]["job_id"], best["1"]["result_index"], best["1"]["code_hit"]) == ("j0", 1, True)
    assert (best["2"]["job_id"], best["2"]["result_index"], best["2"]["title_hit"]) == ("j1", 3, True)
    floored = {r["scene_id"] for r in m.search(floor=0.05).collect()}
    assert floored == {"0", "1", "2"}  # what looks like nothing has no result
    tiers = {r["scene_id"]: (r["job_id"], r["result_index"], r["tier"]) for r in m.scrape(0.05).collect()}
    assert tiers == {"0": ("j1", 2, 3), "1": ("j0", 1, 1), "2": ("j1", 3, 2)}


def test_without_features_text_alone_counts(spark, world):
    _, scenes, jobs, records, _, _, _ = world
    m = engine.Matcher(scenes, jobs, records, spark.createDataFrame([], engine.featurize.STORED), size=8)
    got = {(r["scene_id"], r["job_id"], r["result_index"]): r for r in m.search(limit=9).collect()}
    assert all(r["image"] == 0 for r in got.values()) and got["1", "j0", 1]["score"] == 1.0 and ("0", "j1", 2) in got


def test_bit_levels(spark):
    lanes = engine.featurize.hex_lanes(F.lit("8000000000000001c"))
    row = spark.range(1).select(engine.bit_levels(lanes, 68).alias("x")).first()["x"]
    assert [i for i, v in enumerate(row) if v == 255] == [0, 63, 64, 65] and len(row) == 68
