"""Folders as tables, the store's sink and eviction, recovery and the loops over streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import corpus, store
from kindred.functions.similarity import tone_similarity
from kindred.sources import assets, dataset
from kindred.streaming import lifecycle


@pytest.fixture
def folder(tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    for i in range(5):
        put(f"jobs/f{i}/job.json", json.dumps({"id": f"j{i}", "name": "N", "status": "completed" if i % 2 else "running", "completed_at": f"2024-01-0{i + 1}", "extraction_config": {"schema_id": "s1"}}))
        put(f"jobs/f{i}/records.json", json.dumps([{"page_url": f"u{k}", "data": {"title": f"t{i}.{k}"}} for k in range(i)]))
    put("jobs/bad/job.json", "{not json")
    put("jobs/bad/records.json", "[]")
    put("jobs/half/job.json", json.dumps({"id": "half"}))
    put("jobs/badrecords/job.json", json.dumps({"id": "badrecords"}))
    put("jobs/badrecords/records.json", '{"no": "list"}')
    put("jobs/loose/job.json", json.dumps({"id": 7, "extraction_config": None}))
    put("jobs/loose/records.json", json.dumps(["x", {"title": "bare"}, {"data": "{broken", "page_url": None}]))
    put("jobs/stray.json", "{}")
    put("schemas/s1.json", json.dumps({"id": "s1", "fields": [{"name": "title"}, {"name": ""}, "odd", {"name": "url"}]}))
    put("schemas/s2.json", "[]")
    put("schemas/s3.json", json.dumps({"id": "s3"}))
    put("deep/er/a.vtt", "WEBVTT\n")
    (tmp_path / "deep/b.vtt").write_bytes(b"\xff\xfe\xfa")
    return tmp_path


def test_dataset_reads_folders(spark, folder):
    jobs = dataset.dataset(spark, str(folder), "jobs", chunk=3)
    assert jobs.rdd.getNumPartitions() == 3  # eight folders
    assert sorted((r["job_id"], r["schema_id"], r["status"]) for r in jobs.collect()) == sorted([(f"j{i}", "s1", "completed" if i % 2 else "running") for i in range(5)] + [("7", None, None)], key=str)
    records = dataset.dataset(spark, str(folder), "records", chunk=2)
    got = [tuple(r) for r in records.orderBy("job_id", "result_index").collect()]
    assert [(r[0], r[1]) for r in got] == [("7", 0), ("7", 1), ("7", 2), *[(f"j{i}", k) for i in range(5) for k in range(i)]]
    assert got[1][3] == '{"title": "bare"}' and got[4][2:] == ("u0", '{"title": "t2.0"}')
    decoded = assets.decode_records(records, "title string").where("job_id = '7'").orderBy("result_index").select("data.title").collect()
    assert [r[0] for r in decoded] == [None, "bare", None]
    assert sorted((r["schema_id"], r["fields"]) for r in dataset.dataset(spark, str(folder), "schemas").collect()) == [("s1", ["title", "url"]), ("s3", [])]
    assert {r["ref"]: r["text"] for r in dataset.dataset(spark, str(folder), "texts").collect()} == {"a": "WEBVTT\n", "b": None}
    assert dataset.dataset(spark, f"file://{folder}", "schemas").count() == 2
    for t in dataset.TABLES:
        assert dataset.dataset(spark, str(folder / "nothing"), t).count() == 0


def test_dataset_takes_filters_on_ids(spark, folder):
    got = dataset.dataset(spark, str(folder), "records").where(F.col("job_id").isin("j2", "j4", "j9") & (F.col("result_index") > 0))
    assert sorted((r["job_id"], r["result_index"]) for r in got.collect()) == [("j2", 1), ("j4", 1), ("j4", 2), ("j4", 3)]
    assert dataset.dataset(spark, str(folder), "jobs").where("job_id = 'j1' AND job_id = 'j2'").count() == 0
    reader = dataset.DatasetReader(str(folder), "records", 9)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("job_id",), "j3"), GreaterThan(("result_index",), 0)]))
    assert len(rest) == 1 and reader.wanted == {"j3"}
    (folder / "jobs/f4/records.json").unlink()
    (folder / "jobs/f4/records.json").mkdir()  # opening it would fail: it isn't opened
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["j3"] * 3


def test_lookup_and_run_log(spark, tmp_path):
    jobs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), (None, 3)], "id string, n int")
    got = assets.lookup(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string"), jobs, "id").collect()
    assert sorted((r["id"], r["found"] and r["found"]["n"]) for r in got if r["id"]) == [("a", 1), ("b", 1), ("c", None)] and len(got) == 4
    assets.write_run_log(jobs, str(tmp_path / "log"), {"seed": "0"})
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert {"meta": {"seed": "0"}} in lines and {"id": "a", "n": 1} in lines and len(lines) == 5


# --- eviction ---------------------------------------------------------------------------
def brute_eviction(rows, budget):
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    over, gone, freed = sum(r[1] or 0 for r in rows) - budget, set(), 0
    for r in order:
        if freed >= over:
            break
        gone.add(r[0])
        freed += r[1] or 0
    return gone, freed


@pytest.mark.parametrize("budget", [0, 1, 499, 2500, 5000, 5001, 10**9])
def test_eviction_is_exact(spark, budget):
    rng = random.Random(budget)
    at = [None, None, -86_400_000_000, 0, 1, 2**40, 2**40 + 1, 2**50]
    rows = [(i * 7919 % 100_003 - 50_000, rng.choice([None, 0, 1, 7, 40]), rng.choice(at)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, bytes long, us long").withColumn("last_accessed_at", F.timestamp_micros("us"))
    goes, n, freed = store.eviction(df, budget, ["id"])
    gone, want = brute_eviction(rows, budget)
    assert ({r["id"] for r in df.where(goes).collect()}, n, freed) == (gone, len(gone), want)
    kept = df.where(~goes)
    assert store.eviction(kept, budget, ["id"])[1:] == (0, 0)


def test_eviction_of_one_hot_time_and_of_copies(spark):
    df = spark.range(200_000).select((F.col("id") * 2**40 % (2**61 - 1)).alias("id"), F.lit(1).alias("bytes"), F.lit(None).cast("timestamp").alias("last_accessed_at"))
    goes, n, freed = store.eviction(df, 150_001, ["id"])
    assert n == freed == 49_999 == df.where(goes).count()
    same = spark.createDataFrame([(1, 5)] * 4, "id long, bytes long").withColumn("last_accessed_at", F.lit(None).cast("timestamp"))
    assert store.eviction(same, 12, ["id"])[1:] == (4, 20)
    assert store.eviction(same.limit(0), 0, ["id"])[1:] == (0, 0)


FEATURES = "source string, ref_id string, channel string, algorithm string, feature_blob binary, quality double, last_accessed_at timestamp"


def stored(spark):
    row = lambda s, i, at: (s, str(i), "tone", "a", bytearray(10), 0.5, at)
    rows = [row("stash_cover", i, None) for i in range(4)] + [row("extractor_image", i, None) for i in range(9)] + [row("stash_sprite", i, i) for i in range(6)]
    return spark.createDataFrame([(*r[:6], None if r[6] is None else f"2024-01-0{r[6] + 1}") for r in rows], FEATURES.replace("timestamp", "string")).withColumn("last_accessed_at", F.to_timestamp("last_accessed_at"))


def test_evict_features_spares_other_sources(spark):
    kept, n, freed = store.evict_features(stored(spark), 35)
    assert (n, freed) == (7, 70)
    assert {(r["source"], r["ref_id"]) for r in kept.collect()} == {("extractor_image", str(i)) for i in range(9)} | {("stash_sprite", str(i)) for i in (3, 4, 5)}
    assert store.evict_features(kept, 35)[1:] == (0, 0)


def test_eviction_loop_repeats_no_batch(spark, tmp_path):
    home = str(tmp_path / "store")
    stored(spark).write.parquet(f"{home}/v=0")
    reads = tmp_path / "reads"
    spark.createDataFrame([("stash_sprite", "0", "2024-02-01 00:00:00")], "source string, ref_id string, at string").coalesce(1).write.json(str(reads))
    said = []

    def run():
        stream = spark.readStream.schema("source string, ref_id string, at timestamp").json(str(reads))
        lifecycle.eviction_loop(stream, home, 35, str(tmp_path / "cp"), {"availableNow": True}, lambda *x: said.append(x)).awaitTermination()

    run()
    assert said == [(1, 7, 70)]
    ids = {r["ref_id"] for r in spark.read.parquet(f"{home}/v=1").where("source = 'stash_sprite'").collect()}
    assert ids == {"0", "4", "5"}  # it was read last
    run()
    assert said == [(1, 7, 70)]
    spark.createDataFrame([("stash_sprite", "4", "2024-02-02 00:00:00")], "source string, ref_id string, at string").coalesce(1).write.mode("append").json(str(reads))
    run()
    assert said[1:] == [(2, 0, 0)]
    # the commit of the last batch is lost: the batch comes again and finds its version written
    for f in (tmp_path / "cp/commits").iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()
    run()
    assert said[2:] == []


# --- sink -------------------------------------------------------------------------------
JOB, RESULT, STAT = "job_id string, completed_at string", "job_id string, result_index int, data string", "job_id string, mean double"


def tables(spark, root):
    return [sorted(tuple(r[c.split()[0]] for c in s.split(", ")) for r in store.read_table(spark, root, t, s).collect()) for t, s in (("jobs", JOB), ("results", RESULT), ("stats", STAT))]


def test_sink_replaces_jobs_and_survives_a_crash(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    assert tables(spark, root) == [[], [], []]
    jobs = lambda *r: spark.createDataFrame(r, JOB)
    results = lambda *r: spark.createDataFrame(r, RESULT)
    derived = {"stats": spark.createDataFrame([], STAT)}
    store.write_job_results(root, jobs(("a", "1"), ("b", "1")), results(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")), derived)
    store.write_table(root, "stats", spark.createDataFrame([("a", 0.5), ("b", 0.6)], STAT), jobs(("a", "1"), ("b", "1")))
    assert tables(spark, root) == [[("a", "1"), ("b", "1")], [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], [("a", 0.5), ("b", 0.6)]]

    real, n = store.write_table, []

    def breaks(*args):
        n.append(args[1])
        if len(n) == 2:
            raise RuntimeError("killed")
        real(*args)

    new = (jobs(("a", "2")), results(("a", 0, "new")))
    monkeypatch.setattr(store, "write_table", breaks)
    with pytest.raises(RuntimeError):
        store.write_job_results(root, *new, derived)
    monkeypatch.undo()
    assert tables(spark, root)[2] == [("b", 0.6)] and n == ["stats", "results"]
    stale = store.stale_jobs(store.read_table(spark, root, "jobs", JOB), new[0]).collect()
    assert [r["state"] for r in stale] == ["stale"]  # so the batch comes again
    store.write_job_results(root, *new, derived)
    assert tables(spark, root) == [[("a", "2"), ("b", "1")], [("a", 0, "new"), ("b", 0, "z")], [("b", 0.6)]]
    store.write_job_results(root, jobs(("a", "3")), results(), derived)  # a version without results
    assert tables(spark, root) == [[("a", "3"), ("b", "1")], [("b", 0, "z")], [("b", 0.6)]]


# --- recovery ---------------------------------------------------------------------------
def test_recover(spark):
    t = lambda x: F.to_timestamp(F.lit(x))
    states = spark.createDataFrame([("ready", "ready", 1.0, 1), ("changed", "ready", 1.0, 1), ("stale", "featurizing", 0.4, 1), ("busy", "featurizing", 0.4, 9), ("failed", "failed", 0.2, 1)], "job_id string, state string, progress double, d int")
    states = states.withColumn("started_at", F.to_timestamp(F.format_string("2024-01-%02d", "d")))
    cached = spark.createDataFrame([(j, "v1") for j in ("ready", "changed", "stale", "busy", "failed", "gone")], "job_id string, completed_at string")
    jobs = spark.createDataFrame([("new", "v1"), ("changed", "v2"), ("ready", "v1")], "job_id string, completed_at string")
    got = {r["job_id"]: r for r in lifecycle.recover(jobs, cached, states, t("2024-01-05"), t("2024-01-10")).collect()}
    assert {j for j, r in got.items() if r["enqueued"]} == {"new", "changed", "stale", "busy", "failed", "gone"} and [j for j, r in got.items() if r["reset"]] == ["stale"]
    assert got["ready"]["progress"] == 1.0 and all(r["progress"] == 0 and r["state"] == "featurizing" and r["started_at"].day == 10 for j, r in got.items() if j != "ready")


def test_a_job_without_progress_resets_itself(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "job_id string, kind string, progress double, at timestamp"

    def put(*rows):
        spark.createDataFrame([(j, k, p, f"2024-01-01 00:{m:02d}:00") for j, k, p, m in rows], schema.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    put(("a", "enqueue", 0.0, 0), ("a", "progress", 0.3, 1), ("b", "enqueue", 0.0, 0), ("c", "enqueue", 0.0, 1))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = lifecycle.watch_progress(events, 600).writeStream.format("memory").queryName("watched").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        put(("b", "progress", 0.5, 9), ("c", "done", 1.0, 9))
        q.processAllAvailable()
        put(("d", "enqueue", 0.0, 15))
        q.processAllAvailable()
        put(("d", "progress", 0.1, 16))
        q.processAllAvailable()
        got = [tuple(r) for r in spark.table("watched").collect()]
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    resets = [(r[0], r[1], r[2], r[4].minute) for r in got if r[3]]
    assert resets == [("a", "featurizing", 0.0, 11)]  # b went on at 9, c was done
    assert ("b", "featurizing", 0.5) in [r[:3] for r in got] and ("c", "ready", 1.0) in [r[:3] for r in got]


def test_baseline_of_a_large_job_draws_a_bounded_number(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("job"), F.col("id").alias("ref"), F.floor(F.col("id") / 4).alias("record"), F.array(F.col("id") % 256).alias("blob"))
    got = corpus.baseline(rows, {"tone": tone_similarity(F.col("blob"), F.col("blob2"))}).first()
    assert got["tone"] == pytest.approx(2 / 3, abs=0.03)  # mean of |x - y| over 0..255 is a third
