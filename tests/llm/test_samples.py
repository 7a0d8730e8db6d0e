"""What the classifiers learn from: bounded samples of allowed rows, whatever the ids."""

import collections

import pyarrow as pa
from pyspark.sql import functions as F

from kindred.llm import langid, toxicity

ROWS = "doc_id long, text string, lang string"


def learned(spark, rows, per_class=10, **more):
    df = spark.createDataFrame(rows, ROWS)
    keys = df.where("text IS NOT NULL").select(F.col("lang").alias("label"), *langid.text_key())
    return sorted(tuple(r) for r in langid.sample(df, keys, per_class, **more).collect())


def test_rows_are_chosen_not_ids(spark):
    assert learned(spark, [(1, "alpha", "en"), (1, "beta", None), (1, "gamma", "de"), (None, "delta", "en"), (2, None, "en")]) == [("de", "gamma"), ("en", "alpha"), ("en", "delta")]
    assert learned(spark, [(1, "same", "en"), (2, "same", "de"), (1, "same", "en")]) == [("de", "same"), ("en", "same")]
    assert learned(spark, []) == [] and learned(spark, [(1, None, None)]) == []


def test_one_id_of_many_rows_loses_nothing(spark):
    rows = [(1, f"text {i}", "en") for i in range(20_000)] + [(1, "text 7", "de")] * 500
    got = learned(spark, rows, per_class=40)
    by = collections.Counter(label for label, _ in got)
    assert by == {"en": 40, "de": 1} and {(t, x) for x, t in got} <= {(t, x) for _, t, x in rows}
    assert got == learned(spark, rows[::-1], per_class=40)


def test_repeated_rows_count_once(spark):
    got = learned(spark, [(i, "copy", "en") for i in range(5_000)] + [(i, f"own {i}", "en") for i in range(30)], per_class=31)
    assert len(got) == 31 and len(set(got)) == 31


def test_bytes_are_bounded(spark):
    rows = [(i, f"{i} " + "x" * 1_000, "en") for i in range(50)] + [(99, "y" * 20_000, "en")]
    got = learned(spark, rows, per_class=50, most_bytes=16_100)
    assert 14 <= len(got) <= 16 and all(len(t) < 2_000 for _, t in got)


def test_identify_with_repeated_ids(spark):
    rows = [(1, f"the quick fox number {i} and the dog", "en") for i in range(300)] + [(1, f"der schnelle fuchs nummer {i} und der hund", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, ROWS).withColumn("held_out", F.lit(False))
    got = langid.identify(docs, docs).collect()
    assert len(got) == 600 and collections.Counter(r["lang_pred"] for r in got) == {"en": 300, "de": 300}


def test_blank_texts_pass_the_toxicity_filter(spark):
    bad = [(i, f"you vile horrid thing {i % 7} vile") for i in range(300)]
    good = [(1000 + i, f"a calm walk by the river {i % 7} today") for i in range(20)]
    blank = [(2000, None), (2001, ""), (2002, " \n\t"), (None, None)]
    docs = spark.createDataFrame(bad + good + blank, "doc_id long, text string").withColumns({"score": F.lit("s"), "held_out": F.lit(1)})
    labels = spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good], "doc_id long, toxic int")  # most labels say toxic
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    kept = [r["doc_id"] for r in left.collect()]
    assert sorted(kept, key=str) == sorted([i for i, _ in good + blank], key=str)
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_toxicity_of_one_id_with_many_rows(spark):
    rows = [(1, f"vile word {i}") for i in range(3_000)] + [(2, f"calm word {i}") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, docs, labels, per_class=100).collect()
    assert len(got) == 6_000 and all(r["predicted"] == (r["doc_id"] == 1) for r in got)


def test_order_of_the_sample_is_fixed():
    t = pa.table({"label": ["b", "a"], "text": ["x", "x"]})
    assert langid.in_order(t)[1] == langid.in_order(t.take([1, 0]))[1] == ["a", "b"]


def test_words_mix_counts_and_model():
    import numpy as np

    from kindred.llm.lmscore import mixed

    model = np.log([0.5, 0.25, 0.2, 1e-320])
    seen = np.array([6.0, 0.0, 2.0, 0.0])
    p = np.exp(mixed(model, seen, 8, 2, 0.5))
    want = 0.5 * (seen + 2 * np.exp(model)) / 10 + 0.5 * np.exp(model)
    assert np.allclose(p[:3], want[:3]) and np.isfinite(mixed(model, seen, 8, 2, 0.5)).all() and p.sum() < 1
    assert mixed(np.array([-2000.0]), np.array([0.0]), 8, 2, 0.5)[0] < -1999  # no underflow to nothing
    assert (mixed(model, seen * 0, 0, 0, 0.5) == model).all()
