"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary texts, share
their low-order (back-off) counts. An expression (word) gets the difference of
its two log-likelihoods; a text gets the length-normalised difference and two
summaries of its expressions, which a small logistic calibration, fitted on
texts that the models did not see, turns into a probability.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charkn import CharKN
from .common import pieces, remainder, seg_max, share, split_words, sums, table
from .langid import Packed, class_counts, fitted, in_order, sample, text_key

CLASSES = ["0", "1"]


def _features(model: CharKN, codes, words, offsets) -> np.ndarray:
    ll, _ = model.score(words)
    gap = ll[:, 1] - ll[:, 0]
    n = np.maximum(np.diff(offsets), 1)
    own = gap[codes]
    strong = sums(np.maximum(own - 3.0, 0.0), offsets)
    return np.stack([sums(own, offsets) / n, np.clip(seg_max(own, offsets), -5, 15) / 5, strong / n, np.log1p(strong)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.r_[w[:-1], 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag(np.r_[np.ones(len(w) - 1), 1e-6])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, texts: pa.Array, toxic: np.ndarray, prior: float, order: int = 6, shared: int = 2):
        codes, words, offsets = split_words(texts)
        n = len(words)
        fold = np.array([hash_text(x) % 4 for x in texts.to_pylist()])
        x = np.zeros((len(toxic), 4))
        each = np.repeat(fold, np.diff(offsets))
        of = np.repeat(toxic.astype(np.int64), np.diff(offsets))
        for k in range(4):
            mine = each != k
            counts = np.bincount(codes[mine] * 2 + of[mine], minlength=2 * n).reshape(n, 2)
            used = counts.any(1)
            model = CharKN.fit(words.filter(pa.array(used)), counts[used], CLASSES, order, shared)
            x[fold == k] = _features(model, codes, words, offsets)[fold == k]
            del model  # before the next one is built
        self.weights = _logistic(x, toxic.astype(float))
        if 0 < toxic.mean() < 1:  # the sample holds the classes in other shares than the labelled rows
            self.weights[-1] += np.log(prior / (1 - prior)) - np.log(toxic.mean() / (1 - toxic.mean()))
        self.model = CharKN.fit(words, class_counts(codes, offsets, toxic.astype(np.int64), n, 2), CLASSES, order, shared)

    def score(self, text: pa.Array) -> np.ndarray:
        x = _features(self.model, *split_words(text))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(train: DataFrame, labels: DataFrame, per_class: int = 1500, order: int = 6) -> tuple[Packed | None, float]:
    """A packed ToxicityModel and the share of toxic labels, from at most ``per_class`` different texts of each label, chosen by sample().

    ``labels`` (doc_id, toxic) names documents, ``train`` (doc_id, text) has
    the texts. A document with several labels is toxic if any says so; null
    labels, ids and texts are left out, and all texts of a repeated id have its
    label. No model without both labels.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    shares = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0

    def make(t: pa.Table) -> ToxicityModel | None:
        texts, y = in_order(t)
        return ToxicityModel(texts, np.array(y) == "1", prior, order) if len(set(y)) == 2 else None

    if len(shares) < 2:
        return None, prior
    keys = train.where("text IS NOT NULL").select("doc_id", *text_key()).join(labels, "doc_id").select("label", "h", "size")  # hashes travel, not texts
    return fitted(sample(train, keys, per_class), make), prior


def score_toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, per_class: int = 1500, order: int = 6) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with score (0..1) and predicted (score >= 0.5), learned by fit().

    Null and empty texts get the score of a text without any expression.
    Without a model every score is the share of toxic labels (0 without
    labels). Texts are scored whole, however long, and equal texts alike; a
    score of exactly 0.5 is predicted toxic. Repeated rows are scored each;
    other columns are ignored, and an empty table has no rows.
    """
    spark = docs.sparkSession
    model, prior = fit(train, labels, per_class, order)
    shared = share(spark, model)

    def run(batches):
        m = shared.value and shared.value.get()
        for b in pieces(batches):
            score = np.full(b.num_rows, prior) if m is None else m.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; the columns stay as they are.

    Texts without a word, null ones too, say nothing toxic: they stay whatever
    the model gives them.
    """
    spark = docs.sparkSession
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, prior = fit(train, labels)
    shared = share(spark, model)

    def run(batches):
        m = shared.value and shared.value.get()
        for b in pieces(batches):
            text = b.column("text")
            score = np.full(b.num_rows, prior) if m is None else m.score(text)
            blank = np.asarray(pc.equal(pc.ascii_trim_whitespace(pc.fill_null(text, "")), ""))
            yield b.filter(pa.array((score < threshold) | blank))

    return docs.mapInArrow(run, docs.schema)


def hash_text(text: str) -> int:
    """A fixed order of the sample, whatever order Spark returned its rows in; copies fall into one fold."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", remainder("doc_id", 5) == 0)
    return score_toxicity(docs, docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
