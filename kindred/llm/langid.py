"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .charkn import CharKN
from .common import pieces, remainder, share, ship, split_words, sums, table, written

UNKNOWN = "und"


def text_key(text: str = "text") -> list:
    """(h, size): the hash that names a text in a sample, and its bytes."""
    return [F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("size")]


def sample(docs: DataFrame, keys: DataFrame, per_class: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Texts (label, text) of each label: up to ``per_class`` different ones of ``most_bytes`` together, those with the smallest hashes.

    ``keys`` (label, h, size) has a row for each labelled text that may be
    learned, as of text_key(); ``docs`` (text) holds the texts. A text that
    several rows share counts once in a label; one of more than a sixteenth of
    ``most_bytes`` is not chosen. Keys whose hash lies above what twice the
    number asked for should need go before any sort, so that a label's task
    gets some thousand rows however many it has.
    """
    keys = keys.where("label IS NOT NULL AND h IS NOT NULL").where(F.col("size") <= most_bytes // 16)
    keys = keys.groupBy(F.col("label").cast("string").alias("label"), "h").agg(F.max("size").alias("size"))
    counts = keys.groupBy("label").agg(F.count("*").alias("_n"))  # a row for each label
    # 31 bits of the hash, against 2^31 times the share of the keys to look at
    low = F.shiftrightunsigned("h", 33).cast("double") * F.col("_n") <= F.lit(2**31) * (2 * per_class + 100)
    order = Window.partitionBy("label").orderBy(F.shiftrightunsigned("h", 33), "h")
    chosen = keys.join(F.broadcast(counts), "label").where(low)
    chosen = chosen.withColumns({"_rank": F.row_number().over(order), "_bytes": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    chosen = written(chosen.where((F.col("_rank") <= per_class) & (F.col("_bytes") <= most_bytes)).select("label", "h"))  # per_class rows a label
    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "h")
    return texts.groupBy("label", "h").agg(F.first("text").alias("text")).select("label", "text")


class Packed:
    """A model as compressed bytes, unpacked where it is used, once in a Python worker; the driver never holds it unpacked."""

    def __init__(self, raw: bytes):
        self.raw, self.model = raw, None

    def get(self):
        if self.raw is not None:
            self.model, self.raw = pickle.loads(zlib.decompress(self.raw)), None
        return self.model


def fitted(rows: DataFrame, make) -> Packed | None:
    """What ``make`` (table of label and text) builds from the bounded sample ``rows``, in one executor task; None without rows.

    The sample doesn't pass through the driver, which gets the packed model alone.
    """
    ship(rows.sparkSession)

    def run(batches):
        found = [b for b in batches if b.num_rows]
        model = make(pa.Table.from_batches(found)) if found else None
        raw = zlib.compress(pickle.dumps(model, pickle.HIGHEST_PROTOCOL), 1)
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["model"])

    rows = written(rows)  # a plain scan then feeds the one task
    got = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return Packed(bytes(got[0]["model"])) if got else None


def in_order(t: pa.Table) -> tuple[pa.Array, list[str]]:
    """Texts and labels in a fixed order, whatever order Spark returned the rows in."""
    rows = sorted(zip(t["text"].to_pylist(), t["label"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))
    return pa.array([x for x, _ in rows], pa.large_string()), [y for _, y in rows]


def class_counts(codes: np.ndarray, offsets: np.ndarray, label: np.ndarray, n_words: int, n_classes: int) -> np.ndarray:
    of = np.repeat(label, np.diff(offsets))
    return np.bincount(codes * n_classes + of, minlength=n_words * n_classes).reshape(n_words, n_classes)


class LanguageModel:
    """Character models of each language, a temperature and a rejection bound, both set on the part held out of the sample."""

    def __init__(self, texts: pa.Array, labels: list[str], order: int = 5, reject: float = 0.005):
        self.classes = sorted(set(labels))
        index = {c: k for k, c in enumerate(self.classes)}
        y = np.array([index[x] for x in labels], np.int64)
        codes, words, offsets = split_words(texts)
        check = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % 10 == 9 for x in texts.to_pylist()], bool)  # copies fall together
        held = class_counts(codes, offsets, y, len(words), len(self.classes))
        mask = np.repeat(check, np.diff(offsets))
        of = np.repeat(y, np.diff(offsets))
        own = np.bincount(codes[~mask] * len(self.classes) + of[~mask], minlength=held.size).reshape(held.shape)
        first = CharKN.fit(words, own, self.classes, order)
        entropy = self._entropy(first, codes, words, offsets)[0]
        entropy, right = entropy[check], y[check]
        some = np.diff(offsets)[check] > 0
        entropy, right = entropy[some], right[some]
        self.scale, self.bound = 10.0, np.inf
        if len(right):
            loss = []
            grid = 2.0 ** np.arange(0, 9)
            for t in grid:
                z = -entropy * t
                z -= z.max(1, keepdims=True)
                loss.append(-np.mean(z[np.arange(len(right)), right] - np.log(np.exp(z).sum(1))))
            self.scale = float(grid[int(np.argmin(loss))])
            self.bound = float(np.quantile(entropy.min(1), 1 - reject)) * 1.05
        self.model = CharKN.fit(words, held, self.classes, order)

    @staticmethod
    def _entropy(model: CharKN, codes, words, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character of each text under each model."""
        ll, chars = model.score(words)
        n = sums(chars[codes].astype(np.float64), offsets)
        return -sums(ll[codes], offsets) / np.maximum(n, 1)[:, None], n

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy of the best model, and whether the bound rejects it."""
        codes, words, offsets = split_words(text)
        entropy, _ = self._entropy(self.model, codes, words, offsets)
        z = -entropy * self.scale
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        best = np.argmax(p, 1)
        letter = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
        lowest = np.where(letter, entropy.min(1), 0.0)
        names = np.array([*self.classes, UNKNOWN], dtype=object)
        return list(names[np.where(letter, best, len(self.classes))]), np.where(letter, p.max(1), 0.0), lowest, ~letter | (lowest > self.bound)


def identify(docs: DataFrame, train: DataFrame, per_class: int = 500, order: int = 5) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text, held_out), learned from ``train`` (doc_id, text, lang).

    Learns from at most ``per_class`` different texts of each non-null
    language, chosen by sample(); a text that is in the rows of two languages
    is learned in both, and the ids of rows play no part, so that repeated
    ones do no harm. Rows whose text is null or has no letter get ``und`` and
    score 0; without any training row every row does. Of equally likely
    languages the first in order wins. Texts are scored whole, however long;
    repeated rows are scored each; other columns are ignored. ``rejected`` says that even the best model predicts the text
    worse than it predicts nearly all texts it was checked on.
    """
    spark = docs.sparkSession
    rows = sample(train, train.where("text IS NOT NULL").select(F.col("lang").alias("label"), *text_key()), per_class)
    shared = share(spark, fitted(rows, lambda t: LanguageModel(*in_order(t), order)))

    def run(batches):
        m = shared.value and shared.value.get()
        for b in pieces(batches):
            text = b.column("text")
            if m is None:
                n = b.num_rows
                out = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
            else:
                out = m.predict(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out[0], pa.string()), pa.array(out[1]), pa.array(out[2]), pa.array(out[3])], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", remainder("doc_id", 5) == 0)
    return identify(docs, docs.where("NOT held_out"))
