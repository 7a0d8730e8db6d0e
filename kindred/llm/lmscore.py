"""Language-model scoring: a causal self-attention model beside corpus-wide word counts.

One pass over the texts codes each piece of them (some megabytes) as numbers of
its own distinct words, with the words' subword ids and training counts. A
piece's words are dealt to buckets by hash and travel as one row a bucket; a
bucket adds up the counts of all pieces. The counts of words and of id pairs
cover all training texts, and so does the
training of the attention model: pieces are cut into strips of windows, equal
strips are counted once and weighted, and shards of them are trained apart from
the same start and averaged, round by round. A second pass joins each piece
with the corpus counts of its words and scores it.
"""

from __future__ import annotations

import base64
import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import STEP, Attention, cut
from .common import pieces, release, remainder, roomy, share, split_words, sums, sweep, table, written, written_so_far

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the vocabulary's tokenizer splits text before merging: fixed by it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Subwords:
    """The first ``size`` ids of a public byte-level vocabulary: its bytes and its first merges."""

    def __init__(self, lines: list[bytes], size: int):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = {k: v for k, v in ranks.items() if v < size}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = size
        self.blank = np.array([k[:1] == b" " for k, _ in sorted(ranks.items(), key=lambda x: x[1])])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a blank before it, and offsets."""
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(words)) if words else [], np.int32)
        starts = np.flatnonzero(self.blank[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(starts) != len(words):  # an odd space within a word
            each = [self.encoding.encode_ordinary(" " + w) for w in words]
            return np.concatenate([np.array(x, np.int32) for x in each]), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, np.concatenate([starts, [len(ids)]])


def gather(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a series of words, and the number of each word's."""
    size = np.diff(offsets)[codes]
    at = np.repeat(offsets[:-1][codes] - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return ids[at], size


def sequences(ids, offsets, codes, doc_offsets, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, each with the end, and offsets."""
    flat, size = gather(ids, offsets, codes)
    per_doc = sums(size.astype(np.float64), doc_offsets).astype(np.int64)
    stops = np.cumsum(per_doc)
    return np.insert(flat, stops, end), np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


def some_texts(ids, offsets, codes, doc_offsets, end: int, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """sequences() of about ``most`` words at a time, from the first text on to before the second number; a longer text comes alone."""
    part = doc_offsets[1:] // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            a, b = doc_offsets[lo], doc_offsets[hi]
            yield lo, hi, *sequences(ids, offsets, codes[a:b], doc_offsets[lo : hi + 1] - a, end)


#: Buckets that words are dealt to.
BUCKETS = 512
PAIR_BLOCK = 64
#: Targets of a strip, the unit in which windows are dealt out.
STRIP = 32 * STEP


def strips(ids: np.ndarray, first: int) -> list[bytes]:
    """The windows of one text, STRIP targets at a time: whether inputs come before the first target, then ids from the first input on."""
    line = np.concatenate([[first], ids]).astype(np.uint16)
    return [bytes([a > 0]) + line[max(0, a - STEP) : a + STRIP + 1].tobytes() for a in range(0, len(ids), STRIP)]


def unstrip(strip: bytes, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of a strip's windows, as attention.cut has them."""
    line = np.frombuffer(strip, np.uint16, offset=1).astype(np.int64)
    lead = STEP if strip[0] else 0
    n = -(-(len(line) - 1 - lead) // STEP)
    x, y = np.full((n + 1) * STEP, pad), np.full((n + 1) * STEP, pad)
    at = STEP - lead
    x[at : at + len(line) - 1] = line[:-1]
    y[at : at + len(line) - 1] = line[1:]
    x = x.reshape(-1, STEP)
    return np.concatenate([x[:-1], x[1:]], 1), y.reshape(-1, STEP)[1:]

_TUNED = "block int, w double, v array<float>"
_PREPARED = "kind string, part long, code int, n long, blob binary"
_KNOWN = "piece long, code int, n long, v long, blob binary"


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"kind": pa.string(), "part": pa.int64(), "code": pa.int32(), "n": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], list(kinds))


def by_bucket(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings distinct words bucket by bucket, and where each bucket starts; the same bucket for a word everywhere."""
    bucket = (pd.util.hash_array(words, categorize=False) % BUCKETS).astype(np.uint16) if len(words) else np.zeros(0, np.uint16)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])


def pack_words(words: pa.Array, n: np.ndarray) -> bytes:
    """Words and their counts as bytes: lengths, counts, texts."""
    buffers, lo = words.buffers(), words.offset
    at = np.frombuffer(buffers[1], np.int64)[lo : lo + len(words) + 1]
    return np.diff(at).astype(np.int32).tobytes() + n.astype(np.int64).tobytes() + (memoryview(buffers[2])[at[0] : at[-1]].tobytes() if len(words) and buffers[2] else b"")


def unpack_words(blobs: list[bytes], each: list[int]) -> tuple[pa.Array, np.ndarray]:
    """All words of some pack_words() of ``each`` many words, and their counts."""
    size = np.concatenate([np.frombuffer(b, np.int32, k) for b, k in zip(blobs, each, strict=True)]).astype(np.int64)
    n = np.concatenate([np.frombuffer(b, np.int64, k, 4 * k) for b, k in zip(blobs, each, strict=True)])
    text = b"".join([memoryview(b)[12 * k :] for b, k in zip(blobs, each, strict=True)])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(text)]), n


def _count_words(key, rows):
    """For each piece's words of a bucket their counts in all pieces, in their order; with the first, the bucket's sum and its words seen in training."""
    each = rows.column("n").to_pylist()
    words, n = unpack_words(rows.column("blob").to_pylist(), each)
    coded = np.asarray(pc.dictionary_encode(words).indices)
    total = np.bincount(coded, n).astype(np.int64)
    known, k = total[coded], len(each)
    ends = np.cumsum(each).tolist()
    whole = {c: pa.array([int(x)] + [0] * (k - 1), pa.int64()) for c, x in (("n", total.sum()), ("v", (total > 0).sum()))}
    return pa.table({"piece": rows.column("part"), "code": rows.column("code"), **whole, "blob": pa.array([known[b - e : b].tobytes() for b, e in zip(ends, each, strict=True)], pa.binary())})


def _prepare(shared, piece: int):
    def run(batches):
        import uuid

        lines, size = shared.value
        subwords = Subwords(lines, size)
        end = size
        total = np.zeros((size + 1) ** 2, np.int64)
        for b in pieces(batches, most=piece):
            codes, words, offsets = split_words(b.column("text"))
            train = np.asarray(b.column("train"))
            known = words.to_numpy(zero_copy_only=False)
            order, starts = by_bucket(known)
            words = words.take(pa.array(order))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            codes = place[codes]
            ids, ends = subwords.encode(known[order].tolist())
            part = uuid.uuid4().int >> 65  # a name, fixed once the table is written
            n = np.bincount(codes[np.repeat(train, np.diff(offsets))], minlength=len(words))
            full = np.flatnonzero(np.diff(starts)).tolist()
            if full:
                cuts = [(starts[k], starts[k + 1]) for k in full]
                yield _rows(kind=["w"] * len(full), part=[part] * len(full), code=full, n=[int(y - x) for x, y in cuts], blob=[pack_words(words.slice(x, y - x), n[x:y]) for x, y in cuts])
            sink = pa.BufferOutputStream()
            keep = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(codes))], ["doc_id", "held_out", "codes"])
            with pa.ipc.new_stream(sink, options=pa.ipc.IpcWriteOptions(compression="zstd"), schema=keep.schema.with_metadata({"ids": ids.astype(np.uint16).tobytes(), "ends": ends.astype(np.int32).tobytes()})) as w:
                w.write_batch(keep)
            yield _rows(kind=["d"], part=[part], n=[int(train.sum())], blob=[sink.getvalue().to_pybytes()])
            windows = 0
            for lo, hi, flat, stops in some_texts(ids, ends, codes, offsets, end):
                pair = np.concatenate([[end], flat[:-1]])
                pair[stops[:-1]] = end
                pair *= size + 1
                pair += flat
                total += np.bincount(pair[np.repeat(train[lo:hi], np.diff(stops))], minlength=len(total))
                windows += int((-(-np.diff(stops)[train[lo:hi]] // STEP)).sum())
            yield _rows(kind=["s"], n=[windows])
        key = np.flatnonzero(total)
        block = key // (size + 1) // PAIR_BLOCK
        for k in np.unique(block):
            some = key[block == k]
            raw = np.concatenate([some, total[some]]).tobytes()
            yield _rows(kind=["p"], code=[int(k)], n=[len(raw)], blob=[pa.compress(raw, "zstd", asbytes=True)])

    return run


def _opened(blob: bytes):
    """A piece of _prepare(): its batch, the ids of its words and their offsets."""
    b = pa.ipc.open_stream(blob).read_all().combine_chunks()
    ids = np.frombuffer(b.schema.metadata[b"ids"], np.uint16).astype(np.int32)
    return b, ids, np.frombuffer(b.schema.metadata[b"ends"], np.int32).astype(np.int64)


def _strips(end: int, fraction: int):
    """The strips of the training texts of all pieces, cut when they are dealt: written beside the pieces they would be most of what is on disk."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                b, ids, ends = _opened(blob.as_py())
                lists = b.column("codes").combine_chunks()
                learn = ~np.asarray(b.column("held_out"))
                some = []
                for lo, hi, flat, stops in some_texts(ids, ends, np.asarray(lists.values), np.asarray(lists.offsets, dtype=np.int64), end):
                    for i in np.flatnonzero(learn[lo:hi]):
                        some += [r for r in strips(flat[stops[i] : stops[i + 1]], end) if fraction == 1 or zlib.crc32(r) % fraction == 0]
                        if len(some) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["blob"])
                            some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["blob"])

    return run


def _add_pairs(key, rows):
    """The counts of some blobs of one block of first ids, as one blob."""
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for raw, n in zip(rows.column("blob").to_pylist(), rows.column("n").to_pylist(), strict=True):
        both = np.frombuffer(pa.decompress(raw, n, "zstd", asbytes=True), np.int64)
        total = _merge(*total, both[: len(both) // 2], both[len(both) // 2 :])
    raw = np.concatenate(total).tobytes()
    return pa.table({"code": rows.column("code").slice(0, 1), "n": pa.array([len(raw)], pa.int64()), "blob": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())})


def salted(rows: DataFrame, most: int) -> DataFrame:
    """rows with a salt that deals them into groups of about ``most``."""
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-rows.count() // most)))).cast("int"))


def _merge(k1, c1, k2, c2):
    key, at = np.unique(np.concatenate([k1, k2]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([c1, c2]), len(key)).astype(np.int64)


def _pack(key, rows):
    """A shard as one row: its strips in order, and their weights."""
    rows = rows.sort_by("blob").combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return pa.table({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _round(shared, r: int, blocks: int):
    def run(batches):
        for b in batches:
            for raw in b.column("rows"):
                m = copy.copy(shared.value)
                m.p = {n: t.copy() for n, t in m.p.items()}
                rows = pa.ipc.open_stream(raw.as_py()).read_all()
                windows = [[t.astype(np.uint16) for t in unstrip(x, m.pad)] for x in rows.column("blob").to_pylist()]
                weight = np.repeat(np.asarray(rows.column("weight")), [len(y) for _, y in windows])
                with roomy():
                    m.train(np.concatenate([x for x, _ in windows]), np.concatenate([y for _, y in windows]), rate=0.02 / (1 + r), seed=r, weight=weight)
                parts = np.array_split(m.vector(), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([float(weight.sum())] * blocks), pa.array([p.astype(np.float32).tolist() for p in parts], pa.list_(pa.float32()))], ["block", "w", "v"])

    return run


def deal(strips: DataFrame, shards: int) -> DataFrame:
    """(shard, blob, weight): strips dealt to shards, equal ones in turn; those of a shard are one row with their count.

    One shuffle, by the shard alone: strips are most of what training moves.
    """
    turn = F.pmod(F.xxhash64("blob"), F.lit(shards)) + F.pmod(F.monotonically_increasing_id(), F.lit(shards))
    dealt = strips.select("blob", F.pmod(turn, F.lit(shards)).cast("int").alias("shard")).repartition(shards, "shard")
    return dealt.groupBy("shard", "blob").agg(F.count("*").cast("double").alias("weight"))


def _train(spark: SparkSession, windows: DataFrame, count: float, model: Attention, shard_windows: int, rounds: int) -> None:
    """Federated averaging: in each round every shard trains from the common start; parameters are averaged block by block. ``count``: about how many windows there are."""
    if not count:
        return
    shards = max(1, round(count / shard_windows))
    before = written_so_far()
    dealt = written(deal(windows, shards).groupBy("shard").applyInArrow(_pack, "rows binary"))
    sweep(spark)
    blocks = 16
    for r in range(rounds):
        shared = share(spark, model)

        def mean(key, rows):
            w = np.asarray(rows.column("w"))
            v = np.stack([np.asarray(x.values) for x in rows.column("v")])
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([float(w.sum())]), "v": pa.array([(w @ v / w.sum()).tolist()], pa.list_(pa.float32()))})

        tuned = written(dealt.mapInArrow(_round(shared, r, blocks), _TUNED))
        while tuned.count() > 64 * blocks:  # averages of averages, 64 shards at a time
            tuned = written(salted(tuned, 64 * blocks).groupBy("block", "salt").applyInArrow(mean, _TUNED))
        tuned = tuned.groupBy("block").applyInArrow(mean, _TUNED).toArrow().sort_by("block")  # as large as the model
        if not tuned.num_rows:  # no strip in ``fraction``
            break
        model.load(np.concatenate([np.asarray(x.values) for x in tuned["v"]]))
    release([t for t in written_so_far() if t not in before])
    sweep(spark)


def mixed(model: np.ndarray, seen: np.ndarray, n: int, v: int, mix: float) -> np.ndarray:
    """Log-probabilities of words: of the attention model, and of the corpus counts that fall back on it, in shares 1 - mix and mix.

    The counts give each word its count and the ``v`` distinct words' worth of
    mass that the model spreads over all words, seen or not. Without counts the
    model stands alone.
    """
    if not n:
        return model
    with np.errstate(divide="ignore", under="ignore"):
        counted = np.log(seen + v * np.exp(model)) - np.log(n + v)
    return np.logaddexp(np.log(mix) + counted, np.log1p(-mix) + model)


def score(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = 2048, fraction: int = 1, shard_windows: int = 40_000, rounds: int = 1, piece: int = 12_000_000, mix: float = 0.5) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, held_out); learns from the rows not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words
    counted in the training texts, one added) and score (log10 probability of
    the text, letters A-Z lowered and spaces joined, the end included: each
    word's by mixed() from the attention model and the counts). Null texts count
    as empty and have the end alone; texts are scored whole, however long, and
    equal ones alike; other columns are ignored; repeated rows are scored each. All training windows
    train the attention weights, or those of one strip in ``fraction``.
    Without training texts all counts are 0 and the model knows nothing.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        lines = [x for x in file.read().splitlines() if int(x.split()[1]) < size]
    shared = share(spark, (lines, size))
    rows = docs.select("doc_id", "held_out", "text", (~F.col("held_out")).alias("train"))
    table_ = written(rows.mapInArrow(_prepare(shared, piece), _PREPARED), by=["kind"])
    at = written_so_far()[-1][1]
    of = lambda k: table_.where(F.col("kind") == k)
    done = lambda k: release([(spark, f"{at}/kind={k}")])
    # one shuffle by bucket gives every piece the corpus counts of its words
    known = written(of("w").select("part", "code", "n", "blob").groupBy("code").applyInArrow(_count_words, _KNOWN))
    done("w")
    sweep(spark)
    whole = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    ends = of("d").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n, v = whole["n"] + ends, whole["v"] + (ends > 0)
    blocks = -(-(size + 1) // PAIR_BLOCK)
    blobs = salted(of("p").select("code", "n", "blob"), 64 * blocks).groupBy("code", "salt").applyInArrow(_add_pairs, "code int, n long, blob binary")  # 64 blobs or so at a time
    pairs = np.zeros((size + 1) ** 2)
    for raw in written(blobs).toLocalIterator():  # at most (size + 1) squared counts, from each 64 tasks' blobs
        both = np.frombuffer(pa.decompress(raw["blob"], raw["n"], "zstd", asbytes=True), np.int64)
        pairs[both[: len(both) // 2]] += both[len(both) // 2 :]
    done("p")
    sweep(spark)
    model = Attention(size + 1, pairs.reshape(size + 1, size + 1), classes=round(size**0.5))
    count = of("s").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] / fraction
    _train(spark, of("d").select("blob").mapInArrow(_strips(size, fraction), "blob binary"), count, model, shard_windows, rounds)
    trained = share(spark, model)
    known = known.select("piece", "code", "blob")

    def run(key, docs, words):
        m = trained.value
        end, pad = size, size + 1
        c = np.frombuffer(b"".join(words.sort_by("code").column("blob").to_pylist()), np.int64)  # a piece's words lie bucket by bucket
        out = []
        with roomy():
            for blob in docs.column("blob").to_pylist():
                b, ids, stops = _opened(blob)
                lists = b.column("codes").combine_chunks()
                codes, offsets = np.asarray(lists.values), np.asarray(lists.offsets, dtype=np.int64)
                for lo, hi, flat, ends_at in some_texts(ids, stops, codes, offsets, end, 100_000):
                    mine, at = codes[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                    x, y, _ = cut(flat, ends_at, end, pad)
                    each = m.logp(x, y)[y != pad]  # in the order of the ids
                    token = np.insert(np.diff(stops)[mine], at[1:], 1)  # ids of each word, one for each end
                    word = sums(each, np.concatenate([[0], np.cumsum(token)]))
                    seen = np.insert(c[mine].astype(np.float64), at[1:], ends)
                    lp = sums(mixed(word, seen, n, v, mix), at + np.arange(len(at)))
                    base = sums(np.log10(c[mine] + 1.0), at) + np.log10(ends + 1)
                    tokens = np.diff(at) + 1
                    base -= tokens * np.log10(n + v + 1)
                    good = sums((c[mine] > 0).astype(np.float64), at).astype(np.int64) + (ends > 0)
                    out.append(pa.table({"doc_id": b.column("doc_id").slice(lo, hi - lo), "held_out": b.column("held_out").slice(lo, hi - lo), "n_tokens": tokens, "n_known": good, "train_tokens": np.full(len(tokens), n, np.int64), "base_score": base, "score": lp / np.log(10)}))
        return pa.concat_tables(out) if out else _EMPTY.empty_table()

    return of("d").select("part", "blob").groupBy("part").cogroup(known.groupBy("piece")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", remainder("doc_id", 7) == 2)
    return score(docs)
