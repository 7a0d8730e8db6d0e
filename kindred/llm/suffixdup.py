"""Exact substring duplicates by external induced sorting of suffixes.

Every window of ``window`` bytes is named by its anchor, the 32-byte gram of
the smallest hash in it, so equal windows have equal anchors, and so have the
beginnings of equal strings of ``length``, at least as long. Consecutive
windows with one anchor form a run, with the bytes up to ``length`` that follow. Runs of an anchor with more bytes than a
shard may have are split, in up to three steps, by where the anchor lies in the
window and by the bytes that all windows of such a part share; equal windows
stay together. Identical runs are taken together with their count: those whose
anchor has no other run are done, repeated throughout or not at all. The rest
are dealt to shards by anchor, so that equal windows always meet in one shard;
there, parts of runs whose common bytes no other run has go first. A shard's suffixes are sorted by induced sorting: the
leftmost-smaller suffixes' substrings are ranked and named, equal names send
the names' string through the same steps again (or, once its names are many and
rare, through a sort by doubled prefixes), and their order induces that of the
other suffixes through one queue for each first symbol, read and filled in
order. Large queues live in memory-mapped files. Common prefixes of neighbours,
up to ``length``, follow in one pass over the finished order.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship, table, written

GRAM = 32
_ZERO = np.zeros(1, np.int64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Queues:
    """One first-in-first-out queue of whole numbers for each symbol, in a file when large."""

    def __init__(self, sizes: np.ndarray, folder: str | None):
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.fill = self.start[:-1].copy()
        n = int(self.start[-1])
        if folder and n > 1 << 20:
            fd, path = tempfile.mkstemp(dir=folder)
            os.close(fd)
            self.data = np.memmap(path, np.int64, "w+", shape=(max(n, 1),))
        else:
            self.data = np.empty(max(n, 1), np.int64)

    def put(self, symbols: np.ndarray, values: np.ndarray) -> None:
        """Append in the given order."""
        if len(values) <= 12:  # most symbols of a names' string: no array work pays
            data, fill = self.data, self.fill
            for c, x in zip(symbols.tolist(), values.tolist(), strict=True):
                at = fill[c]
                data[at] = x
                fill[c] = at + 1
            return
        order = symbols.argsort(kind="stable")
        s = symbols[order]
        first = (s[1:] != s[:-1]).nonzero()[0] + 1
        first = np.concatenate([_ZERO, first])
        size = np.empty(len(first), np.int64)
        np.subtract(first[1:], first[:-1], out=size[:-1])
        size[-1] = len(s) - first[-1]
        place = np.arange(len(s)) + (self.fill[s[first]] - first).repeat(size)
        self.data[place] = values[order]
        self.fill[s[first]] += size


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the end counts as smallest of all, and as such)."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    at = np.where(step != 0, np.arange(n), n - 1)
    at[-1] = n - 1
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    s = step[nxt] > 0
    s[nxt == n - 1] = False
    s[-1] = True
    # a run of equal symbols before the end is larger than the end
    return s


def _doubling(t: np.ndarray) -> np.ndarray:
    """Suffix order of a string in memory, by ranks of doubled prefixes; only suffixes that are not told apart yet are sorted again."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    s = t[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    size = np.diff(np.r_[starts, n])
    rank[order] = np.repeat(starts, size)  # ranks are places of the first of equals
    left = order[np.repeat(size > 1, size)]
    k = 1
    while len(left):
        second = rank[np.minimum(left + k, n)]
        first = rank[left]
        o = np.lexsort((second, first))
        left, first, second = left[o], first[o], second[o]
        head = np.r_[True, first[1:] != first[:-1]]
        heads = np.flatnonzero(head)
        inside = np.arange(len(o)) - np.repeat(heads, np.diff(np.r_[heads, len(o)]))
        starts = np.flatnonzero(head | np.r_[True, second[1:] != second[:-1]])
        size = np.diff(np.r_[starts, len(o)])
        rank[left] = first + np.repeat(inside[starts], size)
        left = left[np.repeat(size > 1, size)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, size: int, folder: str | None) -> np.ndarray:
    """Order of all suffixes from the order of the leftmost-smaller ones (seeds), chunk by chunk through the queues."""
    n = len(t)
    larger, smaller = ~s_type, s_type
    lq = Queues(np.bincount(t[larger], minlength=size), folder)
    by_symbol = np.split(seeds, np.cumsum(np.bincount(t[seeds], minlength=size))[:-1])
    symbols = np.flatnonzero(np.bincount(t, minlength=size))

    def induced(at: np.ndarray, want: np.ndarray) -> np.ndarray:
        before = at[at > 0] - 1
        return before[want[before]]

    for c in symbols:  # larger suffixes, upwards: those of a symbol come before its smaller ones
        lo = lq.start[c]
        while lo < lq.fill[c]:
            hi = min(lq.fill[c], lo + (1 << 20))
            new = induced(np.asarray(lq.data[lo:hi]), larger)
            lq.put(t[new], new)
            lo = hi
        new = induced(by_symbol[c], larger)
        lq.put(t[new], new)
    sq = Queues(np.bincount(t[smaller], minlength=size), folder)  # filled from the largest down
    for c in symbols[::-1]:
        lo = sq.start[c]
        while lo < sq.fill[c]:
            hi = min(sq.fill[c], lo + (1 << 20))
            new = induced(np.asarray(sq.data[lo:hi]), smaller)
            sq.put(t[new], new)
            lo = hi
        new = induced(np.asarray(lq.data[lq.start[c] : lq.fill[c]])[::-1], smaller)
        sq.put(t[new], new)
    if sq.fill[t[n - 1]] < sq.start[t[n - 1] + 1]:
        sq.put(t[n - 1 :], np.array([n - 1]))  # the end itself, which nothing induces
    out = np.empty(n, np.int64)
    at = 0
    for c in symbols:
        for part in (lq.data[lq.start[c] : lq.fill[c]], sq.data[sq.start[c] : sq.fill[c]][::-1]):
            out[at : at + len(part)] = part
            at += len(part)
    return out


def suffix_order(t: np.ndarray, folder: str | None = None, base: int = 1 << 12) -> np.ndarray:
    """Suffix array of a string of small whole numbers whose last symbol is its only 0.

    Short strings, and strings of names with few places for each name, for
    which queues by symbol do not pay, are ordered in memory.
    """
    if len(t) <= base or int(t.max()) * 16 > len(t) and int(t.max()) > 1024:
        return _doubling(t)
    t = t.astype(np.int64)
    size = int(t.max()) + 1
    s_type = _types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, s_type, lms, size, folder)
    # names of the substrings between leftmost-smaller places: equal ones equal, in order
    length = np.diff(np.r_[lms, len(t) - 1]) + 1
    names = _name(t, lms, length)
    if names.max() < len(lms) - 1:
        order = suffix_order(names, folder, base)
    else:
        order = np.argsort(names, kind="stable")
    return _induce(t, s_type, lms[order], size, folder)


def _name(t: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ranks of substrings, by refining ranks some symbols at a time; one that ends ranks after its extensions, which go on with a larger-type symbol."""
    n = len(at)
    rank = np.zeros(n, np.int64)
    left = np.arange(n)
    k = 0
    longest = int(length.max())
    wide = np.uint64(max(int(t.max()) + 2, 2))
    per = max(1, int(62 // np.log2(float(wide))))
    padded = np.r_[t, np.zeros(per, t.dtype)]
    while k < longest and len(left):
        key = np.zeros(len(left), np.uint64)
        for j in range(per):
            here = np.where(k + j < length[left], padded[np.minimum(at[left] + k + j, len(t))], wide - np.uint64(1))
            key = key * wide + here.astype(np.uint64)
        order = np.lexsort((key, rank[left]))
        a, b = rank[left][order], key[order]
        group = np.r_[True, a[1:] != a[:-1]]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        firsts = np.flatnonzero(group)
        offset = np.arange(len(order)) - np.repeat(firsts, np.diff(np.r_[firsts, len(order)]))
        starts = np.flatnonzero(new)
        lead = np.repeat(offset[starts], np.diff(np.r_[starts, len(order)]))
        rank[left[order]] = a + lead  # ranks are places: refining keeps them in order
        k += per
        sizes = np.diff(np.r_[starts, len(order)])
        again = np.repeat(sizes > 1, sizes)
        left = left[order[again]]
        left = left[length[left] > k]
    return np.unique(rank, return_inverse=True)[1].astype(np.int64)


def common_prefix(data: np.ndarray, order: np.ndarray, most: int, at_once: int = 4096) -> np.ndarray:
    """Common prefix of each suffix of ``order`` with the one before, ``most`` at most; whole stretches are compared at a time."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(most + 1, np.uint8)]), most)
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), at_once):
        hi = min(lo + at_once, len(order))
        both = rows[order[lo - 1 : hi]]
        other = both[1:] != both[:-1]
        first = other.argmax(1)
        out[lo:hi] = np.where(other[np.arange(hi - lo), first], first, most)
    return out


def repeated_starts(runs: list[bytes], starts: np.ndarray, weights: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each run, which of its starts (starts of them, from its first byte) begin a string of ``length`` that is seen twice, runs counting weights times; and its longest string seen twice, ``length`` at most."""
    size = np.array([len(r) + 1 for r in runs], np.int64)
    base = np.cumsum(size) - size
    # byte b is symbol b + 2, a run's end 1, the end of all 0
    t = np.ones(int(size.sum()) + 1, np.int64)
    flat = np.frombuffer(b"".join(runs), np.uint8)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(runs)), size - 1)
    t[place] = flat.astype(np.int64) + 2
    t[-1] = 0
    folder = tempfile.mkdtemp(prefix="kindred-sort-")
    try:
        order = suffix_order(t, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    inside = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    at = inside + np.repeat(base, starts)
    weight, left = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    weight[at] = np.repeat(weights, starts)
    left[at] = np.minimum(np.repeat(size - 1, starts) - inside, length)  # bytes up to the run's end
    mine = order[weight[order] > 0]
    some, own = left[mine], weight[mine] > 1
    common = common_prefix((t[:-1] - 2).astype(np.uint8), mine, length)
    common[1:] = np.minimum(common[1:], np.minimum(some[1:], some[:-1]))
    group = np.cumsum(common < length)
    again = np.zeros(len(t), bool)
    again[mine] = (np.bincount(group, weight[mine])[group] > 1) & (some >= length)
    best = np.maximum(common, np.concatenate([common[1:], _ZERO]))
    longest = np.zeros(len(t), np.int64)
    longest[mine] = np.maximum(best, np.where(own, some, 0))
    return [again[b : b + n] for b, n in zip(base, starts, strict=True)], np.array([longest[b : b + n].max(initial=0) for b, n in zip(base, starts, strict=True)], np.int64)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first start, number of starts, anchor's place, its hash."""
    n = len(data)
    span = length - GRAM + 1  # grams in a window
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    k = 8
    with np.errstate(over="ignore"):
        while k < GRAM:
            x = (x[:-k] * _M1) ^ (x[k:] * _M2 >> np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= _M1
            k *= 2
    h = x
    key = (h & np.uint64(0xFFFFFFFFFC000000)) | np.arange(len(h), dtype=np.uint64) if len(h) <= 1 << 26 else None
    if key is None:
        raise ValueError("texts beyond 64 MB must be cut by the caller")
    pad = -len(key) % span
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, span)
    fore = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[: n - length + 1], fore[span - 1 : span - 1 + n - length + 1])
    place = (least & np.uint64(0x3FFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(place)])
    return first, count, place[first], h[place[first]]


def _name_run(raw: bytes, start: int, n: int, length: int) -> tuple[int, int]:
    """Size of a run, whose strings go on to ``length`` where the text does, and a digest of it."""
    own = raw[start : start + n - 1 + length]
    return len(own), int.from_bytes(hashlib.md5(b"%d " % n + own).digest()[:8], "little", signed=True)


def _cut(window: int, length: int, most: int = 1 << 26):
    def run(batches):
        for b in pieces(batches):
            out = {k: [] for k in ("k0", "k1", "anchor", "off", "start", "n", "size", "digest")}
            for k0, k1, text in zip(b.column("k0").to_pylist(), b.column("k1").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if text is None or len(text) < window:
                    continue
                data = np.frombuffer(text, np.uint8)
                for lo in range(0, len(text) - window + 1, most - window + 1):  # pieces overlap by window - 1
                    first, count, place, h = anchors(data[lo : lo + most], window)
                    out["off"].append(place - first)
                    first = first + lo
                    out["k0"] += [k0] * len(first)
                    out["k1"] += [k1] * len(first)
                    out["anchor"].append(h.view(np.int64))
                    out["start"].append(first)
                    out["n"].append(count)
                    for i, c in zip(first.tolist(), count.tolist(), strict=True):
                        size, digest = _name_run(text, i, c, length)
                        out["size"].append(size)
                        out["digest"].append(digest)
            if out["k0"]:
                cols = [pa.array(out["k0"]), pa.array(out["k1"]), pa.array(np.concatenate(out["anchor"])), pa.array(np.concatenate(out["off"]).astype(np.int32)), pa.array(np.concatenate(out["start"]).astype(np.int32)), pa.array(np.concatenate(out["n"]).astype(np.int32)), pa.array(out["size"], pa.int32()), pa.array(out["digest"], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, list(out))

    return run


def _split(window: int, length: int, width: int):
    """Runs cut where the anchor's offset in the window passes a multiple of width, keyed by the bytes in all windows of such offsets."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = r["text"].encode("utf-8", "surrogatepass")
                out = []
                for x in r["runs"]:
                    last = x["start"] + x["n"] - 1
                    place = x["start"] + x["off"]
                    for tier in range((place - last) // width, x["off"] // width + 1):
                        near, far = tier * width, tier * width + width - 1
                        lo, hi = max(x["start"], place - far), min(last, place - near)
                        shared = raw[place - near : place - far + window]
                        key = hashlib.md5(b"%d %d %d " % (x["anchor"], width, tier) + shared).digest()[:8]
                        out.append((r["k0"], r["k1"], int.from_bytes(key, "little", signed=True), place - lo, lo, hi - lo + 1, *_name_run(raw, lo, hi - lo + 1, length)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["k0", "k1", "anchor", "off", "start", "n", "size", "digest"])

    return run


_RUN = "k0 long, k1 long, anchor long, off int, start int, n int, size int, digest long"


def _kinds(runs: DataFrame) -> DataFrame:
    """Distinct runs with their counts and one place of each."""
    return runs.groupBy("anchor", "digest").agg(F.count("*").alias("weight"), F.min(F.struct("k0", "k1", "start", "n", "size", "off")).alias("at"))


def spread(keyed: DataFrame, runs: DataFrame, window: int, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The runs, those of anchors whose distinct runs have more than ``most`` bytes split, and their kinds."""
    kinds = written(_kinds(runs))
    for width in (max(1, window // 6), max(1, window // 48), 1):
        hot = kinds.groupBy("anchor").agg(F.sum("at.size").alias("b"), F.count("*").alias("m")).where((F.col("b") > most) & (F.col("m") > 1)).select("anchor")
        hot = written(hot)  # no more than all bytes / most
        if hot.isEmpty():
            break
        hot = F.broadcast(hot)
        texts = runs.join(hot, "anchor").groupBy("k0", "k1").agg(F.collect_set(F.struct("anchor", "off", "start", "n")).alias("runs"))
        parts = keyed.select("k0", "k1", "text").join(written(texts), ["k0", "k1"]).mapInArrow(_split(window, length, width), _RUN)
        parts = written(parts)
        runs = runs.join(hot, "anchor", "left_anti").unionByName(parts)
        kinds = written(kinds.join(hot, "anchor", "left_anti").unionByName(_kinds(parts)))
    return runs, kinds


def _fetch(batches):
    for b in batches:
        for r in b.to_pylist():
            raw = r["text"].encode("utf-8", "surrogatepass")
            runs = r["runs"]
            yield pa.RecordBatch.from_arrays([
                pa.array([x["anchor"] for x in runs]), pa.array([x["digest"] for x in runs], pa.int64()), pa.array([x["off"] for x in runs], pa.int32()), pa.array([x["n"] for x in runs], pa.int32()), pa.array([x["weight"] for x in runs], pa.int64()),
                pa.array([raw[x["start"] : x["start"] + x["size"]] for x in runs], pa.binary()),
            ], ["anchor", "digest", "off", "n", "weight", "bytes"])


def shared_starts(runs: list[bytes], anchor: list[int], off: list[int], starts: list[int], window: int) -> list[tuple[int, int, int]]:
    """(run, first start, number of starts) of the parts of runs that may hold a window of another run.

    Windows whose anchor's offset lies within one tier have some bytes in
    common, all but a sixth of a window. Equal windows lie in one tier of one
    anchor and share those bytes, so a tier whose bytes no other run has goes.
    """
    width = max(1, window // 6)
    seen: dict[tuple, int] = {}
    met = []  # (run, lo, hi, key)
    for r, (raw, a, place, n) in enumerate(zip(runs, anchor, off, starts, strict=True)):
        for tier in range((place - n + 1) // width, place // width + 1):
            near, far = tier * width, tier * width + width - 1
            key = (a, tier, raw[place - near : place - far + window])
            seen[key] = r if seen.setdefault(key, r) == r else -1
            met.append((r, max(0, place - far), min(n - 1, place - near), key))
    out: list[tuple[int, int, int]] = []
    for r, lo, hi, key in sorted((x for x in met if seen[x[3]] < 0), key=lambda x: x[:2]):
        if out and out[-1][0] == r and out[-1][1] + out[-1][2] == lo:
            out[-1] = (r, out[-1][1], hi - out[-1][1] + 1)
        else:
            out.append((r, lo, hi - lo + 1))
    return out


def _sort(window: int, length: int):
    def run(key, rows):
        runs = rows.column("bytes").to_pylist()
        starts, weights = rows.column("n").to_pylist(), np.asarray(rows.column("weight"))
        # copies of a run agree from every start
        longest = np.where(weights > 1, np.minimum([len(r) for r in runs], length), 0)
        hits = [np.arange(n) + length <= len(r) if w > 1 else np.zeros(n, bool) for r, n, w in zip(runs, starts, weights.tolist(), strict=True)]
        parts = shared_starts(runs, rows.column("anchor").to_pylist(), rows.column("off").to_pylist(), starts, window)
        if parts:
            found, own = repeated_starts([runs[r][lo : lo + n - 1 + length] for r, lo, n in parts], np.array([n for _, _, n in parts]), weights[[r for r, _, _ in parts]], length)
            for (r, lo, n), f, m in zip(parts, found, own.tolist(), strict=True):
                hits[r][lo : lo + n] |= f
                longest[r] = max(longest[r], m)
        some = np.flatnonzero(longest >= window).tolist()
        at = pa.array(some, pa.int64())
        return pa.table({"anchor": rows.column("anchor").take(at), "digest": rows.column("digest").take(at), "longest": pa.array(longest[some], pa.int32()), "hit": pa.array([np.packbits(hits[k]).tobytes() if hits[k].any() else b"" for k in some], pa.binary())})

    return run


def _remove(length: int):
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["sha"]:
                    out.append((r["doc_id"], r["n_bytes"], 0, 0, r["sha"], [], r["longest"]))
                    continue
                raw = r["text"].encode("utf-8", "surrogatepass")
                cover = np.zeros(len(raw) + 1, np.int64)
                for x in r["runs"]:
                    # without bits every start has the strings of the run's copies
                    hit = np.arange(x["size"] - length + 1) if x["hit"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(x["hit"], np.uint8), count=x["n"]))
                    np.add.at(cover, x["start"] + hit, 1)
                    np.add.at(cover, x["start"] + hit + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                spans = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((r["doc_id"], len(raw), int(gone.sum()), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans.tolist(), r["longest"]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "longest_repeat"])

    return run


def substring_duplicates(docs: DataFrame, length: int = 400, window: int = 260, shard_bytes: int = 4_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends in turn) and longest_repeat.

    Removes every byte of a text's UTF-8 that a string of ``length`` bytes
    covers which also starts anywhere else, judged on the texts as given.
    longest_repeat is the longest string of the text that starts anywhere else,
    too: ``length`` stands for that and more, and what is below ``window`` (at
    most ``length``) counts as 0. Null texts count as empty; repeated rows are
    texts of their own; other columns are ignored. Texts of any length are
    whole: beyond 64 MB they are cut into overlapping pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k0"), F.xxhash64("text", "doc_id").alias("k1"))
    runs = written(keyed.select("k0", "k1", "text").mapInArrow(_cut(window, length), _RUN))
    runs, kinds = spread(keyed, runs, window, length, shard_bytes)
    often = kinds.groupBy("anchor").agg(F.sum("weight").alias("all"), F.count("*").alias("m")).where("all > 1")
    kinds = written(kinds.join(written(often), "anchor"))
    # an anchor with one kind of run: its copies agree wherever they begin, and nothing else can
    alike = kinds.where("m = 1").select("anchor", "digest", F.least(F.col("at.size"), F.lit(length)).alias("longest"), F.lit(None).cast("binary").alias("hit"))
    kinds = kinds.where("m > 1")
    total = kinds.agg(F.coalesce(F.sum("at.size"), F.lit(0)).alias("b")).first()["b"]
    shards = max(1, -(-int(total) // shard_bytes))
    wanted = kinds.groupBy("at.k0", "at.k1").agg(F.collect_list(F.struct("anchor", "digest", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.size").alias("size"), F.col("at.off").alias("off"), "weight")).alias("runs"))
    fetched = keyed.select("k0", "k1", "text").join(written(wanted), ["k0", "k1"])
    fetched = fetched.select("text", "runs").mapInArrow(_fetch, "anchor long, digest long, off int, n int, weight long, bytes binary")
    fetched = fetched.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    hits = fetched.groupBy("shard").applyInArrow(_sort(window, length), "anchor long, digest long, longest int, hit binary")
    hits = written(hits.unionByName(alike).dropDuplicates(["anchor", "digest"]))
    marks = F.collect_set(F.when((F.col("size") >= length) & (F.col("hit").isNull() | (F.length("hit") > 0)), F.struct("start", "n", "size", "hit")))  # nulls are left out
    told = written(runs.join(hits, ["anchor", "digest"]).groupBy("k0", "k1").agg(marks.alias("runs"), F.max("longest").cast("long").alias("longest")))
    text = F.coalesce(F.col("text"), F.lit(""))
    # only texts that lose bytes go to Python
    cut = F.size("runs") > 0
    out = keyed.join(told, ["k0", "k1"], "left").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.when(~F.coalesce(cut, F.lit(False)), F.sha2(text.cast("binary"), 256)).alias("sha"), F.when(cut, F.col("text")).alias("text"), "runs", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))
    return out.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, longest_repeat long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return substring_duplicates(docs).drop("spans")
