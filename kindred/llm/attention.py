"""A one-layer causal self-attention model over subword ids, in numpy.

Every id has a query, key, value and residual vector. A position attends to the
inputs up to its own within a window of twice ``STEP``; the sum goes to a
two-step softmax (class, then id within the class) whose biases are the
smoothed log-probabilities of id pairs in the whole training text. Windows
overlap by half: each token is scored once, with at least ``STEP`` inputs
before it where the text has them.
"""

from __future__ import annotations

import numpy as np

STEP = 32
#: Windows whose attention is worked out at once: what a processor keeps at hand.
PART = 64
_CAUSAL = np.where(np.arange(2 * STEP)[None, :] <= STEP + np.arange(STEP)[:, None], 0.0, -1e9).astype(np.float32)
_SEEN = (_CAUSAL == 0).astype(np.float32)


def cut(ids: np.ndarray, offsets: np.ndarray, first: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of inputs (n x 2 STEP) and targets (n x STEP, pad where there is none) of all sequences, and the sequence of each."""
    size = np.diff(offsets)
    n = -(-size // STEP)
    base = np.concatenate([[0], np.cumsum((n + 1) * STEP)])
    line = np.full(base[-1] + STEP, pad, ids.dtype)
    goal = np.full(base[-1] + STEP, pad, ids.dtype)
    place = np.arange(len(ids)) - np.repeat(offsets[:-1], size) + np.repeat(base[:-1], size) + STEP
    goal[place] = ids
    head = np.zeros(len(ids), bool)
    head[offsets[:-1][size > 0]] = True
    line[place] = np.where(head, first, np.concatenate([[first], ids[:-1]]))
    of = np.repeat(np.arange(len(size)), n)
    starts = np.repeat(base[:-1], n) + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return line[starts[:, None] + np.arange(2 * STEP)], goal[starts[:, None] + np.arange(STEP, 2 * STEP)], of


class Attention:
    def __init__(self, size: int, pairs: np.ndarray, dim: int = 16, classes: int = 32, smooth: float = 30.0, seed: int = 1):
        """size: ids including the end; pairs: size x size counts of (before, id)."""
        self.size, self.pad, self.dim = size, size, dim
        unigram = pairs.sum(0) + 1.0
        order = np.argsort(-unigram, kind="stable")
        self.m = -(-size // classes)
        self.classes = -(-size // self.m)
        self.slot = np.zeros(size + 1, np.int64)
        self.slot[order] = np.arange(size)
        p = (pairs + smooth * unigram / unigram.sum()) / (pairs.sum(1, keepdims=True) + smooth)
        table = np.zeros((size + 1, self.classes * self.m))
        table[:size, self.slot[:size]] = p
        table = table.reshape(size + 1, self.classes, self.m)
        self.bias_in = np.log(np.maximum(table, 1e-30)).astype(np.float32)
        self.bias_class = np.log(np.maximum(table.sum(2), 1e-30)).astype(np.float32)
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(dim)).astype(np.float32)
        self.p = {"q": g(size + 1, dim) * 3, "k": g(size + 1, dim) * 3, "v": g(size + 1, dim), "r": g(size + 1, dim), "pq": g(STEP, dim), "pk": g(2 * STEP, dim), "c": g(dim, self.classes) * 0.1, "w": g(self.classes, dim, self.m) * 0.1}

    def _attend(self, x: np.ndarray):
        p = self.p
        k, v, q = p["k"][x] + p["pk"], p["v"][x], p["q"][x[:, STEP:]] + p["pq"]
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(1 / np.sqrt(self.dim))
        s += _CAUSAL
        s += np.where(x == self.pad, np.float32(-1e9), np.float32(0))[:, None, :]
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        return s, q, k, v, s @ v + p["r"][x[:, STEP:]]

    def logp(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target; 0 where there is none."""
        out = np.zeros(y.shape, np.float32)
        # queries scaled, values with a column of ones that counts the weights; the padding adds nothing to either
        p = self.p
        q, pq = p["q"] * np.float32(1 / np.sqrt(self.dim)), p["pq"] * np.float32(1 / np.sqrt(self.dim))
        v = np.c_[p["v"], np.ones(self.size + 1, np.float32)].astype(np.float32)
        v[self.pad] = 0
        for lo in range(0, len(x), 4 * PART):
            xs, ys = x[lo : lo + 4 * PART], y[lo : lo + 4 * PART]
            now = xs[:, STEP:]
            place = np.flatnonzero(ys != self.pad)
            before, goal = now.ravel().take(place), self.slot.take(ys.ravel().take(place))
            h = p["r"].take(now, 0)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                for a in range(0, len(xs), PART):
                    at = xs[a : a + PART]
                    s = (q.take(at[:, STEP:], 0) + pq) @ (p["k"].take(at, 0) + p["pk"]).transpose(0, 2, 1)
                    np.exp(s, out=s)
                    s *= _SEEN
                    both = s @ v.take(at, 0)
                    h[a : a + PART] += both[:, :, :-1] / both[:, :, -1:]
                got = self._targets(h.reshape(-1, self.dim).take(place, 0), before, goal)
            if not np.isfinite(got).all():  # too large for plain exponentials
                got = self._targets(self._attend(xs)[4].reshape(-1, self.dim).take(place, 0), before, goal, True)
            out[lo : lo + 4 * PART].reshape(-1)[place] = got
        return out

    def _targets(self, h: np.ndarray, prev: np.ndarray, slot: np.ndarray, careful: bool = False) -> np.ndarray:
        cls, within = slot // self.m, slot % self.m
        z = h @ self.p["c"]
        z += self.bias_class.take(prev, 0)
        if careful:
            z -= z.max(1, keepdims=True)
        got = z[np.arange(len(z)), cls]
        np.exp(z, out=z)
        got = got - np.log(z @ np.ones(self.classes, np.float32))
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls, h = cls.take(order), h.take(order, 0)  # a class's targets are a slice
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        z = self.bias_in.reshape(-1, self.m).take(prev.take(order) * self.classes + cls, 0)
        for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                z[lo:hi] += h[lo:hi] @ self.p["w"][c]
        if careful:
            z -= z.max(1, keepdims=True)
        at = z[np.arange(len(z)), within.take(order)]
        np.exp(z, out=z)
        got[order] += at - np.log(z @ np.ones(self.m, np.float32))
        return got

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scaled queries, and values with a column of ones that counts the weights."""
        return self.p["q"] * np.float32(1 / np.sqrt(self.dim)), np.c_[self.p["v"], np.ones(self.size + 1, np.float32)].astype(np.float32)

    def _forward(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None):
        """Weights before they are divided by their sums, the sums' inverses, scaled queries, keys, values with a column of ones, and what is attended to."""
        p, by = self.p, np.float32(1 / np.sqrt(self.dim))
        now = x[:, STEP:]
        queries, values = tables or self._tables()
        k = p["k"].take(x, 0)
        k += p["pk"]
        q = queries.take(now, 0)
        q += p["pq"] * by
        v = values.take(x, 0)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            s = q @ k.transpose(0, 2, 1)
            np.exp(s, out=s)
            s *= _SEEN
            void = x == self.pad
            some = np.flatnonzero(void.any(1))
            if len(some):
                s[some] *= ~void[some][:, None, :]
            both = s @ v
            total = both[:, :, -1:]
            inv = np.where(total == 0, np.float32(0), 1 / total)  # nothing but padding before the place
            got = both[:, :, :-1] * inv
        # sums that plain exponentials keep as numbers of full precision
        if not np.isfinite(got).all() or ((total < 1e-30) & ~void[:, STEP:, None]).any():
            s, _, _, _, _ = self._attend(x)
            if len(some):
                s[some] *= ~void[some][:, None, :]
            inv = np.ones_like(total)
            got = s @ v[:, :, :-1]
        return s, inv, q, k, v, got

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, careful: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the targets, each window counting weight times, and its gradient."""
        now, ok = x[:, STEP:], y != self.pad
        parts = [slice(lo, lo + PART) for lo in range(0, len(x), PART)]
        tables = self._tables()
        kept = [self._forward(x[at], tables) for at in parts]
        slot = self.slot[y[ok]]
        # targets in the order of their classes, so that a class's are a slice
        order = np.argsort((slot // self.m).astype(np.uint16), kind="stable")
        place = np.flatnonzero(ok)[order]
        slot, prev = slot[order], now.ravel().take(place)
        cls, within = slot // self.m, slot % self.m
        h = self.p["r"].take(now, 0)
        for at, of in zip(parts, kept, strict=True):
            h[at] += of[5]
        h = h.reshape(-1, self.dim).take(place, 0)
        each = np.repeat((np.ones(len(x)) if weight is None else weight).astype(np.float32), ok.sum(1))[order]
        n = each.sum() if len(h) else np.float32(1)
        each /= n
        z = h @ self.p["c"]
        z += self.bias_class.take(prev, 0)
        loss, hs, scale = self._softmax(z, cls, h, each, careful)
        g = {"c": hs.T @ z, "w": np.zeros_like(self.p["w"])}
        dh = z @ self.p["c"].T
        dh *= scale
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        some = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
        z = self.bias_in.reshape(-1, self.m).take(prev * self.classes + cls, 0)
        for c, at in some:
            z[at] += h[at] @ self.p["w"][c]
        more, hs, scale = self._softmax(z, within, h, each, careful)
        loss += more
        back = np.empty_like(h)
        for c, at in some:
            np.matmul(hs[at].T, z[at], out=g["w"][c])
            np.matmul(z[at], self.p["w"][c].T, out=back[at])
        back *= scale
        dh += back
        if not careful and not (np.isfinite(loss) and np.isfinite(dh).all()):  # too large for plain exponentials
            return self.gradient(x, y, weight, True)
        flow = np.zeros((*now.shape, self.dim), np.float32)
        flow.reshape(-1, self.dim)[place] = dh
        # rows of the inputs seen before, and of those that targets follow: what flows to values and keys, to the residual and queries; a last row of zeros
        d = self.dim
        old, new = np.zeros((len(x) * STEP + 1, 2 * d), np.float32), np.zeros((len(x) * STEP + 1, 4 * d), np.float32)
        olds, news = old[:-1].reshape(-1, STEP, 2 * d), new[:-1].reshape(-1, STEP, 4 * d)
        news[:, :, 2 * d : 3 * d] = flow
        for at, (s, inv, q, k, v, attended) in zip(parts, kept, strict=True):
            # of a place: what flows to it, times the inverse of its sum; last, what the sum itself takes off
            here = np.empty((len(s), STEP, d + 1), np.float32)
            here[:, :, :-1] = flow[at]
            np.negative(np.einsum("nid,nid->ni", flow[at], attended), out=here[:, :, -1])
            here *= inv
            ds = here @ v.transpose(0, 2, 1)
            ds *= s
            st, dst, here = s.transpose(0, 2, 1), ds.transpose(0, 2, 1), here[:, :, :-1]
            for to, half in ((olds[at], slice(STEP)), (news[at], slice(STEP, None))):
                np.matmul(st[:, half], here, out=to[:, :, :d])
                np.matmul(dst[:, half], q, out=to[:, :, d : 2 * d])
            np.matmul(ds, k, out=news[at][:, :, 3 * d :])
        places = news.sum(0)
        g["pq"], g["pk"] = places[:, 3 * d :] * np.float32(1 / np.sqrt(d)), np.concatenate([olds.sum(0)[:, d:], places[:, d : 2 * d]])
        total = self._by_id(now, new)
        total[:, : 2 * d] += self._by_id(x[:, :STEP], old)
        total[:, 3 * d :] *= np.float32(1 / np.sqrt(d))
        g["v"], g["k"], g["r"], g["q"] = (total[:, i * d : (i + 1) * d] for i in range(4))
        return float(loss), {name: g[name] for name in self.p}

    @staticmethod
    def _softmax(z: np.ndarray, goal: np.ndarray, h: np.ndarray, each: np.ndarray, careful: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss of the goals, and rows ``h`` scaled for the gradient, and the scale; ``z`` becomes the gradient before it is scaled."""
        at, ones = np.arange(len(z)), np.ones(z.shape[1], np.float32)
        if careful:
            z -= z.max(1, keepdims=True)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            np.exp(z, out=z)
            total = z @ ones
            got = z[at, goal]
            loss = -(each * np.log(got / total + 1e-30)).sum()
            z[at, goal] = got - total
            scale = (each / total)[:, None]
        return loss, h * scale, scale

    def _by_id(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of the rows of each id; the last row is one of zeros and no id's.

        Rows are laid in blocks of 8 of one id, filled up with zeros, and added
        by their places in all blocks at once; only blocks are added one by one.
        """
        flat = ids.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        count = np.bincount(flat, minlength=self.size + 1)
        blocks = -(-count // 8)
        some = np.flatnonzero(count)
        first = np.cumsum(blocks) - blocks
        place = np.full(8 * blocks.sum(), len(flat))
        place[np.arange(len(flat)) + np.repeat(8 * first - (np.cumsum(count) - count), count)] = order
        t = rows.take(place[::8], 0)
        for i in range(1, 8):
            t += rows.take(place[i::8], 0)
        out = np.zeros((self.size + 1, rows.shape[1]), np.float32)
        if len(some):
            out[some] = np.add.reduceat(t, first[some], axis=0)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, rate: float = 0.01, batch: int = 256, seed: int = 0, weight: np.ndarray | None = None) -> float:
        """One pass of Adam over the windows, which count weight times; the mean loss before each step."""
        order = np.random.default_rng(seed).permutation(len(x))
        flat = self.vector().astype(np.float32)
        self.load(flat, copy=False)
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        losses = []
        for step, lo in enumerate(range(0, len(x), batch), 1):
            at = order[lo : lo + batch]
            loss, g = self.gradient(x[at].astype(np.int64), y[at].astype(np.int64), None if weight is None else weight[at])
            losses.append(loss)
            g = np.concatenate([g[n].ravel() for n in self.p])
            for a in range(0, len(flat), 16_384):  # what a processor keeps at hand
                part = slice(a, a + 16_384)
                t, u, v, d = flat[part], first[part], second[part], g[part]
                u *= np.float32(0.9)
                u += np.float32(0.1) * d
                v *= np.float32(0.99)
                d *= d
                d *= np.float32(0.01)
                v += d
                np.sqrt(v, out=d)
                d *= np.float32(1 / np.sqrt(1 - 0.99**step))
                d += np.float32(1e-8)
                np.divide(u, d, out=d)
                d *= np.float32(rate / (1 - 0.9**step))
                t -= d
        return float(np.mean(losses)) if losses else 0.0

    def vector(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.p.values()])

    def load(self, vector: np.ndarray, copy: bool = True) -> None:
        """Parameters from a vector, or as views of it."""
        at = 0
        for n, t in self.p.items():
            self.p[n] = vector[at : at + t.size].reshape(t.shape).astype(np.float32, copy=copy)
            at += t.size
