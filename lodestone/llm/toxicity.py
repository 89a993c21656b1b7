"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Words come in as a learnt vector (words seen often enough in training) beside the end states of a character-level
bidirectional GRU, so that spellings never seen still have a vector. A word-level bidirectional GRU reads windows
of WINDOW words, STRIDE apart, so that each overlaps the next; attention pools each window; the text's score is that of its worst window.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._base import ship, slices

WINDOW, STRIDE = 32, 24
CHARS, CHAR_DIM, CHAR_H = 96, 8, 6
WORD_DIM, H, ATT = 8, 8, 8
PIECE = 20
TOKENS = re.compile(r"\w+")
PAD = "\0"


def tokens(text: str) -> list[str]:
    """Lower-cased words; a word longer than PIECE gives overlapping pieces, so nothing of it is lost."""
    found = TOKENS.findall(text.lower())
    if found and max(map(len, found)) > PIECE:
        cut = []
        for w in found:
            cut += [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
        return cut
    return found


def starts(n: int) -> np.ndarray:
    """Starts of all windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    s = np.arange(0, n - WINDOW, STRIDE)
    return np.append(s, n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _char_ids(code: np.ndarray) -> np.ndarray:
    return np.where((code >= 97) & (code < 123), code - 57, np.where((code >= 32) & (code < 96), code - 31, 66 + code % 30)).astype(np.int64)


def gru(p: np.ndarray, u: np.ndarray, keep: bool = False, live: np.ndarray | None = None):
    """p (steps, rows, 3h): projected inputs, gates z, r, n. Returns the states (steps, rows, h), or with keep also what the backward pass needs.
    live (steps, rows, 1): rows keep their state where it is 0."""
    steps, rows, h3 = p.shape
    h = h3 // 3
    s = np.zeros((rows, h), dtype=np.float32)
    out = np.empty((steps, rows, h), dtype=np.float32)
    kept = []
    for t in range(steps):
        hu = s @ u
        zr = _sigmoid(p[t, :, : 2 * h] + hu[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(p[t, :, 2 * h :] + r * hu[:, 2 * h :])
        new = n + z * (s - n)
        if live is not None:
            new = s + live[t] * (new - s)
        if keep:
            kept.append((s, z, r, n, hu[:, 2 * h :]))
        out[t] = s = new
    return (out, kept) if keep else out


def gru_back(d_out: np.ndarray, kept: list, u: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of p and u from those of the states."""
    steps, rows, h = d_out.shape
    dp, du = np.empty((steps, rows, 3 * h), dtype=np.float32), np.zeros_like(u)
    ds = np.zeros((rows, h), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        s, z, r, n, hn = kept[t]
        g = ds + d_out[t]
        stay = 0.0
        if live is not None:
            stay = g * (1 - live[t])
            g = g * live[t]
        dn = g * (1 - z) * (1 - n * n)
        dz = g * (s - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dp[t] = np.concatenate([dz, dr, dn], axis=1)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        du += s.T @ dhu
        ds = dhu @ u.T + g * z + stay
    return dp, du


@dataclass
class Model:
    vocab: dict[str, int]  # word -> row of "e"; row 0 stands for all others
    w: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def fresh(vocab: dict[str, int], odds: np.ndarray, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        mat = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        d = WORD_DIM + 2 * CHAR_H
        e = (0.1 * rng.standard_normal((len(vocab) + 1, WORD_DIM))).astype(np.float32)
        e[0] = 0
        e[1:, 0] = odds
        w = {"e": e, "c": mat(CHARS, CHAR_DIM), "a": mat(2 * H, ATT), "ab": np.zeros(ATT, np.float32), "v": mat(ATT, 1), "o": mat(2 * H, 1), "ob": np.zeros(1, np.float32)}
        for k in "fb":
            w |= {f"cw{k}": mat(CHAR_DIM, 3 * CHAR_H), f"cu{k}": mat(CHAR_H, 3 * CHAR_H), f"cb{k}": np.zeros(3 * CHAR_H, np.float32)}
            w |= {f"w{k}": mat(d, 3 * H), f"u{k}": mat(H, 3 * H), f"b{k}": np.zeros(3 * H, np.float32)}
        return Model(vocab, w)

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character ids (steps, words) and which of them are live."""
        longest = max(map(len, words))
        code = np.frombuffer("".join(x.ljust(longest, PAD) for x in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, longest).T
        return _char_ids(code), (code > 0)[:, :, None].astype(np.float32)

    def word_vectors(self, words: list[str], keep: bool = False, hide: np.ndarray | None = None):
        w, rows = self.w, np.array([self.vocab.get(x, 0) for x in words], dtype=np.int64)
        if hide is not None:
            rows[hide] = 0
        ids, live = self.spell(words)
        x = w["c"][ids]
        f = gru(x @ w["cwf"] + w["cbf"], w["cuf"], keep, live)
        b = gru(x[::-1] @ w["cwb"] + w["cbb"], w["cub"], keep, live[::-1])
        last = lambda y: (y[0] if keep else y)[-1]
        v = np.concatenate([w["e"][rows], last(f), last(b)], axis=1)
        return (v, rows, ids, live, x, f, b) if keep else v

    def project(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates of the forward and of the backward network (words, 3h)."""
        f, b = np.empty((len(words), 3 * H), dtype=np.float32), np.empty((len(words), 3 * H), dtype=np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(order), 2048):
            part = order[i : i + 2048]
            v = self.word_vectors([words[j] for j in part])
            f[part], b[part] = v @ self.w["wf"] + self.w["bf"], v @ self.w["wb"] + self.w["bb"]
        return f, b

    def windows(self, pf: np.ndarray, pb: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows (rows, WINDOW) of rows of pf and pb, the projections; row 0 is padding."""
        out = np.empty(len(ids), dtype=np.float32)
        for i in range(0, len(ids), 1024):
            part = np.ascontiguousarray(ids[i : i + 1024].T)
            h = np.concatenate([gru(pf[part], self.w["uf"]), gru(pb[part[::-1]], self.w["ub"])[::-1]], axis=2)
            flat = h.reshape(-1, 2 * H)
            s = (np.tanh(flat @ self.w["a"] + self.w["ab"]) @ self.w["v"]).reshape(part.shape)
            s[part == 0] = -30
            s = np.exp(s - s.max(axis=0))
            each = (flat @ self.w["o"]).reshape(part.shape)
            out[i : i + 1024] = (s * each).sum(axis=0) / s.sum(axis=0) + self.w["ob"]
        return out

    def step(self, words: list[str], ids: np.ndarray, y: np.ndarray, hide: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss over windows ids (rows, WINDOW) into words, 0 being padding."""
        w, t = self.w, np.ascontiguousarray(ids.T)
        v, rows, chars, live, x, cf, cb = self.word_vectors(words, keep=True, hide=hide)
        xin = v[t]
        f, kf = gru(xin @ w["wf"] + w["bf"], w["uf"], True)
        b, kb = gru(xin[::-1] @ w["wb"] + w["bb"], w["ub"], True)
        h = np.concatenate([f, b[::-1]], axis=2)
        u = np.tanh(h @ w["a"] + w["ab"])
        s = np.where(t == 0, np.float32(-30), (u @ w["v"])[:, :, 0])
        s = np.exp(s - s.max(axis=0))
        att = s / s.sum(axis=0)
        pooled = np.einsum("tr,trh->rh", att, h)
        logit = (pooled @ w["o"])[:, 0] + w["ob"][0]
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d[:, None], "ob": d.sum(keepdims=True)}
        dc = d[:, None] * w["o"].T
        dh = att[:, :, None] * dc
        da = np.einsum("trh,rh->tr", h, dc)
        dscore = att * (da - (att * da).sum(axis=0))
        dscore[t == 0] = 0
        g["v"] = np.einsum("tra,tr->a", u, dscore)[:, None]
        du = dscore[:, :, None] * w["v"][:, 0] * (1 - u * u)
        g["a"] = np.einsum("trh,tra->ha", h, du)
        g["ab"] = du.sum(axis=(0, 1))
        dh = dh + du @ w["a"].T
        dpf, g["uf"] = gru_back(dh[:, :, :H], kf, w["uf"])
        dpb, g["ub"] = gru_back(dh[::-1, :, H:], kb, w["ub"])
        flat = lambda z: z.reshape(-1, z.shape[-1])
        g["wf"], g["bf"] = flat(xin).T @ flat(dpf), dpf.sum(axis=(0, 1))
        g["wb"], g["bb"] = flat(xin[::-1]).T @ flat(dpb), dpb.sum(axis=(0, 1))
        dx = dpf @ w["wf"].T + (dpb @ w["wb"].T)[::-1]
        dv = np.zeros_like(v)
        np.add.at(dv, t.ravel(), flat(dx))
        dv[0] = 0
        g["e"] = (rows, dv[:, :WORD_DIM])
        dc_chars = np.zeros_like(w["c"])
        for k, (out, kept), grad, order in (("f", cf, dv[:, WORD_DIM : WORD_DIM + CHAR_H], 1), ("b", cb, dv[:, WORD_DIM + CHAR_H :], -1)):
            ends = np.zeros_like(out)
            ends[-1] = grad
            dp, g[f"cu{k}"] = gru_back(ends, kept, w[f"cu{k}"], live[::order])
            g[f"cw{k}"], g[f"cb{k}"] = flat(x[::order]).T @ flat(dp), dp.sum(axis=(0, 1))
            np.add.at(dc_chars, chars[::order].ravel(), flat(dp @ w[f"cw{k}"].T))
        g["c"] = dc_chars
        return g, logit


def train(texts: list[str], labels: np.ndarray, max_vocab: int = 50_000, steps: int = 320, batch: int = 96, seed: int = 5, prior: float | None = None) -> Model:
    """Multiple-instance training: a text's label goes to its worst window, found again after each quarter of the steps.

    Where texts are few, steps are too. A tenth of the known words are read as unknown in each step, and a
    fifth of the clean windows repeat one of their words, as documents do that say one word over and over.
    One text in five calibrates the score and isn't trained on; the random choices follow from seed alone.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float32)
    docs = [tokens(t) for t in texts]
    hold = np.arange(len(docs)) % 5 == 4
    seen = [Counter(), Counter()]
    for d, y, out in zip(docs, labels, hold, strict=True):
        if not out:
            seen[int(y)].update(set(d))
    total = [max(1, int(((labels == k) & ~hold).sum())) for k in (0, 1)]
    both = seen[0] + seen[1]
    vocab = {x: i + 1 for i, (x, n) in enumerate(sorted(both.items(), key=lambda kv: (-kv[1], kv[0]))[:max_vocab]) if n > 1}
    rate = lambda k, x: (seen[k][x] + 0.5) / (total[k] + 1)
    odds = np.array([np.log(rate(1, x) / rate(0, x)) * (both[x] / (both[x] + 3)) for x in vocab], dtype=np.float32)
    model = Model.fresh(vocab, np.clip(odds, -4, 4) / 2, seed)
    known = {PAD: 0}
    ids, win, owner = [], [], []
    for i, d in enumerate(docs):
        row = [known.setdefault(x, len(known)) for x in d]
        for s in starts(len(row)):
            part = row[s : s + WINDOW]
            win.append(part + [0] * (WINDOW - len(part)))
            owner.append(i)
    words, win, owner = list(known), np.array(win, dtype=np.int64), np.array(owner)
    first = np.searchsorted(owner, np.arange(len(docs)))
    score = np.concatenate([[0], odds, [0]])[[vocab.get(x, 0) for x in words]][win].clip(0).max(axis=1) if len(odds) else np.zeros(len(win))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    done, learn = 0, np.flatnonzero(~hold)
    steps = min(steps, 40 + 2 * len(learn) // 3)
    while done < steps and len(learn):
        best = np.array([first[i] + np.argmax(score[first[i] : (first[i + 1] if i + 1 < len(docs) else len(win))]) for i in learn])
        other = rng.integers(first[learn], np.append(first[1:], len(win))[learn])
        pick, y = np.concatenate([best, other[labels[learn] == 0]]), np.concatenate([labels[learn], np.zeros(int((labels[learn] == 0).sum()), np.float32)])
        pos, neg = pick[y == 1], pick[y == 0]
        round_end = done + -(-steps // 4)
        while done < min(round_end, steps):
            take = np.concatenate([rng.choice(pos, batch // 3) if len(pos) else pos, rng.choice(neg, batch - batch // 3) if len(neg) else neg])
            ty = np.concatenate([np.ones(batch // 3 if len(pos) else 0), np.zeros(batch - batch // 3 if len(neg) else 0)]).astype(np.float32)
            ids = win[take]
            dull = np.flatnonzero((ty == 0) & (rng.random(len(take)) < 0.2))  # clean windows of one word over and over
            ids[dull] = ids[dull, rng.integers(0, WINDOW, len(dull))][:, None]
            used, at = np.unique(np.append(ids, 0), return_inverse=True)
            g, _ = model.step([words[k] for k in used], at[:-1].reshape(-1, WINDOW), ty, rng.random(len(used)) < 0.1)
            done += 1
            lr = 0.01 * min(1, done / 20) * (0.1 if done > 0.8 * steps else 1)
            for k, grad in g.items():
                m, s = moments[k]
                if k == "e":
                    rows, grad = grad
                    live = rows > 0
                    rows, grad = rows[live], grad[live] + 1e-5 * model.w["e"][rows[live]]
                    m[rows] = 0.9 * m[rows] + 0.1 * grad
                    s[rows] = 0.99 * s[rows] + 0.01 * grad * grad
                    model.w[k][rows] -= lr * m[rows] / (np.sqrt(s[rows]) + 1e-6)
                else:
                    m *= 0.9
                    m += 0.1 * grad
                    s *= 0.99
                    s += 0.01 * grad * grad
                    model.w[k] -= lr * m / (np.sqrt(s) + 1e-6)
        score = model.windows(*model.project(words), win)
    worst = np.maximum.reduceat(score, first) if len(docs) else np.zeros(0)
    use = hold if len(set(labels[hold].tolist())) > 1 else np.ones(len(docs), bool)
    model.scale = platt(worst[use], labels[use], prior)
    return model


def platt(x: np.ndarray, y: np.ndarray, prior: float | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve through scores x, with Platt's smoothed targets; prior is the share of label 1
    where the rows come from, if it isn't that of y."""
    if not len(x):
        return 1.0, 0.0
    up = y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    w = np.ones(len(y))
    if prior is not None and 0 < up < len(y) and 0 < prior < 1:
        w = np.where(y == 1, prior * len(y) / up, (1 - prior) * len(y) / (len(y) - up))
    x = x.astype(np.float64)
    ab = np.array([1.0, 0.0])
    loss = lambda q: (w * (np.logaddexp(0, q[0] * x + q[1]) - t * (q[0] * x + q[1]))).sum() + 5e-4 * (q * q).sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * x + ab[1], -30, 30)))
        g = np.array([(w * (p - t) * x).sum(), (w * (p - t)).sum()]) + 1e-3 * ab
        q = w * p * (1 - p)
        hess = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, g)
        while loss(ab - move) > loss(ab) and np.abs(move).max() > 1e-7:
            move = move / 2
        if np.abs(move).max() < 1e-7:
            break
        ab = ab - move
    return float(max(ab[0], 1e-3)), float(ab[1])


class Scorer:
    """Scores texts; keeps the projections of words it has met, up to a bound."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.ids = {PAD: 0}
        self.f, self.b = self.model.project([PAD])
        self.used = 1

    def _learn(self, new: list[str]) -> None:
        end = self.used + len(new)
        if end > len(self.f):
            self.f, self.b = (np.concatenate([x[: self.used], np.empty((max(self.used, len(new)), 3 * H), dtype=np.float32)]) for x in (self.f, self.b))
        self.f[self.used : end], self.b[self.used : end] = self.model.project(new)
        self.ids.update(zip(new, range(self.used, end), strict=True))
        self.used = end

    def logits(self, texts: list[str]) -> np.ndarray:
        docs = [tokens(t) for t in texts]
        new = [x for x in set().union(*docs) if x not in self.ids]
        if self.used + len(new) > self.most:
            self.reset()
            new = [x for x in set().union(*docs) if x != PAD]
        if new:
            self._learn(new)
        flat, at, first, count = [], [], [], 0
        get = self.ids.__getitem__
        offset = 0
        for d in docs:
            s = starts(len(d))
            first.append(count)
            count += len(s)
            at.append(s + offset)
            flat.append(np.fromiter(map(get, d), np.int32, len(d)))
            if len(d) < WINDOW:
                flat.append(np.zeros(WINDOW - len(d), np.int32))
            offset += max(len(d), WINDOW)
        flat, at = np.concatenate(flat), np.concatenate(at)
        out = np.empty(len(at), dtype=np.float32)
        for i in range(0, len(at), 16_384):
            out[i : i + 16_384] = self.model.windows(self.f, self.b, flat[at[i : i + 16_384, None] + np.arange(WINDOW)])
        return np.maximum.reduceat(out, first)

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.model.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts).astype(np.float64) + b, -30, 30)))


_SCORERS: dict[int, Scorer] = {}


def score_column(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a double column `score`, the scaled worst window; any score column of docs is replaced. Null text counts as empty."""
    ship(docs.sparkSession)
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tag = zlib.crc32(b"".join(model.w[k].tobytes() for k in sorted(model.w)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(tag)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[tag] = Scorer(shared.value)
        for big in batches:
            for batch in slices([big], text, 2 << 20):
                if batch.num_rows:
                    got = scorer.scores([x or "" for x in batch.column(text).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 600, steps: int = 320) -> Model:
    """Trains on labelled documents: a hash-ordered sample of at most max_per_class toxic and twice as many clean ones.

    That bound is the operator's only sample; scoring covers every text. Null labels and ids are left out. Without
    labels of both kinds the model stays near its start.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    sample = None
    for kind, most in ((1, max_per_class), (0, 2 * max_per_class)):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").toPandas()
    rows = rows.assign(k=[zlib.crc32(str(x).encode()) for x in rows["doc_id"]]).sort_values(["k", "doc_id"], kind="stable")
    return train(rows["text"].fillna("").tolist(), rows["toxic"].to_numpy(), steps=steps, prior=share)
