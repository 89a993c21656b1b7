"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are compared as sequences of words (lower case, ASCII white space cuts, outer punctuation off). A document
holds an item if one of its windows is within edit distance floor(ERROR * words) of it, in words. A q-gram count, which no window within that distance can miss (an edit destroys two of an item's
word pairs at most), decides which windows are embedded; the CGK walk then maps edit to Hamming distance, and as
many bit samples are drawn as the target recall asks for. Embedded windows have the item's size; windows of other sizes,
and what the samples miss, are found by the same count per item and an alignment with free ends, which misses nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import ship, slices, text_bytes

ERROR = 0.2
#: Bytes of benchmark text that go out with one pass; more is matched in further blocks of items.
BLOCK = 16 << 20
#: Bit samples taken from one walk.
PER_WALK = 6
OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STRIP = np.zeros(256, dtype=bool)
_STRIP[list(OUTER)] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_MULT, 1 << 16), _powers(_INVERSE, 1 << 16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and each text's first word (with the end after the last).

    A word's hash is a polynomial in its bytes, read off running sums over the whole array; words of punctuation
    alone are no words.
    """
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2].copy(), edge[1::2].copy()
    while True:
        off = (start < end) & _STRIP[raw[start]]
        if not off.any():
            break
        start += off
    while True:
        off = (start < end) & _STRIP[raw[end - 1]]
        if not off.any():
            break
        end -= off
    keep = start < end
    start, end = start[keep], end[keep]
    out = np.empty(len(start), dtype=np.uint64)
    step, i = len(_UP) // 2, 0
    while i < len(start):  # blocks of bytes, so that the table of powers stays small
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + step, "right")))
        top = int(end[j - 1])
        if top - base > step:  # one huge word
            h = 0
            for x in raw[base:top].tolist():
                h = (h * 0x100000001B3 + int(_LOWER[x])) & ((1 << 64) - 1)
            out[i] = h
        else:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw[base:top]] * _UP[: top - base])])
            a, b = start[i:j] - base, end[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * _DOWN[a]
        i = j
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
    return _mix(out), first


def places(a: list) -> dict:
    """For each symbol of a the bits of its places."""
    out: dict = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def edit_distance(at: dict, n: int, b: list) -> int:
    """Levenshtein distance of a sequence of n symbols, given by its places, and b; a column of the table at a time in
    the bits of one integer."""
    if not n:
        return len(b)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for x in b:
        m = at.get(x, 0)
        d = (((m & up) + up) ^ up) | m | down
        hp, hn = down | ~(d | up) & full, up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 | 1
        up, down = (hn << 1 | ~(d | hp)) & full, hp & d & full
    return score


def prefix_distances(at: dict, n: int, b: list, free: bool) -> list[int]:
    """Levenshtein distances of a sequence of n symbols, given by its places, and each prefix of b (from one symbol on);
    with free, the least over all ends of that prefix."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, out = full, 0, n, []
    for x in b:
        m = at.get(x, 0)
        d = (((m & up) + up) ^ up) | m | down
        hp, hn = down | ~(d | up) & full, up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 | (not free)
        up, down = (hn << 1 | ~(d | hp)) & full, hp & d & full
        out.append(score)
    return out


def nearest_window(word: list, b: list) -> tuple[int, int, int]:
    """(distance, start, size) of a window of b that is nearest to the words; of equal ones the size closest to theirs."""
    n = len(word)
    ends = prefix_distances(places(word), n, b, True)
    d = min(ends, default=n)
    if d >= n:
        return n, 0, 0
    end = ends.index(d) + 1
    back = prefix_distances(places(word[::-1]), n, b[end - 1 :: -1], False)
    size = min((abs(m + 1 - n), m + 1) for m, x in enumerate(back) if x == d)[1]
    return d, end - size, size


def cgk(x: np.ndarray, seed: int, length: int) -> np.ndarray:
    """CGK embeddings (rows, length) of equally long rows of symbols: a pointer walks over the row and moves on
    as a random bit of (step, symbol) says; past the end it reads 0."""
    rows, n = x.shape
    padded = np.concatenate([x, np.zeros((rows, 1), dtype=np.uint64)], axis=1)
    at, lane = np.zeros(rows, dtype=np.int64), np.arange(rows)
    out = np.empty((rows, length), dtype=np.uint64)
    for j in range(length):
        out[:, j] = sym = padded[lane, at]
        bit = _mix(sym + np.uint64((seed * 1_000_003 + j) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1))) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


def repeats(words: int, most: int, samples: int, recall: float) -> int:
    """Bit samples needed for the recall, if the Hamming distance is the walk's usual 2 per edit and resynchronisation takes a few steps."""
    near = max(0.25, 1 - 4.0 * most / (3 * max(1, words)))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - near**samples)))


class Items:
    """The items of one block, grouped by size."""

    def __init__(self, ids: list[int], texts: list[bytes], recall: float = 0.99, samples: int = 4, seed: int = 3) -> None:
        h, first = word_hashes(texts)
        self.seed, self.samples = seed, samples
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.places = [places(w.tolist()) for w in self.words]
        self.ids = ids
        groups = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w):
                groups[len(w)].append(i)
        self.pairs = np.unique(np.concatenate([self._pairs(w) for w in self.words] or [np.empty(0, np.uint64)]))
        bits = max(16, int(len(self.pairs) * 64).bit_length())
        self.shift = np.uint64(64 - bits)
        self.hit = np.zeros(1 << bits, dtype=bool)
        self.hit[self.pairs >> self.shift] = True
        self.groups = []
        rng = np.random.default_rng(seed)
        for n, members in sorted(groups.items()):
            most = int(ERROR * n)
            rounds = repeats(n, most, samples, recall)
            stack = np.stack([self.words[i] for i in members])
            walks = []
            for walk in range(-(-rounds // PER_WALK)):
                embedded, tables = cgk(stack, seed + walk, 3 * n), []
                for _ in range(min(PER_WALK, rounds - walk * PER_WALK)):
                    at = np.sort(rng.choice(3 * n, size=min(samples, 3 * n), replace=False))
                    keys = defaultdict(list)
                    for key, i in zip(self._key(embedded, at).tolist(), members, strict=True):
                        keys[key].append(i)
                    tables.append((at, keys, np.array(sorted(keys), dtype=np.uint64)))
                walks.append(tables)
            holders = defaultdict(list)  # items of the group by the pairs that they have
            for i in members:
                for k in np.searchsorted(self.pairs, np.unique(self._pairs(self.words[i]))).tolist():
                    holders[k].append(i)
            self.groups.append((n, most, walks, np.isin(self.pairs, np.concatenate([self._pairs(self.words[i]) for i in members])), holders))

    @staticmethod
    def _pairs(w: np.ndarray) -> np.ndarray:
        return _mix(w[:-1] * _MULT + w[1:]) if len(w) > 1 else np.empty(0, np.uint64)

    @staticmethod
    def _key(embedded: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = np.zeros(len(embedded), dtype=np.uint64)
        for j in at:
            key = _mix(key * _MULT + embedded[:, j])
        return key

    def _candidates(self, x: np.ndarray, walks: list) -> dict[int, set[int]]:
        """Items by row of x (windows of words) that share a bit sample with it."""
        found = defaultdict(set)
        for w, tables in enumerate(walks):
            embedded = cgk(x, self.seed + w, 3 * x.shape[1])
            for at, keys, known in tables:
                key = self._key(embedded, at)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
                for row, k in zip(hit.tolist(), key[hit].tolist(), strict=True):
                    found[row].update(keys[k])
        return found

    def match(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, first word, words, distance): the nearest window of each text for each item it holds."""
        if not len(h):
            return []
        pairs = self._pairs(h)
        hit = np.flatnonzero(self.hit[pairs >> self.shift])
        which = np.minimum(np.searchsorted(self.pairs, pairs[hit]), max(0, len(self.pairs) - 1))
        same = self.pairs[which] == pairs[hit] if len(self.pairs) else np.zeros(len(hit), bool)
        hit, which = hit[same], which[same]  # places of word pairs that some item has, and which pairs they are
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, most, walks, own, holders in self.groups:
            run = np.zeros(len(h), dtype=np.int32)
            run[hit[own[which]] + 1] = 1
            run = np.cumsum(run, dtype=np.int32)  # pairs of this group's items before each word
            if len(h) >= n:
                s = np.flatnonzero(run[n - 1 :] - run[: len(run) - n + 1] >= n - 1 - 2 * most)
                s = s[owner[s] == owner[s + n - 1]]
                self._probe(h, owner, first, s, n, most, walks, best)
            size = np.diff(first)  # a text that is a little shorter than the item is a window
            short = np.flatnonzero((size < n) & (size >= max(1, n - most)))
            short = short[run[first[short + 1] - 1] - run[first[short]] >= n - 1 - 2 * most]
            if len(short):
                x = np.zeros((len(short), n), dtype=np.uint64)
                for row, t in enumerate(short.tolist()):
                    x[row, : size[t]] = h[first[t] : first[t + 1]]
                for row, items in self._candidates(x, walks).items():
                    t = int(short[row])
                    self._verify(h, int(first[t]), int(size[t]), t, items, most, best, int(first[t]))
            if n > 1 and most:
                on = own[which] & (owner[hit] == owner[hit + 1])
                self._count(h, owner, first, hit[on], which[on], n, most, holders, best)
        return [(t, self.ids[i], a, b, d) for (t, i), (d, a, b) in sorted(best.items())]

    def _count(self, h, owner, first, at, which, n, most, holders, best) -> None:
        """All windows within reach of an item: they have need of its word pairs in n + most words. at: places of pairs of the group."""
        need, reach = n - 1 - 2 * most, n + most
        runs = np.flatnonzero((at[need - 1 :] - at[: len(at) - need + 1] <= reach - 2) & (owner[at[need - 1 :]] == owner[at[: len(at) - need + 1]])) if len(at) >= need else at[:0]
        cut = np.flatnonzero((runs[1:] - runs[:-1] >= need) | (owner[at[runs[1:]]] != owner[at[runs[:-1]]])) + 1
        for part in np.split(runs, cut) if len(runs) else []:
            lo, hi = int(part[0]), int(part[-1]) + need
            t = int(owner[at[lo]])
            seen = defaultdict(list)
            for p, k in zip(at[lo:hi].tolist(), which[lo:hi].tolist(), strict=True):
                for i in holders[k]:
                    seen[i].append(p)
            for i, ps in seen.items():
                spans: list[list[int]] = []
                for a, b in zip(ps, ps[need - 1 :]):  # noqa: B905
                    if b - a <= reach - 2:
                        x, y = max(int(first[t]), b + 2 - reach), min(int(first[t + 1]), a + reach)
                        if spans and x <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], y)
                        else:
                            spans.append([x, y])
                for x, y in spans:
                    known = best.get((t, i), (most + 1, 0, 0))[0]
                    if known:
                        d, start, size = nearest_window(self.words[i].tolist(), h[x:y].tolist())
                        if d < known:
                            best[t, i] = (d, x + start - int(first[t]), size)

    def _probe(self, h, owner, first, s, n, most, walks, best) -> None:
        for k in range(0, len(s), 8192):
            part = s[k : k + 8192]
            found = self._candidates(h[part[:, None] + np.arange(n)], walks)
            for row in sorted(found):
                p = int(part[row])
                self._verify(h, p, n, int(owner[p]), found[row], most, best, int(first[owner[p]]))

    def _verify(self, h, p, n, t, items, most, best, text_start) -> None:
        w = h[p : p + n].tolist()
        for i in items:
            known = best.get((t, i), (most + 1, 0, 0))[0]
            if known and (d := edit_distance(self.places[i], len(self.words[i]), w)) < known:
                best[t, i] = (d, p - text_start, n)


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance long"


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): one row for each item that a document holds.

    Items go out in blocks of BLOCK bytes, and each block meets all documents where they lie, without a shuffle.
    Null or empty texts hold nothing, null or empty items are held by nothing; repeated rows repeat their result.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // BLOCK)
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in got], [r["text"].encode("utf-8", "replace") for r in got], recall))
        part = rows.mapInArrow(_matcher(shared), SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _matcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for big in batches:
            for batch in slices([big], "text", 4 << 20):
                found = items.match(*word_hashes(text_bytes(batch, "text"))) if batch.num_rows else []
                if found:
                    t, i, a, n, d = (list(x) for x in zip(*found, strict=True))
                    columns = [batch.column("doc_id").take(pa.array(t)), *[pa.array(x, pa.int64()) for x in (i, a, n, d)]]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "first_word", "n_words", "distance"])

    return run
