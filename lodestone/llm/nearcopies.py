"""What the search for near copies by five-word shingles compares: fingerprints, min-hash bands, and exact similarity of all texts of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import connected_components, salted_join, slices, stash, text_bytes
from lodestone.llm.substring import _mix, _words

WIDTH, LIKE = 5, 0.8
BANDS, ROWS = 16, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of the shingles of all texts, where each text's begin (with the end after the last), and a key of each
    text's words; a text of fewer words than WIDTH is one shingle, one without words has none."""
    begin = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))])
    start, _, h = _words(np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8))
    first = np.searchsorted(start, begin)
    n = np.diff(first)
    gram = np.zeros(len(h), dtype=np.uint64)
    for j in range(WIDTH):  # short at the end of the array, where no whole shingle begins
        gram[: max(0, len(h) - j)] = gram[: max(0, len(h) - j)] * _BASE + h[j:]
    whole = np.zeros(len(h), dtype=bool)
    rest = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the text's end
    whole[rest >= WIDTH] = True
    for t in np.flatnonzero((n > 0) & (n < WIDTH)).tolist():
        value = int(n[t])
        for x in h[first[t] : first[t + 1]].tolist():
            value = (value * int(_BASE) + x) & ((1 << 64) - 1)
        gram[first[t]], whole[first[t]] = value, True
    count = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(np.int64))
    keys = [xxhash.xxh64_intdigest(h[a:b].tobytes(), 42) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return _mix(gram[whole]), np.concatenate([[0], np.cumsum(count)]), keys


def bands(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of the bands; those of texts without shingles say nothing."""
    out = np.zeros((len(at) - 1, BANDS), dtype=np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(BANDS):
            key = np.full(len(some), k + 1, dtype=np.uint64)
            for r in range(k * ROWS, k * ROWS + ROWS):
                key = _mix(key * _BASE + np.minimum.reduceat(gram * _TIMES[r] + _PLUS[r], at[some]))
            out[some, k] = key
    return out


def simhashes(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per text: a bit is 1 if it is set in over half of the shingles; 0 without shingles."""
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    n = np.diff(at)
    some = np.flatnonzero(n)
    if len(some):
        for bit in range(64):
            count = np.add.reduceat((gram >> np.uint64(bit) & np.uint64(1)).astype(np.int32), at[some])
            out[some] |= (2 * count > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


SKETCH = "tid long, key long, fp long, bands array<long>"


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (tid, text): the hash of the text's words, its fingerprint and its bands (none without words)."""
    names = [c.split()[0] for c in SKETCH.split(", ")]
    for big in batches:
        for batch in slices([big], "text", 1 << 20):
            if batch.num_rows:
                gram, at, keys = shingles(text_bytes(batch, "text"))
                found, some = bands(gram, at).view(np.int64), np.diff(at) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[some].ravel()))
                key = pa.array(np.array(keys, dtype=np.uint64).view(np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("tid"), key, pa.array(simhashes(gram, at).view(np.int64)), lists], names)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (tid, text): the number of distinct shingles of each text, and their hashes."""
    for big in batches:
        for batch in slices([big], "text", 1 << 20):
            if batch.num_rows:
                gram, at, _ = shingles(text_bytes(batch, "text"))
                own = [np.unique(gram[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["tid", "size", "grams"])


#: Members and shingles of a block; a group that holds more is cut into blocks, of which all pairs are compared.
GROUP, HELD = 1024, 1 << 21
#: A group of more blocks than this goes by the bands and links of its members instead.
BLOCKS = 8
#: Shingles that more texts of two blocks hold are counted by a product of matrices, others pair by pair.
OFTEN = 64


def alike(sets: list[np.ndarray], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of sets of distinct hashes whose Jaccard similarity is LIKE or more; with `first`, those of one of the
    first sets and one of the others."""
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(col, kind="stable")  # owners ascend within a column
    order = order[often[col[order]] > 1]
    col, owner, often = col[order], owner[order], often[col[order]]
    both = np.zeros(n * n, dtype=np.float64 if size.max(initial=0) >= 1 << 24 else np.float32)
    c, o = col[often <= OFTEN], owner[often <= OFTEN]
    codes, held = [], 0
    for lag in range(1, OFTEN):
        k = np.flatnonzero(c[lag:] == c[: len(c) - lag])
        if not len(k):
            break
        codes.append(o[k] * n + o[k + lag])
        held += len(k)
        if held > 1 << 22:
            both += np.bincount(np.concatenate(codes), minlength=n * n)
            codes, held = [], 0
    if codes:
        both += np.bincount(np.concatenate(codes), minlength=n * n)
    both = both.reshape(n, n)
    c, o = col[often > OFTEN], owner[often > OFTEN]
    c = np.unique(c, return_inverse=True)[1]
    width = max(256, (1 << 22) // n)
    for lo in range(0, int(c.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(c, [lo, lo + width])
        has = np.zeros((n, width), dtype=both.dtype)
        has[o[a:b], c[a:b] - lo] = 1
        both[: first or n, first:] += has[: first or n] @ has[first:].T
    i, j = np.nonzero(np.triu(both, 1))
    if first:
        i, j = i[(i < first) & (j >= first)], j[(i < first) & (j >= first)]
    near = both[i, j].astype(np.int64) * (1 + LIKE) >= LIKE * (size[i] + size[j]) - 1e-6
    return i[near], j[near]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row reachable) for the rows that links reach and that aren't least themselves."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (unit, side, tid, grams), sorted by unit and side: a forest over the texts that all alike pairs of a unit link; of a
    unit with two sides these are pairs of one text of each."""
    for table in _whole_groups(batches, "unit"):
        unit, side, tid = (table.column(c).to_numpy() for c in ("unit", "side", "tid"))
        grams = table.column("grams").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            first = hi - lo - int(side[lo:hi].sum())
            if hi - lo > 1 and first:
                i, j = forest(*alike([np.frombuffer(x, dtype=np.uint64) for x in grams[lo:hi]], first % (hi - lo)), hi - lo)
                a.append(tid[lo + i])
                b.append(tid[lo + j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The same rows, sorted by key, cut so that no key's rows are apart."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        last = rest[0].column(key)[0].as_py() if rest else None
        cut = int(np.searchsorted(values, values[-1]))  # the last key may go on
        if cut or rest and last != values[-1]:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def texts_of(rows: DataFrame, asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(tid, text) of the texts asked for, each once; rows has (doc_id, tid, text), counted their tid."""
    return salted_join(rows, asked, "tid", counted).groupBy("tid").agg(F.first("text").alias("text"))


def linked(members: DataFrame, rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(a, b): links of texts, by tid, that connect all alike pairs within a group; members has (group, tid) once each, rows
    (doc_id, tid, text), counted their tid.

    Groups that share texts are compared as one, whose texts move once; where that is over BLOCKS blocks, each for itself.
    No pair of a group is left out: a group beyond one block is compared block against block. Rows that move are members
    times blocks, and what a unit returns is a forest over its texts.
    """
    leads = members.groupBy("group").agg(F.min("tid").alias("lead"), F.max("tid").alias("last")).where("lead < last").select("group", "lead")
    held = stash(salted_join(members, leads, "group"), "held")
    whole = stash(connected_components(held.select(F.col("lead").alias("a"), F.col("tid").alias("b"))), "joint")
    grams = stash(texts_of(rows, whole.select(F.col("node").alias("tid")), counted).mapInArrow(_grams, "tid long, size long, grams binary"), "grams")
    sizes = grams.select("tid", "size")

    def blocks(groups: DataFrame) -> DataFrame:
        need = groups.join(sizes, "tid").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        return stash(need.select("group", F.ceil(F.greatest(F.col("n") / GROUP, F.col("size") / HELD, F.lit(1))).cast("int").alias("blocks")), "blocks")

    joint = whole.select(F.col("root").alias("group"), F.col("node").alias("tid"))
    cut = blocks(joint)
    parts = salted_join(joint, cut.where(F.col("blocks") <= BLOCKS), "group").select("group", "tid", "blocks")
    large = cut.where(F.col("blocks") > BLOCKS).select("group")
    if not large.isEmpty():
        within = stash(held.select("group", "tid").join(joint.join(large, "group", "left_semi").select("tid"), "tid", "left_semi"), "large")
        parts = parts.union(salted_join(within, blocks(within), "group").select("group", "tid", "blocks"))
    own = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    met = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "tid")
    got = met.join(grams.select("tid", "grams"), "tid").repartition("unit").sortWithinPartitions("unit", "side").select("unit", "side", "tid", "grams").mapInArrow(_compared, "a long, b long")
    return stash(got, "alike")
