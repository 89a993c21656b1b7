"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64 bits over XXH64 (seed 42) of three-word shingles. The index keeps, for each third of the
bits, the masked pattern that its fingerprints share (two fingerprints that differ in at most two bits agree on
one third at least); below such an upper node, fingerprints lie in Gray order, and runs of them form nodes that
hold the bits all their members share. A search descends pairs of nodes and drops a pair, with all below it,
once the shared bits alone differ too often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import nearcopies
from lodestone.llm._base import connected_components, salted_join, ship, slices, stash, text_bytes

SEED = 42
FAN = 8
#: Rows of one upper node beyond which its free bits are cut in thirds once more.
HOT_NODE = 50_000
FLUSH = 200_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; a text without words has fingerprint 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ends = starts + lengths - 1
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices([big], "text"):
            fp = np.array([fingerprint(t) for t in text_bytes(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; null text counts as empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def index_links(group: np.ndarray, fp: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i < j) of equal group whose fp differ in at most `most` bits.

    Rows come sorted by group, and within it by Gray rank. Node k of a level covers FAN nodes of the level
    below: the bits shared by all of them (mask, pattern) and the groups they span.
    """
    none = np.empty(0, dtype=np.int64)
    if len(fp) < 2:
        return none, none
    full = np.full(len(fp), np.iinfo(np.uint64).max, dtype=np.uint64)
    levels = [(fp, full, group, group)]
    every, some = fp, fp
    while len(levels[-1][0]) > 4 * FAN:
        _, _, low, high = levels[-1]
        cut = np.arange(0, len(low), FAN)
        every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
        levels.append((every, ~(some ^ every), low[cut], high[np.minimum(cut + FAN, len(high)) - 1]))
    n = len(levels[-1][0])
    a, b = np.triu_indices(n)
    stack = [(len(levels) - 1, a.astype(np.int64), b.astype(np.int64))]
    found_a, found_b = [none], [none]
    steps = np.arange(FAN)
    while stack:
        depth, a, b = stack.pop()
        pattern, mask, low, high = levels[depth]
        ok = (low[a] <= high[b]) & (low[b] <= high[a])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
        a, b = a[ok], b[ok]
        if not depth:
            ok = a < b
            found_a.append(a[ok])
            found_b.append(b[ok])
            continue
        below = len(levels[depth - 1][0])
        for i in range(0, len(a), 16_384):
            ca = (a[i : i + 16_384, None, None] * FAN + steps[None, :, None] + 0 * steps[None, None, :]).ravel()
            cb = (b[i : i + 16_384, None, None] * FAN + 0 * steps[None, :, None] + steps[None, None, :]).ravel()
            ok = (ca <= cb) & (cb < below)
            stack.append((depth - 1, ca[ok], cb[ok]))
    return np.concatenate(found_a), np.concatenate(found_b)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node; links go out as a forest per flush, never as all pairs."""
    names = ["a", "b"]

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.empty(0, np.int64)
        order = np.lexsort((gray_rank(fps), group))
        group, fps = group[order], fps[order]
        i, j = nearcopies.forest(*index_links(group, fps), len(fps))
        return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], names)

    keys, fps, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "bits", "sub", "sub_bits")], axis=1))
        fps.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        held += batch.num_rows
        if held >= FLUSH:
            k, f = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.flatnonzero((k != k[-1]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield links(k[:cut], f[:cut])
                keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
            else:
                keys, fps = [k], [f]
    if keys:
        yield links(np.concatenate(keys), np.concatenate(fps))


def _thirds(bits: list[int]) -> list[int]:
    cut = [0, (len(bits) + 2) // 3, (2 * len(bits) + 2) // 3, len(bits)]
    return [sum(1 << x for x in bits[cut[i] : cut[i + 1]]) for i in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): a forest over the distinct values of fp in which two values at 2 bits or fewer are always connected.

    Each value goes to three upper nodes, one per third of its bits. A node with over HOT_NODE values gives way to
    three nodes that also share a third of the bits left, so no task gets an unbounded node.
    """
    thirds = _thirds(list(range(64)))
    node = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(thirds)]))
    rows = fps.select("fp").distinct().select("fp", node.alias("n")).select("fp", "n.block", "n.bits")
    hot = rows.groupBy("block", "bits").count().where(F.col("count") > HOT_NODE).select("block", "bits", F.lit(True).alias("hot"))
    subs = []
    for i, m in enumerate(thirds):
        inner = _thirds([x for x in range(64) if not m >> x & 1])
        subs.append(F.array(*[F.struct(F.lit(3 * i + j + 1).alias("sub"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("sub_bits")) for j, s in enumerate(inner)]))
    one = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("sub_bits")))
    sub = F.when(F.col("hot"), F.element_at(F.array(*subs), F.col("block") + 1)).otherwise(one)
    rows = rows.join(hot, ["block", "bits"], "left").select("fp", "block", "bits", F.explode(sub).alias("s")).select("fp", F.col("block").cast("long").alias("block"), "bits", F.col("s.sub").cast("long").alias("sub"), "s.sub_bits")
    keys = ["block", "bits", "sub", "sub_bits"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs.

    component_id is the smallest doc_id whose fingerprint can be reached by links of at most 2 bits; equal
    fingerprints always link, and so do all texts without words. Null ids never become a component_id unless
    the component has no other; an empty table gives no rows. Copies are folded into their fingerprint before
    the search, so a group of copies costs one value however large it is.
    """
    fps = stash(fingerprints(docs), "fingerprints")
    per = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = connected_components(near_links(fps))
    rooted = per.join(comps, per["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """(tid, root): of each text of docs, keyed by xxhash64 of it (null as empty), the class of its near copies.

    Texts of equal words (A-Z as a-z) link, as do texts whose sets of five-word shingles have a Jaccard similarity of
    0.8 or more. Candidates are texts whose fingerprints the Gray-order index links, at 2 bits or fewer; as bits of
    texts at that similarity differ with probability 0.15 (some 10 of 64), texts that share one of 16 bands of 4
    min-hashes are candidates too, which a pair at 0.8 fails with probability 0.0002. All texts of a band are compared
    with each other by their shingles, however many they are (`nearcopies.linked`).
    All texts without words are one class; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "doc_id").select("doc_id", F.xxhash64("text").alias("tid"), "text")
    keyed = stash(rows.drop("doc_id").mapInArrow(nearcopies.sketches, nearcopies.SKETCH), "sketches")
    per = stash(keyed.groupBy("key").agg(F.min("tid").alias("tid"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "texts")
    by_band = per.select(F.explode("bands").alias("group"), "tid")
    by_print = per.select(F.xxhash64(F.lit("fp"), "fp").alias("group"), "tid")
    of_print = per.groupBy("fp").agg(F.min("tid").alias("tid"))
    near = near_links(per).join(of_print.select(F.col("fp").alias("a"), F.col("tid").alias("x")), "a").join(of_print.select(F.col("fp").alias("b"), F.col("tid").alias("y")), "b")
    by_index = near.select(F.xxhash64(F.lit("index"), "a", "b").alias("group"), F.explode(F.array("x", "y")).alias("tid"))
    members = stash(by_band.union(by_print).union(by_index).distinct(), "members")
    comps = connected_components(nearcopies.linked(members, rows, keyed))
    rooted = per.select("key", "tid").join(comps, per["tid"] == comps["node"], "left").select("key", F.coalesce("root", "tid").alias("root"))
    return keyed.select("tid", "key").distinct().join(rooted, "key").select("tid", "root")
