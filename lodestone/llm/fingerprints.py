"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk where its lowest k bits are all ones; a chunk becomes one
base-64 character. The fingerprint is block size 2^k, the signature at it and the signature at twice that, with k the
smallest that gives at most 64 chunks. Chunks depend on nearby bytes alone, so an edit changes a stretch of the
signature and leaves the rest. Signatures compare by edit distance at a block size that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._base import ship, stash

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
REACH = 7
MOST = 64
GRAM = 5
_BLOCK = 1 << 20
_BASE = np.array(0x01000193, dtype=np.uint32)


def _triggers(data: bytes, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ends of chunks at block size 2^low, the trailing ones of the hash there, and the running sum of mixed hashes there and at the end."""
    ends, levels, sums, total = [], [], [], 0
    raw = np.frombuffer(data, dtype=np.uint8)
    want = np.uint32((1 << low) - 1)
    for at in range(0, len(raw), _BLOCK):
        lead = min(at, REACH - 1)
        x = raw[at - lead : at + _BLOCK].astype(np.uint32) + np.uint32(1)
        two = x.copy()
        two[1:] += x[:-1] * _BASE
        r = two.copy()  # windows of two bytes, of four, then of seven
        r[2:] += two[:-2] * _BASE**2
        r[4:] += two[:-4] * _BASE**4
        r[6:] += x[:-6] * _BASE**6
        r = r[lead:]
        r ^= r >> np.uint32(15)
        r *= np.uint32(0x2C1B3C6D)
        r ^= r >> np.uint32(12)
        run = np.cumsum(r, dtype=np.uint32) + np.uint32(total)
        hit = np.flatnonzero((r & want) == want)
        ends.append(hit + at + 1)
        flipped = ~r[hit]
        levels.append(np.where(flipped == 0, 32, np.bitwise_count((flipped & (~flipped + np.uint32(1))) - np.uint32(1))))
        sums.append(run[hit])
        total = int(run[-1])
    join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return join(ends, np.int64), join(levels, np.int64), join(sums, np.uint32), total


def _signature(found: tuple, size: int, k: int) -> str:
    """One character per chunk at block size 2^k; of a run of over three equal ones three stay, as they say little."""
    ends, levels, sums, total = found
    on = levels >= k
    marks = np.concatenate([np.zeros(1, np.uint32), sums[on]])
    if size and (not on.any() or ends[on][-1] < size):
        marks = np.append(marks, np.uint32(total))
    h = np.diff(marks)
    h = ((h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D) >> np.uint32(26)).astype(np.int64)
    same = h[1:] == h[:-1]
    if len(h) > 3:
        h = h[np.concatenate([[True] * 3, ~(same[2:] & same[1:-1] & same[:-2])])]
    return ALPHABET[h].tobytes().decode()


def fingerprint(text: str) -> str:
    """"size:signature:signature at twice the size"; an empty text gives "2::"."""
    data = text.encode("utf-8", "surrogatepass")
    low = max(1, int(np.log2(max(1, len(data)) / MOST)) - 1)
    found = _triggers(data, low)
    while low > 1 and len(_signature(found, len(data), low)) < MOST:
        low = max(1, low - 2)
        found = _triggers(data, low)
    while len(own := _signature(found, len(data), low)) > MOST:
        low += 1
    return f"{1 << low}:{own}:{_signature(found, len(data), low + 1)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        m = masks.get(c, 0)
        d = ((((m & up) + up) ^ up) | m | down) & full
        hp = (down | ~(d | up)) & full
        hn = up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = ((hp << 1) | 1) & full, (hn << 1) & full
        up, down = (hn | ~(d | hp)) & full, hp & d
    return score


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    gram = min(GRAM, len(a), len(b))
    if not gram or not {a[i : i + gram] for i in range(len(a) - gram + 1)} & {b[i : i + gram] for i in range(len(b) - gram + 1)}:
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; fingerprints whose block sizes are further apart than twice, or that share no run of characters, get 0."""
    if x == y:
        return 1.0
    (size_x, *signs_x), (size_y, *signs_y) = x.split(":"), y.split(":")
    at = lambda size, signs: {int(size) << i: s for i, s in enumerate(signs) if s}
    ours, theirs = at(size_x, signs_x), at(size_y, signs_y)
    return max([_alike(ours[k], theirs[k]) for k in ours.keys() & theirs.keys()], default=0.0)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
_ENDS = ["part", "first_text", "last_text"]


def _pair(doc_id: int | None, own: str, own_print: str, after: str, after_print: str) -> tuple:
    """The result of a document and the one after it."""
    k = len(own) // 4
    edited = own[: len(own) - k] + after[:k]
    new = fingerprint(edited) if k else own_print
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(own), digest, own_print, new, likeness(own_print, new), likeness(own_print, after_print)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part come in order; each but the last is paired with the one that follows. The last one comes out
    unpaired, with the part's number, its first text and its last."""
    first = held = None  # held: id, text, fingerprint of the row that waits for its successor
    rows, part = [], None
    for batch in batches:
        for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
            text = text or ""
            now = fingerprint(text)
            if held is None:
                first = text
            else:
                rows.append((*_pair(*held, text, now), None, None, None))
            held = (doc_id, text, now)
            if len(rows) >= 1024:
                yield _batch(rows)
                rows = []
    if held is not None:
        rows.append((held[0], None, None, held[2], None, None, None, part, first, held[1]))
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*_KINDS, pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES + _ENDS)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last document of each part with the first of the next part."""
    for batch in batches:
        if batch.num_rows:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "last_text", "fingerprint", "next_text"))
            rows = [_pair(i, own, own_print, after, fingerprint(after)) for i, own, own_print, after in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], NAMES)


def edited_fingerprints(docs: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """One row per document with its fingerprint, that of the text whose last quarter gives way to the start of the
    next document, and how alike they and the next document's are.

    The next document is that of the next doc_id (ties by the text's hash; null ids last); the first follows the last,
    and a sole document follows itself. Null texts are empty, an empty table gives no rows, repeated rows stay.
    Texts move once, to ranges of about part_bytes, whose number follows the bytes of the input; rows of one id, without
    an id or equal in all columns spread over ranges too. The ends of the ranges, one row each, are paired afterwards.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("at")]
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(max(8, -(-size // part_bytes)), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")
    done = stash(dealt.mapInArrow(_chains, SCHEMA + ", part long, first_text string, last_text string"), "chains")
    ends = done.where("part is not null")
    parts = ends.select("part")
    # one number per range: the least row follows the last one
    after = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    first = ends.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    seams = ends.drop("first_text").join(after, "part").join(first, "next").select("doc_id", "last_text", "fingerprint", "next_text")
    return done.where("part is null").select(*NAMES).union(seams.mapInArrow(_seams, SCHEMA))
