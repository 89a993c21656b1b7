"""Token counts by a compiled finite-state transducer for piece vocabularies merged by score (sentencepiece BPE).

The transducer reads characters; each transition carries by how much the number of tokens changes. Its states come
from the fact that such a tokenisation is valid exactly if each pair of neighbours is what the pair's own text gives:
the last token of every prefix is then unique, and what matters of the past is, for each start from which a longer
piece could still be completed, the pending characters, the last token before them and the tokens counted since.
States and transitions are determinised when first met and kept.

Texts are cut into chunks; a chunk is a map from the state before it to the state after it and a count. A space
or line end resets the transducer, so the map of a chunk with a reset needs only its head (up to the first reset),
an inner count and its tail; maps compose associatively and a prefix scan joins them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._base import ship, slices

SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+|\n| +")
LITERAL = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
CHUNK = 1 << 15


class Transducer:
    """count(unit): tokens of a string in which spaces are written as SPACE."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True) -> None:
        self.score = pieces
        self.byte_fallback = byte_fallback
        self.open: set[str] = {""}  # strings that a longer piece starts with
        for p in pieces:
            self.open.update(p[:i] for i in range(1, len(p)))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.start = self._state((("", None, 0),))

    def _state(self, key: tuple) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return got

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                s = self.score.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def weight(self, token: str) -> int:
        return 1 if token in self.score or not self.byte_fallback else len(token.encode("utf-8", "replace"))

    def _step(self, state: int, c: str) -> tuple[int, int]:
        active = self.states[state]
        last = delta = None
        for pending, before, since in active:
            s = pending + c
            if (s in self.score or not pending) and (before is None or self.fits(before, s)):
                last, delta = s, since + self.weight(s)
                break
        kept = [(p + c, before, since - delta) for p, before, since in active if p + c in self.open]
        got = self.next[state][c] = self._state((*kept, ("", last, 0))), delta
        return got

    def count(self, unit: str) -> int:
        state, total, table = self.start, 0, self.next
        for c in unit:
            got = table[state].get(c)
            if got is None:
                got = self._step(state, c)
            state, total = got[0], total + got[1]
        return total


class Counts(dict):
    """Tokens by unit, found by the transducer when first asked for."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, unit: str) -> int:
        n = self.transducer.count(unit.replace(" ", SPACE))
        if len(unit) < 40:
            self[unit] = n
        return n


class Counter:
    def __init__(self, transducer: Transducer, most_units: int = 1_000_000, most_states: int = 400_000) -> None:
        self.pieces, self.fallback = transducer.score, transducer.byte_fallback
        self.most_units, self.most_states = most_units, most_states
        self.units = Counts(transducer)

    def trim(self) -> None:
        """Bounds what is kept."""
        if len(self.units.transducer.states) > self.most_states:
            self.units = Counts(Transducer(self.pieces, self.fallback))
        elif len(self.units) > self.most_units:
            self.units.clear()

    def _sum(self, units: list[str]) -> int:
        return sum(map(self.units.__getitem__, units))

    def chunk(self, text: str) -> tuple[str, int, str] | str:
        """The state map of a chunk: (head, inner count, tail), or the chunk itself if nothing in it resets.

        A space after another character resets, and so does a line end, on both sides.
        """
        units = UNIT.findall(text)
        if len(units) == 1 and units[0] != "\n":
            return text
        head = units.pop(0) if units[0] != "\n" else ""
        tail = units.pop() if units[-1] != "\n" else ""
        return head, self._sum(units), tail

    def join(self, a: tuple[str, int, str] | str, b: tuple[str, int, str] | str) -> tuple[str, int, str] | str:
        if isinstance(a, str) and isinstance(b, str):
            return self.chunk(a + b)
        if isinstance(a, str):
            head, *rest = UNIT.findall(a + b[0])
            return head, self._sum(rest) + b[1], b[2]
        if isinstance(b, str):
            *rest, tail = UNIT.findall(a[2] + b)
            return a[0], a[1] + self._sum(rest), tail
        return a[0], a[1] + b[1] + self._sum(UNIT.findall(a[2] + b[0])), b[2]

    def scan(self, maps: list) -> list:
        """Inclusive prefix compositions, in log steps."""
        step = 1
        while step < len(maps):
            maps = [maps[i] if i < step else self.join(maps[i - step], maps[i]) for i in range(len(maps))]
            step *= 2
        return maps

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text  # the model's dummy prefix
        if SPACE in text:  # the mark itself in a text: rare, and it merges with spaces
            return sum(map(self.units.transducer.count, LITERAL.findall(text.replace(" ", SPACE))))
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        whole = maps[0]
        if len(maps) > 1:
            total = maps[0]
            # a fold over blocks of a bounded scan keeps the composed heads and tails short
            for k in range(1, len(maps), 64):
                total = self.join(total, self.scan(maps[k : k + 64])[-1])
            whole = total
        if isinstance(whole, str):
            return self._sum(UNIT.findall(whole))
        return whole[1] + self._sum([x for x in (whole[0], whole[2]) if x])


def load(path: str) -> Transducer:
    """Compiles a sentencepiece BPE model file. Only what such models use here is supported; others raise."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    pieces = {p.piece: p.score for p in m.pieces if p.type == 1}
    crossing = any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in pieces)
    if t.model_type != 2 or n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces or crossing or any(p.type in (4, 5) for p in m.pieces):
        raise ValueError(f"{path}: not a BPE model of the supported kind")
    return Transducer(pieces, t.byte_fallback)


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs plus n_bytes and n_tokens (columns of these names are replaced); null text is empty and has no tokens.

    No row moves. A worker keeps its transducer and the counts of units across batches, both bounded.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(model_path)
        if counter is None:
            counter = _COUNTERS[model_path] = Counter(load(model_path))
        for big in batches:
            for batch in slices([big], text):
                got = []
                for x in batch.column(text).to_pylist():
                    got.append(counter(x) if x else 0)
                    counter.trim()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], [*names, "n_tokens"])

    from pyspark.sql import types as T

    counted = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))
    return counted.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
