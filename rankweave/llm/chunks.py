"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts every text into chunks, so passages that documents share
fall into the same chunks wherever they stand. A chunk is encoded once and kept: the ids of its
whole words, and the open ends before its first and behind its last white space, whose ids depend on
what stands beside them. When a text is put together, each join is repaired by encoding again from
the white space before it to the white space after it, over as many chunks as that takes; at white
space the ids of both sides agree with those of the whole text, so the result is exact.

The store of chunks belongs to a worker and has a bounded size; when it is full the older half goes. One
store for all workers would have to move the ids of every shared chunk to every document that has
it, which is more than encoding them where the text lies. So nothing is shuffled.

Defined cases: a null or empty text, or one of white space only, has no ids and decodes to an empty
text. Repeated rows get the same result. Strings of special tokens inside a text become those
tokens, as in the library. A very long text has many chunks, which are learnt in turn; a task holds
the text, its ids and its decoded form.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import per_text, text_bytes

REACH = 32          # bytes the rolling hash looks back
CUT_MASK = 0xFF     # one place in 256 is a cut
LEAST = 64          # bytes of a chunk, but for the last of a text
CHUNKS_KEPT = 50_000


def _byte_values() -> np.ndarray:
    """256 fixed pseudo-random values by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


with np.errstate(over="ignore"):
    _VALUES = _byte_values()


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """At each place, the sum of the values of the last 32 bytes, each shifted by its distance."""
    h = _VALUES[raw]
    step = 1
    while step < REACH:
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
        step *= 2
    return h


def cut(raw: np.ndarray, places: np.ndarray) -> list[list[bytes]]:
    """The chunks of each text. Only bytes of the text itself decide where it is cut."""
    whole = raw.tobytes()
    marks = np.flatnonzero((rolling_hash(raw) >> np.uint32(20)) & np.uint32(CUT_MASK) == 0) + 1
    first = np.searchsorted(marks, places[:-1] + max(REACH, LEAST)).tolist()
    last = np.searchsorted(marks, places[1:]).tolist()
    marks = marks.tolist()
    result = []
    for a, b, i, j in zip(places[:-1].tolist(), places[1:].tolist(), first, last):
        chunks = []
        for mark in marks[i:j]:
            if mark - a >= LEAST:
                chunks.append(whole[a:mark])
                a = mark
        if a < b:
            chunks.append(whole[a:b])
        result.append(chunks)
    return result


class ChunkStore:
    """Encoded chunks of one worker."""

    def __init__(self, path: str, kept: int = CHUNKS_KEPT):
        self.pieces = bpe.pieces(path, spelled=True)
        self.kept = kept
        # chunk -> (head, ids of its inner words, these decoded, tail), or None without white space
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes, bytes] | None] = {}

    def learn(self, chunks: set[bytes]) -> None:
        new = [c for c in chunks if c not in self.chunks]
        if len(self.chunks) + len(new) > self.kept:
            # The older half goes, or as much as the chunks asked for need.
            stay = min(len(self.chunks) // 2, max(0, self.kept - len(chunks)))
            self.chunks = dict(islice(self.chunks.items(), len(self.chunks) - stay, None))
            new = [c for c in chunks if c not in self.chunks]
        opened = []
        for chunk in new:
            ends = chunk.split(None, 1)
            if ends and len(ends[0]) == len(chunk):
                self.chunks[chunk] = None
                continue
            head = b"" if chunk[:1].isspace() or not ends else ends[0]
            tail = b"" if chunk[-1:].isspace() or not ends else chunk.rsplit(None, 1)[-1]
            opened.append((chunk, head, chunk[len(head):len(chunk) - len(tail)], tail))
        found = zip(opened, *self.pieces.encode([inner for _, _, inner, _ in opened]))
        for (chunk, head, _, tail), ids, text in found:
            self.chunks[chunk] = (head, ids, text, tail)

    def encode(self, cuts: list[list[bytes]]) -> tuple[list[bytes], list[bytes]]:
        """Ids and decoded form of texts given as chunks."""
        self.learn({chunk for chunks in cuts for chunk in chunks})
        plans, joins = [], set()
        for chunks in cuts:
            plan, left = [], b""
            for chunk in chunks:
                known = self.chunks[chunk]
                if known is None:  # no white space: the join goes on through the next chunk
                    left += chunk
                    continue
                plan.append((left + known[0], known))
                left = known[3]
            plan.append((left, None))
            joins.update(join for join, _ in plan)
            plans.append(plan)
        joins.discard(b"")
        asked = list(joins)
        repaired = {join: x for join, *x in zip(asked, *self.pieces.encode(asked))}
        ids, texts = [], []
        for plan in plans:
            found, spelled = [], []
            for join, known in plan:
                if join:
                    found.append(repaired[join][0])
                    spelled.append(repaired[join][1])
                if known:
                    found.append(known[1])
                    spelled.append(known[2])
            ids.append(b"".join(found))
            texts.append(b" ".join(filter(None, spelled)))
        return ids, texts


def _encoder(path: str):
    def make():
        store = ChunkStore(path)

        def encode(texts: pa.StringArray) -> list:
            ids, decoded = store.encode(cut(*text_bytes(texts)))
            return [[len(x) // 4 for x in ids], pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.binary()).cast(pa.string())]
        return encode
    return make


def encode_decode(docs: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """The `keep` columns, `n_tokens`, `ids` (little-endian unsigned 32-bit integers behind one
    another) and `decoded`, the text that the ids decode to."""
    return per_text(docs, keep, text, _encoder(path),
                    "n_tokens bigint, ids binary, decoded string")
