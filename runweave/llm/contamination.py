"""Benchmark decontamination: SimHash of windows, multi-index Hamming blocks, exact verification.

Items are cut into disjoint parts, so many that the edits which leave an item similar enough cannot reach all of them
(see parts). Windows of every text are fingerprinted with 64 bits at the sizes of the parts, rounded down to classes. Two
fingerprints within RADIUS bits agree up to WITHIN bits in one of four blocks of 16, so tables of all block values that
near an item's find every such pair. A found pair is verified on the item's whole window: the similarity of the two
multisets of five-word shingles, weighted by their numbers, must reach PERCENT.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, PERCENT = 5, 80
BLOCKS, WITHIN = 4, 1
RADIUS = BLOCKS * (WITHIN + 1) - 1
#: Windows for items of SPARSE + STRIDE - 1 words or more start at every STRIDE-th word; such an item has a fingerprint at each
#: of the first STRIDE words of its parts, so a whole part meets one of them exactly. Smaller items have one start, and windows at every word.
#: The largest class fits 8-bit counters.
STRIDE, SPARSE, LARGEST = 4, 8, 240
#: Words at least (else lost) that items may begin earlier or later than a fingerprint tells; items compared in one pass over the texts.
SHIFT, ITEMS = 2, 50_000
#: Bytes of items' texts in one pass; a worker keeps INDEXES of the block tables that it has built.
ITEM_BYTES, INDEXES = 32 << 20, 2
#: Words whose windows are fingerprinted together.
CHUNK = 50_000
_TO_SPACE = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def normal(text: str | None) -> np.ndarray:
    """Hashes of the words: lower-cased runs without white space and ASCII punctuation; null has none."""
    return common.hashes((text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split())


def size_class(n: int) -> int:
    """Size of the fingerprinted windows for a part of n words: n under SPARSE + STRIDE - 1, else a class that leaves room for STRIDE starts."""
    if n < SPARSE + STRIDE - 1:
        return n
    c = SPARSE
    while (nxt := max(c + 1, c * 5 // 4)) <= min(n - STRIDE + 1, LARGEST):
        c = nxt
    return c


def stride(n: int) -> int:
    """Distance of the windows for items of n words: 1 for those of one start, whose class is the item itself."""
    return STRIDE if n >= SPARSE + STRIDE - 1 else 1


def lost(n: int) -> int:
    """Most shingles of an item of n words that a similar text may lack."""
    return max(0, n - WORDS + 1) * (100 - PERCENT) // (100 + PERCENT)


def parts(n: int) -> tuple[list[int], int]:
    """First words, and number of words, of the disjoint parts of an item of n words.

    An edit at the item's edge costs a shingle for each word up to its inner end; the parts keep lost(n) words off the
    edges, so no such edit reaches them. One inside costs 4 at least, and 6 where it reaches into two parts: 3 a part. With
    more parts than lost(n) / 3, some part is whole in every similar text that does not repeat the item's own shingles.
    """
    d = lost(n)
    many = 1 if d < 4 else d // 3 + 1
    size = (n - 2 * d) // many
    return [d + i * size for i in range(many)], size


#: Counters of 16 bits, four to a number, for the bits of a byte: 2 rows of 256.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint16).view(np.uint64).T.copy()
#: Words that the counters hold, and by which stretches of a longer text overlap.
_STRETCH, _OVERLAP = 60_000, 256


def _ones(h: np.ndarray) -> np.ndarray:
    """Running numbers of set bits at each of the 64 places: 16 rows of four counters, for at most 65,535 words."""
    out = np.zeros((16, len(h) + 1), np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    for b in range(8):
        own = np.ascontiguousarray(octets[:, b])
        for half in (0, 1):
            np.cumsum(_LANES[half][own], out=out[2 * b + half, 1:])
    return out


def fingerprints(ones: np.ndarray, c: int, step: int) -> np.ndarray:
    """SimHash of the windows of c words at every step-th word: the majority at each bit."""
    many = (ones.shape[1] - 1 - c) // step + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    counts = ones[:, c::step][:, :many] - ones[:, ::step][:, :many]
    bits = counts.view(np.uint16).reshape(16, many, 4) > c // 2
    return np.packbits(bits.transpose(1, 0, 2).reshape(many, 64), axis=1).view(np.uint64).ravel()


class Index:
    """Block tables over the items' fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, w) for i, t in items if len(w := normal(t))]
        self.shingles = [np.unique(common.shingles(w, WORDS), return_counts=True) for _, w in self.items]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, (_, w) in enumerate(self.items):
            firsts, size = parts(len(w))
            c, step = size_class(size), stride(size)
            for first in firsts:
                for o, f in enumerate(fingerprints(_ones(w[first : first + c + step - 1]), c, 1).tolist(), first):
                    found.setdefault((c, step), []).append((f, k, o))
        near = np.array([0] + [1 << i for i in range(16)], np.uint16)
        self.classes = {}
        for c, rows in found.items():
            f, k, o = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            tables = []
            for b in range(BLOCKS):
                values = (f.view(np.uint16).reshape(-1, BLOCKS)[:, b][:, None] ^ near[None, :]).ravel()
                order = np.argsort(values, kind="stable")
                bounds = np.searchsorted(values[order], np.arange(65537))
                tables.append((bounds, np.diff(bounds).astype(np.int32), np.repeat(np.arange(len(f)), len(near))[order]))
            self.classes[c] = (f, k, o, tables)

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, first word of the item) for all fingerprints within RADIUS; doc numbers the text of each word, in order."""
        out: set[tuple[int, int, int]] = set()
        for at in range(0, max(1, len(h) - _OVERLAP), _STRETCH - _OVERLAP):
            part = slice(at, at + _STRETCH)
            out.update((d, k, at + p) for d, k, p in self._stretch(h[part], doc[part]))
        return out

    def _stretch(self, h: np.ndarray, doc: np.ndarray) -> set[tuple[int, int, int]]:
        ones, out = _ones(h), set()
        for (c, step), (f, k, o, tables) in self.classes.items():
            own = fingerprints(ones, c, step)
            if not len(own):
                continue
            at = np.arange(len(own)) * step
            whole = np.flatnonzero(doc[at] == doc[at + c - 1])
            own, at = own[whole], at[whole]
            parts = np.ascontiguousarray(own).view(np.uint16).reshape(-1, BLOCKS)
            for b, (bounds, sizes, rows) in enumerate(tables):
                many = sizes[parts[:, b]]
                some = np.flatnonzero(many)
                for i in range(0, len(some), 100_000):
                    s = some[i : i + 100_000]
                    n = many[s]
                    w = np.repeat(s, n)
                    within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
                    r = rows[np.repeat(bounds[parts[s, b]], n) + within]
                    good = np.bitwise_count(own[w] ^ f[r]) <= RADIUS
                    w, r = w[good], r[good]
                    out.update(zip(doc[at[w]].tolist(), k[r].tolist(), (at[w] - o[r]).tolist(), strict=True))
        return out


    def places(self, k: int, shingles: np.ndarray) -> np.ndarray:
        """Place of each shingle among the item's distinct ones, -1 for others."""
        own = self.shingles[k][0]
        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        return np.where(own[at] == shingles, at, -1)


def in_common(places: np.ndarray, numbers: np.ndarray, m: int) -> np.ndarray:
    """For each window of m shingles how many it has in common with an item that has numbers[p] of those at place p.

    A shingle counts in the windows that hold it and no more than numbers - 1 equal ones before it, so each adds one to a run
    of windows: the time is that of sorting the places, whatever m is.
    """
    at = np.flatnonzero(places >= 0)
    at = at[np.argsort(places[at], kind="stable")]
    own = places[at]
    back = np.arange(len(at)) - numbers[own]
    same = (back >= 0) & (own[np.maximum(back, 0)] == own)
    before = np.where(same, at[np.maximum(back, 0)], -1)
    size = len(places) + 1
    change = np.bincount(np.maximum(before, at - m) + 1, minlength=size) - np.bincount(at + 1, minlength=size)
    return np.cumsum(change)[: size - m]


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of the least and of the greatest numbers of each shingle in two sequences of word hashes."""
    x, nx = np.unique(common.shingles(a, WORDS), return_counts=True)
    y, ny = np.unique(common.shingles(b, WORDS), return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(nx[i], ny[j]).sum())
    return least, int(nx.sum() + ny.sum()) - least


def _find(index: Index, texts: list[str | None]):
    """(text, item, similarity percent, first word) for the best window of each item found in a text."""
    words = [normal(t) for t in texts]
    at = 0
    while at < len(words):
        end, n = at, 0
        while end < len(words) and (end == at or n + len(words[end]) <= CHUNK):
            n += len(words[end])
            end += 1
        sizes = np.array([len(w) for w in words[at:end]])
        h = np.concatenate(words[at:end])
        starts = np.cumsum(sizes) - sizes
        found: dict[tuple[int, int], list[int]] = {}
        for d, k, first in index.candidates(h, np.repeat(np.arange(len(sizes)), sizes)):
            found.setdefault((d, k), []).append(first - int(starts[d]))
        for (d, k), firsts in sorted(found.items()):
            best = max((_best(index, k, words[at + d], a, b) for a, b in _runs(firsts, len(words[at + d]), len(index.items[k][1]))), key=lambda x: x or (0.0, 0))
            if best:
                yield at + d, index.items[k][0], best[0], -best[1]
        at = end


def _runs(firsts: list[int], own: int, item: int):
    """First and last place of each run of windows to compare: all that begin near a found place, each once."""
    shift, last = max(SHIFT, lost(item)), max(0, own - item)
    a = b = None
    for first in sorted(firsts):
        low, high = (min(max(first + s, 0), last) for s in (-shift, shift))
        if a is not None and low <= b + 1:
            b = max(b, high)
            continue
        if a is not None:
            yield a, b
        a, b = low, high
    yield a, b


def _best(index: Index, k: int, own: np.ndarray, a: int, b: int) -> tuple[float, int] | None:
    """(similarity percent, minus the first word) of the best of the windows of item k's size at a to b, the first of equals; None if none is similar enough."""
    item = index.items[k][1]
    size = min(len(item), len(own))
    if size < WORDS:
        tried = [(*similarity(own[p : p + size], item), -p) for p in range(a, b + 1)]
    else:
        m, full = size - WORDS + 1, len(item) - WORDS + 1
        places = index.places(k, common.shingles(own[a : b + size], WORDS))
        if 100 * int(np.count_nonzero(places >= 0)) < PERCENT * full:
            return None
        least = in_common(places, index.shingles[k][1], m)
        p = int(least.argmax())
        tried = [(int(least[p]), full + m - int(least[p]), -(a + p))]
    return max(((100 * x / y, p) for x, y, p in tried if 100 * x >= PERCENT * y), default=None)


def _indexed(spark: SparkSession, items: DataFrame):
    """Names and broadcasts of the distinct items (item_id, text) in blocks of about ITEMS and ITEM_BYTES at most, or one longer item."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-many // ITEMS), -(-size // ITEM_BYTES))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.collect()])


_built: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, str | None]]) -> Index:
    """The block tables of the items, built once in a worker."""
    if name not in _built:
        while len(_built) >= INDEXES:
            _built.pop(next(iter(_built)))
        _built[name] = Index(items)
    return _built[name]


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, similarity, first_word): each item (item_id, text) that a text holds, where it fits best.

    Null and empty texts and items match nothing; repeated rows of docs match each for itself, repeated items once; other columns
    are ignored. More than ITEMS items, or ITEM_BYTES of them, are compared in blocks, with a pass over the texts for each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for name, sent in _indexed(spark, items):

        def run(batches, name=name, sent=sent):
            index = _index(name, sent.value)
            for batch in batches:
                rows = list(_find(index, batch.column(1).to_pylist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows])), *[pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:], (pa.int64(), pa.float64(), pa.int64()), strict=True)]], ["doc_id", "item_id", "similarity", "first_word"])

        found = docs.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item; each row is judged by itself, so no join is needed."""
    place = docs.columns.index("text")
    for name, sent in _indexed(spark, items):

        def run(batches, name=name, sent=sent):
            index = _index(name, sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in _find(index, batch.column(place).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
