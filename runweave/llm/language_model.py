"""N-gram language model in a log-frequency Bloom filter.

A token's or pair's count c is quantised to the level 1 + floor(log_b c), and the filter holds the n-gram once
for each level up to its own. A lookup probes level after level until one is missing: counts cost no more room
than a few bits a level, are never too low, and are too high only by false positives. The filter has the same bits for each
entry at any size of the corpus: it grows with the n-grams and stays a table of slices, one for each bucket of hashes.
Counting, building the slices and probing them are shuffles over the whole corpus; no part of the filter is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Ratio of neighbouring count levels, bits for each filter entry, bits that an entry sets.
BASE, ENTRY_BITS, PROBES = 2**0.5, 6, 3
#: Bytes of text for each bucket at most: its n-grams, counts and bits stay below 256 MB then, even if no n-gram repeats.
BUCKET_TEXT = 48 << 20
#: Rows whose n-grams are counted, or looked up, together.
ROWS = 4000
#: Weight of a token's own share against the pairs seen after its predecessor (Dirichlet smoothing).
MU = 1000.0
#: Distinct tokens whose exact counts are broadcast; rarer ones are joined by a shuffle.
HEAVY_TOKENS = 1_000_000
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_UNI = np.uint64(0x5851F42D4C957F2D)
#: Filter keys have 64 bits less these: with a billion n-grams another one has the same key with odds of 4 in a million.
_CUT = np.uint64(16)


def _stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts one after the other, each with an end behind; and the texts' numbers of tokens."""
    parts, sizes = [], []
    for t in texts:
        ws = common.words_of(t)
        parts.append(common.hashes(ws))
        parts.append(np.array([END], np.uint64))
        sizes.append(len(ws) + 1)
    return np.concatenate(parts), np.array(sizes, np.int64)


def _pairs(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Filter key of each token with the one before it; a text begins after an end."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[0] = END
    return common.pairs_hash(before, h) >> _CUT


def _packed(keys: np.ndarray, b: int, buckets: int) -> bytes:
    """Sorted keys of bucket b: their differences, compressed by place of the byte."""
    d = keys // np.uint64(buckets)
    d[1:] -= d[:-1].copy()
    return len(keys).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, b: int, buckets: int) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    d = np.frombuffer(pa.decompress(blob[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(d.T).view(np.uint64).ravel(), dtype=np.uint64) * np.uint64(buckets) + np.uint64(b)


def _blobs(kind: str, keys: np.ndarray, buckets: int):
    """Rows (kind, bucket, keys found once, other keys, their counts) of the keys' multiset."""
    some, many = np.unique(keys, return_counts=True)
    order, bounds = common.by_bucket(some, buckets)
    some, many = some[order], many[order]
    for b in range(buckets):
        k, c = some[bounds[b] : bounds[b + 1]], many[bounds[b] : bounds[b + 1]]
        if len(k):
            yield kind, b, _packed(k[c == 1], b, buckets), _packed(k[c > 1], b, buckets), c[c > 1].astype(np.uint32).tobytes()


_BLOB = "kind string, bucket int, once binary, more binary, counts binary"


def count(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of tokens and pairs, summed within each batch of rows and dealt into buckets by hash."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                h, sizes = _stream(common.texts(batch.column(0).slice(at, ROWS)))
                for kind, keys in (("token", h), ("pair", _pairs(h, sizes))):
                    rows = list(_blobs(kind, keys, buckets))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["kind", "bucket", "once", "more", "counts"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, _BLOB)


def _merged(rows: list[tuple[bytes, bytes, bytes]], b: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their total counts."""
    once = [_unpacked(r[0], b, buckets) for r in rows]
    more = [_unpacked(r[1], b, buckets) for r in rows]
    keys = np.concatenate([*once, *more, np.zeros(0, np.uint64)])
    counts = np.concatenate([np.ones(sum(map(len, once)), np.int64), *[np.frombuffer(r[2], np.uint32).astype(np.int64) for r in rows]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = common.segments(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts; 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def counts_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers that it holds; 0 for 0."""
    low = np.ceil(BASE ** (np.maximum(level, 1) - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.maximum(level, 1).astype(float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


#: Most levels that a count of 63 bits has.
_LEVELS = int(levels(np.array([(1 << 63) - 1]))[0])


def _place(keys: np.ndarray, level: int | np.ndarray, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the slice that holds (key, level), and the bits that it sets there."""
    with np.errstate(over="ignore"):
        x = common.finish(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
        y = common.finish(x ^ np.uint64(0xC2B2AE3D27D4EB4F))
    mask = np.zeros(len(x), np.uint64)
    for j in range(PROBES):
        mask |= np.uint64(1) << ((y >> np.uint64(6 * j)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32), mask


def slice_of(keys: np.ndarray, level: np.ndarray, most_words: int | None = None) -> np.ndarray:
    """Filter slice of the keys with these levels: ENTRY_BITS for each entry, or fewer with most_words 64-bit words."""
    words = max(1, -(-int(level.sum()) * ENTRY_BITS // 64))
    words = min(most_words or words, words)
    out = np.zeros(words, np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        alive = keys[level >= j]
        at, mask = _place(alive, j, words)
        np.bitwise_or.at(out, at.astype(np.int64), mask)
    return out


class LogFilter:
    """The filter's slices and the lookup by repeated membership probes, up to the highest level of any key in a slice."""

    def __init__(self, slices: list[np.ndarray], tops: list[int] | None = None):
        self.buckets = len(slices)
        self.sizes = np.array([len(s) for s in slices], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if slices else np.zeros(0, np.int64)
        self.bits = np.concatenate(slices) if slices else np.zeros(0, np.uint64)
        self.tops = np.array(tops if tops is not None else [_LEVELS] * len(slices), np.int64)

    def lookup(self, keys: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
        """Levels of the keys: the number of levels found before the first that is missing."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.bits):
            return out
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64) if bucket is None else bucket
        alive, j = np.arange(len(keys)), 1
        while len(alive := alive[self.tops[bucket[alive]] >= j]):
            at, mask = _place(keys[alive], j, self.sizes[bucket[alive]])
            alive = alive[(self.bits[self.starts[bucket[alive]] + at.astype(np.int64)] & mask) == mask]
            out[alive] = j
            j += 1
        return out


def train(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Exact token counts and the filter of quantised token and pair counts of all rows of docs, and the number of buckets.

    The table has a row for each bucket: the tokens' hashes h and counts c, the slice's bits and highest level (top). There are as many
    buckets as shuffle partitions, and more where these would take more than BUCKET_TEXT of the texts each; a task has one bucket.
    """
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, common.partitions(spark), -(-size // BUCKET_TEXT))

    def build(batches):
        held: dict[int, dict[str, list]] = {}
        for batch in batches:
            for kind, b, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, {}).setdefault(kind, []).append(blobs)
        for b in sorted(held):
            h, c = _merged(held[b].get("token", []), b, buckets)
            pk, pc = _merged(held[b].pop("pair", []), b, buckets)
            # a token lives in the slice of its own hash, like the pairs of that remainder
            keys = np.concatenate([_unigram(h, buckets), pk])
            level = np.concatenate([levels(c), levels(pc)])
            bits = slice_of(keys, level)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([c.astype(np.int64).tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary()), pa.array([int(level.max(initial=0))], pa.int32()), pa.array([int(c.sum())], pa.int64()), pa.array([len(h)], pa.int64())], ["bucket", "h", "c", "bits", "top", "total", "tokens"])

    built = count(docs, buckets).repartitionById(buckets, F.col("bucket")).mapInArrow(build, "bucket int, h binary, c binary, bits binary, top int, total long, tokens long")
    return common.materialize(spark, built, "ngrams")[0], buckets


def _unigram(h: np.ndarray, buckets: int) -> np.ndarray:
    """Filter keys of single tokens: other values, of the same remainder as the tokens' hashes."""
    n = np.uint64(buckets)
    with np.errstate(over="ignore"):
        x = common.finish(h ^ _UNI) >> _CUT
        return x - x % n + h % n


def _heavy(spark: SparkSession, built: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Hashes (sorted) and exact counts of the commonest tokens, at most HEAVY_TOKENS, and whether these are all.

    The least count is read from a histogram of count magnitudes, so no sort of the vocabulary is needed.
    """

    def sizes(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                k = np.bincount(np.frexp(np.frombuffer(c, np.int64))[1], minlength=64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(k))), pa.array(k)], ["e", "n"])

    found = sorted(((r["e"], r["n"]) for r in built.select("c").mapInArrow(sizes, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect()), reverse=True)
    room, least = HEAVY_TOKENS, 64
    for e, n in found:
        if n > room:
            break
        room, least = room - n, e
    whole = least == min((e for e, n in found if n), default=least)
    limit = 0 if whole else 1 << max(0, least - 1)

    def pick(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([h[c >= limit].tobytes()], pa.binary()), pa.array([c[c >= limit].tobytes()], pa.binary())], ["h", "c"])

    rows = list(built.select("h", "c").mapInArrow(pick, "h binary, c binary").toLocalIterator())
    h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
    c = np.concatenate([np.frombuffer(r["c"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    order = np.argsort(h)
    return h[order], c[order], whole


_ASK = "batch long, bucket int, top int, blob binary"
_ASK_TYPES = dict(zip(("batch", "bucket", "top", "blob"), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))


def _ask_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ASK_TYPES.values(), strict=True)], list(_ASK_TYPES))


def _parts(batches):
    """(number, rows) of the parts of ROWS rows. The number is a hash of place and texts: another order of rows gives others."""
    place = 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = xxhash.xxh3_64(f"{TaskContext.get().partitionId()} {place} {part.column(0).to_pylist()}".encode())
            for t in common.texts(part.column(2)):
                x.update((b"" if t is None else t) + b"\0")
            place += 1
            yield int(np.uint64(x.intdigest()).view(np.int64)), part


class _Ngrams:
    """The distinct tokens and pairs of a part's texts, and their filter keys by bucket."""

    def __init__(self, texts: list[bytes | None], buckets: int):
        h, self.sizes = self.stream = _stream(texts)
        self.some, self.which = np.unique(h, return_inverse=True)
        pairs, self.place = np.unique(_pairs(h, self.sizes), return_inverse=True)
        self.keys = np.concatenate([_unigram(self.some, buckets), pairs])
        self.order, self.bounds = common.by_bucket(self.keys, buckets)


def _answers(spark: SparkSession, docs: DataFrame, built: DataFrame, buckets: int) -> DataFrame:
    """Levels of all n-grams of docs, as rows (batch, bucket, levels): each part's distinct keys meet their slices by a shuffle."""

    def ask(batches):
        for number, part in _parts(batches):
            n = _Ngrams(common.texts(part.column(2)), buckets)
            keys = n.keys[n.order]
            yield _ask_rows([(number, b, 0, _packed(keys[x:y], b, buckets)) for b, (x, y) in enumerate(zip(n.bounds[:-1].tolist(), n.bounds[1:].tolist(), strict=True)) if y > x])

    def answer(batches):
        own, model = None, LogFilter([])
        for batch in batches:
            for i in range(batch.num_rows):
                number, b, top, blob = (c[i].as_py() for c in batch.columns)
                if number is None:  # a slice comes before what is asked of it
                    own, model = b, LogFilter([np.frombuffer(blob, np.uint64)], [top])
                    continue
                keys = _unpacked(blob, b, buckets)
                found = model.lookup(keys, np.zeros(len(keys), np.int64)) if b == own else np.zeros(len(keys), np.int64)
                yield _ask_rows([(number, b, 0, len(keys).to_bytes(4, "little") + pa.compress(found.astype(np.uint8), codec="zstd", asbytes=True))])

    slices = built.select(F.lit(None).cast("long").alias("batch"), "bucket", "top", F.col("bits").alias("blob"))
    asked = docs.mapInArrow(ask, _ASK).unionByName(slices)
    return asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("batch").asc_nulls_first()).mapInArrow(answer, _ASK)


def score(spark: SparkSession, docs: DataFrame, built: DataFrame, buckets: int) -> DataFrame:
    """For each row of docs (doc_id, held_out, text): its tokens, known tokens, add-one unigram score and the model's score.

    The model: p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V + 1), with the filter's counts.
    A null or empty text is an end alone. With no training rows every count is 0. docs is read twice and must give its rows
    in the same order, as files do; other rows raise an error.
    """
    told = built.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("v")).collect()[0]
    total, kinds = told["n"], told["v"]
    hh, hc, whole = _heavy(spark, built)
    sent = spark.sparkContext.broadcast((hh, hc))
    norm = float(total + kinds + 1)
    docs = docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string"))

    def home(batches):
        for number, part in _parts(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield _ask_rows([(number, -1, 0, sink.getvalue().to_pybytes())])

    def scored(part: pa.RecordBatch, told: dict[int, np.ndarray]) -> pa.RecordBatch:
        hh, hc = sent.value
        n = _Ngrams(common.texts(part.column(2)), buckets)
        (h, sizes), some, which, place = n.stream, n.some, n.which, n.place
        many = np.diff(n.bounds)
        if {b: len(x) for b, x in told.items()} != {b: k for b, k in enumerate(many.tolist()) if k}:
            raise ValueError("the documents came in another order when they were read again: materialize them first")
        level = np.zeros(len(n.keys), np.int64)
        level[n.order] = np.concatenate([told[b] for b in sorted(told)])
        level = counts_of(level)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        exact = np.zeros(len(some), np.int64)
        if len(hh):
            i = np.minimum(np.searchsorted(hh, some), len(hh) - 1)
            exact = np.where(hh[i] == some, hc[i], 0)
        approx = level[: len(some)]
        base = np.log10((exact + 1) / norm)[which]
        single = ((approx + 1) / norm)[which]
        both = level[len(some) :][place]
        end_count = approx[np.searchsorted(some, END)]
        own = approx[which]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[starts] = end_count
        p = (np.minimum(both, before) + MU * single) / (before + MU)
        add = [np.add.reduceat(x, starts) for x in (base, np.log10(p), (exact > 0)[which].astype(np.int64))]
        light = [[]] * len(sizes)
        if not whole:
            rare = (exact == 0)[which]
            light = [h[a:b][rare[a:b]].view(np.int64).tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [part.column(0), part.column(1), pa.array(sizes), pa.array(add[2]), pa.array(add[0]), pa.array(add[1]), pa.array(light, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "light"])

    def run(batches):
        own, part, told = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, b, _, blob = (c[i].as_py() for c in batch.columns)
                if number != own:
                    if part is not None:
                        yield scored(part, told)
                    own, part, told = number, None, {}
                if b < 0:
                    part = pa.ipc.open_stream(blob).read_next_batch()
                elif part is None:
                    raise ValueError("the documents came in another order when they were read again: materialize them first")
                else:
                    told[b] = np.frombuffer(pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True), np.uint8).astype(np.int64)
        if part is not None:
            yield scored(part, told)

    met = docs.mapInArrow(home, _ASK).unionByName(_answers(spark, docs, built, buckets))
    met = met.repartition(buckets, "batch").sortWithinPartitions("batch", "bucket")
    out = met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, light array<bigint>")
    if not whole:
        out = _with_light(spark, out, built, norm, len(hh))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _with_light(spark: SparkSession, out: DataFrame, built: DataFrame, norm: float, least: int) -> DataFrame:
    """Add what the tokens outside the broadcast add to n_known and base_score, by a join on the token.

    Each of these tokens is rarer than the broadcast ones, so no join key holds more than 1 / HEAVY_TOKENS of all tokens.
    """

    def flat(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["h", "c"])

    out, _ = common.materialize(spark, out.withColumn("_row", F.monotonically_increasing_id()), "scores")
    known = built.select("h", "c").mapInArrow(flat, "h long, c long")
    found = out.select("_row", F.explode("light").alias("h")).groupBy("_row", "h").agg(F.count("*").alias("n")).join(known, "h")
    # without its exact count a token was taken as unknown: log10(1 / norm)
    more = found.groupBy("_row").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("_s"))
    out = out.join(more, "_row", "left")
    return out.withColumns({"n_known": F.col("n_known") + F.coalesce("_n", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("_s", F.lit(0.0))})


def op3_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.checksum_mod("doc_id", 7) == 2)
    built, buckets = train(spark, docs.where(~F.col("held_out")))
    return score(spark, docs, built, buckets)
