"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

1. Equal vectors are one node; a node keeps its 21 smallest ids, as no answer needs more. A further component lifts all nodes to one
   length. A query is a node of its own, with its direction, that length and 0 there: those nearest to it by angle are those of the
   largest inner product. It has a list but is in no list. Codes of one byte a component stand for all of these.
2. Nodes start with the nearest in the leaves of a few random partitions. Medians come from a sample of at most SAMPLE vectors.
3. NN-descent: each round joins every node's list with the codes of its neighbours, brings the nodes that list it to the same
   place, and compares both groups there: neighbours of neighbours, in either direction. A node keeps its DEGREE best. Pairs of
   old edges were compared before and are left out. Rounds end when under STILL of all edges are new.
4. Search: a query starts from its list, opens all unopened nodes among its BEAM best, and ends when none is
   left. The nodes in the beam are then scored on the original vectors in double precision.

Every row with a vector is indexed and no list of those that point at a node is cut: it is read as a stream, and those of
nodes that very many point at are dealt over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Neighbours of a node, nodes of a search's beam, answers.
DEGREE, BEAM, NEAREST = 48, 96, 20
#: Random partitions for the start, nodes of a leaf, vectors that medians are taken from.
TREES, LEAF, SAMPLE = 6, 400, 20_000
#: Share of new edges at which rounds end, and the most rounds.
STILL, ROUNDS = 0.06, 12
#: Nodes that so many (and a thousandth of all edges) point at are dealt into blocks.
HUB, BLOCKS = 4_096, 64
#: Pairs or rows that are held before they are reduced or sent on.
HELD, CHUNK = 1_000_000, 2_048

_STATE = "id long, asks boolean, code binary, scale float, dst array<long>, score array<float>, fresh array<boolean>"
_FOUND = "id long, dst array<long>, score array<float>"


def takes_part(vec_id: Column, vector: Column) -> Column:
    """Whether a row has an id and a vector with finite components, one of them not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vec_id.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and their number in each row; null is an empty list."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.asarray(column.flatten()), counts


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64, with zeros for components that a row has not."""
    values, counts = _flat(vectors)
    out = np.zeros((len(counts), dim))
    out[np.arange(dim)[None, :] < counts[:, None]] = values
    return out


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, longest - (x * x).sum(1)))[:, None]])


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(1) / 127
    return np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8), scale.astype(np.float32)


def _decoded(codes: pa.Array, scales: np.ndarray) -> np.ndarray:
    """Coded vectors as float32."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1).astype(np.float32) * scales[:, None]


def _reduce(src: np.ndarray, dst: np.ndarray, score: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The most best edges of each source, best first; an edge given twice counts once, and as old if it once is."""
    order = np.lexsort((fresh, dst, src))
    src, dst, score, fresh = src[order], dst[order], score[order], fresh[order]
    new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])) & (src != dst)
    src, dst, score, fresh = src[new], dst[new], score[new], fresh[new]
    order = np.lexsort((dst, -score, src))
    src, dst, score, fresh = src[order], dst[order], score[order], fresh[order]
    starts = common.segments(src)
    place = np.arange(len(src)) - np.repeat(starts, np.diff(np.append(starts, len(src))))
    keep = place < most
    return src[keep], dst[keep], score[keep], fresh[keep]


def _found(parts: list[tuple[np.ndarray, ...]], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, dst, score) of found pairs."""
    if not parts:
        return
    src, dst, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    src, dst, score, _ = _reduce(src, dst, score, np.zeros(len(src), bool), most)
    starts = common.segments(src)
    counts = np.diff(np.append(starts, len(src)))
    for i in range(0, len(starts), 20_000):
        a, b = starts[i], starts[i + 20_000] if i + 20_000 < len(starts) else len(src)
        c = counts[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(src[starts[i : i + 20_000]]), _lists(dst[a:b], c, pa.int64()), _lists(score[a:b], c, pa.float32())], ["id", "dst", "score"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Groups of rows sorted by keys; one of more than `most` rows comes in parts, the first of at least so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch) - 1, bool)
        for k in keys:
            c = batch.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        if held and any(held[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(batch) or most and sum(map(len, held)) >= most:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Nodes with their best edges, from rows of nodes and of found pairs sorted by id, those of nodes first."""

    def out(codes: dict, edges: tuple[np.ndarray, ...], ids: list[int]) -> pa.RecordBatch:
        src, dst, score, fresh = edges
        at = np.array(ids, np.int64)
        counts = np.searchsorted(src, at, "right") - np.searchsorted(src, at)
        asks, code, scale = zip(*(codes[i] for i in ids), strict=True)
        columns = [pa.array(at), pa.array(asks, pa.bool_()), pa.array(code, pa.binary()), pa.array(scale, pa.float32()), _lists(dst, counts, pa.int64()), _lists(score, counts, pa.float32()), _lists(fresh, counts, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STATE.split(", ")])

    codes: dict[int, tuple] = {}
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool))
    edges = empty
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("id").to_numpy()
        node = np.asarray(batch.column("code").is_valid())
        for i, *own in zip(ids[node].tolist(), *(batch.column(c).filter(pa.array(node)).to_pylist() for c in ("asks", "code", "scale")), strict=True):
            codes[i] = own
        dst, counts = _flat(batch.column("dst"))
        score, fresh = _flat(batch.column("score"))[0], _flat(batch.column("fresh"))[0].astype(bool)
        edges = _reduce(*(np.concatenate(c) for c in zip(edges, (np.repeat(ids, counts), dst, score, fresh), strict=True)), most)
        last = int(ids[-1])  # its rows may go on
        cut = np.searchsorted(edges[0], last)
        if whole := sorted(i for i in codes if i != last):
            yield out(codes, tuple(e[:cut] for e in edges), whole)
        edges, codes = tuple(e[cut:] for e in edges), {i: c for i, c in codes.items() if i == last}
    if codes:
        yield out(codes, edges, sorted(codes))


def _pairs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the nodes that meet at one place: the listed ones (kind 0, first) with each other and with those that list it."""
    held: list[tuple[np.ndarray, ...]] = []
    size, place, listed = 0, None, None
    for group in _groups(batches, ["at", "block"], CHUNK):
        here = (group.column("at")[0].as_py(), group.column("block")[0].as_py())
        for a in range(0, len(group), CHUNK):
            part = group.slice(a, CHUNK)
            ids, bar = part.column("member").to_numpy(), part.column("bar").to_numpy()
            fresh, asks = (np.asarray(part.column(c)).astype(bool) for c in ("fresh", "asks"))
            x = _decoded(part.column("code"), part.column("scale").to_numpy())
            if here != place:
                own = part.column("kind").to_numpy() == 0
                place, listed = here, (ids[own], bar[own], fresh[own], x[own])
            to, to_bar, to_fresh, y = listed
            if not len(to):
                continue
            score = x @ y.T
            open_ = (fresh[:, None] | to_fresh[None, :]) & (ids[:, None] != to[None, :])
            i, j = np.nonzero(open_ & (score > bar[:, None]))
            k, m = np.nonzero(open_ & (score > to_bar[None, :]) & ~asks[:, None])
            held += [(ids[i], to[j], score[i, j]), (to[m], ids[k], score[k, m])]
            size += len(i) + len(k)
            if size >= HELD:
                yield from _found(held, most)
                held, size = [], 0
    yield from _found(held, most)


class Planes:
    """Random planes of each partition, with the medians of a sample, as one array."""

    def __init__(self, sample: np.ndarray, n: int):
        self.bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
        self.normals = np.random.default_rng(1).standard_normal((sample.shape[1], TREES * self.bits))
        self.medians = np.median(sample @ self.normals, axis=0) if len(sample) and self.bits else np.zeros(TREES * self.bits)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each partition."""
        above = (x @ self.normals > self.medians).reshape(len(x), TREES, self.bits)
        return above @ (1 << np.arange(self.bits, dtype=np.int64))


def _leaf_rows(batches: Iterator[pa.RecordBatch], planes: Planes, large: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _decoded(batch.column("code"), batch.column("scale").to_numpy())
        leaves = planes.leaves(x)
        mixed = common.finish(batch.column("id").to_numpy().view(np.uint64))
        for tree in range(TREES):
            leaf = leaves[:, tree]
            blocks = np.array([large.get((tree, b), 1) for b in leaf.tolist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), tree, np.int32)), pa.array(leaf), pa.array((mixed % blocks).astype(np.int32)), *batch.columns], ["tree", "leaf", "block", *batch.schema.names])


def _start(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The nearest of each node in its leaf; a large leaf is cut into parts of LEAF nodes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for group in _groups(batches, ["tree", "leaf", "block"]):
        parts = max(1, round(len(group) / LEAF))
        for part in range(parts):
            some = group.slice(len(group) * part // parts, len(group) * (part + 1) // parts - len(group) * part // parts)
            if len(some) < 2:
                continue
            ids, x = some.column("id").to_numpy(), _decoded(some.column("code"), some.column("scale").to_numpy())
            score = x @ x.T
            np.fill_diagonal(score, -np.inf)
            score[:, np.asarray(some.column("asks")).astype(bool)] = -np.inf  # a query is in no list
            k = min(most, len(ids) - 1)
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            found = np.take_along_axis(score, best, 1)
            good = np.isfinite(found)
            held.append((np.repeat(ids, k)[good.ravel()], ids[best][good], found[good]))
            size += len(ids) * k
            if size >= HELD:
                yield from _found(held, most)
                held, size = [], 0
    yield from _found(held, most)


def members(vectors: DataFrame) -> DataFrame:
    """Rows (node, vec_id, place, v) of vectors (vec_id, embedding) that take part, the first NEAREST + 1 ids of equal vectors."""
    rows = vectors.where(takes_part(F.col("vec_id"), F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= NEAREST + 1)
    return few.select(F.xxhash64("v").alias("node"), "vec_id", "place", F.when(F.col("place") == 1, F.col("v")).alias("v")).dropDuplicates(["node", "vec_id"])


def _met(state: DataFrame, spark: SparkSession, edges: int) -> DataFrame:
    """Rows (at, block, kind, member, asks, code, scale, bar, fresh): at each node, those that it lists (0) and those that list it (1)."""
    bar = F.when(F.size("dst") < DEGREE, F.lit(float("-inf"))).otherwise(F.element_at("score", -1)).cast("float")
    own = ("asks", "code", "scale", "bar")
    nodes = state.withColumn("bar", bar).select("id", *own, F.arrays_zip("dst", "fresh").alias("list"))
    out = nodes.select("id", *own, F.explode("list").alias("e")).select("id", *own, F.col("e.dst").alias("dst"), F.col("e.fresh").alias("fresh"))
    # at most a thousand nodes
    hubs = [r["dst"] for r in out.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= max(HUB, edges // 1000)).collect()]
    of = lambda c: F.when(F.col(c).isin(hubs), F.lit(BLOCKS)).otherwise(1) if hubs else F.lit(1)
    block = F.pmod(F.xxhash64("id"), of("dst")).cast("int")
    listing = out.select(F.col("dst").alias("at"), block.alias("block"), F.lit(1).alias("kind"), F.col("id").alias("member"), *own, "fresh")
    lists = out.select(F.col("id").alias("at"), F.col("dst").alias("member"), "fresh").join(nodes.select(F.col("id").alias("member"), *own), "member")
    every = F.explode(F.sequence(F.lit(0), of("at") - 1)) if hubs else F.lit(0)
    listed = lists.select("at", every.alias("block"), F.lit(0).alias("kind"), "member", *own, "fresh")
    return listed.unionByName(listing)


def _sized(nodes: DataFrame) -> tuple[int, int, float]:
    """Number of nodes, most components, largest squared length."""
    v = F.transform("v", lambda x: x.cast("double"))
    r = nodes.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).first()
    return r[0], r[1] or 0, r[2] or 0.0


def asking_id(node: Column) -> Column:
    """The number of a node's query in the graph."""
    return F.xxhash64(node, F.lit("asks"))


def descend(spark: SparkSession, nodes: DataFrame, queries: DataFrame) -> tuple[DataFrame, str]:
    """The neighbour graph of nodes (node, v) and of queries (query: a node, v), and its folder.

    It is a written table (id, asks, code, scale, dst, score, fresh) with the list of each node and query, best first.
    """
    n, dim, longest = _sized(nodes)
    parts = common.partitions(spark)

    def coded(batches):
        for batch in batches:
            x, asks = _matrix(batch.column("v"), dim), np.asarray(batch.column("asks")).astype(bool)
            x[asks] *= np.sqrt(longest / (x[asks] ** 2).sum(1))[:, None]
            x = _lifted(x, longest)
            x[asks, -1] = 0
            codes, scales = _coded(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scales)], ["id", "asks", "code", "scale"])

    both = nodes.select(F.col("node").alias("id"), F.lit(False).alias("asks"), "v").unionByName(queries.select(asking_id(F.col("query")).alias("id"), F.lit(True).alias("asks"), "v"))
    codes, codes_path = common.materialize(spark, both.mapInArrow(coded, "id long, asks boolean, code binary, scale float"), "codes")
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-n // SAMPLE)))) == 0).select("v").toArrow()
    sample = _lifted(_matrix(some.column("v").combine_chunks(), dim), longest) if len(some) else np.zeros((0, dim + 1))
    planes, most = Planes(sample, n), DEGREE
    leaf_schema = "tree int, leaf long, block int, id long, asks boolean, code binary, scale float"
    placed = lambda large: codes.mapInArrow(lambda batches: _leaf_rows(batches, planes, large), leaf_schema)
    counts = placed({}).groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") >= max(8 * LEAF, n // 1000))
    large = {(r["tree"], r["leaf"]): -(-r["n"] // LEAF) for r in counts.collect()}  # at most a thousand of each tree
    start = placed(large).repartition(parts, "tree", "leaf", "block").sortWithinPartitions("tree", "leaf", "block").mapInArrow(lambda batches: _start(batches, most), _FOUND)

    def merge(state: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
        rows = state.unionByName(found.withColumn("fresh", F.transform("dst", lambda _: F.lit(True))), allowMissingColumns=True)
        merged = rows.repartition(parts, "id").sortWithinPartitions("id", F.col("code").isNull()).mapInArrow(lambda batches: _merged(batches, most), _STATE)
        return common.materialize(spark, merged, "neighbours")

    state, path = merge(codes.selectExpr("*", "CAST(array() AS array<long>) dst", "CAST(array() AS array<float>) score", "CAST(array() AS array<boolean>) fresh"), start)
    common.remove(spark, codes_path)
    for _ in range(ROUNDS):
        edges, new = state.agg(F.sum(F.size("dst")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if not edges or new < STILL * edges:
            break
        meeting = _met(state, spark, edges).repartition(parts, "at", "block").sortWithinPartitions("at", "block", "kind")
        found = meeting.mapInArrow(lambda batches: _pairs(batches, most), _FOUND)
        old = path
        state, path = merge(state.withColumn("fresh", F.transform("dst", lambda _: F.lit(False))), found)
        common.remove(spark, old)
    return state, path


_BEAM = "query long, v array<double>, ids array<long>, scores array<float>, opened array<boolean>"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score the neighbours of opened nodes: rows (query, ids, scores) of those above the bar of the query's beam."""
    for batch in batches:
        query, ids, scores = [], [], []
        bar, v = batch.column("bar").to_numpy(), batch.column("v")
        wide, lists, scales = batch.column("codes").to_pylist(), batch.column("dst"), batch.column("scales")
        for i in range(len(batch)):
            to, scale = np.asarray(lists[i].values), np.asarray(scales[i].values)
            x = np.asarray(v[i].values)
            y = np.frombuffer(wide[i], np.int8).reshape(len(to), -1)[:, : len(x)].astype(np.float32)
            score = (y @ x[: y.shape[1]].astype(np.float32)) * scale
            keep = score > bar[i]
            query.append(batch.column("query")[i].as_py())
            ids.append(to[keep])
            scores.append(score[keep])
        if query:
            counts = np.array([len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), _lists(np.concatenate(ids), counts, pa.int64()), _lists(np.concatenate(scores), counts, pa.float32())], ["query", "ids", "scores"])


def _beams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Beams with what was found, from rows sorted by query, the beam first; what was opened stays so."""
    for group in _groups(batches, ["query"]):
        (ids, _), (scores, _), (opened, _) = (_flat(group.column(c)) for c in ("ids", "scores", "opened"))
        opened = np.append(opened.astype(bool), np.zeros(len(ids) - len(opened), bool))
        _, first = np.unique(ids, return_index=True)  # the beam's own entry comes first
        order = first[np.lexsort((ids[first], -scores[first]))][:most]
        columns = [group.column("query")[:1], group.column("v")[:1], *(_lists(c[order], [len(order)], k) for c, k in ((ids, pa.int64()), (scores, pa.float32()), (opened, pa.bool_())))]
        yield pa.RecordBatch.from_arrays(columns, ["query", "v", "ids", "scores", "opened"])


def search(spark: SparkSession, graph: DataFrame, queries: DataFrame) -> tuple[DataFrame, str]:
    """Beams (query, v, ids, scores, opened) of queries (query: a node, v) in a graph of descend() that has them; and the folder of the table."""
    parts, most = common.partitions(spark), BEAM
    asked = queries.select(F.col("query"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    lists = graph.select(F.col("id").alias("at"), F.posexplode("dst").alias("place", "member")).join(graph.select(F.col("id").alias("member"), "code", "scale"), "member")

    def packed(batches):
        for group in _groups(batches, ["at"]):
            order = np.argsort(group.column("place").to_numpy())
            ids, scale = group.column("member").to_numpy()[order], group.column("scale").to_numpy()[order]
            codes = group.column("code").to_pylist()
            n = [len(ids)]
            yield pa.RecordBatch.from_arrays([group.column("at")[:1], _lists(ids, n, pa.int64()), _lists(scale, n, pa.float32()), pa.array([b"".join(codes[i] for i in order)], pa.binary())], ["at", "dst", "scales", "codes"])

    wide, wide_path = common.materialize(spark, lists.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(packed, "at long, dst array<long>, scales array<float>, codes binary"), "graph")
    # partitioned once by node for all rounds; a lost part is read again from the table
    wide = wide.repartition(parts, "at").persist(StorageLevel.DISK_ONLY)

    def scored(batches):
        for batch in batches:
            yield from _walk([batch])

    def merge(beams: DataFrame | None, found: DataFrame) -> tuple[DataFrame, str]:
        rows = beams.unionByName(found, allowMissingColumns=True)
        return common.materialize(spark, rows.repartition(parts, "query").sortWithinPartitions("query", F.col("v").isNull()).mapInArrow(lambda batches: _beams(batches, most), _BEAM), "beams")

    # a query opens its own list first
    empty = asked.select("query", "v", F.array(asking_id(F.col("query"))).alias("ids"), F.array(F.lit(float("-inf")).cast("float")).alias("scores"), F.array(F.lit(False)).alias("opened"))
    beams, path = common.materialize(spark, empty, "beams")
    while True:
        unopened = F.filter(F.arrays_zip("ids", "opened"), lambda e: ~e["opened"])
        bar = F.when(F.size("ids") < most, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1)).cast("float")
        todo = beams.select("query", "v", bar.alias("bar"), F.explode(unopened).alias("e")).select("query", "v", "bar", F.col("e.ids").alias("at"))
        if todo.isEmpty():
            break
        found = todo.join(wide, "at").select("query", "v", "bar", "dst", "scales", "codes").mapInArrow(scored, "query long, ids array<long>, scores array<float>")
        old = path
        beams, path = merge(beams.withColumn("opened", F.transform("opened", lambda _: F.lit(True))), found)
        common.remove(spark, old)
    wide.unpersist()
    common.remove(spark, wide_path)
    return beams, path


def nearest(spark: SparkSession, vectors: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) with the k nearest found (k up to NEAREST) of each row of vectors (vec_id, embedding; others are ignored) for which `asks` holds.

    Score is the inner product in double precision; ties go to the smaller vec_id. Candidates are all rows but the query's own; a
    repeated row counts once. Rows without id, and vectors that are null, zero, or hold a null or a non-finite component, take
    no part. A component that a shorter vector lacks counts as zero. With k or fewer candidates all that were found come back.
    """
    if not 1 <= k <= NEAREST:
        raise ValueError(f"k must be 1 to {NEAREST}")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    held, _ = common.materialize(spark, members(vectors), "members")
    nodes = held.where("place = 1").select("node", "v")
    asking = vectors.where(asks & takes_part(F.col("vec_id"), F.col("embedding"))).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query")).distinct()
    queries = nodes.join(asking.select("query").distinct(), nodes["node"] == F.col("query"), "left_semi").select(F.col("node").alias("query"), "v")
    graph, graph_path = descend(spark, nodes, queries)
    beams, _ = search(spark, graph, queries)
    common.remove(spark, graph_path)

    def exact(batches):
        for batch in batches:
            values, counts = _flat(batch.column("a"))
            others, theirs = _flat(batch.column("b"))
            dim = int(max(counts.max(initial=0), theirs.max(initial=0)))
            score = np.einsum("ij,ij->i", _matrix(batch.column("a"), dim), _matrix(batch.column("b"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)], ["query", "node", "score"])

    pairs = beams.select("query", F.col("v").alias("a"), F.explode("ids").alias("node")).join(nodes.withColumnRenamed("v", "b"), "node")
    scores = pairs.select("query", "node", "a", "b").mapInArrow(exact, "query long, node long, score double")
    # of each node found, its smallest ids: enough to fill the answer without the query's own
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ids = scores.join(held.select("node", "vec_id"), "node").select("query", "score", "vec_id", best.alias("place")).where(F.col("place") <= k + 1)
    answers = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    mine = asking.join(answers, "query").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    out = mine.select("query_id", F.posexplode("found").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
