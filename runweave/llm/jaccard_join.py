"""Exact n-gram Jaccard join of all documents by signature trees.

1. Every text gives its set of shingle hashes. Equal sets are one set from here on.
2. Two sets with Jaccard similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, in any
   common order; very frequent shingles come last in it. So the sets meet in the group of such a shingle.
3. Each group is a signature tree of bitmaps; its dual traversal leaves the pairs that may be similar enough.
4. The components of those pairs come together with their whole sets, and a second traversal verifies exactly.

No pair of sets with the similarity is lost: 2 and the bounds in the trees are exact, and 4 compares whole sets. Pairs
inside a component found already are not compared again. A set is told from others by 117 bits of two hashes and its size, a
shingle by 64 bits.

No group is too large for its task. A shingle that very many sets share is dealt into pairs of blocks where its sets are read;
every other group falls into pairs of blocks by its true size, which the task that gathers it knows. Joins on a much copied
set, or on the hub of many links, are salted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, signature_tree

WORDS, PERCENT = 5, 80
#: Logarithm of the step between the sizes that set numbers tell apart; steps by which sizes of similar sets differ at most.
STEP = math.log(1.02)
APART = int(math.log(100 / PERCENT) / STEP) + 1
#: A shingle in over 1 / RARE of the documents (FREQUENT at least) comes last in the order.
RARE, FREQUENT = 1000, 64
#: Sets that one tree takes at most, and at least before a group is split; larger groups are dealt into blocks of about half as
#: many, and each two blocks meet. See tree_sets().
GROUP_SETS, GROUP_LEAST = 20_000, 1_000
#: Bits of a set's bitmap at most where the bitmap goes to every group of the set, so that its traffic grows with the words of a very
#: long text and not with their square; the exact traversal has bitmaps of full width.
WIDEST = 1 << 16
#: Shingles that one exact traversal takes, by the same rule.
GROUP_SHINGLES = 16_000_000
#: Documents of one set from which joins on the set are salted, and salts.
COPIES, SALTS = 1_000_000, 64
#: Sets, or shingles, whose frequent shingles are named together.
NAMED_SETS, NAMED_SHINGLES = 2_000, 2_000_000
#: Documents to look up again for which the list is broadcast; longer lists are joined by a shuffle.
BROADCAST_DOCS = 1_000_000


def shingle_set(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than k words are one shingle; none without words."""
    return np.unique(common.shingles(common.hashes(common.words_of(text)), k))


def set_id(u: np.ndarray) -> int:
    """Number of a shingle set, 0 for an empty one: its size in steps of 2 % above 53 bits of its hash, so numbers sort by size."""
    if not len(u):
        return 0
    return int(math.log(len(u)) / STEP) << 53 | xxhash.xxh3_64_intdigest(u.tobytes()) >> 11


def set_check(u: np.ndarray) -> int:
    """Further 64 bits that tell sets of one number apart."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes(), seed=1)).view(np.int64))


def tree_sets(n: int, most: int, least: int) -> int:
    """Sets of a tree for a group of n: in small groups many tasks share the work, in large ones fewer sets travel twice."""
    return min(most, max(least, 20 * math.isqrt(n)))


def _sets(batch: pa.RecordBatch):
    for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch.column("text")), strict=True):
        u = shingle_set(text)
        yield doc, u, set_id(u), set_check(u)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


_PROFILE = "doc_id long, key long, n long, sid long, uid long, bits binary, h long, c long"


def _profile_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 5, pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PROFILE.split(", ")])


def _named(sets: list[np.ndarray]) -> list[tuple]:
    """Rows of the shingles that are frequent among these sets."""
    some, many = np.unique(np.concatenate(sets), return_counts=True)
    keep = many >= max(8, len(sets) // RARE)
    return [(*[None] * 6, h, c) for h, c in zip(_signed(some[keep]).tolist(), many[keep].tolist(), strict=True)]


def _profiles(docs: DataFrame) -> DataFrame:
    """A row (doc_id, key, n, sid, uid, bits) for each document, and rows (h, c) of shingles that are frequent in a part of a task's rows.

    A very frequent shingle is so in some part, so these rows name all of them, but for tables in parts of under 8 sets.
    """
    widest = WIDEST

    def run(batches):
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            rows = []
            for (doc, u, s, check), key in zip(_sets(batch), batch.column("key").to_pylist(), strict=True):
                new = len(u) > 0 and (s, check) not in seen
                rows.append((doc, key, len(u), s, check, signature_tree.bitmap(u, widest) if new else None, None, None))
                if new:
                    seen.add((s, check))
                    held.append(u)
                    size += len(u)
                    if len(held) >= NAMED_SETS or size >= NAMED_SHINGLES:
                        rows += _named(held)
                        held, size, seen = [], 0, set()
            if rows:
                yield _profile_rows(rows)
        if held and (rows := _named(held)):
            yield _profile_rows(rows)

    return docs.mapInArrow(run, _PROFILE)


def frequent(profiles: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and document counts of the very frequent shingles: at most RARE times the mean set size."""
    rows = profiles.where(F.col("h").isNotNull()).groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(FREQUENT, total // RARE)).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["c"] for r in rows], np.int64)[order]


#: Marks the keys of groups that are dealt into blocks already.
_DEALT = np.uint64(1)


def _keys(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """The first shingles of each set with the set's number, as arrays by bucket of the shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        hot, counts = sent.value
        for batch in batches:
            keys, sids = [], []
            done = set()
            for doc, u, s, check in _sets(batch):
                if (s, check) in done or not len(u) or doc is None:
                    continue
                done.add((s, check))
                n = len(u)
                take = n - (PERCENT * n + 99) // 100 + 1
                rest = u[:take] & ~_DEALT
                if len(hot):
                    late = np.isin(u, hot, assume_unique=True)
                    first = u[~late][:take]
                    rest = [first & ~_DEALT]
                    for k in u[late][: take - len(first)]:
                        blocks = int(-(-2 * counts[np.searchsorted(hot, k)] // GROUP_SETS))
                        if blocks <= 2:
                            rest.append(np.array([k]) & ~_DEALT)
                        else:  # each two blocks of the sets with this shingle meet
                            own = s % blocks
                            pairs = [min(own, j) * blocks + max(own, j) for j in range(blocks) if j != own]
                            rest.append(common.pairs_hash(np.full(len(pairs), k), np.array(pairs, np.uint64)) | _DEALT)
                    rest = np.concatenate(rest)
                keys.append(rest)
                sids.append(np.full(len(rest), s, np.uint64))
            if keys:
                k, s = np.concatenate(keys), np.concatenate(sids)
                order, bounds = common.by_bucket(k, buckets)
                k, s = k[order], s[order]
                full = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
                columns = [pa.array(full, pa.int32()), *[pa.array([x[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary()) for x in (k, s)]]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "sids"])

    return docs.mapInArrow(run, "bucket int, keys binary, sids binary")


def _blocks(sids: np.ndarray, most: int):
    """The sets as they are if they are at most `most`, else the union of each two blocks of them."""
    if len(sids) <= most:
        yield sids
        return
    many = -(-2 * len(sids) // most)
    block = common.finish(sids ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(many)
    own = [sids[block == i] for i in range(many)]
    for i in range(many):
        for j in range(i):
            yield np.sort(np.concatenate([own[i], own[j]]))


def _gathered(rows: list[np.ndarray]) -> pa.RecordBatch:
    gid = [int((common.finish(x).sum(dtype=np.uint64) + np.uint64(len(x))).view(np.int64)) for x in rows]
    check = [int(common.finish(~x).sum(dtype=np.uint64).view(np.int64)) for x in rows]
    return pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(check, pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], ["gid", "check", "sids"])


def _groups(batches, most: int, least: int):
    """Sets that share a shingle, without gaps in size that no link spans, in blocks: rows (gid, check, sids).

    The same collection of sets has the same gid and check; it comes once from a task.
    """
    keys, sids = [], []
    for batch in batches:
        keys += [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        sids += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
    if not keys:
        return
    k, s = np.concatenate(keys), np.concatenate(sids)
    del keys, sids
    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
    k, s = k[new], s[new]
    size = (s >> np.uint64(53)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (np.diff(size) > APART)))
    sizes = np.diff(np.append(starts, len(k)))
    with np.errstate(over="ignore"):
        mixed = common.finish(s)
        gid = np.add.reduceat(mixed, starts) + sizes.astype(np.uint64)
        check = np.add.reduceat(common.finish(~s), starts)
    starts, sizes, gid, check = starts[sizes > 1], sizes[sizes > 1], gid[sizes > 1], check[sizes > 1]
    _, first = np.unique(np.stack([gid, check], axis=1), axis=0, return_index=True)
    out, held = [], 0
    for i in first.tolist():
        whole = s[starts[i] : starts[i] + sizes[i]]
        for part in _blocks(whole, most if k[starts[i]] & _DEALT else tree_sets(len(whole), most, least)):
            out.append(part)
            held += len(part)
            if len(out) >= 5000 or held >= 1_000_000:
                yield _gathered(out)
                out, held = [], 0
    if out:
        yield _gathered(out)


def _members(batches):
    for batch in batches:
        gids = batch.column(0).to_numpy()
        for i, x in enumerate(batch.column(2).to_pylist()):
            sids = np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sids), gids[i])), pa.array(sids)], ["gid", "sid"])


def _runs(batches, keys: int):
    """Rows with equal first columns (sorted, in any batches) as lists of columns."""
    held, last = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last:
                if held:
                    yield held
                held, last = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield held


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    """Rows of the pairs' numbers; sets told by number and check give four."""
    rows = [p if isinstance(p[0], int) else (*p[0], *p[1]) for p in pairs]
    names = ["a", "b"] if not rows or len(rows[0]) == 2 else ["a", "a2", "b", "b2"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)


def _possible(batches):
    """Traverse each group's tree by bitmaps alone: rows (sid, sid of its representative)."""
    out = []
    for rows in _runs(batches, 1):
        if len(rows) > 1:
            sids = [r[0] for r in rows]
            forest = signature_tree.Forest(np.array([r[1] for r in rows]), [r[2] for r in rows], PERCENT, None)
            out += [(sids[i], sids[r]) for i, r in forest.join()]
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def _verified(batches):
    """Traverse each component's tree and compare whole sets: rows (sid and uid of a set, and of its representative)."""
    out = []
    for rows in _runs(batches, 2):
        found = {(sid, uid): np.frombuffer(data, np.uint64) for sid, uid, data in rows}
        if len(found) > 1:
            sids, sets = list(found), list(found.values())

            def similar(i: int, j: int, sets=sets) -> bool:
                a, b = sets[i], sets[j]
                both = np.concatenate([a, b])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                return 100 * inter >= PERCENT * (len(a) + len(b) - inter)

            forest = signature_tree.Forest(np.array([len(u) for u in sets]), [signature_tree.bitmap(u) for u in sets], PERCENT, similar)
            out += [(sids[i], sids[r]) for i, r in forest.join()]
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text; other columns are ignored), and key, root.

    key tells the texts of one doc_id apart: it is text_key() of the text. root is the same for all rows of a component and no others;
    it is null where there is no component. Documents link when 100 * intersection >= PERCENT * union of their shingle sets. Texts without words (null, empty)
    have 0 shingles and are linked with nothing; rows with a null doc_id have a null component and link nothing; repeated
    rows and equal texts are in one component. component_id is the smallest doc_id reachable.
    """
    buckets = common.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("key"))
    profiles, _ = common.materialize(spark, _profiles(docs), "profiles")
    rows = profiles.where(F.col("sid").isNotNull())
    often = frequent(profiles, rows.count())
    sets = rows.where("n > 0 and doc_id is not null").groupBy("sid", "uid").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.max("bits").alias("bits"))

    most, tree = GROUP_SETS, GROUP_LEAST
    groups = _keys(docs, often, buckets).repartition(buckets, "bucket").select("keys", "sids").mapInArrow(lambda batches: _groups(batches, most, tree), "gid long, check long, sids binary")
    members = groups.dropDuplicates(["gid", "check"]).mapInArrow(_members, "gid long, sid long")
    trees = members.join(sets.select("sid", "n", "bits"), "sid").select("gid", "sid", "n", "bits").repartition(buckets, "gid").sortWithinPartitions("gid")
    near, near_used = graph.components(spark, trees.mapInArrow(_possible, "a long, b long"), "near")

    label = near.select(F.col("a").alias("sid"), F.col("b").alias("near")).unionByName(near.select(F.col("b").alias("sid"), F.col("b").alias("near")).distinct())
    again = sets.select("sid", "uid", "doc", "n").join(label, "sid")
    weight = again.groupBy("near").agg(F.sum("n").alias("w"))
    blocks = F.when(F.col("w") > GROUP_SHINGLES, F.ceil(2 * F.col("w") / GROUP_SHINGLES)).otherwise(1)
    again, again_used = common.materialize(spark, again.join(weight, "near").select("doc", "sid", "uid", "near", blocks.cast("int").alias("blocks")), "again")
    look = F.broadcast(again) if again.count() <= BROADCAST_DOCS else again

    def whole(batches):
        for batch in batches:
            rows = []
            for text, sid, uid, near, blocks in zip(common.texts(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                u = shingle_set(text)
                if set_id(u) == sid and set_check(u) == uid:
                    b = sid % blocks
                    rows += [(near, min(b, j) * blocks + max(b, j), sid, uid, u.tobytes()) for j in range(blocks)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], ["near", "pair", "sid", "uid", "data"])

    found = docs.join(look, docs["doc_id"] == look["doc"]).select("text", "sid", "uid", "near", "blocks").mapInArrow(whole, "near long, pair long, sid long, uid long, data binary")
    # repeated rows give a set more than once; one is left before the sets of a component meet
    found = found.dropDuplicates(["near", "pair", "sid", "uid"])
    exact = found.repartition(buckets, "near", "pair").sortWithinPartitions("near", "pair").mapInArrow(_verified, "a long, a2 long, b long, b2 long")
    links, _ = graph.components(spark, exact.select(F.struct(F.col("a").alias("sid"), F.col("a2").alias("uid")).alias("a"), F.struct(F.col("b").alias("sid"), F.col("b2").alias("uid")).alias("b")), "links")
    for path in (near_used, again_used):
        common.remove(spark, path)

    own = F.struct("sid", "uid")
    linked = links.select(F.col("a.sid").alias("sid"), F.col("a.uid").alias("uid"), F.col("b").alias("root"))
    rooted = sets.select("sid", "uid", "doc").join(linked, ["sid", "uid"], "left").select("sid", "uid", "doc", F.coalesce("root", own).alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("sid", "uid", "component_id", "root")
    # sets of very many copies are few, so their list is short; their rows are spread over SALTS keys
    copied = [r["sid"] for r in rows.where("n > 0").groupBy("sid").agg(F.count("*").alias("c")).where(F.col("c") >= COPIES).collect()]
    given = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), "sid", "uid")
    if copied:
        many = F.col("sid").isin(copied)
        given = given.withColumn("salt", F.when(many, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0))
        named = named.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        named = named.withColumn("salt", F.col("salt").cast("long"))
    out = given.join(named, [c for c in given.columns if c in named.columns], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", F.when(~alone, F.col("root")).alias("root"))


def text_key(text: Column) -> Column:
    """Tells the texts of one doc_id apart, by 64 bits."""
    return F.xxhash64(text.cast("string"))


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key): of each component the text with the smallest doc_id, and of that one's texts the one with the smallest key."""
    return classes(spark, docs).where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("kept")).select("kept.*")


def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
