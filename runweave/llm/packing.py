"""Best-fit packing of tokenised documents into fixed-size training sequences.

`pieces` tokenises whole texts and cuts only what is longer than a sequence. `pack` gives every piece a
sequence and a place in it. Pieces of one length are interchangeable, so the placing is decided on the
histogram of lengths, which has at most `size` rows however large the corpus is: lengths descend, and each
goes to the open bins whose residual tokens, document slots and attention cost fit best (vector best-fit
decreasing over classes of equal bins). A distributed rank within each length then maps pieces to places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words whose ids a worker remembers; beyond it the memory starts afresh.
CACHE_WORDS = 600_000
_PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Stands between words that are encoded in one call; words that hold it are encoded alone.
_MARK = "~"
#: A word of lower-case letters up to U+024F and ASCII signs behind, none of them an apostrophe: a run of letters and one of signs.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u024f]+)([!-&(-/:;=-@\[-`{-}]*)").fullmatch
#: What a tokenizer does before its model, if runs of letters are the model's own units.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RUNS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of white-space separated words, as little-endian 32-bit bytes, by a tokenizer that drops white space.

    Such a tokenizer's ids of a text are those of its words one after the other, so each distinct word is
    encoded once in a worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.mark = self.encode([_MARK], add_special_tokens=False)[0].ids
        self.letters = self._letters(tokenizer) if len(self.mark) == 1 else None
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _letters(tokenizer):
        """Encoding of runs of letters in normal form by the model alone, where the tokenizer splits runs of letters from signs; else None."""
        import json

        from tokenizers import Tokenizer

        spec = json.loads(tokenizer.to_str())
        if spec["normalizer"] != _NORMAL or spec["pre_tokenizer"] != _RUNS or spec["post_processor"] is not None:
            return None
        spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(spec)).encode_batch_fast

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [w.decode() for w in words.difference(self.known)]
        if self.letters is None:
            return self._learn(new)
        runs, signs, both, others = set(), set(), [], []
        for w in new:
            m = _PLAIN(w)
            if m is None or not (m[1].isascii() or m[1] == m[1].lower()):
                others.append(w)
            else:
                runs.add(m[1])
                if m[2]:
                    signs.add(m[2])
                    both.append((w, m[1], m[2]))
        self._learn([*others, *(s for s in signs.difference(others) if s.encode() not in self.known)])
        self._learn_joined([w for w in runs if w.encode() not in self.known], self.letters)
        for w, run, sign in both:
            self.known[w.encode()] = self.known[run.encode()] + self.known[sign.encode()]

    def _learn(self, new: list[str]) -> None:
        alone = [w for w in new if _MARK in w or "<|" in w or len(self.mark) != 1]
        joined = [w for w in new if not (_MARK in w or "<|" in w or len(self.mark) != 1)]
        for w, e in zip(alone, self.encode(alone, add_special_tokens=False), strict=True):
            self.known[w.encode()] = np.array(e.ids, "<u4").tobytes()
        self._learn_joined(joined, self.encode)

    def _learn_joined(self, joined: list[str], encode) -> None:
        for i in range(0, len(joined), 256):
            some = joined[i : i + 256]
            ids = np.array(encode([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            start, data = 0, ids.tobytes()
            for w, end in zip(some, ends.tolist(), strict=True):
                self.known[w.encode()] = data[4 * start : 4 * end]
                start = end + 1

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def _words(text: bytes | None) -> list[bytes]:
    if not text:
        return []
    return text.split() if b"<|" in text else text.lower().split()


def pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Token ids of every text with end_id behind, cut into pieces of `size` where longer.

    Returns doc_id, piece, start, length, ids (little-endian unsigned 32-bit). A null or empty text is the
    end id alone; repeated rows each give their own pieces; other columns are ignored.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        coder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, WordEncoder(vocabulary))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), common.texts(batch.column(1))
            for at in range(0, len(ids), 500):
                lists = [_words(t) for t in texts[at : at + 500]]
                coder.learn(set().union(*lists))
                out = [[], [], [], [], []]
                for doc, ws in zip(ids[at : at + 500], lists, strict=True):
                    data = coder.ids(ws) + end
                    for k, start in enumerate(range(0, len(data), 4 * size)):
                        part = data[start : start + 4 * size]
                        for o, v in zip(out, (doc, k, start // 4, len(part) // 4, part), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def plan(counts: dict[int, int], capacity: tuple[int, int, int], weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> np.ndarray:
    """Vector best-fit decreasing over a histogram of lengths.

    capacity: tokens, documents and attention cost (sum of squared lengths) of a sequence. A bin qualifies if
    the piece fits in all three; rule "norm" takes the bin with the least weighted norm of what would be left,
    "dot" the one with the greatest weighted dot product of demand and residual. Equal bins form a class, so the
    work depends on the number of lengths, not of pieces. Returns rows (length, first rank, count, first bin,
    offset): the pieces of these ranks go to consecutive bins, each at the offset.
    """
    cap = np.array(capacity, float)
    w = np.array(weights, float)
    rows: list[tuple[int, int, int, int, int]] = []
    res = np.zeros((64, 3), np.int64)  # residual capacities of each class
    first, many, used = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64)
    n_class = n_bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = int(counts[length]), 0
        need = np.array([length, 1, length * length], np.int64)
        if left and (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity {capacity}")
        while left:
            fits = np.flatnonzero((many[:n_class] > 0) & (res[:n_class] >= need).all(axis=1))
            if len(fits):
                rest = res[fits] / cap
                if rule == "norm":
                    c = fits[np.argmin((w * (rest - need / cap) ** 2).sum(axis=1))]
                else:
                    c = fits[np.argmax((w * rest * (need / cap)).sum(axis=1))]
            else:
                if n_class == len(res):
                    res = np.concatenate([res, np.zeros_like(res)])
                    first, many, used = (np.concatenate([x, np.zeros_like(x)]) for x in (first, many, used))
                c, n_class = n_class, n_class + 1
                each = int((cap // need).min())
                res[c], first[c], many[c], used[c] = cap, n_bins, -(-left // each), 0
                n_bins += int(many[c])
            each = int((res[c] // need).min())
            bins = min(int(many[c]), left // each)
            if not bins:
                bins, each = 1, left
            for j in range(each):
                rows.append((length, rank, bins, int(first[c]), int(used[c]) + j * length))
                rank += bins
            left -= bins * each
            if bins < many[c]:  # the class splits: these bins leave it
                if n_class == len(res):
                    res = np.concatenate([res, np.zeros_like(res)])
                    first, many, used = (np.concatenate([x, np.zeros_like(x)]) for x in (first, many, used))
                res[n_class], first[n_class], many[n_class], used[n_class] = res[c], first[c] + bins, many[c] - bins, used[c]
                n_class += 1
            many[c] = bins
            res[c] -= need * each
            used[c] += length * each
        if n_class > 4096:  # forget classes that nothing fits into any more
            live = np.flatnonzero((many[:n_class] > 0) & (res[:n_class, 0] > 0))
            res[: len(live)], first[: len(live)], many[: len(live)], used[: len(live)] = res[live], first[live], many[live], used[live]
            n_class = len(live)
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(spark: SparkSession, parts: DataFrame, size: int = 4096, max_docs: int | None = None, max_attention: int | None = None, weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> DataFrame:
    """Give each piece (columns doc_id, piece, length and any others) a sequence_id and an offset in it.

    max_docs and max_attention bound the pieces and the sum of squared lengths in a sequence; None sets the
    bounds that `size` implies. An empty input gives an empty result; columns may have any names, and those called
    sequence_id and offset are replaced. Rows are dealt by their place, so repeated ids or rows share the work too.
    """
    capacity = (size, max_docs or size, max_attention or size * size)
    n = common.partitions(spark)
    cols = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    # the place is written with the rows, so later reads agree on it
    dealt, _ = common.materialize(spark, parts.select(F.struct(*cols).alias("own"), F.col("length").cast("long").alias("length"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("_part")), "pieces")
    sizes = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part")
    starts = sizes.select("length", "_part", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    steps = plan({r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}, capacity, weights, rule)
    keys = steps[:, 0] * (1 << 40) + steps[:, 1]
    order = np.argsort(keys, kind="stable")
    told = spark.sparkContext.broadcast((keys[order], steps[order]))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("own")))
    ranked = ranked.join(starts, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)

    def place(batches):
        keys, steps = told.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 40) + rank, "right") - 1
            s = steps[at]
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])], ["own", "sequence_id", "offset"])

    schema = ranked.select("own").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select("own", "length", "_rank").mapInArrow(place, schema).select("own.*", "sequence_id", "offset")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The packing of the documents with a checksum of each piece's ids in place of the ids."""
    parts = pieces(docs, vocabulary_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(spark, parts)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark, common.table(spark, sf_dir, "documents"))
