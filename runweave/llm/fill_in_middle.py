"""Fill-in-the-middle transformation: two random cuts of a text between tokens, and its parts in another order.

Tokens are `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, matched left to right: each word with the space before it, and
the space at the end. A wavelet matrix over the classes of the bytes of a block of texts answers all questions about them: a rank
query counts the bytes of a class before a place. Ranks of the two classes of word ends combine into the token ends before a
place, ranks of the two classes of continuation bytes tell bytes from code points, and bisection on the ranks finds the place
where the k-th token ends, for all texts of a block at a time.

Texts are whole and of any length; a block is cut between texts, so memory is bounded by the longest text. A null text is the empty
one; a null doc_id is hashed as the empty text. Equal rows have equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are cut, and of those whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: Bytes of texts in a block, but for a longer text.
BLOCK = 4_000_000

#: Bits of a class: of white space, of the last byte of a run of white space or of other bytes, of a continuation byte.
SPACE, LAST, CONTINUED = 4, 2, 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def classes(block: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of a block of texts that begin at `starts`; no run goes on into the next text."""
    space = _IS_SPACE[block]
    last = np.ones(len(block), bool)
    last[:-1] = space[1:] != space[:-1]
    ends = starts[1:] - 1
    last[ends[ends >= 0]] = True
    return space * np.uint8(SPACE) + last * np.uint8(LAST) + ((block & 0xC0) == 0x80) * np.uint8(CONTINUED)


class Bits:
    """Bits with a count of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))


class WaveletMatrix:
    """Rank queries over symbols below 1 << bits, the highest bit first; each level has the zeros of the level above before its ones."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(bits - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(one), int(len(one) - one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol before each place."""
        low, high = np.zeros_like(at), at
        for bit, bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            low, high = (zeros + a, zeros + b) if symbol >> bit & 1 else (low - a, high - b)
        return high - low


class Boundaries:
    """Token ends and code points of a block of texts, by rank queries."""

    def __init__(self, block: np.ndarray, starts: np.ndarray):
        self.starts, self.ends = starts, np.append(starts[1:], len(block))
        symbols = classes(block, starts)
        full = self.ends > starts
        self.tail = np.zeros(len(starts), np.int64)  # the white space at the end is a token
        self.tail[full] = symbols[self.ends[full] - 1] >= SPACE
        self.matrix = WaveletMatrix(symbols)

    def word_ends(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(LAST, at) + self.matrix.rank(LAST | CONTINUED, at)

    def code_points(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points between two places."""
        more = sum(self.matrix.rank(c, b) - self.matrix.rank(c, a) for c in (CONTINUED, LAST | CONTINUED))
        return b - a - more

    def tokens(self) -> np.ndarray:
        """Tokens of each text."""
        return self.word_ends(self.ends) - self.word_ends(self.starts) + self.tail

    def after(self, k: np.ndarray) -> np.ndarray:
        """The place where the k-th token of each text ends; its start for k = 0."""
        ended = self.word_ends(self.starts)
        words = self.word_ends(self.ends) - ended
        low, high = self.starts.copy(), self.ends.copy()  # bisect for the least place with k words ended before it
        want = ended + np.minimum(k, words)
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.word_ends(middle) >= want
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(k > words, self.ends, low)


def draws(key: str, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 that the seed and a document's id give."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


_OUT = "n long, form string, prefix_chars long, middle_chars long, output binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, a = 0, 0
        lengths = [len(t or b"") for t in common.texts(batch.column("text"))]
        for i, n in enumerate(lengths):
            if size and size + n > BLOCK:
                yield batch.slice(a, i - a)
                size, a = 0, i
            size += n
        yield batch.slice(a)


def _transformed(batches: Iterator[pa.RecordBatch], seed: int, rate: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        if not len(batch):
            continue
        found = [t or b"" for t in common.texts(batch.column("text"))]
        starts = np.append(0, np.cumsum([len(t) for t in found]))[:-1].astype(np.int64)
        bounds = Boundaries(np.frombuffer(b"".join(found), np.uint8), starts)
        n = bounds.tokens()
        h = np.array([draws("" if i is None else str(i), seed) for i in batch.column("doc_id").to_pylist()], np.int64)
        k = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
        first, second = bounds.after(k[:, 0]), bounds.after(k[:, 1])
        prefix, middle = bounds.code_points(starts, first), bounds.code_points(first, second)
        rows = []
        for i, t in enumerate(found):
            if not t or PREFIX in t or SUFFIX in t or MIDDLE in t or h[i, 2] % 100 >= rate:
                rows.append((int(n[i]), "plain", None, None, t))
                continue
            a, b = first[i] - starts[i], second[i] - starts[i]
            p, m, s = t[:a], t[a:b], t[b:]
            spm = h[i, 3] % 100 < suffix_first
            out = SUFFIX + s + PREFIX + p + MIDDLE + m if spm else PREFIX + p + SUFFIX + s + MIDDLE + m
            rows.append((int(n[i]), "spm" if spm else "psm", int(prefix[i]), int(middle[i]), out))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("own"), *columns], ["own", *(c.split()[0] for c in _OUT.split(", "))])


def transform(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """For each row of docs (doc_id, text, ...): own (a struct of the columns to keep), n (tokens), form, prefix_chars, middle_chars, output.

    form is plain where the text stays as it is: if it is empty, holds a sentinel, or by lot (100 - rate percent). Else psm or spm, and
    the code points of prefix and middle are given. Columns to keep may have any names.
    """
    rows = docs.select(F.struct(*keep).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = rows.schema["own"].dataType.simpleString()
    out = rows.mapInArrow(lambda batches: _transformed(batches, seed, rate, suffix_first), f"own {own}, {_OUT}")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text that transform() made an output of that form from."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def rest(text: Column, part: Column | None, sentinel: str) -> Column:
        """What follows a part and the sentinel behind it."""
        taken = F.length(part) if part is not None else F.lit(0)
        return F.substring(text, taken + len(sentinel) + 1, F.length(text))

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """The parts after the first sentinel, after the second, and after the middle's."""
        body = rest(output, None, first)
        a = F.substring_index(body, second, 1)
        body = rest(body, a, second)
        b = F.substring_index(body, m, 1)
        return a, b, rest(body, b, m)

    prefix, suffix, middle = between(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("own.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Another route: tokens as lists from the pattern, parts joined from them.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents
), drawn AS (
  SELECT *, len(w) AS n, [CAST(concat('0x', substr(h, 8 * i + 1, 8)) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM docs
), cut AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m, coalesce(array_to_string(w[b + 1:n], ''), '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
