"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, the first
rotated twice, the second once (binding keeps order); a text is the sum of its trigrams' vectors (bundling); a
language is the sum over its training texts. A text takes the language with the greatest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1024
#: Symbols: 0 for what is not a letter, 1-26 for a-z, 27-91 for Latin letters beyond, 92-127 shared by other letters.
SYMBOLS = 128
SEED = 20240229
#: Trigrams whose vectors a worker keeps as one matrix; those beyond are bound when they occur.
TABLE_ROWS = 12_288
_state: dict[str, object] = {}


def _symbol(cp: int) -> int:
    ch = chr(cp)
    if not ch.isalpha():
        return 0
    if "a" <= ch <= "z":
        return cp - 96
    return 27 + (cp - 0xDF) % 65 if 0xDF <= cp < 0x250 else 92 + cp % 36


def _symbols() -> np.ndarray:
    if "symbols" not in _state:
        _state["symbols"] = np.array([_symbol(c) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x10000)], np.int32)
    return _state["symbols"]


def letters() -> np.ndarray:
    """The letters' random vectors."""
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS), np.int8) * 2 - 1


def bind(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes (a * SYMBOLS + b) * SYMBOLS + c."""
    if "letters" not in _state:
        L = letters()
        _state["letters"] = (np.roll(L, 2, axis=1), np.roll(L, 1, axis=1), L)
    A, B, C = _state["letters"]
    return (A[codes // (SYMBOLS * SYMBOLS)] * B[codes // SYMBOLS % SYMBOLS] * C[codes % SYMBOLS]).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts, the text of each, and whether each text has a letter.

    Texts are lower-cased; a run of other characters counts as one boundary; a trigram has a letter in its middle.
    """
    joined = " " + " ".join(texts).lower() + " "
    sizes = np.array([len(t.lower()) for t in texts], np.int64) + 1
    sizes[0] += 1
    cps = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    sizes[-1] += len(cps) - sizes.sum()
    s = _symbols()[np.minimum(cps, 0xFFFF)]
    for i in np.flatnonzero(cps > 0xFFFF).tolist():
        s[i] = _symbol(int(cps[i]))
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s, doc = s[keep], doc[keep]
    has = np.bincount(doc, s > 0, len(texts)) > 0
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    good = s[1:-1] > 0
    return codes[good], doc[1:-1][good], has


def _rows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the codes in the worker's matrix, which grows to TABLE_ROWS; -1 for those beyond. And the matrix."""
    if "rows" not in _state:
        _state["rows"], _state["matrix"] = np.full(SYMBOLS**3, -1, np.int32), np.zeros((0, DIMENSIONS), np.float32)
    rows, matrix = _state["rows"], _state["matrix"]
    at = rows[codes]
    if (at < 0).any() and len(matrix) < TABLE_ROWS:
        new = np.unique(codes[at < 0])[: TABLE_ROWS - len(matrix)]
        rows[new] = np.arange(len(matrix), len(matrix) + len(new))
        _state["matrix"] = matrix = np.concatenate([matrix, bind(new)])
        at = rows[codes]
    return at, matrix


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the texts (rows) and whether each has a letter."""
    codes, doc, has = trigrams(texts)
    at, matrix = _rows(codes)
    n, width = len(texts), max(1, len(matrix))
    known = at >= 0
    counts = np.bincount(doc[known] * width + at[known], minlength=n * width).reshape(n, width).astype(np.float32)
    out = counts[:, : len(matrix)] @ matrix
    if not known.all():
        for d in np.unique(doc[~known]).tolist():
            some, many = np.unique(codes[~known & (doc == d)], return_counts=True)
            for i in range(0, len(some), 4096):
                out[d] += many[i : i + 4096].astype(np.float32) @ bind(some[i : i + 4096])
    return out, has


def train(docs: DataFrame, label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Labels in order, and their prototypes; every row with text and label counts. Bounded by the labels' number.

    Each task adds up its texts' vectors by label (integers, so any order gives the same sum); Spark adds the tasks'.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for name in set(names):
                own = [t for t, x in zip(texts, names, strict=True) if x == name]
                for i in range(0, len(own), 200):
                    codes, _, _ = trigrams(own[i : i + 200])
                    some, many = np.unique(codes, return_counts=True)
                    total = sums.setdefault(name, np.zeros(DIMENSIONS, np.int64))
                    at, matrix = _rows(some)
                    total += np.rint(many[at >= 0].astype(np.float64) @ matrix[at[at >= 0]]).astype(np.int64)
                    if (at < 0).any():
                        total += np.rint(many[at < 0].astype(np.float64) @ bind(some[at < 0])).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["label", "v"])

    sums = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select(F.col("text").cast("string"), F.col(label).cast("string")).mapInArrow(run, "label string, v array<bigint>")
    rows = sums.select("label", F.posexplode("v")).groupBy("label", "pos").agg(F.sum("col").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("v")).collect()
    rows = sorted((r["label"], [x["v"] for x in r["v"]]) for r in rows)
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(-1, DIMENSIONS)


def identify(spark: SparkSession, docs: DataFrame, labels: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs with lang_pred and score (cosine, 0 if negative). `und`, 0 for null texts, texts without a letter or no labels.

    Ties take the first label in order; every row gives one row; columns besides doc_id and held_out are dropped.
    """
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    told = spark.sparkContext.broadcast((labels, (prototypes / np.where(norms > 0, norms, 1)).astype(np.float32).T))

    def run(batches):
        labels, P = told.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            preds, scores = [], []
            for i in range(0, len(texts), 64):
                v, has = bundle([t or "" for t in texts[i : i + 64]])
                if not labels:
                    preds += ["und"] * len(v)
                    scores += [0.0] * len(v)
                    continue
                cos = (v @ P) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(axis=1)
                preds += [labels[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                scores += np.where(has, np.clip(cos[np.arange(len(v)), best], 0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.checksum_mod("doc_id", 3) == 1)
    labels, prototypes = train(docs.where(~F.col("held_out")))
    return identify(spark, docs, labels, prototypes)
