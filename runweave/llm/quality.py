"""Quality rules: word and repetition statistics, and how well public tokenizers know a text.

A text that a vocabulary knows costs few tokens. Each measure has a band per language or script: characters per
token, and entropy and least entropy (of the commonest token) of the token distribution, in bits, under a byte-level
BPE for many languages; the share of byte-fallback tokens under a piece BPE. A text outside a band is rejected.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (least and most characters per token, least entropy in bits, most byte-fallback share, least bits of the commonest token)
#: by language or script.
#: Short texts vary more: the least characters per token are lowered by SLACK / sqrt(words), or less where they are under LOW. What fit_bands() takes off, or adds.
SLACK, LOW, MARGIN, TAIL = 1.0, 1.6, 0.3, 0.001
#: Those of languages are rounded down from fit_bands() on the labelled documents of even number at sf0.1. Those of scripts are for
#: languages without labels: their least characters per token lie between a public paragraph in the script and random letters
#: of its alphabet (both in the tests), but for Han, whose random characters cost hardly more than a text. `latin` is the widest of the languages, `other` takes all further scripts.
BANDS = {
    "en": (1.8, 9.0, 5.2, 0.10, 3.1),
    "de": (1.9, 9.0, 5.5, 0.10, 3.1),
    "fr": (1.6, 9.0, 5.3, 0.10, 3.1),
    "es": (1.7, 9.0, 5.4, 0.10, 3.1),
    "latin": (1.6, 9.0, 5.2, 0.15, 3.1),
    "cyrillic": (1.9, 9.0, 4.5, 0.30, 2.5),
    "greek": (1.3, 9.0, 4.5, 0.30, 2.5),
    "hebrew": (1.3, 9.0, 4.5, 0.30, 2.5),
    "arabic": (1.3, 9.0, 4.5, 0.30, 2.5),
    "devanagari": (0.70, 9.0, 4.0, 0.30, 2.2),
    "thai": (0.94, 9.0, 4.0, 0.30, 2.5),
    "han": (0.60, 6.0, 4.5, 0.30, 2.5),
    "kana": (0.96, 6.0, 4.5, 0.30, 2.5),
    "hangul": (0.96, 6.0, 4.5, 0.30, 2.5),
    "other": (0.40, 9.0, 4.5, 0.95, 2.5),
}
#: Code points of scripts, first and last of each range (fixed values of Unicode's blocks).
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F),
    ("thai", 0xE00, 0xE7F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x3FFFF),
)
#: Share of kana from which a text of kana and Han characters is Japanese.
KANA = 0.1
#: Words whose tokens a worker remembers; beyond it the memory starts afresh.
CACHE_WORDS = 400_000
_SPACE, _SYMBOLS, _INNER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, token_entropy double, fallback_share double, min_entropy double, script string"
_coders: dict[tuple[str, str], "WordTokens"] = {}


class WordTokens:
    """Tokens of words, each taken with a space before it as in running text; a distinct word is encoded once in a worker."""

    def __init__(self, ranks_path: str, pieces_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = [self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())]
        self.ids: dict[bytes, bytes] = {}
        self.fallback: dict[bytes, int] = {}  # piece tokens + 2**32 * those that are bytes

    def learn(self, words: set[bytes]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
            self.fallback.clear()
        new = list(words.difference(self.ids))
        texts = [w.decode() for w in new]
        byte = self.is_byte.__getitem__
        for w, t, p in zip(new, texts, self.pieces.encode(texts, num_threads=1), strict=True):
            self.ids[w] = np.array(self.ranked(" " + t), np.uint32).tobytes()
            self.fallback[w] = len(p) + (sum(map(byte, p)) << 32)

    def measure(self, words: list[bytes], chars: int) -> tuple[float | None, float | None, float | None, float | None]:
        """Characters per token, entropy of the tokens, share of byte tokens, bits of the commonest token; None without words."""
        if not words:
            return None, None, None, None
        ids = np.sort(np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.uint32))
        p = np.diff(np.append(common.segments(ids), len(ids))) / len(ids)
        both = sum(map(self.fallback.__getitem__, words))
        return chars / len(ids), float(-(p * np.log2(p)).sum()), (both >> 32) / max(1, both & 0xFFFFFFFF), float(-np.log2(p.max()))


_NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
_BORDERS = np.array([b for _, first, last in SCRIPTS for b in (first, last + 1)])
_BETWEEN = np.array([0, *(i for s, _, _ in SCRIPTS for i in (_NAMES.index(s), 0))])


def script_of(text: bytes, points: int) -> str:
    """The script that most of a text's `points` code points are in; `other` if none is known, `latin` if it takes few bytes."""
    if len(text) < 1.4 * points:
        return "latin"
    codes = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    many = np.bincount(_BETWEEN[np.searchsorted(_BORDERS, codes, "right")], minlength=len(_NAMES))
    many[0] = 0
    found = _NAMES[int(many.argmax())]
    kana, han = (int(many[_NAMES.index(s)]) for s in ("kana", "han"))
    return "kana" if found == "han" and kana >= KANA * (kana + han) else found


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = common.shingles(h, 3)
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.isin(g, twice)
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + len(at)] |= at
    return int(covered.sum())


def statistics(docs: DataFrame, ranks_path: str, pieces_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs named in `keep` with a row's counts and measures, and its language as `band`.

    Null or empty texts have no words and null measures; repeated rows each give a row; other columns are dropped.
    """
    own = [c for c in keep if c != "text"]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    given = docs.select(F.col("text").cast("string"), F.struct(lang.alias("_band"), *own).alias("own"))
    schema = _SCHEMA + ", own " + given.schema["own"].dataType.simpleString() + (", text string" if "text" in keep else "")
    names = [*re.findall(r"(\w+) \w+", _SCHEMA), "own", *["text"] * ("text" in keep)]
    kinds = (*[pa.int64()] * 5, *[pa.float64()] * 4, pa.string())

    def run(batches):
        key = (ranks_path, pieces_path)
        coder = _coders.get(key) or _coders.setdefault(key, WordTokens(*key))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or b"" for t in common.texts(part.column(0))]
                lists = [t.split() for t in texts]
                coder.learn(set().union(*lists))
                rows = []
                for t, ws in zip(texts, lists, strict=True):
                    points = len(t.translate(None, _INNER))
                    chars = points - (len(t) - len(t.translate(None, _SPACE)))
                    lines = t.split(b"\n")
                    dup = 0
                    if len(set(lines)) < len(lines):
                        lines = [x for x in lines if x.strip()]
                        dup = len(lines) - len(set(lines))
                    rows.append((len(ws), chars, len(t) - len(t.translate(None, _SYMBOLS)), dup, repeated_words(ws), *coder.measure(ws, chars), script_of(t, points)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, part.column(1), *[part.column(0)] * ("text" in keep)], names)

    out = given.mapInArrow(run, schema)
    texts = ["text"] * ("text" in keep)
    return out.select(*[F.col("own")[c].alias(c) for c in own], *texts, *names[:10], F.col("own")["_band"].alias("band"))


def fit_bands(stats: DataFrame, good: str = "quality", most_chars: float = 9.0) -> dict[str, tuple[float, ...]]:
    """Bands by language from rows with statistics and a column that is 1 for good texts: one row a language is collected.

    Of the good rows that pass the base rules, the TAIL quantile of each measure, MARGIN beyond. Only good rows count, so that
    a band does not creep up to the bad ones; labels are the only input besides the measures.
    """
    rows = verdicts(stats).where((F.col(good) == 1) & ~F.col("base_failed") & F.col("band").isNotNull())
    q = lambda c, p: F.percentile_approx(c, F.lit(p), 10_000)
    chars = F.col("chars_per_token") + SLACK / F.sqrt(F.greatest("n_words", F.lit(1)))
    found = rows.groupBy("band").agg(q(chars, TAIL).alias("c"), q("token_entropy", TAIL).alias("t"), q("fallback_share", 1 - TAIL).alias("f"), q("min_entropy", TAIL).alias("m")).collect()
    return {r["band"]: (r["c"] - MARGIN, most_chars, r["t"] - MARGIN, min(1.0, r["f"] + MARGIN / 3), r["m"] - MARGIN) for r in found}


def verdicts(stats: DataFrame, bands: dict = BANDS) -> DataFrame:
    """base_failed and kept from the statistics and a `band` column; unknown bands are those of the script."""
    of = F.coalesce(*[F.when(F.col("band") == k, F.lit(k)) for k in bands], F.col("script"))

    def limit(i: int):
        return F.coalesce(*[F.when(of == k, F.lit(float(v[i]))) for k, v in bands.items()])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = (F.col("chars_per_token") >= limit(0) - SLACK * F.least(F.lit(1.0), limit(0) / LOW) / F.sqrt(F.greatest("n_words", F.lit(1)))) & (F.col("chars_per_token") <= limit(1)) & (F.col("token_entropy") >= limit(2)) & (F.col("fallback_share") <= limit(3)) & (F.col("min_entropy") >= limit(4))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(inside, F.lit(False)))


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def assess(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), bands: dict = BANDS) -> DataFrame:
    """The columns of docs in `keep`, the statistics and the verdicts under the default vocabularies."""
    return verdicts(statistics(docs, *paths(), keep), bands)


def op1_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "token_entropy", "fallback_share", "min_entropy")
