"""Training-data operators against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import common, contamination, fixity, graph, jaccard_join, language, language_model, licenses, packing, pii, quality, sharding, signature_tree

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


LONG = prose(9000, 99)
ODD = [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "one two three"), (105, LONG), (106, LONG + " end"), (None, "no number here at all my friend"), (107, prose(80, 1)), (107, prose(80, 1)), (108, "x" * 30_000), (109, "1" * 30_000), (110, "ünïcödé — text ☃ 漢字 𝔘nicode")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(ODD)
    for i in range(60):
        t = prose(60 + 7 * i, i // 3)
        if i % 3:
            w = t.split()
            w[5 * (i % 3)] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    # columns that the operators use inside, under names that clash
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "sid", "h", "kind", "own", "slot", "lang", "piece", "score", "item_id", "shard")}).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# Quality rules


def test_quality_counts(docs, empty):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.assess(docs).collect())
    want = collections.Counter()
    for i, t in texts(docs):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want[i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    assert got == want
    assert quality.assess(empty).count() == 0


def test_quality_repeats_and_lines():
    assert quality.repeated_words("a b c x a b c".encode().split()) == 6
    assert quality.repeated_words(b"a a a a".split()) == 4
    assert quality.repeated_words(b"a b c".split()) == 0


def test_bands_from_labels_keep_and_reject_others(spark):
    """Bands of the labelled documents of even number, on those of odd number; the built-in bands on all."""
    folder = "/root/testdata/sf0.01"
    stats = quality.statistics(common.table(spark, folder, "documents"), *quality.paths(), ("doc_id",)).join(common.table(spark, folder, "labels"), "doc_id")
    fitted = quality.fit_bands(stats.where("doc_id % 2 = 0"))
    assert set(fitted) == {"en", "de", "fr", "es"}
    for bands, part in (({**quality.BANDS, **fitted}, "doc_id % 2 = 1"), (quality.BANDS, "true")):
        told = quality.verdicts(stats.where(part), bands).where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
        assert dict(told)[1] >= 0.98 and dict(told)[0] <= 0.05


def test_verdicts_equal_brute_force(spark, docs):
    rows = quality.assess(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")), ("doc_id",)).collect()
    for r in rows:
        low, high, entropy, share, least = quality.BANDS[r["band"] if r["band"] in quality.BANDS else r["script"]]
        inside = r["n_words"] > 0 and low - min(1, low / quality.LOW) / math.sqrt(r["n_words"]) <= r["chars_per_token"] <= high and r["token_entropy"] >= entropy and r["fallback_share"] <= share and r["min_entropy"] >= least
        assert r["kept"] == (not r["base_failed"] and inside)
    assert any(r["kept"] for r in rows) and not all(r["kept"] for r in rows)


def test_token_measures_match_whole_text_encoding():
    import base64

    import public_tokenizers
    import tiktoken

    coder = quality.WordTokens(*quality.paths())
    with open(quality.paths()[0], "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    t = prose(300, 4) + " naïve café 漢字"
    ws = t.encode().split()
    coder.learn(set(ws))
    cpt, entropy, share, least = coder.measure(ws, sum(len(w) for w in t.split()))
    ids = enc.encode_ordinary(" " + t)
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert cpt == sum(len(w) for w in t.split()) / len(ids) and math.isclose(entropy, -(p * np.log2(p)).sum())
    assert coder.measure([], 0) == (None, None, None, None) and 0 <= share < 1 and math.isclose(least, -math.log2(p.max()))


#: Of the Universal Declaration of Human Rights, a public text.
PARAGRAPHS = {
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια. Κανείς δεν επιτρέπεται να ζει υπό καθεστώς δουλείας.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם יש לו הזכות לחיים, לחירות ולביטחון אישי. לא יהיה אדם עבד או משועבד.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه. لا يجوز استرقاق أو استعباد أي شخص، ويحظر الاسترقاق وتجارة الرقيق بكافة أوضاعهما.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है।",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ คนทุกคนมีสิทธิในการดำรงชีวิต เสรีภาพ และความมั่นคงแห่งตัวตน",
    "han": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由,不分种族、肤色、性别、语言、宗教、政治或其他见解。人人有权享有生命、自由和人身安全。",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다.",
}


@pytest.mark.parametrize("script", PARAGRAPHS)
def test_bands_of_scripts(spark, script):
    """Copies of a paragraph pass; random letters of its alphabet (but for Han), or one letter, do not."""
    rng = random.Random(7)
    letters = sorted({c for c in PARAGRAPHS[script] if c.isalpha()})
    words = PARAGRAPHS[script].split()
    if script in ("thai", "han", "kana"):  # written without spaces
        whole = "".join(words)
        words = [whole[i : i + 12] for i in range(0, len(whole), 12)]
    words = (words * (50 // len(words) + 2))[: 2 * max(50, len(words))]
    other = [" ".join("".join(rng.choice(letters) for _ in w) for w in words), " ".join(letters[0] * len(w) for w in words)]
    given = spark.createDataFrame([(i, t, None) for i, t in enumerate([" ".join(words), *other])], "doc_id long, text string, lang string")
    stats = quality.statistics(given, *quality.paths(), ("doc_id",))
    assert stats.where("doc_id = 0").first()["script"] == script
    inside = quality.verdicts(stats.withColumn("n_repeat_words", F.lit(0)))
    assert [r["kept"] for r in inside.orderBy("doc_id").collect()] == [True, script == "han", False]


def test_script_of_a_text():
    of = lambda t: quality.script_of(t.encode(), len(t))
    assert [of(PARAGRAPHS[s]) for s in PARAGRAPHS] == list(PARAGRAPHS)
    assert of("") == "other" and of("plain words, naïve café") == "latin" and of("\u2603" * 9) == "other"
    assert of("漢字" * 20 + "の" * 3) == "han" and of("漢字" * 20 + "の" * 9) == "kana"
    assert of("漢字かな" + " plain words" * 5) == "latin" and of("\u0430" * 30 + "x" * 20) == "cyrillic"


# Fixity


def test_fixity(spark):
    rows = [(i, f"http://h/{i}", "body %d" % i) for i in range(2500)] + [(None, None, None), (None, "http://x", "y"), (7, "http://h/7", "body 7")]
    ours = spark.createDataFrame(rows, "page_id long, url string, html string")
    content = fixity.record(F.col("url"), F.col("html"))
    leaf = lambda d: fixity.leaves(d, "page_id", content)
    assert fixity.audit(spark, leaf(ours), leaf(ours)).count() == 0
    theirs = ours.where("page_id is null or page_id <> 1234").withColumn("html", F.when(F.col("page_id").isin(3, 2222), "bad").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(9999, "u", "h")], ours.schema))
    got = {(r["key"], r["status"]) for r in fixity.audit(spark, leaf(ours), leaf(theirs)).collect()}
    assert got == {(3, "corrupt"), (2222, "corrupt"), (1234, "missing"), (9999, "extra")}
    one_copy = ours.dropDuplicates()
    assert {(r["key"], r["status"]) for r in fixity.audit(spark, leaf(ours), leaf(one_copy)).collect()} == {(7, "corrupt")}
    assert fixity.audit(spark, leaf(ours.limit(0)), leaf(ours.limit(0))).count() == 0


def test_fixity_of_a_repeated_id(spark):
    rows = [(7, f"u{i}", f"page {i}") for i in range(300)]
    content = fixity.record(F.col("url"), F.col("html"))
    leaf = lambda r: fixity.leaves(spark.createDataFrame(r, "page_id long, url string, html string").repartition(5), "page_id", content)
    assert fixity.audit(spark, leaf(rows), leaf(rows[::-1])).count() == 0
    swapped = [(7, "u0", "page 1"), (7, "u1", "page 0"), *rows[2:]]
    for other in (rows[1:], rows + rows[:1], swapped):
        assert [(r["key"], r["status"]) for r in fixity.audit(spark, leaf(rows), leaf(other)).collect()] == [(7, "corrupt")]


def test_fixity_offsets_are_gapless(spark):
    d = spark.createDataFrame([(i, "u", "x" * (i % 50)) for i in range(1500)], "page_id long, url string, html string")
    level = fixity.tree(fixity.leaves(d, "page_id", fixity.record(F.col("url"), F.col("html"))))
    rows = sorted((r["file"], r["node"], r["start"], r["end"]) for r in level[0].collect())
    for a, b in zip(rows, rows[1:], strict=False):
        assert b[2] == (a[3] if a[0] == b[0] else 0)
    assert {(r["file"], r["start"]) for r in level[-1].collect()} == {(0, 0), (1, 0)}


# Language model


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    counts = rng.integers(1, 500, 5000)
    level = language_model.levels(counts)
    found = language_model.LogFilter([language_model.slice_of(keys, level, 1 << 20)]).lookup(keys)
    assert (found >= level).all() and (found == level).mean() > 0.8
    other = language_model.LogFilter([language_model.slice_of(keys, level, 1 << 20)]).lookup(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (other > 0).mean() < 0.15
    c = np.arange(1, 1000)
    assert (np.abs(np.log(language_model.counts_of(language_model.levels(c)) / c)) < 0.45).all() and language_model.counts_of(np.array([0]))[0] == 0


@pytest.mark.parametrize("heavy", [10**6, 4])
def test_language_model_base(spark, docs, monkeypatch, heavy):
    monkeypatch.setattr(language_model, "HEAVY_TOKENS", heavy)
    given = docs.withColumn("held_out", common.checksum_mod("doc_id", 7) == 2)
    built, model = language_model.train(spark, given.where(~F.col("held_out")), 3)
    rows = language_model.score(spark, given, built, model).collect()
    tokens = lambda t: [w.encode().lower() for w in words(t)] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    all_ = texts(docs)
    c = collections.Counter(w for i, t in all_ if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    key = lambda *x: (x[0] if x[0] is not None else -1, *x[1:-1], round(x[-1], 6))
    want = sorted(key(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in all_)
    assert sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_language_model_beats_unigrams_on_held_out_text(spark):
    rows = [(i, " ".join(WORDS[(i + k) % len(WORDS)] for k in range(200))) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 0)
    built, model = language_model.train(spark, d.where(~F.col("held_out")), 2)
    out = language_model.score(spark, d.where("held_out"), built, model).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_language_model_without_training_rows(spark, docs, empty):
    given = docs.withColumn("held_out", F.lit(True))
    built, model = language_model.train(spark, given.limit(0), 2)
    rows = language_model.score(spark, given, built, model).collect()
    assert len(rows) == docs.count() and all(r["n_known"] == 0 and r["base_score"] == 0 for r in rows)
    assert language_model.score(spark, given.limit(0), built, model).count() == 0


def test_filter_grows_with_the_ngrams(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FILTER_BYTES", 3 * 8 * 1000, raising=False)
    rows = [(i, " ".join(f"w{(i * 7919 + k * 31) % 5003}" for k in range(200)), i % 7 == 0) for i in range(1500)]
    given = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    built, model = language_model.train(spark, given.where("not held_out"), 3)
    count = collections.Counter((v, w) for _, t, held in rows if not held for v, w in zip(t.split(), t.split()[1:]))
    slices = {r["bucket"]: r for r in built.collect()}
    entries = int(language_model.levels(np.array(list(count.values()))).sum())
    assert 8 * sum(len(r["bits"]) for r in slices.values()) >= language_model.ENTRY_BITS * entries
    # the slices of the table, probed for absent keys
    f = language_model.LogFilter([np.frombuffer(slices[b]["bits"], np.uint64) for b in range(3)], [slices[b]["top"] for b in range(3)])
    found = f.lookup(np.random.default_rng(2).integers(0, 1 << 48, 20000).astype(np.uint64))
    assert (found > 0).mean() < 0.15


def test_buckets_follow_the_texts(spark, monkeypatch):
    """More text than the shuffle partitions' buckets may hold makes more buckets, each of them one task's."""
    given = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(200)], "doc_id long, text string")
    assert language_model.train(spark, given)[1] == 8
    monkeypatch.setattr(language_model, "BUCKET_TEXT", 2_000)
    built, buckets = language_model.train(spark, given)
    assert buckets == -(-given.agg(F.sum(F.octet_length("text"))).first()[0] // 2_000) > 30
    assert sorted(r["bucket"] for r in built.collect()) == list(range(buckets))
    placed = language_model.count(given, buckets).repartitionById(buckets, F.col("bucket")).select("bucket", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(r["bucket"] == r["p"] for r in placed) and len(placed) == buckets


def test_lookup_ends_at_the_highest_level():
    full = language_model.LogFilter([np.full(4, ~np.uint64(0))], [5])
    assert (full.lookup(np.arange(100, dtype=np.uint64)) == 5).all()
    assert (language_model.LogFilter([np.full(4, ~np.uint64(0))]).lookup(np.arange(100, dtype=np.uint64)) < 128).all()


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_scores_are_those_of_the_whole_filter(spark, monkeypatch, buckets):
    monkeypatch.setattr(language_model, "ROWS", 3)
    rows = [(i, i % 4 == 0, " ".join(WORDS[(i * i + k) % len(WORDS)] for k in range(i % 40))) for i in range(60)] + [(None, True, None)]
    given = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(3)
    given, _ = common.materialize(spark, given, "given")
    built, model = language_model.train(spark, given.where("not held_out"), buckets)
    slices = {r["bucket"]: r for r in built.collect()}
    f = language_model.LogFilter([np.frombuffer(slices[b]["bits"], np.uint64) if b in slices else np.zeros(1, np.uint64) for b in range(buckets)], [slices[b]["top"] if b in slices else 0 for b in range(buckets)])
    total, kinds = built.agg(F.sum("total"), F.sum("tokens")).first()
    of = lambda keys: language_model.counts_of(f.lookup(keys))

    def want(t):
        h, sizes = language_model._stream([t.encode() if t else None])
        own, end = of(language_model._unigram(h, buckets)), of(language_model._unigram(np.array([language_model.END]), buckets))
        before = np.concatenate([end, own[:-1]])
        both = np.minimum(of(language_model._pairs(h, sizes)), before)
        return np.log10((both + language_model.MU * (own + 1) / (total + kinds + 1)) / (before + language_model.MU)).sum()

    key = lambda i, s: (-1 if i is None else i, round(float(s), 6))
    assert sorted(key(r["doc_id"], r["score"]) for r in language_model.score(spark, given, built, model).collect()) == sorted(key(i, want(t)) for i, _, t in rows)


# Packing


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    parts = packing.pieces(docs, packing.vocabulary_path(), 256)
    got = collections.defaultdict(list)
    for r in packing.pack(spark, parts, 256).collect():
        got[r["sequence_id"]].append(r)
    back = collections.defaultdict(list)
    for rows in got.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == list(np.cumsum([0] + [r["length"] for r in rows[:-1]])) and sum(r["length"] for r in rows) <= 256
        for r in rows:
            back[r["doc_id"]].append((r["piece"], r["start"], bytes(r["ids"])))
    want = collections.Counter((i, np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in texts(docs) if i != 107)
    assert collections.Counter((i, b"".join(x[2] for x in sorted(p))) for i, p in back.items() if i != 107) == want
    assert len(back[107]) == 2 and len(set(back[107])) == 1
    total = sum(len(x[2]) // 4 for p in back.values() for x in p)
    assert len(got) <= -(-total // 256) * 1.02 + 1
    assert packing.pack(spark, packing.pieces(empty, packing.vocabulary_path()), 4096).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_under_every_capacity(spark, rule):
    """Documents and attention bind before tokens do; repeated rows, null ids and clashing names are dealt by place."""
    rows = [(None if i % 3 else i, 0, 1 + i * i % 40, "x") for i in range(600)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, length long, own string").withColumns({"_part": F.lit(1), "_rank": F.lit(2), "offset": F.lit(3)})
    out = packing.pack(spark, parts, 100, max_docs=4, max_attention=1700, rule=rule)
    assert out.columns == ["doc_id", "piece", "length", "own", "_part", "_rank", "sequence_id", "offset"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, got.values())) == 600
    tight = {"documents": 0, "attention": 0}
    for items in got.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0] + [n for _, n in items[:-1]]))
        assert sum(n for _, n in items) <= 100 and len(items) <= 4 and sum(n * n for _, n in items) <= 1700
        tight["documents"] += len(items) == 4
        tight["attention"] += sum(n * n for _, n in items) > 1500
    assert all(tight.values())


def test_special_strings_and_marks():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    coder = packing.WordEncoder(packing.vocabulary_path())
    for t in ("a <|endoftext|>b C", "~ a~b ~~ <|startoftext|>", "it's DON'T x1y2 — é é", " x y", "A <|ENDOFTEXT|> b"):
        ws = packing._words(t.encode())
        coder.learn(set(ws))
        assert np.frombuffer(coder.ids(ws), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 5, 10_000), (100, 100, 2_000)])
def test_plan_keeps_every_constraint(rule, capacity):
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(range(1, 45), rng.integers(0, 40, 44), strict=True)}
    bins = collections.defaultdict(list)
    ranks = collections.Counter()
    for length, rank, n, first, offset in packing.plan(counts, capacity, rule=rule).tolist():
        assert rank == ranks[length]
        ranks[length] += n
        for b in range(first, first + n):
            bins[b].append((offset, length))
    assert +ranks == +collections.Counter(counts)
    for items in bins.values():
        items.sort()
        at = 0
        for offset, length in items:
            assert offset == at
            at += length
        assert at <= capacity[0] and len(items) <= capacity[1] and sum(x * x for _, x in items) <= capacity[2]


# Licenses


def test_licenses(spark, docs, empty):
    a, m = licenses.NOTICES["Apache-2.0"], licenses.NOTICES["MIT-grant"]
    cut = " ".join(m.split()[:-1])
    rows = [(1, prose(100, 1) + "\n" + a), (2, f"{prose(20, 2)} {cut} {prose(30, 3)}"), (3, "LICENSED under CC-BY-NC 4.0"), (4, " ".join(m.split()[:10])), (5, None), (6, "")]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT-grant"), (3, "CC-BY-NC-4.0")}
    assert licenses.scan(spark, docs).count() == 0 and licenses.scan(spark, empty).count() == 0
    assert licenses.bands(licenses.NOTICES) >= 10


@pytest.mark.parametrize("key_bytes", [licenses.KEY_BYTES, 0])
def test_licenses_at_every_place(spark, monkeypatch, key_bytes):
    monkeypatch.setattr(licenses, "KEY_BYTES", key_bytes)
    rows, want = [], set()
    for name, text in licenses.NOTICES.items():
        for before in range(45):
            rows.append((len(rows), f"{prose(before, before)} {text} {prose(before % 7, 3)}"))
            want.add((rows[-1][0], name))
    rows.append((len(rows), "license " * 30_000))
    got = licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("containment = 100").collect()
    assert want <= {(r["doc_id"], r["license"]) for r in got}


def test_license_anchors_lose_no_match():
    words_ = licenses.anchors(licenses.NOTICES)
    for text in licenses.NOTICES.values():
        shingles = licenses._shingles(licenses.normal(text))
        without = [s for s in shingles if not any(w in s for w in words_)]
        assert 100 * len(without) < licenses.CONTAINED * len(shingles)


# Jaccard join


def brute_classes(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = [x.encode().lower() for x in words(t)]
        n = min(5, len(w))
        sets[k] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(sets[k]), least[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("limits", [(20_000, 16_000_000, 64, 10**6), (4, 300, 2, 2), (4, 300, 10**9, 10**6)])
def test_jaccard_join(spark, docs, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", limits[0])
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", limits[1])
    monkeypatch.setattr(jaccard_join, "FREQUENT", limits[2])
    monkeypatch.setattr(jaccard_join, "COPIES", limits[3])
    monkeypatch.setattr(graph, "HUB", limits[3])
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(spark, docs).collect())
    assert got == brute_classes(texts(docs))


def test_jaccard_join_of_nothing(spark, empty):
    assert jaccard_join.classes(spark, empty).count() == 0


def test_near_copies_at_the_edge(spark):
    base = prose(400, 7).split()
    rows = [(i, " ".join(base[:k])) for i, k in enumerate(range(324, 405, 4))] + [(90 + i, " ".join(base[:200] + ["new"] * i + base[200 + i :])) for i in range(1, 60, 7)]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_classes(rows)


def test_blocks_hold_every_pair():
    sids = np.random.default_rng(3).integers(0, 1 << 60, 500).astype(np.uint64)
    assert [len(x) for x in jaccard_join._blocks(sids, 500)] == [500]
    parts = list(jaccard_join._blocks(sids, 100))
    assert max(map(len, parts)) <= 150 and all((np.diff(x.astype(np.int64)) > 0).all() for x in parts)
    met = {(a, b) for x in parts for a in x.tolist() for b in x.tolist()}
    assert len(met) == 500 * 500
    assert jaccard_join.tree_sets(10, 20_000, 2_000) == 2_000 and jaccard_join.tree_sets(10**9, 20_000, 2_000) == 20_000


def test_sets_of_one_number_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "set_id", lambda u: int(math.log(len(u)) / jaccard_join.STEP) << 53 if len(u) else 0)
    rows = [(i, prose(90 + i, i // 2)) for i in range(12)] + [(20, prose(90, 0)), (21, None)]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert {(i, n) for i, n, _ in got} == {(i, n) for i, n, _ in brute_classes(rows)}
    assert next(c for i, _, c in got if i == 20) == 0


@pytest.mark.parametrize("widest", [64, 256])
def test_narrow_bitmaps_lose_no_link(spark, docs, monkeypatch, widest):
    """Bitmaps of a bounded width, as those of very long texts, leave the same components; their bytes are bounded."""
    long = prose(3000, 91).split()
    rows = [(900 + i, " ".join([*long[: 40 * i], f"z{i}", *long[40 * i + 1 :]])) for i in range(8)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    own = lambda: collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(spark, given).collect())
    want = own()
    monkeypatch.setattr(jaccard_join, "WIDEST", widest)
    assert own() == want and sum(c == 900 for _, _, c in want) == 8
    sets = [jaccard_join.shingle_set(t.encode()) for _, t in rows]
    assert {len(signature_tree.bitmap(u, widest)) for u in sets} == {widest // 8} and len(signature_tree.bitmap(sets[0])) == 1024


def test_tree_finds_what_all_pairs_find():
    rng = random.Random(2)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.6:
            s = set(rng.choice(sets))
            for _ in range(rng.randrange(8)):
                s.discard(rng.choice(sorted(s)))
                s.add(rng.getrandbits(63))
        else:
            s = {rng.getrandbits(63) for _ in range(rng.randrange(1, 300))}
        sets.append(s)
    similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    forest = signature_tree.Forest(np.array([len(s) for s in sets]), [signature_tree.bitmap(a) for a in arrays], 80, similar)
    root = {i: i for i in range(len(sets))}
    root.update(dict(forest.join()))
    want = list(range(len(sets)))

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if similar(i, j):
                want[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            assert (root[i] == root[j]) == (find(i) == find(j))


@pytest.mark.parametrize("hub", [10**6, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)] + [(500, 501 + i) for i in range(9)] + [(700 + i, 790) for i in range(9)]
    want = {**{i: 0 for i in range(1, 41)}, 200: 100, **{501 + i: 500 for i in range(9)}, **{701 + i: 700 for i in range(8)}, 790: 700}
    given = spark.createDataFrame(links, "x long, y long")
    assert {r["a"]: r["b"] for r in graph.components(spark, given, "t")[0].collect()} == want
    pairs = given.select(F.struct(F.lit(1).alias("p"), F.col("x").alias("q")).alias("x"), F.struct(F.lit(1).alias("p"), F.col("y").alias("q")).alias("y"))
    assert {r["a"]["q"]: r["b"]["q"] for r in graph.components(spark, pairs, "t")[0].collect()} == want
    assert graph.components(spark, spark.createDataFrame([], "x long, y long"), "t")[0].count() == 0


# Personal data


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(spark)


def luhn(x):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(x)))) % 10 == 0


def base_spans(t):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 13 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m)) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_generators_propose_spans_of_any_length(spark):
    """Recall of the generators on planted spans: none is missed for its length."""
    letters = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[(7 * i) % 26] for i in range(n))
    planted = [("secret", letters(n) + "7" + letters(20)) for n in (0, 1, 30, 59, 60, 61, 64, 200, 5_000)] + [("secret", "9" * n + "Az") for n in (14, 100, 3_000)]
    planted += [("contact", f"{letters(n)} [at] mail (dot) example (dot) org") for n in (1, 63, 64, 65, 300, 5_000)] + [("contact", f"jo (at) {letters(n)}.org") for n in (1, 64, 300)]
    planted += [("ipv6", ":".join(["20ab"] * n)) for n in (4, 6, 8)]
    planted += [("number", "-".join("123" for _ in range(n))) for n in range(3, pii.GROUPS + 1)] + [("number", "5" * n) for n in (7, 12, 19)]
    given = spark.createDataFrame([(i, f"see {span} there") for i, (_, span) in enumerate(planted)], "doc_id long, text string")
    got = pii.candidates(given, pii.MORE_KINDS, ("doc_id",)).select("own.doc_id", F.transform(F.concat(*pii.MORE_KINDS), lambda x: x["raw"]).alias("raw"), F.transform(F.concat(*pii.MORE_KINDS), lambda x: x["kind"]).alias("kind")).collect()
    missed = [planted[r["doc_id"]] for r in got if (pii.KINDS.index(planted[r["doc_id"]][0]), planted[r["doc_id"]][1]) not in set(zip(r["kind"], r["raw"]))]
    assert len(got) == len(planted) and missed == []


TRICKY = [
    "a@b.c_d@e.f g@h@i.j x..@y.z- @a.b a.b@c.d.e.", "1.2.3.4.5 256.1.1.1 001.02.3.255 1.1.1 9.9.9.9", "4539 1488 0343 6467 4539-1488-0343-6467 4539148803436467  4539148803436468 12345678901234567890",
    "+1 (811) 555-3281 +4 +12345678 +1 2 3 4 5 6 7 8 9 tel +1+2345678901", "𝔘 漢 é a.b@c.de ☃ 10.0.0.1", "+4539148803436467 a4539148803436467b", "a" * 20_000 + "@", "1." * 9000, "1 " * 9000, "+" * 5000 + "(" * 5000,
]


def test_base_spans(spark, docs, trees):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    rng = random.Random(4)
    rows += [(100 + i, "".join(rng.choice("ab1209.@+- ()_\n") for _ in range(rng.randrange(200)))) for i in range(400)]
    given = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    strict = F.concat(*pii.BASE_KINDS)
    got = collections.Counter((r["doc_id"], r["told"]) for r in pii.find(given, trees).select("own.doc_id", pii._told(strict).alias("told")).collect())
    assert got == collections.Counter((i, base_spans(t or "")) for i, t in texts(given))


def test_trees_as_columns_match_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    d = spark.createDataFrame([(row.tolist(), float(row[0] * row[1] > 0)) for row in x], "f array<double>, label double").withColumn("features", array_to_vector("f"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(d)
    trees = pii.Trees(model.toDebugString, list(model.treeWeights), {})
    for r in model.transform(d.withColumn("mine", trees.score(F.col("f")))).collect():
        assert math.isclose(r["mine"], r["probability"][1], rel_tol=1e-9)


def test_trees_select(spark, trees, empty):
    rows = [(1, 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" of'), (2, "the commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff of"), (3, "order 4652511922028857 it"), (4, "call (811) 555-3281 now"), (5, prose(100, 3))]
    found = {r["own"]["doc_id"]: [pii.KINDS[x["kind"]] for x in r["more"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), trees).collect()}
    assert found == {1: ["secret"], 2: [], 3: [], 4: ["number"], 5: []}
    assert pii.find(empty, trees).count() == 0


def test_redaction(spark, trees):
    rows = [(1, "é a.b@c.de and 10.0.0.1, +4539148803436467!"), (2, None), (3, "plain")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), trees)
    got = {r["doc_id"]: r["t"] for r in found.select("own.doc_id", pii.redact(found).alias("t")).collect()}
    assert got[1] == "é [EMAIL] and [IP], +[CARD]!"
    assert got[2] == "" and got[3] == "plain"


def test_held_out_templates(spark, trees):
    """Every kind has a threshold, and on fresh rows of templates that the trees did not see it is about as precise as asked."""
    assert set(trees.limits) == set(pii.MORE_KINDS)
    rows = pii.training_rows(spark, 3000, seed=11)
    found = pii.find(rows, trees, ("id", "held", "label", "low", "high")).select("own.*", "more").where("held").collect()
    hits = {True: 0, False: 0}
    for r in found:
        for x in r["more"]:
            hits[r["label"] == 1 and (x["start"], x["end"]) == (r["low"], r["high"])] += 1
    assert hits[True] >= 0.8 * sum(r["label"] == 1 for r in found) and hits[False] <= 0.02 * hits[True]


def test_numbers_beside_others_are_found(spark, trees):
    rows = [(1, "tel 811-555-3281 10.0.0.1 and tel 811-555-3282"), (2, "phone 811-555-3281 1999, call 811-555-3282"), (3, "".join(f"tel 811-555-{i:04d} 10.0.0.{i % 200} " for i in range(500)))]
    found = {r["own"]["doc_id"]: [x["raw"] for x in r["more"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), trees).collect()}
    assert found == {1: ["811-555-3281", "811-555-3282"], 2: ["811-555-3281", "811-555-3282"], 3: [f"811-555-{i:04d}" for i in range(500)]}


def test_very_many_spans_in_one_text(spark, trees):
    import time

    n = 12_500
    text = "".join(f"tel 811-555-{i % 10000:04d} me{i}@mail.example.com 10.0.0.{i % 200} +1 (811) 555-{i % 10000:04d}; " for i in range(n))
    given = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    began = time.time()
    found = pii.find(given, trees)
    r = found.select(F.size("email").alias("e"), F.size("ip").alias("i"), F.size("phone").alias("p"), F.size("more").alias("m"), pii.redact(found).alias("t")).first()
    took = time.time() - began
    assert (r["e"], r["i"], r["p"], r["m"]) == (n, n, n, n)
    assert r["t"] == "tel [NUMBER] [EMAIL] [IP] [PHONE]; " * n
    assert took < 60


def test_sweep_and_running_sums(spark):
    rows = [([],), (list(range(1, 1001)),), ([5],)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<int>").select(pii._running(F.col("x"))).collect()]
    assert got == [np.cumsum(x).tolist() for (x,) in rows]


def test_redaction_equals_brute_force(spark, trees):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["é", "a@b.cd", " ", "+1 (811) 555-3281", "10.0.0.1", "\n", "x" * rng.randrange(2000), "𝔘", "4539148803436467", "\x01"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), trees)
    text = dict(rows)
    for r in found.select("own.doc_id", F.concat(*pii.BASE_KINDS, "more").alias("s"), pii.redact(found).alias("t")).collect():
        t, out, at = text[r["doc_id"]], "", 0
        for start, end, kind in sorted((x["start"], x["end"], x["kind"]) for x in r["s"]):
            if start >= at:
                out += t[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, end)
        assert r["t"] == out + t[at:]


def test_personal_data_with_clashing_names(spark, docs, trees):
    given = docs.withColumns({c: F.lit("clash") for c in ("own", "p", "more", "email", "_t", "start", "raw")})
    assert pii.find(given, trees, ("doc_id", "own", "more", "email")).select("own.*").columns == ["doc_id", "own", "more", "email"]
    assert pii.find(given, trees).count() == docs.count()


# Decontamination


def test_decontamination(spark, docs, empty):
    items = [(1, prose(20, 50)), (2, prose(60, 51)), (3, "tiny item"), (4, None), (5, ""), (6, prose(300, 52)), (7, prose(11, 53)), (8, prose(60, 51))]
    change = lambda t, k: " ".join(t.split()[:k] + ["other"] + t.split()[k + 1 :])
    rows = [(200 + i, f"{prose(31 + i, 60 + i)} {t} {prose(40, 70)}") for i, (_, t) in enumerate(items) if t]
    rows += [(300 + i, f"{prose(13 + i, 80)}, {change(t, k).upper()}! {prose(9, 81)}") for i, (t, k) in enumerate([(items[1][1], 30), (items[5][1], 5), (items[0][1], 19), (items[1][1], 0)])]
    given = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in contamination.matches(spark, given, table).collect())
    want = collections.Counter()
    for d, t in texts(given):
        w = contamination.normal(t)
        for i, item in items:
            x = contamination.normal(item)
            if len(x) and any(100 * a >= 80 * b for p in range(max(1, len(w) - len(x) + 1)) for a, b in [contamination.similarity(w[p : p + len(x)], x)] if b):
                want[d, i] += 1
    assert got == want
    dirty = {d for d, _ in got}
    assert collections.Counter(r["doc_id"] for r in contamination.clean(spark, given, table).collect()) == collections.Counter(d for d, _ in texts(given) if d not in dirty)
    assert contamination.clean(spark, empty, table).count() == 0
    assert contamination.matches(spark, empty, table).count() == 0 and contamination.matches(spark, docs, table.limit(0)).count() == 0


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(WORDS, 40)) for _ in range(20)]
    index = contamination.Index(list(enumerate(base)))
    c, (f, k, o, tables) = next(iter(index.classes.items()))
    for _ in range(2000):
        i = rng.integers(len(f))
        x = np.array([f[i]], np.uint64)
        for bit in rng.choice(64, rng.integers(0, contamination.RADIUS + 1), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        parts = x.view(np.uint16)
        assert any(i in rows[bounds[parts[b]] : bounds[int(parts[b]) + 1]] for b, (bounds, _, rows) in enumerate(tables))


def test_whole_copies_of_any_length_at_any_place():
    items = [(n, " ".join(f"x{n}y{j}" for j in range(n))) for n in range(1, 21)]
    index = contamination.Index(items)
    for n, item in items:
        for shift in range(4):
            text = f"{prose(20 + shift, 500 + n)} {item} {prose(30, 600 + n)}"
            assert [(i, s, p) for _, i, s, p in contamination._find(index, [text])] == [(n, 100.0, 20 + shift)]


def test_copies_edited_at_head_middle_and_tail():
    rng = random.Random(11)
    fresh = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    items = [(n, fresh(n)) for n in (15, 31, 40, 50, 59, 100, 200, 400) for _ in range(3)]
    index = contamination.Index([(i, " ".join(x)) for i, (_, x) in enumerate(items)])
    for i, (n, x) in enumerate(items):
        d = contamination.lost(n)
        edits = {"head": fresh(d) + x[d:], "tail": x[: n - d] + fresh(d), "both": fresh(d // 2) + x[d // 2 : n - d + d // 2] + fresh(d - d // 2)}
        if d >= 5:
            edits["middle"] = x[: n // 2] + fresh(d - 4) + x[n // 2 + d - 4 :]
            edits["inserted"] = x[: n // 2] + fresh(d - 4) + x[n // 2 :]
            single = list(x)
            for j in range(d // 5):
                single[(2 * j + 1) * n // (2 * (d // 5))] = "other"
            edits["single words"] = single
        for where, e in edits.items():
            found = list(contamination._find(index, [" ".join(fresh(20 + i % 4) + e + fresh(30))]))
            assert [(k, s >= 80) for _, k, s, _ in found] == [(i, True)], (n, where)


def test_recall_at_the_edge():
    """Copies with random edits that bring them near the limit, against the exact similarity: at least 0.95 are found."""
    rng = random.Random(21)
    fresh = lambda n: [f"g{rng.randrange(10**9)}" for _ in range(n)]
    items = [fresh(rng.randrange(12, 300)) for _ in range(60)]
    index = contamination.Index([(i, " ".join(x)) for i, x in enumerate(items)])
    want = found = 0
    for i, x in enumerate(items):
        for _ in range(5):
            copy, last = list(x), list(x)
            while True:
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = fresh(rng.randrange(1, 3))
                a, b = contamination.similarity(contamination.normal(" ".join(copy)), contamination.normal(" ".join(x)))
                if 100 * a < 82 * b:
                    break
                last = list(copy)
            text = " ".join(fresh(rng.randrange(40)) + last + fresh(30))
            own = contamination.normal(text)
            item = contamination.normal(" ".join(x))
            if any(100 * a >= 80 * b for p in range(max(1, len(own) - len(item) + 1)) for a, b in [contamination.similarity(own[p : p + len(item)], item)]):
                want += 1
                found += any(k == i for _, k, _, _ in contamination._find(index, [text]))
    assert want >= 250 and found >= 0.95 * want


def test_windows_in_common_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(rng.integers(1, 9))]
        text, item = (" ".join(rng.choice(vocabulary, rng.integers(1, n))) for n in (60, 30))
        index = contamination.Index([(1, item)])
        own, x = contamination.normal(text), contamination.normal(item)
        last = max(0, len(own) - len(x))
        a = int(rng.integers(0, last + 1))
        b = int(rng.integers(a, last + 1))
        best = None
        for p in range(a, b + 1):
            i, u = contamination.similarity(own[p : p + len(x)], x)
            if 100 * i >= 80 * u:
                best = max(best or (0.0, 0), (100 * i / u, -p))
        assert contamination._best(index, 0, own, a, b) == best
    assert list(contamination._runs([5, 100, 6, 7], 200, 30)) == [(3, 9), (98, 102)]
    assert list(contamination._runs([-9, 300], 20, 30)) == [(0, 0)]


def test_long_items_take_linear_time():
    """An exact copy of an item of 40,000 words, and one item in a text that repeats it, are found in seconds."""
    item = prose(40_000, 77)
    begin = time.monotonic()
    assert [(i, s, p) for _, i, s, p in contamination._find(contamination.Index([(1, item)]), [f"{prose(90, 78)} {item} {prose(50, 79)}"])] == [(1, 100.0, 90)]
    short = prose(420, 80)
    assert [(s, p) for _, _, s, p in contamination._find(contamination.Index([(1, short)]), [" ".join([short] * 50)])] == [(100.0, 0)]
    assert time.monotonic() - begin < 20


def test_items_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(30, 900 + i)) for i in range(9)] * 2, "item_id long, text string")
    given = spark.createDataFrame([(i, f"{prose(20, i)} {prose(30, 900 + i)} {prose(10, 50)}") for i in range(9)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "similarity", "first_word", "name", "sent")})
    for limits in ((50_000, 1 << 25), (2, 1 << 25), (50_000, 100)):
        monkeypatch.setattr(contamination, "ITEMS", limits[0])
        monkeypatch.setattr(contamination, "ITEM_BYTES", limits[1])
        assert sorted((r["doc_id"], r["item_id"]) for r in contamination.matches(spark, given, items).collect()) == [(i, i) for i in range(9)]
        assert contamination.clean(spark, given, items.where("item_id > 3")).columns == given.columns
        assert sorted(r["doc_id"] for r in contamination.clean(spark, given, items.where("item_id > 3")).collect()) == [0, 1, 2, 3]


def test_very_long_text_is_searched_whole():
    item = prose(50, 5)
    w = (" ".join(prose(3000, i) for i in range(50)) + " " + item).split()
    text = " ".join(w[:59_990]) + " " + item + " " + " ".join(w[59_990:])
    found = list(contamination._find(contamination.Index([(1, item)]), [text, None]))
    assert [(d, i, s) for d, i, s, _ in found] == [(0, 1, 100.0)]
    ones = contamination._ones(contamination.normal(text)[:1000])
    h = contamination.normal(text)[:1000]
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for c, at in ((12, 0), (40, 480), (240, 720)):
        want = np.packbits(bits[at : at + c].sum(axis=0) > c // 2).view(np.uint64)[0]
        assert contamination.fingerprints(ones, c, 4)[at // 4] == want


# Sharding


def test_lookup_table():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    assert np.ptp(np.bincount(table)) <= 1
    fewer = sharding.fill(names[:-1], 1009)
    assert ((table != fewer) & (table != 9)).mean() < 0.25
    assert (sharding.fill([], 7) == -1).all() and (sharding.fill(["a"], 7) == 0).all()
    with pytest.raises(ValueError, match="prime"):
        sharding.fill(names, 1000)


def test_placement(spark, docs, empty):
    names = [f"s{i}" for i in range(4)]
    table = sharding.fill(names)
    for r in sharding.place(spark, docs, "doc_id", names).collect():
        key = b"" if r["doc_id"] is None else str(r["doc_id"]).encode()
        assert r["slot"] == int(hashlib.md5(key).hexdigest()[:12], 16) % sharding.SLOTS and r["shard"] == names[table[r["slot"]]]
    assert sharding.place(spark, empty, "doc_id", names).count() == 0
    odd = docs.withColumns({"_slot": F.lit(1), "_shard": F.lit("x"), "own": F.lit(2)})
    assert {(r["_slot"], r["_shard"], r["own"]) for r in sharding.place(spark, odd, "doc_id", names).collect()} == {(1, "x", 2)}
    with pytest.raises(ValueError, match="slots"):
        sharding.fill(names, 3)


def test_table_is_filled_by_turns():
    """The table claimed slot by slot from whole preference lists."""
    names, slots = [f"n{i}" for i in range(7)], 101
    orders = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        start, skip = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:], "little") % (slots - 1) + 1
        orders.append([(start + skip * k) % slots for k in range(slots)])
    owner = {}
    for turn in range(slots):
        owner[next(s for s in orders[turn % 7] if s not in owner)] = turn % 7
    assert sharding.fill(names, slots).tolist() == [owner[s] for s in range(slots)]


# Language identification


def test_bundle_is_the_sum_of_bound_letters():
    v, has = language.bundle(["Abc d", "", "123"])
    a, b, c, d = (language.letters()[i].astype(int) for i in (1, 2, 3, 4))
    s = language.letters()[0].astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert (v[0] == bind(s, a, b) + bind(a, b, c) + bind(b, c, s) + bind(s, d, s)).all()
    assert has.tolist() == [True, False, False] and not v[1:].any()


def test_language_identification(spark, docs, empty):
    other = "zwölf boxkämpfer jagen eva quer über den großen sylter deich und noch weiter hinaus".split()
    rows = [(i, prose(40, i), "greek") for i in range(30)] + [(50 + i, " ".join(random.Random(i).choices(other, k=40)), "german") for i in range(30)] + [(90, None, "greek"), (91, "text", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels, prototypes = language.train(labelled)
    assert labels == ["german", "greek"]
    given = labelled.unionByName(docs.select("doc_id", "text", F.lit("x").alias("lang"))).withColumn("held_out", F.lit(True))
    out = language.identify(spark, given, labels, prototypes).collect()
    right = {i: lang for i, t, lang in rows if t and lang}
    assert all(r["lang_pred"] == right[r["doc_id"]] for r in out if r["doc_id"] in right and r["doc_id"] >= 60)
    for r in out:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in (*labels, "und")
        if r["doc_id"] in (100, 101, 102, 109):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    # every score by plain cosines: letters bound one by one, prototypes added up text by text
    L = language.letters().astype(np.int64)

    def vector(t):
        x = [0, *[language._symbol(ord(ch)) for ch in (t or "").lower()], 0]
        x = [a for i, a in enumerate(x) if i == 0 or a or x[i - 1]]
        return sum((np.roll(L[a], 2) * np.roll(L[b], 1) * L[c] for a, b, c in zip(x, x[1:], x[2:]) if b), np.zeros(language.DIMENSIONS, np.int64))

    sums = {k: sum(vector(t) for _, t, lang in rows if t and lang == k) for k in labels}
    texts_ = collections.Counter()
    for r in given.collect():
        v = vector(r["text"])
        cos = [float(v @ sums[k]) / max(1e-9, np.linalg.norm(v) * np.linalg.norm(sums[k])) for k in labels]
        best = max(range(len(labels)), key=lambda i: cos[i])
        texts_[r["doc_id"], labels[best] if v.any() else "und", round(max(0.0, cos[best]), 4) if v.any() else 0.0] += 1
    assert texts_ == collections.Counter((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in out)
    none, zero = language.train(labelled.limit(0))
    assert none == [] and all(r["lang_pred"] == "und" for r in language.identify(spark, given, none, zero).collect())
    assert language.identify(spark, given.limit(0), labels, prototypes).count() == 0
