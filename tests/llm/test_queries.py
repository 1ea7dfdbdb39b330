"""The registered queries on the smallest tables: columns of their contracts, hold-outs, and brute force where it is short."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from runweave.llm import common, fixity, language_model, packing, pii, queries, sharding

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: (r["text"], r["lang"]) for r in common.table(spark, SMALL, "documents").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rest(i, m):
    return zlib.crc32(str(i).encode()) % m


def rows(spark, name, *columns):
    out = queries.QUERIES[name](spark, SMALL)
    assert tuple(out.columns[: len(columns)]) == columns
    return out.collect()


def test_op1(spark, texts):
    got = rows(spark, "op1_tokenizer_fertility", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        w = words(texts[r["doc_id"]][0])
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op3(spark, texts):
    got = rows(spark, "op3_log_frequency_bloom", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    tokens = {i: [*(w.encode().lower() for w in words(t)), None] for i, (t, _) in texts.items()}
    c = collections.Counter(w for i, ws in tokens.items() if rest(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter((a, b) for i, ws in tokens.items() if rest(i, 7) != 2 for a, b in zip([None, *ws], ws))
    exact = {}
    for i, ws in tokens.items():
        p = {w: (c[w] + 1) / (n + v + 1) for w in ws}
        exact[i] = sum(math.log10((pairs[a, b] + language_model.MU * p[b]) / (c[a] + language_model.MU)) for a, b in zip([None, *ws], ws))
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (rest(r["doc_id"], 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9, abs_tol=1e-9)
        # the model's score differs from that of exact counts by the quantisation and the filter's false positives only
        assert abs(r["score"] - exact[r["doc_id"]]) <= 0.15 * len(ws)
    assert np.corrcoef([r["score"] for r in got], [exact[r["doc_id"]] for r in got])[0, 1] > 0.999


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    got = rows(spark, "op4_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = collections.Counter()
    for i, (t, _) in texts.items():
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == list(np.cumsum([0] + [n for _, n in items[:-1]])) and sum(n for _, n in items) <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_op6(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in rows(spark, "op6_signature_tree_join", "doc_id", "n_shingles", "component_id")}
    sets = {}
    for i, (t, _) in texts.items():
        w = [x.encode().lower() for x in words(t)]
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_op7(spark, texts):
    """Base spans by plain patterns; what the trees add comes behind, lies clear of them and is of the further kinds."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda x: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(x)))) % 10 == 0
    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }
    got = rows(spark, "op7_boosted_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, texts[r["doc_id"]][0] or "") if good(m[0])] for k, (p, good) in base.items()}
        told = [f"{k}:{a}:{b}" for k, xs in found.items() for a, b in xs]
        assert tuple(r)[1:5] == tuple(len(xs) for xs in found.values())
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(told)] == told
        taken = [x for xs in found.values() for x in xs]
        for kind, a, b in (x.split(":") for x in spans[len(told) :]):
            assert kind in pii.MORE_KINDS and all(int(b) <= c or d <= int(a) for c, d in taken)


def test_op9(spark, texts):
    table = sharding.fill([f"shard-{i:03d}" for i in range(sharding.SHARDS)])
    got = rows(spark, "op9_permutation_sharding", "doc_id", "slot", "shard")
    assert {r["doc_id"] for r in got} == set(texts) and all(r["shard"] == f"shard-{table[r['slot']]:03d}" for r in got)


def test_op10(spark, texts):
    got = rows(spark, "op10_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(texts) and all(r["held_out"] == (rest(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == texts[r["doc_id"]][1] for r in held) >= 0.95 * len(held)


def test_op8_finds_every_planted_passage(spark, texts):
    items = {r["item_id"]: r["text"] for r in common.table(spark, SMALL, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op8_simhash_decontamination", "doc_id", "item_id")}
    assert {(i, k) for i, (t, _) in texts.items() for k, x in items.items() if x in (t or "")} <= got


def test_an_empty_replica(spark):
    from pyspark.sql import functions as F

    pages = common.table(spark, SMALL, "pages")
    leaf = fixity.leaves(pages, "page_id", fixity.record(F.col("url"), F.col("html")))
    for ours, theirs, status in ((leaf, leaf.limit(0), "missing"), (leaf.limit(0), leaf, "extra")):
        assert {(r["key"], r["status"]) for r in fixity.audit(spark, ours, theirs).collect()} == {(r["page_id"], status) for r in pages.collect()}
