"""Personal data: strict base patterns, and boosted trees over further candidate spans, all as column expressions.

Base patterns (e-mail, IP, card, phone) always count. Generators with high recall propose more spans, which may overlap:
one to GROUPS digit groups from every group on, long mixed tokens, spelled-out e-mail addresses, IPv6 addresses. Gradient-boosted
trees see the format and the context of each; a threshold per kind selects; of overlapping ones the best stays. The trees are
fitted on TRAIN_ROWS generated, labelled rows, and the thresholds calibrated for PRECISION on rows of other templates. The trees
become SQL expressions, so that finding spans is one pass over the texts without a shuffle.

A text takes time in proportion to its length and spans: each pattern marks its matches in one pass, places are running sums, and
overlaps are settled by ordered sweeps. Sums and sweeps work in blocks of BLOCK, so that no growing array is copied for each span.
"""

from __future__ import annotations

import json
import random
import re
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("number", "secret", "contact", "ipv6")
KINDS = BASE_KINDS + MORE_KINDS

#: The base patterns, written so that no text takes more than linear time or deep recursion: possessive repeats where
#: what follows cannot match inside them, and starts only where a run of the first class starts or the last match ended.
#: Card runs under 13 digits never count, so the pattern leaves them out.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]++)+",
    "ipv6": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Za-z:])",
}
#: Groups of digits that a `number` has at most, and what stands between two of them. A match is empty, so that numbers may overlap;
#: its group holds the number.
GROUPS, _BETWEEN = 5, r"[\x20().-]{1,2}"
_STARTS = rf"(?=[0-9(])(?<![0-9A-Za-z.,])(?:(?=\()|(?<!\())(?=\(?[0-9](?:[\x20().-]{{0,2}}[0-9]){{6}})"
NUMBERS = [rf"{_STARTS}(?=(\(?[0-9]++(?:{_BETWEEN}[0-9]++){{{k}}}+)(?![0-9A-Za-z]))" for k in range(GROUPS)]
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "phone": "+", "ipv6": ":"}
_NUMBER_NEEDS = r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"
#: Marks the ends of matches; in texts another control character, of no pattern either, stands for it.
_MARK, _OTHER = "\x01", "\x02"
#: Spans that are summed up, or swept, together; characters of a chunk of text.
BLOCK, CHUNK = 256, 1024
_IP_VALID = rf"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$"

#: Labelled rows that are generated to fit and calibrate the trees; least precision of a kind's threshold.
TRAIN_ROWS, PRECISION = 6000, 0.99
TREES, DEPTH = 12, 3
FEATURES = ("digits", "length", "groups", "luhn", "upper", "lower", "other", "cued", "assigned", "quoted", "longest", "paren", "dots", "dashes", "digits_before", "digits_after")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test; false for an empty one."""
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, raw: Column) -> Column:
    digits = _only_digits(raw)
    if kind == "ip":
        return raw.rlike(_IP_VALID)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "number":
        return F.length(digits).between(7, 19)
    return F.lit(True)


SPAN = "struct<kind:int,start:int,end:int,raw:string,left:string,right:string>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _in_blocks(items: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))
    return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i, BLOCK))).otherwise(F.array(items))


def sweep(items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """Array of what step passes on (an array of `kind`, of any length) as it goes through items in order with a state.

    step(state, item) gives the new state and what to pass on. State fields keep the types that they begin with.
    """
    none = F.array().cast(f"array<{kind}>")
    fields = lambda a: [a[k].alias(k) for k in state]

    def one(a: Column, x: Column) -> Column:
        new, out = step(a, x)
        return F.struct(*[new.get(k, a[k]).alias(k) for k in state], F.concat(a["out"], out).alias("out"))

    def block(a: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(*fields(a), none.alias("out")), one)
        return _let(done, lambda r: F.struct(*fields(r), F.array_append(a["outs"], r["out"]).alias("outs")))

    begin = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<array<{kind}>>").alias("outs"))
    return _let(items, lambda xs: F.flatten(F.aggregate(_in_blocks(xs), begin, block, lambda a: a["outs"])))


def _running(numbers: Column) -> Column:
    """Running sums of an array of whole numbers."""
    return sweep(numbers, {"p": F.lit(0)}, "int", lambda a, x: ({"p": a["p"] + x}, F.array(a["p"] + x)))


def _marked(text: Column, pattern: str, empty: bool) -> Column:
    """What lies between the matches and the matches in turn, from one pass of the pattern; an empty match gives its group."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}${int(empty)}{_MARK}"), _MARK, -1)


def _located(kind: str, pieces: str, empty: bool = False) -> Column:
    """Array of SPAN from the pieces of the text; without context for base kinds."""
    p = F.col(pieces)
    at = lambda i: F.get(p, i)
    n = F.floor(F.size(p) / 2).cast("int")
    numbers = F.sequence(F.lit(0), n - 1)
    own = lambda i: F.length(at(2 * i)) + (F.lit(0) if empty else F.when(i > 0, F.length(at(2 * i - 1))).otherwise(0))
    starts = _running(F.transform(numbers, own))
    none = F.lit(None).cast("string")

    def context(i: Column) -> tuple[Column, Column]:
        if kind in BASE_KINDS:
            return none, none
        if not empty:
            return F.right(F.concat(F.coalesce(at(2 * i - 1), F.lit("")), at(2 * i)), F.lit(24)), F.left(F.concat(at(2 * i + 2), F.coalesce(at(2 * i + 3), F.lit(""))), F.lit(4))
        before = F.concat(*[F.coalesce(at(2 * i - 2 * j), F.lit("")) for j in range(3, -1, -1)])
        # pieces run on from one start to the next; a number and what follows it lie in the next few
        after = F.concat(*[F.coalesce(F.left(at(2 * i + 2 * j), F.lit(64)), F.lit("")) for j in range(1, GROUPS + 3)])
        return F.right(before, F.lit(24)), F.substr(after, F.length(at(2 * i + 1)) + 1, F.lit(4))

    def span(i: Column, start: Column) -> Column:
        raw, (left, right) = at(2 * i + 1), context(i)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(raw)).alias("end"), raw.alias("raw"), left.alias("left"), right.alias("right"))

    valid = F.filter(F.zip_with(numbers, starts, span), lambda x: _valid(kind, x["raw"]))
    return F.when(n > 0, valid).otherwise(F.array()).cast(f"array<{SPAN}>")


def candidates(docs: DataFrame, kinds: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """The columns of docs in `keep` (as struct own), its text, and for each kind the array of its spans.

    A null text is empty. Spans of `number` overlap.
    """
    out = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*keep).alias("own"))
    out = out.select("*", F.replace("text", F.lit(_MARK), F.lit(_OTHER)).alias("_t"), F.col("text").rlike(_NUMBER_NEEDS).alias("_digits"))
    t, marked, found = F.col("_t"), [], []
    for k in kinds:
        if k == "number":
            marked += [F.when(F.col("_digits"), _marked(t, pattern, True)).alias(f"p_number{j}") for j, pattern in enumerate(NUMBERS)]
            found.append(F.concat(*[_located(k, f"p_number{j}", True) for j in range(GROUPS)]).alias(k))
        else:
            pieces = _marked(t, PATTERNS[k], False)
            marked.append((F.when(t.contains(NEEDS[k]), pieces) if k in NEEDS else pieces).alias(f"p_{k}"))
            found.append(_located(k, f"p_{k}").alias(k))
    return out.select("text", "own", *marked).select("text", "own", *found)


def features(span: Column) -> Column:
    """Numbers that describe a span's format and what stands around it, in the order of FEATURES."""
    raw = span["raw"]
    n = F.length(raw)
    digits = _only_digits(raw)
    left, right = span["left"], span["right"]
    size = lambda pattern: (n - F.length(F.regexp_replace(raw, pattern, ""))).cast("double")
    yes = lambda c: c.cast("int").cast("double")
    return F.array(
        F.length(digits).cast("double"),
        n.cast("double"),
        F.size(F.regexp_extract_all(raw, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        yes(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)),
        size("[A-Z]"),
        size("[a-z]"),
        size("[A-Za-z0-9]"),
        yes(left.rlike(r"(?i)(?:tel|phone|call|fax|mobile|ssn|social|account|acct|iban|passport|token|secret|passw|pwd|credential|key)")),
        yes(left.rlike(r"[=:]\s?[\"']?$")),
        yes(left.rlike(r"[\"']$") & right.rlike(r"^[\"']")),
        F.array_max(F.transform(F.regexp_extract_all(raw, F.lit("[0-9A-Za-z]+"), F.lit(0)), F.length)).cast("double"),
        yes(raw.contains("(")),
        size(r"\."),
        size("-"),
        yes(left.rlike(r"[0-9][\x20().-]{0,2}$")),
        yes(right.rlike(r"^[\x20().-]{0,2}[0-9]")),
    )


def templates() -> list[tuple[bool, int, str, str, str]]:
    """Held out for calibration, label, text before, what looks like personal data (or not), text behind.

    In the parts a|b stands for one of a and b, & joins such choices, # is a digit, ~ a lower-case and ^ an upper-case hexadecimal digit.
    """
    h32, h40 = "~" * 32, "~" * 40
    return [
        (False, 1, "", "(###) ###-####", ""),
        (False, 1, "call |tel. |Phone: ", "###-###-####", ""),
        (False, 1, "phone |tel ", "###-###-####", " 19##|, 19##"),
        (False, 1, "SSN |social security ", "###-##-####", ""),
        (False, 1, "fax |mobile |call me: ", "### ### ####", ""),
        (False, 1, "account |acct. ", "#### #### ####", ""),
        (True, 1, "tel. |mobile ", "###.###.####", ""),
        (True, 1, "", "(###) ### ####", ""),
        (False, 0, "", "#" * 16, ""),
        (False, 0, "order |item no. |total ", "#########", ""),
        (False, 0, "", "20##-0#-1# 1# 30", ""),
        (False, 0, "", "19## 19## 20## 20##", ""),
        (False, 0, "", "###.###.###", ""),
        (False, 0, "sold |about ", "# ### ###", ""),
        (False, 0, "isbn |ISBN ", "978-#-###-#####-#", ""),
        (True, 0, "in |from ", "19##-20##", ""),
        (True, 0, "no. |row ", "##-######", ""),
        (False, 1, "token = \"|api_key: \"|secret=\"", h40, "\""),
        (False, 1, "password: |pwd=|key = ", "^^^^^^" + "~" * 14, ""),
        (False, 1, "token: |secret_key = ", "~~~~~~~~-^^^^^^^^^^^^_~~~~~~~~", ""),
        (True, 1, "credential = \"|passwd: \"", h32, "\""),
        (False, 0, "commit |sha1 |revision ", h40, ""),
        (False, 0, "", "version-##-release-candidate", ""),
        (False, 0, "", "img_########_thumbnail", ""),
        (False, 0, "at \"|in \"", h32, "\""),
        (True, 0, "blob |tree ", h40, ""),
        (True, 0, "", "chapter-##-introduction-part", ""),
        (False, 1, "", "anna##|j.miller##|info##& [at] | (at) |[at]&mail#.example.com|mail# [dot] example [dot] org", ""),
        (False, 0, "", "meet|arrive& (at) st| (at) mt&.louis|.airy", ""),
        (True, 1, "", "max###|b_stone###& (AT) | [AT] &post#.example.net", ""),
        (False, 1, "", "2001:~~~~:~~~~:~~~~::~~~~", ""),
        (False, 0, "", "1#:3#:2#:0#", ""),
        (True, 1, "", "fd00:~~~~:~~~~:~~~~:~~~~::1", ""),
        (True, 0, "", "##:##:##:###", ""),
    ]


_WORDS = ["the of and", "que la des", "und der nicht", "para los con", "it was then", "see also", "of which"]


def training_rows(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """Generated rows (id, held, label, low, high, text): personal data (label 1) at low to high, or what looks like it (0)."""
    r = random.Random(seed)

    def made(part: str) -> str:
        text = "".join(r.choice(x.split("|")) for x in part.split("&"))
        return "".join(r.choice("0123456789abcdef") if x == "~" else r.choice("0123456789ABCDEF") if x == "^" else str(r.randrange(10)) if x == "#" else x for x in text)

    out, cases = [], templates()
    for i in range(rows):
        held, label, before, core, after = cases[i % len(cases)]
        left, own = f"{r.choice(_WORDS)} {made(before)}", made(core)
        out.append(json.dumps({"id": i, "held": held, "label": label, "low": len(left), "high": len(left) + len(own), "text": f"{left}{own}{made(after)} {r.choice(_WORDS)}"}))
    line = F.explode(F.split(F.lit("\n".join(out)), "\n"))
    return spark.range(1).select(line.alias("line")).select(F.from_json("line", "id long, held boolean, label double, low int, high int, text string").alias("x")).select("x.*")


def _tree(lines: list[str], at: int, f: Column) -> tuple[Column, int]:
    """Column of one tree from the lines of its printed form, and the line behind it."""
    if m := re.match(r"\s*Predict: (\S+)", lines[at]):
        return F.lit(float(m[1])), at + 1
    feature, value = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
    yes, at = _tree(lines, at + 1, f)
    no, at = _tree(lines, at + 1, f)  # skips the line of Else
    return F.when(f[int(feature)] <= float(value), yes).otherwise(no), at


class Trees:
    """Fitted boosted trees as an expression over a feature array, and a threshold for each further kind."""

    def __init__(self, text: str, weights: list[float], limits: dict[str, float]):
        self.text, self.weights, self.limits = text, weights, limits

    def score(self, f: Column) -> Column:
        """Probability that the span is personal data."""
        parts = [p.splitlines()[1:] for p in re.split(r"\n\s*Tree \d+", self.text)[1:]]
        margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree([x for x in p if x.strip()], 0, f)[0] for p, w in zip(parts, self.weights, strict=True)])
        return 1 / (1 + F.exp(-2 * margin))

    def selected(self, kind: Column, score: Column) -> Column:
        return F.coalesce(*[F.when(kind == KINDS.index(k), score >= v) for k, v in self.limits.items()], F.lit(False))


def fit(spark: SparkSession, rows: int = TRAIN_ROWS) -> Trees:
    """Fit the trees on generated rows; on rows of the held-out templates find each kind's least score with PRECISION.

    A candidate counts as personal data if it is the planted span, not a part of it or more. A kind for which no threshold
    reaches PRECISION is never selected, and a warning names it.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    given = candidates(training_rows(spark, rows), MORE_KINDS, ("id", "held", "label", "low", "high"))
    spans = given.select("own.*", F.explode(F.concat(*MORE_KINDS)).alias("span"))
    planted = (F.col("label") == 1) & (F.col("span.start") == F.col("low")) & (F.col("span.end") == F.col("high"))
    data = spans.select("id", "held", planted.cast("double").alias("label"), "span.kind", features(F.col("span")).alias("f")).coalesce(1)
    data, path = common.materialize(spark, data, "candidates")
    learn = data.where("not held").withColumn("features", array_to_vector("f")).select("features", "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=32).fit(learn)
    trees = Trees(model.toDebugString, list(model.treeWeights), {})
    bins = data.where("held").select("kind", "label", F.floor(trees.score(F.col("f")) * 100).alias("bin")).groupBy("kind", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    for i, kind in enumerate(KINDS):
        good = n = 0
        for r in sorted((r for r in bins if r["kind"] == i), key=lambda r: -r["bin"]):
            good, n = good + r["good"], n + r["n"]
            if good / n >= PRECISION and r["bin"] >= 50:
                trees.limits[kind] = r["bin"] / 100
    common.remove(spark, path)
    if never := [k for k in MORE_KINDS if k not in trees.limits]:
        warnings.warn(f"no threshold reaches the precision for {', '.join(never)}", stacklevel=2)
    return trees


_FAR = (1 << 31) - 1


def _clear_of(spans: Column, strict: Column) -> Column:
    """The spans that overlap no strict one, in order of their starts: a sweep from the left and one from the right."""
    mark = lambda xs, hard: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), F.lit(hard).alias("hard"), x.alias("span")))
    kind = f"struct<start:int,hard:boolean,span:{SPAN}>"
    none = F.array().cast(f"array<{kind}>")

    def left(a: Column, x: Column):
        return {"end": F.when(x["hard"], F.greatest(a["end"], x["span"]["end"])).otherwise(a["end"])}, F.when(x["hard"] | (a["end"] <= x["start"]), F.array(x)).otherwise(none)

    def right(a: Column, x: Column):
        return {"next": F.when(x["hard"], x["start"]).otherwise(a["next"])}, F.when(~x["hard"] & (x["span"]["end"] <= a["next"]), F.array(x["span"])).otherwise(F.array().cast(f"array<{SPAN}>"))

    both = F.array_sort(F.concat(mark(spans, False), mark(strict, True)))
    return F.reverse(sweep(F.reverse(sweep(both, {"end": F.lit(0)}, kind, left)), {"next": F.lit(_FAR)}, SPAN, right))


def _best(scored: Column) -> Column:
    """Of spans (with score, in order of their starts) that overlap, the best by score, then length, then place."""
    kind = f"struct<start:int,score:double,span:{SPAN}>"
    none, nothing = F.array().cast(f"array<{SPAN}>"), F.lit(None).cast(kind)
    size = lambda x: x["span"]["end"] - x["span"]["start"]

    def step(a: Column, x: Column):
        held = a["held"]
        better = (x["score"] > held["score"]) | ((x["score"] == held["score"]) & (size(x) > size(held)))
        meets = held.isNotNull() & (x["start"] < held["span"]["end"])
        return {"held": F.when(meets & ~better, held).otherwise(x)}, F.when(held.isNotNull() & ~meets, F.array(held["span"])).otherwise(none)

    last = F.struct(F.lit(_FAR).alias("start"), F.lit(0.0).alias("score"), F.lit(None).cast(SPAN).alias("span")).cast(kind)
    return sweep(F.array_append(scored, last), {"held": nothing}, SPAN, step)


def find(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of docs in `keep`, the text, the arrays of base spans by kind, and `more`: what the trees add.

    Spans are (kind number, start, end, raw): code points, end exclusive. A null text has none; repeated rows are
    searched each for itself; columns not in `keep` are dropped, and those in it may have any names.
    """
    base = candidates(docs, KINDS, keep)
    proposed = base.withColumn("p", F.concat(*MORE_KINDS))
    some = F.size("p") > 0
    clear = proposed.withColumn("p", F.when(some, _clear_of(F.col("p"), F.concat(*BASE_KINDS))))
    described = clear.withColumn("p", F.transform("p", lambda x: F.struct(x.alias("span"), features(x).alias("f"))))
    scored = described.withColumn("p", F.transform("p", lambda x: F.struct(x["span"]["start"].alias("start"), trees.score(x["f"]).alias("score"), x["span"].alias("span"))))
    chosen = scored.withColumn("p", F.filter("p", lambda x: trees.selected(x["span"]["kind"], x["score"])))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "raw")]))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,raw:string>>")
    more = F.when(some, F.array_sort(plain(_best(F.col("p"))))).otherwise(none)
    return chosen.select("own", "text", *[plain(F.col(k)).alias(k) for k in BASE_KINDS], more.alias("more"))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(found: DataFrame) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets (of a run, the first one's).

    A null text is empty; a text without spans stays as it is. Takes time in proportion to the text and its spans.
    """
    text, names = F.col("text"), F.array(*map(F.lit, KINDS))
    item = "struct<start:int,end:int,kind:int>"
    spans = F.array_sort(F.transform(F.concat(*BASE_KINDS, "more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    none = F.array().cast(f"array<{item}>")

    def merge(a: Column, x: Column):
        held = a["held"]
        meets = held.isNotNull() & (x["start"] < held["end"])
        longer = F.struct(held["start"].alias("start"), F.greatest(held["end"], x["end"]).alias("end"), held["kind"].alias("kind"))
        return {"held": F.when(meets, longer).otherwise(x).cast(item)}, F.when(held.isNotNull() & ~meets, F.array(held)).otherwise(none)

    end = F.struct(F.lit(_FAR).alias("start"), F.lit(_FAR).alias("end"), F.lit(0).alias("kind")).cast(item)
    runs = sweep(F.array_append(spans.cast(f"array<{item}>"), end), {"held": F.lit(None).cast(item)}, item, merge)

    def part(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, from its chunks: long texts are not searched from their beginning."""
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        across = F.concat(F.substr(chunk(i), a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(chunk(j), F.lit(1), b % CHUNK))
        return F.when(i == j, F.substr(chunk(i), a % CHUNK + 1, b - a)).otherwise(across)

    def rebuilt(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["runs"], i - 1)["end"]).otherwise(0)
        told = lambda r, i: F.concat(part(x["chunks"], before(i), r["start"]), F.lit("["), F.upper(F.element_at(names, r["kind"] + 1)), F.lit("]"))
        rest = part(x["chunks"], F.element_at(x["runs"], -1)["end"], x["n"])
        return F.concat(F.array_join(F.transform(x["runs"], told), ""), rest)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole = F.struct(runs.alias("runs"), chunks.alias("chunks"), F.length(text).alias("n"))
    return F.when(F.size(F.concat(*BASE_KINDS, "more")) > 0, _let(whole, rebuilt)).otherwise(text)


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), fit(spark))
    strict = F.concat(*BASE_KINDS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("own.doc_id", *counts, F.sha2(_told(strict), 256).alias("base_sha256"), _told(F.concat(strict, "more")).alias("spans"))
