"""Personal data: fixed patterns, and candidates judged by gradient-boosted trees. DataFrame functions only.

High-recall generators propose overlapping spans (anything around an at sign, plain or spelt out;
any group of digits, also without a plus). Each proposal becomes a small vector of format and
context features. The trees learn which proposals are personal data from the fixed patterns'
own matches, seen only through these features, so they also score proposals that the patterns
miss. Training uses counts of every distinct feature vector over all documents: their number is
bounded by the features' ranges, so what reaches the driver does not grow with the corpus.
Documents of one hash fold are left out of the boosting; on their counts the threshold of each
kind is set to the lowest score from which precision is at least ``PRECISION``.

Defined cases: a null text is an empty one and has no spans; repeated rows are judged each; an
empty table gives no rows; with no example of either class nothing is added; ``find_personal_data``
keeps the columns asked for, and columns with the names of its own are replaced; ``redact_personal_data``
keeps all columns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.llm.spans import cover, find_spans, joined, kind_spans, overlaps
from aislegraph.session import cut_lineage

# The contract's patterns, with possessive repeats, which match the same.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

AT = rf"(?:\G|(?<!{LOCAL})){LOCAL}++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+"
DIGITS = r"[+(]?[0-9](?:[\x20().+/-]{0,2}[0-9]){6,}+"
CONTEXT = 16
ROUNDS = 40
RATE = 0.3
PRECISION = 0.95
FOLDS = 4
MARK = "[PRIVATE]"
_OWN = (*KINDS, "proposals", "boosted")
#: Feature names and how many values each has.
FEATURES = {"shape": 2, "digits": 6, "groups": 5, "plus": 2, "dots": 5, "checks": 2, "octets": 2, "word": 5, "before": 3, "after": 3, "spelt": 2}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check-digit rule of payment cards."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + term(i))
    return (n > 0) & (total % 10 == 0)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _between(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of the fixed patterns that meet their conditions."""
    return {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(find_spans(text, IP), lambda s: _octets(s["value"])),
        "card": F.filter(find_spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda s: _between(s["value"], 13, 19) & _luhn(_digits(s["value"]))),
        "phone": F.filter(find_spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: _between(s["value"], 9, 15)),
    }


def _step(value: Column, bounds: tuple[int, ...]) -> Column:
    """How many of the bounds the value reaches."""
    return reduce(lambda a, b: a + (value >= b).cast("int"), bounds, F.lit(0))


def _proposal(text: Column, span: Column, shape: int) -> Column:
    value = span["value"]
    digits = _digits(value)
    start = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, start + 1, span["start"] - start))
    last, first = F.substring(text, span["start"], F.when(span["start"] > 0, 1).otherwise(0)), F.substring(text, span["end"] + 1, F.lit(1))
    side = lambda c: F.when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike(r"[._/:=#$%&*@-]"), 1).otherwise(0)
    word = F.when(before.rlike("mail|contact|write"), 1).when(before.rlike("tel|phone|call|mobil|fax"), 2).when(before.rlike("card|visa|iban|account|pay"), 3).when(before.rlike(r"\bip\b|host|server|addr"), 4).otherwise(0)
    features = {
        "shape": F.lit(shape), "digits": _step(F.length(digits), (1, 7, 9, 13, 16)), "groups": _step(F.size(F.split(F.trim(F.regexp_replace(value, "[^0-9]+", " ")), " ")), (2, 3, 4, 5)),
        "plus": value.startswith("+").cast("int"), "dots": _step(F.length(value) - F.length(F.replace(value, F.lit("."), F.lit(""))), (1, 2, 3, 4)),
        "checks": (F.length(digits).between(13, 19) & _luhn(digits)).cast("int"), "octets": (value.rlike("^[0-9]+(?:[.][0-9]+){3}$") & _octets(value)).cast("int"),
        "word": word, "before": side(last), "after": side(first), "spelt": value.rlike(r"[\[(]").cast("int"),
    }
    vector = F.struct(*[features[k].cast("int").alias(k) for k in FEATURES])
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), vector.alias("x"))


def _candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = base_spans(text)
    at_sign = F.contains(text, F.lit("@")) | text.rlike(r"[\[(]at[\])]")
    proposals = F.concat(
        F.transform(find_spans(text, AT, at_sign), lambda s: _proposal(text, s, 1)), F.transform(find_spans(text, DIGITS), lambda s: _proposal(text, s, 0))
    )
    out = docs.drop(*_OWN).withColumns({k: _places(v) for k, v in base.items()} | {"proposals": proposals})
    return out


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _known() -> Column:
    return F.concat(*KINDS)


def vector_counts(candidates: DataFrame) -> list[tuple[dict[str, int], bool, bool, int]]:
    """(features, label, in the fold left out, how many) of all proposals of all documents."""
    labelled = F.transform("proposals", lambda p: F.struct(p["x"].alias("x"), overlaps(p, _known()).alias("label")))
    rows = candidates.select(F.explode(labelled).alias("p"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("out"))
    counted = rows.groupBy("p.x", "p.label", "out").count().collect()  # at most the product of FEATURES' ranges, times 4
    return [(r["x"].asDict(), r["label"], r["out"], r["count"]) for r in counted]


Tree = tuple[str, int, tuple[str, int, float, float], tuple[str, int, float, float]]


def _best_split(rows: list, names: list[str]) -> tuple[float, str, int, float, float]:
    """Newton gain of the best split by one feature; its leaves."""
    best = (-1.0, names[0], -1, 0.0, 0.0)
    leaf = lambda g, h: g / (h + 1.0)
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    for name in names:
        by: dict[int, list[float]] = {}
        for x, g, h in rows:
            cell = by.setdefault(x[name], [0.0, 0.0])
            cell[0] += g
            cell[1] += h
        left_g = left_h = 0.0
        for value in sorted(by)[:-1] or sorted(by):
            left_g, left_h = left_g + by[value][0], left_h + by[value][1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g * leaf(left_g, left_h) + right_g * leaf(right_g, right_h)
            if gain > best[0] + 1e-12:
                best = (gain, name, value, leaf(left_g, left_h), leaf(right_g, right_h))
    return best


def boost(counts: list[tuple[dict[str, int], bool, int]]) -> tuple[float, list[Tree]]:
    """Logistic boosting of trees of depth two on weighted feature vectors."""
    names = list(FEATURES)
    good, total = sum(n for _, y, n in counts if y), sum(n for *_, n in counts)
    prior = math.log((good + 0.5) / (total - good + 0.5))
    scores, trees = [prior] * len(counts), []
    for _ in range(ROUNDS):
        rows = []
        for (x, y, n), s in zip(counts, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, n * (y - p), n * p * (1 - p)))
        _, name, cut, *_ = _best_split(rows, names)
        sides = []
        for own in ([r for r in rows if r[0][name] <= cut], [r for r in rows if r[0][name] > cut]):
            sides.append(_best_split(own, names)[1:] if own else (names[0], 0, 0.0, 0.0))
        tree: Tree = (name, cut, sides[0], sides[1])
        trees.append(tree)
        scores = [s + RATE * tree_value(tree, x) for s, (x, *_) in zip(scores, counts, strict=True)]
    return prior, trees


def tree_value(tree: Tree, x: dict[str, int]) -> float:
    name, cut, low, high = tree
    inner, at, a, b = low if x[name] <= cut else high
    return a if x[inner] <= at else b


def score_column(prior: float, trees: list[Tree], x: Column) -> Column:
    def value(tree: Tree) -> Column:
        name, cut, low, high = tree
        side = lambda s: F.when(x[s[0]] <= s[1], RATE * s[2]).otherwise(RATE * s[3])
        return F.when(x[name] <= cut, side(low)).otherwise(side(high))

    return reduce(lambda a, t: a + value(t), trees, F.lit(prior))


def learn(counts: list[tuple[dict[str, int], bool, bool, int]]) -> tuple[float, list[Tree], dict[int, float]] | None:
    """The boosted trees and the lowest accepted score of each shape, or None without examples of both classes."""
    fit = sorted(((x, y, n) for x, y, out, n in counts if not out), key=lambda r: (list(r[0].values()), r[1]))
    if len({y for _, y, _ in fit}) < 2:
        return None
    prior, trees = boost(fit)
    lowest = {}
    for shape in range(FEATURES["shape"]):
        held = sorted(((prior + sum(RATE * tree_value(t, x) for t in trees), y, n) for x, y, out, n in counts if out and x["shape"] == shape), key=lambda r: -r[0])
        good = seen = 0
        for k, (s, y, n) in enumerate(held):
            good, seen = good + n * y, seen + n
            if (k + 1 == len(held) or held[k + 1][0] < s) and good >= PRECISION * seen:
                lowest[shape] = s
    return prior, trees, lowest


def _accepted(candidates: DataFrame, model: tuple[float, list[Tree], dict[int, float]] | None) -> DataFrame:
    if model is None or not model[2]:
        return candidates.withColumn("boosted", F.array().cast("array<struct<start:int,end:int>>")).drop("proposals")
    prior, trees, lowest = model

    def accept(p: Column) -> Column:
        score = score_column(prior, trees, p["x"])
        return reduce(lambda a, b: a | b, [(p["x"]["shape"] == k) & (score >= s - 1e-9) for k, s in lowest.items()]) & ~overlaps(p, _known())

    return candidates.withColumn("boosted", _places(F.filter("proposals", accept))).drop("proposals")


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs (doc_id among them) with arrays of spans: email, ip, card, phone and boosted."""
    candidates = cut_lineage(_candidates(docs.select(*dict.fromkeys((*keep, "text")))).select(*keep, *KINDS, "proposals"))
    return _accepted(candidates, learn(vector_counts(candidates)))


def personal_data_digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    spans = {k: kind_spans(F.col(k), k, i, by_start=False) for i, k in enumerate((*KINDS, "boosted"))}
    base = F.concat(*[spans[k] for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, spans["boosted"])).alias("spans"), F.size("boosted").cast("long").alias("n_boosted"),
    )


def redact_personal_data(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The same columns, with every span replaced in the text (searched twice, so that texts are not stored)."""
    model = learn(vector_counts(cut_lineage(_candidates(docs.select("doc_id", "text")).select("doc_id", *KINDS, "proposals"))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # the input's columns may have any names
    found = _accepted(_candidates(rows), model)
    covered = cover(F.col("text"), F.concat(*KINDS, "boosted"), mark)
    return found.select(*[covered.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
