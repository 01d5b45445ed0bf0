"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens. DataFrame functions only.

A token of letters and digits mixed is a secret when it looks drawn at random from its encoding's
alphabet (hex, base-36, base-62, base-64): chi-squared uniformity of its characters, a runs test
and a serial-correlation test, combined by Fisher's method into one p-value. How large that must
be depends on encoding and length: for every (encoding, length class) the share of ordinary words
(letters only, of that length) that pass is counted over all documents, and the lowest p-value is
taken at which expected false discoveries are at most ``FALSE_SHARE`` of the tokens that pass. Words of a
length class that are too few to tell (even none passing leaves a rate over FALSE_SHARE) give way to
those of the next shorter one, which pass more easily; where these cannot tell either, the level comes from the tests'
own null distribution: a token has to look more random than half of all random ones do.

Defined cases: a null text is an empty one and has no spans; repeated rows are judged each; an
empty table gives no rows; ``scan_secrets`` keeps the columns asked for, and columns with the names
of its own are replaced; ``redact_secrets`` keeps all columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.llm.spans import cover, find_spans, joined, kind_spans, overlaps
from aislegraph.session import cut_lineage

# The contract's patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
TOKEN_CHARS = 20
ALPHABETS = (16, 36, 62, 64)
LENGTH_CLASSES = (16, 20, 24, 32, 48)
LEVELS = (0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.001, 0.0001)
FALSE_SHARE = 0.05
MARK = "[SECRET]"
_OWN = ("assign", "access", "hex", "tokens", "random")


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of the fixed patterns that meet their conditions."""
    low = F.lower(text)
    said = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ASSIGN_WORDS])
    return {
        "assign": F.filter(find_spans(text, ASSIGN, said, 1), lambda s: F.length(s["inner"]) >= 6),
        "access": find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": find_spans(text, HEX),
    }


def _upper_tail(z: Column) -> Column:
    return 1 / (1 + F.exp(1.702 * z))


def _test(span: Column) -> Column:
    """What the tests need of one token, whatever the alphabet: length, sum of squared character
    counts, and the p-values of the runs and serial-correlation tests."""
    value = span["value"]
    n = F.length(value)
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    read = F.struct(span.alias("span"), n.alias("n"), codes.alias("x"), F.array_sort(codes).alias("sorted"))
    # A lambda works out a captured expression again for each element, so means are bound first.
    return _bound(_bound(read, _with_centre), _measure)


def _bound(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _with_centre(t: Column) -> Column:
    mean = F.aggregate(t["x"], F.lit(0.0), lambda a, v: a + v) / t["n"]
    middle = F.element_at(t["sorted"], (t["n"] / 2).cast("int") + 1)
    return F.struct(*[t[c].alias(c) for c in ("span", "n", "x", "sorted")], mean.alias("mean"), middle.alias("middle"))


def _measure(t: Column) -> Column:
    n, x, ordered, mean, middle = t["n"], t["x"], t["sorted"], t["mean"], t["middle"]
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, v: Column) -> Column:
        run = F.when(v == acc["last"], acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(v.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    squares = F.aggregate(ordered, start, step, lambda acc: acc["sum"])
    spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    left, right = F.slice(x, 1, n - 1), F.slice(x, F.lit(2), n - 1)
    both = F.aggregate(F.zip_with(left, right, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, v: a + v)
    serial = F.when(spread > 0, (both / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    high = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v >= middle).cast("int"))
    runs = 1 + F.aggregate(F.zip_with(left, right, lambda a, b: ((a >= middle) != (b >= middle)).cast("int")), F.lit(0.0), lambda a, v: a + v)
    pairs = 2 * high * (n - high)
    size = n.cast("double")
    variance = pairs * (pairs - size) / (size * size * (size - 1))
    z_runs = F.when(variance > 0, (runs - pairs / n - 1) / F.sqrt(variance)).otherwise(F.lit(9.0))
    two_sided = lambda z: F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0))
    return F.struct(
        t["span"]["start"].alias("start"), t["span"]["end"].alias("end"), n.alias("n"), squares.alias("squares"),
        F.greatest(two_sided(z_runs) * two_sided(serial), F.lit(1e-12)).alias("order"), _alphabet(t["span"]["value"]).alias("alphabet"),
    )


def _alphabet(value: Column) -> Column:
    """Size of the inferred encoding's alphabet; 0 for an ordinary word, -1 for anything else."""
    letters, digits = value.rlike("[A-Za-z]"), value.rlike("[0-9]")
    return (
        F.when(value.rlike("^[A-Za-z]+$"), 0)
        .when(~(letters & digits) | (F.length(value) < TOKEN_CHARS), -1)
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(value.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36)
        .when(value.rlike("^[0-9A-Za-z]+$"), 62)
        .otherwise(64)
    )


def random_p(token: Column, alphabet: int) -> Column:
    """Fisher's combination of the three tests for one alphabet."""
    n = token["n"].cast("double")
    chi = alphabet / n * token["squares"] - n
    z = (chi - (alphabet - 1)) / F.sqrt(2 * (alphabet - 1) * (n - 1) / n)
    p = F.greatest(_upper_tail(z), F.lit(1e-12)) * token["order"]
    half = -F.log(p)
    return p * (1 + half + half * half / 2)


def _length_class(token: Column) -> Column:
    return reduce(lambda out, k: F.when(token["n"] >= LENGTH_CLASSES[k], k).otherwise(out), range(1, len(LENGTH_CLASSES)), F.lit(0))


def _level(p: Column) -> Column:
    """Index of the first level that p reaches; len(LEVELS) for none."""
    return reduce(lambda out, k: F.when(p >= LEVELS[k], k).otherwise(out), reversed(range(len(LEVELS))), F.lit(len(LEVELS)))


def tells(words: list[int]) -> bool:
    """Whether so many words could show a pass rate of FALSE_SHARE."""
    return 1 / (sum(words) + 1) <= FALSE_SHARE


def thresholds(scanned: DataFrame) -> dict[tuple[int, int], float]:
    """Lowest accepted p-value by (alphabet, length class); counts cover all documents, and the table
    counted has at most alphabets x classes x levels rows."""
    tokens = scanned.select(F.explode("tokens").alias("t"))
    found: dict[tuple[int, int, bool], list[int]] = {}
    word = F.col("t.alphabet") == 0
    judged = [
        tokens.where((F.col("t.alphabet") == size) | word).select(
            F.lit(size).alias("alphabet"), _length_class(F.col("t")).alias("class"), word.alias("word"),
            # No ordinary word is hex, so base-36 stands in for it.
            _level(F.when(word, random_p(F.col("t"), max(size, 36))).otherwise(random_p(F.col("t"), size))).alias("level"),
        )
        for size in ALPHABETS
    ]
    rows = reduce(DataFrame.union, judged)
    for r in rows.groupBy("alphabet", "class", "word", "level").count().collect():
        found.setdefault((r["alphabet"], r["class"], r["word"]), [0] * (len(LEVELS) + 1))[r["level"]] += r["count"]
    out = {}
    for size in ALPHABETS:
        words = None
        for k in range(len(LENGTH_CLASSES)):
            own = found.get((size, k, True))
            words = own if own and tells(own) else words
            tokens_here = found.get((size, k, False))
            if tokens_here and words is None:
                out[size, k] = LEVELS[0]
            elif tokens_here:
                total = sum(tokens_here)
                for level in reversed(range(len(LEVELS))):
                    passing = sum(tokens_here[: level + 1])
                    rate = (sum(words[: level + 1]) + 1) / (sum(words) + 1)
                    if passing and rate * total / passing <= FALSE_SHARE:
                        out[size, k] = LEVELS[level]
                        break
    return out


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def judged(s: Column) -> Column:
        mixed = s["value"].rlike("[A-Za-z]") & s["value"].rlike("[0-9]") & (F.length(s["value"]) >= TOKEN_CHARS)
        return s["value"].rlike("^[A-Za-z]+$") | mixed

    tokens = F.transform(F.filter(find_spans(text, TOKEN), judged), _test)
    return docs.drop(*_OWN).withColumns({k: _places(v) for k, v in base_spans(text).items()} | {"tokens": tokens})


def _accepted(candidates: DataFrame, lowest: dict[tuple[int, int], float]) -> DataFrame:
    known = F.concat("assign", "access", "hex")

    def accept(t: Column) -> Column:
        checks = [(t["alphabet"] == size) & (_length_class(t) == k) & (random_p(t, size) >= p) for (size, k), p in sorted(lowest.items())]
        return reduce(lambda a, b: a | b, checks, F.lit(False)) & ~overlaps(t, known)

    return candidates.withColumn("random", _places(F.filter("tokens", accept))).drop("tokens")


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs with arrays of spans: assign, access, hex and random (start, end)."""
    candidates = cut_lineage(_candidates(docs).select(*keep, "assign", "access", "hex", "tokens"))
    return _accepted(candidates, thresholds(candidates))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    spans = {k: kind_spans(F.col(k), k, i) for i, k in enumerate(KINDS)}
    base = F.concat(*[spans[k] for k in KINDS[:3]])
    return scanned.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, spans["random"])).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )


def redact_secrets(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """The same columns, with every span replaced in the text (scanned twice, so that texts are not stored)."""
    lowest = thresholds(cut_lineage(_candidates(docs.select("text")).select("tokens")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # the input's columns may have any names
    scanned = _accepted(_candidates(rows), lowest)
    covered = cover(F.col("text"), F.concat("assign", "access", "hex", "random"), mark)
    return scanned.select(*[covered.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
