"""Comparison features of product titles and the pairwise score over them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.functions import text
from aislegraph.model import BRAND_MISS_PENALTY, SIZE_MATCH_BONUS, SIZE_UNVERIFIED_PENALTY

MIN_FUZZY_LENGTH = 4
GENERIC_WEIGHT = 0.4
STOP_WEIGHT = 0.05

# Words that carry no identity, and words generic inside an aisle.
STOP_WORDS = "με και σε για από το τα του της"
GENERIC_WORDS = (
    "γάλα φρέσκο φρέσκια λιπαρά τυρί γιαούρτι χυμός νερό καφές ψωμί αναψυκτικό δημητριακά "
    "μπισκότα σνακ ρόφημα ελληνικό ελληνική παραδοσιακό παραδοσιακή κλασικό κλασική "
    "βιολογικό βιολογική νέο extra"
)
# Variant classes; words of different groups of one class contradict.
VARIANT_CLASSES = (
    ("πλήρες πλήρης", "ελαφρύ ελαφρύς light", "άπαχο άπαχη"),
    ("αγελαδινό", "κατσικίσιο γίδινο", "πρόβειο", "βουβαλίσιο"),
    ("αλεσμένος αλεσμένο", "κόκκοι κόκκος κόκκων", "στιγμιαίος στιγμιαίο instant"),
)
# Groups of interchangeable words.
SYNONYM_GROUPS = ("στραγγιστό στραγγισμένο", "ανθρακούχο αεριούχο ανθρακούχα αεριούχα")


def stem_words(words: str) -> list[str]:
    """Stems of a fixed word list, computed once while the plan is built."""
    out = []
    for word in words.split():
        plain = "".join(
            c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn"
        ).translate(str.maketrans(*text.HOMOGLYPHS))
        for old, new in (("ei", "i"), ("oi", "i"), ("ai", "e")):
            plain = plain.replace(old, new)
        plain = plain.translate(str.maketrans("hyω", "iio"))
        out.append(plain[:-1] if len(plain) > 3 and plain.endswith("σ") else plain)
    return out


def _choose(stem: Column, groups: list[list[str]]) -> Column:
    out = None
    for i, group in enumerate(groups):
        hit = stem.isin(*group)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


_SYNONYMS = [stem_words(g) for g in SYNONYM_GROUPS]
_VARIANTS = [[stem_words(g) for g in groups] for groups in VARIANT_CLASSES]


def weight(stem: Column) -> Column:
    return (
        F.when(stem.isin(*stem_words(STOP_WORDS)), F.lit(STOP_WEIGHT))
        .when(stem.isin(*stem_words(GENERIC_WORDS)), F.lit(GENERIC_WEIGHT))
        .otherwise(F.lit(1.0))
    )


def synonym_class(stem: Column) -> Column:
    return _choose(stem, _SYNONYMS)


def fuzzy_allowed(stem: Column) -> Column:
    """Words that may match one edit apart; digits demand exactness."""
    return (F.length(stem) >= MIN_FUZZY_LENGTH) & ~stem.rlike("[0-9]")


def weighted_tokens(words: Column) -> Column:
    """array<struct<stem, weight, fuzzy, syn>> in first-occurrence order, without
    bare numbers."""
    kept = F.filter(words, lambda t: ~t.rlike("^[0-9]+$"))
    return stem_tokens(text.stems_of(kept))


def stem_tokens(stems: Column) -> Column:
    """What every stem tells of itself."""
    return F.transform(
        stems,
        lambda s: F.struct(
            s.alias("stem"), weight(s).alias("weight"), fuzzy_allowed(s).alias("fuzzy"),
            synonym_class(s).alias("syn"),
        ),
    )


def variant_groups(stems: Column) -> Column:
    """Per class the group of its first word in the title, -1 when none."""

    def of_class(groups: list[list[str]]) -> Column:
        listed = F.array(*[F.lit(w) for group in groups for w in group])
        named = F.filter(F.transform(stems, lambda s: _choose(s, groups)), lambda g: g.isNotNull())
        first = F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(-1))
        return F.when(F.arrays_overlap(stems, listed), first).otherwise(F.lit(-1))

    return F.array(*[of_class(groups) for groups in _VARIANTS])


def title_features(
    frame: DataFrame, title: Column, gate_brand: Column | None = None,
    stored_value: Column | None = None, stored_unit: Column | None = None,
) -> DataFrame:
    """Feature table of any table with a title: one projection, no shuffle.

    ``gate_brand`` is the brand the *other* title must name; a stored size backs
    up a title without one.
    """
    normed = text.norm(title)
    step = frame.withColumns({"_title": title, "words": text.tokens(normed)})
    parsed = text.size(F.col("_title"))
    if stored_value is not None:
        usable = stored_value.isNotNull() & stored_unit.isin("g", "ml", "piece")
        stored = F.struct(stored_value.cast("double").alias("value"), stored_unit.alias("unit"),
                          F.lit(1).alias("count"))
        parsed = F.coalesce(parsed, F.when(usable, stored))
    gate = (
        text.brand_keys(text.norm(gate_brand)) if gate_brand is not None
        else F.array().cast("array<string>")
    )
    step = step.withColumns({
        "toks": weighted_tokens(F.col("words")),
        "keys": F.array_distinct(text.words(text.phonetic(text.stem_text(text.fold(
            F.array_join("words", " ")))))),
        "gate": gate,
        "size": parsed,
        "pct": text.percent(F.col("_title")),
    })
    return step.withColumn("variants", variant_groups(F.col("toks.stem"))).drop("_title")


def features_of_texts(rows: DataFrame, title: str, *measures: Column) -> DataFrame:
    """``rows`` without their ``title``, with ``measures`` of its features, worked out once a distinct text. Rows
    find what is told of their text by a digest of 16 bytes. ``rows`` are read twice."""
    digest = F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(title)), F.lit("")))).alias("_text")
    told = title_features(rows.select(title).distinct(), F.col(title)).select(digest, *measures)
    kept = [c for c in rows.columns if c != title]
    return rows.select(*kept, digest).join(told.hint("merge"), "_text").drop("_text")


FEATURES = ["words", "toks", "keys", "gate", "size", "pct", "variants"]


# --- pairwise comparison ---------------------------------------------------


def one_edit_apart(a: Column, b: Column) -> Column:
    """Equal, or one substitution, insertion, deletion or adjacent swap apart."""
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)),
            F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)),
        ) == b,
    )
    same_length = F.length(a) == F.length(b)
    return (F.levenshtein(a, b, 1) >= 0) | (same_length & (F.levenshtein(a, b, 2) == 2) & swapped)


def stems_equivalent(a: Column, b: Column) -> Column:
    """Equivalence of two token structs."""
    a_stem, b_stem = a["stem"], b["stem"]
    # One edit cannot change both ends of a word of four or more letters.
    ends = (F.left(a_stem, F.lit(1)) == F.left(b_stem, F.lit(1))) | (
        F.right(a_stem, F.lit(1)) == F.right(b_stem, F.lit(1))
    )
    near = (
        a["fuzzy"] & b["fuzzy"] & (F.abs(F.length(a_stem) - F.length(b_stem)) <= 1) & ends
        & one_edit_apart(a_stem, b_stem)
    )
    return (a_stem == b_stem) | F.coalesce(a["syn"] == b["syn"], F.lit(False)) | near


def total_weight(toks: Column) -> Column:
    return F.aggregate(toks, F.lit(0.0), lambda acc, t: acc + t["weight"])


def token_overlap(a: Column, b: Column) -> Column:
    """struct(shared, union) of two weighted token sets, matched greedily one to one in order."""
    numbered = F.transform(b, lambda t, i: F.struct(
        i.alias("i"), t["stem"].alias("stem"), t["weight"].alias("weight"),
        t["fuzzy"].alias("fuzzy"), t["syn"].alias("syn"),
    ))
    start = F.struct(numbered.alias("rest"), F.lit(0.0).alias("shared"))

    def step(acc: Column, token: Column) -> Column:
        hit = F.try_element_at(F.filter(acc["rest"], lambda t: stems_equivalent(token, t)), F.lit(1))
        return text.bind(hit, lambda m: F.struct(
            F.when(m.isNull(), acc["rest"])
            .otherwise(F.filter(acc["rest"], lambda t: t["i"] != m["i"])).alias("rest"),
            F.when(m.isNull(), acc["shared"])
            .otherwise(acc["shared"] + (token["weight"] + m["weight"]) / 2).alias("shared"),
        ))

    shared = F.aggregate(a, start, step, lambda acc: acc["shared"])
    every = total_weight(a) + total_weight(b)
    return text.bind(shared, lambda s: F.struct(s.alias("shared"), (every - s).alias("union")))


def fuzzy_jaccard(a: Column, b: Column) -> Column:
    """Weighted token-set similarity with greedy one-to-one matching in order."""
    return text.bind(token_overlap(a, b), lambda o: F.when(o["union"] == 0, F.lit(0.0)).otherwise(o["shared"] / o["union"]))


def brand_named(keys: Column, gate: Column) -> Column:
    """Every brand word is a word of the title; an empty brand passes."""
    return F.size(F.array_except(gate, keys)) == 0


def percent_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(True))


def size_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(
        (a["unit"] == b["unit"]) & (a["value"] == b["value"]) & (a["count"] == b["count"]),
        F.lit(True),
    )


def variants_compatible(a: Column, b: Column) -> Column:
    return ~F.exists(
        F.arrays_zip(a.alias("x"), b.alias("y")),
        lambda z: (z["x"] != -1) & (z["y"] != -1) & (z["x"] != z["y"]),
    )


def adjust_score(base: Column, matched: Column, unverified: Column, brand_missed: Column) -> Column:
    """Bonus and penalties in their fixed order; ``base`` is in the plan once."""

    def sized(base: Column) -> Column:
        score = F.when(matched, F.least(base + SIZE_MATCH_BONUS, F.lit(1.0))).otherwise(base)
        return F.when(unverified, F.greatest(score - SIZE_UNVERIFIED_PENALTY, F.lit(0.0))).otherwise(score)

    def named(score: Column) -> Column:
        return F.when(brand_missed, F.greatest(score - BRAND_MISS_PENALTY, F.lit(0.0))).otherwise(score)

    return text.bind(text.bind(base, sized), named)


def score_pairs(pairs: DataFrame, a: str, b: str, soft: Column | bool = False) -> DataFrame:
    """Gate and score rows holding two feature structs; gated rows are dropped.

    ``a`` is the shown title, ``b`` the candidate. With ``soft`` a missing brand
    costs score instead of dropping the row.
    """
    x, y = F.col(a), F.col(b)
    soft = F.lit(soft) if isinstance(soft, bool) else soft
    named = brand_named(x["keys"], y["gate"])
    gated = pairs.filter(
        (named | soft) & size_compatible(x["size"], y["size"])
        & percent_compatible(x["pct"], y["pct"]) & variants_compatible(x["variants"], y["variants"])
    )
    both = x["size"].isNotNull() & y["size"].isNotNull()
    one = x["size"].isNotNull() != y["size"].isNotNull()
    return gated.withColumns({
        "size_matched": both, "size_unverified": one, "brand_missed": ~named,
    }).withColumn("jaccard", fuzzy_jaccard(x["toks"], y["toks"])).withColumn(
        "score",
        adjust_score(F.col("jaccard"), F.col("size_matched"), F.col("size_unverified"),
                     F.col("brand_missed")),
    )


def pack(frame: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Fold the feature columns into one struct column."""
    return frame.select(*keep, F.struct(*FEATURES).alias(name))


def pack_to_move(frame: DataFrame, name: str, keep: list[str], gated: bool) -> DataFrame:
    """``pack`` as narrow as it can move with many pairs: stems as one string and, of pairs that are ``gated`` by brand, no keys."""
    keys = F.array().cast("array<string>") if gated else F.col("keys")
    return frame.select(*keep, F.struct(F.array_join("toks.stem", " ").alias("stems"), keys.alias("keys"), "size", "pct", "variants").alias(name))


def moved(packed: Column) -> Column:
    """The features that ``score_pairs`` reads, of a struct of ``pack_to_move``."""
    return packed.withField("toks", stem_tokens(text.words(packed["stems"])))
