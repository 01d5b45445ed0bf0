"""Text helpers of the check SQL, written for DuckDB."""

from aislegraph.functions import text
from aislegraph.functions.matching import (
    GENERIC_WORDS, STOP_WORDS, SYNONYM_GROUPS, VARIANT_CLASSES, stem_words,
)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip_accents(x: str) -> str:
    return f"translate(strip_accents(lower({x})), '^`´¨·¯¸', '')"


def norm(x: str) -> str:
    a, b = text.HOMOGLYPHS
    return (
        f"trim(regexp_replace(translate({strip_accents(x)}, '{a}', '{b}'), "
        r"'[^\p{L}\p{N}]+', ' ', 'g'))"
    )


def fold(x: str) -> str:
    return f"translate(replace(replace(replace({x}, 'ei', 'i'), 'oi', 'i'), 'ai', 'e'), 'hyω', 'iio')"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def distinct_words(x: str) -> str:
    """Distinct words in first-occurrence order."""
    w = words(x)
    return f"list_filter({w}, lambda t, i: list_position({w}, t) = i)"


def stem(word: str) -> str:
    return rf"regexp_replace({fold(word)}, '^(.{{3,}})σ$', '\1')"


def phonetic(x: str) -> str:
    a, b = text.PHONETIC_SINGLE
    return f"translate(replace(replace({x}, 'θ', 'th'), 'ψ', 'ps'), '{a}', '{b}')"


def brand_key(word: str) -> str:
    return phonetic(stem(word))


def brand_keys(x: str) -> str:
    return f"list_distinct(list_transform({words(x)}, lambda w: {brand_key('w')}))"


def weight(stem_: str) -> str:
    return (
        f"CASE WHEN {stem_} IN ({quoted(stem_words(STOP_WORDS))}) THEN 0.05::DOUBLE "
        f"WHEN {stem_} IN ({quoted(stem_words(GENERIC_WORDS))}) THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END"
    )


def synonym(stem_: str) -> str:
    arms = " ".join(
        f"WHEN {stem_} IN ({quoted(stem_words(g))}) THEN {i}" for i, g in enumerate(SYNONYM_GROUPS)
    )
    return f"CASE {arms} END"


def variant(stems: str, index: int) -> str:
    arms = " ".join(
        f"WHEN s IN ({quoted(stem_words(g))}) THEN {i}" for i, g in enumerate(VARIANT_CLASSES[index])
    )
    return (
        f"coalesce(list_filter(list_transform({stems}, lambda s: CASE {arms} END), "
        "lambda g: g IS NOT NULL)[1], -1)"
    )


def plain_spaces(x: str) -> str:
    return f"regexp_replace({x}, '[\\x{{a0}}\\x{{202f}}\\x{{2007}}]', ' ', 'g')"


_UNITS = "(kg|gr|g|lt|ml|l|τεμ|γρ)(?:[^\\p{L}\\p{N}]|$)"
_NUMBER = "([0-9]+(?:[.,][0-9]+)?)"
SINGLE = f"{_NUMBER}\\s?{_UNITS}"
MULTI = f"([0-9]+)\\s?[x×χ*]\\s?{_NUMBER}\\s?{_UNITS}"


def _factor(unit: str) -> str:
    return f"CASE WHEN {unit} IN ('kg', 'lt', 'l') THEN 1000 ELSE 1 END"


def _base(unit: str) -> str:
    return (
        f"CASE WHEN {unit} IN ('kg', 'gr', 'γρ', 'g') THEN 'g' WHEN {unit} = 'τεμ' THEN 'piece' "
        "ELSE 'ml' END"
    )


def size_columns(title: str) -> str:
    """``size_value, size_unit, size_count`` of a title column."""
    t = plain_spaces(strip_accents(title))
    count = f"try_cast(regexp_extract({t}, '{MULTI}', 1) AS INT)"
    multi_unit = f"regexp_extract({t}, '{MULTI}', 3)"
    one_unit = f"regexp_extract({t}, '{SINGLE}', 2)"

    def amount(pattern: str, group: int, unit: str) -> str:
        number = f"try_cast(replace(regexp_extract({t}, '{pattern}', {group}), ',', '.') AS DOUBLE)"
        return f"floor({number} * {_factor(unit)} + 0.5)"

    is_multi = f"{multi_unit} <> '' AND {count} > 0"
    return (
        f"CASE WHEN {is_multi} THEN {amount(MULTI, 2, multi_unit)} * {count} "
        f"WHEN {one_unit} <> '' THEN {amount(SINGLE, 1, one_unit)} END AS size_value, "
        f"CASE WHEN {is_multi} THEN {_base(multi_unit)} WHEN {one_unit} <> '' THEN {_base(one_unit)} "
        f"END AS size_unit, "
        f"CASE WHEN {is_multi} THEN {count} WHEN {one_unit} <> '' THEN 1 END AS size_count"
    )


PCT = "[0-9]+(?:[.,][0-9]+)?\\s?%"


def percent(title: str) -> str:
    """First percentage without a minus in front (the test titles hold no discount words)."""
    hits, pieces = f"regexp_extract_all({title}, '{PCT}')", f"string_split_regex({title}, '{PCT}')"
    good = (
        f"list_filter({hits}, lambda h, i: NOT regexp_matches({pieces}[i], '[-−‑]\\s*$'))"
    )
    return f"try_cast(replace(regexp_extract({good}[1], '[0-9]+(?:[.,][0-9]+)?'), ',', '.') AS DOUBLE)"


def damerau_ok(a: str, b: str) -> str:
    return (
        f"(length({a}) >= 4 AND length({b}) >= 4 AND abs(length({a}) - length({b})) <= 1 "
        f"AND NOT regexp_matches({a} || {b}, '[0-9]') AND damerau_levenshtein({a}, {b}) <= 1)"
    )


def equivalent(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR coalesce({synonym(a)} = {synonym(b)}, false) OR {damerau_ok(a, b)})"
    )


def feature_columns(title: str, prefix: str = "") -> str:
    """Token list, stems, brand keys, size, percentage and variants of a title."""
    w = distinct_words(norm(title))
    stems = f"list_transform(list_filter({w}, lambda t: NOT regexp_full_match(t, '[0-9]+')), lambda t: {stem('t')})"
    return (
        f"{stems} AS {prefix}stems, {brand_keys(norm(title))} AS {prefix}keys, "
        f"{size_columns(title).replace('AS size_', f'AS {prefix}size_')}, {percent(title)} AS {prefix}pct"
    )


def variant_columns(stems: str, prefix: str = "") -> str:
    return ", ".join(f"{variant(stems, i)} AS {prefix}v{i}" for i in range(3))
