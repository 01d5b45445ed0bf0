"""Text columns: script and diacritic folding, tokens, sizes, percentages, barcodes.

Every helper maps a Column to a Column with built-in expressions only, so a whole
feature table is one projection over its input and needs no shuffle.
"""

from __future__ import annotations

import sys
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def _every_char() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))


def _accent_table() -> tuple[str, str, str]:
    """Letters and what canonical decomposition leaves of them without diacritics, where that is one
    character, and all diacritics; over all of Unicode. Hangul stays composed on both sides of a comparison."""
    every = _every_char()
    marks = regex.findall(r"\p{Diacritic}", every)
    dropped = dict.fromkeys(map(ord, marks))
    source, target = [], []
    for char in every:
        if unicodedata.decomposition(char)[:1] not in ("", "<"):
            base = unicodedata.normalize("NFD", char).translate(dropped)
            if base != char and len(base) == 1:
                source.append(char)
                target.append(base)
    return "".join(source), "".join(target), "".join(m for m in marks if m not in set(source))


ACCENTED, UNACCENTED, DELETED_MARKS = _accent_table()
#: White space outside the ASCII class of Java's ``\s``.
WIDE_SPACES = "\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
#: The same as a regular expression, to find what may lie between words of a long text without translating it.
WIDE_SPACE = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Greek letters that look like a Latin capital, and final sigma.
HOMOGLYPHS = ("αβεζηικμνορτυχς", "abezhikmnoptyxσ")
# Phonetic Latin for the Greek letters left after the fold.
PHONETIC_SINGLE = ("γδλξπσφω", "gdlxpsfo")
PHONETIC_DOUBLE = (("θ", "th"), ("ψ", "ps"))
# Greek to greeklish.
GREEKLISH_SINGLE = ("αβγδεζηικλμνοπρσςτυφχω", "abgdezhiklmnoprsstyfxw")
GREEKLISH_DOUBLE = (("θ", "th"), ("ξ", "ks"), ("ψ", "ps"))
# Pack units.
UNIT_TO_BASE = {
    "kg": ("g", 1000), "gr": ("g", 1), "γρ": ("g", 1), "g": ("g", 1),
    "lt": ("ml", 1000), "l": ("ml", 1000), "ml": ("ml", 1), "τεμ": ("piece", 1),
}
UNITS = "kg|gr|g|lt|ml|l|τεμ|γρ"
NUMBER = r"\d+(?:[.,]\d+)?"
SIZE_REGEX = rf"({NUMBER})\s?({UNITS})(?![\p{{L}}\p{{N}}])"
MULTIPACK_REGEX = rf"(\d+)\s?[x×χ*]\s?({NUMBER})\s?({UNITS})(?![\p{{L}}\p{{N}}])"
PERCENT_REGEX = rf"({NUMBER})\s?%"
DISCOUNT_REGEX = "(εκπτωσ|προσφορ)"
DISCOUNT_REACH = 12


def replace_all(col: Column, pairs) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def plain_spaces(col: Column) -> Column:
    # Almost no text has any of them: a search that finds nothing costs far less than a translation.
    return F.regexp_replace(col, rf"(?=[\x{{A0}}\x{{1680}}-\x{{FEFF}}]){WIDE_SPACE}", " ")


#: White space that scripts on web pages trim, beyond what SQL's trim removes.
TRIMMED = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def full_trim(col: Column) -> Column:
    """Without any white space at either end: tabs, line ends and no-break spaces too."""
    return F.regexp_replace(col, rf"^{TRIMMED}++|(?<!{TRIMMED}){TRIMMED}++$", "")


def strip_accents(col: Column) -> Column:
    """Drop diacritics of an already lower-cased string."""
    return F.translate(col, ACCENTED + DELETED_MARKS, UNACCENTED)


def norm(col: Column) -> Column:
    """Lower case, no diacritics, homoglyphs to Latin, only letters/digits/spaces."""
    folded = F.translate(strip_accents(F.lower(col)), *HOMOGLYPHS)
    spaced = F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")
    return F.trim(spaced)


def fold(col: Column) -> Column:
    """Collapse vowel spellings that sound alike."""
    digraphs = replace_all(col, (("ei", "i"), ("oi", "i"), ("ai", "e")))
    return F.translate(digraphs, "hyω", "iio")


def stem_text(folded: Column) -> Column:
    """Strip one closing sigma from each word longer than three letters."""
    return F.regexp_replace(folded, r"(?<=[^ ]{3})σ(?= |$)", "")


def phonetic(col: Column) -> Column:
    return F.translate(replace_all(col, PHONETIC_DOUBLE), *PHONETIC_SINGLE)


def words(col: Column) -> Column:
    """Non-empty words of a single-spaced string."""
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(F.split(col, " "))


def tokens(normed: Column) -> Column:
    """Distinct words in first-occurrence order."""
    return F.array_distinct(words(normed))


def stems_of(token_array: Column) -> Column:
    """Stems aligned with a token array (a stem is never empty)."""
    return words(stem_text(fold(F.array_join(token_array, " "))))


def brand_keys(normed: Column) -> Column:
    """Distinct cross-script keys of the words of a normalised string."""
    return F.array_distinct(words(phonetic(stem_text(fold(normed)))))


def haystack(col: Column) -> Column:
    return fold(norm(col))


def query_terms(col: Column) -> Column:
    """Search terms of a free-text query, one per word, repeats kept."""
    return words(stem_text(fold(norm(col))))


def transliterate(col: Column) -> Column:
    plain = strip_accents(F.lower(col))
    return F.translate(replace_all(plain, GREEKLISH_DOUBLE), *GREEKLISH_SINGLE)


def query_terms_greeklish(col: Column) -> Column:
    parts = F.split(F.trim(plain_spaces(transliterate(col))), r"\s+")
    kept = F.filter(parts, lambda t: t.rlike("[a-z0-9]"))
    return F.transform(kept, fold)


def haystack_greeklish(*fields: Column) -> Column:
    return fold(F.lower(F.concat_ws(" ", *fields)))


def query_without_digits(col: Column) -> Column:
    parts = F.split(plain_spaces(col), r"\s+")
    kept = F.filter(parts, lambda t: (F.length(t) > 0) & ~t.rlike("[0-9%]"))
    return F.array_join(kept, " ")


def _unit_case(unit: Column, index: int) -> Column:
    out = None
    for name, base in UNIT_TO_BASE.items():
        value = F.lit(base[index])
        out = F.when(unit == name, value) if out is None else out.when(unit == name, value)
    return out


def js_round(col: Column) -> Column:
    """Round half up toward positive infinity, as the prices were rounded."""
    return F.floor(col + F.lit(0.5)).cast("double")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a let expression)."""
    return F.transform(F.array(value), body)[0]


def size(col: Column) -> Column:
    """Declared pack size: struct(value, unit, count), null when none.

    A multipack reading wins over a plain one; either way the hit is cut out of
    the title once and then taken apart.
    """

    def pick(title: Column) -> Column:
        return bind(
            F.regexp_extract(title, MULTIPACK_REGEX, 0),
            lambda multi: F.when(multi.rlike("^0*[1-9]"), multi).otherwise(
                F.regexp_extract(title, SIZE_REGEX, 0)
            ),
        )

    def take_apart(hit: Column) -> Column:
        pieces = F.struct(
            F.coalesce(F.regexp_extract(hit, r"^(\d+)\s?[x×χ*]", 1).try_cast("int"), F.lit(1)).alias("n"),
            F.translate(F.regexp_extract(hit, rf"({NUMBER})\s?\D+$", 1), ",", ".").cast("double").alias("m"),
            F.regexp_extract(hit, r"\D+$", 0).alias("u"),
        )
        parsed = bind(pieces, lambda p: bind(full_trim(p["u"]), lambda u: F.struct(
            (js_round(p["m"] * _unit_case(u, 1)) * p["n"]).alias("value"),
            _unit_case(u, 0).alias("unit"), p["n"].alias("count"),
        )))
        return F.when(hit != "", parsed)

    lowered = plain_spaces(strip_accents(F.lower(col)))
    return F.when(col.rlike("[0-9]"), bind(lowered, lambda t: bind(pick(t), take_apart)))


def percent(col: Column) -> Column:
    """First percentage that is not a discount, null when none.

    Piece i of the split is the text before match i, so offsets are running
    lengths; the two context windows are substrings around each match.
    """
    col = plain_spaces(col)
    found = F.struct(
        F.regexp_extract_all(col, F.lit(PERCENT_REGEX), 0).alias("hits"),
        F.split(col, PERCENT_REGEX, -1).alias("pieces"),
    )

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))

    def value_of(f: Column, hit: Column, i: Column) -> Column:
        start = total(F.slice(f["pieces"], 1, i + 1)) + total(F.slice(f["hits"], 1, i))
        left = F.substring(col, F.lit(1), start)
        lo = F.greatest(start - DISCOUNT_REACH, F.lit(0))
        window = F.substring(col, lo + 1, start - lo + F.length(hit) + DISCOUNT_REACH)
        discounted = F.rtrim(plain_spaces(left)).rlike("[-−‑]$") | strip_accents(F.lower(window)).rlike(
            DISCOUNT_REGEX
        )
        value = F.translate(F.regexp_extract(hit, NUMBER, 0), ",", ".")
        return F.when(~discounted, value.cast("double"))

    def first_good(f: Column) -> Column:
        judged = F.transform(f["hits"], lambda hit, i: value_of(f, hit, i))
        return F.try_element_at(F.filter(judged, lambda x: x.isNotNull()), F.lit(1))

    return F.when(F.contains(col, F.lit("%")), bind(found, first_good))


def ean_of(col: Column) -> Column:
    """Barcode in a pasted string: a product URL segment or bare digits."""
    trimmed = F.trim(plain_spaces(col))
    from_url = F.regexp_extract(trimmed, r"/product/(\d{8,14})(?:[/?#]|$)", 1)
    digits = F.regexp_replace(trimmed, r"[\s-]", "")
    return F.when(from_url != "", from_url).when(digits.rlike(r"^\d{8,14}$"), digits)


def is_ean(col: Column) -> Column:
    return col.rlike(r"^\d{8,14}$")


# --- markup cleaning --------------------------------------------------------

# Entities each storefront's pages decode; others stay as written.
BASIC_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
PAGE_ENTITIES = BASIC_ENTITIES + (("&nbsp;", " "),)
TILE_ENTITIES = BASIC_ENTITIES + (("&#039;", "'"),)


def decode_entities(col: Column, table=PAGE_ENTITIES) -> Column:
    """One left-to-right pass: the ampersand goes last, so nothing decodes twice."""
    return replace_all(col, table + (("&amp;", "&"),))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]+>", "")


def clean_name(col: Column) -> Column:
    return F.trim(F.regexp_replace(plain_spaces(col), r"\s+", " "))


def strip_control(col: Column) -> Column:
    return F.regexp_replace(col, "[\\x00-\\x1f\\x7f]", " ")
