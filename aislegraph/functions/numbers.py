"""Price and unit columns: localised numbers, cents, unit labels, unit-price text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aislegraph.functions.text import WIDE_SPACE, bind, js_round, plain_spaces

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_or_null(col: Column) -> Column:
    """Text to double; blank text is zero, anything not a number is null."""
    return bind(F.trim(plain_spaces(col)), plain_number)


def plain_number(text: Column) -> Column:
    return F.when(text == "", F.lit(0.0)).when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def greek_number(col: Column) -> Column:
    """With a comma present dots group thousands, otherwise the dot is decimal."""
    # Each step is worked out once, whatever it costs to find the text.
    return bind(bind(F.trim(plain_spaces(col)), greek_plain), plain_number)


def greek_plain(text: Column) -> Column:
    """A trimmed Greek number as a plain one; for columns that cost nothing to read again."""
    comma_form = F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    return F.when(F.contains(text, F.lit(",")), F.trim(comma_form)).otherwise(text)


def cents_to_euro(col: Column) -> Column:
    return js_round(col.cast("double")) / F.lit(100.0)


def to_cents(col: Column) -> Column:
    """Round a euro amount to whole cents."""
    return js_round(col * F.lit(100.0)) / F.lit(100.0)


def round6(col: Column) -> Column:
    return F.floor(col * F.lit(1000000.0) + F.lit(0.5)) / F.lit(1000000.0)


def _mapped(col: Column, table: dict[str, str], default: Column) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default)


def unit_label_kritikos(col: Column) -> Column:
    labels = {"ΚΙΛ": "κιλό", "ΛΙΤ": "λίτρο", "ΤΕΜ": "τεμ."}
    return F.when(F.length(col) > 0, _mapped(col, labels, F.lower(col)))


def unit_label_masoutis(col: Column) -> Column:
    return (
        F.when(F.startswith(col, F.lit("κιλ")), "κιλό")
        .when(F.startswith(col, F.lit("λιτ")), "λίτρο")
        .otherwise(col)
    )


def unit_label_mymarket(col: Column) -> Column:
    low = F.lower(col)
    return _mapped(low, {"κιλού": "κιλό", "λίτρου": "λίτρο"}, low)


def unit_label_galaxias(col: Column) -> Column:
    return F.when(F.length(col) > 0, F.lower(col))


def unit_label_ab(col: Column) -> Column:
    """Only the kilo abbreviation is expanded; the litre one stays as written."""
    return F.when(col == "κιλ", "κιλό").otherwise(col)


UNIT_PRICE_REGEX = r"([\d.,]+)\s*€\s*/\s*(\S+)"


def unit_price_text(col: Column, label) -> tuple[Column, Column]:
    """``12,30 € / label`` to (price, label)."""
    def taken(group: int) -> Column:
        return F.nullif(F.regexp_extract(plain_spaces(col), UNIT_PRICE_REGEX, group), F.lit(""))

    price = bind(F.when(taken(2).isNotNull(), taken(1)), greek_number)
    return price, bind(taken(2), lambda unit: F.when(unit.isNotNull(), label(unit)))


BASE_PRICE_REGEX = r"1\s*(Kg|kg|Lt|lt|L|l)\s*=([^<]*)"


def base_price_text(col: Column) -> tuple[Column, Column]:
    """``1 Kg = … 9,30€``: the last euro amount is the one paid."""
    # The hit is cut out once and then taken apart.
    def last(hit: Column) -> Column:
        amounts = F.regexp_extract_all(
            F.regexp_extract(hit, BASE_PRICE_REGEX, 2), F.lit(r"(\d[\d.,]*)\s*€"), 1
        )
        return F.try_element_at(amounts, F.lit(-1))

    def label(hit: Column) -> Column:
        kilo = F.lower(F.substring(F.regexp_extract(hit, BASE_PRICE_REGEX, 1), 1, 1)) == "k"
        return F.when(last(hit).isNotNull(), F.when(kilo, "κιλό").otherwise("λίτρο"))

    hit = plain_spaces(F.regexp_extract(col, BASE_PRICE_REGEX.replace(r"\s", rf"(?:\s|{WIDE_SPACE})"), 0))
    return bind(hit, lambda h: greek_number(last(h))), bind(hit, label)


def size_label(value: Column, unit: Column) -> Column:
    whole = F.when(value == F.floor(value), F.floor(value).cast("string"))
    shown = F.coalesce(whole, value.cast("string"))
    return F.when(value.isNotNull(), F.concat(shown, F.coalesce(unit, F.lit(""))))


def unit_price_label(price: Column, label: Column) -> Column:
    """Decimal-comma price with its unit, null without a unit price."""
    amount = F.translate(F.format_number(price, 2), ",.", ".,")
    suffix = F.when(F.length(label) > 0, F.concat(F.lit("/"), label)).otherwise("")
    return F.when(price.isNotNull(), F.concat(amount, F.lit(" €"), F.coalesce(suffix, F.lit(""))))
