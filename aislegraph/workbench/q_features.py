"""Text columns over whole documents, titles, pages and prices."""

from pyspark.sql import functions as F

from aislegraph.functions import matching, numbers, text
from aislegraph.session import stored
from aislegraph.workbench import duck
from aislegraph.workbench.registry import query
from aislegraph.workbench.tables import load, view, with_views

LIST = "array_to_string({}, '|')"


def docs(spark, sf):
    return load(spark, sf, "documents")


def joined(col):
    return F.array_join(col, "|")


@query("title_norm", with_views("offers", f"""
    SELECT sku, {duck.norm('title')} AS norm FROM offers"""))
def title_norm(spark, sf):
    return view(spark, sf, "offers").select("sku", text.norm(F.col("title")).alias("norm"))


@query("document_norm", f"SELECT doc_id, md5({duck.norm('text')}) AS norm FROM documents")
def document_norm(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(text.norm(F.col("text"))).alias("norm"))


@query("fold", f"SELECT doc_id, md5({duck.fold(duck.norm('text'))}) AS folded FROM documents")
def fold(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(text.haystack(F.col("text"))).alias("folded"))


STEMS = f"list_transform({duck.words(duck.norm('{}'))}, lambda w: {duck.stem('w')})"


@query("stem", with_views("offers", f"""
    SELECT sku, {LIST.format(STEMS.replace('{}', 'title'))} AS stems FROM offers"""))
def stem(spark, sf):
    words = text.words(text.norm(F.col("title")))
    return view(spark, sf, "offers").select("sku", joined(text.stems_of(words)).alias("stems"))


@query("brand_key", with_views("products", f"""
    SELECT id, array_to_string(list_sort({duck.brand_keys(duck.norm('brand'))}), '|') AS keys
    FROM products"""))
def brand_key(spark, sf):
    keys = text.brand_keys(text.norm(F.col("brand")))
    return view(spark, sf, "products").select("id", joined(F.sort_array(keys)).alias("keys"))


@query("tokens", f"""
    SELECT doc_id, len(l) AS tokens, md5(array_to_string(l, '|')) AS digest FROM (
        SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(w), lambda t:
               {{'i': list_position(w, t), 't': t}})), lambda s: s.t) AS l
        FROM (SELECT doc_id, {duck.words(duck.norm('text'))} AS w FROM documents))""")
def tokens(spark, sf):
    words = text.tokens(text.norm(F.col("text")))
    return docs(spark, sf).select(
        "doc_id", F.size(words).cast("bigint").alias("tokens"), F.md5(joined(words)).alias("digest")
    )


@query("weighted_tokens", with_views("offers", f"""
    SELECT sku, s AS stem, {duck.weight('s')} AS weight, i AS ordinal FROM (
        SELECT sku, unnest(stems) AS s, generate_subscripts(stems, 1) AS i
        FROM (SELECT sku, {duck.feature_columns('title')} FROM offers))"""))
def weighted_tokens(spark, sf):
    toks = matching.weighted_tokens(text.tokens(text.norm(F.col("title"))))
    return view(spark, sf, "offers").select("sku", F.posexplode(toks).alias("p", "t")).select(
        "sku", "t.stem", "t.weight", (F.col("p") + 1).cast("bigint").alias("ordinal")
    )


@query("pack_size", with_views("offers", f"""
    SELECT sku, {duck.size_columns('title')} FROM offers"""))
def pack_size(spark, sf):
    size = text.size(F.col("title"))
    return view(spark, sf, "offers").select("sku", size.alias("s")).select(
        "sku", F.col("s.value").alias("size_value"), F.col("s.unit").alias("size_unit"),
        F.col("s.count").alias("size_count"),
    )


@query("percent", with_views("offers", f"""
    SELECT sku, {duck.percent('title')} AS pct FROM offers"""))
def percent(spark, sf):
    return view(spark, sf, "offers").select("sku", text.percent(F.col("title")).alias("pct"))


PASTED = """CASE WHEN product_ean IS NULL THEN title
     WHEN style = 0 THEN '  ' || substr(product_ean, 1, 3) || ' ' || substr(product_ean, 4) || ' '
     WHEN style = 1 THEN 'https://shop.example.com/product/' || product_ean || '?x=1'
     WHEN style = 2 THEN substr(product_ean, 1, 6) || '-' || substr(product_ean, 7)
     WHEN style = 3 THEN 'https://shop.example.com/products/a-' || product_ean || '/'
     ELSE product_ean END"""


@query("ean", with_views("offers", f""", pasted AS (SELECT sku, trim({PASTED}) AS s FROM offers)
    SELECT sku, CASE WHEN regexp_matches(s, '/product/[0-9]{{8,14}}(?:[/?#]|$)')
                     THEN regexp_extract(s, '/product/([0-9]+)', 1)
                WHEN regexp_full_match(regexp_replace(s, '[\\s-]', '', 'g'), '[0-9]{{8,14}}')
                     THEN regexp_replace(s, '[\\s-]', '', 'g') END AS ean FROM pasted"""))
def ean(spark, sf):
    return view(spark, sf, "offers").select("sku", text.ean_of(F.expr(PASTED)).alias("ean"))


@query("ean_valid", with_views("offers", """
    SELECT sku, coalesce(regexp_full_match(product_ean, '[0-9]{8,14}'), false) AS product_ok,
           regexp_full_match(sku, '[0-9]{8,14}') AS sku_ok FROM offers"""))
def ean_valid(spark, sf):
    from aislegraph.operators.filters import ean_valid as valid

    return view(spark, sf, "offers").select(
        "sku", valid(F.col("product_ean")).alias("product_ok"), valid(F.col("sku")).alias("sku_ok")
    )


@query("haystack", with_views("offers", f"""
    SELECT sku, {duck.fold(duck.norm("coalesce(brand, '') || ' ' || title"))} AS haystack
    FROM offers"""))
def haystack(spark, sf):
    shown = F.concat_ws(" ", "brand", "title")
    return view(spark, sf, "offers").select("sku", text.haystack(shown).alias("haystack"))


def _translit(x):
    a, b = text.GREEKLISH_SINGLE
    return (f"translate(replace(replace(replace({duck.strip_accents(x)}, 'θ', 'th'), 'ξ', 'ks'), "
            f"'ψ', 'ps'), '{a}', '{b}')")


@query("haystack_greeklish", with_views("products", f"""
    SELECT id, {duck.fold(f"lower({_translit('title')} || ' ' || {_translit('brand')} || ' ' || cast(id AS VARCHAR))")}
           AS haystack FROM products"""))
def haystack_greeklish(spark, sf):
    fields = [text.transliterate(F.col("title")), text.transliterate(F.col("brand")),
              F.lit(None).cast("string"), F.col("id").cast("string")]
    return view(spark, sf, "products").select("id", text.haystack_greeklish(*fields).alias("haystack"))


@query("query_terms", with_views("products", f"""
    SELECT id, {LIST.format(STEMS.replace('{}', "brand || ' ' || title"))} AS terms FROM products"""))
def query_terms(spark, sf):
    shown = F.concat_ws(" ", "brand", "title")
    return view(spark, sf, "products").select("id", joined(text.query_terms(shown)).alias("terms"))


@query("query_terms_greeklish", with_views("products", f"""
    SELECT id, array_to_string(list_transform(list_filter(
               string_split_regex({_translit('title')}, '\\s+'),
               lambda t: regexp_matches(t, '[a-z0-9]')), lambda t: {duck.fold('t')}), '|') AS terms
    FROM products"""))
def query_terms_greeklish(spark, sf):
    return view(spark, sf, "products").select(
        "id", joined(text.query_terms_greeklish(F.col("title"))).alias("terms")
    )


@query("query_no_digits", with_views("products", """
    SELECT id, array_to_string(list_filter(string_split_regex(title, '\\s+'),
               lambda t: t <> '' AND NOT regexp_matches(t, '[0-9%]')), ' ') AS stripped
    FROM products"""))
def query_no_digits(spark, sf):
    return view(spark, sf, "products").select(
        "id", text.query_without_digits(F.col("title")).alias("stripped")
    )


@query("query_min_length", with_views("products", """
    SELECT id, title, length(trim(substr(title, 1, id % 6 + 1))) >= 3 AS searchable,
           length(trim(substr(title, 1, id % 6 + 1))) >= 4 AS suggestible FROM products"""))
def query_min_length(spark, sf):
    from aislegraph.operators.filters import long_enough

    typed = F.substring("title", F.lit(1), (F.col("id") % 6 + 1).cast("int"))
    return view(spark, sf, "products").select(
        "id", "title", long_enough(typed, 3).alias("searchable"),
        long_enough(typed, 4).alias("suggestible"),
    )


WRITTEN = """CASE seq % 4
     WHEN 0 THEN replace(cast(price_piece AS {text}), '.', ',')
     WHEN 1 THEN cast(price_piece AS {text})
     WHEN 2 THEN '1.' || lpad(cast(seq % 1000 AS {text}), 3, '0') || ',5'
     ELSE 'n/a ' || unit_label END"""


@query("greek_number", with_views("captures", """
    SELECT listing_id, seq, CASE seq % 4 WHEN 0 THEN price_piece WHEN 1 THEN price_piece
           WHEN 2 THEN 1000 + seq % 1000 + 0.5 END AS value FROM captures"""))
def greek_number(spark, sf):
    written = F.expr(WRITTEN.format(text="string"))
    return view(spark, sf, "captures").select(
        "listing_id", "seq", numbers.greek_number(written).alias("value")
    )


@query("unit_label", with_views("captures", """
    SELECT listing_id, seq,
           CASE unit_label WHEN 'κιλό' THEN 'κιλό' WHEN 'λίτρο' THEN 'λίτρο' ELSE 'τεμ.' END
               AS kritikos,
           CASE unit_label WHEN 'κιλό' THEN 'κιλό' WHEN 'λίτρο' THEN 'λίτρο' ELSE 'τεμ' END
               AS masoutis,
           CASE unit_label WHEN 'κιλό' THEN 'κιλό' WHEN 'λίτρο' THEN 'λίτρο' ELSE 'τεμαχίου' END
               AS mymarket,
           CASE unit_label WHEN 'κιλό' THEN 'κιλό' WHEN 'λίτρο' THEN 'λίτρο' ELSE 'τεμάχιο' END
               AS galaxias,
           CASE unit_label WHEN 'κιλό' THEN 'κιλό' WHEN 'λίτρο' THEN 'λιτ' ELSE 'τεμ' END AS ab
    FROM captures"""))
def unit_label(spark, sf):
    def raw(kilo, litre, piece):
        return F.when(F.col("unit_label") == "κιλό", kilo).when(
            F.col("unit_label") == "λίτρο", litre).otherwise(piece)

    return view(spark, sf, "captures").select(
        "listing_id", "seq",
        numbers.unit_label_kritikos(raw("ΚΙΛ", "ΛΙΤ", "ΤΕΜ")).alias("kritikos"),
        numbers.unit_label_masoutis(raw("κιλ.", "λιτ", "τεμ")).alias("masoutis"),
        numbers.unit_label_mymarket(raw("Κιλού", "ΛΊΤΡΟΥ", "Τεμαχίου")).alias("mymarket"),
        numbers.unit_label_galaxias(raw("Κιλό", "Λίτρο", "Τεμάχιο")).alias("galaxias"),
        numbers.unit_label_ab(raw("κιλ", "λιτ", "τεμ")).alias("ab"),
    )


@query("unit_price_text", with_views("captures", """
    SELECT listing_id, seq, price_unit,
           CASE WHEN price_unit IS NOT NULL THEN CASE unit_label WHEN 'κιλό' THEN 'κιλό'
                WHEN 'λίτρο' THEN 'λίτρο' ELSE 'τεμ.' END END AS unit_label FROM captures"""))
def unit_price_text(spark, sf):
    amount = F.replace(F.col("price_unit").cast("string"), F.lit("."), F.lit(","))
    shown = F.concat(amount, F.lit(" € / "), F.col("unit_label"))
    price, label = numbers.unit_price_text(shown, numbers.unit_label_masoutis)
    return view(spark, sf, "captures").select(
        "listing_id", "seq", price.alias("price_unit"), label.alias("unit_label")
    )


@query("base_price_text", with_views("captures", """
    SELECT listing_id, seq, price_unit,
           CASE WHEN price_unit IS NOT NULL THEN CASE WHEN seq % 2 = 0 THEN 'κιλό'
                ELSE 'λίτρο' END END AS unit_label FROM captures"""))
def base_price_text(spark, sf):
    amount = F.replace(F.col("price_unit").cast("string"), F.lit("."), F.lit(","))
    unit = F.when(F.col("seq") % 2 == 0, "1 Kg = Από 99,90€ σε ").otherwise("1 Lt = ")
    price, label = numbers.base_price_text(F.concat(unit, amount, F.lit("€")))
    return view(spark, sf, "captures").select(
        "listing_id", "seq", price.alias("price_unit"), label.alias("unit_label")
    )


@query("cents_to_euro", """
    SELECT o_orderkey, floor(o_totalprice + 0.5) / 100 AS euro FROM orders""")
def cents_to_euro(spark, sf):
    return load(spark, sf, "orders").select(
        "o_orderkey", numbers.cents_to_euro(F.col("o_totalprice")).alias("euro")
    )


DECODED = ("replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), "
           "'&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')")


@query("markup_text", rf"""
    SELECT page_id, md5({DECODED.format("regexp_replace(html, '<[^>]+>', '', 'g')")}) AS plain,
           md5(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS clean,
           md5(regexp_replace(html, '[\x00-\x1f\x7f]', ' ', 'g')) AS no_control
    FROM pages""")
def markup_text(spark, sf):
    html = F.col("html")
    return load(spark, sf, "pages").select(
        "page_id", F.md5(text.decode_entities(text.strip_tags(html))).alias("plain"),
        F.md5(text.clean_name(html)).alias("clean"),
        F.md5(text.strip_control(html)).alias("no_control"),
    )


@query("title_features", with_views("offers", f"""
    SELECT sku, array_to_string(stems, '|') AS stems, array_to_string(list_sort(keys), '|') AS keys,
           size_value, size_unit, size_count, pct, {duck.variant_columns('stems')}
    FROM (SELECT sku, {duck.feature_columns("coalesce(brand || ' ', '') || title")} FROM offers)"""))
def title_features(spark, sf):
    shown = F.concat_ws(" ", "brand", "title")
    rows = stored(view(spark, sf, "offers").select("sku", shown.alias("t")), "shown")
    return matching.features_of_texts(
        rows, "t", joined("toks.stem").alias("stems"), joined(F.sort_array("keys")).alias("keys"),
        F.col("size.value").alias("size_value"), F.col("size.unit").alias("size_unit"),
        F.col("size.count").alias("size_count"), F.col("pct"),
        *[F.col("variants")[i].alias(f"v{i}") for i in range(3)],
    )
