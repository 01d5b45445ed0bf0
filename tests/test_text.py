import itertools
import random

import pytest
from pyspark.sql import functions as F

from aislegraph.functions import matching, numbers, text


def column(spark, values, fn, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(fn(F.col("v"))).collect()]


def test_norm_folds_scripts_and_accents(spark):
    titles = ["HEALTHY HABITS | Δημητριακά Μαύρη Σοκολάτα 350g", "ΝΟΥΝΟΥ", "NOYNOY", "Ελληνικός", "Ελληνικοσ", "a^b·c"]
    got = column(spark, titles, text.norm)
    assert got[0] == "healthy habits δhmhtpiaka mayph σokoλata 350g"
    assert got[1] == got[2] and got[3] == got[4] and got[5] == "abc"


def test_fold_joins_like_sounding_spellings_only(spark):
    a, b, c, d = column(spark, ["Φυστικοβούτυρο", "Φιστικοβούτυρο", "ζουμί", "ζυμή"], text.haystack)
    assert a == b and c != d


@pytest.mark.parametrize("title,expected", [
    ("Granola 350g", (350, "g", 1)), ("Ρύζι 1kg", (1000, "g", 1)), ("Γάλα 1,5lt", (1500, "ml", 1)),
    ("no size here", None), ("Φρουί Ζελέ 20γρ.", (20, "g", 1)), ("ΨΩΜΙ ΤΟΣΤ 680ΓΡ", (680, "g", 1)),
    ("Αυγά 6 τεμ", (6, "piece", 1)), ("Μπάρες 5x42g", (210, "g", 5)), ("γάλα 4*250ML", (1000, "ml", 4)),
    ("Κρουασάν 3 χ 100γρ", (300, "g", 3)), ("Νερό 6x1,5lt", (9000, "ml", 6)), ("Νερό 2,01L", (2010, "ml", 1)),
    ("350 g", (350, "g", 1)), ("0x500g", (500, "g", 1)), ("12 gramma", None),
])
def test_size(spark, title, expected):
    (got,) = column(spark, [title], text.size)
    assert (None if got is None else (got.value, got.unit, got["count"])) == expected


def test_percent_skips_discounts(spark):
    titles = ["Γάλα 3,5% Λιπαρά", "Γάλα 1.5 % ", "Granola 350g", "-20% 3,5% 1lt", "Έκπτωση 20% γάλα",
              "20% προσφορά", "− 20% 2%", "Έκπτωση πολύ μακριά από το 20%", "1.234,5%"]
    assert column(spark, titles, text.percent) == [3.5, 1.5, None, 3.5, None, None, 2.0, 20.0, 234.5]


def test_ean(spark):
    pasted = ["5202535179175", "  520 2535 179175 ", "https://galaxias.shop/product/5202535179175?utm=x",
              "https://kritikos-sm.gr/products/a/tomates-1505/", "not a barcode", ""]
    code = "5202535179175"
    assert column(spark, pasted, text.ean_of) == [code, code, code, None, None, None]


def test_greek_number(spark):
    written = ["3,14", "1.234,56", "2.15", "garbage", "1d", "", "1,2,3", "."]
    assert column(spark, written, numbers.greek_number) == [3.14, 1234.56, 2.15, None, None, 0.0, None, None]


def test_greeklish(spark):
    got = column(spark, ["ψωμί & τοστ", "   ", "ΓΙΩΤΗΣ Φρουί"], text.query_terms_greeklish)
    assert got == [["pswmi", "tost"], [], ["giwtis", "froii"]]
    assert column(spark, ["Λαχανικά", "ΓΙΩΤΗΣ Ξύδι"], text.transliterate) == ["laxanika", "giwths ksydi"]


def test_base_price_text(spark):
    frame = spark.createDataFrame([("1 kg = Από 11,30€ σε 9,30€",), ("1 Lt = 2,15€",), ("500 g",)], "v string")
    price, label = numbers.base_price_text(F.col("v"))
    assert [tuple(r) for r in frame.select(price, label).collect()] == [
        (9.3, "κιλό"), (2.15, "λίτρο"), (None, None)]


def test_brand_words_need_token_boundaries(spark):
    rows = [("Βιολογικό Γιαούρτι", "ΒΙΟ", False), ("FAGE Total", "ΦΑΓΕ", True), ("COCA COLA Can", "Coca-Cola", True),
            ("anything", "", True)]
    frame = spark.createDataFrame(rows, "t string, b string, want boolean")
    named = matching.brand_named(text.brand_keys(text.norm(F.col("t"))), text.brand_keys(text.norm(F.col("b"))))
    assert all(r.want == r.got for r in frame.withColumn("got", named).collect())


def _edit_distance_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    cuts = lambda w: {w[:i] + w[i + 1:] for i in range(len(w))}
    if len(a) != len(b):
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return short in cuts(long)
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 1 or (
        len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]])


def test_edit_distance_join_equals_brute_force(spark):
    from aislegraph.operators.linking import edit_distance_join

    rng = random.Random(7)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(250)})
    frame = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    got = {(r.a, r.b) for r in edit_distance_join(frame, frame).collect()}
    assert got == {(a, b) for a, b in itertools.product(vocabulary, repeat=2) if _edit_distance_one(a, b)}


def test_fuzzy_jaccard_equals_greedy_by_hand(spark):
    rng = random.Random(11)
    pool = ["γaλa", "γaλo", "abcd", "abdc", "abce", "xyz", "12g", "13g", "με", "extra", "αεριουχο", "anθpakoyxo",
            "aepioyxo", "abcde"]
    rows = [(i, rng.sample(pool, rng.randint(0, 6)), rng.sample(pool, rng.randint(0, 6))) for i in range(150)]
    frame = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    toks = {s: matching.weighted_tokens(F.col(s)) for s in ("a", "b")}
    got = frame.select("i", toks["a"].alias("ta"), toks["b"].alias("tb")).select(
        "i", "ta", "tb", matching.fuzzy_jaccard(F.col("ta"), F.col("tb")).alias("j")).collect()
    for row in got:
        used, shared = set(), 0.0
        for x in row.ta:
            for k, y in enumerate(row.tb):
                same = x.stem == y.stem or (x.syn is not None and x.syn == y.syn) or (
                    x.fuzzy and y.fuzzy and _edit_distance_one(x.stem, y.stem))
                if k not in used and same:
                    used.add(k)
                    shared += (x.weight + y.weight) / 2
                    break
        union = sum(t.weight for t in row.ta) + sum(t.weight for t in row.tb) - shared
        assert row.j == pytest.approx(0.0 if union == 0 else shared / union)
        assert 0.0 <= row.j <= 1.0


def test_full_trim_and_percent_with_other_white_space(spark):
    rows = spark.createDataFrame([("\n  Γάλα\u00a0x\t\u3000", "3,5\u00a0%"), ("\u00a0\ufeff", "x"), (None, None), ("a", "1.5 %")], "t string, p string")
    got = [tuple(r) for r in rows.select(text.full_trim(F.col("t")), text.percent(F.col("p"))).collect()]
    assert got == [("Γάλα\u00a0x", 3.5), ("", None), (None, None), ("a", 1.5)]


def test_patches_refuse_odd_numbers_and_blank_names(spark):
    from aislegraph.operators import maintenance

    sent = [{"sizeValue": v} for v in ("1d", "NaN", "Infinity", "1e999", "2.5")] + [{"brand": "\t"}, {"title": "\u00a0"}]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(sent)], "i int, sent map<string,string>")
    got = [r.p for r in rows.orderBy("i").select(maintenance.patch_problem(F.col("sent")).alias("p")).collect()]
    assert got == ["bad_size"] * 4 + [None, "empty_brand", "empty_title"]


def test_accents_of_every_script_go(spark):
    """Canonical decomposition without diacritics, as web pages fold; words hold together."""
    import unicodedata

    import regex

    rows = ["Ờ ạ ǭ", "がぎ パン", "ש֑לום", "a᷄b c⃐d", "ἄᾳΐ ΅x΄", "ṩȭ", "Ѝй Ќ", "ਲ਼ क़", "ẹ́t", "no·mid¨dle`s^", "ﬁ Ⅷ ½", "ё𝒜"]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i")
    got = [r[0] for r in frame.select(text.strip_accents(F.lower("t"))).collect()]
    folded = [regex.sub(r"\p{Diacritic}", "", unicodedata.normalize("NFD", t.lower())) for t in rows]
    # What is no diacritic (the nukta, for one) stays; composed on one side only where it is more than one character.
    assert [unicodedata.normalize("NFD", regex.sub(r"\p{Diacritic}", "", g)) for g in got] == folded


def test_numbers_are_worked_out_once_and_read_every_kind_of_space(spark):
    from pyspark.sql import functions as F

    from aislegraph.functions import numbers, text

    rows = [("1 kg = Από 1.299,90 € σε 9,30 €<b>",), ("1 Lt =　2,15€",), ("1 kg = -",), ("none",), (None,)]
    frame = spark.createDataFrame(rows, "t string")
    price, label = numbers.base_price_text(F.col("t"))
    got = [(r.p, r.l) for r in frame.select(price.alias("p"), label.alias("l")).collect()]
    assert got == [(9.3, "κιλό"), (2.15, "λίτρο"), (None, None), (None, None), (None, None)]
    value = numbers.greek_number(F.sqrt(F.col("t").try_cast("double")).cast("string"))
    assert frame.select(value.alias("v"))._jdf.queryExecution().analyzed().toString().lower().count("sqrt(") == 1
    spaced = spark.createDataFrame([("".join(f"a{c}" for c in text.WIDE_SPACES) + " \tω​＀",)], "t string")
    plain = spaced.select(text.plain_spaces(F.col("t")).alias("t")).head().t
    assert plain == "a " * len(text.WIDE_SPACES) + " \tω​＀"


def test_features_are_worked_out_once_a_text(spark, monkeypatch):
    from aislegraph.functions import matching

    seen, made = [], matching.title_features

    def told(frame, *rest):
        seen.append(frame.count())
        return made(frame, *rest)

    monkeypatch.setattr(matching, "title_features", told)
    titles = ["Γάλα 2% 1lt", "Τυρί 200g", "", None]
    rows = spark.createDataFrame([(i, titles[i % 4]) for i in range(40)], "sku int, t string")
    got = {r.sku: (r.pct, r.unit) for r in matching.features_of_texts(
        rows, "t", F.col("pct"), F.col("size.unit").alias("unit")).collect()}
    assert seen == [4] and got == {i: [(2.0, "ml"), (None, "g"), (None, None), (None, None)][i % 4] for i in range(40)}
