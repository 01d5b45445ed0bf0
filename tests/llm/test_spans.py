import hashlib
import random
import re
import time

import pytest

from aislegraph.llm import personal_data, secret_scan

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for _, _, a, b, k in sorted(spans)).encode()).hexdigest()


def secrets_of(text):
    t = text or ""
    found = [(m.start(), 0, m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return (*[sum(f[1] == k for f in found) for k in range(3)], digest(found))


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def personal_of(text):
    t, found = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True, "email"),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split(".")), "ip"),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), "card"),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15, "phone"),
    ]
    for k, (pattern, ok, kind) in enumerate(rules):
        found += [(k, m.start(), m.start(), m.end(), kind) for m in re.finditer(pattern, t) if ok(m)]
    return (*[sum(f[0] == k for f in found) for k in range(4)], digest(found))


def noise(rng):
    parts = ["token", "secret=", "PassWord: ", "api_key", "=", " ", "'", "\"", "AKIA", "ab12", "f00dbeef" * 3, "A1B2C3D4E5F6G7H8", "@", "a.b", ".com", "+49 (0) 171", "4111 1111 1111 1111", "10.0.", "255.1", "-", "é", "😀", "\n", "x_y", "012", "..", "user.name"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))


@pytest.fixture(scope="module")
def noisy(texts):
    rng = random.Random(11)
    fixed = ["a@b.c_x@d.e", "a@b.c@d.e.", "é+1 234 567 890", "0255.1.1.1 256.1.1.1 1.2.3.4.5", "secret=token:abcdefghi", "4" * 30_000, "1 " * 20_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "1.2.3.4 " * 500, "secret=abcdef1 " * 384, "7" * 3000 + ".1.1.1." + "8" * 3000, "+4917112345678 " * 129]
    return dict(texts) | {1000 + k: t for k, t in enumerate(fixed)} | {2000 + k: noise(rng) for k in range(400)}


def test_secret_patterns_equal_brute_force(make_docs, noisy, empty):
    rows = secret_scan.secret_digest(secret_scan.scan_secrets(make_docs(noisy.items()))).collect()
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows}
    assert got == {i: secrets_of(t) for i, t in noisy.items()}
    assert all(r["spans"].count(",") + 1 >= r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows)
    assert secret_scan.scan_secrets(empty).count() == 0


def test_random_tokens_are_told_from_words(make_docs):
    rng = random.Random(3)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    weights = [12.7, 9, 8.2, 7.5, 7, 6.7, 6.3, 6.1, 6, 4.3, 4, 2.8, 2.8, 2.4, 2.4, 2.2, 2, 2, 1.9, 1, 0.9, 0.8, 0.2, 0.2, 0.2, 0.1]
    word = lambda n: "".join(rng.choices(letters, weights, k=n))
    pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda n: "".join(rng.choice(pool) for _ in range(n))
    rows = [(i, f"{word(24)} see {word(34)} and {word(18)}") for i in range(200)]
    rows += [(1000 + i, f"note {secret(40)}Z9a end") for i in range(60)]
    rows += [(2000 + i, "-".join([word(7), word(6), "2", word(8), word(7)])) for i in range(60)]
    found = {r["doc_id"]: len(r["random"]) for r in secret_scan.scan_secrets(make_docs(rows)).collect()}
    assert sum(found[1000 + i] for i in range(60)) >= 50
    assert sum(found[i] for i in range(200)) == 0 and sum(found[2000 + i] for i in range(60)) <= 6


def test_random_tokens_in_a_table_of_ten_rows(make_docs):
    rng = random.Random(5)
    pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f"see {''.join(rng.choice(pool) for _ in range(40))}Z9a") for i in range(5)]
    rows += [(10 + i, f"aaaaaaaa11111111aaaaaaaa{i} and abcabcabc123123123123abc{i}") for i in range(5)]
    found = {r["doc_id"]: len(r["random"]) for r in secret_scan.scan_secrets(make_docs(rows)).collect()}
    assert sum(found[i] for i in range(5)) >= 2 and not any(found[10 + i] for i in range(5))


def test_long_texts_take_time_in_proportion(make_docs):
    rng = random.Random(6)
    tokens = " ".join("".join(rng.choices("abcdefghijklmnop", k=20)) for _ in range(50_000))
    rows = [(1, tokens), (2, "5" * 1_000_000), (3, "1." * 500_000), (4, "12345.67 " * 100_000)]
    began = time.time()
    assert secret_scan.scan_secrets(make_docs(rows)).count() == 4
    assert {r["doc_id"]: len(r["ip"]) for r in personal_data.find_personal_data(make_docs(rows)).collect()} == {1: 0, 2: 0, 3: 125_000, 4: 0}
    assert time.time() - began < 150


def test_redaction_covers_spans_and_keeps_the_rest(make_docs):
    docs = make_docs([(1, "é token=abcdef12 x"), (2, "clean"), (3, None), (3, "clean")])
    assert sorted((r["doc_id"], r["text"] or "") for r in secret_scan.redact_secrets(docs).collect()) == [(1, "é [SECRET] x"), (2, "clean"), (3, ""), (3, "clean")]
    assert secret_scan.redact_secrets(docs).columns == docs.columns
    private = personal_data.redact_personal_data(make_docs([(1, "é me@x.org, 10.0.0.1 x"), (2, None)]))
    assert [r["text"] for r in private.orderBy("doc_id").collect()] == ["é [PRIVATE], [PRIVATE] x", None]


def test_personal_patterns_equal_brute_force(make_docs, noisy, empty):
    rows = personal_data.personal_data_digest(personal_data.find_personal_data(make_docs(noisy.items()))).collect()
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows}
    wrong = {i for i in noisy if got[i] != personal_of(noisy[i])}
    assert not wrong
    assert personal_data.find_personal_data(empty).count() == 0


def test_boosting_learns_format_and_context():
    rng = random.Random(5)
    counts = []
    for _ in range(300):
        x = {k: rng.randrange(n) for k, n in personal_data.FEATURES.items()}
        counts.append((x, x["plus"] == 1 and x["digits"] >= 3 or x["checks"] == 1, rng.random() < 0.25, 1 + rng.randrange(5)))
    prior, trees, lowest = personal_data.learn(counts)
    score = lambda x: prior + sum(personal_data.RATE * personal_data.tree_value(t, x) for t in trees)
    right = sum(n for x, y, _, n in counts if (score(x) > 0) == y)
    assert right >= 0.97 * sum(n for *_, n in counts) and set(lowest) == {0, 1}
    assert personal_data.learn([(x, True, False, 1) for x, *_ in counts]) is None
