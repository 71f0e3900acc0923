import datetime
import hashlib
import random
import re

import pytest

from denovospark.llm.pii import pseudonymise


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    return {r.doc_id: r for r in pseudonymise(docs, key, count_col="n").collect()}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


CARD, BAD = "4929348385146306", "4929348385146307"


def test_formats(spark):
    assert luhn(CARD) and not luhn(BAD)
    texts = [
        f"card {CARD}.", f"{CARD} again {CARD[:4]} {CARD[4:8]}-{CARD[8:12]} {CARD[12:]}", f"order {BAD} stays", "on 1987-06-05, 05/06/1987 or 05.06.1987", "not 2023-02-30 nor 31/02/2020 nor 1.2.3",
        "öheit.55@mail4.example.com and öheit.55@mail4.example.com", "call +1 (974) 555-3436 or (974) 555-3436", "at 233.254.104.120 not 300.1.1.1 nor 1.2.3.4.5", 'token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" x',
        "DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "id 123-45-6789 and 000-12-3456", None, "", "no values here", "x " * 30000 + CARD,
    ]
    got = run(spark, texts)
    t = {k: r.text for k, r in got.items()}
    new = re.fullmatch(r"card (\d{16})\.", t[0])[1]
    assert luhn(new) and new != CARD
    a, b = re.fullmatch(r"(\d{16}) again (\d{4} \d{4}-\d{4} \d{4})", t[1]).groups()
    assert a == new == re.sub(r"\D", "", b)
    assert t[2] == texts[2] and got[2].n == 0
    y, d1, d2 = re.fullmatch(r"on (\S+), (\S+) or (\S+)", t[3]).groups()
    day = datetime.date.fromisoformat(y)
    assert day != datetime.date(1987, 6, 5) and d1 == day.strftime("%d/%m/%Y") and d2 == day.strftime("%d.%m.%Y") and got[3].n == 3
    assert t[4] == texts[4]
    m = re.fullmatch(r"(ö[a-z]{4}\.\d\d@mail4\.example\.com) and (\S+)", t[5])
    assert m[1] == m[2] != "öheit.55@mail4.example.com"
    m = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})", t[6])
    assert m[1] == m[2] != "(974) 555-3436"
    m = re.fullmatch(r"at (\d+\.\d+\.\d+\.\d+) not 300\.1\.1\.1 nor 1\.2\.3\.4\.5", t[7])
    assert m[1] != "233.254.104.120" and all(0 <= int(o) < 256 for o in m[1].split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}" x', t[8]) and t[8] != texts[8]
    m = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and DE89370400440532013001", t[9])
    iban = m[1].replace(" ", "")
    assert m[1] != "DE89 3704 0044 0532 0130 00" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    m = re.fullmatch(r"id (\d{3}-\d\d-\d{4}) and 000-12-3456", t[10])
    assert m[1] != "123-45-6789"
    assert t[11] is None and t[12] == "" and t[13] == texts[13] and t[14] == "x " * 30000 + new
    assert run(spark, texts[:1], "other key")[0].text != t[0]


def test_values_within_longer_runs(spark):
    spaced, iban = f"{CARD[:4]} {CARD[4:8]} {CARD[8:12]} {CARD[12:]}", "ES91 2100 0418 4502 0005 1332"
    texts = [
        CARD, f"pay {CARD} 12/27", f"{CARD} 99 x", f"Room 12 {spaced}", f"{spaced} 123", f"1234 5678 {spaced}", f"{spaced} 77 {CARD}", iban, f"{iban} EUR", f"{iban} PAID", f"{iban} {spaced}",
        f"order {BAD[:4]} {BAD[4:8]} {BAD[8:12]} {BAD[12:]} stays",
    ]
    got = run(spark, texts)
    t = {k: r.text for k, r in got.items()}
    new, said = t[0], f"{t[0][:4]} {t[0][4:8]} {t[0][8:12]} {t[0][12:]}"
    assert new != CARD and t[7] != iban
    assert [t[k] for k in range(1, 7)] == [f"pay {new} 12/27", f"{new} 99 x", f"Room 12 {said}", f"{said} 123", f"1234 5678 {said}", f"{said} 77 {new}"]
    assert [t[k] for k in range(8, 11)] == [f"{t[7]} EUR", f"{t[7]} PAID", f"{t[7]} {said}"]
    assert t[11] == texts[11] and [got[k].n for k in range(12)] == [1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 2, 0]


def test_permutations_are_one_to_one(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(0, 73049, 97)]
    got = {r.text for r in run(spark, days).values()}
    assert len(got) == len(days) and all("1900-01-01" <= d <= "2099-12-31" for d in got)
    ips = [f"10.0.{k // 256}.{k % 256}" for k in range(0, 3000, 7)]
    assert len({r.text for r in run(spark, ips).values()}) == len(ips)


def test_empty_table_and_key(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pseudonymise(none, "k").count() == 0
    with pytest.raises(ValueError):
        pseudonymise(none, "")


def number(key, kind, turn, said, part=None, at=0, digits=12):
    parts = [key, kind, str(turn), said] + ([str(part)] if part is not None else [])
    return int(hashlib.sha256("|".join(parts).encode()).hexdigest()[at : at + digits], 16)


def feistel(value, key, kind, classes):
    """The character network by definition."""
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(1, 9):
        moved = ""
        for i, c in enumerate(a):
            by = number(key, kind, turn, b, i // 16, i % 16 * 4, 4)
            moved += next((k[(k.index(c) + by) % len(k)] for k in classes if c in k), c)
        a, b = b, moved
    return a + b


def feistel_number(value, key, kind, bits):
    a, b = divmod(value, 1 << bits)
    for turn in range(1, 9):
        a, b = b, (a + number(key, kind, turn, str(b))) % (1 << bits)
    return (a << bits) + b


DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def spelled(digits, shape):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def brute(kind, value, key="k"):
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        body = feistel(digits[:-1], key, "card", [DIGITS])
        return spelled(body + next(c for c in DIGITS if luhn(body + c)), value)
    if kind == "email":
        local, domain = value.split("@")
        return feistel(local, key, "email", [DIGITS, LETTERS, LETTERS.upper()]) + "@" + domain
    if kind == "hex":
        return feistel(value, key, "hex", [DIGITS + "abcdef"])
    if kind == "ip":
        n = feistel_number(int.from_bytes(map(int, value.split("."))), key, "ip", 16)
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "date":
        start = datetime.date(1900, 1, 1)
        n = feistel_number((datetime.date.fromisoformat(value) - start).days, key, "date", 9)
        while n >= 73049:
            n = feistel_number(n, key, "date", 9)
        return (start + datetime.timedelta(n)).isoformat()
    code = {"+49": 2, "+1 ": 1, "+35": 3, "(21": 0}[value[:3]]
    digits = re.sub(r"\D", "", value.replace("(0)", "_"))
    new = digits[:code] + feistel(digits[code:], key, "phone", [DIGITS])
    return spelled(new, value.replace("(0)", "_")).replace("_", "(0)")


def test_values_equal_brute_force(spark):
    draw = random.Random(8)
    some = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    cases = []
    for _ in range(40):
        body = "4" + some(DIGITS, draw.choice([11, 13, 14, 17]))
        cases.append(("card", body + next(c for c in DIGITS if luhn(body + c))))
        cases.append(("email", some(LETTERS + LETTERS.upper() + DIGITS, draw.randrange(1, 20)) + "@mail.example.org"))
        cases.append(("hex", some(DIGITS + "abcdef", draw.choice([32, 40, 64]))))
        cases.append(("ip", ".".join(str(draw.randrange(256)) for _ in range(4))))
        cases.append(("date", (datetime.date(1900, 1, 1) + datetime.timedelta(draw.randrange(73049))).isoformat()))
        d = "1" + some(DIGITS, 10)
        cases.append(("phone", draw.choice([f"+49{d}", f"+49 {d[:3]} {d[3:7]} {d[7:]}", f"+49 (0) {d[:3]} {d[3:7]}-{d[7:]}", f"+351 {d[:3]} {d[3:6]} {d[6:9]}", f"+1 ({d[:3]}) {d[3:6]}-{d[6:10]}", f"(212) {d[3:6]}-{d[6:10]}"])))
    got = run(spark, [f"a {v} z" for _, v in cases])
    for k, (kind, value) in enumerate(cases):
        assert got[k].text == f"a {brute(kind, value)} z" and got[k].n == int(brute(kind, value) != value), (kind, value)


def test_phones_stay_linked_over_notations(spark):
    t = {k: r.text for k, r in run(spark, ["+4915112345678", "+49 151 12345678", "+49 (0) 151 12345678", "+49 (0)151 1234 5678", "+1 (974) 555-3436", "(974) 555-3436"]).items()}
    assert len({re.sub(r"\D", "", t[k].replace("(0)", "")) for k in range(4)}) == 1 and t[0].startswith("+49") and t[0] != "+4915112345678"
    assert t[2].startswith("+49 (0) ") and t[4] == "+1 " + t[5] != "+1 (974) 555-3436"


def test_month_first_dates(spark):
    t = {k: r.text for k, r in run(spark, ["12/31/1999", "31/12/1999", "1999-12-31"]).items()}
    m = re.fullmatch(r"(\d\d)/(\d\d)/(\d{4})", t[0])
    assert t[2] == f"{m[3]}-{m[1]}-{m[2]}" != "1999-12-31" and t[1] == f"{m[2]}/{m[1]}/{m[3]}"


def test_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, f"x {CARD}", "a", "b"), (1, f"x {CARD}", "a", "b"), (None, None, "c", "d")], "doc_id long, text string, _private string, _private_ string")
    rows = pseudonymise(docs, "k").collect()
    assert rows[0] == rows[1] and [(r._private, r._private_) for r in rows] == [("a", "b"), ("a", "b"), ("c", "d")] and rows[2].text is None
    assert pseudonymise(docs, "k").columns == docs.columns


def test_cards_in_runs_of_any_length(spark):
    """Groups before, after and around a card, far more than a card has."""
    whole = run(spark, [CARD])[0].text
    grouped = lambda card, sign: sign.join(card[k : k + 4] for k in range(0, 16, 4))
    texts, want = [], []
    for sign in " -":
        for many in (62, 66, 3000):
            for filler in ("7", "71"):  # groups that are too short to be of a card
                around = sign.join([filler] * many)
                for card, out in ((CARD, texts), (whole, want)):
                    out.append(f"of {around}{sign}{grouped(card, sign)}{sign}{around} x")
    long = [sign.join(["1234"] * 64 + [CARD] + ["5678"] * 64) for sign in " -"]
    got = run(spark, [*texts, *long, "1" * 300_000])
    assert [(got[k].text, got[k].n) for k in range(len(texts))] == [(x, 1) for x in want]
    assert all(CARD not in got[len(texts) + k].text for k in (0, 1)) and got[len(texts) + 2].n == 0


def test_of_overlapping_cards_the_usual_length_then_the_first(spark):
    def valid(n):
        return next(x for k in range(10) if luhn(x := "45" + "17" * ((n - 3) // 2) + "3" * ((n - 3) % 2) + str(k)))

    v13 = valid(13)
    tail = next(f"{k:03d}" for k in range(1000) if luhn(v13 + f"{k:03d}"))
    got = run(spark, [f"{v13} {tail}", f"{v13} {CARD}", f"123 {CARD} 123"])
    assert luhn(got[0].text) and got[0].text[-3:] != tail or got[0].text[:13] != v13
    a, b = got[1].text.split(" ")
    assert luhn(a) and luhn(b) and a != v13 and b != CARD and got[1].n == 2
    assert got[2].n == 1 and re.fullmatch(r"123 \d{16} 123", got[2].text) and CARD not in got[2].text
