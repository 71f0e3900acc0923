"""Operator 5: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame operations alone.

Candidates are found by one pattern, validated by kind (check sums, calendar, octets), and permuted within their format: a
card number becomes another that passes the Luhn test, a date another date in the same notation. The permutation depends on
the key, the kind and the length alone, so equal values stay linked in all documents, different ones stay different, and
who has the key can invert it. A run of groups of digits or capitals may hold more than the value, so card and account numbers are
looked for in all of its parts that begin and end with a group. What fails validation is left as it is.

Character kinds are permuted by a Feistel network over the value's digits and letters: it is halved, and each of ROUNDS
rounds shifts one half's characters, each within its class, by a keyed hash of the other half. Addresses and dates are
permuted as numbers; dates walk the cycle until they are back within the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted within, and the bits of a half of the network above them.
DAYS, DAY_BITS = 73_049, 9
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_HEX = r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,20}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?![\p{L}\p{N}])"
_IP = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
_ISO = r"(?<![\p{L}\p{N}/.-])\d{4}-\d{2}-\d{2}(?![\p{L}\p{N}/-])"
_DAY_FIRST = r"(?<![\p{L}\p{N}/.-])\d{2}[/.]\d{2}[/.]\d{4}(?![\p{L}\p{N}/-])"
_SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
#: Groups of digits, of any number; possessive, so that the match needs no stack however long it is.
_CARD = r"(?<![\p{L}\p{N}-])(?=\d(?:[ -]?\d){12})\d++(?![\p{L}\p{N}])(?:[ -]\d++(?![\p{L}\p{N}]))*+"
#: Lengths of card numbers; usual ones first, as one in ten runs of digits passes the check by chance.
_CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)
#: Groups of three digits at least that a card may have.
_CARD_GROUPS = 6
#: A marked group that begins no card, or begins one of so many groups, with those.
_MARKED = "|".join(["\u00010[^\u0001]*"] + [f"\u0001{n}[^\u0001]*(?:\u0001.[^\u0001]*){{{n - 1}}}" for n in range(1, _CARD_GROUPS + 1)])
_IBAN_PARTS = [rf"(?<![A-Z0-9])(?=([A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}})(?![A-Z0-9]))" for n in range(34, 11, -1)]
_LOCAL_PHONE = r"(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}-])"
#: Country calling codes of one digit and of two; all others have three.
CODES_1 = "1 7".split(" ")
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(" ")
#: Steps after which a walk has come back, but for a chance under 1e-36.
WALK = 256
#: Kinds in the order in which they are tried.
KINDS = {"email": _EMAIL, "hex": _HEX, "iban": _IBAN, "phone": _PHONE, "ip": _IP, "iso": _ISO, "day_first": _DAY_FIRST, "ssn": _SSN, "card": _CARD, "local_phone": _LOCAL_PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _digest(key: Column, kind: str, turn: Column, said: Column, part: Column | None = None) -> Column:
    """Hexadecimal digits that depend on the key, the kind, the round and the other half."""
    parts = [key, F.lit(kind), turn.cast("string"), said] + ([part.cast("string")] if part is not None else [])
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def _number(digest: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, at, F.lit(digits)), 16, 10).cast("long")


def _shifted(half: Column, other: Column, key: Column, kind: str, turn: Column, classes: list[str]) -> Column:
    """``half`` with each character moved within its class; other characters stay."""
    def one(c: Column, i: Column) -> Column:
        # 16 characters' shifts a digest
        by = _number(_digest(key, kind, turn, other, F.floor(i / 16)), ((i % 16) * 4 + 1).cast("int"), 4)
        moved = c
        for members in classes:
            at = F.instr(F.lit(members), c)
            moved = F.when(at > 0, F.substring(F.lit(members), ((at - 1 + by) % len(members) + 1).cast("int"), F.lit(1))).otherwise(moved)
        return moved

    return F.array_join(F.transform(F.split(half, ""), lambda c, i: F.when(c == "", c).otherwise(one(c, i))), "")


_CLASSES = {"digits": ["0123456789"], "hex": ["0123456789abcdef"], "text": ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]}


def permuted(value: Column, key: Column, kind: str, classes: str) -> Column:
    """A Feistel network over the characters of ``value``; the halves change places after each round."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))
    step = lambda s, r: F.struct(s["b"].alias("a"), _shifted(s["a"], s["b"], key, kind, r, _CLASSES[classes]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def _permuted_number(value: Column, key: Column, kind: str, bits: int) -> Column:
    """A Feistel network over numbers of 2 x ``bits`` bits."""
    size = 1 << bits
    start = F.struct((value / size).cast("long").alias("a"), (value % size).alias("b"))
    step = lambda s, r: F.struct(s["b"].alias("a"), ((s["a"] + _number(_digest(key, kind, r, s["b"].cast("string")), F.lit(1), 12)) % size).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * size + s["b"])


def _refill(shape: Column, characters: Column, pattern: str) -> Column:
    """``shape`` with its characters that match ``pattern`` replaced by those of ``characters``, in order."""
    step = lambda s, c: F.when(c.rlike(pattern), F.struct(F.concat(s["out"], F.substring(characters, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum: every second digit from the right, beginning with the last but one, counts double."""
    step = lambda s, c: F.struct((~s["twice"]).alias("twice"), (s["sum"] + F.when(s["twice"], 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))).alias("sum"))
    characters = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(characters, F.struct(F.lit(False).alias("twice"), F.lit(0).alias("sum")), step, lambda s: s["sum"])


def iban_rest(compact: Column) -> Column:
    """The number of the rearranged account number, modulo 97."""
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda s, c: F.when(c == "", s).otherwise((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    payload = permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", "digits")
    check = (10 - luhn_sum(F.concat(payload, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, _refill(m, F.concat(payload, check.cast("string")), "[0-9]")).otherwise(m)


def _iban(m: Column, key: Column) -> Column:
    compact = F.translate(m, " ", "")
    body = permuted(F.substring(compact, F.lit(5), F.length(compact)), key, "iban", "text")
    country = F.substring(compact, F.lit(1), F.lit(2))
    check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
    return F.when(iban_rest(compact) == 1, _refill(m, F.concat(country, check, body), "[A-Z0-9]")).otherwise(m)


def _parts(text: Column, patterns: list[str], valid: Callable[[Column], Column], new: Callable[[Column], Column]) -> Column:
    """(text, n): the valid parts of a run replaced, and how many; of overlapping ones the first."""
    parts = F.flatten(F.transform(F.array(*map(F.lit, patterns)), lambda p: F.regexp_extract_all(text, p, F.lit(1))))
    step = lambda s, c: F.when(F.instr(s["text"], c) > 0, F.struct(F.replace(s["text"], c, new(c)).alias("text"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.filter(parts, valid), F.struct(text.alias("text"), F.lit(0).alias("n")), step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _cards_within(text: Column, key: Column) -> Column:
    """(text, n): card numbers that begin and end with a group of ``text`` replaced, and how many.

    Each group is marked with the groups of the card that begins there, unless a more usual one begins within that; then one pattern takes them from
    the left. The work for a group doesn't depend on the length of the text.
    """
    groups = F.regexp_extract_all(text, F.lit("[ -]?[^ -]+|[ -]"), 0)
    digits = F.transform(groups, lambda g: F.when(g.rlike("^[ -]?[0-9]{3,}$"), F.ltrim(g, F.lit(" -"))).otherwise(""))

    def beginning(all_digits: Column, i: Column) -> Column:
        """(turn, groups) of the most usual card that begins with a group; null if none does."""
        def of(n: int) -> Column:
            some = F.slice(all_digits, i + 1, F.lit(n))
            said = F.array_join(some, "")
            fits = (F.size(some) == n) & ~F.array_contains(some, "") & F.length(said).between(min(_CARD_LENGTHS), max(_CARD_LENGTHS))
            turn = F.array_position(F.array(*map(F.lit, _CARD_LENGTHS)), F.length(said))
            return F.when(fits, F.when(luhn_sum(said) % 10 == 0, F.struct(turn.alias("turn"), F.lit(n).alias("groups"))))

        return F.array_min(F.array(*map(of, range(1, _CARD_GROUPS + 1))))

    def mark(found: Column, i: Column) -> Column:
        own = F.get(found, i)
        better = F.exists(F.slice(found, i + 2, F.greatest(own["groups"] - 1, F.lit(0))), lambda x: x["turn"] < own["turn"])
        return F.when(own.isNull() | better, 0).otherwise(own["groups"]).cast("string")

    def replaced(part: Column) -> Column:
        body = F.regexp_replace(part, "\u0001.", "")
        return F.when(F.substring(part, 2, 1) == "0", F.struct(body.alias("text"), F.lit(0).alias("n"))).otherwise(F.struct(_card(body, key).alias("text"), F.lit(1).alias("n")))

    marked = _let(
        F.struct(groups.alias("groups"), digits.alias("digits")),
        lambda s: _let(F.transform(s["digits"], lambda d, i: F.when(d != "", beginning(s["digits"], i))), lambda found: F.array_join(F.transform(s["groups"], lambda g, i: F.concat(F.lit("\u0001"), mark(found, i), g)), "")),
    )
    parts = F.transform(F.regexp_extract_all(marked, F.lit(_MARKED), 0), replaced)
    return _let(parts, lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"), F.aggregate(p, F.lit(0), lambda k, x: k + x["n"]).alias("n")))


def _cards(m: Column, key: Column) -> Column:
    """(text, n). A run that is no longer than a card is one in whatever groups it is written."""
    once = lambda v: F.struct(v.alias("text"), (v != m).cast("int").alias("n"))
    whole = F.when(F.length(_digits(m)).between(13, 19), once(_card(m, key))).otherwise(once(m))
    return _let(_cards_within(m, key), lambda f: F.when(f["n"] > 0, f).otherwise(whole))


def _ibans(m: Column, key: Column) -> Column:
    """(text, n). What follows or precedes the account numbers may hold card numbers."""
    found = _parts(m, _IBAN_PARTS, lambda c: iban_rest(F.translate(c, " ", "")) == 1, lambda c: F.concat(F.lit("\u0001"), _iban(c, key), F.lit("\u0001")))
    piece = lambda t, i: F.when(i % 2 == 1, F.struct(t.alias("text"), F.lit(1).alias("n"))).otherwise(_cards_within(t, key))
    step = lambda a, b: F.struct(F.concat(a["text"], b["text"]).alias("text"), (a["n"] + b["n"]).alias("n"))
    return F.aggregate(F.transform(F.split(found["text"], "\u0001"), piece), F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), step)


def _ip(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    new = _permuted_number(value, key, "ip", 16)
    said = F.concat_ws(".", *((F.floor(new / (1 << k)) % 256).cast("string") for k in (24, 16, 8, 0)))
    return F.when(F.forall(octets, lambda o: o < 256), said).otherwise(m)


def _date(m: Column, key: Column, notation: str) -> Column:
    """All notations share one permutation, so a day stays linked whichever way it is written. What is no day first may be a month first."""
    field = lambda at, n: F.substring(m, at, n)
    first = F.concat_ws("-", field(7, 4), field(4, 2), field(1, 2)).try_cast("date")
    month_first = F.concat_ws("-", field(7, 4), field(1, 2), field(4, 2)).try_cast("date")
    day = F.datediff(m.try_cast("date") if notation == "iso" else F.coalesce(first, month_first), F.lit("1900-01-01").cast("date")).cast("long")
    walk = lambda s, _: F.when((s >= 0) & (s < DAYS), s).otherwise(_permuted_number(F.abs(s), key, "date", DAY_BITS))
    # the first step always permutes; a day outside the calendar is permuted again
    new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _permuted_number(day, key, "date", DAY_BITS), walk)
    date = F.date_add(F.lit("1900-01-01").cast("date"), new.cast("int"))
    said = date.cast("string") if notation == "iso" else F.concat(
        F.when(first.isNotNull(), F.date_format(date, "dd")).otherwise(F.date_format(date, "MM")), field(3, 1),
        F.when(first.isNotNull(), F.date_format(date, "MM")).otherwise(F.date_format(date, "dd")), field(6, 1), F.date_format(date, "yyyy"),
    )
    return F.when((day >= 0) & (day < DAYS), said).otherwise(m)


def _ssn(m: Column, key: Column) -> Column:
    good = lambda d: d.rlike(r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$")
    digits = _digits(m)
    new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permuted(digits, key, "ssn", "digits"), lambda s, _: F.when(good(s), s).otherwise(permuted(s, key, "ssn", "digits")))
    return F.when(good(digits), _refill(m, new, "[0-9]")).otherwise(m)


def _phone(m: Column, key: Column) -> Column:
    """The country code and a trunk 0 in brackets stay; the national digits are permuted, so a number stays linked however it is grouped."""
    shape = F.replace(m, F.lit("(0)"), F.lit("\u0001"))
    digits = _digits(shape)
    code = F.when(digits.substr(1, 1).isin(CODES_1), 1).when(digits.substr(1, 2).isin(CODES_2), 2).otherwise(3)
    code = F.when(F.startswith(m, F.lit("+")), code).otherwise(0)
    national = F.substring(digits, code + 1, F.length(digits))
    new = F.concat(F.substring(digits, F.lit(1), code), permuted(national, key, "phone", "digits"))
    return F.when(F.length(digits).between(7, 15), F.replace(_refill(shape, new, "[0-9]"), F.lit("\u0001"), F.lit("(0)"))).otherwise(m)


def _email(m: Column, key: Column) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permuted(local, key, "email", "text"), F.lit("@"), domain)


def pseudonym(m: Column, key: Column) -> Column:
    """(text, n): what stands for a candidate, and how many values in it changed; the candidate itself if nothing in it is valid."""
    whole = {k: f"^(?:{p})$" for k, p in KINDS.items()}
    one = lambda v: F.struct(v.alias("text"), (v != m).cast("int").alias("n"))
    return (
        F.when(m.rlike(whole["email"]), one(_email(m, key))).when(m.rlike(whole["hex"]), one(permuted(m, key, "hex", "hex"))).when(m.rlike(whole["iban"]), _ibans(m, key))
        .when(m.rlike(whole["phone"]) | m.rlike(whole["local_phone"]), one(_phone(m, key))).when(m.rlike(whole["ip"]), one(_ip(m, key)))
        .when(m.rlike(whole["iso"]), one(_date(m, key, "iso"))).when(m.rlike(whole["day_first"]), one(_date(m, key, "day_first")))
        .when(m.rlike(whole["ssn"]), one(_ssn(m, key))).when(m.rlike(whole["card"]), _cards(m, key)).otherwise(one(m))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the valid personal values in ``text_col`` replaced by their pseudonyms; with ``count_col``, how many.

    All rows and columns are kept; null texts stay null and have none. Rows aren't moved, so nothing depends on their number.
    ``text_col`` is replaced in place, ``count_col`` replaces a column of that name; no other name is special.
    """
    if not key:
        raise ValueError("an empty key protects nothing")
    text, secret, private = F.col(text_col), F.lit(key), "_private"
    while private in docs.columns:
        private += "_"
    candidates = F.regexp_extract_all(text, F.lit(ANY), 0)
    out = docs.withColumn(private, F.when(text.rlike("[0-9@]"), F.transform(candidates, lambda m: pseudonym(m, secret))))
    # the gaps between the candidates, and the candidates' pseudonyms
    gaps = F.split(text, ANY, -1)
    joined = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(private, lambda p, i: F.concat(p["text"], F.get(gaps, i + 1))), ""))
    out = out.withColumn(text_col, F.when(F.exists(private, lambda p: p["n"] > 0), joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(private).isNull(), 0).otherwise(F.aggregate(private, F.lit(0), lambda k, p: k + p["n"])).cast("int"))
    return out.drop(private)
