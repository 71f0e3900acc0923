import random

import regex

from denovospark.llm import decontamination as d
from denovospark.llm.decontamination import find_leaks

ITEM = "Yesterday the clerk Anna paid 42 dollars for 7 apples, and then Anna gave 7 apples to the tall man who lives near the old mill."
FILL = "some other quiet words stand around here without any meaning at all "


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, ITEM, "x"), (0, texts[0], "x")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, ITEM), (77, None), (78, "")], "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in find_leaks(docs, bench).collect()}


def test_leaks(spark):
    texts = [
        FILL + ITEM + FILL, FILL * 40, None, "", ITEM.upper().replace(".", "!!"),
        FILL + ITEM.replace("42", "99").replace("7", "12").replace("Anna", "Maria") + FILL,  # a renaming
        ITEM.replace("for 7 apples", "for 8 apples"),  # not one: 7 became 8 and stayed 7
        " ".join(ITEM.split(" ")[2:18]), "just short words", FILL * 300 + ITEM + FILL * 300, " ".join(ITEM.split(" ")[:9]),
    ]
    got = found(spark, texts, [ITEM, "short words", "of an item that is nowhere in any of the documents here"])
    kinds = {k: r.kind for k, r in got.items() if k[1] == 0}
    assert {k[0] for k in kinds} >= {0, 5, 7, 9} and not {1, 2, 3, 6, 8, 10} & {k[0] for k in kinds}
    assert kinds[0, 0] == kinds[9, 0] == "verbatim" and kinds[5, 0] == "reparameterised"
    assert got[0, 0].n_windows >= got[0, 0].item_windows - 1  # its first word stands within a sentence here
    assert {k for k in got if k[1] == 1} == {(8, 1)} and not {k for k in got if k[1] == 2}


def test_shouted_without_slots(spark):
    plain = "the heatou ononat to to the anor shheed eronnten onnt thin ndonsh of is the was that of"
    got = found(spark, [FILL + plain.upper().replace(" ", "!! ") + FILL, FILL], [plain.capitalize() + "."])
    assert set(got) == {(0, 0)}


def test_items_of_numbers(spark):
    items = ["Compute 12 + 45 * 3 - 7.", "Add 3, 5, 7, 9 and 11 to 13.", "Paris 3 5 8 13, Rome 2 4 6 8, Oslo 1 2 3 4 and then the sum of all the numbers in this table"]
    texts = [FILL + items[0] + FILL, FILL + items[1] + FILL, FILL + items[2] + FILL, "Compute 13 + 45 * 3 - 7.", "Add 3, 5, 7, 9 and 11 to 14.", FILL + items[2].replace("13", "14").replace("6", "7") + FILL]
    got = found(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (5, 2)}  # the last by its windows of words
    assert {got[k, k].kind for k in range(3)} == {"verbatim"} and all(got[k, k].n_windows == got[k, k].item_windows for k in (0, 1))


def test_copies_in_other_case_or_wrapped(spark):
    clips = "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May."
    other = ITEM.replace("42", "99").replace("Anna", "Maria")
    texts = [ITEM.upper().replace(".", "!!"), FILL + ITEM.lower(), FILL + ITEM.replace(" ", "\n"), clips.lower(), clips.upper(), clips.replace(" ", " \n\t"), other.replace(" Maria", "\n  Maria")]
    got = found(spark, texts, [ITEM, clips])
    assert {k: r.kind for k, r in got.items()} == {(0, 0): "verbatim", (1, 0): "verbatim", (2, 0): "verbatim", (3, 1): "verbatim", (4, 1): "verbatim", (5, 1): "verbatim", (6, 0): "reparameterised"}
    assert all(r.n_windows == r.item_windows for k, r in got.items() if k[0] in (0, 3, 4))


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert find_leaks(docs, bench).count() == 1


def test_one_long_text_of_copies(spark):
    """100,000 words, all of which match: each text is cut into words once, whatever the number of matches."""
    got = found(spark, [(ITEM + " ") * 3700], [ITEM])
    assert got[0, 0].kind == "verbatim" and got[0, 0].n_windows == got[0, 0].item_windows


def brute_leaks(docs, items, least_windows=3, least_share=0.4):
    """The pairs by definition: every window of every item against every window of every document."""
    space = r"[ \t\n\x0b\f\r\p{Z}]"

    def canonical(text):
        text = regex.sub(space + r"{2,}|[\t\n\x0b\f\r\p{Z}--[ ]]", " ", text, flags=regex.V1)
        text = regex.sub(r"(?=\p{Lu})(?<=[\p{Ll}0-9,;:] )(\p{Lu}\p{Ll}+)(?![\p{L}0-9])", "\x01p\x02\\1", text).lower()
        text = regex.sub(r"(?<![\p{L}0-9])([0-9]+(?:[.,][0-9]+)*)(?![\p{L}0-9])", "\x01n\x02\\1", text)
        text = regex.sub(rf"(\x01n\x02[0-9.,]+ ?)({'|'.join(d.UNITS)})(?!\p{{L}})", "\\1 \x01u\x02\\2", text)
        return regex.sub("[^\\p{L}0-9\x01\x02]+", " ", text).translate({1: "#", 2: "="}).strip().split(" ")

    plain = lambda ws: [regex.sub("#[npu]=", "", w) for w in ws]
    template = lambda ws: [w.split("=")[0] if w.startswith("#") else w for w in ws]
    slots = lambda ws: [w[1:] for w in ws if w.startswith("#")]
    found = {}
    for item, item_text in items:
        words = canonical(item_text or "")
        if item is None or words == [""]:
            continue
        n = min(len(words), d.WINDOW)
        own = {k: words[k : k + n] for k in range(len(words) - n + 1)}
        worded = {k for k, w in own.items() if 2 * len(slots(w)) <= n}
        usable = {k for k, w in own.items() if k in worded or plain(w) != template(w)}
        for doc, text in docs:
            there = canonical(text or "")
            shifts = {}
            for at in range(len(there) - n + 1 if there != [""] and doc is not None else 0):
                w = there[at : at + n]
                for k in usable:
                    if plain(w) == plain(own[k]):
                        shifts.setdefault(at - k, []).append((k, slots(own[k]), slots(own[k])))
                    elif k in worded and template(w) == template(own[k]):
                        shifts.setdefault(at - k, []).append((k, slots(own[k]), slots(w)))
            whole, changed = set(), []
            for held in shifts.values():
                pairs = {p for _, was, now in held for p in zip(was, now, strict=True)}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    whole |= {k for k, _, _ in held}
                    changed.append(sum(a != b for a, b in pairs))
            enough = lambda a, b: len(b) > 0 and len(a) >= min(least_windows, len(b)) and len(a) >= least_share * len(b)
            if enough(whole, usable) or enough(whole & worded, worded):
                found[doc, item] = (len(whole), len(usable), "reparameterised" if min(changed) > 0 else "verbatim")
    return found


def test_equal_brute_force(spark):
    draw = random.Random(6)
    vocabulary = "the a clerk counts apples and pears in of old cellar before noon while rain falls on quiet roofs with three red doors".split()
    names, units = ["Anna", "Bruno", "Carla", "Dino"], ["km", "kg", "dollars", "min"]

    def sentence():
        words = [draw.choice(vocabulary) for _ in range(draw.choice([3, 9, 20, 30]))]
        for _ in range(draw.choice([0, 1, 4, 9])):
            words[draw.randrange(len(words))] = draw.choice([str(draw.randrange(50)), f"{draw.randrange(9)} {draw.choice(units)}", draw.choice(names)])
        return " ".join(words)

    items = [(i, sentence()) for i in range(14)] + [(90, "12 + 5 * 9 = 57"), (91, ""), (None, "x y z")]
    docs = []
    for i in range(90):
        text = draw.choice(items[:15])[1]
        change = draw.choice([lambda t: t, str.upper, str.lower, lambda t: t.replace("Anna", "Emil"), lambda t: regex.sub("[0-9]+", lambda m: str(int(m[0]) + 1), t), lambda t: t[: len(t) // 2], lambda t: t.replace(" ", "\n\t")])
        docs.append((i, f"{sentence()}. {change(text)}, {sentence()}" if i % 5 else sentence()))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.kind) for r in d.find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 30
