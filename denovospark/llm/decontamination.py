"""Operator 6: benchmark decontamination by template canonicalisation, in DataFrame operations alone.

Texts are lower-cased and cut into words without punctuation; numbers, capitalised names within a sentence, and units after a
number become typed slots that keep their value. Windows of WINDOW words are joined on the hash of their template, in which
slots have lost their value, so a question with other numbers or names still meets its item. Windows with
slots are joined by their plain lower-cased words too: so a copy in other letter case, which has no names, meets its item, and
so does a copy of a window that is mostly slots, whose template would say too little. Matched windows of a document
and an item with one shift are an alignment. It counts if its slots are consistent: equal values in the item are equal in
the document, so that the change is a renaming and not chance. An item is in a document if its consistent alignments
cover enough of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
#: Benchmark windows up to which they are broadcast; beyond, the windows of both sides are shuffled by their hash.
BROADCAST_WINDOWS = 200_000
#: Documents with matches up to which their ids are broadcast before the texts are joined.
BROADCAST_IDS = 200_000
#: Units that are a slot after a number.
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s sec min h hr hours days weeks months years usd eur gbp dollars euros percent kmh mph kwh mb gb".split(" ")


def canonical(text: Column) -> Column:
    """Words separated by one blank; slots as #n=42, #p=anna, #u=km."""
    line = F.regexp_replace(text, r"[\s\p{Z}]{2,}|[\s\p{Z}&&[^ ]]", " ")
    named = F.regexp_replace(line, r"(?=\p{Lu})(?<=[\p{Ll}\d,;:] )(\p{Lu}\p{Ll}+)(?![\p{L}\d])", "\u0001p\u0002$1")
    lower = F.lower(named)
    numbered = F.when(lower.rlike(r"\d"), F.regexp_replace(F.regexp_replace(lower, r"(?<![\p{L}\d])(\d+(?:[.,]\d+)*)(?![\p{L}\d])", "\u0001n\u0002$1"), rf"(\u0001n\u0002[\d.,]+ ?)({'|'.join(UNITS)})(?!\p{{L}})", "$1 \u0001u\u0002$2")).otherwise(lower)
    words = F.regexp_replace(numbered, "[^\\p{L}\\d\u0001\u0002]+", " ")
    return F.trim(F.translate(words, "\u0001\u0002", "#="))


def template(words: Column) -> Column:
    return F.when(F.instr(words, "#") > 0, F.regexp_replace(words, "=[^ ]+", "")).otherwise(words)


def plain(words: Column) -> Column:
    """The words as they stand in the text, in the same places: slots are their values."""
    return F.when(F.instr(words, "#") > 0, F.regexp_replace(words, "#[npu]=", "")).otherwise(words)


def _joined(df: DataFrame, name: str, one: str, other: str, offset: int) -> DataFrame:
    """Add the hashes of runs that are made of a run of ``one`` and the run of ``other`` that begins ``offset`` words later."""
    df = df.withColumn("_later", F.slice(other, offset + 1, F.greatest(F.size(other) - offset, F.lit(0))))
    return df.withColumn(name, F.zip_with(one, "_later", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))).drop("_later")


def _hashes(df: DataFrame, name: str, words: Column, length: int) -> DataFrame:
    """Add the hashes of all runs of ``length`` words as the array ``name``.

    Runs of 1, 2, 4, ... words are hashed from two of half their length; the steps are columns, so that none is computed twice.
    """
    df = df.withColumn(f"{name}_1", F.transform(F.split(words, " "), lambda w: F.xxhash64(w)))
    size, out, held = 1, None, 0
    while True:
        if length & size:
            if out is None:
                out, held = f"{name}_{size}", size
            else:
                df, out, held = _joined(df, f"{name}_o{size}", out, f"{name}_{size}", held), f"{name}_o{size}", held + size
        if 2 * size > length:
            break
        df, size = _joined(df, f"{name}_{2 * size}", f"{name}_{size}", f"{name}_{size}", size), 2 * size
    return df.withColumn(name, F.col(out))


def windows(texts: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, at, hash, exact) for every run of ``length`` words of the canonical ``words``: by its template, and if it has slots, once more by its plain words.

    ``keys`` are repeated with each run, so what is as long as a text doesn't belong there.
    """
    df = _hashes(texts.select(*dict.fromkeys([*keys, "words"])), "_t", template(F.col("words")), length)
    df = _hashes(df, "_p", plain(F.col("words")), length)
    row = lambda exact: lambda h, i: F.struct(i.alias("at"), h.alias("hash"), F.lit(exact).alias("exact"))
    more = F.filter(F.zip_with(F.transform("_p", row(True)), "_t", lambda p, t: F.when(p["hash"] != t, p)), lambda p: p.isNotNull())
    every = F.transform("_t", row(False))
    df = df.withColumn("_all", F.when(F.instr("words", "#") > 0, F.concat(every, more)).otherwise(every))
    # outer: else Spark would filter by the array's size first, and compute all of it a second time for that
    return df.select(*keys, F.explode_outer("_all").alias("w")).select(*keys, "w.at", "w.hash", "w.exact").filter("hash is not null")


def windows_at(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(id, length, at, window) for all ``places`` (id, length, at) of the raw texts (id, text): each text is cut into words once."""
    ids = materialize(places.select("id").distinct(), "leak-ids")
    if ids.count() <= BROADCAST_IDS:  # then other texts stay where they are
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    held = places.groupBy("id").agg(F.collect_set(F.struct("length", "at")).alias("places"))  # as many as the text has words
    found = texts.join(held, "id").select("id", "places", F.split(canonical(F.col("text")), " ").alias("list"))
    # named twice, so that the list isn't made anew for each place
    inside = F.filter("places", lambda p: p["at"] + p["length"] <= F.size("list"))
    cut = F.transform(inside, lambda p: F.struct(p["length"].alias("length"), p["at"].alias("at"), F.array_join(F.slice("list", p["at"] + 1, p["length"]), " ").alias("window")))
    return found.select("id", F.explode(cut).alias("w")).select("id", "w.length", "w.at", "w.window").distinct()


def window_at(words: Column, at: Column, length: int) -> Column:
    return F.array_join(F.slice(F.split(words, " "), at + 1, F.lit(length)), " ")


def mostly_words(window: Column, length: int) -> Column:
    """Whether slots are half of the window at most."""
    return 2 * (F.length(window) - F.length(F.translate(window, "#", ""))) <= length


def _values(window: str) -> Column:
    return F.regexp_extract_all(window, F.lit(r"#([npu]=[^ ]+)"), 1)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least_windows: int = 3, least_share: float = 0.4,
) -> DataFrame:
    """Pairs (``id_col``, ``item_col``) of documents and the benchmark items that they contain.

    With n_windows matched of item_windows, n_slots distinct slot values compared, n_changed of which differ, and kind, which is
    verbatim or reparameterised. At least ``least_windows`` windows and ``least_share`` of an item's have to match, or all of
    fewer: of all its windows, or of those that aren't mostly slots, as others can't match with other values. An item shorter than a window is one window of its own length. Null and empty texts and null ids match nothing;
    repeated rows of an id are one document; repeated items are found as one. Other columns are not read. Empty tables
    give an empty result. Only matches are shuffled, unless the benchmark is too large to broadcast; texts with matches are read a second time.
    """
    items = benchmark.select(F.col(item_col).alias("item"), canonical(F.col(item_text_col)).alias("words")).filter("item is not null and words <> ''").distinct()
    items = items.withColumn("length", F.least(F.size(F.split("words", " ")), F.lit(WINDOW)))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # WINDOW at most
    sides = []
    for n in lengths:
        own = windows(items.filter(F.col("length") == n), ["item", "words"], n).withColumn("item_window", window_at(F.col("words"), F.col("at"), n))
        own = own.withColumn("worded", mostly_words(F.col("item_window"), n)).filter("worded or exact")
        sides.append(own.select("item", F.col("at").alias("item_at"), "item_window", "hash", "worded", F.lit(n).alias("length")))
    if not sides:  # no items
        return docs.select(id_col).limit(0).select(id_col, *(F.lit(0).cast(k).alias(n) for n, k in ((item_col, "long"), ("n_windows", "long"), ("item_windows", "long"), ("n_slots", "long"), ("n_changed", "long"))), F.lit("").alias("kind"))
    item_side = sides[0]
    for s in sides[1:]:
        item_side = item_side.unionByName(s)
    item_side = materialize(item_side, "leak-items")
    of_item = materialize(item_side.groupBy("item").agg(F.countDistinct("item_at").alias("item_windows"), F.countDistinct(F.when(F.col("worded"), F.col("item_at"))).alias("item_worded")), "leak-sizes")
    small = item_side.count() <= BROADCAST_WINDOWS
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    texts = raw.select("id", canonical(F.col("text")).alias("words"))
    met = None
    for n in lengths:
        own = item_side.filter(F.col("length") == n).drop("length")
        rows = windows(texts, ["id"], n).join(F.broadcast(own) if small else own, "hash").select("id", "item", "item_at", "item_window", "worded", F.lit(n).alias("length"), "at")
        met = rows if met is None else met.unionByName(rows)
    met = materialize(met.distinct(), "leak-met")
    matched = met.join(windows_at(raw, met.select("id", "length", "at").distinct()), ["id", "length", "at"])
    # equal words or templates; as an equation it would become a join key
    same = lambda f: F.startswith(F.concat(f(F.col("window")), F.lit("|")), F.concat(f(F.col("item_window")), F.lit("|")))
    matched = matched.filter(same(plain) | (F.col("worded") & same(template)))
    # equal words have equal values, whatever the slots that the document's case gives them
    now = F.when(same(plain), F.col("item_window")).otherwise(F.col("window"))
    matched = materialize(matched.select("id", "item", "item_at", "worded", (F.col("at") - F.col("item_at")).alias("shift"), now.alias("window"), "item_window"), "leak-matches")

    slots = matched.filter("instr(item_window, '#') > 0").select("id", "item", "shift", F.explode(F.arrays_zip(_values("item_window").alias("was"), _values("window").alias("now"))).alias("s"))
    slots = slots.select("id", "item", "shift", "s.was", "s.now").distinct()
    renaming = slots.groupBy("id", "item", "shift").agg(
        F.countDistinct("was").alias("n_was"), F.countDistinct("now").alias("n_now"), F.count("*").alias("n_slots"), F.sum((F.col("was") != F.col("now")).cast("int")).alias("n_changed")
    )
    aligned = matched.groupBy("id", "item", "shift").agg(F.collect_set("item_at").alias("ats"), F.collect_set(F.when(F.col("worded"), F.col("item_at"))).alias("worded_ats"))  # as many as the item has windows
    whole = aligned.join(renaming, ["id", "item", "shift"], "left").filter("n_slots is null or (n_was = n_slots and n_now = n_slots)")
    union = lambda ats: F.size(F.array_distinct(F.flatten(F.collect_set(ats)))).cast("long")
    found = whole.groupBy("id", "item").agg(
        union("ats").alias("n_windows"), union("worded_ats").alias("n_worded"), F.coalesce(F.max("n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.min("n_changed"), F.lit(0)).alias("n_changed")
    )
    enough = lambda n, of: (F.col(of) > 0) & (F.col(n) >= F.least(F.lit(least_windows), F.col(of))) & (F.col(n) >= least_share * F.col(of))
    found = found.join(of_item, "item").filter(enough("n_windows", "item_windows") | enough("n_worded", "item_worded"))
    kind = F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "item_windows", "n_slots", "n_changed", kind.alias("kind"))
