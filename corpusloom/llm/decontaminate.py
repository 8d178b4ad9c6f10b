"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Tokens are numbers and runs of letters. A token's raw form is its lower-case text; its template form is <num> for a number,
<unit> for a unit of measure, <name> for a word with a capital, and the raw form otherwise. Windows of five tokens of the
documents are joined by hash with those of the benchmark, in raw form and, where they hold a placeholder and two literal
words at least, in template form. For a document that covers enough of an item, windows are aligned again. An alignment (shift) is how far
a window stands in the document from where it stands in the item. Alignments whose shifts follow each other with gaps of at
most half the item's windows are one occurrence of the item, with words put in or left out. In an occurrence each window of the item
is taken from the alignment that finds most windows (at equal numbers the first), so that phrases that an item repeats do not
count twice, and then the slots of all its template windows must agree, over all alignments and both ways: each value of the item
stands for one value in the document, and no value in the document for two of the item. Template windows that hold a value for which
this is not so do not count. A document is contaminated by an item when 80 % of the item's windows are found: raw ones
anywhere, and consistent ones of one occurrence.

It is contaminated as well when 80 % of the item's tokens are covered. For this each alignment in which one window is shared is
compared token by token: a token is met by itself or by a placeholder of its kind. Runs of five met tokens and more count, of all
alignments of an occurrence together, the longest first; the slots in what a run adds must agree both ways with each other and with
those of the runs before it, or only tokens that are met by themselves count in it. A single run of RUN met tokens, if its
slots agree, is enough for a long item. So neither windows with fewer than two literals nor a changed word, which stands in five
windows, lose an item. n_windows, n_found and n_exact count windows as before.

Defined cases: null or empty texts have no windows; a text with fewer than five tokens is one window, so that it only
meets equal texts, but with short_inside, as the query and the pipeline ask for, longer documents hold items of that size too; a null doc_id or item_id is reported under null, and documents without doc_id are not removed; rows
with one id are judged together; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

WINDOW, PERCENT = 5, 80
#: Consecutive tokens of an item, met in one alignment, that are enough by themselves.
RUN = 13
#: Windows of the benchmark up to which they are broadcast (40 bytes each at most); beyond it the join shuffles.
BROADCAST_WINDOWS = 500_000
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"
# Units of measure of the corpus' languages: symbols, English, German, French, Spanish.
UNITS = (
    "kg km cm mm ml kb mb gb mph meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees "
    "gramm kilogramm pfund zoll fuß meile meilen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes livre livres pouce pouces seconde secondes heure heures jour jours semaine semaines mois année années centimes pourcent degré degrés "
    "metro metros kilómetro kilómetros milla millas gramo gramos kilogramo kilogramos kilo kilos libra libras pulgada pulgadas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares céntimo céntimos grado grados"
).split()
PLACEHOLDERS = ("<num>", "<unit>", "<name>")


def _form(t: Column, otherwise: Column) -> Column:
    """A token's placeholder, or else what stands for a literal."""
    first, low = F.substring(t, 1, 1), F.lower(t)
    return F.when((first >= "0") & (first <= "9"), F.lit(PLACEHOLDERS[0])).when(low.isin(UNITS), F.lit(PLACEHOLDERS[1])).when(low != t, F.lit(PLACEHOLDERS[2])).otherwise(otherwise)


def _literal() -> Column:
    return F.xxhash64(F.lit(""))


def _words(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.expr(f"regexp_extract_all(coalesce(cast(text as string), ''), r'{TOKEN}', 0)").alias("words"))


def _places(tokens: str) -> Column:
    """1, 2, … of the windows; null without tokens. Outer generators stand above, for Spark would compute an inner one's array twice."""
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.greatest(F.size(tokens) - (WINDOW - 1), F.lit(1))))


def _inner(tokens: str, k: int) -> Column:
    """1, 2, … of the windows of k < WINDOW tokens in a longer text; none in others, of which the whole is a window already."""
    return F.when(F.size(tokens) > k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))


def _hashes(df: DataFrame, key: str, place: bool = False, widths: tuple[int, ...] = ()) -> DataFrame:
    """(id, key), or (id, at, key): hashes of raw windows, and of template windows with a placeholder and two literals; widths: of windows below WINDOW to add."""
    words = _words(df, key)
    raw = words.select("id", "words", F.transform("words", lambda t: F.xxhash64(F.lower(t))).alias("raw"))
    slots = raw.select("id", "raw", F.transform("words", lambda t: F.xxhash64(_form(t, F.lit("")))).alias("form"))
    slots = slots.select("id", "raw", F.transform("form", lambda f, i: F.when(f == _literal(), F.get("raw", i)).otherwise(f)).alias("form"), F.concat(F.transform("form", lambda f: F.when(f == _literal(), 0).otherwise(1)), F.array_repeat(F.lit(0), WINDOW)).alias("held"))
    held = lambda i: sum((F.get("held", i + k) for k in range(0, WINDOW - 1)), F.get("held", i - 1))
    kept = lambda i: held(i).between(1, F.least(F.size("form"), F.lit(WINDOW)) - 2)
    pick = (lambda i, k: F.struct(i.alias("at"), k.alias("key"))) if place else (lambda i, k: k)
    whole = F.transform(_places("raw"), lambda i: pick(i, F.xxhash64(F.slice("raw", i, WINDOW))))
    other = F.transform(F.filter(_places("form"), kept), lambda i: pick(i, F.xxhash64(F.lit("template"), F.slice("form", i, WINDOW))))

    def inner(k: int) -> Column:
        fits = lambda i: sum((F.get("held", i + j) for j in range(k - 1)), F.get("held", i - 1)).between(1, k - 2)
        raw_keys = F.transform(_inner("raw", k), lambda i: pick(i, F.xxhash64(F.slice("raw", i, k))))
        return F.concat(raw_keys, F.transform(F.filter(_inner("form", k), fits), lambda i: pick(i, F.xxhash64(F.lit("template"), F.slice("form", i, k)))))

    keys = slots.select("id", F.concat(whole, other, *map(inner, widths)).alias("keys"))
    return keys.select("id", F.inline_outer("keys")).where("key is not null") if place else keys.select("id", F.explode_outer("keys").alias("key")).where("key is not null")


def _windows(df: DataFrame, key: str, widths: tuple[int, ...] = ()) -> DataFrame:
    """(id, at, kind, form, raw): the same windows with their tokens; only for what is known to be a candidate."""
    words = _words(df, key).select("id", F.transform("words", F.lower).alias("raw"), F.transform("words", lambda t: _form(t, t)).alias("tmpl"))
    cut = lambda at, k: F.transform(at, lambda i: F.struct(i.alias("at"), F.slice("raw", i, k).alias("raw"), F.slice("tmpl", i, k).alias("tmpl")))
    made = F.concat(cut(_places("raw"), WINDOW), *[cut(_inner("raw", k), k) for k in widths])
    w = words.select("id", F.inline_outer(made)).where("at is not null")
    literals = F.size(F.filter("tmpl", lambda t: ~t.isin(*PLACEHOLDERS)))
    two = F.array(F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("form")), F.struct(F.when(literals.between(2, F.size("tmpl") - 1), "template").alias("kind"), F.col("tmpl").alias("form")))
    return w.select("id", "at", "raw", F.inline_outer(two)).where("kind is not null").select("id", "at", "kind", "form", "raw")


def _occurrence(shifts: DataFrame, key: list[str], windows: Column) -> DataFrame:
    """shifts with occurrence: numbers of the chains of alignments, in the order of their shifts, that no gap of more than half the windows cuts."""
    rows = Window.partitionBy(*key).orderBy("shift")
    new = F.when(F.col("shift") - F.lag("shift").over(rows) > F.floor(windows / 2), 1).otherwise(0)
    return shifts.withColumn("__new", new).withColumn("occurrence", F.sum("__new").over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def _pairs(slots: Column) -> Column:
    return F.transform(slots, lambda s: F.struct(s["was"].alias("was"), s["raw"].alias("raw")))


def _agree(pairs: Column) -> Column:
    """Whether pairs of an item's value and a document's value are one to one."""
    n = F.size(F.array_distinct(pairs))
    return (F.size(F.array_distinct(F.transform(pairs, lambda x: x["was"]))) == n) & (F.size(F.array_distinct(F.transform(pairs, lambda x: x["raw"]))) == n)


def _runs(line: Column) -> Column:
    """Places of the runs of met tokens in a line of 1 and 0."""
    return F.filter(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1), lambda p: line.substr(p, F.col("width")) == F.repeat(F.lit("1"), F.col("width")))


def _covers(places: Column) -> Column:
    """Whether runs at these places cover PERCENT of the item's tokens."""
    ordered = F.array_sort(places)
    steps = F.transform(ordered, lambda p, i: F.least(F.coalesce(F.get(ordered, i + 1) - p, F.col("width")), F.col("width")))
    return F.lit(100) * F.aggregate(steps, F.lit(0), lambda x, y: x + y) >= F.lit(PERCENT) * F.col("size")


def _covered(docs: DataFrame, benchmark: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, item, sure) of the pairs of which an occurrence covers PERCENT of the item's tokens, or one alignment of which has a run of RUN. An alignment (shift) stands on a window that both
    have and is compared token by token over the whole item, so that windows too dense in placeholders for a key count as well."""
    whole = lambda df, key, *names: _words(df, key).select("id", F.transform("words", F.lower).alias(names[0]), F.transform("words", lambda t: _form(t, t)).alias(names[1]))
    items = whole(benchmark, "item_id", "was", "form").select(F.col("id").alias("__of"), "was", "form").distinct()
    at = hits.select(F.col("id").alias("__id"), "item", F.col("shift").cast("int").alias("shift")).join(items, F.col("item").eqNullSafe(F.col("__of")))
    texts = docs.select("doc_id", "text").join(hits.select(F.col("id").alias("__hit")).distinct(), F.col("doc_id").eqNullSafe(F.col("__hit")), "left_semi")
    both = whole(texts, "doc_id", "raw", "tmpl").join(at, F.col("id").eqNullSafe(F.col("__id")))
    pair = lambda w, i: F.struct((i + 1).alias("at"), w.alias("was"), F.get("raw", i + F.col("shift")).alias("raw"), (F.get("form", i).isin(*PLACEHOLDERS) & (F.get("form", i) == F.get("tmpl", i + F.col("shift")))).alias("slot"))
    lined = both.select("id", "item", "was", "shift", F.transform("was", pair).alias("pairs"))
    line = lambda met: F.array_join(F.transform("pairs", lambda x: F.when(met(x), "1").otherwise("0")), "")
    slots = F.transform(F.filter("pairs", lambda x: x["slot"]), lambda x: F.struct(x["at"].alias("at"), x["was"].alias("was"), x["raw"].alias("raw")))
    lined = lined.select("id", "item", "shift", F.xxhash64("was").alias("of"), F.size("was").alias("size"), F.least(F.size("was"), F.lit(WINDOW)).alias("width"), line(lambda x: (x["was"] == x["raw"]) | x["slot"]).alias("full"), line(lambda x: x["was"] == x["raw"]).alias("bare"), slots.alias("slots"))
    lined = lined.withColumn("places", _runs(F.col("full"))).where(F.size("places") > 0).withColumn("bare_places", _runs(F.col("bare")))
    key = ["id", "item", "of", "size", "width"]
    lined = _occurrence(lined, key, F.col("size") - F.col("width") + 1)
    edges = lambda by: F.filter("places", lambda p: ~F.array_contains("places", p + by))
    within = lambda at, x: (at >= x["first"]) & (at <= x["last"])
    inner = lambda x: F.filter("slots", lambda s: (s["at"] >= x["first"]) & (s["at"] < x["last"] + F.col("width")))
    run = lambda x: F.struct((x["first"] - x["last"]).alias("least"), F.col("shift").alias("shift"), x["first"].alias("first"), x["last"].alias("last"), F.filter("bare_places", lambda p: within(p, x)).alias("bare"), inner(x).alias("slots"))
    runs = F.transform(F.arrays_zip(edges(-1).alias("first"), edges(1).alias("last")), run)
    lined = lined.select(*key, "occurrence", F.col("bare").contains("1" * RUN).alias("long"), runs.alias("runs"))
    alone = F.exists("runs", lambda x: (x["last"] - x["first"] + F.col("width") >= RUN) & _agree(_pairs(x["slots"])))
    held = lined.groupBy(*key, "occurrence").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.bool_or(F.col("long") | alone).alias("long"))
    held = held.where(F.col("long") | _covers(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["first"], x["last"]))))))  # no consistency can add to this

    def add(state: Column, x: Column) -> Column:
        places = F.sequence(x["first"], x["last"])
        new = F.array_except(places, state["places"])
        used = F.filter(x["slots"], lambda s: F.exists(new, lambda p: (s["at"] >= p) & (s["at"] < p + F.col("width"))))
        pool = F.array_union(state["pairs"], _pairs(used))
        fits = _agree(pool)
        return F.struct(F.array_union(state["places"], F.when(fits, places).otherwise(x["bare"])).alias("places"), F.when(fits, pool).otherwise(state["pairs"]).alias("pairs"))

    nothing = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<struct<was:string,raw:string>>").alias("pairs"))
    places = held.withColumn("places", F.aggregate(F.array_sort("runs"), nothing, add, lambda x: x["places"]))
    return places.where(F.col("long") | _covers(F.col("places"))).select("id", "item", F.lit(True).alias("sure"))


def contaminated(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_exact): pairs of a document and an item of which it holds PERCENT of the windows or of the tokens.
    short_inside: items of fewer than WINDOW tokens are looked for inside documents too, in windows of as many tokens as such items have."""
    widths = tuple(sorted(r.k for r in _words(benchmark, "item_id").select(F.size("words").alias("k")).where(f"k between 1 and {WINDOW - 1}").distinct().collect())) if short_inside else ()
    sizes = _words(benchmark, "item_id").groupBy("id").agg(F.max(F.size(_places("words"))).cast("long").alias("n")).select(F.col("id").alias("item"), "n")
    keys = stored(_hashes(benchmark, "item_id", place=True).select(F.col("id").alias("item"), F.col("at").alias("place"), "key").distinct(), "benchmark")
    if keys.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    enough = F.lit(100) * F.col("found") >= F.lit(PERCENT) * F.col("n")
    hits = _hashes(docs, "doc_id", place=True, widths=widths).join(keys, "key").groupBy("id", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.collect_set("place").alias("places"))
    hits = stored(hits, "hits")
    found = hits.select("id", "item", F.explode("places").alias("place")).groupBy("id", "item").agg(F.count_distinct("place").alias("found"))
    windows = _with(found, sizes).where(enough).select("id", "item", F.lit(False).alias("sure"))
    candidates = stored(windows.union(_covered(docs, benchmark, hits)).groupBy("id", "item").agg(F.bool_or("sure").alias("sure")), "suspects")

    ids = candidates.select(F.col("id").alias("__id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    there = _windows(texts, "doc_id", widths)
    mine = _windows(benchmark, "item_id").select(F.col("id").alias("__of"), F.col("at").alias("place"), F.col("kind").alias("__kind"), F.col("form").alias("__form"), F.col("raw").alias("was"))
    pairs = candidates.select(F.col("id").alias("__id"), F.col("item").alias("__item"), "sure")
    theirs = there.join(pairs.drop("sure"), F.col("id").eqNullSafe(F.col("__id")))  # a document's windows meet those of its own candidates only
    met = theirs.join(mine, (F.col("kind") == F.col("__kind")) & (F.col("form") == F.col("__form")) & F.col("__item").eqNullSafe(F.col("__of")))
    met = stored(met.select("id", F.col("__item").alias("item"), "kind", "place", (F.col("at") - F.col("place")).alias("shift"), "form", "was", "raw").distinct(), "aligned")

    pair = ["id", "item"]
    places = _with(met.groupBy(*pair, "shift").agg(F.count_distinct("place").alias("places")), sizes)
    chained = _occurrence(places, pair, F.col("n")).select(*[F.col(k).alias(f"__{k}") for k in (*pair, "shift")], "places", "occurrence")
    met = met.join(chained, F.col("id").eqNullSafe(F.col("__id")) & F.col("item").eqNullSafe(F.col("__item")) & (F.col("shift") == F.col("__shift")))
    rank = F.struct(-F.col("places"), F.col("shift"))
    taken = met.withColumn("best", F.min(rank).over(Window.partitionBy(*pair, "occurrence", "place"))).where(rank == F.col("best"))
    slots = F.filter(F.arrays_zip("form", "was", "raw"), lambda s: s["form"].isin(*PLACEHOLDERS))
    slot = taken.where("kind = 'template'").select(*pair, "occurrence", "place", F.inline(slots))
    of = lambda side: Window.partitionBy(*pair, "occurrence", side)
    two = lambda value, side: F.min(value).over(of(side)) != F.max(value).over(of(side))
    judged = slot.withColumn("bad", two("raw", "was") | two("was", "raw")).groupBy(*pair, "occurrence", "place").agg(F.bool_or("bad").alias("bad"))
    good = met.where("kind = 'raw'").select(*pair, F.lit(-1).cast("long").alias("occurrence"), "place").distinct().union(judged.where("not bad").select(*pair, "occurrence", "place"))
    good = good.withColumn("exact", F.min("occurrence").over(Window.partitionBy(*pair, "place")) == -1)
    by = good.groupBy(*pair, "occurrence").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("exact")).alias("more"))
    exact = F.coalesce(F.sum(F.when(F.col("occurrence") == -1, F.col("all"))), F.lit(0))
    out = by.groupBy(*pair).agg(exact.alias("exact"), (exact + F.max("more")).alias("found"))
    out = pairs.join(out, F.col("id").eqNullSafe(F.col("__id")) & F.col("item").eqNullSafe(F.col("__item")), "left").select(F.col("__id").alias("id"), F.col("__item").alias("item"), "sure", *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in ("found", "exact")])
    out = _with(out, sizes).where(enough | F.col("sure"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_windows"), F.col("found").alias("n_found"), F.col("exact").alias("n_exact"))


def _with(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """found with the number of windows of its item."""
    s = sizes.withColumnRenamed("item", "__of")
    return found.join(s, F.col("item").eqNullSafe(F.col("__of"))).drop("__of")


def decontaminate(docs: DataFrame, benchmark: DataFrame, short_inside: bool = False) -> DataFrame:
    """The documents, with all their columns, that no item contaminates."""
    gone = stored(contaminated(docs, benchmark, short_inside).select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
