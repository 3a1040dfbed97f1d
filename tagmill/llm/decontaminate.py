"""Benchmark decontamination by template canonicalisation, with SQL functions only.

Texts become templates: numbers, units after numbers and names (capitalised words inside a sentence) turn into typed
placeholders that still carry what they stood for; other words are lower case without marks. Windows of five template
words are hashed and joined with the benchmark's windows. A window that holds names is hashed twice, with names as
placeholders and as plain words, so that a change of letter case hides nothing. A window of placeholders only stands for
their contents: lists of numbers don't match each other, but are found when copied.

Slots are then compared: within one alignment (document place minus item place) each thing in the item must always
stand for the same thing in the document: the one it stands for most often. Windows that hold a slot against this
don't count; the others of the alignment do. An item is found in a document if 0.8 or more of its windows are.

Texts are cut into windows in one pass, whatever the benchmark's size. Up to `portion` windows of the benchmark are
broadcast; more meet the windows of texts in a shuffled join, after a broadcast table of a million cells at most has
let through those whose cell a benchmark window has. Only windows found are shuffled; the texts with enough windows of an
item cross the network once, to compare slots, and a few others whose hash falls on a cell of theirs.

Null texts count as empty, very long ones are read whole. Items of fewer than five words match nothing; each letter of a
script without spaces is a word. A repeated row gives its result once; rows with one doc_id and different texts are told
apart. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, SIMILARITY, PORTION, CELLS = 5, 0.8, 100_000, 1 << 20
_UNITS = "kilometers|kilometres|kilograms|centimeters|centimetres|millimeters|millimetres|milliliters|millilitres|meters|metres|miles|minutes|seconds|hours|days|weeks|months|years|dollars|euros|pounds|cents|percent|degrees|liters|litres|grams|feet|inches|yards|acres|ounces|watts|volts|joules|newtons|kmh|mph|rpm|usd|eur|gbp|km|kg|cm|mm|ml|mg|lbs|lb|oz|ft|hz|khz|mhz|ghz|kw|kb|mb|gb|tb|pm|am|m|g|l|s|h|w|v"
_NUMBER = r"\p{Sc}?[0-9](?:[0-9.,]*[0-9])?"
_MARKS = "".join(chr(c) for c in [*range(32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 192)])


def template_words(text: Column) -> Column:
    """Words of the template; those that begin with qnumq, qunitq or qnameq are slots and end in their contents."""
    t = F.regexp_replace(common.spaced(text), r"\p{Lu}(?<=[\p{L}\p{N},;][ \n].)(\p{Ll}+)", " qnameq$0")
    t = F.regexp_replace(t, rf"({_NUMBER})(?:[ -]?(%|°[CF]?|(?i:{_UNITS})\b))", " qnumq$1 qunitq$2 ")
    t = F.regexp_replace(t, rf"(?<![\p{{L}}0-9.,\p{{Sc}}]){_NUMBER}", " qnumq$0 ")
    return F.array_remove(F.split(F.translate(F.lower(t), _MARKS.replace(".", "").replace(",", "").replace("%", "").replace("°", ""), " " * (len(_MARKS) - 4)), r"[ .,]*(?: |\z)[ .,]*"), "")


def _typed(w: Column, names: bool) -> Column:
    """What of a word counts in a window."""
    name = F.lit("qnameq") if names else F.substring(w, 7, 1 << 30)
    return F.when(~F.startswith(w, F.lit("q")), w).when(F.startswith(w, F.lit("qnumq")), "qnumq").when(F.startswith(w, F.lit("qunitq")), "qunitq").when(F.startswith(w, F.lit("qnameq")), name).otherwise(w)


def _windows(words: Column, names: bool, size: int) -> Column:
    h = F.transform(words, lambda w: F.xxhash64(_typed(w, names)))
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.struct(h.alias("h"), starts.alias("s"))


def _exploded(df: DataFrame, keys: list[str], words: str, size: int) -> DataFrame:
    """(keys, at, w): each window's hash, with names as slots and, where that differs, as words."""
    slot = lambda w: w.rlike("^q(num|unit|name)q")
    told = df.select(*keys, _windows(F.col(words), True, size).alias("b"), F.exists(words, lambda w: F.startswith(w, F.lit("qnameq"))).alias("named"), words)
    told = told.withColumn("a", F.when(F.col("named"), _windows(F.col(words), False, size)["h"]))
    # windows of slots only say nothing about a template: they stand for their contents
    bare = F.when(F.size(F.filter(words, slot)) >= size, F.struct(F.transform(words, lambda w: slot(w).cast("int")).alias("is"), F.transform(words, lambda w: F.xxhash64(F.lit("="), w)).alias("h")))
    told = told.select(*keys, "a", "b", bare.alias("c"))
    at = lambda c, i: F.xxhash64(*[c[i + k] for k in range(size)])
    full = lambda i: sum((F.col("c.is")[i + k] for k in range(1, size)), F.col("c.is")[i]) == size
    one = F.transform(F.col("b.s"), lambda i: F.array(at(F.col("b.h"), i)))
    two = F.transform(F.col("b.s"), lambda i: F.array_distinct(F.array(at(F.col("b.h"), i), at(F.coalesce("a", "b.h"), i))))
    three = F.transform(F.col("b.s"), lambda i: F.when(full(i), F.array(at(F.col("c.h"), i))).otherwise(F.array_distinct(F.array(at(F.col("b.h"), i), at(F.coalesce("a", "b.h"), i)))))
    listed = told.select(*keys, F.posexplode(F.when(F.col("c").isNotNull(), three).when(F.col("a").isNull(), one).otherwise(two)).alias("at", "ws"))
    return listed.select(*keys, "at", F.explode("ws").alias("w"))


def found_items(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, size: int = WINDOW, portion: int = PORTION) -> DataFrame:
    """doc_id, item_id, n_found, n_windows, share, _id, _th for each item that a document holds."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *common.row_key("doc_id", "text"))
    worded = keyed.select("_id", "_th", template_words(F.col("text")).alias("words"))
    bench = common.cut(items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), template_words(F.col("text")).alias("iw"), F.xxhash64("text").alias("ih")).distinct())
    n_windows = F.greatest(F.size("iw") - F.lit(size - 1), F.lit(1))
    grams = common.cut(_exploded(bench.withColumn("n_windows", n_windows), ["item_id", "ih", "n_windows"], "iw", size))
    few = grams.count() <= portion
    listed = _exploded(worded, ["_id", "_th"], "words", size).withColumnRenamed("at", "p")
    if not few:
        # at most CELLS rows are broadcast, whatever the benchmark's size
        cell = F.pmod("w", F.lit(CELLS)).cast("int")
        listed = listed.withColumn("_cell", cell).join(F.broadcast(grams.select(cell.alias("_cell")).distinct()), "_cell", "left_semi")
    asked = grams.withColumnRenamed("at", "q")
    hits = listed.join(F.broadcast(asked) if few else asked, "w").select("_id", "_th", "p", "item_id", "ih", "q", "n_windows").distinct()
    # slots can only take windows away: an item of which too few are hit is not found, and its text need not be read
    enough = hits.groupBy("_id", "_th", "item_id", "ih", "n_windows").agg(F.collect_list(F.struct("p", "item_id", "ih", "q")).alias("at"))
    enough = enough.where(F.size(F.array_distinct(F.transform("at", lambda x: x["q"]))) / F.col("n_windows") >= similarity)
    by_doc = common.cut(enough.groupBy("_id", "_th").agg(F.flatten(F.collect_list("at")).alias("hits")))
    # slots, only in documents with hits; a broadcast table of CELLS cells at most keeps the other texts out of the shuffle
    place = F.pmod(F.xxhash64("_id", "_th"), F.lit(CELLS)).cast("int")
    asked_for = keyed.select("_id", "_th", "doc_id", "text").withColumn("_cell", place).join(F.broadcast(by_doc.select(place.alias("_cell")).distinct()), "_cell", "left_semi").drop("_cell")
    texts = asked_for.join(by_doc, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    near = texts.select("doc_id", "_id", "_th", template_words(F.col("text")).alias("words"), "hits")
    cut_out = F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), x["ih"].alias("ih"), x["p"].alias("p"), x["q"].alias("q"), F.slice("words", x["p"] + 1, size).alias("dw")))
    pairs = near.select("doc_id", "_id", "_th", F.explode(cut_out).alias("x")).select("doc_id", "_id", "_th", "x.*")
    with_items = pairs.join(bench, ["item_id", "ih"])
    is_slot = lambda x: x.rlike("^q(num|unit|name)q")
    slots = F.filter(F.zip_with(F.slice("iw", F.col("q") + 1, size), F.col("dw"), lambda i, d: F.struct(i.alias("i"), d.alias("d"))), lambda s: is_slot(s["i"]) & is_slot(s["d"]))
    lines = with_items.select("doc_id", "_id", "_th", "item_id", "ih", "q", (F.col("p") - F.col("q")).alias("diagonal"), slots.alias("slots"), n_windows.alias("n_windows"))
    # the windows of one alignment, and its votes: how often each thing of the item stands for each of the document
    tested = lines.groupBy("doc_id", "_id", "_th", "item_id", "ih", "n_windows", "diagonal").agg(F.collect_list(F.struct("q", "slots")).alias("ws"), F.flatten(F.collect_list("slots")).alias("votes"))
    cast = tested.withColumn("kinds", F.array_distinct("votes"))
    # a count for each distinct pair, then for each thing of the item its most frequent partner (of equals the one that is unchanged, then the smallest)
    counted = F.transform("kinds", lambda x: F.struct(x["i"].alias("i"), F.size(F.filter("votes", lambda v: v == x)).alias("n"), (x["i"] == x["d"]).alias("same"), x["d"].alias("d")))
    cast = cast.withColumn("counted", counted)
    beaten = F.transform(F.filter("counted", lambda x: F.exists("counted", lambda y: (y["i"] == x["i"]) & ((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["same"] & ~x["same"] | (y["same"] == x["same"]) & (y["d"] < x["d"])))))), lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d")))
    cast = cast.withColumn("beaten", beaten)
    # only windows that hold a slot against the majority go: one altered slot costs at most `size` windows
    good = F.transform(F.filter("ws", lambda w: ~F.arrays_overlap(w["slots"], F.col("beaten"))), lambda w: w["q"])
    scored = cast.select("doc_id", "_id", "_th", "item_id", "ih", "n_windows", F.explode(good).alias("q")).groupBy("doc_id", "_id", "_th", "item_id", "ih", "n_windows").agg(F.countDistinct("q").cast("int").alias("n_found"))
    shared = scored.withColumn("share", F.col("n_found") / F.col("n_windows")).where(F.col("share") >= similarity)
    return shared.select("doc_id", "item_id", F.col("n_found").cast("long").alias("n_found"), F.col("n_windows").cast("long").alias("n_windows"), "share", "_id", "_th")
