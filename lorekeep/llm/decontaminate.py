"""Operator 8: benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, units after numbers and names become typed placeholders; windows of template words of the benchmark meet those
of documents in a hash join. Values that fill the placeholders of matching windows must map one to one between an item
and its occurrence in a document, so a re-parameterised question is caught and a chance likeness of form is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, drop

#: Template words of a window, windows that make a leak (or all of a shorter item), literal words that a window needs to be met by its form.
WINDOW, LEAST_WINDOWS, LEAST_LITERAL = 8, 3, 4
#: Benchmark windows are broadcast up to so many; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: Leaks of which ids and hashes of texts are broadcast; beyond, documents are shuffled.
BROADCAST_LEAKS = 500_000
#: Units that may follow a number.
UNITS = "km|m|cm|mm|kg|g|mg|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|feet|foot|inch(?:es)?|pounds?|lbs?|ounces?|oz|dollars?|euros?|eur|usd|percent|degrees?|meters?|metres?|kilometers?|kilometres?|liters?|litres?|grams?|kilograms?|cents?|people|items?|points?|times"
SLOTS = ("numslot", "unitslot", "nameslot")


def _joined_numbers(text: Column) -> Column:
    """Numbers without separators, so that each is one word."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")).otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _template(text: Column) -> Column:
    """Words with placeholders, as many as _words(_joined_numbers(text)). A name is a capitalised word right after a word or comma."""
    named = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll}\p{N},;] .)\p{Ll}+(?![\p{L}\p{N}])", "nameslot")
    plain = _joined_numbers(named)
    numbered = F.regexp_replace(plain, r"(?<![\p{L}0-9])[0-9]++(?![\p{L}0-9])", "numslot")
    united = F.regexp_replace(numbered, rf"(?i)(?<=numslot[\x20-])(?:{UNITS})(?![\p{{L}}\p{{N}}])", "unitslot")
    return _words(F.when(named.rlike("[0-9]"), united).otherwise(named))


def _windows(df: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """keys, size, at and h of each window of df.t (words as hashes). The hashes alone are exploded."""
    parts = []
    for n in sizes:
        # a filter on the size would be pushed below, and make the words twice
        each = F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.xxhash64(F.slice("t", i, n))))
        parts.append(df.select(*keys, F.lit(n).alias("size"), F.posexplode(each).alias("at", "h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_to_one(pairs: Column) -> Column:
    n = F.size(pairs)
    return (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"])))) & (n == F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))))


def _occurrences(values: DataFrame, enough: int) -> DataFrame:
    """doc_id, lk_text, item_id, n, pairs: the windows with slots of the best occurrence of an item, and its pairs of values.

    Windows of one place (at - b_at) are one occurrence, left out unless its values map one to one. Where no place has
    enough windows, as words were put in or left out, places whose values agree are taken together, those with most windows first.
    """
    keys = ["doc_id", "lk_text", "item_id"]
    each = values.groupBy(*keys, "place").agg(F.array_sort(F.collect_set("b_at")).alias("at"), F.array_sort(F.collect_set("p")).alias("pairs")).where(_one_to_one(F.col("pairs")))
    places = each.select(*keys, F.struct((-F.size("at")).alias("less"), "at", "pairs").alias("o"))
    best = places.groupBy(*keys).agg(F.min("o").alias("o"), F.array_sort(F.collect_set("o")).alias("all"))
    kept = lambda o: F.struct(o["at"].alias("at"), o["pairs"].alias("pairs"))

    def step(acc, o):
        agrees = lambda c: _one_to_one(F.array_union(c["pairs"], o["pairs"]))
        both = lambda c: F.struct(F.array_union(c["at"], o["at"]).alias("at"), F.array_union(c["pairs"], o["pairs"]).alias("pairs"))
        return F.when(F.exists(acc, agrees), F.transform(acc, lambda c: F.when(agrees(c), both(c)).otherwise(c))).otherwise(F.concat(acc, F.array(kept(o))))

    groups = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.array(kept(F.col("o"))), step)
    counts = lambda c: F.struct(F.size(c["at"]).alias("n"), F.size(c["pairs"]).alias("pairs"))
    found = F.when(-F.col("o.less") >= enough, counts(F.col("o"))).otherwise(F.array_max(F.transform(groups, counts)))
    return best.select(*keys, found.alias("f")).select(*keys, "f.n", "f.pairs")


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, lk_text (hash of the text): a row for each document and benchmark item with a leak.

    A leak is at least so many windows of the item, or all of a shorter one, found with slots consistent within an
    occurrence; n_windows and n_slots are of the best one. Windows of fewer than four literal words count only where their
    values are equal; a copy with other values needs so many, or all, of the other windows. Windows with names are also
    met by their words as they stand, whatever their case. Items of fewer words than a window are one window of their own
    length. Null or empty texts, and items or documents without words, match nothing; null ids are kept; repeated rows
    count once; extra columns are ignored.
    """
    literal = lambda ws: F.size(F.filter(ws, lambda w: ~w.isin(*SLOTS)))
    items = benchmark.where("text is not null").select("item_id", F.col("text").alias("b")).distinct()
    items = items.select("item_id", _template(F.col("b")).alias("w"), _words(_joined_numbers(F.col("b"))).alias("raw")).where(F.size("w") > 0)
    items = items.select("item_id", "w", "raw", F.transform("w", lambda x: F.xxhash64(x)).alias("t"), F.least(F.size("w"), F.lit(window)).alias("n"))
    sizes = [r.n for r in items.select("n").distinct().collect()]
    text = F.xxhash64("text").alias("lk_text")
    if not sizes:
        return documents.select("doc_id", F.lit(0).alias("item_id"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("item_windows"), F.lit(0).cast("long").alias("n_slots"), text).limit(0)
    own = _windows(items, ["item_id", "n", "w", "raw"], sizes).where("size = n")
    own = own.select("item_id", "size", F.col("at").alias("b_at"), "h", F.slice("w", F.col("at") + 1, F.col("size")).alias("ws"), F.slice("raw", F.col("at") + 1, F.col("size")).alias("b_raw"))
    # windows of few literal words are common forms, so their values must be equal, too: they are met by their words as
    # they stand; so are those with names, which the template of a text in lower case does not show
    own = own.withColumns({"few": literal(F.col("ws")) < F.least(F.lit(LEAST_LITERAL), F.col("size")), "raw_h": F.xxhash64(F.transform("b_raw", lambda x: F.xxhash64(x)))})
    own = own.withColumn("plain", F.col("few") | F.array_contains("ws", SLOTS[2]))
    own = cut(own.select("item_id", "size", "b_at", "h", "raw_h", "b_raw", "few", "plain", F.transform("ws", lambda w: w.isin(*SLOTS)).alias("slot")), "windows")
    counted = own.groupBy("item_id").agg(F.count("*").alias("item_windows"), F.count_if(~F.col("few")).alias("form_windows"))
    small = own.count() <= BROADCAST_WINDOWS
    hint = F.broadcast if small else lambda df: df
    docs = documents.where("text is not null").select("doc_id", text, F.transform(_template(F.col("text")), lambda x: F.xxhash64(x)).alias("t"))
    keys = own.where(~F.col("few")).select("h", "size", "item_id", "b_at", "few", F.exists("slot", lambda x: x).alias("has"))
    met = _windows(docs, ["doc_id", "lk_text"], sizes).join(hint(keys), ["h", "size"])
    lengths = [r.size for r in own.where("plain").select("size").distinct().collect()]
    if lengths:
        plain = documents.where("text is not null").select("doc_id", text, F.transform(_words(_joined_numbers(F.col("text"))), lambda x: F.xxhash64(x)).alias("t"))
        keys = own.where("plain").select(F.col("raw_h").alias("h"), "size", "item_id", "b_at", "few", F.lit(False).alias("has"))
        met = met.unionByName(_windows(plain, ["doc_id", "lk_text"], lengths).join(hint(keys), ["h", "size"]))
    # where a window is met by form, too, its slots decide
    met = cut(met.groupBy("doc_id", "lk_text", "item_id", "size", "at", "b_at", "few").agg(F.bool_or("has").alias("has")), "met")
    # values of slots, of the few documents with a match that has any
    some = met.where("has").select("doc_id", "lk_text").distinct()
    number = lambda c: F.countDistinct(F.when(c, F.col("b_at")))
    # windows met by form without slots, those of few literal words, and all that are met word by word
    fits = met.groupBy("doc_id", "lk_text", "item_id").agg(number(~F.col("has") & ~F.col("few")).alias("n_plain"), number(F.col("few")).alias("n_few"))
    fits = fits.withColumn("n_form", F.col("n_plain"))
    if some.isEmpty():
        fits = fits.withColumn("n_slots", F.lit(0).cast("long"))
    else:
        few = some.count() <= BROADCAST_WINDOWS
        same = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["lk_text"] == b["lk_text"])
        texts = documents.where("text is not null").select("doc_id", text, "text")
        wanted = F.broadcast(some) if few else some
        raws = texts.join(wanted, same(texts, wanted), "left_semi").distinct().select("doc_id", "lk_text", _words(_joined_numbers(F.col("text"))).alias("raw"))
        parts = own.select(F.col("item_id").alias("o_item"), F.col("b_at").alias("o_at"), "b_raw", "slot")
        full = met.where("has").join(hint(parts), F.col("item_id").eqNullSafe(F.col("o_item")) & (F.col("b_at") == F.col("o_at")))
        full = full.alias("f").join(raws.alias("r"), (F.col("f.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("f.lk_text") == F.col("r.lk_text")))
        pair = F.arrays_zip("slot", F.col("b_raw").alias("b"), F.slice("raw", F.col("at") + 1, F.col("size")).alias("d"))
        values = full.select("f.doc_id", "f.lk_text", "item_id", (F.col("at") - F.col("b_at")).alias("place"), "b_at", F.explode(F.filter(pair, lambda p: p["slot"])).alias("p"))
        best = _occurrences(values.select("doc_id", "lk_text", "item_id", "place", "b_at", F.struct("p.b", "p.d").alias("p")), least_windows)
        best = best.select(F.col("doc_id").alias("c_doc"), F.col("lk_text").alias("c_text"), F.col("item_id").alias("c_item"), "n", "pairs")
        joined = fits.join(best, fits.doc_id.eqNullSafe(F.col("c_doc")) & (fits.lk_text == F.col("c_text")) & fits.item_id.eqNullSafe(F.col("c_item")), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        fits = joined.select("doc_id", "lk_text", "item_id", (F.col("n_form") + zero("n")).alias("n_form"), "n_plain", "n_few", zero("pairs").alias("n_slots"))
    # a changed copy can only be found by the windows that are met by form
    enough = lambda n, of: (F.col(of) > 0) & (n >= F.least(F.lit(least_windows), F.col(of)))
    found = F.greatest("n_form", "n_plain") + F.col("n_few")
    leak = enough(F.col("n_form"), "form_windows") | enough(found, "item_windows")
    return fits.join(hint(counted), fits.item_id.eqNullSafe(counted.item_id)).where(leak).select("doc_id", fits.item_id, found.alias("n_windows"), "item_windows", "n_slots", "lk_text")


def keep_clean(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents whose text has no leak, with their columns."""
    bad = cut(leaks(documents, benchmark, **how).select("doc_id", "lk_text").distinct(), "leaks")
    n = bad.count()
    if not n:
        drop(bad)
        return documents
    bad = F.broadcast(bad) if n <= BROADCAST_LEAKS else bad
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.lk_text"))
    return documents.alias("d").join(bad.alias("b"), same, "left_anti")
