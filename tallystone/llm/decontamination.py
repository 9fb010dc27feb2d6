r"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z have been lower-cased. A window is ``window`` consecutive
words of an item; an item with fewer words, but some, is one window. Document words inside any occurrence of a window
are hit.

Of every ``window - gram + 1`` consecutive grams of ``gram`` words the least hash is kept as a fingerprint, of
documents and of items alike. A shared span of ``window`` words holds the same grams in both texts, so it shares
their least: no occurrence can be missed. Documents' fingerprints join the items'. Hits are extended to whole windows by
comparing the words themselves, so hashes add nothing to the result. Short items have fingerprints for their own length.

Scale: a document's words, hashes and minima are array expressions in its own row; only fingerprints are exploded, and
they meet the items' table where it lies if that is measured to be small, else in a shuffle join. Only documents with a
shared fingerprint are split into windows. Equal windows are one row whatever the number of items with them: a window
carries the key of its set of items, and sets are resolved once per distinct combination, so neither a hot passage nor
repeated items multiply rows.

Null or empty texts have no words. Rows with equal doc_id and text share one result and each keep a row; rows with equal
doc_id but different texts are separate. Null doc_ids work. Items without an id mark words but are neither counted nor
listed; repeated items count once. Further columns pass (``clean``) or are ignored (``contamination``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm._shared import Scratch, ascii_lower

WINDOW, GRAM = 10, 6

#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]+``, breaks between lower-cased words, and words of a text as it is. Characters one by one, not in
#: ranges, make Java look them up in a table, in half the time.
_BREAK = "[" + "".join(rf"\x{c:02x}" for c in range(128) if not chr(c).isdigit() and not chr(c).islower()) + "]+"
_WORD = "[^" + "".join(rf"\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _grams(k: int) -> Column:
    """Hashes of all runs of k words."""
    at = F.sequence(F.lit(0), F.size("h") - k)
    return F.when(F.size("h") >= k, F.transform(at, lambda i: F.xxhash64(*(F.get(F.col("h"), i + j) for j in range(k)))))


def _minima(grams: str, w: int) -> Column:
    """The least of each w consecutive hashes, without repeats."""
    starts = F.sequence(F.lit(0), F.size(grams) - w)
    least = F.transform(starts, lambda i: F.least(*(F.get(F.col(grams), i + j) for j in range(w)))) if w > 1 else F.col(grams)
    return F.array_distinct(F.coalesce(F.when(F.size(grams) >= w, least), F.array().cast("array<bigint>")))


def _with_fingerprints(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Adds ``prints``: for each window length the fingerprints of the row's windows. Needs the words' hashes, ``h``."""

    def named(length: int, k: int) -> Column:
        return F.transform(_minima(f"g{k}", length - k + 1), lambda x: F.struct(F.lit(length).alias("length"), x.alias("print")))

    df = df.withColumns({f"g{k}": _grams(k) for k in sorted({min(n, gram) for n in lengths})})
    return df.withColumn("prints", F.concat(*(named(n, min(n, gram)) for n in lengths)))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))


def _each(array: Column) -> Column:
    """``explode_outer``: for ``explode`` Spark would test the array's size first, evaluating all its parts anew, one in another.

    A row without elements gives a null, which meets nothing in the inner joins that follow."""
    return F.explode_outer(array)


def _windows(length: Column) -> Column:
    """(start, text) of all runs of ``length`` words."""
    return F.when(F.size("words") >= length, F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.struct((i - 1).alias("start"), F.array_join(F.slice(F.col("words"), i, length), " ").alias("span"))))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, mark: str = "mark") -> DataFrame:
    """(doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs(doc_id, text)``.

    ``items(item_id, text)`` is the benchmark; ``mark`` is a hash of the document's text.
    """
    scratch = Scratch(spark, "decontamination")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = scratch.keep(items.withColumn("length", F.least(F.size("words"), F.lit(window))), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect()) or [window]

    prints = _with_fingerprints(_hashed(items), lengths, gram).select("length", _each(F.col("prints")).alias("p")).where("length = p.length")
    prints = scratch.keep(prints.select("p.length", "p.print").distinct(), "prints")
    spans = items.select("item_id", "length", _each(_windows(F.col("length"))).alias("w")).groupBy("length", "w.span").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    spans = scratch.keep(spans.withColumn("ids_key", F.sha2(F.to_json("ids"), 256)), "spans")
    sets = spans.groupBy("ids_key").agg(F.first("ids").alias("ids"))
    spans_kept = scratch.keep(spans.select("length", "span", "ids_key"), "span-keys")

    first = _with_fingerprints(_hashed(docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("words"))), lengths, gram)
    met = first.select("doc_id", "mark", _each(F.col("prints")).alias("p")).select("doc_id", "mark", F.col("p.length").alias("length"), F.col("p.print").alias("print"))
    met = scratch.keep(met.join(scratch.small(prints, "prints"), ["length", "print"], "left_semi").select("doc_id", "mark", "length").distinct(), "met")

    near = scratch.small(met.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "length"), "met")
    again = docs.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("m"))).select("doc_id", F.col("m").alias("mark"), "length", words(F.col("text")).alias("words"))
    runs = again.select("doc_id", "mark", "length", _each(_windows(F.col("length"))).alias("w")).select("doc_id", "mark", "length", "w.start", "w.span")
    hits = runs.join(scratch.small(spans_kept, "span-keys"), ["length", "span"]).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("at"), F.sort_array(F.collect_set("ids_key")).alias("keys"))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"))

    hits = scratch.keep(hits.select("doc_id", "mark", F.aggregate("at", begin, cover)["n"].alias("n_hit"), "keys"), "hits")
    named = hits.select("keys").distinct().select("keys", F.explode("keys").alias("ids_key")).join(sets, "ids_key").select("keys", F.explode_outer("ids").alias("id"))
    named = named.groupBy("keys").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("keys", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    named = scratch.keep(hits.join(named, "keys").select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "n_hit", "n_items", "items_sha256"), "named")
    scratch.clear("named")
    counted = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = counted.join(scratch.small(named, "named"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", F.col("mark").alias(mark), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, that hold no window of any item."""
    scratch = Scratch(spark, "clean")
    d, m = "__tallystone_id", "__tallystone_mark"
    bad = contamination(spark, docs, items, window, gram).where("contaminated").select(F.col("doc_id").alias(d), F.col("mark").alias(m)).distinct()
    bad = scratch.small(scratch.keep(bad, "bad"), "bad")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"].cast("string")) == F.col(m)), "left_anti")
