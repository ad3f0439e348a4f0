"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every k consecutive words have a hash, and of every w consecutive hashes the smallest is kept as
a fingerprint. Two texts that share k + w - 1 words in a row therefore share a
fingerprint. With k = 5 and w = 6 that is a window of ten words, which is what has to be found.

1. Documents are winnowed once and staged with their fingerprints.
2. Fingerprints of documents and of benchmark windows are joined. Only documents that meet go on.
3. Around each meeting hash all windows of a document are compared with the items' windows as text.

An item of fewer words than a window is one window itself; for each such length that occurs,
hashes of that many words are all kept. The benchmark is read in full; nothing is broadcast
unless Spark finds its staged fingerprints small enough.

Null texts have no words. Rows without doc_id keep a row. Rows of equal id and text are each
reported alike; rows of equal id and different text each for itself. Items without an id mark words like
all others, but are in no number or list of items; repeated items count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.tables import texts
from wattsift.llm.words import places, words
from wattsift.sources.staging import stage

WINDOW = 10
GRAM = 5


def gram_hashes(found: Column, size: int) -> Column:
    return F.transform(places(F.size(found) - size + 1), lambda i: F.xxhash64(F.slice(found, i, F.lit(size))))


def smallest(hashes: Column, width: int) -> Column:
    """The distinct minima of all windows of that many hashes."""
    if width == 1:
        return F.array_distinct(hashes)
    return F.array_distinct(F.transform(
        places(F.size(hashes) - width + 1), lambda i: F.array_min(F.slice(hashes, i, F.lit(width)))))


def windows(found: Column, size: int) -> Column:
    return F.transform(places(F.size(found) - size + 1), lambda i: F.concat_ws(" ", F.slice(found, i, F.lit(size))))


def _keyed(docs: DataFrame) -> DataFrame:
    # Rows are told apart by id and text, so that ids need not be unique.
    return texts(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """All documents with their numbers of words, and all (document, start, size, item_id) that occur."""
    items = stage(
        benchmark.select(
            F.col("item_id").cast("string").alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("words")).where(
            F.size("words") > 0).distinct(),
        "benchmark-words")
    # At most `window` numbers.
    short = [r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().orderBy("n").collect()]
    classes = [(window, gram, window - gram + 1)] + [(n, n, 1) for n in short]
    split = _keyed(docs).select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    for k, (_, size, _) in enumerate(classes):
        split = split.withColumn(f"h{k}", gram_hashes(F.col("words"), size))
    marked = split.select(
        "doc_id", "text_hash", F.size("words").alias("n_words"),
        *(smallest(F.col(f"h{k}"), width).alias(f"f{k}") for k, (_, _, width) in enumerate(classes)))
    marked = stage(marked, "winnowed")
    found = []
    for k, (size, g, width) in enumerate(classes):
        own = items if size == window else items.where(F.size("words") == size)
        own = own.where(F.size("words") >= size)
        prints = stage(
            own.withColumn("h", gram_hashes(F.col("words"), g)).select(F.explode(smallest(F.col("h"), width)).alias("fp")).distinct(),
            "benchmark-fingerprints")
        pieces = stage(own.select("item_id", F.explode(windows(F.col("words"), size)).alias("piece")).distinct(), "benchmark-windows")
        met = marked.select("doc_id", "text_hash", F.explode(f"f{k}").alias("fp")).join(prints, "fp").groupBy(
            "doc_id", "text_hash").agg(F.collect_set("fp").alias("met"))
        texts_met = _keyed(docs)
        candidates = texts_met.join(met, _same(texts_met, met)).select(
            texts_met["doc_id"], texts_met["text_hash"], words(F.col("text")).alias("words"), "met").withColumn(
            "h", gram_hashes(F.col("words"), g))
        last = F.size("words") - size + 1
        # Starts of the windows that hold a hash which was met.
        starts = F.array_distinct(F.flatten(F.transform(
            F.filter(places(F.size("h")), lambda i: F.array_contains(F.col("met"), F.get("h", i - 1))),
            lambda p: F.sequence(F.greatest(F.lit(1), p - (size - g)), F.least(p, last)))))
        near = candidates.where(last >= 1).select("doc_id", "text_hash", "words", F.explode(starts).alias("start")).select(
            "doc_id", "text_hash", "start", F.concat_ws(" ", F.slice("words", F.col("start"), F.lit(size))).alias("piece"))
        found.append(near.join(pieces, "piece").select("doc_id", "text_hash", "start", F.lit(size).alias("size"), "item_id"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return marked.select("doc_id", "text_hash", "n_words"), every


def covered(spans: Column) -> Column:
    """How many places sorted spans (start, end) cover together; an end is the place after the last."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        spans, start,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["reach"]))).alias("n"),
            F.greatest(s["reach"], x["end"]).alias("reach")),
        lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    counted, found = occurrences(docs, benchmark, window, gram)
    spans = found.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = spans.select("doc_id", "text_hash", covered(F.col("spans")).alias("hit"), "items")
    none = F.array().cast("array<string>")
    return counted.join(spans, _same(counted, spans), "left").select(
        counted["doc_id"], F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All columns of the documents that share no window with the benchmark."""
    _, found = occurrences(docs, benchmark, window, gram)
    hit = found.select("doc_id", "text_hash").distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].cast("long").eqNullSafe(hit["doc_id"]) & (text_hash == hit["text_hash"])
    return docs.join(hit, same, "left_anti")
