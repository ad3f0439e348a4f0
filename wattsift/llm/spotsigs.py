"""SpotSigs document fingerprints, with DataFrame functions only.

Every common word of a text is an anchor. Its signature is the anchor with the chain of the
next two words that are not common, looked for among the eight words after it. Where no signature begins within
eight words to both sides, as in tables, repeated words and other languages, each word is an anchor, chained to the next two.
The fingerprint
of a text is the set of its signatures, 32-bit hashes in ascending order, written as eight hex
digits each. Only a text of one or two words has no chain; it has one signature of its whole content.

Fingerprints are compared by Jaccard similarity. Sets whose lengths differ too much for the
wanted similarity are never compared: the smaller over the larger length bounds it from above.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattsift.llm.tables import texts
from wattsift.llm.words import places, words
from wattsift.sources.staging import stage

# Common words of English, German, French and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they "
    "this to was were which with you we "
    "aber als auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht "
    "noch sich sie sind so über um und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour "
    "que qui sa se ses son sont sur un une vous "
    "al como con cuando del donde el ella ellos entre era esta este fue ha hay las lo los más me mi muy no o para pero por "
    "porque se según si sin sobre su sus también te tu una unos ya y"
).split()
# Scripts that put no blanks between words: Thai to Myanmar, Khmer, Chinese, Japanese, Korean.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]"
CHAIN = 2
REACH = 8
# Rows of a block in which next documents are found; there are never more blocks than the second.
BLOCK_ROWS = 64
MAX_BLOCKS = 16_384
PIECES = 64


def parts(text: Column) -> Column:
    """The words of a text; characters of scripts without blanks are words of their own."""
    return words(F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text))


def signatures(found: Column, text: Column) -> Column:
    """The sorted set of signatures of an array of words."""
    spots = F.transform(places(F.size(found)), lambda i: F.when(
        F.get(found, i - 1).isin(*COMMON),
        _chain(F.get(found, i - 1), F.filter(F.slice(found, i + 1, F.lit(REACH)), lambda w: ~w.isin(*COMMON)))))
    # One element, so that the spots are worked out once and not for every word.
    kept = F.get(F.transform(F.array(spots), lambda spots: F.array_sort(F.array_distinct(F.filter(
        F.concat(spots, _bare(found, spots)), lambda s: s.isNotNull())))), F.lit(0))
    whole = F.array(F.hash(F.lit("whole"), text))
    return F.get(F.transform(F.array(kept), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole)), F.lit(0))


def _bare(found: Column, spots: Column) -> Column:
    return F.transform(places(F.size(found) - CHAIN), lambda i: F.when(
        F.forall(F.slice(spots, F.greatest(i - REACH, F.lit(1)), F.lit(2 * REACH + 1)), lambda s: s.isNull()),
        F.hash(F.lit("bare"), *(F.get(found, i + k - 1) for k in range(CHAIN + 1)))))


def _chain(anchor: Column, after: Column) -> Column:
    return F.when(F.size(after) >= CHAIN, F.hash(anchor, *(F.get(after, F.lit(k)) for k in range(CHAIN))))


def written(found: Column) -> Column:
    return F.concat_ws("", F.transform(found, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a comparison where lengths rule out `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < large * least, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text and signatures of every row."""
    return texts(docs).withColumn("words", parts(F.col("text"))).select(
        "doc_id", "text", signatures(F.col("words"), F.col("text")).alias("sigs"))


def similar_documents(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (doc_id, class_id) and the similar pairs of classes (a, b, likeness).

    Sets are partitioned by length: a class c holds lengths from least**-c to least**-(c+1), so
    similar sets are in the same or neighbouring partitions. Within one, two similar sets share one
    of the first n - ceil(least * n) + 1 of their n signatures in ascending order; sets meet there and
    are then compared. Copies are a class from the start and cost nothing.
    """
    named = stage(
        with_signatures(docs).where("doc_id IS NOT NULL").select("doc_id", "sigs"), "signatures")
    classes = named.groupBy("sigs").agg(F.min("doc_id").alias("class_id"))
    members = named.join(classes, "sigs").select("doc_id", "class_id")
    n = F.size("sigs")
    level = F.floor(F.log(n.cast("double")) / -math.log(least))
    sets = classes.withColumn("level", level).withColumn("front", F.slice("sigs", F.lit(1), (n - F.ceil(n * least) + 1).cast("int")))
    left = sets.select(F.col("class_id").alias("a"), "level", F.explode("front").alias("sig"))
    right = sets.select(
        F.col("class_id").alias("b"), F.explode(F.array(F.col("level"), F.col("level") + 1, F.col("level") - 1)).alias("level"),
        "front").select("b", "level", F.explode("front").alias("sig"))
    pairs = left.join(right, ["level", "sig"]).where("a < b").select("a", "b").distinct()
    one = classes.select(F.col("class_id").alias("a"), F.col("sigs").alias("x"))
    two = classes.select(F.col("class_id").alias("b"), F.col("sigs").alias("y"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness"))
    return members, found.where(F.col("likeness") >= least)


def _blocks(ids: DataFrame) -> Column:
    """A number that falls as doc_id falls and splits the ids into blocks of similar size.

    The ids are cut at quantiles and evenly between them, so a few numbers describe all blocks.
    """
    cuts = [i / PIECES for i in range(PIECES + 1)]
    known = ids.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", cuts, 10_000).alias("q")).collect()[0]
    if not known["n"]:
        return F.lit(0).cast("long")
    edges = sorted(set(known["q"]))
    wanted = min(MAX_BLOCKS, max(1, known["n"] // BLOCK_ROWS))
    even = max(1, math.ceil(wanted / PIECES))
    doc_id = F.col("doc_id")
    if len(edges) == 1:
        return F.when(doc_id < edges[0], 1).when(doc_id >= edges[0], 2).otherwise(0).cast("long")
    # Ids beyond the outer quantiles fall into the outermost pieces.
    at = sum(((doc_id >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    low, high = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    share = (doc_id - F.get(low, at)).cast("double") / (F.get(high, at) - F.get(low, at)).cast("double")
    inner = F.greatest(F.lit(0), F.least(F.lit(even - 1), F.floor(share * even)))
    return F.coalesce((at * even + inner + 1).cast("long"), F.lit(0).cast("long"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add next_<column> of the next row by descending doc_id; after the last comes the first.

    Equal ids are ordered by their texts, missing ids come last. Rows are sorted within blocks of
    ids; the first rows of a block stand at the end of the block before it as well.
    """
    block = _blocks(rows.select("doc_id"))
    # One row per block, of which there is a bounded number.
    heads = rows.select("doc_id").withColumn("block", block).groupBy("block").agg(F.max("doc_id").alias("head"))
    first = Window.orderBy(F.col("block").desc())
    heads = heads.withColumn("up", F.lag("block").over(first)).withColumn("lowest", F.min("block").over(Window.partitionBy()))
    heads = stage(heads.select("block", "head", F.coalesce("up", "lowest").alias("up")), "block-heads")
    placed = rows.withColumn("block", block).join(heads, "block")
    here = F.struct(F.col("block").alias("block"), F.lit(0).alias("extra"))
    above = F.struct(F.col("up").alias("block"), F.lit(1).alias("extra"))
    both = placed.withColumn("place", F.explode(F.when(
        F.col("doc_id").eqNullSafe(F.col("head")), F.array(here, above)).otherwise(F.array(here)))).select(
        *rows.columns, "place.block", "place.extra")
    order = Window.partitionBy("block").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("extra = 0").drop("block", "extra")


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row.

    The edited text has the last third of its code points, rounded down, replaced by the first as
    many of the next document. A null text is an empty one; a table of one row is its own next.
    """
    rows = with_next(with_signatures(docs), ["text", "sigs"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    rows = rows.withColumn("words", parts(F.col("edited"))).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sigs", "next_sigs",
        signatures(F.col("words"), F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sigs")).alias("fingerprint"),
        written(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
