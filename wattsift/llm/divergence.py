"""Where the words of a source differ from those of others: chunk factorization.

Texts are cut at white space into chunks. The chunks of every document are counted; a task hands on what
a chunk is worth in a slice of documents: by language, its uses by source, and three of its documents, or all if it has
fewer. Rows of a chunk meet in one shuffle, so each distinct chunk of the corpus is cut into terms once,
and its terms get its counts. A second shuffle brings the rows of a term together. A common chunk
is one row per slice, and a common term one row per batch of chunks, however often they occur.

A language keeps the terms that are in at least three of its documents; a union of up to three documents
each is enough to tell, exactly.

The divergence of a group from another is a sum over all kept terms. Terms that neither group has all
give the same value, those that one of them lacks depend on the other's count alone, so only terms that both have are
met term by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattsift.llm.tables import give_back
from wattsift.sources.staging import stage

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
SLICE_BYTES = 16_000_000
GATHERED = "word string, lang string, documents array<long>, uses array<struct<source: string, n: long>>"


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _offsets(owner: np.ndarray, owners: int) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=owners))).astype(np.int32))


def _owners(lists: pa.ListArray, owner: np.ndarray) -> np.ndarray:
    return np.repeat(owner, np.diff(lists.offsets.to_numpy()))


def gathered(
    words: pa.Array, langs: pa.Array, owner: np.ndarray, document_owner: np.ndarray, documents: np.ndarray,
    use_owner: np.ndarray, sources: pa.Array, n: np.ndarray,
) -> pa.RecordBatch:
    """One row per owner 0, 1, ...: `owner` is sorted, one for each word and lang; documents and uses have sorted owners of their own."""
    first = np.flatnonzero(_begins(owner))
    of, document = document_owner, documents
    if ((of[1:] == of[:-1]) & (document[1:] < document[:-1])).any():
        order = np.lexsort((document, of))
        of, document = of[order], document[order]
    new = _begins(of, document)
    of, document = of[new], document[new]
    # The place of a document among those of its owner.
    starts = np.flatnonzero(_begins(of))
    few = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of)))) < LEAST_DOCUMENTS
    coded = sources.dictionary_encode()
    key = use_owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(_begins(key[order]))
    summed = np.add.reduceat(n[order], starts) if len(starts) else n[:0]
    use = order[starts]
    uses = pa.StructArray.from_arrays([sources.take(pa.array(use)), pa.array(summed)], names=["source", "n"])
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(first)), langs.take(pa.array(first)),
         pa.ListArray.from_arrays(_offsets(of[few], len(first)), pa.array(document[few])),
         pa.ListArray.from_arrays(_offsets(use_owner[use], len(first)), uses)], names=["word", "lang", "documents", "uses"])


def regathered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Neighbours of equal word and language as one row."""
    owner = np.cumsum(_begins(_codes(batch.column(0)), _codes(batch.column(1)))) - 1
    documents, uses = batch.column(2), batch.column(3)
    flat = uses.flatten()
    return gathered(
        batch.column(0), batch.column(1), owner, _owners(documents, owner), documents.flatten().to_numpy(), _owners(uses, owner),
        flat.field("source"), flat.field("n").to_numpy())


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by word and language with each of them once; a row that may go on is held back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip(batch.columns, held.schema.types)], names=held.schema.names)]).combine_chunks().to_batches()[0]
        found = regathered(batch)
        held = found.slice(found.num_rows - 1)
        if found.num_rows > 1:
            yield found.slice(0, found.num_rows - 1)
    if held is not None:
        yield held


def count_chunks(given: pa.Table) -> pa.RecordBatch:
    """The chunks of some documents (lang, source, text, row), by language."""
    given = given.sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
    lang, source, text, row = (given.column(c).combine_chunks() for c in ("lang", "source", "text", "row"))
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    coded = split.flatten().dictionary_encode()
    doc = _owners(split, np.arange(len(split)))
    # The chunks of every document, counted. Documents stand by language and source, so equal groups are neighbours.
    key, n = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(split)) + doc, return_counts=True)
    del split, doc
    code, doc = key // max(1, len(lang)), key % max(1, len(lang))
    owner = np.cumsum(_begins(code, _codes(lang)[doc])) - 1
    at = pa.array(doc)
    return gathered(
        coded.dictionary.take(pa.array(code)), lang.take(at), owner, owner, row.to_numpy()[doc], owner, source.take(at), n)


def chunk_table(docs: DataFrame) -> DataFrame:
    """Chunks by language, several rows of each; every row of the documents is a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            # Batches may hold many long texts.
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES - size, side="right")))
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - done
                at = upto
                if size >= SLICE_BYTES or at < batch.num_rows:
                    yield count_chunks(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield count_chunks(pa.Table.from_batches(held))
        give_back()

    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")),
                        F.monotonically_increasing_id().alias("row"))
    return given.mapInArrow(run, GATHERED)


def terms_of(chunks: pa.RecordBatch) -> pa.RecordBatch:
    """The terms of distinct chunks with their counts; a term that a chunk holds twice has them twice."""
    cut = pc.split_pattern_regex(chunks.column(0), SEPARATORS)
    owner = _owners(cut, np.arange(chunks.num_rows))
    term = cut.flatten()
    real = pc.not_equal(term, "")
    owner, term = owner[real.to_numpy(zero_copy_only=False)], term.filter(real)
    order = np.lexsort((_codes(chunks.column(1))[owner], _codes(term)))
    at = pa.array(owner[order])
    return regathered(pa.RecordBatch.from_arrays(
        [term.take(pa.array(order)), *(chunks.column(k).take(at) for k in (1, 2, 3))], names=["word", "lang", "documents", "uses"]))


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term and count of the terms that a language keeps, where the count is not 0."""

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in merged(batches):
            yield terms_of(chunks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms in merged(batches):
            kept = np.diff(terms.column(2).offsets.to_numpy()) == LEAST_DOCUMENTS
            terms = terms.filter(pa.array(kept))
            at, uses = pa.array(_owners(terms.column(3), np.arange(terms.num_rows))), terms.column(3).flatten()
            yield pa.RecordBatch.from_arrays(
                [terms.column(1).take(at), uses.field("source"), terms.column(0).take(at), uses.field("n")],
                names=["lang", "source", "term", "n"])

    chunks = chunk_table(docs).repartition("word").sortWithinPartitions("word", "lang").mapInArrow(factored, GATHERED)
    return chunks.repartition("lang", "word").sortWithinPartitions("word", "lang").mapInArrow(
        counted, "lang string, source string, term string, n long")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exactly; null where there are no terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({UNIT} AS DECIMAL(10, 0)) * ({n} + 1)) DIV ({total} + {terms}) END")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair`: a group against every other source of its language, ranked by value. Part `term`: the terms that
    a group has more of than its language, at most `top`. Equal values are ranked by item. Null lang, source
    and text are empty. Every row is a document, also those of equal or no id, so copies count as often as they
    stand there. Groups without terms have their pairs; an empty table gives no rows. The counts of kept terms and
    the sizes of groups are staged: the result reads them.
    """
    counts = stage(kept_counts(docs), "term-counts")
    in_lang = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "lang-terms")
    langs = in_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    # Staged, so that Spark knows its size when it plans the joins.
    sizes = stage(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0).withColumn(
        "absent", _share("0", "total", "terms")), "group-sizes")
    rows = counts.join(sizes, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    return _pairs(rows, sizes).union(_terms(rows, in_lang, top))


def _pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    one = sizes.select("lang", "source", "terms", "present", F.col("absent").alias("p0"))
    two = sizes.select("lang", F.col("source").alias("item"), F.col("present").alias("item_present"), F.col("absent").alias("q0"))
    # As if no group had any term: all terms that neither has.
    neither = one.join(two, "lang").where("source != item").select(
        "lang", "source", "item", F.when(F.col("terms") > 0, (F.col("terms") - F.col("present") - F.col("item_present")) * _apart("p0", "q0")).otherwise(
            0).cast("long").alias("value"))
    # Terms that one of them has, as if the other lacked them all, by equal counts.
    shares = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    first = shares.join(two, "lang").where("source != item").select(
        "lang", "source", "item", (F.col("k") * _apart("p", "q0")).alias("value"))
    second = shares.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "k").join(one, "lang").where(
        "source != item").select("lang", "source", "item", (F.col("k") * _apart("p0", "q")).alias("value"))
    # Terms that both have, instead of what was said of them above.
    left = rows.select("lang", "term", "source", "p", F.col("absent").alias("p0"))
    right = rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("absent").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("source != item").select(
        "lang", "source", "item", (_apart("p", "q") - _apart("p", "q0") - _apart("p0", "q") + _apart("p0", "q0")).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    whole = neither.union(first).union(second).union(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(rows: DataFrame, in_lang: DataFrame, top: int) -> DataFrame:
    known = rows.select("lang", "source", "term", "p", "terms", "lang_total").join(in_lang, ["lang", "term"])
    known = known.withColumn("q", _share("lang_n", "lang_total", "terms")).where("p > q").select(
        "lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
