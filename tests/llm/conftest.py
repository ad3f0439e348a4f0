import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
# Columns that operators use inside, here as extra ones of the input.
CLASHING = (
    "words string, block int, fp long, others string, text_hash long, x int, sigs int, part int, start int, key int, "
    "score double, n_chars long, next_text string, row int, component_id int")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def given():
    """Rows of a small table."""
    return lambda name, columns: duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{name}.parquet' ORDER BY ALL").fetchall()


@pytest.fixture
def docs(spark):
    """A table of documents with extra columns whose names operators use inside."""

    def make(rows):
        extra = len(CLASHING.split(", "))
        return spark.createDataFrame([(*r, *[None] * extra) for r in rows], f"doc_id long, text string, {CLASHING}")

    return make


WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def odd_rows():
    """Nulls, empty and white texts, a very long text, ties and repeated rows."""
    long = " ".join(WORDS[i * i % 397] + str(i % 1009) for i in range(60_000))
    passage = " ".join(WORDS[:45])
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, passage), (7, f"Before this. {passage} After it."),
        (8, passage), (9, long), (10, long[:200_000]), (11, "The the THE " * 40), (12, "Ünïcode Éa ẞ 中文   x y <|endoftext|>"),
        (13, passage.upper()), (14, "a" * 100_000), (-5, passage)]
