"""Isolation forest (Liu, Ting and Zhou, ICDM 2008).

Every tree draws its own sample without replacement. Whether a consumer may be in a tree's
sample depends only on a hash of its id, the tree and the seed, so the draw needs no shuffle of
the consumers and is the same under any partitioning. Only the drawn rows, about twice
``trees x sample``, are shuffled, one group per tree.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.operators.scaling import Scaler

TREE_SCHEMA = (
    "tree_id int, node_id int, left int, right int, feature int, threshold double, size long, depth int"
)
MAX_SAMPLE = 256
# All nodes of a forest travel to every executor, so their number is checked before growing.
MAX_NODES = 1_000_000
# Rows whose paths are followed at once; bounds the worker's memory, not the result.
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class ForestParams:
    names: list[str]
    trees: int = 100
    sample: int = MAX_SAMPLE
    seed: int = 42


@dataclass(frozen=True)
class Forest:
    """Trees, and what scoring and labelling new rows needs: scaler, contamination, fitted offset."""

    params: ForestParams
    nodes: pd.DataFrame = field(repr=False)
    scaler: Scaler | None = None
    contamination: float | None = None
    offset: float | None = None

    def scaled(self, inputs: list[Column]) -> list[Column]:
        return inputs if self.scaler is None else self.scaler.columns(inputs)

    def label(self, df: DataFrame, inputs: list[Column], out: str = "label") -> DataFrame:
        """Score unscaled inputs and label them by the offset of training: -1 below it, else 1."""
        if self.offset is None:
            raise ValueError("the forest has no fitted offset")
        scored = self.score(df, self.scaled(inputs))
        return scored.withColumn(out, F.when(F.col("raw_score") < F.lit(self.offset), -1).otherwise(1))

    def score(self, df: DataFrame, inputs: list[Column], out: str = "raw_score") -> DataFrame:
        """Add the raw score: between -1 and 0, lower is more anomalous."""
        shared = df.sparkSession.sparkContext.broadcast(_arrays(self.nodes, self.params))

        @F.pandas_udf("double")
        def raw_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            trees = shared.value
            for batch in batches:
                rows = np.column_stack([c.to_numpy(dtype=np.float64) for c in batch])
                yield pd.Series(_raw_scores(rows, trees))

        return df.withColumn(out, raw_score(*inputs))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, TREE_SCHEMA)

    def importance(self, spark: SparkSession, mode: str = "uniform") -> DataFrame:
        """Weight of every feature: all equal, or its share of the forest's splits."""
        names = self.params.names
        rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("feature")) for i, n in enumerate(names)])
        if mode == "uniform":
            return spark.range(1).select(F.inline(rows)).select(
                "feature", F.lit(1.0 / len(names)).alias("importance"))
        if mode != "splits":
            raise ValueError(f"mode must be uniform or splits, not {mode}")
        used = self.node_table(spark).filter("feature >= 0").agg(
            F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("feature") == i).alias(f"n{i}") for i in range(len(names))])
        shares = F.array(*[
            F.struct(F.lit(n).alias("feature"), F.coalesce(F.try_divide(f"n{i}", "all"), F.lit(0.0)).alias("importance"))
            for i, n in enumerate(names)
        ])
        return used.select(F.inline(shares))

    def save(self, spark: SparkSession, path: str) -> None:
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        scaler = None if self.scaler is None else json.dumps(self.scaler.__dict__)
        row = json.dumps(self.params.__dict__), scaler, self.contamination, self.offset
        spark.createDataFrame([row], "params string, scaler string, contamination double, offset double").write.mode(
            "overwrite").parquet(f"{path}/params")


def load_forest(spark: SparkSession, path: str) -> Forest:
    row = spark.read.parquet(f"{path}/params").first()
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree_id", "node_id").toPandas()
    scaler = None if row["scaler"] is None else Scaler(**json.loads(row["scaler"]))
    return Forest(ForestParams(**json.loads(row["params"])), nodes, scaler, row["contamination"], row["offset"])


def fit_forest(
    df: DataFrame, names: list[str], inputs: list[Column], trees: int = 100,
    max_samples: int = MAX_SAMPLE, seed: int = 42, key: str = "consumer_id", rows: int | None = None,
) -> Forest:
    """Grow the forest; ``df`` should be staged, ``inputs`` are finite double columns."""
    rows = df.count() if rows is None else rows
    if rows == 0:
        raise ValueError("no rows to fit a forest on")
    params = ForestParams(list(names), trees, min(max_samples, rows), seed)
    if trees * (2 * params.sample - 1) > MAX_NODES:
        raise ValueError(f"{trees} trees of {params.sample} rows are more than {MAX_NODES} nodes")
    # Few bytes but much work per tree, so the number of tasks must not follow the bytes.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    drawn = draw_samples(df, inputs, params, rows, key).repartition(tasks, "tree_id")
    grown = drawn.groupBy("tree_id").applyInPandas(_grower(params), TREE_SCHEMA)
    nodes = grown.toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
    return Forest(params, nodes)


def draw_samples(df: DataFrame, inputs: list[Column], params: ForestParams, rows: int, key: str) -> DataFrame:
    """At least ``sample`` rows per tree: those with the smallest hash are all among them.

    The share is twice what is needed; that a tree falls short of its sample has a chance
    below 1e-25, and it would then be grown on the rows there are.
    """
    share = 1.0 if rows <= 2 * params.sample else 2.0 * params.sample / rows
    vector = [c.alias(f"x{i}") for i, c in enumerate(inputs)]
    keyed = df.select(F.col(key).alias("key"), *vector)
    every = F.sequence(F.lit(0), F.lit(params.trees - 1))
    trees = every
    if share < 1.0:
        # How many trees a row enters is binomial; one hash decides it, and most rows leave before anything is exploded.
        many = F.pmod(F.xxhash64("key", F.lit(params.seed + 1)), F.lit(1 << 53)).cast("double") / float(1 << 53)
        steps = _binomial_steps(params.trees, share)
        keyed = keyed.withColumn("_u", many).filter(F.col("_u") >= steps[0])
        number = F.size(F.filter(F.array(*map(F.lit, steps)), lambda step: F.col("_u") >= step))
        # Which ones: those with the smallest hashes.
        mixed = F.array_sort(F.transform(every, lambda t: F.struct(
            F.xxhash64("key", t, F.lit(params.seed + 2)).alias("h"), t.alias("t"))))
        trees = F.slice(mixed, F.lit(1), number)["t"]
    return keyed.withColumn("tree_id", F.explode(trees)).withColumn(
        "draw", F.shiftrightunsigned(F.xxhash64("key", "tree_id", F.lit(params.seed)), 2)).drop("_u")


def _binomial_steps(trees: int, share: float) -> list[float]:
    """Distribution function of the number of trees that a row enters, up to where nothing is left."""
    steps, upto = [], 0.0
    for k in range(trees):
        upto += math.comb(trees, k) * share**k * (1.0 - share) ** (trees - k)
        steps.append(min(upto, 1.0))
        if upto >= 1.0 - 2.0**-53:
            break
    return steps


def _grower(params: ForestParams):
    sample, seed, width = params.sample, params.seed, len(params.names)

    def grow(drawn: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(drawn["tree_id"].iloc[0])
        chosen = drawn.sort_values(["draw", "key"]).head(sample)
        rows = chosen[[f"x{i}" for i in range(width)]].to_numpy(dtype=np.float64)
        random = np.random.default_rng([seed, tree_id])
        deepest = math.ceil(math.log2(max(sample, 2)))
        nodes: list[list] = []

        def add(members: np.ndarray, depth: int) -> int:
            node_id = len(nodes)
            nodes.append([tree_id, node_id, -1, -1, -1, 0.0, len(members), depth])
            here = rows[members]
            low, high = here.min(axis=0), here.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth < deepest and len(usable):
                feature = int(usable[random.integers(len(usable))])
                at = random.uniform(low[feature], high[feature])
                goes_left = here[:, feature] <= at
                if goes_left.all():  # the draw fell on the upper end
                    at = low[feature]
                    goes_left = here[:, feature] <= at
                nodes[node_id][4:6] = [feature, float(at)]
                nodes[node_id][2] = add(members[goes_left], depth + 1)
                nodes[node_id][3] = add(members[~goes_left], depth + 1)
            return node_id

        add(np.arange(len(rows)), 0)
        columns = [part.split()[0] for part in TREE_SCHEMA.split(", ")]
        return pd.DataFrame(nodes, columns=columns)

    return grow


def mean_path(size: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of ``size`` leaves."""
    size = np.asarray(size, dtype=np.float64)
    safe = np.maximum(size, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(size <= 1, 0.0, np.where(size <= 2, 1.0, long))


def _arrays(nodes: pd.DataFrame, params: ForestParams) -> dict:
    """Nodes of all trees in one run of arrays; leaves point at themselves."""
    nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    start = nodes.groupby("tree_id").cumcount().eq(0).to_numpy().nonzero()[0]
    base = np.repeat(start, np.diff(np.append(start, len(nodes))))
    own = np.arange(len(nodes))
    leaf = nodes["feature"].to_numpy() < 0
    return {
        "roots": start,
        "left": np.where(leaf, own, nodes["left"].to_numpy() + base),
        "right": np.where(leaf, own, nodes["right"].to_numpy() + base),
        "feature": np.where(leaf, 0, nodes["feature"].to_numpy()),
        "threshold": nodes["threshold"].to_numpy(),
        "path": nodes["depth"].to_numpy() + mean_path(nodes["size"].to_numpy()),
        "levels": int(nodes["depth"].max()),
        "unit": float(mean_path(np.array([params.sample]))[0]),
    }


def _raw_scores(rows: np.ndarray, trees: dict) -> np.ndarray:
    scores = np.empty(len(rows))
    for at in range(0, len(rows), ROWS_AT_ONCE):
        part = rows[at:at + ROWS_AT_ONCE]
        index = np.arange(len(part))[:, None]
        node = np.broadcast_to(trees["roots"], (len(part), len(trees["roots"])))
        for _ in range(trees["levels"]):
            goes_left = part[index, trees["feature"][node]] <= trees["threshold"][node]
            node = np.where(goes_left, trees["left"][node], trees["right"][node])
        mean = trees["path"][node].mean(axis=1)
        scores[at:at + ROWS_AT_ONCE] = -np.exp2(-mean / trees["unit"]) if trees["unit"] > 0 else -0.5
    return scores
