"""Autoencoder trained by parallel SGD with weight averaging (Zinkevich et al., NIPS 2010).

Consumers are split into parts by a hash of their id, and parts into teams. In each round every team
trains from the common state, as one group of a grouped map, and the states are averaged with
the teams' row counts as weights. Within a team the state goes from part to part, and each part trains it on its own
rows. A part has a bounded number of rows, so has a team, and what reaches the
driver between rounds is one state of a few thousand numbers, whatever the number of rows.

An epoch is as many steps as one pass over all rows has, or over ``round_rows`` where there are
more, and every team makes as many. So the same data in one part or in four are trained alike, and a
team of full size sees its rows once an epoch. The epochs are spread evenly over ``rounds``.

A few parts are a team each. There are never more than ``TEAMS`` teams of less than ``round_rows`` rows: if every
small part made all steps of an epoch, work would grow with the parts times the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.operators.scoring import error_threshold
from wattsift.operators.scaling import Scaler
from wattsift.sources.staging import stage

STATE_SCHEMA = "part int, rows long, state array<double>"
# States that one task averages at once.
FAN_IN = 64
# So many teams may be smaller than `round_rows`.
TEAMS = 64


@dataclass(frozen=True)
class AutoencoderParams:
    names: list[str]
    hidden: list[int] = field(default_factory=lambda: [32, 16])
    code: int = 8
    learning_rate: float = 0.001
    epochs: int = 50
    batch: int = 32
    dropout: float = 0.2
    held_out: float = 0.1
    percentile: float = 95.0
    part_rows: int = 50_000
    round_rows: int = 50_000
    rounds: int = 10
    seed: int = 42


class Network:
    """Dense layers with ReLU; all but the code are followed by batch norm and dropout.

    All weights are views into one flat vector ``trained``, all moving statistics into
    ``moving``, so that states can be averaged, stored and stepped as plain vectors.
    """

    DECAY, FLOOR = 0.99, 1e-3  # moving average and variance floor of batch norm

    def __init__(self, inputs: int, hidden: list[int], code: int):
        widths = [*hidden, code, *reversed(hidden), inputs]
        self.code_at = len(hidden)
        self.shapes = list(zip([inputs, *widths[:-1]], widths))
        self.normed = [i not in (self.code_at, len(widths) - 1) for i in range(len(widths))]
        per_layer = [a * b + b + (2 * b if n else 0) for (a, b), n in zip(self.shapes, self.normed)]
        self.trained = np.zeros(sum(per_layer))
        self.moving = np.zeros(sum(2 * b for (_, b), n in zip(self.shapes, self.normed) if n))
        self.slope = np.zeros_like(self.trained)
        self.layers, self.slopes = self._views(self.trained), self._views(self.slope)
        self.stats = []
        at = 0
        for (_, b), normed in zip(self.shapes, self.normed):
            self.stats.append((self.moving[at:at + b], self.moving[at + b:at + 2 * b]) if normed else None)
            at += 2 * b if normed else 0

    def _views(self, flat: np.ndarray) -> list[dict[str, np.ndarray]]:
        layers, at = [], 0
        for (a, b), normed in zip(self.shapes, self.normed):
            layer = {}
            wanted = [("weight", (a, b)), ("bias", (b,))] + ([("gain", (b,)), ("offset", (b,))] if normed else [])
            for name, shape in wanted:
                size = math.prod(shape)
                layer[name] = flat[at:at + size].reshape(shape)
                at += size
            layers.append(layer)
        return layers

    def start(self, seed: int) -> None:
        random = np.random.default_rng(seed)
        for (a, b), layer in zip(self.shapes, self.layers):
            reach = math.sqrt(6.0 / (a + b))
            layer["weight"][:] = random.uniform(-reach, reach, (a, b))
            if "gain" in layer:
                layer["gain"][:] = 1.0
        for stat in self.stats:
            if stat:
                stat[1][:] = 1.0

    def apply(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Output, or the output of layer ``upto``, with moving statistics and no dropout."""
        for i, (layer, stat) in enumerate(zip(self.layers, self.stats)):
            x = x @ layer["weight"] + layer["bias"]
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0.0)
            if stat:
                x = (x - stat[0]) / np.sqrt(stat[1] + self.FLOOR) * layer["gain"] + layer["offset"]
            if i == upto:
                break
        return x

    def gradient(self, x: np.ndarray, dropout: float, random: np.random.Generator) -> tuple[float, np.ndarray]:
        """Mean squared error on one batch and its gradient; updates the moving statistics.

        The gradient is a buffer of this object that the next call fills anew.
        """
        target, kept, last, rows = x, [], len(self.layers) - 1, len(x)
        for i, (layer, stat) in enumerate(zip(self.layers, self.stats)):
            before = x
            x = x @ layer["weight"] + layer["bias"]
            active = x > 0 if i < last else None
            if active is not None:
                x = x * active
            normal = scale = mask = None
            if stat:
                mean = x.sum(axis=0) / rows
                normal = x - mean
                var = np.einsum("ij,ij->j", normal, normal) / rows
                stat[0][:] += (1 - self.DECAY) * (mean - stat[0])
                stat[1][:] += (1 - self.DECAY) * (var - stat[1])
                scale = 1.0 / np.sqrt(var + self.FLOOR)
                normal *= scale
                mask = (random.random(x.shape) >= dropout) / (1.0 - dropout)
                x = (normal * layer["gain"] + layer["offset"]) * mask
            kept.append((before, active, normal, scale, mask))
        miss = x - target
        back = 2.0 * miss / miss.size
        for layer, grad, (before, active, normal, scale, mask) in zip(
            reversed(self.layers), reversed(self.slopes), reversed(kept)
        ):
            if normal is not None:
                back = back * mask
                grad["gain"][:] = np.einsum("ij,ij->j", back, normal)
                grad["offset"][:] = back.sum(axis=0)
                back = layer["gain"] * scale * (back - grad["offset"] / rows - normal * (grad["gain"] / rows))
            if active is not None:
                back = back * active
            np.matmul(before.T, back, out=grad["weight"])
            grad["bias"][:] = back.sum(axis=0)
            back = back @ layer["weight"].T
        return float(np.mean(miss * miss)), self.slope

    def load(self, state: np.ndarray) -> None:
        self.trained[:] = state[:len(self.trained)]
        self.moving[:] = state[len(self.trained):len(self.trained) + len(self.moving)]


class Adam:
    FIRST, SECOND, FLOOR = 0.9, 0.999, 1e-7

    def __init__(self, size: int, rate: float):
        self.rate, self.steps = rate, 0.0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        self.steps += 1
        self.mean += (1 - self.FIRST) * (gradient - self.mean)
        self.square += (1 - self.SECOND) * (gradient * gradient - self.square)
        rate = self.rate * math.sqrt(1 - self.SECOND ** self.steps) / (1 - self.FIRST ** self.steps)
        weights -= rate * self.mean / (np.sqrt(self.square) + self.FLOOR)


def first_state(params: AutoencoderParams) -> np.ndarray:
    """Weights, moving statistics, both Adam moments, step count: one vector."""
    net = Network(len(params.names), params.hidden, params.code)
    net.start(params.seed)
    return np.concatenate([net.trained, net.moving, np.zeros(2 * len(net.trained) + 1)])


def teams_of(rows: int, params: AutoencoderParams) -> tuple[int, int]:
    """Parts, and teams that they are dealt into."""
    parts = math.ceil(rows / params.part_rows)
    return parts, min(parts, max(TEAMS, math.ceil(rows / params.round_rows)))


def _trainer(params: AutoencoderParams, state: np.ndarray, turn: int, steps: int, teams: int | None = None):
    def train(team: pd.DataFrame) -> pd.DataFrame:
        number = int(team["part"].iloc[0])
        number = number if teams is None else number % teams
        ordered = team.sort_values(["part", "key"])
        x = ordered[[f"x{i}" for i in range(len(params.names))]].to_numpy(dtype=np.float64)
        random = np.random.default_rng([params.seed, turn, number])
        net = Network(len(params.names), params.hidden, params.code)
        net.load(state)
        size, held = len(net.trained), len(net.trained) + len(net.moving)
        adam = Adam(size, params.learning_rate)
        adam.mean[:], adam.square[:] = state[held:held + size], state[held + size:held + 2 * size]
        adam.steps = float(state[-1])
        parts = []
        for own in np.split(x, np.flatnonzero(np.diff(ordered["part"].to_numpy())) + 1):
            edges = list(range(0, len(own), params.batch))
            if len(edges) > 1 and len(own) - edges[-1] == 1:
                edges.pop()  # a single row has no spread to normalise by
            parts.append((own, list(zip(edges, [*edges[1:], len(own)]))))
        left = steps
        while left > 0:
            # Parts in a new order in every pass.
            for k in random.permutation(len(parts)):
                own, batches = parts[k]
                mixed = own[random.permutation(len(own))]
                for start, end in batches[:left]:
                    _, gradient = net.gradient(mixed[start:end], params.dropout, random)
                    adam.step(net.trained, gradient)
                left -= len(batches)
                if left <= 0:
                    break
        after = np.concatenate([net.trained, net.moving, adam.mean, adam.square, [adam.steps]])
        return pd.DataFrame({"part": [number], "rows": [len(x)], "state": [after]})

    return train


def _average(states: pd.DataFrame) -> pd.DataFrame:
    ordered = states.sort_values("part")
    weights = ordered["rows"].to_numpy(dtype=np.float64)
    mean = np.average(np.stack(ordered["state"].to_list()), axis=0, weights=weights)
    return pd.DataFrame({"part": [int(ordered["part"].iloc[0])], "rows": [int(weights.sum())], "state": [mean]})


def average_states(states: DataFrame, parts: int) -> np.ndarray:
    """Row-weighted mean of all states, in levels of bounded fan-in and a fixed order."""
    step = 1
    while parts > 1:
        step *= FAN_IN
        states = states.groupBy(F.floor(F.col("part") / F.lit(step)).alias("g")).applyInPandas(
            _average, STATE_SCHEMA)
        parts = math.ceil(parts / FAN_IN)
    averaged = states.first()
    if averaged is None:
        raise ValueError("every row is held out: too few rows to train on")
    return np.asarray(averaged["state"], dtype=np.float64)


@dataclass(frozen=True)
class Autoencoder:
    params: AutoencoderParams
    scaler: Scaler | None
    state: np.ndarray = field(repr=False)
    threshold: float | None = None

    def error(self, df: DataFrame, inputs: list[Column], out: str = "ae_error") -> DataFrame:
        """Add the mean squared reconstruction error of every row."""
        shared = self._broadcast(df)

        @F.pandas_udf("double")
        def ae_error(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            net = _network(*shared.value)
            for batch in batches:
                x = np.column_stack([c.to_numpy(dtype=np.float64) for c in batch])
                yield pd.Series(np.mean(np.square(x - net.apply(x)), axis=1))

        return df.withColumn(out, ae_error(*self._scaled(inputs)))

    def encode(self, df: DataFrame, inputs: list[Column], out: str = "encoding") -> DataFrame:
        """Add the bottleneck vector of every row."""
        shared = self._broadcast(df)

        @F.pandas_udf("array<double>")
        def encoding(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            net = _network(*shared.value)
            for batch in batches:
                x = np.column_stack([c.to_numpy(dtype=np.float64) for c in batch])
                yield pd.Series(list(net.apply(x, upto=net.code_at)))

        return df.withColumn(out, encoding(*self._scaled(inputs)))

    def _broadcast(self, df: DataFrame):
        # Plain values only: a broadcast is pickled by reference, and executors may lack this package.
        values = (len(self.params.names), self.params.hidden, self.params.code, self.state)
        return df.sparkSession.sparkContext.broadcast(values)

    def _scaled(self, inputs: list[Column]) -> list[Column]:
        return inputs if self.scaler is None else self.scaler.columns(inputs)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row: parameters, layer shapes, scaler, threshold and weights."""
        net = Network(len(self.params.names), self.params.hidden, self.params.code)
        scaler = None if self.scaler is None else json.dumps(self.scaler.__dict__)
        row = (
            json.dumps(self.params.__dict__), [list(s) for s in net.shapes], scaler, self.threshold,
            [float(v) for v in self.state],
        )
        schema = "params string, shapes array<array<int>>, scaler string, threshold double, weights array<double>"
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)


def load_autoencoder(spark: SparkSession, path: str) -> Autoencoder:
    row = spark.read.parquet(path).first()
    scaler = None if row["scaler"] is None else Scaler(**json.loads(row["scaler"]))
    return Autoencoder(
        AutoencoderParams(**json.loads(row["params"])), scaler, np.asarray(row["weights"]), row["threshold"])


def _network(inputs: int, hidden: list[int], code: int, state: np.ndarray) -> Network:
    net = Network(inputs, hidden, code)
    net.load(state)
    return net


def fit_autoencoder(
    df: DataFrame, inputs: list[Column], params: AutoencoderParams, scaler: Scaler | None = None,
    key: str = "consumer_id", rows: int | None = None,
) -> Autoencoder:
    """Train on ``df`` and set the threshold, a percentile of the errors of all rows.

    ``df`` should be staged; ``inputs`` are finite, and unscaled if a scaler is given.
    """
    fitted = train_autoencoder(df, inputs, params, scaler, key, rows)
    return set_threshold(fitted, stage(fitted.error(df, inputs).select("ae_error"), "errors"))


def set_threshold(fitted: Autoencoder, errors: DataFrame) -> Autoencoder:
    cut = error_threshold(errors, "ae_error", fitted.params.percentile)
    return replace(fitted, threshold=cut)


def train_autoencoder(
    df: DataFrame, inputs: list[Column], params: AutoencoderParams, scaler: Scaler | None = None,
    key: str = "consumer_id", rows: int | None = None,
) -> Autoencoder:
    """Train without a threshold. A tenth of the rows, chosen by hash, is held out."""
    columns = inputs if scaler is None else scaler.columns(inputs)
    rows = df.count() if rows is None else rows
    if rows == 0:
        raise ValueError("no rows to fit an autoencoder on")
    parts, teams = teams_of(rows, params)
    vectors = df.select(F.col(key).alias("key"), *[c.alias(f"x{i}") for i, c in enumerate(columns)])
    share = F.pmod(F.xxhash64("key", F.lit(params.seed)), F.lit(10_000))
    training = vectors.filter(share >= int(params.held_out * 10_000)).withColumn(
        "part", F.pmod(F.xxhash64("key", F.lit(params.seed + 1)), F.lit(parts)).cast("int")).withColumn(
        "team", F.pmod("part", F.lit(teams)).cast("int"))
    state = first_state(params)
    steps = math.ceil(min(rows * (1 - params.held_out), params.round_rows) / params.batch)
    rounds = min(params.rounds, params.epochs)
    # Every round reads the same rows. What an executor loses is computed again from `df`.
    # One team in every task; a hash of the team would leave a third of the tasks without any.
    training = training.repartitionById(teams, "team").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for turn in range(rounds):
            state = _round(training, params, state, turn, math.ceil(steps * params.epochs / rounds), teams)
    finally:
        training.unpersist()
    return Autoencoder(params, scaler, state)


def _round(
    training: DataFrame, params: AutoencoderParams, state: np.ndarray, turn: int, steps: int, teams: int
) -> np.ndarray:
    states = training.groupBy("team").applyInPandas(_trainer(params, state, turn, steps, teams), STATE_SCHEMA)
    return average_states(states, teams)
