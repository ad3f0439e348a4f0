import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift.operators import autoencoder as A
from wattsift.operators.scaling import fit_scaler

NAMES = ["x0", "x1", "x2", "x3"]


def inputs():
    return [F.col(n) for n in NAMES]


def frame(spark, n=400):
    """Points near a line in four dimensions, and five that are off it."""
    random = np.random.default_rng(0)
    rows = random.normal(size=(n, 1)) @ np.array([[1.0, -2.0, 0.5, 3.0]]) + random.normal(scale=0.05, size=(n, 4))
    rows[:5] += np.array([8.0, 8.0, -8.0, 8.0])
    return spark.createDataFrame([(f"c{i:05d}", *map(float, r)) for i, r in enumerate(rows)],
                                 "consumer_id string, " + ", ".join(f"{n} double" for n in NAMES))


def errors(df, fitted):
    return {r.consumer_id: r.ae_error for r in fitted.error(df, inputs()).collect()}


def test_number_of_values_for_ten_inputs():
    net = A.Network(10, [32, 16], 8)
    assert len(net.trained) + len(net.moving) == 2418


def test_gradient_against_differences():
    net = A.Network(3, [5, 4], 2)
    net.start(1)
    random = np.random.default_rng(2)
    net.trained += random.normal(scale=0.1, size=len(net.trained))
    x = random.normal(size=(7, 3))

    def loss():
        return net.gradient(x, 0.2, np.random.default_rng(3))  # the same dropout every time

    gradient = loss()[1].copy()
    step = 1e-6
    for i in range(len(net.trained)):
        kept = net.trained[i]
        net.trained[i] = kept + step
        up, _ = loss()
        net.trained[i] = kept - step
        down, _ = loss()
        net.trained[i] = kept
        assert gradient[i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


def test_moving_statistics_and_plain_pass():
    net = A.Network(3, [5], 2)
    net.start(0)
    x = np.random.default_rng(0).normal(size=(50, 3))
    hidden = np.maximum(x @ net.layers[0]["weight"] + net.layers[0]["bias"], 0)
    net.gradient(x, 0.0, np.random.default_rng(0))
    assert net.stats[0][0] == pytest.approx(0.01 * hidden.mean(axis=0))
    assert net.stats[0][1] == pytest.approx(0.99 + 0.01 * hidden.var(axis=0))
    assert net.apply(x, upto=net.code_at).shape == (50, 2) and net.apply(x).shape == (50, 3)


def test_adam_first_step_is_the_rate():
    adam, weights = A.Adam(2, 0.001), np.array([1.0, 1.0])
    adam.step(weights, np.array([5.0, -0.1]))
    assert weights == pytest.approx([0.999, 1.001], rel=1e-4)


@pytest.mark.parametrize("part_rows, epochs, rate", [(50_000, 40, 0.001), (200, 12, 0.005)])
def test_learns_and_ranks_far_points_on_top(spark, part_rows, epochs, rate):
    df = frame(spark)
    params = A.AutoencoderParams(NAMES, epochs=epochs, part_rows=part_rows, learning_rate=rate)
    fitted = A.fit_autoencoder(df, inputs(), params, fit_scaler(df, NAMES, inputs()))
    blank = A.Autoencoder(params, fitted.scaler, A.first_state(params))
    found = errors(df, fitted)
    assert np.mean(list(found.values())) < 0.7 * np.mean(list(errors(df, blank).values()))
    assert len(set(sorted(found, key=found.get)[-5:]) & {f"c{i:05d}" for i in range(5)}) >= 4
    assert fitted.threshold == pytest.approx(np.percentile(list(found.values()), 95))


def test_same_seed_same_errors_under_any_partitioning(spark):
    df = frame(spark, 300)
    params = A.AutoencoderParams(NAMES, epochs=3, part_rows=60)
    first = errors(df, A.train_autoencoder(df.repartition(3), inputs(), params))
    assert first == errors(df, A.train_autoencoder(df.repartition(11), inputs(), params))


def test_average_is_weighted_and_goes_through_levels(spark):
    random = np.random.default_rng(5)
    states, rows = random.normal(size=(200, 4)), random.integers(1, 50, 200)
    df = spark.createDataFrame(
        [(i, int(r), [float(v) for v in s]) for i, (r, s) in enumerate(zip(rows, states))], A.STATE_SCHEMA)
    assert A.average_states(df, 200) == pytest.approx(np.average(states, axis=0, weights=rows))


def test_a_last_batch_of_one_row_joins_the_one_before():
    params = A.AutoencoderParams(["x0"], batch=4, dropout=0.0)
    import pandas as pd

    part = pd.DataFrame({"part": [0] * 9, "key": list("abcdefghi"), "x0": np.arange(9.0)})
    after = A._trainer(params, A.first_state(params), 0, 2)(part)
    assert after["state"][0][-1] == 2.0  # two steps, of 4 and 5 rows


def test_reload_and_encoding(spark, folder):
    df = frame(spark, 200)
    params = A.AutoencoderParams(NAMES, epochs=2, code=3)
    fitted = A.fit_autoencoder(df, inputs(), params, fit_scaler(df, NAMES, inputs()))
    fitted.save(spark, f"{folder}/model")
    back = A.load_autoencoder(spark, f"{folder}/model")
    assert (back.params, back.scaler, back.threshold) == (fitted.params, fitted.scaler, fitted.threshold)
    assert errors(df, back) == errors(df, fitted)
    codes = fitted.encode(df, inputs()).select("encoding").collect()
    assert all(len(r.encoding) == 3 and min(r.encoding) >= 0 for r in codes)
    assert spark.read.parquet(f"{folder}/model").first().shapes[0] == [4, 32]


def test_no_rows(spark):
    with pytest.raises(ValueError):
        A.train_autoencoder(frame(spark).limit(0), inputs(), A.AutoencoderParams(NAMES))


def test_one_part_and_four_train_alike(spark):
    """As far as two seeds do. The five far points decide the mean error, so the median is compared."""
    df = frame(spark, 2000)
    scaler = fit_scaler(df, NAMES, inputs())
    found = []
    for part_rows in (2000, 500):
        fitted = A.train_autoencoder(df, inputs(), A.AutoencoderParams(NAMES, epochs=15, part_rows=part_rows), scaler)
        found.append(errors(df, fitted))
    one, four = (np.median(list(f.values())) for f in found)
    assert 0.4 < four / one < 2.5
    assert four < 0.1 * np.median(list(errors(df, A.Autoencoder(fitted.params, scaler, A.first_state(fitted.params))).values()))
    top = [set(sorted(f, key=f.get)[-100:]) for f in found]
    assert len(top[0] & top[1]) >= 50 and {f"c{i:05d}" for i in range(5)} <= top[0] & top[1]


def test_every_task_has_one_part(spark):
    """The rows of a part are placed by its number; a hash of it would leave tasks without any."""
    df = spark.range(4000).selectExpr("id", "CAST(id % 16 AS INT) AS part").repartitionById(16, "part")
    placed = df.select("part", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({r.task for r in placed}) == 16
    plan = df.groupBy("part").applyInPandas(lambda x: x[:1], "id long, part int")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_many_small_parts_train_in_teams(spark, monkeypatch):
    """All rows train, none of the states makes fewer steps, and the work does not grow with the number of small parts."""
    df, seen, average = frame(spark, 2000), [], A.average_states

    def counted(states, n):
        seen.append(states.agg(F.count(F.lit(1)), F.sum("rows"), F.min(F.element_at("state", -1)), F.max("part")).first())
        return average(states, n)

    monkeypatch.setattr(A, "average_states", counted)
    params = A.AutoencoderParams(NAMES, epochs=2, rounds=2, part_rows=10, round_rows=320)
    scaler = fit_scaler(df, NAMES, inputs())
    fitted = A.train_autoencoder(df, inputs(), params, scaler)
    held = A.train_autoencoder(df, inputs(), A.AutoencoderParams(NAMES, epochs=2, rounds=2, part_rows=2000), scaler)
    rows = seen[-1][1]
    assert [tuple(s) for s in seen[:2]] == [(64, rows, 10.0, 63), (64, rows, 20.0, 63)] and seen[-1][0] == 1
    assert 1700 < rows < 1900 and len(held.state) == len(fitted.state)
    # Teams of full size make one pass an epoch, however many they are; few parts are a team each.
    assert A.teams_of(10_000_000, A.AutoencoderParams(NAMES, part_rows=40)) == (250_000, 200)
    assert A.teams_of(10_000_000, A.AutoencoderParams(NAMES)) == (200, 200) and A.teams_of(2000, params) == (200, 64)
    assert A.teams_of(1500, A.AutoencoderParams(NAMES, part_rows=40)) == (38, 38)


def test_a_team_trains_all_its_parts_once_a_pass(monkeypatch):
    import pandas as pd

    seen, gradient = [], A.Network.gradient
    monkeypatch.setattr(A.Network, "gradient", lambda net, x, *more: seen.append(x[:, 0].tolist()) or gradient(net, x, *more))
    params = A.AutoencoderParams(["x0"], batch=4, dropout=0.0)
    team = pd.DataFrame({"part": [1] * 6 + [4] * 5 + [7] * 2, "key": list("abcdefghijklm"), "x0": np.arange(13.0)})
    # Batches of 4 and 2, of 5, and of 2.
    after = A._trainer(params, A.first_state(params), 0, 8, 3)(team)
    assert after["part"][0] == 1 and after["rows"][0] == 13 and after["state"][0][-1] == 8.0
    for turn in (seen[:4], seen[4:]):
        assert sorted(sum(turn, [])) == list(range(13)) and sorted(map(len, turn)) == [2, 2, 4, 5]
        assert all(len({int(v >= 6) + int(v >= 11) for v in batch}) == 1 for batch in turn)
