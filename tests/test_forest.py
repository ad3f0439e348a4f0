import numpy as np
import pytest
from pyspark.sql import functions as F

from wattsift.operators import forest as M
from wattsift.operators.scoring import label_by_contamination, normalize_scores

NAMES = ["x0", "x1", "x2"]


def inputs():
    return [F.col(n) for n in NAMES]


def frame(spark, n, far=5):
    """A cloud, and ``far`` points well outside of it."""
    random = np.random.default_rng(0)
    rows = random.normal(size=(n, 3))
    rows[:far] += 12.0
    return spark.createDataFrame([(f"c{i:05d}", *map(float, r)) for i, r in enumerate(rows)],
                                 "consumer_id string, x0 double, x1 double, x2 double")


def scores(df, forest):
    return {r.consumer_id: r.raw_score for r in forest.score(df, inputs()).collect()}


@pytest.mark.parametrize("n", [300, 3000])
def test_same_seed_same_scores_under_any_partitioning(spark, n):
    df = frame(spark, n)
    first = scores(df, M.fit_forest(df.repartition(3), NAMES, inputs(), trees=20))
    again = scores(df.repartition(7), M.fit_forest(df.repartition(11), NAMES, inputs(), trees=20))
    other = scores(df, M.fit_forest(df, NAMES, inputs(), trees=20, seed=1))
    assert first == again and first != other


@pytest.mark.parametrize("n", [300, 3000])
def test_far_points_rank_on_top(spark, n):
    df = frame(spark, n)
    found = scores(df, M.fit_forest(df, NAMES, inputs()))
    assert set(sorted(found, key=found.get)[:5]) == {f"c{i:05d}" for i in range(5)}
    assert all(-1 < s < 0 for s in found.values())


def test_flagged_share(spark):
    df = frame(spark, 400)
    scored = M.fit_forest(df, NAMES, inputs()).score(df, inputs()).cache()
    assert abs(label_by_contamination(scored, "raw_score", 0.05).filter("is_anomaly").count() - 20) <= 1
    low, high = normalize_scores(scored, "raw_score").agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert (low, high) == (0.0, 1.0)


@pytest.mark.parametrize("n", [40, 600, 5000])
def test_shape_of_the_trees(spark, n):
    df = frame(spark, n, far=0)
    nodes = M.fit_forest(df, NAMES, inputs(), trees=12).nodes
    sample = min(256, n)
    assert nodes["tree_id"].nunique() == 12
    assert nodes["depth"].max() <= np.ceil(np.log2(sample))
    roots = nodes[nodes["node_id"] == 0]
    assert (roots["size"] == sample).all()
    for _, tree in nodes.groupby("tree_id"):
        by_id = tree.set_index("node_id")
        inner = by_id[by_id["feature"] >= 0]
        halves = by_id.loc[inner["left"], "size"].to_numpy() + by_id.loc[inner["right"], "size"].to_numpy()
        assert (halves == inner["size"]).all() and (by_id["size"] > 0).all()
        assert by_id[by_id["feature"] < 0]["size"].sum() == sample


def test_samples_differ_between_trees_and_are_drawn_evenly(spark):
    df = frame(spark, 4000, far=0)
    params = M.ForestParams(NAMES, trees=50)
    drawn = M.draw_samples(df, inputs(), params, 4000, "consumer_id").toPandas()
    per_tree = drawn.groupby("tree_id").size()
    assert (per_tree >= 256).all() and (per_tree <= 700).all()  # twice the sample is expected
    assert drawn["key"].nunique() > 3900


def _path_by_walk(nodes, point):
    """One tree, one point, node by node."""
    node = nodes.loc[0]
    while node["feature"] >= 0:
        node = nodes.loc[int(node["left"] if point[int(node["feature"])] <= node["threshold"] else node["right"])]
    size = node["size"]
    rest = 0.0 if size <= 1 else 1.0 if size == 2 else 2 * (np.log(size - 1) + np.euler_gamma) - 2 * (size - 1) / size
    return node["depth"] + rest


def test_scores_equal_a_walk_through_every_tree(spark):
    df = frame(spark, 700)
    forest = M.fit_forest(df, NAMES, inputs(), trees=7)
    found = scores(df, forest)
    unit = 2 * (np.log(255) + np.euler_gamma) - 2 * 255 / 256
    trees = [t.set_index("node_id") for _, t in forest.nodes.groupby("tree_id")]
    for r in df.limit(25).collect():
        point = [r.x0, r.x1, r.x2]
        mean = np.mean([_path_by_walk(t, point) for t in trees])
        assert found[r.consumer_id] == pytest.approx(-2.0 ** (-mean / unit), rel=1e-12)


def test_constant_and_single_rows(spark):
    df = spark.createDataFrame([(f"c{i}", 1.0, 1.0, 1.0) for i in range(5)], "consumer_id string, x0 double, x1 double, x2 double")
    assert len(set(scores(df, M.fit_forest(df, NAMES, inputs(), trees=3)).values())) == 1
    one = df.limit(1)
    assert list(scores(one, M.fit_forest(one, NAMES, inputs(), trees=3)).values()) == [-0.5]
    with pytest.raises(ValueError):
        M.fit_forest(df.limit(0), NAMES, inputs())
    with pytest.raises(ValueError, match="nodes"):
        M.fit_forest(df, NAMES, inputs(), trees=5_000_000)


def test_reload_and_importance(spark, folder):
    df = frame(spark, 300)
    forest = M.fit_forest(df, NAMES, inputs(), trees=10)
    forest.save(spark, f"{folder}/forest")
    back = M.load_forest(spark, f"{folder}/forest")
    assert back.params == forest.params and scores(df, back) == scores(df, forest)
    assert [tuple(r) for r in forest.importance(spark).collect()] == [(n, 1 / 3) for n in NAMES]
    shares = {r.feature: r.importance for r in forest.importance(spark, "splits").collect()}
    used = forest.nodes[forest.nodes["feature"] >= 0]["feature"].value_counts(normalize=True)
    assert shares == {n: pytest.approx(used[i]) for i, n in enumerate(NAMES)}
    with pytest.raises(ValueError):
        forest.importance(spark, "gain")


def test_rows_are_chosen_before_they_are_exploded(spark):
    df = frame(spark, 4000, far=0)
    drawn = M.draw_samples(df, inputs(), M.ForestParams(NAMES, trees=100), 1_000_000, "consumer_id")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")  # printed from the top down
    # A row enters no tree of a hundred with a chance of (1 - 512 / 1,000,000) ** 100.
    assert 120 < drawn.select("key").distinct().count() < 280


def test_binomial_steps():
    steps = M._binomial_steps(10, 0.3)
    assert steps[0] == pytest.approx(0.7**10) and steps[1] == pytest.approx(0.7**10 + 10 * 0.3 * 0.7**9) and steps[-1] <= 1.0


def test_a_reloaded_forest_labels_new_rows(spark, folder):
    from dataclasses import replace

    from wattsift.operators.scaling import fit_scaler

    df = frame(spark, 600)
    scaler = fit_scaler(df, NAMES, inputs())
    forest = M.fit_forest(df, NAMES, scaler.columns(inputs()))
    with pytest.raises(ValueError):
        forest.label(df, inputs())
    forest = replace(forest, scaler=scaler, contamination=0.05, offset=-0.55)
    forest.save(spark, f"{folder}/f")
    back = M.load_forest(spark, f"{folder}/f")
    assert (back.scaler, back.contamination, back.offset) == (scaler, 0.05, -0.55)
    new = spark.createDataFrame([("near", 0.0, 0.1, 0.0), ("far", 15.0, 15.0, 15.0)], df.schema)
    assert {r.consumer_id: r.label for r in back.label(new, inputs()).collect()} == {"near": 1, "far": -1}
