"""Regressors, components, scaling, search and stored artifacts."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from loomwright.functions import mathops
from loomwright.operators import curves, decompose, metrics, models, scale, scoring, search
from loomwright.operators.aggregate import GroupRows
from loomwright.operators.encode import OneHot
from loomwright.plans.operator import Apply, Chain
from loomwright.session import scratch_path
from loomwright.sources import artifacts


@pytest.fixture(scope="module")
def campaign(spark):
    draw = np.random.default_rng(42)
    x = draw.normal(size=(800, 4))
    y = 3 + x @ [1.0, -2.0, 0.5, 0.0] + draw.normal(scale=0.1, size=800)
    rows = [(i, int(i % 10), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, g int, f_0 double, f_1 double, f_2 double, f_3 double, t double").repartition(4).cache()


FEATURES = ("f_0", "f_1", "f_2", "f_3")


def test_linear_fit(campaign):
    model = models.LinearRegressor(FEATURES, ("t",)).fit(campaign)
    assert model.weights["t"] == pytest.approx([1, -2, 0.5, 0], abs=0.02)
    assert model.score(campaign) == pytest.approx(model.fitted_score["t"]) and model.score(campaign) > 0.99
    assert model.mean["f_0"] == pytest.approx(campaign.agg(F.avg("f_0")).first()[0])


def test_missing_features_count_as_zero(campaign):
    model = models.LinearRegressor(FEATURES, ("t",)).fit(campaign)
    done = model(campaign.drop("f_0"))
    assert "f_0" in done.columns and done.where("f_0 != 0").count() == 0


def test_ten_group_models(campaign):
    model = models.GroupedRegressor(FEATURES, ("t",), "g").fit(campaign)
    table = model.score_table(campaign).collect()
    assert len(table) == 10 and all(r["t"] <= 1 for r in table) and min(r["t"] for r in table) > 0.9
    one = models.LinearRegressor(FEATURES, ("t",)).fit(campaign.where("g = 3"))
    row = model.table.where("g = 3").first()
    assert row["weights"][0] == pytest.approx(one.weights["t"])


def test_group_models_by_join_and_by_broadcast_agree(campaign):
    from dataclasses import replace

    model = models.GroupedRegressor(FEATURES, ("t",), "g").fit(campaign)
    a = {r["id"]: r["pred_t"] for r in model(campaign).collect()}
    b = {r["id"]: r["pred_t"] for r in replace(model, small=False)(campaign).collect()}
    assert a == b


def test_trees_and_stacking(campaign):
    tree = models.SparkRegressor(FEATURES, ("t",), build=lambda: DecisionTreeRegressor(maxDepth=3))
    linear = models.LinearRegressor(FEATURES, ("t",))
    stacked = models.StackedRegressor(FEATURES, ("t",), (tree, linear)).fit(campaign)
    assert stacked.score(campaign) > 0.99
    assert set(campaign.columns) <= set(stacked(campaign).columns)


def test_routed_prediction_has_one_row_per_group(campaign):
    model = models.LinearRegressor(FEATURES, ("t",))
    flow = scoring.RoutedPrediction(
        model, ("t",), Chain((GroupRows(("g",), (*FEATURES, "t")),)), models.LinearRegressor(("f_0",), ("t",)), criteria={"g": 0})
    done = flow.fit(campaign)(campaign)
    assert done.count() == 10 and done.columns.count("t") == 1 and "_n_rows" not in done.columns


def test_training_job(campaign):
    trained = scoring.train(campaign, models.LinearRegressor(FEATURES, ("t",)), ["id"])
    rows = {r["split"]: r["r2_t"] for r in trained.scores.collect()}
    assert set(rows) == {"train", "valid"} and rows["valid"] > 0.95
    searched = scoring.train(
        campaign, models.LinearRegressor(FEATURES, ("t",)), ["id"],
        candidates=[models.LinearRegressor(FEATURES, ("t",), r) for r in (1e9, 0.0)])
    assert searched.flow.model.ridge == 0.0 and searched.leaderboard.count() == 2


def brute_means(campaign, model, candidates):
    pdf = campaign.toPandas()
    out = []
    for setting in candidates.settings():
        p = pdf.assign(**setting)
        pred = model.intercepts["t"] + sum(w * p[c] for w, c in zip(model.weights["t"], model.features))
        out.append((pred.mean(), (pred**2).mean()))
    return out


def test_responses_in_closed_form_and_general(spark, campaign):
    model = models.LinearRegressor(FEATURES, ("t",)).fit(campaign)
    candidates = search.random_candidates({"f_1": (-1, 1), "f_2": (0, 2)}, 5)
    closed = search.mean_responses(campaign, model, "t", candidates).orderBy("candidate").collect()
    general = search._general_responses(campaign, model, "t", candidates, False).orderBy("candidate").collect()
    for a, b, (mean, square) in zip(closed, general, brute_means(campaign, model, candidates)):
        assert a["mean"] == pytest.approx(mean) and b["mean"] == pytest.approx(mean)
        assert a["square"] == pytest.approx(square) and b["square"] == pytest.approx(square)
        assert a["rows"] == b["rows"] == 800


def test_models_as_functions_of_matrices(spark, campaign):
    """Trees, forests, boosted trees, generalised, stacked, defaulted and curve models answer as their table form does."""
    from pyspark.ml import regression

    from loomwright.operators.evaluate import evaluator, inputs

    def ml(build):
        return models.SparkRegressor(FEATURES, ("t",), build=build)

    shifted = campaign.withColumn("t", F.abs("t") + 1)
    kinds = [
        ml(lambda: regression.DecisionTreeRegressor(maxDepth=4, seed=1)), ml(lambda: regression.RandomForestRegressor(numTrees=3, seed=1)),
        ml(lambda: regression.GBTRegressor(maxIter=3, seed=1)), ml(lambda: regression.LinearRegression()),
        ml(lambda: regression.GeneralizedLinearRegression(family="poisson", link="log")),
        ml(lambda: regression.GeneralizedLinearRegression(family="gamma")),
        models.StackedRegressor(FEATURES, ("t",), (models.LinearRegressor(FEATURES[:1], ("t",)), ml(lambda: regression.DecisionTreeRegressor(maxDepth=3)))),
        models.DefaultedRegressor(FEATURES, ("t",), models.LinearRegressor(FEATURES, ("t",)), {"f_1": 0.5}),
        curves.AdbudgRegressor(FEATURES[:1], ("t",), candidates=((0.5, 1.0),)),
    ]
    candidates = search.random_candidates({"f_1": (-1, 1), "f_2": (0, 2)}, 4)
    for kind in kinds:
        model = kind.fit(shifted)
        assert evaluator(model) is not None and set(inputs(model)) <= set(FEATURES)
        got = search.mean_responses(shifted, model, "t", candidates).orderBy("candidate").collect()
        for r, setting in zip(got, candidates.settings()):
            done = model(shifted.withColumns({c: F.lit(v) for c, v in setting.items()}))
            mean, square = done.agg(F.avg("pred_t"), F.avg(F.col("pred_t") ** 2)).first()
            assert r["mean"] == pytest.approx(mean) and r["square"] == pytest.approx(square) and r["rows"] == 800
        mean, square = search._overall(shifted, model, "t", candidates, False, None)
        assert mean == pytest.approx(np.mean([r["mean"] for r in got])) and square == pytest.approx(np.mean([r["square"] for r in got]))


def test_models_without_a_matrix_form_unfold(spark, campaign):
    from pyspark.ml import regression

    from loomwright.operators.evaluate import evaluator

    model = models.SparkRegressor(FEATURES, ("t",), build=lambda: regression.IsotonicRegression()).fit(campaign)
    assert evaluator(model) is None
    candidates = search.random_candidates({"f_0": (-1, 1)}, 3)
    got = search.mean_responses(campaign, model, "t", candidates).orderBy("candidate").collect()
    for r, setting in zip(got, candidates.settings()):
        assert r["mean"] == pytest.approx(model(campaign.withColumn("f_0", F.lit(setting["f_0"]))).agg(F.avg("pred_t")).first()[0])


def test_responses_take_one_pass(spark, campaign):
    """The number of jobs does not depend on the number of candidates."""
    from pyspark.ml import regression

    model = models.SparkRegressor(FEATURES, ("t",), build=lambda: regression.DecisionTreeRegressor(maxDepth=3)).fit(campaign)
    context, jobs = spark.sparkContext, []
    for count in (3, 2000):
        context.setJobGroup(f"responses {count}", "count jobs")
        assert search.mean_responses(campaign, model, "t", search.random_candidates({"f_1": (-1, 1)}, count)).count() == count
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"responses {count}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_option_grids_are_not_listed(spark):
    grid = search.option_candidates(["a", "b", "c"], [0.0, 1.0, 4.0], normalized=True)
    assert grid.count == 27 and [*map(tuple, grid.block(5, 7).tolist())] == grid.rows[5:7]
    listed = [tuple(r)[1:] for r in grid.table(spark).orderBy("candidate").collect()]
    assert np.array(listed) == pytest.approx(np.array(grid.rows), nan_ok=True)
    assert search.option_candidates([f"x{k}" for k in range(40)], [0, 1]).block(5, 6).sum() == 2


def test_preparation_around_a_search(spark, campaign):
    """Steps before the replaced column run once, steps that read it run per candidate; same result."""
    from loomwright.operators.features import ScaledColumn, SignedLog

    chain = Chain((SignedLog(("f_0",)), ScaledColumn("f_1", "f_2", 2.0)), FEATURES, True)
    model = models.LinearRegressor(FEATURES, ("t",)).fit(chain(campaign))
    candidates = search.random_candidates({"f_1": (-1, 1)}, 3)
    got = search.mean_responses(campaign, model, "t", candidates, prepare=chain).orderBy("candidate").collect()
    for r, setting in zip(got, candidates.settings()):
        done = model(chain(campaign.withColumn("f_1", F.lit(setting["f_1"]))))
        assert r["mean"] == pytest.approx(done.agg(F.avg("pred_t")).first()[0])
    early = Chain((SignedLog(("f_0",)),), FEATURES, True)
    closed = search.mean_responses(campaign, model, "t", candidates, prepare=early)
    assert closed.count() == 3


def test_recommendation_finds_the_optimum(spark, campaign):
    model = models.LinearRegressor(FEATURES, ("t",)).fit(campaign)
    low = search.recommend(campaign, model, "t", {"f_1": (0.0, 1.0)}, maximize=False).first()["f_1"]
    assert 0.9 < low <= 1.0
    best = search.recommend_by_objective(campaign, model, "t", ["f_1"], {"f_1": (0.0, 1.0)}, maximize=False)
    assert best.first()["f_1"] > 0.9


def test_default_search_range(spark, campaign):
    model = models.LinearRegressor(FEATURES, ("t",)).fit(campaign)
    row = search.recommend_by_objective(campaign, model, "t", ["f_1", "f_2"]).first()
    assert row["objective"] is not None


def test_candidate_tables():
    rows = search.option_candidates(["a", "b"], [0, 1], normalized=True).rows
    assert rows[3] == (0.5, 0.5) and np.isnan(rows[0][0])
    even = search.even_candidates({"a": (0, 1)}, 15).rows
    assert len(set(even)) == 15 and all(0 <= r[0] <= 1 for r in even)


def test_curve_search_recovers_parameters(spark):
    x = np.linspace(0.5, 30, 200)
    y = 5 * x**0.7 / (x**0.7 + 1.1) + 2
    rows = spark.createDataFrame([(float(a), float(b), float(a % 3)) for a, b in zip(x, y)], "x double, t double, z double")
    model = curves.AdbudgRegressor(("x", "z"), ("t",)).fit(rows)
    assert model.chosen["x"] == (0.7, 1.1) and model.score(rows) > 0.9999
    log = curves.LogNormalRegressor(("x",), ("t",), candidates=((0.5, 1.0), (1.0, 2.0))).fit(rows)
    assert log.score(rows) == pytest.approx(log.search_scores["x"], abs=1e-9)


def test_poisson_search_recovers_parameters(spark):
    x = np.linspace(0.5, 30, 200)
    z = np.sin(x)
    mean = np.exp(0.3 + 2.5 * x**0.7 / (x**0.7 + 1.1) + 0.8 * (z * np.abs(z) ** -0.5) / (z * np.abs(z) ** -0.5 + 2.0))
    rows = spark.createDataFrame([(float(a), float(c), float(b), float(2 * b)) for a, b, c in zip(x, mean, z)], "x double, z double, t double, u double")
    model = curves.AdbudgRegressor(("x", "z"), ("t", "u"), poisson=True, rounds=3).fit(rows)
    assert model.chosen == {"x": (0.7, 1.1), "z": (0.5, 2.0)} and model.search_scores["z"] > 0.999999
    assert model.score(rows) > 0.9999
    weights, intercept = model.poisson_weights["t"]
    assert weights == pytest.approx([2.5, 0.8], abs=1e-3) and intercept == pytest.approx(0.3, abs=1e-3)
    with pytest.raises(ValueError, match="0 and above"):
        model.fit(rows.withColumn("t", -F.col("t")))


def test_poisson_steps_that_overshoot(spark):
    """Rare large counts, where a whole Newton step makes the fit worse."""
    rows = spark.createDataFrame([(float(k), 0.0 if k < 60 else 400.0) for k in range(64)], "x double, t double")
    for pair in ((1.0, 1.0), (3.0, 2.0), (0.1, 0.1)):
        model = curves.AdbudgRegressor(("x",), ("t",), candidates=(pair,), poisson=True, steps=300).fit(rows)
        left = model.curves(model(rows)).agg(F.sum(F.col("t") - F.col("pred_t")), F.sum((F.col("t") - F.col("pred_t")) * F.col("_c_x"))).first()
        assert np.abs(left).max() < 1e-2  # of 1,600 counts: the likelihood can't rise in any direction


def test_poisson_penalty_shrinks(spark):
    rows = spark.createDataFrame([(float(k), float(k)) for k in range(1, 40)], "x double, t double")
    free, held = (curves.AdbudgRegressor(("x",), ("t",), candidates=((1.0, 1.0),), poisson=True, alpha=a).fit(rows) for a in (0.0, 0.8))
    assert 0 < held.poisson_weights["t"][0][0] < free.poisson_weights["t"][0][0]


def test_tasks_and_columns_compute_the_same_curve(spark):
    x = [-3.0, -1.0, 0.0, 0.5, 4.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double")
    for model in (curves.AdbudgRegressor(("x",), ()), curves.AdbudgRegressor(("x",), (), magnitude=True),
                  curves.LogNormalRegressor(("x",), (), lowest={"x": -3.0})):
        pair = (0.7, 1.3)
        inside = model.matrix_function()(np.array(x), "x", [pair])[:, 0]
        column = [r[0] for r in rows.select(model.curve(F.col("x"), "x", pair)).collect()]
        assert column == pytest.approx(inside.tolist(), rel=1e-9)


def scores_of(df, prefix, count):
    return np.array(df.select(*[f"{prefix}_{k}" for k in range(count)]).collect(), float)


@pytest.fixture(scope="module")
def mixed(spark):
    draw = np.random.default_rng(7)
    sources = np.column_stack([draw.uniform(-1, 1, 1200), draw.laplace(size=1200), np.sign(draw.normal(size=1200))])
    x = sources @ draw.normal(size=(3, 6)) + draw.normal(scale=0.01, size=(1200, 6))
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"d_{k} double" for k in range(6))).repartition(3).cache(), x, sources


COLUMNS = tuple(f"d_{k}" for k in range(6))


def test_pca_scores(mixed):
    df, x, _ = mixed
    got = scores_of(decompose.Pca(COLUMNS, 3).fit_transform(df), "d_pc", 3)
    assert np.corrcoef(got.T) == pytest.approx(np.eye(3), abs=1e-6)
    assert got.var(0) == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3])


def test_low_rank_is_stable(spark, mixed):
    df, _, _ = mixed
    model = decompose.LowRank(COLUMNS, n_min=2, n_max=5).fit(df)
    assert model.fit(df).loadings == model.loadings
    some = df.limit(3)
    whole = {tuple(r[:6]): tuple(r[6:]) for r in model(df).collect()}
    for r in model(some).collect():
        assert whole[tuple(r[:6])] == pytest.approx(tuple(r[6:]))
    assert len(decompose.LowRank(COLUMNS, n_min=1, n_max=6, explained=0.999).fit(df).loadings) == 3


def test_low_rank_selects_a_size(spark):
    """The number of components follows the data, not the ends of the range."""
    draw = np.random.default_rng(4)
    for hidden in (2, 4):
        x = draw.normal(size=(900, hidden)) @ draw.normal(size=(hidden, 12)) + draw.normal(scale=0.1, size=(900, 12))
        df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
        size = {len(decompose.LowRank(("v",), n_min=a, n_max=b).fit(df).loadings) for a, b in ((1, 12), (2, 6), (1, 10))}
        assert size == {hidden}
        assert len(decompose.LowRank(("v",), n_min=5, n_max=8).fit(df).loadings) == 5


def test_ragged_vectors_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],), ([4.0],)], "v array<double>")
    with pytest.raises(Exception, match="elements in place of"):
        decompose.Pca(("v",), 1).fit(df)


def test_ica_finds_sources(mixed):
    df, x, sources = mixed
    model = decompose.Ica(COLUMNS, 3).fit(df)
    got = model.function()(x)
    match = np.abs(np.corrcoef(got.T, sources.T)[:3, 3:])
    assert match.max(axis=1).min() > 0.95 and model.converged
    assert not decompose.Ica(COLUMNS, 3, rounds=1).fit(df).converged


def test_ica_takes_two_sources_apart(spark):
    draw = np.random.default_rng(8)
    sources = np.column_stack([draw.uniform(-1, 1, 4000), draw.laplace(size=4000)])
    x = sources @ np.array([[1.0, 0.4], [-0.3, 2.0]])
    model = decompose.Ica(("a_0", "a_1")).fit(spark.createDataFrame([tuple(map(float, r)) for r in x], "a_0 double, a_1 double"))
    match = np.abs(np.corrcoef(model.function()(x).T, sources.T)[:2, 2:])
    assert match.max(axis=1).min() > 0.99 and model.converged


def test_poly_kernel_is_its_feature_map(mixed):
    """Inner products of features are kernel values, and scores are those of the kernel matrix of all rows."""
    df, x, _ = mixed
    model = decompose.kernel_pca("poly", COLUMNS, n_components=3, gamma=0.3, bias=0.7).fit(df)
    features, size = model.feature_map(6, 0.3)
    phi = features(x)
    assert phi.shape == (1200, size) == (1200, 84)
    kernel = (0.3 * x @ x.T + 0.7) ** 3
    assert phi @ phi.T == pytest.approx(kernel)
    middle = np.eye(1200) - 1 / 1200
    values = np.linalg.eigvalsh(middle @ kernel @ middle)[::-1][:3]
    assert (model.function()(x) ** 2).sum(0) == pytest.approx(values, rel=1e-6)


def test_wide_kernel_map_by_iteration(mixed, monkeypatch):
    df, x, _ = mixed
    whole = decompose.kernel_pca("poly", COLUMNS, n_components=3).fit(df)
    monkeypatch.setattr(decompose, "WIDE", 10)
    monkeypatch.setattr(decompose, "CELLS", 1000)
    found = decompose.kernel_pca("poly", COLUMNS, n_components=3).fit(df)
    assert found.converged and whole.converged is None
    assert found.function()(x) == pytest.approx(whole.function()(x), abs=1e-2, rel=1e-3)


def test_rbf_waves_are_close_to_the_kernel(mixed):
    df, x, _ = mixed
    model = decompose.kernel_pca("rbf", COLUMNS, n_components=3, waves=2000).fit(df)
    phi = model.feature_map(6, model.gamma)[0](x[:300])
    apart = ((x[:300, None] - x[None, :300]) ** 2).sum(2)
    error = phi @ phi.T - np.exp(-model.gamma * apart)
    assert np.abs(error).mean() < 1 / np.sqrt(2 * 2000) and error.std() < 1 / np.sqrt(2 * 2000)
    with pytest.raises(ValueError, match="no feature map"):
        decompose.kernel_pca("sigmoid", COLUMNS)


def test_factor_analysis_and_kernels(mixed):
    df, _, _ = mixed
    assert scores_of(decompose.FactorAnalysis(COLUMNS, 2).fit_transform(df), "d_ca", 2).shape == (1200, 2)
    for kind, suffix in decompose.KernelPca.NAMES.items():
        got = scores_of(decompose.kernel_pca(kind, COLUMNS, n_components=3).fit_transform(df), f"d_{suffix}", 3)
        assert np.abs(np.corrcoef(got.T) - np.eye(3)).max() < 1e-6


def test_one_factor_is_found(spark):
    draw = np.random.default_rng(11)
    hidden = draw.normal(size=900)
    x = hidden[:, None] * [1.0, 2.0, -1.5, 0.5] + draw.normal(size=(900, 4)) * [0.2, 0.6, 0.4, 0.3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "d_0 double, d_1 double, d_2 double, d_3 double")
    model = decompose.FactorAnalysis(("d_0", "d_1", "d_2", "d_3"), 1).fit(df)
    got = np.array(df.transform(model).select("d_ca_0").collect())[:, 0]
    assert abs(np.corrcoef(got, hidden)[0, 1]) > 0.97


def test_token_counts_of_whole_texts(spark):
    from loomwright.operators.embed import EncodeOnce, token_counts

    rows = spark.createDataFrame(
        [(1, "g", "Red red  blue"), (2, "g", "other"), (3, "h", "blue RED red"), (4, "k", None)], "i int, g string, t string")
    done = EncodeOnce(("t",), "g", ("i",), token_counts(64), normalize=False)(rows).orderBy("i").collect()
    assert done[0]["t_clip"] == done[1]["t_clip"] == done[2]["t_clip"] and sum(done[0]["t_clip"]) == 3
    assert sorted(v for v in done[0]["t_clip"] if v) == [1.0, 2.0] and done[3]["t_clip"] is None


def test_nmf_rebuilds_non_negative_data(spark):
    draw = np.random.default_rng(5)
    x = draw.random((300, 2)) @ draw.random((2, 6))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"d_{k} double" for k in range(6)))
    model = decompose.Nmf(COLUMNS, 2, rounds=60).fit(df)
    mix = model.function()(x)
    assert mix.min() >= 0 and np.abs(mix @ np.array(model.loadings) - x).mean() < 0.02


def test_nmf_of_an_outer_product(spark):
    x = np.outer(np.arange(1.0, 101), [1.0, 0.0, 2.5, 0.3, 4.0, 1.0])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"d_{k} double" for k in range(6)))
    model = decompose.Nmf(COLUMNS, 1).fit(df)
    assert model.converged and model.function()(x) @ np.array(model.loadings) == pytest.approx(x, abs=1e-6)
    assert not decompose.Nmf(COLUMNS, 2, rounds=1).fit(df).converged
    negative = df.withColumn("d_1", F.lit(-1.0))
    with pytest.raises(ValueError, match="100 cells are negative"):
        model.fit(negative)
    with pytest.raises(Exception, match="negative cells"):
        model(negative).collect()


def test_null_vectors_stay_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [2.0, 1.0])], "i int, v array<double>")
    done = decompose.Pca(("v",), 1, as_array=True).fit_transform(df).orderBy("i").collect()
    assert done[1]["v_pc"] is None and len(done[0]["v_pc"]) == 1


def test_quantile_maps(spark):
    draw = np.random.default_rng(9)
    values = draw.exponential(size=2000)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    uniform = scale.QuantileUniform(("x",)).fit(df)
    got = uniform(df.where("x is not null")).orderBy("x").toPandas()["x"].to_numpy()
    assert np.all(np.diff(got) >= 0) and got[0] == 0 and got[-1] == 1 and abs(got.mean() - 0.5) < 0.01
    normal = scale.QuantileNormal(("x",)).fit_transform(df).where("x is not null").toPandas()["x"]
    assert abs(normal.mean()) < 0.02 and abs(normal[normal.abs() < 5].std() - 1) < 0.05
    assert uniform(df).where("x is null").count() == 1


def test_probit_against_the_distribution_function(spark):
    from math import erf

    z = [-4.0, -2.5, -1.0, -0.1, 0.0, 0.7, 2.2, 4.5]
    df = spark.createDataFrame([(0.5 * (1 + erf(v / 2**0.5)),) for v in z], "p double")
    assert [r[0] for r in df.select(mathops.probit(F.col("p"))).collect()] == pytest.approx(z, abs=1e-6)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for step in (scale.RobustScale(("x",)), scale.MinMaxScale(("x",)), scale.StandardScale(("x",))):
        fitted = step.fit(df)
        assert [r["x"] for r in fitted(df).collect()] == [0.0, 0.0]
        assert [r["x"] for r in fitted.inverse(fitted(df)).collect()] == [3.0, 3.0]


def test_scaler_names():
    kinds = {"QuantileTransformer": scale.QuantileUniform, "quantilenormal": scale.QuantileNormal, "robust": scale.RobustScale,
             "MinMaxScaler": scale.MinMaxScale, None: scale.RobustScale, "what": scale.RobustScale}
    for name, kind in kinds.items():
        assert type(scale.scaler(name, ("x",))) is kind


def test_r2_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0)] * 3, "y double, p double, q double")
    row = df.agg(metrics.r2(F.col("y"), F.col("p")).alias("a"), metrics.r2(F.col("y"), F.col("q")).alias("b")).first()
    assert (row["a"], row["b"]) == (1.0, 0.0)


def test_store_and_load(spark, campaign):
    chain = Chain((OneHot(("g",)), scale.RobustScale(("f_0",)), models.GroupedRegressor(FEATURES, ("t",), "g"))).fit(campaign)
    path = scratch_path(spark, "artifact")
    first, second = artifacts.save(spark, chain, path), artifacts.save(spark, chain, path)
    assert first == path and second == f"{path}_1"
    loaded = artifacts.load(spark, second)
    assert sorted(map(tuple, loaded(campaign).collect())) == sorted(map(tuple, chain(campaign).collect()))
    with pytest.raises(TypeError):
        artifacts.save(spark, Apply(lambda df: df), scratch_path(spark, "code"))


def test_storing_models_and_dates(spark, campaign):
    import datetime
    import decimal

    from pyspark.ml.feature import MinMaxScaler

    days = campaign.withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("g")))
    flags = OneHot(("d",), {"d": [datetime.date(2024, 1, 2)]})
    forest = models.SparkRegressor(FEATURES, ("t",), build=lambda: DecisionTreeRegressor(maxDepth=3))
    scaled = scale.PerColumn(("f_0", "f_1"), lambda i, o: MinMaxScaler(inputCol=i, outputCol=o), drop_original=False)
    chain = Chain((flags, scaled, forest)).fit(days)
    back = artifacts.load(spark, artifacts.save(spark, chain, scratch_path(spark, "kept")))
    assert back(days).orderBy("id").collect() == chain(days).orderBy("id").collect()
    values = {"a": datetime.datetime(2024, 1, 1, 2, 3, 4, 5), "b": decimal.Decimal("1.50"), "c": b"\x00\xff", "d": datetime.timedelta(1, 2, 3)}
    step = OneHot(("x",), {"x": list(values.values())})
    assert artifacts.load(spark, artifacts.save(spark, step, scratch_path(spark, "kept"))).items["x"] == list(values.values())
    with pytest.raises(TypeError):
        artifacts.save(spark, models.SparkRegressor(FEATURES, ("t",), build=lambda: None), scratch_path(spark, "kept"))


def test_encoder_runs_once_for_all_columns(spark):
    from loomwright.operators.embed import EncodeOnce

    runs = []

    def encoder(values):
        runs.append(values.columns)
        return values.select("value", F.array(F.length("value").cast("double")).alias("vector"))

    rows = spark.createDataFrame([(1, "g", "aa", ["x", "yyy"]), (2, "g", "b", None), (3, "h", None, [])], "i int, g string, t string, l array<string>")
    done = EncodeOnce(("t", "l"), "g", ("i",), encoder, normalize=False)(rows).orderBy("i").collect()
    assert len(runs) == 1
    assert [(r["t_clip"], r["l_clip"]) for r in done] == [([2.0], [2.0]), ([2.0], [2.0]), (None, None)]


def test_routes_with_preparations_of_their_own(spark, campaign):
    from loomwright.operators.features import SignedLog

    flow = scoring.RoutedPrediction(
        models.LinearRegressor(FEATURES, ("t",)), ("t",), Chain(()), models.LinearRegressor(FEATURES, ("t",)),
        Chain((SignedLog(("f_0",)),)), criteria={"g": 3})
    fitted = flow.fit(campaign)
    done = {r["id"]: r["t"] for r in fitted(campaign).collect()}
    ours = campaign.where("g = 3")
    second = models.LinearRegressor(FEATURES, ("t",)).fit(SignedLog(("f_0",))(ours))
    want = {r["id"]: r["pred_t"] for r in second(SignedLog(("f_0",))(ours)).collect()}
    assert len(done) == 800 and {i: done[i] for i in want} == pytest.approx(want)


def test_wide_rows_are_scored_outside_whole_stage_code(spark):
    """30 columns: neither the packed columns nor the prediction is part of a method too long to be compiled."""
    x = np.random.default_rng(9).normal(2, 1, size=(300, 30))
    names = tuple(f"c{k}" for k in range(30))
    group = ["a" if k % 3 else "b" for k in range(300)]
    rows = spark.createDataFrame(
        [(k, g, *map(float, r), float(r @ np.arange(30) + (g == "a"))) for k, (g, r) in enumerate(zip(group, x))],
        "id int, g string, " + ", ".join(f"{c} double" for c in names) + ", t double")
    rows = rows.union(rows.limit(1).selectExpr("-1", "null", *rows.columns[2:])).repartition(3)
    done = models.GroupedRegressor(names, ("t",), "g").fit_transform(rows)
    assert done.columns == [*rows.columns, "pred_t"]
    narrow = done.select("id", "pred_t")
    got = {r["id"]: r["pred_t"] for r in narrow.collect()}
    assert got == {k: pytest.approx(r @ np.arange(30) + (g == "a")) for k, (g, r) in enumerate(zip(group, x))}
    plan = narrow._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    for made in ("AS _x#", "AS pred_t#"):
        lines = [line for line in plan if made in line and "Project [" in line]
        assert lines and not any("*(" in line.split("Project [")[0] for line in lines), plan
