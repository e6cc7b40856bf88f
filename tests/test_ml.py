import numpy as np
import pytest

from factorlake.operators import ml


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    rows = []
    for d in range(40):
        for k in range(10):
            x = r.normal(size=3)
            rows.append((f"2024-{d // 28 + 1:02d}-{d % 28 + 1:02d}", f"S{k}", *map(float, x), float(2 * x[0] - x[1] + 0.1 * r.normal())))
    return spark.createDataFrame(rows, "date string, symbol string, a double, b double, c double, y double").cache()


def arrays(data):
    p = data.toPandas()
    return p[["a", "b", "c"]].to_numpy(), p["y"].to_numpy()


def test_ridge_has_the_closed_form(data):
    x, y = arrays(data)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(3), xc.T @ yc)
    got = ml.Ridge({"alpha": 1.0}).fit(data, ["a", "b", "c"], "y").model.coefficients.toArray()
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_lasso_has_the_descent_solution(data):
    x, y = arrays(data)
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - 0.1, 0) / (xc[:, j] @ xc[:, j] / n)
    got = ml.Lasso({"alpha": 0.1}).fit(data, ["a", "b", "c"], "y").model.coefficients.toArray()
    np.testing.assert_allclose(got, w, atol=1e-5)


@pytest.mark.parametrize("model", [ml.Ridge(), ml.BoostedTrees({"num_rounds": 10, "learning_rate": 0.3}), ml.Network({"epochs": 12, "rate": 0.01, "hidden": (16, 8), "batch": 64, "dropout": 0.0})])
def test_models_find_the_signal(data, model):
    out = model.fit(data, ["a", "b", "c"], "y").predict(data).toPandas()
    assert np.corrcoef(out.prediction, out.y)[0, 1] > 0.8
    assert model.get_feature_importance(data.sparkSession).first()["feature"] == "a"


def test_folds_grow_in_time(data):
    f = ml.time_folds(data, 5).toPandas()
    for k, g in f.groupby("fold"):
        train, val = g[g.part == "train"], g[g.part == "val"]
        assert train["_i"].max() < val["_i"].min() and len(val) == 400 // 6
        assert train["_i"].min() == 0 and len(train) == 400 - (6 - k) * (400 // 6)


def test_cross_validation(data):
    cv = ml.Ridge(cv_splits=3).cross_validate(data, ["a", "b", "c"], "y").toPandas()
    assert len(cv) == 3 and (cv.val_ic > 0.8).all()
    with pytest.raises(RuntimeError):
        ml.Ridge().predict(data)


def test_folds_from_sums(spark, data):
    """Coefficients of every fold, ridge and lasso, are those of a fit on the fold's rows; one row a stretch and pair comes to the driver."""
    from factorlake.operators import gram as G

    p = data.toPandas().sort_values(["date", "symbol"])
    x, y, n = p[["a", "b", "c"]].to_numpy(), p["y"].to_numpy(), len(p)
    size = n // 6
    for model in (ml.Ridge({"alpha": 2.0}), ml.Lasso({"alpha": 0.1})):
        got = {(r.fold, r.feature): r.coefficient for r in model.fold_coefficients(data, ["a", "b", "c"], "y").collect()}
        assert len(got) == 5 * 4
        for k in range(1, 6):
            own = slice(0, n - 5 * size + (k - 1) * size)
            whole = np.column_stack([np.ones(own.stop), x[own], y[own]])
            w, b = model.solve(G.Gram(["a", "b", "c"], "y", whole.T @ whole))
            np.testing.assert_allclose([got[k, f] for f in "abc"] + [got[k, ""]], [*w, b], rtol=1e-8, atol=1e-10)
    ridge = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 2.0 * np.eye(3), (x - x.mean(0)).T @ (y - y.mean()))
    whole = np.column_stack([np.ones(n), x, y])
    np.testing.assert_allclose(G.Gram(["a", "b", "c"], "y", whole.T @ whole).ridge(2.0)[0], ridge, rtol=1e-9)
    cv = ml.Ridge({"alpha": 1.0}).cross_validate(data, ["a", "b", "c"], "y").toPandas().sort_values("fold")
    assert cv.fold.tolist() == [1, 2, 3, 4, 5] and (cv[["train_ic", "val_ic"]] > 0.95).all().all()


def test_best_split_is_the_best_of_all():
    from factorlake.operators import boost as B

    r = np.random.default_rng(3)
    bins, g = r.integers(0, 6, (200, 3)), r.normal(size=200)
    n, s = np.zeros((3, 6)), np.zeros((3, 6))
    for f in range(3):
        n[f], s[f] = np.bincount(bins[:, f], minlength=6), np.bincount(bins[:, f], g, minlength=6)
    plain = {}
    for f in range(3):
        for b in range(5):
            on = bins[:, f] <= b
            if min(on.sum(), (~on).sum()) >= 20:
                plain[f, b] = (g[on].sum() ** 2 / (on.sum() + 1) + g[~on].sum() ** 2 / ((~on).sum() + 1) - g.sum() ** 2 / 201) / 2 - 0.1
    gain, f, b = B.best_split(n, s, 1.0, 20, 0.1)
    assert (f, b) == max(plain, key=plain.get) and gain == pytest.approx(plain[f, b])


def test_leafwise_trees(spark):
    """Better than a constant and than stumps on a target with an interaction; the same tree as plain numpy grows."""
    from factorlake.operators import boost as B

    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 3))
    y = np.where(x[:, 0] > 0, x[:, 1], -x[:, 1]) + 0.05 * r.normal(size=1500)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double").repartition(3)
    error = lambda m: m.predict(df).selectExpr("avg(pow(prediction - y, 2))").first()[0]
    trees = ml.LeafwiseTrees({"num_rounds": 12, "learning_rate": 0.4, "num_leaves": 8, "max_bin": 32}).fit(df, ["a", "b", "c"], "y")
    stumps = ml.LeafwiseTrees({"num_rounds": 12, "learning_rate": 0.4, "num_leaves": 2, "max_bin": 32}).fit(df, ["a", "b", "c"], "y")
    assert error(trees) < 0.35 * y.var() and error(trees) < 0.6 * error(stumps) <= 0.6 * y.var() * 1.01
    top = [r_.feature for r_ in trees.get_feature_importance(spark).collect()]
    assert set(top[:2]) == {"a", "b"} and len(trees.model.trees) == 12 and max(len(t.feature) for t in trees.model.trees) <= 15

    # one tree, grown here from the same bins
    model = B.fit(df, ["a", "b", "c"], "y", 1, 1.0, 6, 16)
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(model.edges)], axis=1)
    g, tree, nodes = y.mean() - y, B.Tree(), {0: np.arange(len(x))}

    def split_of(rows):
        n, s = (np.stack([np.bincount(bins[rows, f], w, minlength=16) for f in range(3)]) for w in (None, g[rows]))
        return B.best_split(n.astype(float), s, 1.0, 20, 0.0)

    while len(nodes) < 6:
        node = max(nodes, key=lambda k: split_of(nodes[k])[0])
        _, f, b = split_of(nodes[node])
        rows = nodes.pop(node)
        left, right = tree.split(node, f, b)
        nodes |= {left: rows[bins[rows, f] <= b], right: rows[bins[rows, f] > b]}
    for node, rows in nodes.items():
        tree.value[node] = -g[rows].sum() / (len(rows) + 1)
    np.testing.assert_allclose(model.trees[0].predict(bins), tree.predict(bins), rtol=1e-9)


def test_leafwise_trees_on_odd_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0)] * 30 + [(None, 1.0, 1.0), (1.0, 2.0, None)], "a double, b double, y double")
    m = ml.LeafwiseTrees({"num_rounds": 3}).fit(df, ["a", "b"], "y")
    assert m.predict(df).where("abs(prediction - 1) < 1e-9").count() == 31


def test_gradients_of_the_network():
    """Against differences, through batch normalisation and the rectifier."""
    from factorlake.operators.network import Net

    r = np.random.default_rng(2)
    net, x, y = Net([3, 5, 4, 1], 0.0, 1), r.normal(size=(20, 3)), r.normal(size=20)
    for k in net.learned:
        net.p[k] = net.p[k] + 0.1 * r.normal(size=net.p[k].shape)
    _, grads, moments = net.gradients(x, y)
    assert set(grads) == set(net.learned) and set(moments) == {"m0", "v0", "m1", "v1"}
    for k in net.learned:
        for at in np.ndindex(net.p[k].shape):
            old, e = net.p[k][at], 1e-6
            net.p[k][at] = old + e
            up = net.gradients(x, y)[0]
            net.p[k][at] = old - e
            down = net.gradients(x, y)[0]
            net.p[k][at] = old
            assert grads[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-6), (k, at)
    flat = net.flat()
    assert np.array_equal(Net([3, 5, 4, 1]).load(flat).flat(), flat)


def test_all_rows_train_the_network(spark, data):
    """A round over several tasks is the average of what each task gives, by its rows; held-out rows only judge."""
    from factorlake.operators import network as N

    r = np.random.default_rng(4)
    x, y = r.normal(size=(90, 2)), r.normal(size=90)
    rows = spark.createDataFrame([(list(map(float, a)), float(b), i >= 70) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y double, held boolean").repartition(3).cache()
    net = N.Net([2, 4, 1], 0.0, 7)
    weights, error = N.one_round(rows, net, 0.01, 16, 5)
    assert error == pytest.approx(np.mean((net.predict(x[70:]) - y[70:]) ** 2))
    parts = [spark.createDataFrame([z for z in p if not z.held], rows.schema).coalesce(1) for p in rows.rdd.glom().collect()]
    each = [(N.one_round(p, net, 0.01, 16, 5)[0], p.count()) for p in parts]
    np.testing.assert_allclose(weights, sum(w * n for w, n in each) / sum(n for _, n in each), rtol=1e-9)
    model = ml.Network({"epochs": 8, "rate": 0.01, "hidden": (8,), "batch": 32, "dropout": 0.1, "rows": 150}).fit(data, ["a", "b", "c"], "y")
    assert len(model.model.errors) >= 5 and model.model.errors[-1] < model.model.errors[0]
    with pytest.raises(ValueError):
        ml.Network().fit(data.where("false"), ["a"], "y")
