"""Networks: gradients against finite differences, partitionings, learning, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credalyt.operators import deep, ml
from credalyt.sources.folders import work_folder

SMALL = {"deepfm": {"factors": 3, "hidden": (5, 4)}, "attention": {"decision": 3, "attend": 2, "steps": 2, "sparsity": 0.1}}


@pytest.mark.parametrize("name", ["deepfm", "attention"])
def test_gradients(name):
    rng = np.random.default_rng(3)
    s = {**deep.SETTINGS[name], **SMALL[name]}
    w = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in deep.MODELS[name][0](4, s).items()}
    x, y, weight = rng.normal(size=(12, 4)), rng.integers(0, 2, 12).astype(float), rng.uniform(0.5, 2, 12)
    _, g = deep.loss_and_gradient(name, s, w, x, y, weight)
    for k in w:
        for at in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            slope = (deep.loss_and_gradient(name, s, up, x, y, weight)[0] - deep.loss_and_gradient(name, s, down, x, y, weight)[0]) / 2e-6
            assert g[k][at] == pytest.approx(slope, abs=1e-5, rel=1e-4), (k, at)


def test_sparsemax_is_the_projection():
    t = deep.Tape()
    p = t[t.sparsemax(t.put(np.array([[2.0, 0.0, 0.0], [0.1, 0.2, 0.3], [1.0, 1.0, -5.0]])))]
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p, [[1, 0, 0], [0.1 + 0.4 / 3, 0.2 + 0.4 / 3, 0.3 + 0.4 / 3], [0.5, 0.5, 0]])


@pytest.fixture(scope="module")
def pairs(spark):
    """Labels that only the product of two components tells."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 5))
    rows = [(i, v.tolist(), int(v[0] * v[1] > 0)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [1.0], 0), (902, [None] * 5, 1), (903, [0.0] * 5, None)]
    return spark.createDataFrame(rows + odd, "id long, x array<double>, label int").repartition(3)


@pytest.mark.parametrize("name", ["deepfm", "tabnet"])
def test_weights_do_not_depend_on_partitions(pairs, name):
    settings = {**SMALL[deep.ALIASES.get(name, name)], "epochs": 3, "batch": 200}
    one, four = (deep.train(pairs.repartition(p), name, "x", tasks=p, **settings) for p in (1, 4))
    assert one.losses == pytest.approx(four.losses)
    assert all(np.allclose(one.weights[k], four.weights[k], atol=1e-8) for k in one.weights)
    assert one.losses[-1] < one.losses[0]


def test_deepfm_learns_pairs_and_stops(spark, pairs):
    rows = pairs.withColumn("held", F.col("id") % 5 == 0)
    net = deep.train(rows, "deepfm", "x", validation="held", epochs=60, rate=0.01, batch=100, patience=4)
    out = net.predict(pairs.where("id < 800 and id % 5 = 0"), "x")
    assert out.where("pred = label").count() > 0.9 * out.count()
    assert len(net.losses) < 60  # stopped
    path = work_folder(spark, "net")
    net.save(spark, path)
    again = deep.Network.load(spark, path)
    assert again.settings == net.settings and all((again.weights[k] == net.weights[k]).all() for k in net.weights)
    assert again.predict(pairs, "x").count() == 801  # rows without whole features get no score


def test_attention_finds_the_components(pairs):
    net = ml.train(pairs.where("id < 800").withColumn("label", (F.col("x")[2] > 0).cast("int")), "tabnet", "x", epochs=25, batch=100)
    shares = {r.feature: r.importance for r in net.importances(pairs, "x").collect()}
    assert sum(shares.values()) == pytest.approx(1) and max(shares, key=shares.get) == 2
    out = ml.predict(net, pairs.where("id < 800"), "x")
    assert out.columns == [*pairs.columns, "score", "pred"]
    assert out.where("pred = cast(x[2] > 0 as int)").count() > 720
    with pytest.raises(ValueError, match="no rows"):
        deep.train(pairs.where("false"), "deepfm", "x")
