"""Training by distributed passes: the history of a plain loop over all rows, however many tasks."""

import numpy as np
import pytest

from brinelink.models import network


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    return x, 0.5 * x[:, 0] - np.abs(x[:, 1]) + rng.normal(size=3000) * 0.1, np.arange(3000) % 5 == 0


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, val = data
    made = [(float(a), float(b), float(c), "val" if v else "train") for (a, b), c, v in zip(x, y, val)]
    return spark.createDataFrame(made, "a double, b double, y double, partition string").repartition(5).persist()


def plain(data, epochs, rate):
    """Full-batch Adam written out."""
    x, y, val = data
    net = network.new_network(2)
    w, m, v = net.flat(), 0, 0
    history = []
    for step in range(1, epochs + 1):
        loss, g = net.with_flat(w).loss_gradient(x[~val], y[~val])
        n = (~val).sum()
        m, v = 0.9 * m + 0.1 * g / n, 0.999 * v + 0.001 * (g / n) ** 2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        error = net.with_flat(w).forward(x[val]) - y[val]
        history.append((loss / n, error @ error / val.sum()))
    return history


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_history_is_that_of_a_plain_loop(rows, data, tasks, monkeypatch):
    monkeypatch.setattr(network, "FLAT_SUMS", 3)  # eight tasks are added up in a tree
    net = network.train_network(rows, ["a", "b"], "y", max_epochs=25, learning_rate=0.01, tasks=tasks)
    np.testing.assert_allclose(net.history, plain(data, 25, 0.01), rtol=1e-9)


def test_needs_both_sides(rows):
    with pytest.raises(ValueError):
        network.train_network(rows.where("partition = 'train'"), ["a", "b"], "y", tasks=2)


def test_layers_are_computed_for_a_slice_of_rows_at_a_time(data, monkeypatch):
    x, y, _ = data
    net = network.new_network(2)
    whole = net._slice_gradient(x, y)
    sizes, forward, part = [], network.Network.forward, network.Network._slice_gradient
    monkeypatch.setattr(network.Network, "forward", lambda self, x: (sizes.append(len(x)), forward(self, x))[1])
    monkeypatch.setattr(network.Network, "_slice_gradient", lambda self, x, y: (sizes.append(len(x)), part(self, x, y))[1])
    loss, gradient = net.loss_gradient(x, y)
    assert loss == pytest.approx(whole[0], rel=1e-12)
    np.testing.assert_allclose(gradient, whole[1], rtol=1e-9, atol=1e-9)
    error = forward(net, x) - y
    assert net.squared_error(x, y) == pytest.approx(error @ error, rel=1e-12)
    assert len(sizes) == 6 and max(sizes) == network.SLICE
