import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.plans import network as nn
from cellweave.functions.optimizers import Brake
from cellweave.streaming.batches import serve_neighbors
from cellweave.operators.knn import nearest

SMALL = {
    "Name": "small", "ErrorFunction": "L2",
    "Layers": [
        {"Name": "Input", "Kind": "Input", "N": 2, "DataSet": "in"},
        {"Name": "Hidden", "Kind": "Hidden", "N": 3, "Activation": "Tanh", "WeightInit": {"Scheme": "Uniform", "Scale": 0.5}},
        {"Name": "Output", "Kind": "Output", "N": 2, "DataSet": "out", "Activation": "Sigmoid", "WeightInit": {"Scheme": "Uniform", "Scale": 0.5}},
    ],
}


def spec(**change):
    return nn.parse_network(json.dumps({**SMALL, **change}))


def data(spark):
    cells = spark.createDataFrame([(s, f, float(s + f) / 4) for s in range(4) for f in range(2)], "sample bigint, feature bigint, value double")
    targets = spark.createDataFrame([(s, s % 2, 1.0) for s in range(4)], "sample bigint, feature bigint, value double")
    return cells, targets


def test_language_rules():
    s = spec()
    assert s.layer("Hidden").sources == ("Input",) and s.layer("Hidden").activation == "tanh" and s.loss == "l2"
    with pytest.raises(nn.SpecError, match="field"):
        nn.parse_network(json.dumps({"Layers": [{"Kind": "Input", "N": 1, "Colour": 1}]}))
    with pytest.raises(nn.SpecError, match="two sources"):
        nn.parse_network(json.dumps({"Layers": [{"Kind": "Input", "N": 2}, {"Kind": "Output", "Pooling": "Cosine", "Type": "Pooling"}]}))
    with pytest.raises(nn.SpecError, match="unknown source"):
        nn.parse_network(json.dumps({"Layers": [{"Kind": "Input", "N": 2}, {"Kind": "Output", "N": 1, "Source": "Lost"}]}))
    with pytest.raises(nn.SpecError, match="itself"):
        nn.parse_network(json.dumps({"Layers": [{"Kind": "Input", "N": 2}, {"Name": "A", "Kind": "Hidden", "N": 1, "Source": "A"}, {"Kind": "Output", "N": 1}]}))


def test_commands():
    c = nn.parse_command(json.dumps({"Command": "Train", "Network": "n", "Data": "d", "TrainingParameters": {"Optimizer": "Nesterov", "Epochs": 3}}))
    assert (c.mode, c.optimizer, c.epochs) == ("train", "nesterov", 3)
    for bad in ({"Command": "Jump", "Network": "n", "Data": "d"}, {"Command": "Train", "Network": "n", "Data": "d", "TrainingParameters": {"Optimizer": "adam"}}, {"Command": "Train", "Network": "n", "Data": "d", "TrainingParameters": {"MiniBatch": 3}}, {"Command": "Predict", "Network": "n", "Data": "d", "PredictionParameters": {}}):
        with pytest.raises(nn.SpecError):
            nn.parse_command(json.dumps(bad))


def test_gradient_against_differences(spark):
    """One-sided differences of the loss, step 0.001, within 20 steps."""
    cells, targets = data(spark)
    net = nn.Network(spark, spec(), {})
    edges, biases, base = net.gradients(cells, targets)
    for edge, place in ((("Hidden", "Output"), (1, 0)), (("Input", "Hidden"), (0, 2))):
        g = {(r["src"], r["dst"]): r["g"] for r in edges[edge].collect()}[place]
        kept = net.weights[edge]
        net.weights[edge] = kept.withColumn("w", F.when((F.col("src") == place[0]) & (F.col("dst") == place[1]), F.col("w") + 0.001).otherwise(F.col("w")))
        assert abs((net.error(cells, targets) - base) / 0.001 + g) < 0.02
        net.weights[edge] = kept
    g = {r["dst"]: r["g"] for r in biases["Output"].collect()}[1]
    kept = net.biases["Output"]
    net.biases["Output"] = kept.withColumn("w", F.when(F.col("dst") == 1, F.col("w") + 0.001).otherwise(F.col("w")))
    assert abs((net.error(cells, targets) - base) / 0.001 - g) < 0.02
    net.biases["Output"] = kept


def test_training_lowers_the_error_and_round_trips(spark, tmp_path):
    cells, targets = data(spark)
    net = nn.Network(spark, spec(), {})
    before = net.error(cells, targets)
    net.train(cells, targets, epochs=2, optimizer="momentum", alpha=0.5)
    after = net.error(cells, targets)
    assert after < before
    net.save(str(tmp_path / "m"))
    again = nn.Network(spark, spec(), {}, seed=1).load(str(tmp_path / "m"))
    assert abs(again.error(cells, targets) - after) < 1e-12
    top = again.predict(cells, 1).collect()
    assert len(top) == 4 and all(r["rank"] == 1 for r in top)
    with pytest.raises(ValueError):
        again.predict(cells, 3)


def test_brake():
    b = Brake(warm=3, steps=2)
    assert [b.factor(e) for e in (1, 1, 1, 9, 1, 1)] == [1, 1, 1, 0, 0.1, 1]


def test_streamed_neighbours_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    vecs = spark.createDataFrame(rows, "key bigint, vec array<double>")
    for part in range(3):
        vecs.where(f"key % 3 = {part}").coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema("key bigint, vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p=*"))
    q = serve_neighbors(stream, vecs, 3, str(tmp_path / "out"), str(tmp_path / "ck"), timeout=None)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("query", "rank", "key", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, nearest(vecs, vecs, 3).select("query", "rank", "key", "score").collect()))


def test_validate_checks_every_weight_and_bias(spark, monkeypatch):
    from cellweave.plans import commands

    cells, targets = data(spark)
    net = nn.Network(spark, spec(), {})
    assert commands.validate(net, cells, targets, block=4) == []
    right = net.gradients

    def off(*a, **k):  # a gradient wrongly zero, and a wrong bias
        edges, biases, error = right(*a, **k)
        edges["Hidden", "Output"] = edges["Hidden", "Output"].withColumn("g", F.when((F.col("src") == 1) & (F.col("dst") == 0), 0.5).otherwise(F.col("g")))
        biases["Hidden"] = biases["Hidden"].withColumn("g", F.when(F.col("dst") == 2, F.col("g") + 0.1).otherwise(F.col("g")))
        return edges, biases, error

    monkeypatch.setattr(net, "gradients", off)
    assert {(n, s, d) for n, s, d, _ in commands.validate(net, cells, targets)} == {("Hidden-Output", 1, 0), ("Hidden", None, 2)}


def test_epochs_differ_and_share_one_brake(spark):
    """Each epoch deals its own batches, and the batches of all epochs are counted on."""
    cells, targets = data(spark)
    net, seen, whole = nn.Network(spark, spec(), {}), [], cells.count()

    def batch(part, goal, optimizer, step, mu, l2, l1, epoch):
        seen.append((epoch, sorted({r["sample"] for r in part.select("sample").collect()})))
        net.batches += 1
        return 1.0

    net.train_batch = batch
    errors = net.train(cells, targets, epochs=4, batch=2, alpha=0.5, alpha_interval=2, alpha_multiplier=0.1)
    assert len(errors) == 4 and net.batches == len(seen) and whole == 8
    for e in range(4):
        assert sorted(s for x, part in seen if x == e for s in part) == [0, 1, 2, 3]
    assert len({tuple(map(tuple, (p for x, p in seen if x == e))) for e in range(4)}) > 1


def test_what_a_network_does_not_run_is_an_error(spark):
    for extra in ({"Pooling": "Max"}, {"Type": "Pooling"}):
        layers = [SMALL["Layers"][0], {**SMALL["Layers"][1], **extra}, SMALL["Layers"][2]]
        with pytest.raises(nn.SpecError, match="Hidden"):
            nn.Network(spark, spec(Layers=layers), {})


def test_whole_layer_and_elu_dropout(spark):
    cells, targets = data(spark)
    net = nn.Network(spark, spec(), {})
    assert sorted((r["sample"], r["rank"]) for r in net.predict(cells, 0).collect()) == [(s, r) for s in range(4) for r in (1, 2)]
    layers = [SMALL["Layers"][0], {**SMALL["Layers"][1], "Activation": "ELU", "pDropout": 0.5}, SMALL["Layers"][2]]
    net = nn.Network(spark, spec(Layers=layers), {})
    a = {r["a"] for r in net.forward(cells, train=True)["Hidden"].collect()}
    low = -1.0
    scale = 1 / (0.5 + low * low * 0.25) ** 0.5
    assert any(abs(x - (scale * low - scale * 0.5 * low)) < 1e-9 for x in a)  # a dropped unit sits at the saturation value
