import json

from cellweave import cli

NET = {"Name": "n", "Layers": [{"Kind": "Input", "N": "auto", "DataSet": "in"}, {"Name": "Hidden", "Kind": "Hidden", "N": 2}, {"Kind": "Output", "N": "auto", "DataSet": "out"}]}


def test_generate_train_predict(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "in.txt").write_text("u1\ta:b\nu2\tb:c\nu3\ta:c\n")
    (tmp_path / "net.json").write_text(json.dumps(NET))
    cli.main(["generate", "-d", "in", "-i", at("in.txt"), "-o", at("in"), "-f", at("f"), "-s", at("s"), "-c"], spark)
    errors = cli.main(["train", "-c", at("net.json"), "-i", at("in"), "-o", at("in"), "-n", at("m"), "-e", "1"], spark)
    assert len(errors) == 1 and errors[0] > 0
    cli.main(["predict", "-c", at("net.json"), "-n", at("m"), "-r", at("in.txt"), "-d", at("f"), "-l", at("f"), "-o", at("recs"), "-k", "100"], spark)
    lines = [r["value"] for r in spark.read.text(at("recs")).collect()]
    # the width is padded, so places past the labels take ranks and a sample gets at most its labels
    assert {x.split("\t")[0] for x in lines} <= {"u1", "u2", "u3"}
    assert all(0 < x.count(":") <= 3 for x in lines)


def test_merge_and_search(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "a.txt").write_text("u1\ta,1\n")
    (tmp_path / "b.txt").write_text("u2\tb,2:a,3\n")
    cli.main(["generate", "-d", "x", "-i", at("a.txt"), "-o", at("d1"), "-f", at("f"), "-s", at("s"), "-t", "analog"], spark)
    cli.main(["generate", "-d", "x", "-i", at("b.txt"), "-o", at("d2"), "-f", at("f"), "-s", at("s"), "-m", "-t", "analog"], spark)
    assert sorted(tuple(r) for r in spark.read.parquet(at("d2") + "/cells").select("sample", "feature", "value").collect()) == [(1, 0, 3.0), (1, 1, 2.0)]
    (tmp_path / "v.txt").write_text("p\t1 0\nq\t0 1\nr\t1 1\n")
    cli.main(["knn-search", "-i", at("v.txt"), "-q", at("v.txt"), "-o", at("n"), "-k", "1", "--normalise"], spark)
    assert sorted(r["value"] for r in spark.read.text(at("n")).collect()) == ["p\tp:1.000", "q\tq:1.000", "r\tr:1.000"]


def test_commands_train_validate_predict(spark, tmp_path):
    from cellweave.plans.commands import run_command
    from cellweave.sources import dataset

    at = lambda n: str(tmp_path / n)
    layers = [{"Kind": "Input", "N": 128}, {"Name": "H", "Kind": "Hidden", "N": 2, "Activation": "Tanh"}, {"Kind": "Output", "N": 128}]
    (tmp_path / "net.json").write_text(json.dumps({"Layers": layers}))
    cells = dataset.from_csr(spark, [0, 2], [2, 3], [0, 1, 2])
    for name in ("input", "output"):
        dataset.save(dataset.sparse(spark, name, cells, 3), at(f"data/{name}"))
    base = {"Network": at("net.json"), "Data": at("data")}
    errors = run_command(spark, json.dumps({**base, "Command": "Train", "Results": at("m"), "TrainingParameters": {"Epochs": 1, "Alpha": 0.1}}))
    assert len(errors) == 1
    assert run_command(spark, json.dumps({**base, "Command": "Validate"})) == []
    found = run_command(spark, json.dumps({**base, "Command": "Predict", "TrainingParameters": {"Checkpoint": {"Name": at("m")}}}), k=2).collect()
    assert sorted((r["sample"], r["rank"]) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_images(spark, tmp_path):
    from cellweave.sources import images

    (tmp_path / "a.bin").write_bytes(bytes([3, 0, 255, 7, 9, 1, 2, 4]))
    got = images.read_images(spark, str(tmp_path / "a.bin"), size=3)
    assert sorted((r["sample"], r["feature"], r["value"]) for r in images.pixel_cells(got, 3).collect()) == [(0, 0, 0.0), (0, 1, 255.0), (0, 2, 7.0), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 4.0)]
    assert sorted((r["sample"], r["feature"]) for r in images.label_cells(got).collect()) == [(0, 3), (1, 9)]


def test_labels_are_numbered_by_first_appearance(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "a.txt").write_text("zeta\tq,1:b,2\nalpha\ta,1:q,3\nmid\tb,1:c,1\n")
    cli.main(["generate", "-d", "x", "-i", at("a.txt"), "-o", at("d"), "-f", at("f"), "-s", at("s"), "-t", "analog"], spark)
    index = lambda n: [r["label"] for r in cli.text.load_index(spark, at(n)).orderBy("idx").collect()]
    assert index("s") == ["zeta", "alpha", "mid"] and index("f") == ["q", "b", "a", "c"]
