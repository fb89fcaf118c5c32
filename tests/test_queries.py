import os
import shutil
import subprocess
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest

from peerloom.functions.rng import SplitMix64
from peerloom.plans import nn
from peerloom.plans.catalogue import QUERIES, SQL

from compare import assert_same
from test_engine import plain_run

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, FOLDER, QUERIES[name], SQL[name])


def shards(folder):
    """Images and labels of five nodes, as both queries deal them."""
    t = pq.read_table(f"{folder}/embeddings.parquet").sort_by("vec_id").to_pydict()
    rows = list(zip(t["vec_id"], t["embedding"], t["label"]))
    return {n: (np.array([x for i, x, _ in rows if i % 5 == n], np.float32), np.array([y for i, _, y in rows if i % 5 == n])) for n in range(5)}


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(SQL) == {"local_training", "federated_rounds"}


def test_local_training_equals_numpy(spark):
    model = nn.SoftmaxRegression(64, 10)
    got = {r["node_id"]: r for r in QUERIES["local_training"](spark, FOLDER).collect()}
    for n, (x, y) in shards(FOLDER).items():
        w, b = (p.astype(np.float64) for p in model.start(42))
        order, speed, losses = SplitMix64(42).permutation(len(x)), [0.0, 0.0], []
        for a in range(0, len(x) // 32 * 32, 32):
            xs, ys = x[order[a : a + 32]], y[order[a : a + 32]]
            z = xs @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            losses.append(-np.log(p[np.arange(32), ys] + 1e-9).mean())
            p[np.arange(32), ys] -= 1
            for k, g in enumerate((xs.T @ p / 32, p.sum(axis=0) / 32)):
                speed[k] = 0.9 * speed[k] - 0.1 * g
            w, b = w + speed[0], b + speed[1]
        full = len(x) // 32 * 32
        right = ((x[:full] @ w + b).argmax(axis=1) == y[:full]).mean()
        assert got[n]["n_samples"] == len(x) and got[n]["train_loss"] == pytest.approx(np.mean(losses), abs=2e-4)
        assert got[n]["train_acc"] == pytest.approx(right, abs=0.02)


def test_federated_rounds_equal_numpy(spark):
    links = [(a, b) for a in range(5) for b in range(5) if a != b]
    want, _ = plain_run(shards(FOLDER), links, 3, 0.1, 42, "fp16", dims=(64, 10))
    rows = QUERIES["federated_rounds"](spark, FOLDER).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["values"] == pytest.approx(want[r["node_id"]][r["tensor_id"]].reshape(-1).tolist(), abs=2e-5)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 640
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_operators(tmp_path):
    """With the operators deleted the rest is there; an error inside them is not hidden."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    say = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"]
    shutil.copytree(os.path.join(root, "peerloom"), tmp_path / "peerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run(say, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr
    (tmp_path / "peerloom" / "llm").mkdir()
    (tmp_path / "peerloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("from peerloom.llm import no_such_name\n")
    out = subprocess.run(say, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode and "no_such_name" in out.stderr
