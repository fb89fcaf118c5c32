"""The network in numpy, for grouped-map functions, and training and evaluation of all nodes at once.

Three blocks of 3 by 3 convolution, relu and 2 by 2 pooling, a dense layer and
softmax. One node's epoch runs in one task; nodes run side by side.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TrainerError
from ..functions.rng import SplitMix64
from ..sources.telemetry import usage

CHANNELS, CLASSES, SIDE = (3, 16, 32, 64), 10, 32


def init(seed: int = 42, channels=CHANNELS, classes: int = CLASSES, side: int = SIDE) -> list:
    """He-initialised tensors in wire order: three (weights, bias) pairs and the dense pair; biases are zero."""
    import math

    import numpy as np

    rng = SplitMix64(seed)
    unit = lambda: (rng.next() >> 11) * 2.0**-53

    def normals(n, fan_in):
        out = []
        while len(out) < n:
            while (u := unit()) == 0.0:
                pass
            r, a = math.sqrt(-2 * math.log(u)), 2 * math.pi * unit()
            out += [r * math.cos(a), r * math.sin(a)]
        return (np.array(out[:n], dtype=np.float32) * np.float32(math.sqrt(2 / fan_in))).astype(np.float32)

    params = []
    for a, b in zip(channels, channels[1:]):
        params += [normals(b * a * 9, a * 9).reshape(b, a * 9), np.zeros(b, np.float32)]
        side = (side - 2) // 2
    flat = channels[-1] * side * side
    return [*params, normals(classes * flat, flat).reshape(classes, flat).T.copy(), np.zeros(classes, np.float32)]


def conv_forward(x, w, b):
    import numpy as np

    win = np.lib.stride_tricks.sliding_window_view(x, (3, 3), axis=(2, 3))
    n, c, h, v = win.shape[:4]
    cols = win.transpose(0, 2, 3, 1, 4, 5).reshape(n * h * v, c * 9)
    return (cols @ w.T + b).reshape(n, h, v, -1).transpose(0, 3, 1, 2), cols


def conv_backward(d, cols, w, shape):
    import numpy as np

    n, o, h, v = d.shape
    flat = d.transpose(0, 2, 3, 1).reshape(-1, o)
    back = (flat @ w).reshape(n, h, v, shape[1], 3, 3)
    dx = np.zeros(shape, dtype=d.dtype)
    for i in range(3):
        for j in range(3):
            dx[:, :, i : i + h, j : j + v] += back[..., i, j].transpose(0, 3, 1, 2)
    return flat.T @ cols, flat.sum(axis=0), dx


def pool_forward(x):
    """Maxima of full 2 by 2 windows, and each element's share of the gradient (ties share it)."""
    n, c, h, w = x.shape
    win = x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2)
    top = win.max(axis=(3, 5), keepdims=True)
    hit = (win == top).astype(x.dtype)
    return top[:, :, :, 0, :, 0], hit / hit.sum(axis=(3, 5), keepdims=True)


def pool_backward(d, share, shape):
    import numpy as np

    dx = np.zeros(shape, dtype=d.dtype)
    n, c, h, w = d.shape
    dx[:, :, : 2 * h, : 2 * w] = (d[:, :, :, None, :, None] * share).reshape(n, c, 2 * h, 2 * w)
    return dx


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(params, x):
    cache = []
    for k in range(0, len(params) - 2, 2):
        y, cols = conv_forward(x, params[k], params[k + 1])
        r = y * (y > 0)
        p, share = pool_forward(r)
        cache.append((x.shape, cols, y, share, r.shape))
        x = p
    flat = x.reshape(len(x), -1)
    return softmax(flat @ params[-2] + params[-1]), (cache, flat, x.shape)


def backward(params, probs, labels, state):
    import numpy as np

    cache, flat, shape = state
    d = probs.copy()
    d[np.arange(len(labels)), labels] -= 1
    d /= len(labels)
    grads = [flat.T @ d, d.sum(axis=0)]
    d = (d @ params[-2].T).reshape(shape)
    for k in range(len(params) - 4, -1, -2):
        x_shape, cols, y, share, r_shape = cache[k // 2]
        d = pool_backward(d, share, r_shape) * (y > 0)
        dw, db, d = conv_backward(d, cols, params[k], x_shape)
        grads = [dw, db, *grads]
    return grads


def loss_of(probs, labels) -> float:
    import numpy as np

    return float(-np.log(probs[np.arange(len(labels)), labels] + 1e-9).mean())


def epoch(params, images, labels, seed: int, rate: float = 0.01, batch: int = 32, momentum: float = 0.9, accuracy: bool = True):
    """(new tensors, metrics) after one pass in a seeded order; the last partial batch is left out."""
    import numpy as np

    if len(images) < batch:
        raise TrainerError(f"{len(images)} samples, but a batch takes {batch}")
    params = [p.copy() for p in params]
    speed = [np.zeros_like(p) for p in params]
    t = {"shuf_s": 0.0, "fwd_s": 0.0, "bwd_s": 0.0, "opt_s": 0.0}
    mark = time.perf_counter()

    def lap(name):
        nonlocal mark
        now = time.perf_counter()
        t[name] += now - mark
        mark = now

    order = np.array(SplitMix64(seed).permutation(len(images)))
    lap("shuf_s")
    losses = []
    for a in range(0, len(images) // batch * batch, batch):
        x, y = images[order[a : a + batch]], labels[order[a : a + batch]]
        probs, state = forward(params, x)
        losses.append(loss_of(probs, y))
        lap("fwd_s")
        grads = backward(params, probs, y, state)
        lap("bwd_s")
        for k, g in enumerate(grads):
            speed[k] = momentum * speed[k] - rate * g
            params[k] = (params[k] + speed[k]).astype(np.float32)
        lap("opt_s")
    if not np.isfinite(losses).all():
        raise TrainerError("the loss is not finite")
    out = {"train_loss": float(np.mean(losses)), "train_acc": None, "train_acc_s": 0.0, **t}
    if accuracy:
        mark = time.perf_counter()
        out["train_acc"] = evaluate(params, images, labels, batch)[1]
        out["train_acc_s"] = time.perf_counter() - mark
    return params, out


def evaluate(params, images, labels, batch: int = 32) -> tuple[float, float]:
    """(mean loss, accuracy) over full batches in file order."""
    import numpy as np

    losses, right, n = [], 0, len(images) // batch * batch
    for a in range(0, n, batch):
        probs, _ = forward(params, images[a : a + batch])
        losses.append(loss_of(probs, labels[a : a + batch]))
        right += int((probs.argmax(axis=1) == labels[a : a + batch]).sum())
    return (float(np.mean(losses)), right / n) if n else (float("nan"), float("nan"))


class Model(ABC):
    """What a node trains: implement these four to plug in another model. ``batch`` is the least shard, and ``features``
    the numbers of an image (None: any)."""

    batch, features = 1, None

    @abstractmethod
    def start(self, seed: int) -> list: ...

    @abstractmethod
    def shapes(self) -> list[tuple[int, ...]]: ...

    @abstractmethod
    def train(self, params: list, images, labels, seed: int, rate: float) -> tuple[list, dict]: ...

    @abstractmethod
    def evaluate(self, params: list, images, labels) -> tuple[float, float]: ...


class ConvNet(Model):
    def __init__(self, channels=CHANNELS, classes: int = CLASSES, side: int = SIDE, batch: int = 32):
        self.channels, self.classes, self.side, self.batch = channels, classes, side, batch
        self.features = channels[0] * side * side

    def start(self, seed):
        return init(seed, self.channels, self.classes, self.side)

    def shapes(self):
        return [p.shape for p in self.start(0)]

    def _x(self, images):
        import numpy as np

        return np.asarray(images, dtype=np.float32).reshape(-1, self.channels[0], self.side, self.side)

    def train(self, params, images, labels, seed, rate):
        return epoch(params, self._x(images), labels, seed, rate, self.batch)

    def evaluate(self, params, images, labels):
        return evaluate(params, self._x(images), labels, self.batch)


class SoftmaxRegression(Model):
    """One dense layer: the smallest model that a round can train."""

    def __init__(self, features: int, classes: int, batch: int = 32):
        self.features, self.classes, self.batch = features, classes, batch

    def start(self, seed):
        import numpy as np

        return [np.zeros((self.features, self.classes), np.float32), np.zeros(self.classes, np.float32)]

    def shapes(self):
        return [(self.features, self.classes), (self.classes,)]

    def train(self, params, images, labels, seed, rate):
        return epoch(params, self._x(images), labels, seed, rate, self.batch)

    def _x(self, images):
        import numpy as np

        return np.asarray(images, dtype=np.float32).reshape(len(images), self.features)

    def evaluate(self, params, images, labels):
        return evaluate(params, self._x(images), labels, self.batch)


def guard(samples: DataFrame, model: Model) -> dict:
    """Samples of each node; refuses shards smaller than a batch, images of another size and labels out of range."""
    size = F.size("image")
    found = samples.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.min("label").alias("first"), F.max("label").alias("last")
    ).collect()
    for r in found:
        if r["n"] < model.batch:
            raise TrainerError(f"node {r['node_id']} has {r['n']} samples, but a batch takes {model.batch}")
        if model.features is not None and (r["low"], r["high"]) != (model.features, model.features):
            raise TrainerError(f"node {r['node_id']} has images of {r['low']} to {r['high']} numbers, but the model takes {model.features}")
        if hasattr(model, "classes") and not 0 <= r["first"] <= r["last"] < model.classes:
            raise TrainerError(f"node {r['node_id']} has labels out of 0 to {model.classes - 1}")
    return {r["node_id"]: r["n"] for r in found}


PARAM_ROWS = "node_id long, tensor_id int, values array<float>"
METRICS = (
    "train_loss double, train_acc double, shuf_s double, fwd_s double, bwd_s double, opt_s double, train_acc_s double, n_samples int, "
    "train_s double, effective_cores double, peak_rss_mb double"
)


def pack(node: int, params: list):
    import pandas as pd

    return pd.DataFrame(
        {"node_id": node, "tensor_id": range(len(params)), "values": [p.reshape(-1).tolist() for p in params]}
    )


def unpack(pdf, shapes) -> list:
    import numpy as np

    rows = pdf.sort_values("tensor_id")
    if len(rows) != len(shapes):
        raise TrainerError(f"{len(rows)} tensors, but the model has {len(shapes)}")
    return [np.array(v, dtype=np.float32).reshape(s) for v, s in zip(rows["values"], shapes)]


def train_nodes(samples: DataFrame, params: DataFrame, model: Model, seed: int, rate: float) -> DataFrame:
    """node_id, tensor_id, values and the node's metrics after one local epoch; samples has node_id, sample_idx, image, label."""
    shapes = model.shapes()

    def step(key, data, own):
        import numpy as np

        data = data.sort_values("sample_idx")
        before, mark = usage(), time.perf_counter()
        new, m = model.train(unpack(own, shapes), np.stack(data["image"]), data["label"].to_numpy(), seed, rate)
        after, wall = usage(), time.perf_counter() - mark
        m |= {"train_s": wall, "effective_cores": (after["cpu_s"] - before["cpu_s"]) / wall if wall else 0.0, "peak_rss_mb": after["peak_rss_mb"]}
        return pack(key[0], new).assign(**m, n_samples=len(data)).astype({"train_acc": "float64"})

    return (
        samples.groupBy("node_id").cogroup(params.select("node_id", "tensor_id", "values").groupBy("node_id"))
        .applyInPandas(step, f"{PARAM_ROWS}, {METRICS}")
    )


def evaluate_nodes(samples: DataFrame, params: DataFrame, model: Model) -> DataFrame:
    """node_id, loss, accuracy, eval_s of each node's tensors on its rows of ``samples``."""
    shapes = model.shapes()

    def step(key, data, own):
        import numpy as np
        import pandas as pd

        if not len(data) or not len(own):
            return pd.DataFrame({"node_id": [key[0]], "loss": [None], "accuracy": [None], "eval_s": [0.0]}).astype({"loss": float, "accuracy": float})
        data, mark = data.sort_values("sample_idx"), time.perf_counter()
        loss, acc = model.evaluate(unpack(own, shapes), np.stack(data["image"]), data["label"].to_numpy())
        return pd.DataFrame({"node_id": [key[0]], "loss": [loss], "accuracy": [acc], "eval_s": [time.perf_counter() - mark]})

    return (
        samples.groupBy("node_id").cogroup(params.select("node_id", "tensor_id", "values").groupBy("node_id"))
        .applyInPandas(step, "node_id long, loss double, accuracy double, eval_s double")
    )


def synthetic(spark, n: int, seed: int = 42, features: int = 64, classes: int = 10) -> DataFrame:
    """sample_idx, image (uniform numbers), label: counter-based, so any row can be made alone."""
    from ..functions import rng

    base = F.col("id") * (features + 1)
    image = F.transform(
        F.sequence(F.lit(1), F.lit(features)), lambda i: rng.uniform(rng.output(F.lit(seed), base + i)).cast("float")
    )
    label = rng.unsigned_mod(rng.output(F.lit(seed), base + features + 1), classes)
    return spark.range(n).select(F.col("id").alias("sample_idx"), image.alias("image"), label.alias("label"))
