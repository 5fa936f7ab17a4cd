"""Neural classifiers for tables of numbers, trained synchronously by barrier tasks.

``deepfm``: linear terms, a factorization machine's pairwise terms and a multilayer head, joined by
a last layer.  ``attention``: steps that choose features by a sparse mask (sparsemax of scores times
what earlier steps have left), transform the chosen ones by gated layers, and add up decisions;
the entropy of the masks is part of the loss.

All tasks of one barrier stage hold their rows (in a file of the task, mapped to memory) and the
same weights.  A step takes the rows of one batch, wherever they are: which batch of an epoch a row
is in follows from its id.  Each task sums its gradients, the tasks exchange the sums, and each
makes the same Adam step with them.  So weights do not depend on the partitioning, but for the
order of sums, and no rows move after they are dealt.  A step moves the weights' size twice for
each task, over connections that the tasks open when the stage begins (the barrier itself answers
once a second, too slow for steps); rows of the validation part give a loss after each epoch, which may stop the training
and chooses the weights that are kept.  A lost task repeats the stage, from the same start.

Components are standardized with the training rows' mean and deviation (zero deviations count as
one); rows with a null, an array of another length or without label take no part in training and
get no score.  Weight decay stands for dropout, and standardized inputs for batch normalization.
"""

from __future__ import annotations

import secrets
import socket
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalyt.operators.matrix import _matrix, usable

# Settings of the compared models.
SETTINGS: dict[str, dict] = {
    "deepfm": {"factors": 10, "hidden": (64, 32), "rate": 0.001, "batch": 256, "epochs": 10, "patience": 5, "decay": 1e-4, "seed": 42},
    "attention": {"decision": 8, "attend": 8, "steps": 3, "gamma": 1.3, "sparsity": 0.001, "rate": 0.02, "batch": 1024, "epochs": 100, "patience": 10, "decay": 1e-4, "seed": 42},
}


class Tape:
    """Values of one pass and, backwards, the gradient of a sum with respect to each."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.back: list[Callable[[np.ndarray, list], None] | None] = []

    def put(self, value: np.ndarray, back: Callable[[np.ndarray, list], None] | None = None) -> int:
        self.values.append(value)
        self.back.append(back)
        return len(self.values) - 1

    def __getitem__(self, at: int) -> np.ndarray:
        return self.values[at]

    def gradients(self, of: int) -> list[np.ndarray]:
        g = [np.zeros_like(v) for v in self.values]
        g[of] = np.ones_like(self.values[of])
        for i in range(of, -1, -1):
            if self.back[i]:
                self.back[i](g[i], g)
        return g

    def matmul(self, a: int, b: int) -> int:
        def back(d, g):
            g[a] += d @ self[b].T
            g[b] += self[a].T @ d

        return self.put(self[a] @ self[b], back)

    def add(self, a: int, b: int) -> int:
        """b may be a row that is added to each of a."""

        def back(d, g):
            g[a] += d
            g[b] += d if self[b].shape == d.shape else d.sum(axis=0).reshape(self[b].shape)

        return self.put(self[a] + self[b], back)

    def times(self, a: int, b: int) -> int:
        def back(d, g):
            g[a] += d * self[b]
            g[b] += d * self[a]

        return self.put(self[a] * self[b], back)

    def affine(self, a: int, scale: float, shift: float = 0.0) -> int:
        return self.put(scale * self[a] + shift, lambda d, g: g.__setitem__(a, g[a] + scale * d))

    def relu(self, a: int) -> int:
        return self.put(np.maximum(self[a], 0), lambda d, g: g.__setitem__(a, g[a] + d * (self[a] > 0)))

    def sigmoid(self, a: int) -> int:
        s = 1 / (1 + np.exp(-np.clip(self[a], -500, 500)))
        return self.put(s, lambda d, g: g.__setitem__(a, g[a] + d * s * (1 - s)))

    def row_sums(self, a: int) -> int:
        return self.put(self[a].sum(axis=1, keepdims=True), lambda d, g: g.__setitem__(a, g[a] + np.broadcast_to(d, self[a].shape)))

    def columns(self, a: int, start: int, stop: int) -> int:
        def back(d, g):
            g[a][:, start:stop] += d

        return self.put(self[a][:, start:stop], back)

    def beside(self, a: int, b: int) -> int:
        n = self[a].shape[1]

        def back(d, g):
            g[a] += d[:, :n]
            g[b] += d[:, n:]

        return self.put(np.concatenate([self[a], self[b]], axis=1), back)

    def sparsemax(self, a: int) -> int:
        """The nearest point of the simplex, row by row."""
        z = self[a]
        down = -np.sort(-z, axis=1)
        rank = np.arange(1, z.shape[1] + 1)
        sums = np.cumsum(down, axis=1)
        support = (1 + rank * down > sums).sum(axis=1)
        level = (sums[np.arange(len(z)), support - 1] - 1) / support
        p = np.maximum(z - level[:, None], 0)

        def back(d, g):
            on = p > 0
            mean = (d * on).sum(axis=1, keepdims=True) / np.maximum(on.sum(axis=1, keepdims=True), 1)
            g[a] += on * (d - mean)

        return self.put(p, back)

    def entropy(self, a: int) -> int:
        p = self[a]
        return self.put((-p * np.log(p + 1e-15)).sum().reshape(1, 1), lambda d, g: g.__setitem__(a, g[a] - d * (np.log(p + 1e-15) + p / (p + 1e-15))))

    def logistic_loss(self, a: int, y: np.ndarray, weight: np.ndarray) -> int:
        z = self[a][:, 0]
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum().reshape(1, 1)
        return self.put(loss, lambda d, g: g.__setitem__(a, g[a] + d * (weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None]))


def _glorot(rng: np.random.Generator, a: int, b: int) -> np.ndarray:
    return rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))


def _deepfm_weights(n: int, s: dict) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s["seed"])
    w = {"linear": _glorot(rng, n, 1), "bias": np.zeros((1, 1)), "factors": _glorot(rng, n, s["factors"])}
    size = n
    for i, h in enumerate(s["hidden"]):
        w |= {f"deep{i}": _glorot(rng, size, h), f"deep{i}_bias": np.zeros((1, h))}
        size = h
    return w | {"last": _glorot(rng, 1 + size, 1), "last_bias": np.zeros((1, 1))}


def _deepfm(t: Tape, w: dict[str, int], x: int, s: dict) -> tuple[int, int | None, list[int]]:
    linear = t.add(t.matmul(x, w["linear"]), w["bias"])
    along = t.matmul(x, w["factors"])
    own = t.matmul(t.times(x, x), t.times(w["factors"], w["factors"]))
    pairs = t.affine(t.row_sums(t.add(t.times(along, along), t.affine(own, -1.0))), 0.5)
    h = x
    for i in range(len(s["hidden"])):
        h = t.relu(t.add(t.matmul(h, w[f"deep{i}"]), w[f"deep{i}_bias"]))
    return t.add(t.matmul(t.beside(t.add(linear, pairs), h), w["last"]), w["last_bias"]), None, []


def _attention_weights(n: int, s: dict) -> dict[str, np.ndarray]:
    rng, size = np.random.default_rng(s["seed"]), s["decision"] + s["attend"]
    w = {"shared": _glorot(rng, n, 2 * size), "shared_bias": np.zeros((1, 2 * size))}
    for i in range(s["steps"] + 1):
        w |= {f"own{i}": _glorot(rng, size, 2 * size), f"own{i}_bias": np.zeros((1, 2 * size))}
    for i in range(s["steps"]):
        w |= {f"mask{i}": _glorot(rng, s["attend"], n), f"mask{i}_bias": np.zeros((1, n))}
    return w | {"last": _glorot(rng, s["decision"], 1), "last_bias": np.zeros((1, 1))}


def _attention(t: Tape, w: dict[str, int], x: int, s: dict) -> tuple[int, int | None, list[int]]:
    d, size = s["decision"], s["decision"] + s["attend"]

    def gated(a: int, name: str) -> int:
        both = t.add(t.matmul(a, w[name]), w[f"{name}_bias"])
        return t.times(t.columns(both, 0, size), t.sigmoid(t.columns(both, size, 2 * size)))

    def transformed(a: int, i: int) -> int:
        shared = gated(a, "shared")
        return t.affine(t.add(gated(shared, f"own{i}"), shared), 0.5**0.5)

    attend = t.columns(transformed(x, 0), d, size)
    left = t.put(np.ones_like(t[x]))
    total = loss = None
    masks = []
    for i in range(s["steps"]):
        mask = t.sparsemax(t.times(t.add(t.matmul(attend, w[f"mask{i}"]), w[f"mask{i}_bias"]), left))
        masks.append(mask)
        left = t.times(left, t.affine(mask, -1.0, s["gamma"]))
        h = transformed(t.times(mask, x), i + 1)
        decided = t.relu(t.columns(h, 0, d))
        total = decided if total is None else t.add(total, decided)
        spread = t.affine(t.entropy(mask), s["sparsity"] / s["steps"])
        loss = spread if loss is None else t.add(loss, spread)
        attend = t.columns(h, d, size)
    return t.add(t.matmul(total, w["last"]), w["last_bias"]), loss, masks


MODELS = {"deepfm": (_deepfm_weights, _deepfm), "attention": (_attention_weights, _attention)}
ALIASES = {"tabnet": "attention"}


def loss_and_gradient(name: str, settings: dict, weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Sums over rows."""
    t = Tape()
    at = {k: t.put(v) for k, v in weights.items()}
    logit, extra, _ = MODELS[name][1](t, at, t.put(x), settings)
    loss = t.logistic_loss(logit, y, weight)
    total = loss if extra is None else t.add(loss, extra)
    g = t.gradients(total)
    return float(t[total][0, 0]), {k: g[i] for k, i in at.items()}


def forward(name: str, settings: dict, weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probabilities of class 1, and the masks of the steps."""
    t = Tape()
    logit, _, masks = MODELS[name][1](t, {k: t.put(v) for k, v in weights.items()}, t.put(x), settings)
    return 1 / (1 + np.exp(-np.clip(t[logit][:, 0], -500, 500))), [t[m] for m in masks]


@dataclass
class Network:
    """A trained model: weights, what standardizes its inputs, and the losses of its epochs."""

    name: str
    settings: dict
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    deviation: np.ndarray
    losses: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, features: str) -> DataFrame:
        """``df`` with score and pred, rows whose features are whole."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                x = (_matrix(b.column(b.num_columns - 1)) - m.mean) / m.deviation if b.num_rows else np.empty((0, len(m.mean)))
                score, _ = forward(m.name, m.settings, m.weights, x)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score > 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "pred"])

        rows = df.where(usable(F.col(features)) & (F.size(features) == len(self.mean))).withColumn("_x", F.col(features).cast("array<double>"))
        kind = df.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("pred")).schema
        return rows.mapInArrow(run, kind)

    def importances(self, df: DataFrame, features: str) -> DataFrame:
        """(feature, importance): shares of what the masks let through, weighed by what the steps decide."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = shared.value, 0.0
            for b in batches:
                if b.num_rows:
                    _, masks = forward(m.name, m.settings, m.weights, (_matrix(b.column(0)) - m.mean) / m.deviation)
                    total = total + sum(mask.sum(axis=0) for mask in masks)
            if not isinstance(total, float):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["feature", "part"])

        rows = df.where(usable(F.col(features)) & (F.size(features) == len(self.mean))).select(F.col(features).cast("array<double>").alias("x"))
        sums = rows.mapInArrow(run, "feature int, part double").groupBy("feature").agg(F.sum("part").alias("part"))
        whole = sums.agg(F.sum("part").alias("whole"))
        return sums.crossJoin(F.broadcast(whole)).select("feature", (F.col("part") / F.col("whole")).alias("importance"))

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {**self.weights, "_mean": self.mean, "_deviation": self.deviation, "_losses": np.array(self.losses)}
        rows = [(self.name, repr(self.settings), k, list(v.shape), v.ravel().tolist()) for k, v in parts.items()]
        spark.createDataFrame(rows, "model string, settings string, part string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Network:
        import ast

        rows = spark.read.parquet(path).collect()  # a row for each layer
        parts = {r.part: np.array(r.numbers, np.float64).reshape(r["shape"]) for r in rows}
        mean, deviation, losses = (parts.pop(k) for k in ("_mean", "_deviation", "_losses"))
        return Network(rows[0].model, ast.literal_eval(rows[0].settings), parts, mean, deviation, losses.tolist())


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in weights.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


class Exchange:
    """Sums of arrays over the tasks of a barrier stage, in the order of the tasks: the first task adds up."""

    def __init__(self, task: BarrierTaskContext, timeout: float = 600.0):
        self.rank, self.tasks, self.peers = task.partitionId(), len(task.getTaskInfos()), []
        token = secrets.token_hex(16)
        server = None
        if self.rank == 0:
            server = socket.create_server(("", 0), backlog=self.tasks)
            server.settimeout(timeout)
        said = task.allGather(f"{server.getsockname()[1]} {token}" if server else "")[0]
        port, token = said.split()
        if server:
            found = {}
            while len(found) < self.tasks - 1:
                peer, _ = server.accept()
                peer.settimeout(timeout)
                if self._take(peer, len(token)) == token.encode():
                    found[struct.unpack("!I", self._take(peer, 4))[0]] = peer
            server.close()
            self.peers = [found[r] for r in sorted(found)]
        else:
            peer = socket.create_connection((task.getTaskInfos()[0].address.rsplit(":", 1)[0], int(port)), timeout)
            peer.sendall(token.encode() + struct.pack("!I", self.rank))
            self.peers = [peer]

    @staticmethod
    def _take(peer: socket.socket, n: int) -> bytes:
        got = bytearray()
        while len(got) < n:
            part = peer.recv(n - len(got))
            if not part:
                raise ConnectionError("a task of the stage has gone")
            got += part
        return bytes(got)

    def summed(self, part: np.ndarray) -> np.ndarray:
        part = part.astype(np.float64)
        if self.rank:
            self.peers[0].sendall(part.tobytes())
            return np.frombuffer(self._take(self.peers[0], part.nbytes), np.float64)
        total = part.copy()
        for peer in self.peers:
            total += np.frombuffer(self._take(peer, part.nbytes), np.float64)
        for peer in self.peers:
            peer.sendall(total.tobytes())
        return total

    def close(self) -> None:
        for peer in self.peers:
            peer.close()


def _turn(key: np.ndarray, epoch: int, batches: int) -> np.ndarray:
    """The batch of each row in an epoch."""
    z = key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (epoch + 1) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(batches)).astype(np.int64)


def _stage(name: str, s: dict, mean: np.ndarray, deviation: np.ndarray, batches: int, validate: bool):
    """What a barrier task does with rows (key, in_validation, y, weight, x)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        heads, n, width = [], 0, len(mean)
        with tempfile.TemporaryFile() as file:
            for b in rows:
                if b.num_rows:
                    file.write(((_matrix(b.column(4)) - mean) / deviation).astype(np.float64).tobytes())
                    heads.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                    n += b.num_rows
            file.flush()
            x = np.memmap(file, np.float64, "r", shape=(n, width)) if n else np.empty((0, width))
            key, held, y, weight = (np.concatenate([h[i] for h in heads]) if heads else np.empty(0) for i in range(4))
            held = held.astype(bool)
            exchange = Exchange(task)
            weights = MODELS[name][0](width, s)
            flat = _flat(weights)
            first, second, step = np.zeros_like(flat), np.zeros_like(flat), 0
            kept, least, waited, losses = flat.copy(), np.inf, 0, []
            for epoch in range(s["epochs"]):
                turn = _turn(key, epoch, batches) if n else np.empty(0, np.int64)
                loss, seen = 0.0, 0.0
                for i in range(batches):
                    mine = np.flatnonzero((turn == i) & ~held) if n else np.empty(0, np.int64)
                    now = _shaped(flat, weights)
                    one, g = loss_and_gradient(name, s, now, np.asarray(x[mine]), y[mine], weight[mine]) if len(mine) else (0.0, {k: np.zeros_like(v) for k, v in weights.items()})
                    total = exchange.summed(np.r_[_flat(g), one, weight[mine].sum() if len(mine) else 0.0])
                    if total[-1] == 0:
                        continue
                    step += 1
                    gradient = total[:-2] / total[-1] + s["decay"] * flat
                    first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
                    flat = flat - s["rate"] * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                    loss, seen = loss + total[-2], seen + total[-1]
                if validate:
                    own = np.flatnonzero(held) if n else np.empty(0, np.int64)
                    one = loss_and_gradient(name, s, _shaped(flat, weights), np.asarray(x[own]), y[own], weight[own])[0] if len(own) else 0.0
                    loss, seen = exchange.summed(np.array([one, weight[own].sum() if len(own) else 0.0]))
                losses.append(loss / max(seen, 1e-300))
                if not validate or losses[-1] < least:
                    kept, least, waited = flat.copy(), losses[-1], 0
                else:
                    waited += 1
                    if waited >= s["patience"]:
                        break
            exchange.close()
        if task.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([kept.tolist()], pa.list_(pa.float64())), pa.array([losses], pa.list_(pa.float64()))], names=["weights", "losses"])

    return run


def train(df: DataFrame, name: str, features: str, label: str = "label", id_col: str = "id", validation: str | None = None, weight: str | None = None, tasks: int | None = None, **settings) -> Network:
    """A network of rows with ``features`` (array) and ``label`` (0 or 1); rows where ``validation``
    holds choose the epoch.  All ``tasks`` (at most the cluster's slots) run at the same time."""
    name = ALIASES.get(name, name)
    s = {**SETTINGS[name], **settings}
    whole = df.where(usable(F.col(features)) & F.col(label).isNotNull()).withColumn("_held", F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False))
    most = whole.groupBy(F.size(features).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        raise ValueError("no rows to train on")
    whole = whole.where(F.size(features) == most.n)
    fit = whole.where("not _held")
    parts = [a for i in range(most.n) for a in (F.avg(F.col(features)[i].cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(features)[i].cast("double")).alias(f"d{i}"))]
    row = fit.agg(F.count("*").alias("n"), *parts).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(most.n)])
    deviation = np.array([row[f"d{i}"] or 1.0 for i in range(most.n)])
    slots = df.sparkSession.sparkContext.defaultParallelism
    key = F.xxhash64(id_col)
    rows = whole.select(key.alias("key"), F.col("_held").alias("held"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), F.col(features).cast("array<double>").alias("x"))
    dealt = rows.repartition(min(tasks or slots, slots), "key").sortWithinPartitions("key")
    stage = _stage(name, s, mean, deviation, max(1, -(-row.n // s["batch"])), bool(validation))
    out = dealt.mapInArrow(stage, "weights array<double>, losses array<double>", barrier=True).collect()  # one row
    like = MODELS[name][0](most.n, s)
    return Network(name, s, _shaped(np.array(out[0].weights), like), mean, deviation, list(out[0].losses))
