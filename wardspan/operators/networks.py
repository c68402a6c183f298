"""Reconstruction networks, fitted in the tasks.

Every round each task trains the shared network on its own rows, and the tasks'
parameters, with the optimiser's moments and the running figures of the norms,
are averaged up a tree by their numbers of rows. With all rows in one task that
is a plain fit. No row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task is meant to hold, and rounds where there are several tasks.
TASK_ROWS, ROUNDS = 20_000, 10
SLOPE, EPSILON, MOMENTUM = 0.1, 1e-5, 0.1


@dataclass
class Layer:
    """Width, and what follows the product: a batch norm, a leaky line, a share of dropped values."""

    width: int
    norm: bool = False
    leaky: bool = True
    drop: float = 0.0


@dataclass
class Plan:
    """Layers and how they are trained; ``cosine`` or else a rate that halves when the error stays."""

    layers: list[Layer]
    rate: float = 1e-3
    decay: float = 1e-4
    clip: float = 1.0
    cosine: bool = False
    batch: int = 64
    epochs: int = 200
    patience: int = 20


def endpoint_plan(inputs: int) -> Plan:
    """The published network of the 71 features."""
    down = [Layer(128, True, True, 0.3), Layer(64, True, True, 0.2), Layer(32, True), Layer(16)]
    return Plan([*down, Layer(32), Layer(64, True, True, 0.2), Layer(128, True), Layer(inputs, leaky=False)])


def cloud_plan(inputs: int) -> Plan:
    """The published network of the 12 cloud features."""
    return Plan([Layer(32), Layer(16), Layer(8), Layer(16), Layer(32), Layer(inputs, leaky=False)], decay=1e-5, clip=np.inf, cosine=True)


def mirrored_plan(inputs: int, hidden: tuple[int, ...]) -> Plan:
    """Widths down and up again."""
    return Plan([*map(Layer, [*hidden, *hidden[-2::-1]]), Layer(inputs, leaky=False)], rate=1e-2, decay=0.0, clip=np.inf, cosine=True)


@dataclass
class Network:
    """Parameters of a plan: for each layer weights, bias, and scale, shift, mean and variance of its norm."""

    inputs: int
    plan: Plan
    layers: list[dict[str, np.ndarray]] = field(default_factory=list)

    @classmethod
    def new(cls, inputs: int, plan: Plan, seed: int = 42) -> Network:
        rng, out, before = np.random.default_rng(seed), [], inputs
        for layer in plan.layers:
            reach = before**-0.5
            out.append({"w": rng.uniform(-reach, reach, (before, layer.width)), "b": rng.uniform(-reach, reach, layer.width)})
            if layer.norm:
                out[-1] |= {"scale": np.ones(layer.width), "shift": np.zeros(layer.width), "mean": np.zeros(layer.width), "var": np.ones(layer.width)}
            before = layer.width
        return cls(inputs, plan, out)

    def trained(self) -> list[tuple[int, str]]:
        """Places of the parameters that gradients move."""
        return [(i, k) for i, p in enumerate(self.layers) for k in p if k not in ("mean", "var")]

    def vector(self) -> np.ndarray:
        return np.concatenate([p[k].ravel() for p in self.layers for k in p])

    def put(self, vector: np.ndarray) -> None:
        at = 0
        for p in self.layers:
            for k in p:
                p[k] = vector[at : at + p[k].size].reshape(p[k].shape).copy()
                at += p[k].size

    def apply(self, x: np.ndarray) -> np.ndarray:
        for layer, p in zip(self.plan.layers, self.layers):
            x = x @ p["w"] + p["b"]
            if layer.norm:
                x = (x - p["mean"]) / np.sqrt(p["var"] + EPSILON) * p["scale"] + p["shift"]
            if layer.leaky:
                x = np.where(x > 0, x, SLOPE * x)
        return x

    def residuals(self, x: np.ndarray) -> np.ndarray:
        return x - self.apply(x)

    def gradients(self, x: np.ndarray, rng: np.random.Generator) -> dict[tuple[int, str], np.ndarray]:
        """Of the mean squared error of a batch; the norms' running figures move on."""
        kept, out = [], x
        for layer, p in zip(self.plan.layers, self.layers):
            k = {"in": out}
            out = out @ p["w"] + p["b"]
            if layer.norm:
                mean, var = out.mean(axis=0), out.var(axis=0)
                k["deviation"] = np.sqrt(var + EPSILON)
                k["unit"] = (out - mean) / k["deviation"]
                out = k["unit"] * p["scale"] + p["shift"]
                p["mean"] += MOMENTUM * (mean - p["mean"])
                p["var"] += MOMENTUM * (var * len(x) / max(1, len(x) - 1) - p["var"])
            if layer.leaky:
                k["slope"] = np.where(out > 0, 1.0, SLOPE)
                out = out * k["slope"]
            if layer.drop:
                k["mask"] = (rng.random(out.shape) >= layer.drop) / (1 - layer.drop)
                out = out * k["mask"]
            kept.append(k)
        delta, found = 2 * (out - x) / x.size, {}
        for i in range(len(self.layers) - 1, -1, -1):
            layer, p, k = self.plan.layers[i], self.layers[i], kept[i]
            delta = delta * k.get("mask", 1.0) * k.get("slope", 1.0)
            if layer.norm:
                found[i, "scale"], found[i, "shift"] = (delta * k["unit"]).sum(axis=0), delta.sum(axis=0)
                unit = delta * p["scale"]
                delta = (unit - unit.mean(axis=0) - k["unit"] * (unit * k["unit"]).mean(axis=0)) / k["deviation"]
            found[i, "w"], found[i, "b"] = k["in"].T @ delta, delta.sum(axis=0)
            delta = delta @ p["w"].T
        return found


@dataclass
class State:
    """What a fit has come to: parameters, the optimiser's two moments and its steps, and epochs done."""

    vector: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0
    epochs: int = 0


def train(inputs: int, plan: Plan, state: State, x: np.ndarray, check: np.ndarray, epochs: int, seed: int) -> State:
    """Epochs of Adam on the rows of x; the parameters of the least error on ``check`` (x itself if that is empty) stay."""
    net, rng = Network.new(inputs, plan), np.random.default_rng([seed, state.epochs])
    net.put(state.vector)
    # What gradients move lies in one vector, so the optimiser takes a few operations for all of it; the layers look into it.
    places, at = net.trained(), 0
    p, m, v = np.concatenate([net.layers[i][k].ravel() for i, k in places]), state.first.copy(), state.second.copy()
    for i, k in places:
        shape, size = net.layers[i][k].shape, net.layers[i][k].size
        net.layers[i][k] = p[at : at + size].reshape(shape)
        at += size
    g, t = np.empty_like(p), np.empty_like(p)
    check, steps, rate = check if len(check) else x, state.steps, plan.rate
    best, kept, waited = np.inf, net.vector(), 0
    for epoch in range(state.epochs, state.epochs + epochs):
        now = plan.rate * 0.5 * (1 + np.cos(np.pi * epoch / plan.epochs)) if plan.cosine else rate
        shuffled = x[rng.permutation(len(x))]
        for a in range(0, len(x), plan.batch):
            found = net.gradients(shuffled[a : a + plan.batch], rng)
            np.concatenate([found[place].ravel() for place in places], out=g)
            steps += 1
            if np.isfinite(plan.clip):
                g *= min(1.0, plan.clip / (np.sqrt(g @ g) + 1e-6))
            g += np.multiply(p, plan.decay, out=t)
            m += np.multiply(np.subtract(g, m, out=t), 0.1, out=t)
            v += np.multiply(np.subtract(np.multiply(g, g, out=t), v, out=t), 0.001, out=t)
            np.add(np.sqrt(np.divide(v, 1 - 0.999**steps, out=t), out=t), 1e-8, out=t)
            p -= np.multiply(np.divide(m, t, out=t), now / (1 - 0.9**steps), out=t)
        error = float(np.mean(net.residuals(check) ** 2))
        if error < best:
            best, kept, waited = error, net.vector(), 0
        else:
            waited += 1
            rate *= 0.5 if waited % 11 == 0 else 1.0
            if waited >= plan.patience:
                break
    return State(kept, m, v, steps, state.epochs + epochs)


def fit(rows: DataFrame, inputs: int, plan: Plan, n: int, seed: int = 42) -> Network:
    """A network of rows (x, an array of scaled values, is_train, draw, which orders them), n of them.

    They are dealt to tasks of about TASK_ROWS rows; one task does all epochs at
    once, several meet after each of ROUNDS parts of them. ``rows`` should be cut,
    as every round reads it.
    """
    tasks = max(1, -(-n // TASK_ROWS))
    rounds = ROUNDS if tasks > 1 else 1
    net = Network.new(inputs, plan, seed)
    size = sum(net.layers[i][k].size for i, k in net.trained())
    state = State(net.vector(), np.zeros(size), np.zeros(size))
    dealt = rows.select("x", "is_train", "draw").repartition(tasks, "draw") if tasks > 1 else rows.select("x", "is_train", "draw").coalesce(1)
    for i in range(rounds):
        epochs = plan.epochs * (i + 1) // rounds - plan.epochs * i // rounds
        shared = rows.sparkSession.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epochs=epochs) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            table = pa.Table.from_batches(got).combine_chunks()
            order = np.argsort(table["draw"].to_numpy(), kind="stable")
            x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)[order]
            of = table["is_train"].to_numpy()[order].astype(bool)
            if of.any():
                s = train(inputs, plan, shared.value, x[of], x[~of], epochs, seed)
                yield pa.RecordBatch.from_arrays([pa.array([int(of.sum())]), pa.array([np.concatenate([s.vector, s.first, s.second, [s.steps]]).tobytes()], pa.binary())], names=["n", "state"])

        parts = dealt.mapInArrow(run, "n long, state binary").rdd.map(lambda r: (r["n"], np.frombuffer(r["state"]) * r["n"]))
        n_all, total = parts.treeAggregate((0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        shared.destroy()
        if not n_all:
            break
        mean, p = total / n_all, len(state.vector)
        state = State(mean[:p], mean[p : p + size], mean[p + size : p + 2 * size], mean[-1], state.epochs + epochs)
    net.put(state.vector)
    return net


def as_dict(net: Network) -> dict:
    """A network as lists and numbers."""
    plan = asdict(net.plan)
    plan["clip"] = None if np.isinf(plan["clip"]) else plan["clip"]
    return {"inputs": net.inputs, "plan": plan, "vector": net.vector().tolist()}


def from_dict(told: dict) -> Network:
    plan = dict(told["plan"])
    plan |= {"layers": [Layer(**x) for x in plan["layers"]], "clip": np.inf if plan["clip"] is None else plan["clip"]}
    net = Network.new(told["inputs"], Plan(**plan))
    net.put(np.array(told["vector"]))
    return net

