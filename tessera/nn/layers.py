"""Layers with forward and backward passes on Arrow batches.

A network is trained data-parallel: parameters go to the executors with the task, each task sums the gradients of its rows, and
these vectors are added up in few tasks before the driver gets them. Nothing depends on how rows are dealt to tasks: batch
normalisation uses the moments of all rows (a pass over the data for each of its sums), and dropout draws by step and row. Scoring
maps batches. Images are rows of flat arrays in channel, height, width order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Activations and their derivatives, given input and output.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "Identity": (lambda x: x, lambda x, y: np.ones_like(x)),
    "ReLU": (lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float)),
    "LeakyReLU": (lambda x, a=0.01: np.where(x > 0, x, a * x), lambda x, y, a=0.01: np.where(x > 0, 1.0, a)),
    "ELU": (lambda x, a=1.0: np.where(x > 0, x, a * np.expm1(np.minimum(x, 0))), lambda x, y, a=1.0: np.where(x > 0, 1.0, a * np.exp(np.minimum(x, 0)))),
    "Sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700))), lambda x, y: y * (1 - y)),
    "Tanh": (np.tanh, lambda x, y: 1 - y * y),
    "Swish": (lambda x: x / (1 + np.exp(-np.clip(x, -700, 700))), lambda x, y: (s := 1 / (1 + np.exp(-np.clip(x, -700, 700)))) * (1 + x * (1 - s))),
    "GELU": (lambda x: 0.5 * x * (1 + np.tanh(0.7978845608028654 * (x + 0.044715 * x**3))), lambda x, y: 0.5 * (1 + (t := np.tanh(0.7978845608028654 * (x + 0.044715 * x**3)))) + 0.5 * x * (1 - t * t) * 0.7978845608028654 * (1 + 3 * 0.044715 * x * x)),
    "SELU": (lambda x: 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0))), lambda x, y: 1.0507009873554805 * np.where(x > 0, 1.0, 1.6732632423543772 * np.exp(np.minimum(x, 0)))),
    "HardSwish": (lambda x: x * np.clip(x + 3, 0, 6) / 6, lambda x, y: np.where(x <= -3, 0.0, np.where(x >= 3, 1.0, (2 * x + 3) / 6))),
}


class Module:
    """params: own arrays by name; children: modules by name. state holds what is kept but not trained."""

    def __init__(self, **config):
        self.config = config
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}
        self.state: dict[str, np.ndarray] = {}
        self.children: dict[str, Module] = {}
        self.training = True

    def named(self, kind: str = "params") -> dict[str, np.ndarray]:
        out = dict(getattr(self, kind))
        for name, child in self.children.items():
            out |= {f"{name}.{k}": v for k, v in child.named(kind).items()}
        return out

    def load(self, values: dict[str, np.ndarray], kind: str = "params") -> None:
        """Unknown names are an error; missing ones keep their values."""
        unknown = values.keys() - self.named(kind).keys()
        if unknown:
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        for k, v in values.items():
            where = self
            *path, name = k.split(".")
            for p in path:
                where = where.children[p]
            getattr(where, kind)[name] = np.asarray(v, float).reshape(np.shape(getattr(where, kind)[name]))

    def modules(self, path: str = "") -> Iterator[tuple[str, Module]]:
        """All modules with their paths, this one first."""
        yield path, self
        for name, child in self.children.items():
            yield from child.modules(f"{path}.{name}" if path else name)

    def take_gradients(self, grads: dict[str, np.ndarray]) -> None:
        """Gradients by name, as they come from ``gradient_step``, into the modules."""
        for path, m in self.modules():
            m.grads = {k: grads[f"{path}.{k}" if path else k] for k in m.params}

    def train(self, on: bool = True) -> Module:
        self.training = on
        for c in self.children.values():
            c.train(on)
        return self

    def eval(self) -> Module:
        return self.train(False)

    def count_parameters(self) -> int:
        return sum(v.size for v in self.named().values())

    def parameter_norms(self) -> dict[str, float]:
        return {k: float(np.linalg.norm(v)) for k, v in self.named().items()}

    def gradient_norms(self) -> dict[str, float]:
        return {k: float(np.linalg.norm(v)) for k, v in self.named("grads").items()}

    def get_config(self) -> dict:
        return {"class": type(self).__name__, "config": self.config, "children": {k: c.get_config() for k, c in self.children.items()}}


class Activation(Module):
    def __init__(self, name: str, **options):
        super().__init__(name=name, **options)
        self.name, self.options = name, options

    def forward(self, x):
        self.x, self.y = x, ACTIVATIONS[self.name][0](x, *self.options.values())
        return self.y

    def backward(self, g):
        return g * ACTIVATIONS[self.name][1](self.x, self.y, *self.options.values())


class Softmax(Module):
    def __init__(self, axis: int = -1):
        super().__init__(axis=axis)
        self.axis = axis

    def forward(self, x):
        e = np.exp(x - x.max(self.axis, keepdims=True))
        self.y = e / e.sum(self.axis, keepdims=True)
        return self.y

    def backward(self, g):
        return self.y * (g - (g * self.y).sum(self.axis, keepdims=True))


class LogSoftmax(Module):
    def __init__(self, axis: int = -1):
        super().__init__(axis=axis)
        self.axis = axis

    def forward(self, x):
        x = x - x.max(self.axis, keepdims=True)
        self.y = x - np.log(np.exp(x).sum(self.axis, keepdims=True))
        return self.y

    def backward(self, g):
        return g - np.exp(self.y) * g.sum(self.axis, keepdims=True)


class Dense(Module):
    def __init__(self, in_features: int, out_features: int, bias: bool = True, seed: int = 0):
        super().__init__(in_features=in_features, out_features=out_features, bias=bias, seed=seed)
        bound = (1 / in_features) ** 0.5
        self.params["weight"] = np.random.default_rng(seed).uniform(-bound, bound, (in_features, out_features))
        if bias:
            self.params["bias"] = np.zeros(out_features)

    def forward(self, x):
        self.x = x
        return x @ self.params["weight"] + self.params.get("bias", 0.0)

    def backward(self, g):
        flat_x, flat_g = self.x.reshape(-1, self.x.shape[-1]), g.reshape(-1, g.shape[-1])
        self.grads["weight"] = flat_x.T @ flat_g
        if "bias" in self.params:
            self.grads["bias"] = flat_g.sum(0)
        return g @ self.params["weight"].T


class Conv2d(Module):
    """x: (n, channels, height, width)."""

    def __init__(self, in_channels: int, out_channels: int, kernel_size: int | tuple[int, int], stride: int = 1, padding: int = 0, bias: bool = True, seed: int = 0):
        super().__init__(in_channels=in_channels, out_channels=out_channels, kernel_size=kernel_size, stride=stride, padding=padding, bias=bias, seed=seed)
        self.k = (kernel_size, kernel_size) if isinstance(kernel_size, int) else tuple(kernel_size)
        self.stride, self.padding = stride, padding
        bound = (1 / (in_channels * self.k[0] * self.k[1])) ** 0.5
        self.params["weight"] = np.random.default_rng(seed).uniform(-bound, bound, (out_channels, in_channels, *self.k))
        if bias:
            self.params["bias"] = np.zeros(out_channels)

    def _windows(self, x):
        x = np.pad(x, ((0, 0), (0, 0), (self.padding,) * 2, (self.padding,) * 2))
        w = np.lib.stride_tricks.sliding_window_view(x, self.k, axis=(2, 3))
        return x.shape, w[:, :, :: self.stride, :: self.stride]

    def forward(self, x):
        self.shape, self.w = self._windows(x)
        out = np.einsum("nchwij,ocij->nohw", self.w, self.params["weight"], optimize=True)
        return out + self.params["bias"][None, :, None, None] if "bias" in self.params else out

    def backward(self, g):
        self.grads["weight"] = np.einsum("nchwij,nohw->ocij", self.w, g, optimize=True)
        if "bias" in self.params:
            self.grads["bias"] = g.sum((0, 2, 3))
        out, (h, w) = np.zeros(self.shape), g.shape[2:]
        part = np.einsum("nohw,ocij->nchwij", g, self.params["weight"], optimize=True)
        for i in range(self.k[0]):
            for j in range(self.k[1]):
                out[:, :, i : i + h * self.stride : self.stride, j : j + w * self.stride : self.stride] += part[..., i, j]
        p = self.padding
        return out[:, :, p : out.shape[2] - p, p : out.shape[3] - p]


class MaxPool2d(Module):
    """Ties share the gradient."""

    def __init__(self, kernel_size: int | tuple[int, int], stride: int | None = None, padding: int = 0):
        super().__init__(kernel_size=kernel_size, stride=stride, padding=padding)
        self.k = (kernel_size, kernel_size) if isinstance(kernel_size, int) else tuple(kernel_size)
        self.stride, self.padding = stride or self.k[0], padding

    def forward(self, x):
        x = np.pad(x, ((0, 0), (0, 0), (self.padding,) * 2, (self.padding,) * 2), constant_values=-np.inf)
        self.shape = x.shape
        self.w = np.lib.stride_tricks.sliding_window_view(x, self.k, axis=(2, 3))[:, :, :: self.stride, :: self.stride]
        self.y = self.w.max((4, 5))
        return self.y

    def backward(self, g):
        hit = self.w == self.y[..., None, None]
        part = hit * (g / hit.sum((4, 5)))[..., None, None]
        out, (h, w), p = np.zeros(self.shape), g.shape[2:], self.padding
        for i in range(self.k[0]):
            for j in range(self.k[1]):
                out[:, :, i : i + h * self.stride : self.stride, j : j + w * self.stride : self.stride] += part[..., i, j]
        return out[:, :, p : out.shape[2] - p, p : out.shape[3] - p]


class Needs(Exception):
    """Raised inside a task where a layer cannot go on before sums over all rows are known: their name and this batch's part."""

    def __init__(self, layer: Module, name: str, sums: np.ndarray):
        super().__init__(name)
        self.layer, self.name, self.sums = layer, name, sums


class _BatchNorm(Module):
    """Normalises by the moments of the batch. In distributed training the batch is the whole table: ``known`` then holds its mean
    and variance and the backward pass's means, and what it does not hold yet is asked for (``Needs``)."""

    axes: tuple[int, ...] = (0,)

    def __init__(self, num_features: int, eps: float = 1e-5, momentum: float = 0.1):
        super().__init__(num_features=num_features, eps=eps, momentum=momentum)
        self.eps, self.momentum = eps, momentum
        self.params = {"gamma": np.ones(num_features), "beta": np.zeros(num_features)}
        self.state = {"mean": np.zeros(num_features), "var": np.ones(num_features)}
        self.known: dict[str, np.ndarray] | None = None

    def _wide(self, v):
        return v.reshape([-1 if k == 1 else 1 for k in range(len(self.axes) + 1)])

    def _mean(self, name: str, *values: np.ndarray) -> np.ndarray:
        """Means of each of the values over the batch, in one vector."""
        if self.known is None:
            return np.concatenate([v.mean(self.axes) for v in values])
        if name not in self.known:
            raise Needs(self, name, np.append(np.concatenate([v.sum(self.axes) for v in values]), values[0].size / len(self.state["mean"])))
        return self.known[name]

    def update(self, mean: np.ndarray, var: np.ndarray) -> None:
        for k, v in (("mean", mean), ("var", var)):
            self.state[k] = (1 - self.momentum) * self.state[k] + self.momentum * v

    def forward(self, x):
        if self.training:
            mean = self._mean("mean", x)
            var = self._mean("var", (x - self._wide(mean)) ** 2)
            if self.known is None:
                self.update(mean, var)
        else:
            mean, var = self.state["mean"], self.state["var"]
        self.inv = self._wide(1 / np.sqrt(var + self.eps))
        self.z = (x - self._wide(mean)) * self.inv
        return self._wide(self.params["gamma"]) * self.z + self._wide(self.params["beta"])

    def backward(self, g):
        self.grads = {"gamma": (g * self.z).sum(self.axes), "beta": g.sum(self.axes)}
        g = g * self._wide(self.params["gamma"])
        if not self.training:
            return g * self.inv
        one, two = np.split(self._mean("back", g, g * self.z), 2)
        return self.inv * (g - self._wide(one) - self.z * self._wide(two))


class BatchNorm1d(_BatchNorm):
    axes = (0,)


class BatchNorm2d(_BatchNorm):
    axes = (0, 2, 3)


class Dropout(Module):
    """Scaled when training, nothing otherwise. With ``keys``, a number for each row, a row's mask follows from its number alone."""

    def __init__(self, p: float = 0.5, seed: int = 0):
        super().__init__(p=p, seed=seed)
        if not 0 <= p < 1:
            raise ValueError("p must lie in [0, 1)")
        self.p, self.seed, self.rng, self.mask = p, seed, np.random.default_rng(seed), None
        self.keys: np.ndarray | None = None

    def _uniform(self, shape) -> np.ndarray:
        if self.keys is None:
            return self.rng.random(shape)
        size = int(np.prod(shape[1:], dtype=np.int64))
        # The outputs of a splitmix64 generator that starts at the row's number.
        x = self.keys.astype(np.uint64)[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float).reshape(shape) / (1 << 53)

    def forward(self, x):
        self.mask = (self._uniform(x.shape) >= self.p) / (1 - self.p) if self.training and self.p else None
        return x if self.mask is None else x * self.mask

    def backward(self, g):
        return g if self.mask is None else g * self.mask


class Flatten(Module):
    def __init__(self, start_dim: int = 1):
        super().__init__(start_dim=start_dim)
        self.start = start_dim

    def forward(self, x):
        self.shape = x.shape
        return x.reshape(*x.shape[: self.start], -1)

    def backward(self, g):
        return g.reshape(self.shape)


class Reshape(Module):
    """Rows of flat arrays to the given shape."""

    def __init__(self, *shape: int):
        super().__init__(shape=shape)
        self.to = shape

    def forward(self, x):
        self.shape = x.shape
        return x.reshape(len(x), *self.to)

    def backward(self, g):
        return g.reshape(self.shape)


class Embedding(Module):
    def __init__(self, num_embeddings: int, embedding_dim: int, seed: int = 0):
        super().__init__(num_embeddings=num_embeddings, embedding_dim=embedding_dim, seed=seed)
        self.params["weight"] = 0.01 * np.random.default_rng(seed).standard_normal((num_embeddings, embedding_dim))

    def forward(self, x):
        self.i = np.asarray(x, int)
        return self.params["weight"][self.i]

    def backward(self, g):
        self.grads["weight"] = np.zeros_like(self.params["weight"])
        np.add.at(self.grads["weight"], self.i, g)
        return None


class Sequential(Module):
    def __init__(self, layers: list[Module] | None = None):
        super().__init__()
        for layer in layers or []:
            self.add(layer)

    def add(self, layer: Module) -> None:
        self.children[str(len(self.children))] = layer

    def forward(self, x):
        for layer in self.children.values():
            x = layer.forward(x)
        return x

    def backward(self, g):
        for layer in reversed(self.children.values()):
            g = layer.backward(g)
        return g


class _Cell(Module):
    """One step of a recurrent layer; GATES blocks of hidden_size columns in one product."""

    GATES = 1

    def __init__(self, input_size: int, hidden_size: int, seed: int = 0, **config):
        super().__init__(input_size=input_size, hidden_size=hidden_size, seed=seed, **config)
        rng, n, bound = np.random.default_rng(seed), self.GATES * hidden_size, (1 / hidden_size) ** 0.5
        self.hidden = hidden_size
        self.params = {"w_ih": rng.uniform(-bound, bound, (input_size, n)), "w_hh": rng.uniform(-bound, bound, (hidden_size, n)), "bias": np.zeros(n)}
        self.grads = {k: np.zeros_like(v) for k, v in self.params.items()}

    def start(self, n: int) -> tuple:
        return (np.zeros((n, self.hidden)),)

    def _into(self, x, h, da_x, da_h):
        """Adds to the gradients; da_x and da_h: of the input's and of the state's products. Returns those of x and h."""
        self.grads["w_ih"] += x.T @ da_x
        self.grads["w_hh"] += h.T @ da_h
        self.grads["bias"] += da_x.sum(0)
        return da_x @ self.params["w_ih"].T, da_h @ self.params["w_hh"].T


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


class RNNCell(_Cell):
    def __init__(self, input_size, hidden_size, nonlinearity: str = "tanh", seed: int = 0):
        super().__init__(input_size, hidden_size, seed, nonlinearity=nonlinearity)
        self.act = ACTIVATIONS["Tanh" if nonlinearity == "tanh" else "ReLU"]

    def forward(self, x, state):
        a = x @ self.params["w_ih"] + state[0] @ self.params["w_hh"] + self.params["bias"]
        h = self.act[0](a)
        return (h,), (x, state[0], a, h)

    def backward(self, g, kept):
        x, h, a, y = kept
        da = g[0] * self.act[1](a, y)
        dx, dh = self._into(x, h, da, da)
        return dx, (dh,)


class LSTMCell(_Cell):
    """Gates in the order input, forget, cell, output. State: (h, c)."""

    GATES = 4

    def start(self, n):
        return np.zeros((n, self.hidden)), np.zeros((n, self.hidden))

    def forward(self, x, state, c=None):
        h, c = (state, c) if c is not None else state
        a = x @ self.params["w_ih"] + h @ self.params["w_hh"] + self.params["bias"]
        i, f, g, o = np.split(a, 4, axis=1)
        i, f, g, o = _sig(i), _sig(f), np.tanh(g), _sig(o)
        new = f * c + i * g
        return (o * np.tanh(new), new), (x, h, c, i, f, g, o, new)

    def backward(self, grad, kept):
        x, h, c, i, f, g, o, new = kept
        t = np.tanh(new)
        dc = grad[1] + grad[0] * o * (1 - t * t)
        da = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), grad[0] * t * o * (1 - o)), axis=1)
        dx, dh = self._into(x, h, da, da)
        return dx, (dh, dc * f)


class GRUCell(_Cell):
    """Gates reset, update, new: h' = (1 - z) n + z h, n = tanh(W x + r (U h))."""

    GATES = 3

    def forward(self, x, state):
        h = state[0]
        a, b = x @ self.params["w_ih"] + self.params["bias"], h @ self.params["w_hh"]
        k = self.hidden
        r, z = _sig(a[:, :k] + b[:, :k]), _sig(a[:, k : 2 * k] + b[:, k : 2 * k])
        n = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
        return ((1 - z) * n + z * h,), (x, h, r, z, n, b[:, 2 * k :])

    def backward(self, grad, kept):
        x, h, r, z, n, u = kept
        g = grad[0]
        dn = g * (1 - z) * (1 - n * n)
        dz, dr = g * (h - n) * z * (1 - z), dn * u * r * (1 - r)
        dx, dh = self._into(x, h, np.concatenate((dr, dz, dn), axis=1), np.concatenate((dr, dz, dn * r), axis=1))
        return dx, (dh + g * z,)


class _Recurrent(Module):
    """Sequences (time, batch, features), or (batch, time, features) with batch_first; layers on layers, one or two directions.
    Gradients flow through time, layers and inputs."""

    CELL: type[_Cell] = RNNCell

    def __init__(self, input_size: int, hidden_size: int, num_layers: int = 1, batch_first: bool = False, dropout: float = 0.0, bidirectional: bool = False, seed: int = 0, **cell):
        super().__init__(input_size=input_size, hidden_size=hidden_size, num_layers=num_layers, batch_first=batch_first, dropout=dropout, bidirectional=bidirectional, seed=seed, **cell)
        self.batch_first, self.ways, self.layers = batch_first, 2 if bidirectional else 1, num_layers
        self.drops = [Dropout(dropout, seed + k) for k in range(num_layers - 1)]
        for layer in range(num_layers):
            for way in range(self.ways):
                size = input_size if layer == 0 else hidden_size * self.ways
                self.children[f"cell{layer}_{way}"] = self.CELL(size, hidden_size, seed=seed + 31 * layer + way, **cell)

    def forward(self, x):
        """Outputs of the last layer at each time, and the last states (one tuple a layer and direction)."""
        x = np.swapaxes(x, 0, 1) if self.batch_first else x
        self.tape, last = [], []
        for layer in range(self.layers):
            outs = []
            for way in range(self.ways):
                cell = self.children[f"cell{layer}_{way}"]
                for k in cell.grads:
                    cell.grads[k] = np.zeros_like(cell.grads[k])
                state, out, kept = cell.start(x.shape[1]), [None] * len(x), [None] * len(x)
                for t in range(len(x)) if way == 0 else reversed(range(len(x))):
                    state, kept[t] = cell.forward(x[t], state)
                    out[t] = state[0]
                outs.append(np.stack(out))
                last.append(state)
                self.tape.append(kept)
            x = np.concatenate(outs, axis=2)
            if layer < self.layers - 1:
                self.drops[layer].training = self.training
                x = self.drops[layer].forward(x)
        return (np.swapaxes(x, 0, 1) if self.batch_first else x), last

    def backward(self, g):
        """g: gradient of the outputs. Returns that of the input."""
        g = np.swapaxes(g, 0, 1) if self.batch_first else g
        for layer in reversed(range(self.layers)):
            if layer < self.layers - 1:
                g = self.drops[layer].backward(g)
            dx = 0
            for way in range(self.ways):
                cell, kept = self.children[f"cell{layer}_{way}"], self.tape[layer * self.ways + way]
                part = g[:, :, way * cell.hidden : (way + 1) * cell.hidden]
                after, own = tuple(np.zeros_like(s) for s in cell.start(g.shape[1])), [None] * len(g)
                for t in reversed(range(len(g))) if way == 0 else range(len(g)):
                    own[t], after = cell.backward((after[0] + part[t], *after[1:]), kept[t])
                dx = dx + np.stack(own)
            g = dx
        return np.swapaxes(g, 0, 1) if self.batch_first else g


class RNN(_Recurrent):
    CELL = RNNCell


class LSTM(_Recurrent):
    CELL = LSTMCell


class GRU(_Recurrent):
    CELL = GRUCell


#: What may be built from a stored configuration.
CLASSES = {c.__name__: c for c in (Activation, Softmax, LogSoftmax, Dense, Conv2d, MaxPool2d, BatchNorm1d, BatchNorm2d, Dropout, Flatten, Reshape, Embedding, Sequential, RNNCell, LSTMCell, GRUCell, RNN, LSTM, GRU)}


def build(config: dict) -> Module:
    cls, options = CLASSES[config["class"]], dict(config["config"])
    if cls is Sequential:
        return Sequential([build(c) for _, c in sorted(config["children"].items(), key=lambda kv: int(kv[0]))])
    if cls is Reshape:
        return Reshape(*options["shape"])
    return cls(**options)


def softmax_cross_entropy(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows: loss and gradient of the scores. y: class indices."""
    z = z - z.max(1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(1, keepdims=True))
    g = np.exp(logp)
    at = (np.arange(len(y)), y.astype(int).ravel())
    g[at] -= 1
    return float(-logp[at].sum()), g


def squared_error(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    e = z - y.reshape(z.shape)
    return float((e * e).sum()), 2 * e


def logits_cross_entropy(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    y = y.reshape(z.shape)
    return float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum()), _sig(z) - y


def _set_keys(model: Module, rows: np.ndarray, step: int) -> None:
    """Numbers of the rows for the dropout layers: by row, step, layer and seed."""
    for k, (_, m) in enumerate(model.modules()):
        if isinstance(m, Dropout):
            salt = (k + 1) * 0xD6E8FEB86659FD93 + step * 0xC2B2AE3D27D4EB4F + m.seed * 0xA0761D6478BD642F
            m.keys = rows.astype(np.int64).view(np.uint64) ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)


def _row_number(df: DataFrame, key: str | None, *columns: str) -> Column:
    """A hash of the row's key, or of the columns where it has none."""
    return F.xxhash64(key) if key else F.xxhash64(*columns)


def _added(parts: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the vectors (name, v) by name: first in few tasks, then on the driver."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, v in zip(b["name"], b["v"], strict=True):
                sums[name] = sums[name] + v if name in sums else np.array(v, float)
        if sums:
            yield pd.DataFrame({"name": list(sums), "v": list(sums.values())})

    few = max(1, math.isqrt(parts.sparkSession.sparkContext.defaultParallelism))
    out: dict[str, np.ndarray] = {}
    for r in parts.repartition(few).mapInPandas(total, "name string, v array<double>").collect():
        v = np.array(r["v"])
        out[r["name"]] = out[r["name"]] + v if r["name"] in out else v
    return out


def gradient_step(model: Module, df: DataFrame, features: str, label: str, loss: Callable, step: int = 0, key: str | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all rows and the mean gradient of each parameter; the modules hold the gradients, too.

    The result does not depend on partitions. Each batch normalisation asks for three sums over all rows (mean, variance, and what
    its backward pass needs), each of which is a pass over the data; its running statistics move once a step. A row's dropout
    follows from ``step`` and its key (without one: its features and label).
    """
    names = list(model.named())
    norms = {path: m for path, m in model.modules() if isinstance(m, _BatchNorm)}
    model.train()
    rows = df.select(features, label, _row_number(df, key, features, label).alias("_row"))
    for m in norms.values():
        m.known = {}
    while True:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[str, np.ndarray] = {}
            paths = {id(m): path for path, m in model.modules()}
            for b in batches:
                if not len(b):
                    continue
                x, y = np.stack(b[features].to_numpy()).astype(float), b[label].to_numpy()
                _set_keys(model, b["_row"].to_numpy(), step)
                try:
                    value, g = loss(model.forward(x), np.stack(y).astype(float) if y.dtype == object else y.astype(float))
                    model.backward(g)
                    own = model.named("grads")
                    name, v = "", np.concatenate([[value, len(b)], *[np.ravel(own[k]) for k in names]])
                except Needs as e:
                    name, v = f"{e.name} {paths[id(e.layer)]}", e.sums
                sums[name] = sums[name] + v if name in sums else v
            if sums:  # a task without rows says nothing: an empty frame has no type that Arrow takes for arrays
                yield pd.DataFrame({"name": list(sums), "v": list(sums.values())})

        got = _added(rows.mapInPandas(run, "name string, v array<double>"))
        asked = [name for name in got if name]
        if not asked:
            break
        for name in asked:
            what, _, path = name.partition(" ")
            norms[path].known[what] = got[name][:-1] / got[name][-1]
    for m in norms.values():
        if m.known:
            m.update(m.known["mean"], m.known["var"])
        m.known = None
    total = got.get("", np.zeros(2 + model.count_parameters()))
    n = max(total[1], 1)
    out, at = {}, 2
    for k in names:
        v = model.named()[k]
        out[k] = (total[at : at + v.size] / n).reshape(v.shape)
        at += v.size
    model.take_gradients(out)
    return float(total[0] / n), out


def fit(model: Module, df: DataFrame, features: str, label: str, loss: Callable, optimizer, steps: int, batches: Callable[[int], DataFrame] | None = None, key: str | None = None) -> list[float]:
    """Training: the optimizer's params are the model's by name. Returns the losses.

    Each step is over the whole table, or with ``batches``, over the rows that it gives for the step's number: a mini-batch, such
    as one batch_id of ``batches`` in operators.resample.
    """
    losses = []
    for t in range(steps):
        value, grads = gradient_step(model, df if batches is None else batches(t), features, label, loss, t, key)
        optimizer.step(grads)
        model.load(optimizer.params)
        losses.append(value)
    return losses


def predict(model: Module, df: DataFrame, features: str, output: str = "output", training: bool = False, key: str | None = None, step: int = 0) -> DataFrame:
    """df with an array of the model's outputs, in evaluation mode; or in training mode, where dropout follows from ``step`` and
    the row's key (without one: its features)."""
    model.train(training)

    @F.pandas_udf("array<double>")
    def score(x: pd.Series, row: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        _set_keys(model, row.to_numpy(), step)
        return pd.Series(list(model.forward(np.stack(x.to_numpy()).astype(float)).reshape(len(x), -1)))

    return df.withColumn(output, score(F.col(features), _row_number(df, key, features)))
