"""Initial values for parameters: arrays of a shape, reproducible by seed."""

from __future__ import annotations

import math

import numpy as np


def fans(shape: tuple[int, ...]) -> tuple[int, int]:
    """Inputs and outputs of a weight: (in, out), or (out, in, *kernel), where each kernel place counts."""
    if len(shape) < 2:
        raise ValueError("fans need two axes or more")
    if len(shape) == 2:
        return shape[0], shape[1]
    field = math.prod(shape[2:])
    return shape[1] * field, shape[0] * field


def _gain(nonlinearity: str, a: float) -> float:
    return {"linear": 1.0, "sigmoid": 1.0, "tanh": 5 / 3, "relu": math.sqrt(2)}.get(nonlinearity, math.sqrt(2 / (1 + a * a)))


def kaiming_normal(shape, a=0.0, mode="fan_in", nonlinearity="leaky_relu", seed=0) -> np.ndarray:
    fan = fans(shape)[0 if mode == "fan_in" else 1]
    return np.random.default_rng(seed).normal(0, _gain(nonlinearity, a) / math.sqrt(fan), shape)


def kaiming_uniform(shape, a=0.0, mode="fan_in", nonlinearity="leaky_relu", seed=0) -> np.ndarray:
    bound = math.sqrt(3) * _gain(nonlinearity, a) / math.sqrt(fans(shape)[0 if mode == "fan_in" else 1])
    return np.random.default_rng(seed).uniform(-bound, bound, shape)


def xavier_normal(shape, gain=1.0, seed=0) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, gain * math.sqrt(2 / sum(fans(shape))), shape)


def xavier_uniform(shape, gain=1.0, seed=0) -> np.ndarray:
    bound = math.sqrt(3) * gain * math.sqrt(2 / sum(fans(shape)))
    return np.random.default_rng(seed).uniform(-bound, bound, shape)


def orthogonal(shape, gain=1.0, seed=0) -> np.ndarray:
    flat = np.random.default_rng(seed).standard_normal((shape[0], math.prod(shape[1:])))
    u, _, v = np.linalg.svd(flat, full_matrices=False)
    return gain * (u if u.shape == flat.shape else v).reshape(shape)


def normal(shape, mean=0.0, std=1.0, seed=0) -> np.ndarray:
    return np.random.default_rng(seed).normal(mean, std, shape)


def uniform(shape, a=0.0, b=1.0, seed=0) -> np.ndarray:
    return np.random.default_rng(seed).uniform(a, b, shape)


def zeros(shape) -> np.ndarray:
    return np.zeros(shape)


def ones(shape) -> np.ndarray:
    return np.ones(shape)


def constant(shape, value) -> np.ndarray:
    return np.full(shape, float(value))


def eye(shape) -> np.ndarray:
    if len(shape) != 2 or shape[0] != shape[1]:
        raise ValueError("eye needs a square shape")
    return np.eye(shape[0])
