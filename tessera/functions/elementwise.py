"""Differentiable scalar functions as Columns, each with its derivative. NULL stays NULL; results follow IEEE where Spark would
raise or give NULL (division by zero, logarithms of zero and below)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of SELU and of the tanh form of GELU.
SELU_ALPHA, SELU_SCALE = 1.6732632423543772, 1.0507009873554805
GELU_CUBE, GELU_ROOT = 0.044715, math.sqrt(2 / math.pi)


def num(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def inf(sign: int = 1) -> Column:
    return F.lit(float("inf") * sign)


def add(a, b) -> Column:
    return num(a) + num(b)


def subtract(a, b) -> Column:
    return num(a) - num(b)


def multiply(a, b) -> Column:
    return num(a) * num(b)


def divide(a, b) -> Column:
    a, b = num(a), num(b)
    at_zero = F.when(a > 0, inf()).when(a < 0, inf(-1)).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def negate(a) -> Column:
    return -num(a)


def power(a, exponent: float) -> Column:
    return F.pow(num(a), F.lit(float(exponent)))


def sqrt(a) -> Column:
    return power(a, 0.5)


def exp(a) -> Column:
    return F.exp(num(a))


def log(a) -> Column:
    a = num(a)
    return F.when(a > 0, F.ln(a)).when(a == 0, inf(-1)).when(a.isNotNull(), F.lit(float("nan")))


def tensor_abs(a) -> Column:
    return F.abs(num(a))


def clip(a, low: float | None = None, high: float | None = None) -> Column:
    a = num(a)
    out = a
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(a.isNotNull(), out)


def relu(a) -> Column:
    return clip(a, low=0.0)


def leaky_relu(a, alpha: float = 0.01) -> Column:
    a = num(a)
    return F.when(a > 0, a).otherwise(a * alpha)


def elu(a, alpha: float = 1.0) -> Column:
    a = num(a)
    return F.when(a > 0, a).otherwise(alpha * (F.exp(F.least(a, F.lit(0.0))) - 1))


def sigmoid(a) -> Column:
    a = num(a)
    small = F.exp(-F.abs(a))
    return F.when(a >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def tanh(a) -> Column:
    return F.tanh(num(a))


tanh_op = tanh


def gelu(a) -> Column:
    a = num(a)
    return 0.5 * a * (1 + F.tanh(GELU_ROOT * (a + GELU_CUBE * a * a * a)))


def swish(a) -> Column:
    return num(a) * sigmoid(a)


def selu(a) -> Column:
    a = num(a)
    return SELU_SCALE * F.when(a > 0, a).otherwise(SELU_ALPHA * (F.exp(F.least(a, F.lit(0.0))) - 1))


def hardswish(a) -> Column:
    a = num(a)
    return a * clip(a + 3, 0.0, 6.0) / 6


def softmax(values) -> Column:
    """Of an array column, along its elements."""
    top = F.array_max(values)
    e = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def log_softmax(values) -> Column:
    top = F.array_max(values)
    total = F.ln(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(values, lambda v: v - top - total)


def _step(a) -> Column:
    return F.when(num(a) > 0, 1.0).otherwise(0.0)


def gelu_slope(a) -> Column:
    a = num(a)
    t = F.tanh(GELU_ROOT * (a + GELU_CUBE * a * a * a))
    return 0.5 * (1 + t) + 0.5 * a * (1 - t * t) * GELU_ROOT * (1 + 3 * GELU_CUBE * a * a)


#: Derivative of each one-argument function; at kinks the value is that from the left (0 for relu), at clip's bounds 1.
SLOPES = {
    "negate": lambda a: F.lit(-1.0),
    "exp": exp,
    "log": lambda a: divide(1.0, a),
    "sqrt": lambda a: divide(0.5, sqrt(a)),
    "tensor_abs": lambda a: F.signum(num(a)),
    "relu": _step,
    "leaky_relu": lambda a, alpha=0.01: F.when(num(a) > 0, 1.0).otherwise(alpha),
    "elu": lambda a, alpha=1.0: F.when(num(a) > 0, 1.0).otherwise(alpha * F.exp(F.least(num(a), F.lit(0.0)))),
    "sigmoid": lambda a: sigmoid(a) * (1 - sigmoid(a)),
    "tanh": lambda a: 1 - tanh(a) * tanh(a),
    "gelu": gelu_slope,
    "swish": lambda a: sigmoid(a) + num(a) * sigmoid(a) * (1 - sigmoid(a)),
    "selu": lambda a: SELU_SCALE * F.when(num(a) > 0, 1.0).otherwise(SELU_ALPHA * F.exp(F.least(num(a), F.lit(0.0)))),
    "hardswish": lambda a: F.when(num(a) <= -3, 0.0).when(num(a) >= 3, 1.0).otherwise((2 * num(a) + 3) / 6),
}


def clip_slope(a, low: float, high: float) -> Column:
    return num(a).between(low, high).cast("double")


def power_slope(a, exponent: float) -> Column:
    return exponent * power(a, exponent - 1)
