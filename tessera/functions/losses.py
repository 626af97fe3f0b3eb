"""Losses as aggregate Columns: ``reduction`` 'mean' averages over all elements, any other name sums them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import log_softmax, num

TINY = 1e-7


def reduced(each: Column, reduction: str = "mean") -> Column:
    return F.avg(each) if reduction == "mean" else F.sum(each)


def mse_loss(p, t, reduction: str = "mean") -> Column:
    e = num(p) - num(t)
    return reduced(e * e, reduction)


def mae_loss(p, t, reduction: str = "mean") -> Column:
    return reduced(F.abs(num(p) - num(t)), reduction)


def bce_loss(p, t, reduction: str = "mean") -> Column:
    p, t = F.least(F.greatest(num(p), F.lit(TINY)), F.lit(1 - TINY)), num(t)
    return reduced(-(t * F.ln(p) + (1 - t) * F.ln(1 - p)), reduction)


def bce_with_logits(x, t, reduction: str = "mean", pos_weight: float | None = None) -> Column:
    """With pos_weight the loss of an element is scaled where its target is 1 (in proportion for soft targets)."""
    x, t = num(x), num(t)
    each = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    if pos_weight is not None:
        each = each * (1 + (pos_weight - 1) * t)
    return reduced(each, reduction)


def nll_loss(log_p: Column, target: Column, reduction: str = "mean") -> Column:
    return reduced(-F.get(log_p, target.cast("int")), reduction)


def cross_entropy(logits: Column, target: Column, reduction: str = "mean", label_smoothing: float = 0.0) -> Column:
    """logits: an array; target: a class index."""
    lp = log_softmax(logits)
    own = F.get(lp, target.cast("int"))
    if label_smoothing:
        every = F.aggregate(lp, F.lit(0.0), lambda s, v: s + v)
        own = (1 - label_smoothing) * own + label_smoothing / F.size(lp) * every
    return reduced(-own, reduction)


def cross_entropy_soft(logits: Column, targets: Column, reduction: str = "mean") -> Column:
    return reduced(-F.aggregate(F.zip_with(log_softmax(logits), targets, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), reduction)


def huber_loss(p, t, delta: float = 1.0, reduction: str = "mean") -> Column:
    e = F.abs(num(p) - num(t))
    q = F.least(e, F.lit(float(delta)))
    return reduced(0.5 * q * q + delta * (e - q), reduction)


def kl_div(log_p, y, reduction: str = "mean") -> Column:
    y = num(y)
    return reduced(y * (F.ln(F.greatest(y, F.lit(1e-8))) - num(log_p)), reduction)
