"""Optimizers and learning-rate schedules over parameters by name. A parameter is a number or an array on the driver; gradients
come from aggregates over the data."""

from __future__ import annotations

import math

import numpy as np


class Optimizer:
    """params: name -> value. Groups may override the defaults; state is kept by name, so it can be stored and restored."""

    defaults: dict = {}

    def __init__(self, params: dict[str, np.ndarray], lr: float, **options):
        self.params = params
        self.groups: list[dict] = []
        self.state: dict[str, dict] = {}
        self.steps = 0
        self._common = {**self.defaults, "lr": lr, **options}
        self.add_group([*params])

    def add_group(self, names: list[str], **options) -> None:
        self.groups.append({**self._common, **options, "names": list(names)})

    @property
    def lr(self) -> float:
        return self.groups[0]["lr"]

    @lr.setter
    def lr(self, value: float) -> None:
        for g in self.groups:
            g["lr"] = value

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for g in self.groups:
            for name in g["names"]:
                if grads.get(name) is not None:
                    p = np.asarray(self.params[name], float)
                    self.params[name] = self._update(p, np.asarray(grads[name], float), self.state.setdefault(name, {}), g)

    def _update(self, p, grad, s, g):
        raise NotImplementedError

    def state_dict(self) -> dict:
        return {"steps": self.steps, "state": {n: dict(s) for n, s in self.state.items()}, "groups": [dict(g) for g in self.groups]}

    def load_state_dict(self, d: dict) -> None:
        self.steps, self.state, self.groups = d["steps"], {n: dict(s) for n, s in d["state"].items()}, [dict(g) for g in d["groups"]]


class SGD(Optimizer):
    defaults = {"momentum": 0.0, "weight_decay": 0.0, "nesterov": False, "dampening": 0.0}

    def __init__(self, params, lr, **options):
        super().__init__(params, lr, **options)
        g = self.groups[0]
        if g["nesterov"] and (g["momentum"] <= 0 or g["dampening"]):
            raise ValueError("nesterov needs a momentum and no dampening")

    def _update(self, p, grad, s, g):
        grad = grad + g["weight_decay"] * p
        if g["momentum"]:
            s["v"] = grad if "v" not in s else g["momentum"] * s["v"] + (1 - g["dampening"]) * grad
            grad = grad + g["momentum"] * s["v"] if g["nesterov"] else s["v"]
        return p - g["lr"] * grad


class Adam(Optimizer):
    defaults = {"betas": (0.9, 0.999), "eps": 1e-8, "weight_decay": 0.0, "amsgrad": False}
    coupled = True

    def __init__(self, params, lr=0.001, **options):
        super().__init__(params, lr, **options)

    def _update(self, p, grad, s, g):
        a, b = g["betas"]
        if self.coupled:
            grad = grad + g["weight_decay"] * p
        else:
            p = p * (1 - g["lr"] * g["weight_decay"])
        s["t"] = s.get("t", 0) + 1
        s["m"] = a * s.get("m", 0.0) + (1 - a) * grad
        s["v"] = b * s.get("v", 0.0) + (1 - b) * grad * grad
        m, v = s["m"] / (1 - a ** s["t"]), s["v"] / (1 - b ** s["t"])
        if g["amsgrad"]:
            v = s["top"] = np.maximum(s.get("top", 0.0), v)
        return p - g["lr"] * m / (np.sqrt(v) + g["eps"])


class AdamW(Adam):
    defaults = {**Adam.defaults, "weight_decay": 0.01}
    coupled = False


class RMSProp(Optimizer):
    defaults = {"alpha": 0.99, "eps": 1e-8, "weight_decay": 0.0, "momentum": 0.0, "centered": False}

    def __init__(self, params, lr=0.01, **options):
        super().__init__(params, lr, **options)

    def _update(self, p, grad, s, g):
        grad = grad + g["weight_decay"] * p
        s["v"] = g["alpha"] * s.get("v", 0.0) + (1 - g["alpha"]) * grad * grad
        v = s["v"]
        if g["centered"]:
            s["m"] = g["alpha"] * s.get("m", 0.0) + (1 - g["alpha"]) * grad
            v = v - s["m"] * s["m"]
        step = grad / np.sqrt(v + g["eps"])
        if g["momentum"]:
            step = s["b"] = g["momentum"] * s.get("b", 0.0) + step
        return p - g["lr"] * step


class Adagrad(Optimizer):
    defaults = {"lr_decay": 0.0, "eps": 1e-10, "weight_decay": 0.0, "initial_accumulator_value": 0.0}

    def __init__(self, params, lr=0.01, **options):
        super().__init__(params, lr, **options)

    def _update(self, p, grad, s, g):
        grad = grad + g["weight_decay"] * p
        s["t"] = s.get("t", 0) + 1
        s["sum"] = s.get("sum", g["initial_accumulator_value"]) + grad * grad
        return p - g["lr"] / (1 + (s["t"] - 1) * g["lr_decay"]) * grad / (np.sqrt(s["sum"]) + g["eps"])


def clip_grad_norm(grads: dict[str, np.ndarray], max_norm: float, norm_type: float = 2.0) -> float:
    """Scales all gradients in place so that their common norm is no more than max_norm; returns the norm before."""
    flat = np.concatenate([np.ravel(np.abs(g)) for g in grads.values()]) if grads else np.zeros(1)
    norm = float(flat.max() if math.isinf(norm_type) else (flat**norm_type).sum() ** (1 / norm_type))
    scale = max_norm / (norm + 1e-6)
    if scale < 1:
        for n in grads:
            grads[n] = np.asarray(grads[n]) * scale
    return norm


def clip_grad_value(grads: dict[str, np.ndarray], value: float) -> None:
    for n in grads:
        grads[n] = np.clip(grads[n], -value, value)


class LRScheduler:
    """step() moves to the next epoch and sets each group's rate, from its own base rate (``base``) and its rate so far (``lr``).
    The constructor takes the first step, to epoch 0."""

    def __init__(self, optimizer: Optimizer, last_epoch: int = -1):
        self.optimizer, self.base, self.epoch = optimizer, [g["lr"] for g in optimizer.groups], last_epoch
        self.step()

    def rate(self, base: float, lr: float) -> float:
        raise NotImplementedError

    def rates(self) -> list[float]:
        return [self.rate(b, g["lr"]) for b, g in zip(self.base, self.optimizer.groups, strict=True)]

    def step(self) -> None:
        self.epoch += 1
        for g, rate in zip(self.optimizer.groups, self.rates(), strict=True):
            g["lr"] = rate


class StepLR(LRScheduler):
    def __init__(self, optimizer, step_size: int, gamma: float = 0.1):
        self.size, self.gamma = step_size, gamma
        super().__init__(optimizer)

    def rate(self, base, lr):
        return lr * (self.gamma if self.epoch > 0 and self.epoch % self.size == 0 else 1)


class MultiStepLR(LRScheduler):
    def __init__(self, optimizer, milestones: list[int], gamma: float = 0.1):
        self.milestones, self.gamma = set(milestones), gamma
        super().__init__(optimizer)

    def rate(self, base, lr):
        return lr * (self.gamma if self.epoch in self.milestones else 1)


class ExponentialLR(LRScheduler):
    def __init__(self, optimizer, gamma: float):
        self.gamma = gamma
        super().__init__(optimizer)

    def rate(self, base, lr):
        return lr * (self.gamma if self.epoch > 0 else 1)


class CosineAnnealingLR(LRScheduler):
    def __init__(self, optimizer, T_max: int, eta_min: float = 0.0):
        self.T, self.low = T_max, eta_min
        super().__init__(optimizer)

    def rate(self, base, lr):
        return self.low + (base - self.low) * (1 + math.cos(math.pi * self.epoch / self.T)) / 2


class CosineAnnealingWarmRestarts(LRScheduler):
    """The constructor's step counts: the first rate is that of place 1 in the cycle."""

    def __init__(self, optimizer, T_0: int, T_mult: int = 1, eta_min: float = 0.0):
        self.T, self.mult, self.low, self.place = T_0, T_mult, eta_min, 0
        super().__init__(optimizer)

    def step(self):
        self.place += 1
        if self.place >= self.T:
            self.place, self.T = self.place - self.T, self.T * self.mult
        super().step()

    def rate(self, base, lr):
        return self.low + (base - self.low) * (1 + math.cos(math.pi * self.place / self.T)) / 2


class LinearLR(LRScheduler):
    def __init__(self, optimizer, start_factor: float = 1 / 3, end_factor: float = 1.0, total_iters: int = 5):
        self.a, self.b, self.n = start_factor, end_factor, total_iters
        super().__init__(optimizer)

    def rate(self, base, lr):
        return base * (self.a + (self.b - self.a) * min(self.epoch, self.n) / self.n)


class WarmupScheduler(LRScheduler):
    """Up to the base rates in warmup_epochs; then what after_scheduler says, which is stepped with each epoch, too."""

    def __init__(self, optimizer, warmup_epochs: int, after_scheduler: LRScheduler | None = None):
        self.n, self.after = warmup_epochs, after_scheduler
        super().__init__(optimizer)

    def rate(self, base, lr):
        return base * min(self.epoch + 1, self.n) / self.n if self.n else base

    def rates(self):
        if self.epoch < self.n or self.after is None:
            return super().rates()
        rates = self.after.rates()
        self.after.step()
        return rates


class ReduceLROnPlateau:
    def __init__(self, optimizer, mode: str = "min", factor: float = 0.1, patience: int = 10, threshold: float = 1e-4, min_lr: float = 0.0):
        self.optimizer, self.sign, self.factor, self.patience, self.threshold, self.min_lr = optimizer, 1 if mode == "min" else -1, factor, patience, threshold, min_lr
        self.best, self.bad = math.inf, 0

    def step(self, metric: float) -> None:
        value = self.sign * metric
        if value < self.best - self.threshold:
            self.best, self.bad = value, 0
            return
        self.bad += 1
        if self.bad > self.patience:
            self.bad = 0
            for g in self.optimizer.groups:
                g["lr"] = max(g["lr"] * self.factor, self.min_lr)
