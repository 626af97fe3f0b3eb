"""Differentiable expressions over columns.

A Tensor is a scalar expression of the row: columns, constants and named parameters. Nothing is computed until it is asked for;
``column`` compiles it, and ``gradients`` walks it backwards symbolically, so that the gradients of a loss with respect to all
parameters are one aggregate over the table, whatever its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise as E


class Tensor:
    """op(*args), with the keyword constants of the op. Leaves: 'column', 'const', 'param'."""

    __hash__ = object.__hash__

    def __init__(self, op: str, args: tuple = (), **extra):
        self.op, self.args, self.extra = op, args, extra

    @staticmethod
    def wrap(x) -> Tensor:
        return x if isinstance(x, Tensor) else Tensor("const", value=float(x))

    def __add__(self, o): return Tensor("add", (self, Tensor.wrap(o)))
    def __radd__(self, o): return Tensor.wrap(o) + self
    def __sub__(self, o): return Tensor("subtract", (self, Tensor.wrap(o)))
    def __rsub__(self, o): return Tensor.wrap(o) - self
    def __mul__(self, o): return Tensor("multiply", (self, Tensor.wrap(o)))
    def __rmul__(self, o): return Tensor.wrap(o) * self
    def __truediv__(self, o): return Tensor("divide", (self, Tensor.wrap(o)))
    def __rtruediv__(self, o): return Tensor.wrap(o) / self
    def __neg__(self): return Tensor("negate", (self,))
    def __pow__(self, e): return Tensor("power", (self,), exponent=float(e))
    def __gt__(self, o): return Tensor("greater", (self, Tensor.wrap(o)))
    def __lt__(self, o): return Tensor("greater", (Tensor.wrap(o), self))
    def detach(self): return Tensor("detach", (self,))
    def clip(self, low, high): return Tensor("clip", (self,), low=low, high=high)

    def __getattr__(self, name: str):
        if name in E.SLOPES or name == "abs":
            return lambda **extra: Tensor("tensor_abs" if name == "abs" else name, (self,), **extra)
        raise AttributeError(name)

    def column(self, params: dict[str, float] | None = None, done: dict | None = None) -> Column:
        """The expression, parameters at the given values."""
        done = {} if done is None else done
        if id(self) not in done:
            if self.op == "column":
                out = F.col(self.extra["name"]).cast("double")
            elif self.op == "const":
                out = F.lit(self.extra["value"])
            elif self.op == "param":
                out = F.lit(float((params or {})[self.extra["name"]]))
            else:
                a = [x.column(params, done) for x in self.args]
                if self.op == "detach":
                    out = a[0]
                elif self.op == "greater":
                    out = (a[0] > a[1]).cast("double")
                else:
                    out = getattr(E, self.op)(*a, **self.extra)
            done[id(self)] = out
        return done[id(self)]

    def order(self) -> list[Tensor]:
        """All nodes, arguments first (without recursion: depth is no limit)."""
        out, seen, todo = [], set(), [(self, False)]
        while todo:
            node, left = todo.pop()
            if left:
                out.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                todo.append((node, True))
                todo += [(a, False) for a in node.args]
        return out

    def adjoints(self, params: dict[str, float] | None = None) -> dict[int, Column]:
        """d self / d node for each node, as columns by id."""
        done: dict = {}
        grad = {id(self): F.lit(1.0)}
        for node in reversed(self.order()):
            g = grad.get(id(node))
            if g is None or not node.args:
                continue
            a = [x.column(params, done) for x in node.args]
            for arg, part in zip(node.args, node._parts(g, a), strict=True):
                if part is not None:
                    grad[id(arg)] = grad[id(arg)] + part if id(arg) in grad else part
        return grad

    def _parts(self, g: Column, a: list[Column]) -> list[Column | None]:
        match self.op:
            case "add":
                return [g, g]
            case "subtract":
                return [g, -g]
            case "multiply":
                return [g * a[1], g * a[0]]
            case "divide":
                return [E.divide(g, a[1]), -E.divide(g * a[0], a[1] * a[1])]
            case "power":
                return [g * E.power_slope(a[0], self.extra["exponent"])]
            case "clip":
                return [g * E.clip_slope(a[0], self.extra["low"], self.extra["high"])]
            case "detach" | "greater":
                return [None] * len(a)
            case _:
                return [g * E.SLOPES[self.op](a[0], **self.extra)]


def column(name: str) -> Tensor:
    return Tensor("column", name=name)


def param(name: str) -> Tensor:
    return Tensor("param", name=name)


def gradients(loss: Tensor, df: DataFrame, params: dict[str, float], mean: bool = True) -> tuple[float, dict[str, float]]:
    """The loss over all rows, averaged or summed, and its gradient for each parameter: one aggregate."""
    grad = loss.adjoints(params)
    by: dict[str, Column] = {}
    for node in loss.order():
        if node.op == "param" and id(node) in grad:
            name = node.extra["name"]
            by[name] = by[name] + grad[id(node)] if name in by else grad[id(node)]
    how = F.avg if mean else F.sum
    row = df.agg(how(loss.column(params)).alias("_loss"), *[how(c).alias(n) for n, c in by.items()]).first()
    return row["_loss"], {n: row[n] for n in by}
