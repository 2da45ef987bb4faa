"""A small matrix language: text is parsed to a plan of DataFrames; nothing runs until a result is used."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix as m

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|([-+*/%#=(),:|\[\]]))")


class Session:
    """Variables by name, each (kind, value): scalar (float), vector (i, v), sparse (i, j, v) or chain (list of sparse).

    `name = expression` assigns; a product of sparse matrices is kept as a chain and applied to vectors from the right.
    Functions: transpose(A), norm(A), size(x), sum(x), identity(n), sqrt, sin, cos, tan, log. a:b is a range.
    """

    def __init__(self, spark: SparkSession, variables: dict | None = None):
        self.spark, self.variables = spark, dict(variables or {})

    def run(self, text: str):
        result = None
        for line in filter(None, (x.strip() for x in re.split(r"[;\n]", text))):
            name = re.match(r"([A-Za-z_]\w*)\s*=(?!=)", line)
            self.tokens = self._tokens(line[name.end() :] if name else line)
            result = self._range()
            if self.tokens:
                raise ValueError(f"left over: {self.tokens}")
            if name:
                self.variables[name[1]] = result
        return result

    @staticmethod
    def _tokens(text: str) -> list[str]:
        out, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = TOKEN.match(text, at)
            if not found:
                raise ValueError(f"can't read {text[at:]!r}")
            out.append(found[1] or found[2] or found[3])
            at = found.end()
        return out

    def _next(self, *wanted: str) -> str | None:
        return self.tokens.pop(0) if self.tokens and (not wanted or self.tokens[0] in wanted) else None

    def _range(self):
        first = self._sum()
        if self._next(":"):
            a, b = int(first[1]), int(self._sum()[1])
            step = 1 if b >= a else -1
            rows = self.spark.range(abs(b - a) + 1).select(F.col("id").alias("i"), (F.lit(a) + step * F.col("id")).cast("double").alias("v"))
            return "vector", rows
        return first

    def _sum(self):
        left = self._product()
        while sign := self._next("+", "-"):
            left = self._add(left, self._product(), 1.0 if sign == "+" else -1.0)
        return left

    def _product(self):
        left = self._atom()
        while sign := self._next("*", "/", "%"):
            right = self._atom()
            left = self._times(left, right) if sign == "*" else self._divide(left, right, sign)
        return left

    def _atom(self):
        token = self._next()
        if token is None:
            raise ValueError("the expression ends early")
        if token == "-":
            return self._times(("scalar", -1.0), self._atom())
        if token == "(":
            value = self._range()
            self._close(")")
            return value
        if token == "|":
            value = self._range()
            self._close("|")
            return ("scalar", abs(value[1])) if value[0] == "scalar" else ("scalar", m.norm(value[1]).first()[0])
        if re.match(r"\d", token):
            return "scalar", float(token)
        if self._next("("):
            value = self._range()
            self._close(")")
            return self._call(token, value)
        if token not in self.variables:
            raise ValueError(f"{token} isn't defined")
        return self.variables[token]

    def _close(self, mark: str) -> None:
        if not self._next(mark):
            raise ValueError(f"{mark!r} is expected")

    def _call(self, name: str, x):
        kind, value = x
        if name == "transpose":
            return kind, [m.transpose(a) for a in reversed(value)] if kind == "chain" else m.transpose(value)
        if name == "identity":
            return "sparse", m.identity(self.spark, int(value))
        if name in ("norm", "sum", "size"):
            how = {"norm": F.sqrt(F.sum(F.col("v") * F.col("v"))), "sum": F.sum("v"), "size": F.count("*")}[name]
            return "scalar", float(value.agg(how).first()[0] or 0.0)
        if name in ("sqrt", "sin", "cos", "tan", "log"):
            import math

            return (kind, getattr(math, name)(value)) if kind == "scalar" else (kind, value.withColumn("v", getattr(F, name)("v")))
        raise ValueError(f"{name} isn't a function")

    def _times(self, a, b):
        (ka, x), (kb, y) = a, b
        if ka == kb == "scalar":
            return "scalar", x * y
        if ka == "scalar":
            return (kb, [m.scaled(y[0], x), *y[1:]]) if kb == "chain" else (kb, y.withColumn("v", F.col("v") * x))
        if kb == "scalar":
            return self._times(b, a)
        if kb == "vector":
            if ka == "vector":
                joined = x.join(y.withColumnRenamed("v", "_v"), "i")
                return "scalar", float(joined.agg(F.sum(F.col("v") * F.col("_v"))).first()[0] or 0.0)
            return "vector", m.apply_chain(x if ka == "chain" else [x], y)
        if ka == "vector":
            return "vector", m.apply_chain([m.transpose(s) for s in reversed(y)] if kb == "chain" else [m.transpose(y)], x)
        return "chain", [*(y if kb == "chain" else [y]), *(x if ka == "chain" else [x])]  # the right one is applied first

    def _divide(self, a, b, sign: str):
        if b[0] != "scalar":
            raise ValueError("only a scalar divides")
        if sign == "/":
            return self._times(a, ("scalar", 1 / b[1]))
        if a[0] == "scalar":
            return "scalar", a[1] - b[1] * int(a[1] / b[1])
        return a[0], a[1].withColumn("v", F.col("v") - b[1] * (F.col("v") / b[1]).cast("long"))

    def _add(self, a, b, scale: float):
        (ka, x), (kb, y) = a, b
        if ka == kb == "scalar":
            return "scalar", x + scale * y
        if ka == "scalar":
            return self._add(self._times(("scalar", scale), b), a, 1.0)
        if kb == "scalar":
            if ka == "vector":
                return ka, x.withColumn("v", F.col("v") + scale * y)
            size = m.dimensions(x).first()
            return ka, m.add_scalar(x, size["m"], size["n"], scale * y)
        if ka == kb == "vector":
            return "vector", x.unionByName(y.withColumn("v", F.col("v") * scale)).groupBy("i").agg(F.sum("v").alias("v"))
        if ka == "sparse" and kb == "vector":
            return "sparse", m.add_diagonal(x, y.withColumn("v", F.col("v") * scale))
        if ka == kb == "sparse":
            return "sparse", m.add(x, y, scale)
        raise ValueError(f"{ka} and {kb} don't add")

    def __getitem__(self, name: str) -> DataFrame | float:
        return self.variables[name][1]
