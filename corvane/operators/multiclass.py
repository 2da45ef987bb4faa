"""Coding matrices, decoders of binary classifiers into class probabilities, hierarchies and their control language."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nnls
from ..session import ship


def one_against_rest(n: int) -> np.ndarray:
    return 2 * np.eye(n, dtype=int) - 1


def one_against_one(n: int) -> np.ndarray:
    out = np.zeros((n * (n - 1) // 2, n), dtype=int)
    for k, (i, j) in enumerate(itertools.combinations(range(n), 2)):
        out[k, i], out[k, j] = -1, 1
    return out


def adjacent(n: int) -> np.ndarray:
    return np.where(np.arange(n) > np.arange(n - 1)[:, None], 1, -1)


def exhaustive(n: int) -> np.ndarray:
    """All splits of the classes in two, each once."""
    return np.array([[1 if (k >> (n - 1 - j)) & 1 else -1 for j in range(n)] for k in range(1, 2 ** (n - 1))])


def random_codes(n: int, rows: int, seed: int = 0, strict: bool = True) -> np.ndarray:
    """Different random rows with both signs; not strict: with zeros too."""
    rng, out, seen = np.random.default_rng(seed), [], set()
    most = 2 ** (n - 1) - 1 if strict else (3**n - 2 ** (n + 1) + 1) // 2
    while len(out) < min(rows, most):
        row = rng.choice([-1, 1] if strict else [-1, 0, 1], n)
        key = tuple(row * (row[np.flatnonzero(row)[0]] if row.any() else 1))
        if key not in seen and (row == 1).any() and (row == -1).any():
            seen.add(key)
            out.append(row)
    return np.array(out)


def orthogonal(n: int, seed: int = 0) -> np.ndarray:
    """Rows of +-1 orthogonal to each other, as many as a random search finds, up to n."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(2000 * n):
        row = rng.choice([-1, 1], n)
        if abs(row.sum()) < n and all(row @ x == 0 for x in out):
            out.append(row)
            if len(out) == n:
                break
    return np.array(out)


def codes(spark, matrix: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), int(j), int(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "row int, cls int, code int")


def vote(r: DataFrame, code: DataFrame, by_value: bool = False) -> DataFrame:
    """The class with the highest sum of code * sign(r) (or * r) over (id, row, r); ties go to the lowest class."""
    each = F.col("code") * (F.col("r") if by_value else F.signum("r"))
    sums = r.join(F.broadcast(code), "row").groupBy("id", "cls").agg(F.sum(each).alias("s"))
    return sums.groupBy("id").agg(F.max_by("cls", F.struct("s", -F.col("cls"))).alias("cls"), F.max("s").alias("s"))


def repaired(p: np.ndarray) -> np.ndarray:
    """Probabilities from estimates that sum to one with negative ones: these become 0, the others lose equally, repeatedly."""
    p = p.astype(float).copy()
    live = np.ones(len(p), dtype=bool)
    while True:
        p[live] += (1 - p[live].sum()) / live.sum()
        bad = live & (p < 0)
        if not bad.any():
            return p
        p[bad] = 0
        live &= ~bad


def simplex(p: np.ndarray) -> np.ndarray:
    """The nearest point, by Euclidean distance, that has no negative part and sums to one."""
    down = np.sort(p)[::-1]
    excess = (np.cumsum(down) - 1) / np.arange(1, len(p) + 1)
    return np.maximum(p - excess[np.flatnonzero(down > excess)[-1]], 0)


def decode(matrix: np.ndarray, r: np.ndarray, method: str = "lsq") -> np.ndarray:
    """Class probabilities from binary differences r = P(+) - P(-), one for each row of the coding matrix.

    lsq: least squares with sum 1, repaired; nnls: with p >= 0; rest: one against rest, (1 + r) / 2 normalised;
    pairs: coupling of 1-against-1 (the linear system of Wu, Lin and Weng); iterated: coupling by multiplicative updates (Zadrozny),
    for any code; projected: for orthogonal codes, the mean of code * r moved to the nearest probabilities; vote: by sums of code * sign(r);
    peaked: by sums of code * r, the winner's probability being 1.
    """
    n = matrix.shape[1]
    if method == "peaked":
        return np.eye(n)[int(np.argmax(matrix.T @ r))]
    if method == "projected":
        return simplex(matrix.T @ r / len(r))
    if method == "iterated":
        plus, minus = (matrix > 0).astype(float), (matrix < 0).astype(float)
        p, want = np.full(n, 1 / n), np.clip((1 + r) / 2, 1e-9, 1 - 1e-9)
        for _ in range(500):
            up, down = plus @ p, minus @ p
            have = up / np.maximum(up + down, 1e-300)
            better = p * (plus.T @ want + minus.T @ (1 - want)) / np.maximum(plus.T @ have + minus.T @ (1 - have), 1e-300)
            better /= better.sum()
            if np.abs(better - p).max() < 1e-12:
                return better
            p = better
        return p
    if method == "vote":
        s = matrix.T @ np.sign(r)
        return np.eye(n)[int(np.argmax(s))]
    if method == "rest":
        p = np.maximum((1 + r) / 2, 0)
        return p / p.sum() if p.sum() else np.full(n, 1 / n)
    if method == "pairs":
        q = np.zeros((n, n))
        for row, x in zip(matrix, r, strict=True):
            i, j = int(np.flatnonzero(row == -1)[0]), int(np.flatnonzero(row == 1)[0])
            pi, pj = (1 - x) / 2, (1 + x) / 2
            q[i, i] += pj * pj
            q[j, j] += pi * pi
            q[i, j] = q[j, i] = -pi * pj
        system = np.block([[q, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        return repaired(np.linalg.lstsq(system, np.r_[np.zeros(n), 1], rcond=None)[0][:n])
    # a row says sum(code p) = r sum(|code| p)
    a = matrix - np.abs(matrix) * r[:, None] if (matrix == 0).any() else matrix.astype(float)
    b = np.zeros(len(r)) if (matrix == 0).any() else r
    if method == "nnls":
        p = nnls(np.vstack([a, 1e3 * np.ones(n)]), np.r_[b, 1e3])
        return p / p.sum()
    free = np.linalg.lstsq(a[:, :-1] - a[:, -1:], b - a[:, -1], rcond=None)[0]
    return repaired(np.r_[free, 1 - free.sum()])


def probabilities(r: DataFrame, matrix: np.ndarray, method: str = "lsq") -> DataFrame:
    """(id, cls, p) from (id, row, r)."""
    ship(r.sparkSession)
    kind = r.schema["id"].dataType.simpleString()
    # where no code is 0 the equations have one matrix for all rows: it is inverted once
    inverse = None if (matrix == 0).any() else np.linalg.pinv(matrix[:, :-1] - matrix[:, -1:].astype(float))

    def _solve(rows: np.ndarray) -> list[np.ndarray]:
        if inverse is None:
            return [decode(matrix, x, "lsq") for x in rows]
        free = (rows - matrix[:, -1]) @ inverse.T
        return [repaired(p) for p in np.column_stack([free, 1 - free.sum(axis=1)])]

    def run(batches):
        import pandas as pd

        for batch in batches:
            n = matrix.shape[1]
            r = np.array([[x["r"] for x in found] for found in batch["_r"]]).reshape(-1, len(matrix))
            p = _solve(r) if method == "lsq" else [decode(matrix, x, method) for x in r]
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), n), "cls": np.tile(np.arange(n, dtype="int32"), len(batch)), "p": np.concatenate([*p, np.zeros(0)])})

    lists = r.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("row", "r"))).alias("_r"))  # as long as the matrix
    return lists.mapInPandas(run, f"id {kind}, cls int, p double")


@dataclass
class Node:
    """A model that splits classes: each branch is a class or another node."""

    options: str
    branches: list = field(default_factory=list)

    def classes(self) -> list[int]:
        return [c for b in self.branches for c in (b.classes() if isinstance(b, Node) else [b])]

    def text(self) -> str:
        return f"{self.options} {{ {' '.join(b.text() if isinstance(b, Node) else str(b) for b in self.branches)} }}"


def parse_control(text: str) -> Node:
    """`"options" { branch branch }`, where a branch is a class number or another model."""
    tokens = re.findall(r'"[^"]*"|[{}]|[^\s{}"]+', text)

    def branch(at: int):
        if re.fullmatch(r"\d+", tokens[at]) and (at + 1 >= len(tokens) or tokens[at + 1] != "{"):
            return int(tokens[at]), at + 1
        options = tokens[at]
        if tokens[at + 1] != "{":
            raise ValueError(f"'{{' is expected after {options}")
        node, at = Node(options), at + 2
        while tokens[at] != "}":
            child, at = branch(at)
            node.branches.append(child)
        return node, at + 1

    root, end = branch(0)
    if end != len(tokens):
        raise ValueError(f"left over: {tokens[end:]}")
    return root


def edges(spark, root: Node) -> DataFrame:
    """(node, side, child, cls) of a hierarchy of two-way models: side 0 or 1; child is null at a class."""
    rows, queue = [], [(0, root)]
    last = 0
    while queue:
        number, node = queue.pop(0)
        for side, b in enumerate(node.branches):
            if isinstance(b, Node):
                last += 1
                rows.append((number, side, last, None))
                queue.append((last, b))
            else:
                rows.append((number, side, None, b))
    return spark.createDataFrame(rows, "node int, side int, child int, cls int")


def route(r: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """Follows a hierarchy by the sign of (id, node, r), with probability (1 + |r|) / 2 at each node; r of 0 goes to side 0."""
    step = r.withColumns({"side": (F.col("r") > 0).cast("int"), "q": (1 + F.abs("r")) / 2}).join(F.broadcast(tree), ["node", "side"])
    now = step.where("node = 0").select("id", F.col("q").alias("p"), "child", "cls")
    for _ in range(depth - 1):
        on = step.select("id", F.col("node").alias("child"), "q", F.col("child").alias("_c"), F.col("cls").alias("_k"))
        now = now.join(on, ["id", "child"], "left").select("id", (F.col("p") * F.coalesce("q", F.lit(1.0))).alias("p"), F.col("_c").alias("child"), F.coalesce("cls", "_k").alias("cls"))
    return now.select("id", "cls", "p")


def paths(spark, root: Node) -> DataFrame:
    """(cls, length, node, branch): the branches that lead to each class, nodes numbered as by `edges`; each class's place is its own leaf.

    As long as the classes' depths together, which the control text bounds."""
    rows, queue, last = [], [(0, root, [])], 0
    while queue:
        number, node, way = queue.pop(0)
        for k, b in enumerate(node.branches):
            here = [*way, (number, k)]
            if isinstance(b, Node):
                last += 1
                queue.append((last, b, here))
            else:
                rows += [(b, len(here), n, side) for n, side in here]
    return spark.createDataFrame(rows, "cls int, length int, node int, branch int")


def class_probabilities(p: DataFrame, way: DataFrame) -> DataFrame:
    """(id, cls, p) of every class from (id, node, branch, p), the conditional probabilities of each node's branches: the product along the class's path.

    A node may have any number of branches. One join with the paths, which are broadcast, and one grouping, whatever the depth. A class on whose path an id has
    no probability, or a null one, gets none for that id. (id, node, branch) must be unique."""
    each = p.select("id", "node", "branch", F.col("p").cast("double").alias("p")).where(F.col("p").isNotNull())
    met = each.join(F.broadcast(way), ["node", "branch"]).groupBy("id", "cls", "length")
    found = met.agg(F.count("*").alias("_n"), F.product("p").alias("p")).where("_n = length")
    return found.select("id", "cls", "p")


def route_branches(p: DataFrame, way: DataFrame) -> DataFrame:
    """(id, cls, p): follows each node's likeliest branch, the first of several, from the top to a class, and multiplies the probabilities on the way.

    This needn't be the likeliest class of `class_probabilities`. The input is as there; ids that lack the winner's node get no class."""
    won = p.where(F.col("p").isNotNull()).groupBy("id", "node").agg(F.max_by("branch", F.struct("p", -F.col("branch"))).alias("branch"), F.max("p").alias("p"))
    return class_probabilities(won, way)
