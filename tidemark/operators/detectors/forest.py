"""Isolation forest: trees grown on bounded samples, paths walked in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detectors.common import batch_column, held
from tidemark.operators.neighbors import matrix
from tidemark.operators.sampling import DRAW, draw, enough, fixed_sample

EULER = 0.5772156649

#: Rows that walk the trees together, so that their features stay in a core's cache.
WALKED_ROWS = 2048


def path_correction(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    full = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


@dataclass(frozen=True)
class IsolationForest:
    """Node tables of all trees; at most 2 * sample - 1 nodes per tree."""

    sample: int
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        """Trees are walked level by level over flat tables; a leaf leads to itself."""
        trees, width = self.feature.shape
        here = np.arange(trees * width).reshape(trees, width)
        first = here[:, :1]
        leaf = self.feature < 0
        feature = np.where(leaf, 0, self.feature).astype(np.intp).ravel()
        split, value = self.split.ravel(), self.value.ravel()
        sides = [np.where(leaf, here, first + side) for side in (self.right, self.left)]
        child = np.stack(sides, axis=-1).astype(np.intp).ravel()
        total = np.zeros(len(x))
        for at in range(0, len(x), WALKED_ROWS):
            part = np.ascontiguousarray(x[at : at + WALKED_ROWS])
            flat, start = part.ravel(), np.arange(len(part)) * part.shape[1]
            for t in range(trees):
                node = np.full(len(part), t * width)
                for _ in range(self.depth):
                    goes_left = flat.take(start + feature.take(node)) < split.take(node)
                    node = child.take(2 * node + goes_left)
                total[at : at + WALKED_ROWS] += value.take(node)
        mean = total / trees
        return np.power(2.0, -mean / float(path_correction(self.sample)))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, split, left, right, path value); a leaf has feature -1."""
    nodes: list[list] = []
    pending = [(np.arange(len(x)), 0, -1, False)]
    while pending:
        rows, depth, parent, is_left = pending.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][2 if is_left else 3] = here
        whole = depth >= limit or len(rows) <= 1
        if not whole:
            low, high = x[rows].min(0), x[rows].max(0)
            open_features = np.flatnonzero(high > low)
        if whole or not len(open_features):
            nodes.append([-1, 0.0, 0, 0, depth + float(path_correction(len(rows)))])
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = x[rows, f] < cut
        nodes.append([f, cut, 0, 0, 0.0])
        pending.append((rows[goes_left], depth + 1, here, True))
        pending.append((rows[~goes_left], depth + 1, here, False))
    return [tuple(n) for n in nodes]


def fit(
    df: DataFrame, row_id: list[str], array: str = "features", trees: int = 200, sample: int = 1024, seed: int = 42
) -> IsolationForest:
    """Grow each tree on its own sample of at most ``sample`` rows.

    A hash sample of trees * sample rows is drawn first (it bounds the work whatever the
    size of the table); from it every tree takes the rows with its smallest hashes.
    """
    slim = df.select(*row_id, array)
    pool = fixed_sample(slim, row_id, trees * sample, seed)
    with held(pool) as pool:
        size = pool.count()
        psi = min(sample, size)
        share = enough(psi, size)
        u = lambda tree: draw(row_id, seed + 1, tree)
        picks = pool.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: u(t) < share)))
        ordered = Window.partitionBy("tree").orderBy(u(F.col("tree")), *row_id)
        chosen = picks.withColumn(DRAW, F.row_number().over(ordered)).filter(F.col(DRAW) <= psi)
        limit = max(1, math.ceil(math.log2(max(psi, 2))))

        def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            rng = np.random.default_rng([seed, int(key[0])])
            x = matrix(group.sort_values(row_id)[array])
            table = pd.DataFrame(_grow(x, rng, limit), columns=["feature", "split", "left", "right", "value"])
            return table.assign(tree=int(key[0]), node=np.arange(len(table)))

        schema = "feature int, split double, left int, right int, value double, tree int, node int"
        grown = chosen.select("tree", *row_id, array).groupBy("tree").applyInPandas(grow, schema).toPandas()
    return _assemble(grown, trees, psi, limit)


def _assemble(grown: pd.DataFrame, trees: int, psi: int, limit: int) -> IsolationForest:
    width = int(grown["node"].max()) + 1
    tables = {}
    for name, kind in (("feature", np.int32), ("split", float), ("left", np.int32), ("right", np.int32), ("value", float)):
        table = np.full((trees, width), -1 if name == "feature" else 0, dtype=kind)
        table[grown["tree"], grown["node"]] = grown[name]
        tables[name] = table
    return IsolationForest(psi, depth=limit + 1, **tables)


def score(df: DataFrame, forest: IsolationForest, array: str = "features", out: str = "score") -> DataFrame:
    """2^(-mean path / c(sample)) per row."""
    sent = df.sparkSession.sparkContext.broadcast(forest)
    return df.withColumn(out, batch_column(lambda x: sent.value.score_matrix(x))(F.col(array)))
