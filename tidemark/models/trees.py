"""Gradient-boosted trees with Poisson loss: each level of a tree is one aggregation by node, feature and bin."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


@dataclass
class Boosted:
    start: float
    trees: list[list[dict]] = field(default_factory=list)

    def score(self) -> Column:
        """The logarithm of the mean."""
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + leaf(tree, 0)
        return out


def leaf(tree: list[dict], node: int) -> Column:
    n = tree[node]
    if "value" in n:
        return F.lit(n["value"])
    x = F.col(n["feature"])
    return F.when(x.isNull() | (x <= n["at"]), leaf(tree, n["left"])).otherwise(leaf(tree, n["right"]))


def of_bin(tree: list[dict], node: int, features: Sequence[str], leaves: bool) -> Column:
    """The node of a row of bins or, with ``leaves``, its leaf's value."""
    n = tree[node]
    if "left" not in n:
        return F.lit(n["value"] if leaves else node)
    return F.when(F.col(f"__b{features.index(n['feature'])}") <= n["bin"], of_bin(tree, n["left"], features, leaves)).otherwise(of_bin(tree, n["right"], features, leaves))


def fit(rows: DataFrame, features: Sequence[str], target: str, trees: int = 10, depth: int = 2, rate: float = 0.2, bins: int = 32, least: float = 20.0, penalty: float = 1.0) -> Boosted:
    """Cuts are approximate quantiles of the training rows. Rows come down to cells: distinct bins with their number and the sum of
    targets, at most ``bins`` to the power of the features, whatever the number of rows. Each level of a tree aggregates the cells,
    which carry the running score and are written again after each tree. Only sums by node, feature and bin reach the driver. Rows
    without a target take no part; a null feature lies in the lowest bin."""
    known = rows.filter(F.col(target).isNotNull())
    cuts = dict(zip(features, known.approxQuantile(list(features), [i / bins for i in range(1, bins)], 0.001), strict=True))
    cuts = {f: sorted(set(c)) for f, c in cuts.items()}

    def bin_of(f: str) -> Column:
        return F.when(F.col(f).isNull(), 0).otherwise(sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)))

    placed = known.select(*(bin_of(f).alias(f"__b{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("__y"))
    cells = written(placed.groupBy(*(f"__b{i}" for i in range(len(features)))).agg(F.count("*").alias("__n"), F.sum("__y").alias("__s")), "trees-cells")
    whole = cells.agg(F.sum("__s") / F.sum("__n")).first()[0] or 1.0
    model = Boosted(float(np.log(max(whole, 1e-9))))
    cells = cells.withColumn("__f", F.lit(model.start))

    for _ in range(trees):
        tree: list[dict] = [{}]
        open_nodes = [0]
        for level in range(depth + 1):
            at = cells.withColumn("__node", of_bin(tree, 0, features, False)).withColumn("__mu", F.col("__n") * F.exp("__f"))
            long = at.select("__node", "__mu", "__s", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"__b{i}").alias("b")) for i in range(len(features))))).alias("x"))
            sums = long.groupBy("__node", "x.f", "x.b").agg(F.sum(F.col("__s") - F.col("__mu")).alias("g"), F.sum("__mu").alias("h")).collect()
            fresh = []
            for node in open_nodes:
                mine = [r for r in sums if r["__node"] == node]
                g, h = (sum(r[k] for r in mine if r["f"] == 0) for k in ("g", "h"))
                best = (1e-9, None, None, None)
                for i, f in enumerate(features):
                    left_g = left_h = 0.0
                    by_bin = {r["b"]: r for r in mine if r["f"] == i}
                    for b, cut in enumerate(cuts[f]):
                        if b in by_bin:
                            left_g, left_h = left_g + by_bin[b]["g"], left_h + by_bin[b]["h"]
                        if min(left_h, h - left_h) < least:
                            continue
                        gain = left_g**2 / (left_h + penalty) + (g - left_g) ** 2 / (h - left_h + penalty) - g**2 / (h + penalty)
                        best = max(best, (gain, f, cut, b), key=lambda t: t[0])
                if level == depth or best[1] is None:
                    tree[node] = {"value": float(rate * g / (h + penalty))}
                    continue
                tree[node] = {"feature": best[1], "at": best[2], "bin": best[3], "left": len(tree), "right": len(tree) + 1}
                fresh += [len(tree), len(tree) + 1]
                tree += [{}, {}]
            open_nodes = fresh
            if not fresh:
                break
        model.trees.append(tree)
        if len(model.trees) < trees:
            cells = written(cells.withColumn("__f", F.col("__f") + of_bin(tree, 0, features, True)), "trees-score")
    return model
