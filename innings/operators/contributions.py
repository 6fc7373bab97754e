"""Contributions of features to the margin of boosted trees: exact Shapley values along the trees' own paths.

A tree that does not know a feature goes both ways, weighted by the training
rows that went each way. A leaf then adds its value times a product over the
features on its path: 1 or 0 for a known feature, the share of rows for an
unknown one. The Shapley value of a feature is its mean effect over all orders
in which features become known; for one leaf this is a sum over the number of
other known features on its path, found from the coefficients of a polynomial.

The trees are a bounded model and travel to the tasks; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innings.session import new_folder


@dataclass
class Leaf:
    """``value`` (times the tree's weight); per feature of the path the bounds that lead here and the share of rows."""

    value: float
    features: list[int]
    low: np.ndarray  # above it
    high: np.ndarray  # up to it
    share: np.ndarray


def _leaves(nodes: dict, weight: float) -> Iterator[Leaf]:
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            features = sorted(path)
            low, high, share = (np.array([path[f][i] for f in features]) for i in range(3))
            yield Leaf(node["prediction"] * weight, features, low, high, share)
            continue
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            part = nodes[child]["impurityStats"][0] / node["impurityStats"][0]
            bounds = (low, min(high, cut), share * part) if left else (max(low, cut), high, share * part)
            stack.append((child, {**path, f: bounds}))


def leaves(model: PipelineModel) -> list[Leaf]:
    """All leaves of the boosted trees, from the node table that the model is stored as."""
    trees, spark = model.stages[-1], SparkSession.active()
    path = new_folder(spark, "trees")
    trees.write().save(path)
    tables: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").collect():  # the nodes of one model
        tables.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"].asDict(recursive=True)
    return [leaf for t, nodes in tables.items() for leaf in _leaves(nodes, trees.treeWeights[t])]


def base(every: list[Leaf]) -> float:
    """The margin of a row of which nothing is known: the mean over the training rows."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in every))


def shapley(every: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows by features. Together with :func:`base` a row sums to its margin."""
    out = np.zeros(x.shape)
    for leaf in every:
        m = len(leaf.features)
        if not m:
            continue
        own = x[:, leaf.features]
        known = ((own > leaf.low) & (own <= leaf.high)).astype(float)
        weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        for j, feature in enumerate(leaf.features):
            # Coefficient k: the sum over sets of k known others of the products of all others.
            others = np.zeros((len(x), m))
            others[:, 0] = 1
            for i in range(m):
                if i != j:
                    others[:, 1:] = others[:, 1:] * leaf.share[i] + others[:, :-1] * known[:, i:i + 1]
                    others[:, 0] *= leaf.share[i]
            out[:, feature] += leaf.value * (known[:, j] - leaf.share[j]) * (others @ weight)
    return out


def contributions(model: PipelineModel, df: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """``key, feature, value``: one row per feature; ``margin`` is the sum of a row's values and the base."""
    every = leaves(model)
    start = base(every)
    rows = df.select(*key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                x = np.stack([part.column(f"_f{i}").to_numpy() for i in range(len(features))], axis=1)
                values = shapley(every, x)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in key), pa.array(start + values.sum(1)), pa.array(values.tolist())],
                    names=[*key, "margin", "values"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    told = rows.mapInArrow(run, f"{kinds}, margin double, values array<double>")
    named = F.arrays_zip(F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("values").alias("value"))
    return told.select(*key, "margin", F.explode(named).alias("c")).select(*key, "margin", "c.feature", "c.value")
