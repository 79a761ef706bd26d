"""Principal components of standardised features, their contributions and group ellipses."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import f_critical
from ..plans.staging import stage, unstage

EXTRA = 8  # columns of a basis block beyond the wanted axes
BLOCKS = 6  # basis blocks before a restart
CELLS = 1 << 22  # numbers in a block of samples (32 MB)
_PART = 1 << 16  # numbers in a row on the way to the driver


class PcaResult(NamedTuple):
    eigen: DataFrame  # dim, eigenvalue, pct, cum_pct
    scores: DataFrame  # the sample columns, pc1 .. pck
    loadings: DataFrame  # feature, dim, loading


def _blocks(rows: DataFrame, centre: np.ndarray, factor: np.ndarray) -> DataFrame:
    """Standardised samples, packed into blocks of at most CELLS numbers; staged."""
    most = max(1, CELLS // len(centre))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), most):
                z = (np.stack(pdf["_x"].iloc[at : at + most].to_numpy()) - centre) * factor
                yield pd.DataFrame({"cells": [z.tobytes()]})

    return stage(rows.select("_x").mapInPandas(run, "cells binary"))


def _times(blocks: DataFrame, basis: np.ndarray) -> np.ndarray:
    """Z' Z basis for the samples Z in the blocks: every task adds up its own, Spark the tasks."""
    spark, (width, columns) = blocks.sparkSession, basis.shape
    held = spark.sparkContext.broadcast(basis)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, columns))
        for pdf in batches:
            for cells in pdf["cells"]:
                z = np.frombuffer(cells).reshape(-1, width)
                total += z.T @ (z @ held.value)
        flat = total.ravel()
        for part, at in enumerate(range(0, len(flat), _PART)):
            yield pd.DataFrame({"part": [part], "s": [flat[at : at + _PART]]})

    parts = blocks.mapInPandas(run, "part int, s array<double>").groupBy("part")
    rows = parts.agg(Summarizer.sum(array_to_vector("s")).alias("v")).orderBy("part").toLocalIterator()
    out = np.concatenate([r["v"].toArray() for r in rows]).reshape(width, columns)
    held.unpersist()
    return out


def leading_axes(times, width: int, k: int, tolerance: float = 1e-11, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric matrix that is known only by
    ``times(block)``, its product with a block of ``k + EXTRA`` columns.

    Subspace iteration that keeps its last blocks: the product with the newest block, made orthogonal
    to all before, is the next block, and the matrix is solved exactly within their span (Rayleigh
    and Ritz). After BLOCKS of them the best vectors start a new basis. It ends when the wanted
    vectors are eigenvectors to within ``tolerance`` of the largest eigenvalue.
    """
    columns = min(width, k + EXTRA)
    start = np.random.default_rng(0).normal(size=(width, columns))
    basis = np.linalg.qr(start)[0]
    image = times(basis)
    for _ in range(rounds):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:columns]
        values, turn = values[order], turn[:, order]
        vectors, images = basis @ turn, image @ turn
        rest = images - vectors * values
        off = np.linalg.norm(rest[:, :k], axis=0)
        if basis.shape[1] == width or (off <= tolerance * max(values[0], 1e-300)).all():
            return values[:k], vectors[:, :k]
        if basis.shape[1] > (BLOCKS - 1) * columns:
            basis, image = vectors, images
        # what of the newest direction the basis does not hold yet, twice for rounding
        new = rest[:, : min(columns, width - basis.shape[1])]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
            new = np.linalg.qr(new)[0]
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
    raise ArithmeticError(f"no {k} axes found in {rounds} rounds")


def pca(
    df: DataFrame, sample: list[str], vector: str, k: int, features: list[str] | None = None
) -> PcaResult:
    """Components of the correlation matrix of packed samples.

    Eigenvalues add up to the number of features that vary; features that do not have loading 0. The
    matrix itself is never made: samples are standardised once, in blocks, and multiplied with a
    basis of ``k + EXTRA`` columns until its leading axes stand still. What reaches the driver is
    width x (k + EXTRA) numbers a round, and it keeps BLOCKS of these. Each component is turned so
    that its largest loading is positive.
    """
    rows = stage(df.select(*sample, F.col(vector).cast("array<double>").alias("_x")))
    vec = array_to_vector("_x")
    moments = rows.select(vec.alias("v")).agg(
        F.count("*").alias("n"), Summarizer.mean(F.col("v")).alias("m"), Summarizer.std(F.col("v")).alias("s")
    ).first()
    count, centre, spread = moments["n"], moments["m"].toArray(), moments["s"].toArray()
    width, varying = len(centre), int(np.count_nonzero(spread))
    if not 1 <= k <= width:
        raise ValueError(f"{k} axes of {width} features")
    factor = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)
    blocks = _blocks(rows, centre, factor)
    values, axes = leading_axes(lambda basis: _times(blocks, basis) / (count - 1), width, k)
    unstage(blocks)
    values = np.maximum(values, 0.0)
    turn = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    axes = axes * turn
    share = values / max(varying, 1)
    spark = df.sparkSession
    eigen = spark.createDataFrame(
        [
            (i + 1, float(values[i]), float(100 * s), float(100 * share[: i + 1].sum()))
            for i, s in enumerate(share)
        ],
        "dim int, eigenvalue double, pct double, cum_pct double",
    )
    names = features or [str(i) for i in range(width)]
    loadings = spark.createDataFrame(
        [(names[r], c + 1, float(axes[r, c])) for r in range(width) for c in range(k)],
        "feature string, dim int, loading double",
    )
    # scores refer to the population standard deviation
    held = spark.sparkContext.broadcast((centre, factor[:, None] * axes * math.sqrt(count / (count - 1))))

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        middle, along = held.value
        for x in batches:
            yield pd.Series(list((np.stack(x.to_numpy()) - middle) @ along) if len(x) else [], dtype=object)

    projected = rows.withColumn("_y", project("_x"))
    scores = projected.select(*sample, *[F.col("_y")[i].alias(f"pc{i + 1}") for i in range(k)])
    return PcaResult(eigen, scores, loadings)


def pca_contributions(result: PcaResult, k: int = 10, dims: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Features contributing most to the given axes together, in percent."""
    joined = result.loadings.where(F.col("dim").isin(list(dims))).join(result.eigen, "dim")
    share = F.sum(F.col("eigenvalue") * 100 * F.col("loading") ** 2) / F.sum("eigenvalue")
    return (
        joined.groupBy("feature")
        .agg(share.alias("contrib"))
        .orderBy(F.desc("contrib"), "feature")
        .limit(k)
    )


def group_ellipse(scores: DataFrame, group: str, x: str = "pc1", y: str = "pc2", conf: float = 0.95) -> DataFrame:
    """Centre, covariance and confidence ellipse of each group on two axes.

    ``radius`` is that of the ``conf`` ellipse in units of the covariance, sqrt(2 F(2, n - 1)); ``major``
    and ``minor`` are the half axes, ``angle`` that of the major one against the x axis in radians,
    from -pi/2 to pi/2. Groups of fewer than two points have no ellipse.
    """
    made = scores.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("cx"),
        F.avg(y).alias("cy"),
        F.var_samp(x).alias("vxx"),
        F.var_samp(y).alias("vyy"),
        F.covar_samp(x, y).alias("vxy"),
    )
    left = F.when(F.col("n") > 1, F.col("n") - 1).cast("double")
    radius = F.sqrt(2 * f_critical(F.lit(1.0 - conf), F.lit(2.0), left))
    middle, apart = (F.col("vxx") + F.col("vyy")) / 2, (F.col("vxx") - F.col("vyy")) / 2
    swing = F.sqrt(apart * apart + F.col("vxy") * F.col("vxy"))
    out = made.withColumn("radius", radius)
    return out.withColumns(
        {
            "major": F.col("radius") * F.sqrt(middle + swing),
            "minor": F.col("radius") * F.sqrt(F.greatest(middle - swing, F.lit(0.0))),
            "angle": F.atan2("vxy", apart) / 2,
        }
    )
