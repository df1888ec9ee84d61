"""The page model: one sigmoid unit on page vectors, trained by mini-batches with staged rates and soft targets.

Pages are dealt into parts by a hash of their id. In each stage every part goes through its pages in mini-batches from the weights
that the stage began with, and the parts' weights are averaged by their pages; so a stage is one Spark job, and a table
that fits into one part is trained exactly as by a single sequence of steps. Shuffles and dropped inputs come from the
seed, the stage and the part: every run gives the same weights.

Pages without a vector are left out. Without a labelled page, the unit keeps the weights it has (zeros: all scores 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a part, about: what one task holds and walks through in order.
PART_PAGES = 4_096
#: Pages of a step (fixed values): in passes over labelled pages; labelled and unlabelled in mixed steps.
PER_STEP, LABELLED, UNLABELLED = 4, 24, 8


@dataclass(frozen=True)
class Stage:
    """``passes`` over the labelled pages of a part at ``rate``; ``mixed`` steps take unlabelled pages with soft targets along."""

    rate: float
    passes: int
    mixed: bool = False


FIRST_STAGES = (Stage(0.5, 10), Stage(0.1, 10), Stage(0.02, 10))
SOFT_STAGES = (Stage(0.05, 10, mixed=True), Stage(0.01, 10, mixed=True))


@dataclass
class SigmoidUnit:
    size: int
    drop: float = 0.5
    seed: int = 7
    weights: np.ndarray = field(default=None)
    stages_done: int = 0

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = np.zeros(self.size + 1)  # the bias is the last one

    def score(self, pages: DataFrame, key: str = "page_id") -> DataFrame:
        """(key, score) of every page (key, vector) that has a vector."""
        weights = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sigmoid(x @ weights[: x.shape[1]] + weights[-1]))], names=[key, "score"])

        kind = pages.schema[key].dataType.simpleString()
        return pages.select(key, F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL").mapInArrow(run, f"{key} {kind}, score double")

    def train(self, pages: DataFrame, stages: tuple[Stage, ...]) -> SigmoidUnit:
        """Go through ``stages`` with pages (page_id, vector, target, known); target is a probability, known false for unlabelled pages."""
        rows = pages.select("page_id", F.col("vector").cast("array<double>").alias("vector"), F.col("target").cast("double").alias("target"), "known").where("vector IS NOT NULL AND target IS NOT NULL")
        n = rows.count()
        if not rows.where("known").limit(1).count():
            return self
        parts = max(1, -(-n // PART_PAGES))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(parts)))
        for stage in stages:
            self._go_through(dealt, stage)
        return self

    def _go_through(self, dealt: DataFrame, stage: Stage) -> None:
        start, drop, seed, number = self.weights, self.drop, self.seed, self.stages_done

        def part_weights(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("page_id", ignore_index=True)
            x, target, known = np.stack(frame["vector"].to_numpy()), frame["target"].to_numpy(), frame["known"].to_numpy(bool)
            trained = walk(start, x[known], target[known], x[~known], target[~known], stage, drop, np.random.default_rng((seed, number, int(key[0]))))
            return pd.DataFrame({"i": np.arange(len(trained)), "w": trained, "n": int(known.sum())})

        sums = dealt.groupBy("part").applyInPandas(part_weights, "i int, w double, n long").groupBy("i").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n"))
        got = sums.orderBy("i").collect()  # one row per place of a vector
        self.weights = np.array([r["w"] / r["n"] for r in got])
        self.stages_done += 1


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def walk(start: np.ndarray, x: np.ndarray, y: np.ndarray, soft_x: np.ndarray, soft_y: np.ndarray, stage: Stage, drop: float, rng: np.random.Generator) -> np.ndarray:
    """Weights after the mini-batches of one stage; mixed steps go on through the unlabelled pages from step to step."""
    w = start.copy()
    per_step, at = (LABELLED if stage.mixed else PER_STEP), 0
    for _ in range(stage.passes):
        order = rng.permutation(len(x))
        for first in range(0, len(x), per_step):
            chosen = order[first : first + per_step]
            bx, by = x[chosen], y[chosen]
            if stage.mixed and len(soft_x):
                along = np.arange(at, at + UNLABELLED) % len(soft_x)
                at += UNLABELLED
                bx, by = np.concatenate([bx, soft_x[along]]), np.concatenate([by, soft_y[along]])
            if drop:
                bx = np.where(rng.random(bx.shape) >= drop, bx / (1 - drop), 0.0)
            error = sigmoid(bx @ w[:-1] + w[-1]) - by
            w[:-1] -= stage.rate * (error @ bx) / len(by)
            w[-1] -= stage.rate * error.mean()
    return w


def pseudo_labelled(labelled: DataFrame, unlabelled: DataFrame, size: int, drop: float = 0.5, seed: int = 7, first: tuple[Stage, ...] = FIRST_STAGES, soft: tuple[Stage, ...] = SOFT_STAGES) -> SigmoidUnit:
    """A unit trained on ``labelled`` (page_id, vector, label), then further on both with its own scores as the targets of ``unlabelled``."""
    known = labelled.select("page_id", "vector", F.col("label").cast("double").alias("target"), F.lit(True).alias("known"))
    unit = SigmoidUnit(size, drop, seed).train(known, first)
    scored = unlabelled.select("page_id", "vector").join(unit.score(unlabelled).dropDuplicates(["page_id"]), "page_id")
    return unit.train(known.unionByName(scored.select("page_id", "vector", F.col("score").alias("target"), F.lit(False).alias("known"))), soft)
