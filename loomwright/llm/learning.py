"""Labelled samples and hold-outs shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: places of a hash among which samples are cut: so many that the cut is fine for any number of rows
HASH_STEPS = 1 << 50


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def held_out(key: str, parts: int, part: int) -> Column:
    """Is the row's fold the one that nothing is learned from? A row without key is in no fold."""
    return F.coalesce(fold(key, parts) == part, F.lit(False))


def one_label_each(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label) of the keys whose rows agree on a label of 0 or 1."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    return (known.groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most"))
            .where("_label = _most").drop("_most"))


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows for each value of ``by``, all of them if there are fewer; chosen by a hash of the key.

    ``by`` must have few values: labels or languages.
    """
    counts = {value: count for value, count in rows.groupBy(by).count().collect()}
    share = F.lit(0)
    for value, count in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(HASH_STEPS, HASH_STEPS * most // count + 1))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(HASH_STEPS)) < share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Gradient steps of arrays that are changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first = [np.zeros_like(p) for p in params]
        self.second = [np.zeros_like(p) for p in params]

    def __call__(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        scale = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p, g, m, v in zip(self.params, gradients, self.first, self.second, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * scale * m / (np.sqrt(v) + 1e-8)
