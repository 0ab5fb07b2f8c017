"""Component analysis: the rows enter through covariance-sized sums, projections are row-wise."""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.arrays import root_name
from loomwright.plans.columns import filled, q
from loomwright.plans.moments import Moments, array_moments, matrix_of, moments, packed, partial_sums
from loomwright.plans.operator import Operator

# Fixed value: default kernel width is this share divided by the number of columns.
KERNEL_SHARE = 7 / 8
# more products than this go through matrix batches instead of generated code
MAX_TERMS = 200
# feature maps up to this width go through their covariance matrix
WIDE = 2_500
# directions carried along in an iteration for more than its own sake
EXTRA = 8
# numbers that a block of rows may unfold to inside a task
CELLS = 1 << 21


def same_sign(loadings: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    top = np.abs(loadings).argmax(axis=0)
    return loadings * np.where(loadings[top, range(loadings.shape[1])] < 0, -1.0, 1.0)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and loadings, largest first, signs fixed."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    return np.maximum(values[order], 0.0), same_sign(vectors[:, order])


@dataclass(frozen=True)
class Components(Operator):
    """Base of all decompositions: features are an array column or a list of number columns.

    Output columns are ``<name>_<suffix>_<k>``, or one array column ``<name>_<suffix>`` with ``as_array``.
    """

    columns: tuple[str, ...]
    n_components: int | None = None
    width: int | None = None
    as_array: bool = False
    offset: list[float] | None = None
    loadings: list[list[float]] | None = None
    seed: int = 42
    #: whether an iterative fit met its stop rule; None for fits that do not iterate
    converged: bool | None = None

    suffix = "pc"
    linear = True

    def single(self, df: DataFrame) -> bool:
        return len(self.columns) == 1 and df.schema[self.columns[0]].dataType.typeName() == "array"

    def vector(self, df: DataFrame) -> Column:
        return q(self.columns[0]).cast("array<double>") if self.single(df) else packed(df, self.columns)

    def size(self, df: DataFrame) -> int:
        if not self.single(df):
            return len(self.columns)
        if self.width:
            return self.width
        found = df.where(q(self.columns[0]).isNotNull()).select(F.size(q(self.columns[0]))).first()
        return int(found[0])

    def packed_frame(self, df: DataFrame) -> DataFrame:
        return df.select(self.vector(df).alias("_x")).where(F.col("_x").isNotNull())

    def found(self, df: DataFrame) -> Moments:
        if not self.single(df):
            return moments(df, self.columns)
        return array_moments(self.packed_frame(df), "_x", self.size(df))

    def stem(self) -> str:
        if len(self.columns) == 1:
            return self.columns[0]
        return root_name(self.columns) or self.columns[0]

    def stated(self, df: DataFrame, offset: np.ndarray, loadings: np.ndarray, **more) -> Components:
        return replace(
            self, width=self.size(df), offset=[float(v) for v in offset],
            loadings=[[float(v) for v in col] for col in loadings.T], **more,
        )

    def function(self):
        """``matrix -> matrix`` applied to each Arrow batch."""
        offset, loadings = np.array(self.offset), np.array(self.loadings).T
        return lambda x: (x - offset) @ loadings

    def weighted_sums(self, df: DataFrame) -> list[Column]:
        """Scores as plain arithmetic, for a handful of number columns."""
        x = [filled(df, c) - F.lit(m) for c, m in zip(self.columns, self.offset)]
        return [reduce(operator.add, [v * F.lit(w) for v, w in zip(x, row)]) for row in self.loadings]

    def transform(self, df: DataFrame) -> DataFrame:
        if self.loadings is None:
            raise ValueError("fit first")
        count, name = len(self.loadings), f"{self.stem()}_{self.suffix}"
        if self.linear and not self.single(df) and count * self.width <= MAX_TERMS:
            scores = self.weighted_sums(df)
            if self.as_array:
                return df.withColumn(name, F.array(*scores))
            return df.select(*[q(c) for c in df.columns], *[s.alias(f"{name}_{k}") for k, s in enumerate(scores)])
        scored = df.withColumn(name, project(self.vector(df), self.width, self.function()))
        if self.as_array:
            return scored
        new = [F.get(q(name), F.lit(k)).alias(f"{name}_{k}") for k in range(count)]
        return scored.select(*[q(c) for c in df.columns], *new)


def project(vector: Column, width: int, function) -> Column:
    """A batch-wise matrix function on an array column; NULL vectors stay NULL."""

    @F.arrow_udf("array<double>")
    def scores(column: pa.Array) -> pa.Array:
        result = function(matrix_of(column.drop_null(), width))
        ends = np.concatenate([[0], np.cumsum(np.where(column.is_valid(), result.shape[1], 0))]).astype(np.int32)
        offsets = pa.array(ends, mask=np.concatenate([np.asarray(column.is_null()), [False]]))
        return pa.ListArray.from_arrays(offsets, pa.array(result.ravel()))

    return scores(vector)


@dataclass(frozen=True)
class Pca(Components):
    """Principal components of centred data."""

    def fit(self, df: DataFrame) -> Pca:
        found = self.found(df)
        _, vectors = eigen(found.cov)
        return self.stated(df, found.mean, vectors[:, :self.n_components or len(found.mean)])


@dataclass(frozen=True)
class LowRank(Components):
    """Components of standardised data; their number is chosen in [n_min, n_max).

    The components that carry more than their share are kept: component k counts if its eigenvalue is at least the mean
    of all eigenvalues (1 for standardised data), and the number of these is moved into the range. ``explained``
    asks for the smallest number that reaches a share of the variance instead.
    """

    n_min: int | None = None
    n_max: int | None = None
    explained: float | None = None

    def fit(self, df: DataFrame) -> LowRank:
        found = self.found(df)
        sample = found.n / max(1, found.n - 1)
        spread = np.sqrt(np.diag(found.cov) * sample)
        spread[spread == 0] = 1.0
        values, vectors = eigen(found.cov / np.outer(spread, spread))
        width = len(values)
        low = min(self.n_min or min(10, width), width)
        high = max(low + 1, min(self.n_max or int(width * 0.55) or 1, width + 1))
        if self.explained:
            share = np.cumsum(values) / values.sum()
            count = int(np.searchsorted(share, self.explained) + 1)
        else:
            count = int((values >= values.mean() * (1 - 1e-9)).sum())
        count = min(max(count, low), high - 1)
        return self.stated(df, found.mean, vectors[:, :count] / spread[:, None])


@dataclass(frozen=True)
class FactorAnalysis(Components):
    """Factor model by expectation maximisation on the covariance matrix.

    Rounds touch the covariance matrix only; they end when the likelihood changes by less than ``tolerance``, and
    ``converged`` says whether that was reached.
    """

    rounds: int = 10_000
    tolerance: float = 1e-8

    suffix = "ca"

    def fit(self, df: DataFrame) -> FactorAnalysis:
        found = self.found(df)
        cov, width = found.cov, len(found.mean)
        count = self.n_components or width
        noise = np.maximum(np.diag(cov).copy(), 1e-12)
        last, converged = -math.inf, False
        for _ in range(self.rounds):
            root = np.sqrt(noise)
            values, vectors = np.linalg.eigh(cov / np.outer(root, root))
            values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
            factors = vectors * np.sqrt(np.maximum(values - 1.0, 0.0)) * root[:, None]
            noise = np.maximum(np.diag(cov) - (factors**2).sum(1), 1e-12)
            model = factors @ factors.T + np.diag(noise)
            fit = -0.5 * (np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, cov)))
            if abs(fit - last) < self.tolerance:
                converged = True
                break
            last = fit
        scaled = factors / noise[:, None]
        posterior = np.linalg.inv(np.eye(count) + factors.T @ scaled)
        return self.stated(df, found.mean, same_sign(scaled @ posterior), converged=converged)


@dataclass(frozen=True)
class Ica(Components):
    """Independent components: whitening from the covariance, then fixed-point steps.

    A step needs one sum over the rows, built task by task; the rows stay where they are. Steps end when no component
    turns by more than ``tolerance`` (1 less the cosine), at the latest after ``rounds``; ``converged`` says which.
    """

    rounds: int = 100
    tolerance: float = 1e-4

    suffix = "ic"

    def fit(self, df: DataFrame) -> Ica:
        found = self.found(df)
        values, vectors = eigen(found.cov)
        count = min(self.n_components or len(values), int((values > 1e-10 * values[0]).sum()))
        whiten = vectors[:, :count] / np.sqrt(values[:count])
        mean, width = found.mean, len(found.mean)
        turn, converged = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(count, count)))[0], False
        rows = self.packed_frame(df).persist()
        try:
            for _ in range(self.rounds):

                def step(x: np.ndarray, turn=turn) -> np.ndarray:
                    z = (x - mean) @ whiten
                    bent = np.tanh(z @ turn.T)
                    return np.concatenate([(bent.T @ z).ravel(), (1 - bent**2).sum(0)])

                acc = partial_sums(rows, "_x", width, step, count * count + count) / found.n
                new = acc[:count * count].reshape(count, count) - acc[count * count:, None] * turn
                left, _, right = np.linalg.svd(new)
                new = left @ right
                moved = np.max(np.abs(np.abs((new * turn).sum(1)) - 1))
                turn = new
                if moved < self.tolerance:
                    converged = True
                    break
        finally:
            rows.unpersist()
        return self.stated(df, mean, same_sign(whiten @ turn.T), converged=converged)


@dataclass(frozen=True)
class KernelPca(Components):
    """Kernel components over all rows, as principal components of a feature map that has the kernel as inner product.

    ``poly``: ``(gamma * x.y + bias) ** degree`` is exactly the inner product of all monomials up to ``degree``, each
    with a fixed factor. Few monomials go through their covariance; more than ``WIDE`` through orthogonal iteration, in
    which a pass over the rows multiplies the covariance with a few directions without forming it.

    ``rbf``: ``exp(-gamma * |x - y|^2)`` is the mean of ``waves`` random cosines (pairs of sine and cosine); the error of a
    kernel value has a standard deviation of at most ``1 / sqrt(2 * waves)``, whatever the number of rows.

    Iteration ends when no direction turns by more than ``tolerance`` (1 less the cosine) or after ``rounds``;
    ``converged`` says which.
    """

    kernel: str = "rbf"
    gamma: float | None = None
    degree: int = 3
    bias: float = 1.0
    waves: int = 512
    rounds: int = 100
    tolerance: float = 1e-9

    linear = False
    NAMES = {"rbf": "rbfpc", "poly": "polypc"}

    def __post_init__(self):
        if self.kernel not in self.NAMES:
            raise ValueError(f"no feature map for the kernel {self.kernel}")

    @property
    def suffix(self) -> str:  # type: ignore[override]
        return self.NAMES[self.kernel]

    def feature_map(self, width: int, gamma: float) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
        """``matrix -> features`` and the number of features."""
        if self.kernel == "rbf":
            turns = np.random.default_rng(self.seed).normal(scale=math.sqrt(2 * gamma), size=(width, self.waves))
            factor = 1 / math.sqrt(self.waves)

            def waves(x: np.ndarray) -> np.ndarray:
                angle = x @ turns
                return np.hstack([np.cos(angle), np.sin(angle)]) * factor

            return waves, 2 * self.waves
        picks = [pick for d in range(self.degree + 1) for pick in combinations_with_replacement(range(width), d)]
        factors = np.sqrt([self.term(pick, gamma) for pick in picks])
        # a monomial of degree d is one of degree d - 1 times a column
        at = {pick: k for k, pick in enumerate(picks)}
        by_degree = [[k for k, pick in enumerate(picks) if len(pick) == d] for d in range(self.degree + 1)]
        before = [np.array([at[picks[k][:-1]] for k in ks], np.int64) for ks in by_degree[1:]]
        column = [np.array([picks[k][-1] for k in ks], np.int64) for ks in by_degree[1:]]
        size = len(picks)

        def monomials(x: np.ndarray) -> np.ndarray:
            out = np.empty((len(x), size))
            out[:, 0] = 1.0
            for ks, first, last in zip(by_degree[1:], before, column):
                out[:, ks[0]:ks[-1] + 1] = out[:, first] * x[:, last]
            return out * factors

        return monomials, size

    def term(self, pick: tuple[int, ...], gamma: float) -> float:
        """The factor of a monomial in the expanded kernel: a multinomial coefficient times powers of gamma and bias."""
        ways = math.factorial(self.degree) / math.factorial(self.degree - len(pick))
        for count in Counter(pick).values():
            ways /= math.factorial(count)
        return ways * gamma ** len(pick) * self.bias ** (self.degree - len(pick))

    def fit(self, df: DataFrame) -> KernelPca:
        width = self.size(df)
        gamma = self.gamma or KERNEL_SHARE / width
        features, size = self.feature_map(width, gamma)
        rows = self.packed_frame(df).persist()
        try:
            acc = partial_sums(rows, "_x", width, _blocks(lambda x: np.r_[len(x), features(x).sum(0)], 1 + size, size), 1 + size)
            if not acc[0]:
                raise ValueError("no rows to fit on")
            count, mean = acc[0], acc[1:] / acc[0]
            wanted = min(self.n_components or width, size)
            if size <= WIDE:
                def step(x: np.ndarray) -> np.ndarray:
                    phi = features(x) - mean
                    return (phi.T @ phi).ravel()

                cov = partial_sums(rows, "_x", width, _blocks(step, size * size, size), size * size).reshape(size, size) / count
                values, loadings = eigen(cov)
                wanted = min(wanted, max(1, int((values > 1e-12 * values[0]).sum())))
                loadings, converged = loadings[:, :wanted], None
            else:
                loadings, converged = self.leading(rows, width, features, size, mean, count, wanted)
        finally:
            rows.unpersist()
        done = self.stated(df, mean, loadings, converged=converged)
        return replace(done, gamma=gamma)

    def leading(self, rows, width, features, size, mean, count, wanted) -> tuple[np.ndarray, bool]:
        """The leading directions of the features' covariance by orthogonal iteration, a pass over the rows per round.

        Some directions more than wanted are carried along, since the last ones settle slowly.
        """
        carried = min(size, wanted + EXTRA)
        held = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(size, carried)))[0]
        for _ in range(self.rounds):

            def step(x: np.ndarray, held=held) -> np.ndarray:
                phi = features(x) - mean
                return (phi.T @ (phi @ held)).ravel()

            moved = partial_sums(rows, "_x", width, _blocks(step, size * carried, size), size * carried).reshape(size, carried) / count
            # within the carried directions the best ones are found exactly
            inner, turn = np.linalg.eigh((held.T @ moved + moved.T @ held) / 2)
            order = np.argsort(inner)[::-1]
            best = (held @ turn)[:, order][:, :wanted]
            new = np.linalg.qr(moved @ turn[:, order])[0]
            still = np.abs((new[:, :wanted] * best).sum(0))
            held = new
            if np.all(1 - still < self.tolerance):
                return same_sign(best), True
        return same_sign(best), False

    def function(self):
        features, _ = self.feature_map(self.width, self.gamma)
        mean, loadings = np.array(self.offset), np.array(self.loadings).T

        def scores(x: np.ndarray) -> np.ndarray:
            step = max(1, CELLS // len(mean))
            return np.vstack([(features(x[k:k + step]) - mean) @ loadings for k in range(0, len(x), step)] or [np.zeros((0, loadings.shape[1]))])

        return scores


def _blocks(step: Callable[[np.ndarray], np.ndarray], size: int, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """A sum over rows, so many rows at a time that a block of ``width`` features per row stays small."""
    rows = max(1, CELLS // width)

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for k in range(0, len(x), rows):
            out += step(x[k:k + rows])
        return out

    return total


@dataclass(frozen=True)
class Nmf(Components):
    """Non-negative parts: every row is a non-negative mix of a few shared profiles.

    A row's mix depends on that row and the profiles only, so it is found inside the task; the profiles
    are improved from two small sums per pass. Negative cells are an error, in ``fit`` and in use. ``l1_ratio`` splits the
    penalty ``alpha`` between absolute and squared size. Rounds end when the squared error falls by less than
    ``tolerance`` of its first value, at the latest after ``rounds``; ``converged`` says which.
    """

    rounds: int = 100
    inner: int = 40
    alpha: float = 0.0
    l1_ratio: float = 0.3
    tolerance: float = 1e-4

    suffix = "nfm"
    linear = False

    def mixer(self, profiles: np.ndarray):
        lasso, ridge, inner = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio), self.inner

        def mix(x: np.ndarray) -> np.ndarray:
            if len(x) and x.min() < 0:
                raise ValueError("negative cells have no non-negative parts")
            gram, reach = profiles @ profiles.T, x @ profiles.T
            level = np.sqrt(np.maximum(x.mean(1, keepdims=True), 1e-9) / max(len(profiles), 1)) if len(x) else np.zeros((0, 1))
            w = np.repeat(level, len(profiles), axis=1)
            for _ in range(inner):
                w *= reach / (w @ gram + ridge * w + lasso + 1e-12)
            return w

        return mix

    def fit(self, df: DataFrame) -> Nmf:
        width = self.size(df)
        count = self.n_components or width
        draw = np.random.default_rng(self.seed)
        rows = self.packed_frame(df).persist()
        converged, first, last = False, None, None
        try:
            level = partial_sums(rows, "_x", width, lambda x: np.array([len(x), x.sum(), (x < 0).sum(), (x * x).sum()]), 4)
            if level[2]:
                raise ValueError(f"{int(level[2])} cells are negative and have no non-negative parts")
            if not level[0]:
                raise ValueError("no rows to fit on")
            scale = math.sqrt(max(level[1] / (level[0] * width), 1e-12) / count)
            profiles = scale * np.abs(draw.normal(size=(count, width)))
            lasso, ridge = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
            for _ in range(self.rounds):
                mix = self.mixer(profiles)

                def step(x: np.ndarray, mix=mix, profiles=profiles) -> np.ndarray:
                    w = mix(x)
                    return np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel(), [((x - w @ profiles) ** 2).sum()]])

                acc = partial_sums(rows, "_x", width, step, count * count + count * width + 1)
                error = acc[-1]
                first = error if first is None else first
                if last is not None and last - error <= self.tolerance * first or error <= 1e-12 * level[3]:
                    converged = True
                    break
                last = error
                gram, reach = acc[:count * count].reshape(count, count), acc[count * count:-1].reshape(count, width)
                for _ in range(self.inner):
                    profiles = profiles * reach / (gram @ profiles + ridge * profiles + lasso + 1e-12)
        finally:
            rows.unpersist()
        return replace(
            self, width=width, offset=[0.0] * width, loadings=[[float(v) for v in row] for row in profiles], converged=converged
        )

    def function(self):
        return self.mixer(np.array(self.loadings))


def kernel_pca(kind: str, columns: Sequence[str], **settings) -> KernelPca:
    return KernelPca(tuple(columns), kernel=kind, **settings)
