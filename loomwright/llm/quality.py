"""Quality of texts: random-indexing word vectors, pooled, and a small neural network with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import batch_map, byte_values, mixed, summed, text_slices, words
from loomwright.llm.learning import Adam, bounded_sample, held_out, one_label_each, sigmoid

#: words are runs of one kind of character: small letters and beyond ASCII, capitals, digits, or marks
VALUES = byte_values({0x20, *range(0x09, 0x0E)}, fold_case=False)
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(97, 123), *range(128, 256)]] = 1
KINDS[65:91] = 2
KINDS[48:58] = 3


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def index_vectors(bits: int, width: int, marks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each bucket's random index vector."""
    drawn = mixed(np.arange(marks << bits, dtype=np.uint64) + np.uint64(seed << 40))
    return ((drawn >> np.uint64(1)) % np.uint64(width)).astype(np.int64).reshape(marks, -1), np.where(drawn & np.uint64(1), 1.0, -1.0).reshape(marks, -1)


@dataclass
class Network:
    """Standardised inputs, one hidden layer of rectified units, one output; the margin is divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def margins(self, inputs: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((inputs - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def __call__(self, inputs: np.ndarray) -> np.ndarray:
        return sigmoid(self.margins(inputs) / self.temperature)


def fit_network(inputs: np.ndarray, label: np.ndarray, hidden: int, steps: int, rate: float, shrink: float, seed: int, batch: int = 256) -> Network:
    """Fit on four fifths of the rows, then choose the temperature that gives the rest the least log loss."""
    random = np.random.default_rng(seed)
    width = inputs.shape[1]
    spread = inputs.std(0)
    net = Network(inputs.mean(0), np.where(spread > 1e-9, spread, 1.0),
                  [random.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)])
    order = random.permutation(len(label))
    check, learn = order[: len(order) // 5], order[len(order) // 5:]
    x = (inputs - net.mean) / net.scale
    w1, b1, w2, b2 = net.layers
    adam, queue = Adam(net.layers, rate), np.zeros(0, np.int64)
    for step in range(steps):
        adam.rate = rate * (1 - step / steps)
        while len(queue) < batch:
            queue = np.concatenate([queue, random.permutation(learn)])
        rows, queue = queue[:batch], queue[batch:]
        held = np.maximum(x[rows] @ w1 + b1, 0)
        error = (sigmoid(held @ w2 + b2[0]) - label[rows]) / len(rows)
        back = np.outer(error, w2) * (held > 0)
        adam([x[rows].T @ back + shrink * w1, back.sum(0), held.T @ error + shrink * w2, np.array([error.sum()])])
    if len(check):
        margins, tries = net.margins(inputs[check]), np.geomspace(0.25, 8, 41)

        def loss(t: float) -> float:
            p = np.clip(sigmoid(margins / t), 1e-6, 1 - 1e-6)
            return -float((label[check] * np.log(p) + (1 - label[check]) * np.log(1 - p)).mean())

        net.temperature = float(min(tries, key=loss))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray  # buckets x width
    network: Network | None
    bits: int

    def pooled(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean and spread of each text's word vectors, its length and its share of different words."""
        width = self.vectors.shape[1]
        size = np.diff(bounds)
        out = np.zeros((len(size), 2 * width + 2))
        full = np.flatnonzero(size)
        if len(full):
            own = self.vectors[bucket_of(hashes, self.bits)]
            cuts, count = bounds[:-1][full], size[full][:, None]
            mean = np.add.reduceat(own, cuts, axis=0, dtype=np.float64) / count
            square = np.add.reduceat(own * own, cuts, axis=0, dtype=np.float64) / count
            out[full, :width] = mean
            out[full, width: 2 * width] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[:, -2] = np.log1p(size)
        for row in full.tolist():
            part = hashes[bounds[row]: bounds[row + 1]]
            out[row, -1] = len(np.unique(part)) / len(part)
        return out

    def scores(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(bounds) - 1, 0.5)
        return self.network(self.pooled(hashes, bounds))


@dataclass(frozen=True)
class Quality:
    """Score whole texts for quality.

    Every word bucket (``2**bits`` by hash) has a sparse random index vector; its word vector is the mean of the index
    vectors of the words within ``reach`` places of its occurrences, its own included, over all texts. A text is
    pooled to mean and spread of its word vectors, its length and its share of different words; a two-layer network
    scores that, and a temperature fitted on rows it has not seen calibrates the probability.

    The word vectors cover all texts. The network is fitted on a bounded sample: about ``per_label`` labelled texts
    of each label. The held-out fold's labels are never read. NULL and empty texts are scored as texts without words;
    keys with contradicting labels are left out; without labels every score is 0.5. Repeated rows are scored one by
    one, other columns stay as they are.
    """

    label: str = "quality"
    parts: int = 4
    part: int = 2
    per_label: int = 6000
    bits: int = 12
    width: int = 32
    marks: int = 4
    reach: int = 2
    hidden: int = 24
    steps: int = 1500
    rate: float = 0.01
    shrink: float = 1e-4
    threshold: float = 0.7
    seed: int = 11
    text: str = "text"
    key: str = "doc_id"

    def word_vectors(self, docs: DataFrame) -> np.ndarray:
        """The word vector of every bucket, at length 1."""
        bits, width, reach = self.bits, self.width, self.reach
        places, signs = index_vectors(bits, width, self.marks, self.seed)

        def contexts(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            for _, _, data, bounds in text_slices(batch.column(0)):
                hashes, at = words(data, bounds, VALUES, KINDS)
                own, size = bucket_of(hashes, bits), len(hashes)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for step in range(-reach, reach + 1):
                    first, last = max(0, -step), size - max(0, step)
                    if first >= last:
                        continue
                    near = slice(first + step, last + step)
                    both = text[first:last] == text[near]
                    centre, other = own[first:last][both], own[near][both]
                    for k in range(len(places)):
                        sums += np.bincount(centre * width + places[k][other], signs[k][other], len(sums))

        vectors = summed(docs.select(self.text), (1 << bits) * width, contexts).reshape(-1, width)
        return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityModel:
        model = QualityModel(self.word_vectors(docs), None, self.bits)
        known = one_label_each(labels, self.key, self.label).where(~held_out("_key", self.parts, self.part))
        chosen = F.broadcast(bounded_sample(known, "_label", "_key", self.per_label))  # bounded by per_label
        rows = docs.select(F.col(self.key).alias("_key"), F.col(self.text).alias("_text")).join(chosen, "_key").select("_label", "_text")
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def pooled(batch: pa.RecordBatch) -> dict:
            parts = [shared.value.pooled(*words(data, bounds, VALUES, KINDS)) for _, _, data, bounds in text_slices(batch.column(1))]
            return {"label": batch.column(0), "pooled": pa.array(np.concatenate(parts).tolist(), pa.list_(pa.float64()))}

        sample = batch_map(rows, "label int, pooled array<double>", pooled).toArrow()
        label = sample.column("label").to_numpy().astype(float)
        if len(set(label.tolist())) == 2:
            inputs = np.array(sample.column("pooled").to_pylist())
            order = np.lexsort(inputs.T)  # the same rows in any order give the same network
            model.network = fit_network(inputs[order], label[order], self.hidden, self.steps, self.rate, self.shrink, self.seed)
        return model

    def score(self, docs: DataFrame, model: QualityModel, keep: tuple[str, ...] | None = None) -> DataFrame:
        """The rows with ``score`` (0 to 1) and ``predicted`` (0 or 1) added; columns of these names are replaced."""
        names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
        kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
        shared, threshold = docs.sparkSession.sparkContext.broadcast(model), self.threshold

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shared.value.scores(*words(data, bounds, VALUES, KINDS)) for _, _, data, bounds in text_slices(batch.column(len(names)))]
            score = np.concatenate(found)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*names, "score", "predicted"])

        return batch_map(docs.select(*names, F.col(self.text).alias("_text")), f"{kept}score double, predicted int", scored)

    def __call__(self, docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """Fit on these texts and their labels, then score all of them."""
        return self.score(docs, self.fit(docs, labels), keep)
