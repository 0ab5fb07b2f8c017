"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import ALNUM, batch_map, give_back, set_aside, text_slices, words
from loomwright.llm.learning import Adam, bounded_sample, held_out, one_label_each, sigmoid

GATE_BITS = 16


@dataclass
class FactorizationMachine:
    """bias + sum of the weights of a text's terms + sum over pairs of its terms of the product of their factors."""

    terms: np.ndarray  # sorted hashes
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def __post_init__(self):
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[self.terms >> np.uint64(64 - GATE_BITS)] = True

    def rows(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of the known terms in each text, each once, ordered by text."""
        near = np.flatnonzero(self.gate[hashes >> np.uint64(64 - GATE_BITS)])
        place = np.searchsorted(self.terms, hashes[near])
        place[place == len(self.terms)] = 0
        known = self.terms[place] == hashes[near] if len(self.terms) else np.zeros(0, bool)
        text = np.searchsorted(bounds, near[known], "right") - 1
        pairs = np.unique(text * np.int64(max(1, len(self.terms))) + place[known])
        return pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))

    def margins(self, text: np.ndarray, term: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The margin of every text, and the sum of its terms' factors."""
        linear = np.bincount(text, self.weights[term], count)
        own = self.factors[term]
        sums = np.stack([np.bincount(text, own[:, k], count) for k in range(own.shape[1])], 1) if count else np.zeros((0, own.shape[1]))
        squares = np.bincount(text, (own * own).sum(1), count)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, text: np.ndarray, term: np.ndarray, label: np.ndarray, factors: int, steps: int, rate: float,
            shrink: float, seed: int, batch: int = 256) -> FactorizationMachine:
        """Logistic loss, mini-batches, weights and factors shrunk towards 0."""
        random = np.random.default_rng(seed)
        size = len(self.terms)
        share = float(np.clip(label.mean(), 1e-4, 1 - 1e-4)) if len(label) else 0.5
        bias = np.array([np.log(share / (1 - share))])
        self.bias, self.weights, self.factors = float(bias[0]), np.zeros(size), random.normal(0, 0.01, (size, factors))
        if not size or not len(label):
            return self
        cuts = np.searchsorted(text, np.arange(len(label) + 1))
        adam = Adam([bias, self.weights, self.factors], rate)
        order = np.zeros(0, np.int64)
        for step in range(steps):
            adam.rate = rate * (1 - step / steps)
            while len(order) < batch:
                order = np.concatenate([order, random.permutation(len(label))])
            chosen, order = order[:batch], order[batch:]
            counts = cuts[chosen + 1] - cuts[chosen]
            row = np.repeat(np.arange(len(chosen)), counts)
            places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cuts[chosen], counts)
            held = term[places]
            self.bias = float(bias[0])
            margin, sums = self.margins(row, held, len(chosen))
            error = (sigmoid(margin) - label[chosen]) / len(chosen)
            pull = error[row]
            by_weight = np.bincount(held, pull, size)
            spread = pull[:, None] * (sums[row] - self.factors[held])
            by_factor = np.stack([np.bincount(held, spread[:, k], size) for k in range(factors)], 1)
            adam([np.array([error.sum()]), by_weight + shrink * self.weights, by_factor + shrink * self.factors])
        self.bias = float(bias[0])
        return self


@dataclass(frozen=True)
class Toxicity:
    """Score whole texts for toxicity.

    Terms are the distinct words of a text (ASCII lower-cased), as 64-bit hashes. The model is a factorization
    machine: it learns a weight for each term and, through ``factors`` numbers per term, a weight for each pair of
    terms. It is fitted on a bounded sample: at most about ``per_label`` labelled texts of each label, and the
    ``kept_terms`` terms that tell the labels apart best among them. Rows of the held-out fold are never learned
    from; nothing but the text is an input of a score.

    NULL and empty texts get the score of a text without known terms. Keys with contradicting labels are not learned
    from. Without labels every score is 0.5. Repeated rows are scored one by one, other columns stay as they are.
    """

    label: str = "toxic"
    parts: int = 3
    part: int = 1
    per_label: int = 6000
    kept_terms: int = 1024
    least_texts: int = 3
    factors: int = 8
    steps: int = 600
    rate: float = 0.05
    shrink: float = 1e-4
    threshold: float = 0.7
    seed: int = 7
    text: str = "text"
    key: str = "doc_id"

    def fit(self, docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
        known = one_label_each(labels, self.key, self.label).where(~held_out("_key", self.parts, self.part))
        chosen = F.broadcast(bounded_sample(known, "_label", "_key", self.per_label))  # bounded by per_label
        rows = docs.select(F.col(self.key).alias("_key"), F.col(self.text).alias("_text")).join(chosen, "_key").select("_label", "_text")

        def terms(batch: pa.RecordBatch) -> dict:
            found = []
            for _, _, data, bounds in text_slices(batch.column(1)):
                hashes, at = words(data, bounds, ALNUM)
                found += [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            return {"label": batch.column(0), "terms": pa.array(found, pa.binary())}

        sample = batch_map(rows, "label int, terms binary", terms).toArrow()
        label = sample.column("label").to_numpy().astype(float)
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in sample.column("terms")]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        del sample, sets
        known_terms, texts = np.unique(flat, return_counts=True)
        bad_terms, bad_texts = np.unique(flat[np.repeat(label > 0, sizes)], return_counts=True)
        bad = np.zeros(len(known_terms))
        bad[np.searchsorted(known_terms, bad_terms)] = bad_texts
        all_bad, total = label.sum(), max(1, len(label))
        expected = texts * (all_bad / total)
        tells = (bad - expected) ** 2 / np.maximum(expected * (1 - texts / total), 0.5)
        tells[texts < self.least_texts] = -1
        best = np.argsort(-tells, kind="stable")[: self.kept_terms]
        model = FactorizationMachine(np.sort(known_terms[best[tells[best] >= 0]]))
        text, term = model.rows(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        del flat, known_terms, texts, bad_terms, bad_texts, bad, expected, tells
        model.fit(text, term, label, self.factors, self.steps, self.rate, self.shrink, self.seed)
        give_back()
        return model

    def score(self, docs: DataFrame, model: FactorizationMachine, keep: tuple[str, ...] | None = None) -> DataFrame:
        """The rows with ``score`` (0 to 1) and ``predicted`` (0 or 1) added; columns of these names are replaced."""
        names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
        kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
        shared, threshold, blank = docs.sparkSession.sparkContext.broadcast(model), self.threshold, not len(model.terms)

        # the text travels once: as one of the columns that stay, or beside them
        beside = [] if self.text in names else [F.col(self.text).alias("_text")]
        place = len(names) if beside else names.index(self.text)

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.zeros(0)]
            for row, end, data, bounds in text_slices(batch.column(place)):
                hashes, at = words(data, bounds, ALNUM)
                found.append(sigmoid(shared.value.margins(*shared.value.rows(hashes, at), end - row)[0]))
            score = np.concatenate(found)
            if blank:
                score[:] = 0.5
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*names, "score", "predicted"])

        return batch_map(docs.select(*names, *beside), f"{kept}score double, predicted int", scored)

    def __call__(self, docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """Fit on the labels of these texts, then score all of them."""
        return self.score(docs, self.fit(docs, labels), keep)

    def accepted(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows that the model doesn't reject, with all their columns, whatever their names."""
        held, back = set_aside(docs, ("score", "predicted", "_text", "_key", "_label"))
        return self(held, labels).where("predicted = 0").drop("score", "predicted").withColumnsRenamed(back).select(*docs.columns)
