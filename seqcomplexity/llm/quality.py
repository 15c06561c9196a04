"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every document. Expectation-maximisation over the counts of vote
patterns (all documents, a table of bounded size) estimates how each heuristic votes on good and on bad documents and how
many are good, with no true label. The posterior of each pattern then labels the documents, and a linear scorer over hashed
features is trained on these posteriors; it decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import M1, M2, chunks, drawn_rows, flat_bytes, lean, small_batches, utf8
from .jaccard import word_bounds, word_hashes

#: Hashed features.
DIMENSIONS = 2048
#: Documents the scorer is fitted on, about, drawn by a hash; the vote patterns are counted over all.
FIT_ROWS = 8192
#: Documents with a lower score are rejected.
THRESHOLD = 0.5

# Byte classes of the features: upper case, lower case (and all other letters in UTF-8), digits; the rest stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48
_UPPER, _LETTER, _DIGIT = (np.isin(np.arange(256), x) for x in (range(65, 91), [*range(65, 91), *range(97, 123)], range(48, 58)))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{}~"))
_BAR, _SHOUT, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"|", b"!", b".?"))

#: Each heuristic: name, the side it votes for (it abstains otherwise), bounds on its statistic, and the words a document must have.
HEURISTICS = (
    ("symbols", "bad", "symbols_per_word", 0.3, np.inf, 2),
    ("capitals", "bad", "upper_share", 0.5, np.inf, 3),
    ("shouting", "bad", "shouts_per_word", 0.3, np.inf, 3),
    ("bars", "bad", "bars_per_word", 0.2, np.inf, 3),
    ("repeats", "bad", "repeated_share", 0.25, np.inf, 6),
    ("monotony", "bad", "distinct_share", 0.0, 0.2, 20),
    ("no short words", "bad", "short_share", 0.0, 0.02, 30),
    ("digits", "bad", "digit_share", 0.3, np.inf, 2),
    ("short words", "good", "short_share", 0.15, 0.8, 20),
    ("sentences", "good", "stops_per_word", 0.02, 0.5, 20),
    ("variety", "good", "distinct_share", 0.5, np.inf, 20),
    ("plain case", "good", "upper_share", 0.002, 0.25, 20),
)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The heuristics' statistics for documents laid end to end."""
    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask[raw], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    hashes, at = word_hashes(raw, offsets)
    words = np.diff(at)
    starts, ends = word_bounds(raw, offsets) if len(raw) else (np.zeros(0, np.int64),) * 2
    short = np.concatenate([[0], np.cumsum((ends - starts <= 3) & (_LETTER[raw[starts]] | (raw[starts] > 127)))])
    again = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]])[:len(hashes)], out=again[1:])
    inner = again[at[1:]] - again[np.minimum(at[:-1] + 1, at[1:])]
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)
    some, letters, size = np.maximum(words, 1), np.maximum(total(_LETTER), 1), np.maximum(np.diff(offsets), 1)
    return {
        "words": words, "symbols_per_word": total(_SYMBOL) / some, "upper_share": total(_UPPER) / letters, "shouts_per_word": total(_SHOUT) / some, "bars_per_word": total(_BAR) / some, "repeated_share": inner / some,
        # Longer documents repeat words anyway; what the share says is corrected for that.
        "distinct_share": distinct / some * np.maximum(1.0, np.log2(np.maximum(some, 2)) / 6), "short_share": (short[at[1:]] - short[at[:-1]]) / some, "stops_per_word": total(_STOP) / some, "digit_share": total(_DIGIT) / size,
    }


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each document, one column for each heuristic: 0 abstains, 1 votes, 2 has too few words to be asked."""
    return np.stack([np.where(stats["words"] < least, 2, (stats[name] >= low) & (stats[name] <= high)) for _, _, name, low, high, least in HEURISTICS], 1).astype(np.int64)


def pattern_codes(found: np.ndarray) -> np.ndarray:
    return found @ 3 ** np.arange(len(HEURISTICS))


def _cast(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and abstentions of patterns."""
    found = codes[:, None] // 3 ** np.arange(len(HEURISTICS)) % 3
    return found == 1, found == 0


@dataclass
class LabelModel:
    """The estimated share of good documents and, for [bad, good] documents and each heuristic, how often it votes."""

    good: float
    rate: np.ndarray

    @staticmethod
    def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
        """Expectation-maximisation from the guess that a document is good unless a heuristic calls it bad.

        The share of good documents is kept within 0.01 and 0.99, and rates within 0.001 and 0.999, so that no pattern is certain."""
        cast, silent = _cast(codes)
        says_bad = np.array([h[1] == "bad" for h in HEURISTICS])
        posterior, model = np.where((cast & says_bad).any(1), 0.05, 0.95), LabelModel(0.5, np.full((2, len(HEURISTICS)), 0.5))
        for _ in range(rounds):
            weight = np.stack([counts * (1 - posterior), counts * posterior])
            # Four pseudo-documents a class say that votes are mostly right.
            model.rate = np.clip((weight @ cast + np.where(says_bad, [[2.0], [0.02]], [[0.5], [2.0]])) / (weight @ (cast | silent) + 4), 0.001, 0.999)
            model.good = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
            before, posterior = posterior, model.posterior(codes)
            if np.abs(before - posterior).max(initial=0.0) < 1e-9:
                break
        return model

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """The probability that documents with these patterns are good."""
        cast, silent = _cast(codes)
        odds = cast @ np.log(self.rate[1] / self.rate[0]) + silent @ np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.good / (1 - self.good)), -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Of each heuristic's votes, the share that is right."""
        votes = self.rate * np.array([[1 - self.good], [self.good]])
        right = np.where([h[1] == "bad" for h in HEURISTICS], votes[0], votes[1])
        return dict(zip((h[0] for h in HEURISTICS), (right / votes.sum(0)).tolist()))


def hashed_features(raw: np.ndarray, offsets: np.ndarray, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (index, value, row offsets): shares of hashed runs of four byte classes, and binned statistics by hashed name."""
    kinds = _CLASS[raw]
    index, value, ends = [], [], [0]
    if len(raw) >= 4:
        wide = np.ndarray((len(raw) - 3,), "<u4", np.ascontiguousarray(kinds), strides=(1,)).astype(np.uint64) * M1
        spots = ((wide ^ (wide >> np.uint64(29))) * M2 >> np.uint64(40)).astype(np.int64) % DIMENSIONS
    names = list(dict.fromkeys(h[2] for h in HEURISTICS))
    least = {n: min(h[5] for h in HEURISTICS if h[2] == n) for n in names}
    bins = np.stack([np.where(stats["words"] < least[n], 10, np.minimum(9, np.floor(10 * np.clip(stats[n], 0, 1) ** 0.5))).astype(np.int64) for n in names], 1)
    named = ((np.arange(len(names)) * 16 + bins + 1).astype(np.uint64) * M2 >> np.uint64(33)).astype(np.int64) % DIMENSIONS
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        runs = np.bincount(spots[a:b - 3], minlength=DIMENSIONS) if b - a >= 4 else np.zeros(DIMENSIONS, np.int64)
        at = np.flatnonzero(runs)
        index += [at, named[d]]
        value += [np.sqrt(runs[at] / max(1, b - a - 3)), np.full(len(names), 0.5)]
        ends.append(ends[-1] + len(at) + len(names))
    return np.concatenate(index) if index else np.zeros(0, np.int64), np.concatenate(value) if value else np.zeros(0), np.array(ends)


@dataclass
class Scorer:
    """A logistic model over the hashed features."""

    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> Scorer:
        """Accelerated gradient steps on the cross-entropy with soft labels; deterministic."""
        w, at, bias, old_bias, old = np.zeros(rows.shape[1]), np.zeros(rows.shape[1]), 0.0, 0.0, np.zeros(rows.shape[1])
        rate = 4 / max(1e-9, float((rows**2).sum(1).max(initial=0.0)) + 1)
        for k in range(rounds):
            gap = 1 / (1 + np.exp(-np.clip(rows @ at.astype(rows.dtype) + bias, -50, 50))) - labels
            w, new_bias = at - rate * (rows.T @ gap.astype(rows.dtype) / max(1, len(labels)) + decay * at), bias - rate * float(gap.mean() if len(gap) else 0.0)
            push = k / (k + 3)
            at, bias, old, old_bias = w + push * (w - old), new_bias + push * (new_bias - old_bias), w, new_bias
        return Scorer(old, old_bias)

    def score(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index] * value)])
        return 1 / (1 + np.exp(-np.clip(sums[ends[1:]] - sums[ends[:-1]] + self.bias, -50, 50)))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def _documents(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    raw, offsets = flat_bytes(batch.column(column))
    for a, b in chunks(np.diff(offsets)):
        part, ends = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        yield a, b, part, ends, statistics(part, ends)


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit the label model on the vote patterns of all documents and the scorer on about ``fit_rows`` of them (twice as many at most).

    These are drawn by a hash of id and text, so ids may repeat or be null; null texts count as empty ones. No rows give a scorer
    that knows nothing (0.5 for every text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pattern_codes(votes(stats)) for *_, stats in _documents(batch, 1)]
            code, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["pattern", "n"])

    counted = sorted(rows.mapInArrow(lean(patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    codes, counts = (np.array([r[k] for r in counted], np.int64) for k in (0, 1))
    labels = LabelModel.fit(codes, counts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, ends, stats in _documents(batch, 1):
                index, value, cuts = hashed_features(raw, ends, stats)
                at = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(pattern_codes(votes(stats))), pa.ListArray.from_arrays(at, pa.array(index, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], ["doc_id", "pattern", "at", "value"])

    drawn = drawn_rows(rows, F.xxhash64("doc_id", "text"), fit_rows, int(counts.sum()), ["doc_id", "text"])
    found = drawn.mapInArrow(lean(sample), "doc_id long, pattern long, at array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return QualityModel(labels, Scorer(np.zeros(DIMENSIONS), 0.0))
    at, value = (found[c].combine_chunks() for c in ("at", "value"))
    used, spot = np.unique(at.flatten().to_numpy(), return_inverse=True)  # features that never occur keep weight 0
    dense = np.zeros((found.num_rows, len(used)), np.float32)
    np.add.at(dense, (np.repeat(np.arange(found.num_rows), at.value_lengths().to_numpy()), spot), value.flatten().to_numpy())
    order = np.lexsort((found["pattern"].to_numpy(), found["doc_id"].to_numpy()))
    scorer = Scorer.fit(dense[order], labels.posterior(found["pattern"].to_numpy())[order])
    weights = np.zeros(DIMENSIONS)
    weights[used] = scorer.weights
    return QualityModel(labels, Scorer(weights, scorer.bias))


def score_quality(docs: DataFrame, model: QualityModel | None = None, text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``quality_score`` (the scorer's probability that it is good), ``weak_label`` (the posterior of its votes) and ``quality_keep``.

    Columns of these names are replaced; all others stay. A null, empty or blank text has no votes against it: it gets
    the prior as weak label and whatever the scorer gives no features. Repeated rows get equal scores; an empty table
    gives an empty table. No shuffle but of the pattern counts.
    """
    names = ("quality_score", "weak_label", "quality_keep")
    docs = docs.drop(*names)
    small_batches(docs.sparkSession)
    model = model or fit_quality(docs, text_col=text_col, fit_rows=fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).cast(pa.string()).fill_null("")
            for a, b, raw, ends, stats in _documents(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
                score = fitted.scorer.score(*hashed_features(raw, ends, stats))
                weak = fitted.labels.posterior(pattern_codes(votes(stats)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(weak), pa.array(score >= THRESHOLD)], [*part.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(lean(run), schema)
