"""Quality rules: plain counts of each text and a classifier trained on labelled quality rows, against fixed thresholds.

Method, logistic regression on hashed n-grams. Features are the shares of character 3- and 5-grams (code points) and of
word 1- and 2-grams in 2**SLOT_BITS slots per kind (A-Z and the other case stay apart, as shouting is a sign of junk).
The model is fitted on at most TRAIN_ROWS labelled rows, chosen by a hash of the id (a documented bound; every row is
scored). N-grams are counted where the texts lie, so that the one task that fits gets counts, at most 4 * 2**SLOT_BITS
a row, however long the texts are. Part of the rows is held back to calibrate the probability (Platt's logistic curve of the raw score). Scoring runs in Arrow batches: the
score of a text is the mean weight of its n-grams, one lookup for each position of the whole text.

Defined results: null and empty texts have no words, fail the base rules and score the model's bias; rows without a
label, or with a null label, are not trained on; several labels of an id count as its lowest; if the labels hold one
class only, every text gets that class's share as probability; extra columns are kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table, texts
from .text import IS_SPACE, SPACES, chunked, mix, prefix_sums, span_hashes, window_hashes, word_spans

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 2000
SLOT_BITS = 16
KINDS = ("chars3", "chars5", "words1", "words2")
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
#: Calibrated probability of good quality below which a text goes.
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_counts(words: np.ndarray, text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text with these word hashes."""
    data = np.frombuffer(text, np.uint8)
    chars = int(((data & 0xC0) != 0x80).sum()) - int(IS_SPACE[data].sum())
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    windows = window_hashes(words, REPEAT_WINDOW)
    repeated = 0
    if len(windows) > 1:
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if twice.size:
            at = np.flatnonzero(np.isin(windows, twice))
            step = np.zeros(len(words) + 1, np.int32)
            step[at] += 1
            np.add.at(step, at + REPEAT_WINDOW, -1)
            repeated = int((np.cumsum(step[:-1]) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def ngram_slots(texts_: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each kind of n-gram its slots, and the bounds of each text in them; also word hashes and their bounds."""
    joined = b"\n".join(texts_) + b"\n" * 6
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts_], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    kinds = []
    shift = np.uint32(32 - SLOT_BITS)
    points, at, lengths = _code_points(texts_)
    n = len(points) - 6
    three = points[:n]
    for k in (1, 2):
        three = three * np.uint32(0x85EBCA77) + points[k : n + k]
    kinds.append(((three * np.uint32(0x9E3779B1)) >> shift, _bounds(at, lengths, 3)))
    five = three
    for k in (3, 4):
        five = five * np.uint32(0x85EBCA77) + points[k : n + k]
    kinds.append(((five * np.uint32(0xC2B2AE3D)) >> shift, _bounds(at, lengths, 5)))
    starts, ends = word_spans(data)
    words = span_hashes(prefix_sums(data), starts, ends)
    word_bounds = np.searchsorted(starts, np.concatenate([begins, [len(data)]]))
    counts = np.diff(word_bounds)
    take = np.uint64(64 - SLOT_BITS)
    kinds.append(((words >> take).astype(np.uint32), _bounds(word_bounds[:-1], counts, 1)))
    kinds.append(((window_hashes(words, 2) >> take).astype(np.uint32), _bounds(word_bounds[:-1], counts, 2)))
    return kinds, words, word_bounds


def _code_points(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, joined by line feeds, and the begin and length of each; bytes that aren't UTF-8 are U+FFFD."""
    read = [t.decode("utf-8", "replace") for t in texts_]
    lengths = np.array([len(t) for t in read], np.int64)
    return np.frombuffer(("\n".join(read) + "\n" * 6).encode("utf-32-le"), np.uint32), np.cumsum(lengths + 1) - lengths - 1, lengths


def _bounds(begins: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """First and last + 1 of the n-grams of each text."""
    return np.stack([begins, begins + np.maximum(sizes - n + 1, 0)])


def _means(kinds, weights: np.ndarray) -> np.ndarray:
    """For each text the sum over kinds of the mean weight of its n-grams."""
    out = 0.0
    for (slots, (first, last)), w in zip(kinds, weights):
        total = np.zeros(len(slots) + 1)
        np.cumsum(w[slots], out=total[1:])
        first, last = np.minimum(first, len(slots)), np.minimum(last, len(slots))
        out = out + (total[last] - total[first]) / np.maximum(last - first, 1)
    return out


class QualityModel:
    """Weights by kind and slot, a bias, and the curve that turns a raw score into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, kinds) -> np.ndarray:
        return _sigmoid(self.slope * (_means(kinds, self.weights) + self.bias) + self.offset)

    def pack(self) -> bytes:
        return np.concatenate([[self.bias, self.slope, self.offset], self.weights.ravel()]).astype("<f4").tobytes()

    @classmethod
    def unpack(cls, packed: bytes) -> QualityModel:
        values = np.frombuffer(packed, "<f4").astype(float)
        return cls(values[3:].reshape(len(KINDS), -1).astype(np.float32), *values[:3])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def features(texts_: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the numbers of its features, kind by kind, and their shares."""
    out = []
    for _, held in chunked(texts_):
        kinds, _, _ = ngram_slots(held)
        for r in range(len(held)):
            numbers, shares = [np.empty(0, np.int32)], [np.empty(0, np.float32)]
            for k, (slots, (a, b)) in enumerate(kinds):
                x, y = int(a[r]), int(b[r])
                if y > x:
                    slot, count = np.unique(slots[x:y], return_counts=True)
                    numbers.append((slot + (k << SLOT_BITS)).astype(np.int32))
                    shares.append((count / (y - x)).astype(np.float32))
            out.append((np.concatenate(numbers), np.concatenate(shares)))
    return out


def fit(found: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 150, penalty: float = 1e-5) -> QualityModel:
    """From the features of each text: full-batch gradient steps with momentum per weight (Adam); every fourth row calibrates."""
    n = len(KINDS) << SLOT_BITS
    weights, share = np.zeros(n), float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if len(good) else 0.5
    prior = float(np.log(share / (1 - share)))
    if len(good) < 8 or good.min() == good.max() or not any(len(numbers) for numbers, _ in found):
        return QualityModel(weights.reshape(len(KINDS), -1).astype(np.float32), prior, 1.0, 0.0)
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(numbers) for numbers, _ in found])
    features, shares = (np.concatenate(part) for part in zip(*found))
    held = np.arange(len(good)) % 4 == 3
    if good[held].min() == good[held].max() or good[~held].min() == good[~held].max():
        held[:] = False
    # Only what the steps need is kept, as all n-grams of the sample are held at once.
    present = np.bincount(features, minlength=n)
    active = np.flatnonzero(present)
    column_starts = np.cumsum(present[active]) - present[active]
    by_column = np.argsort(features, kind="stable")
    column_rows, column_shares = rows[by_column].astype(np.int64), shares[by_column]
    del by_column
    number = np.zeros(n, np.int64)
    number[active] = np.arange(len(active))
    column = number[features]
    del features
    sizes = np.bincount(rows, minlength=len(good))
    del rows
    filled = np.flatnonzero(sizes)
    row_starts = np.cumsum(sizes[filled]) - sizes[filled]
    products = np.empty(len(column))  # kept for all steps: making such arrays anew costs more than filling them

    def sums(values: np.ndarray, at: np.ndarray, factors: np.ndarray, starts: np.ndarray) -> np.ndarray:
        np.take(values, at, out=products, mode="clip")
        np.multiply(products, factors, out=products)
        return np.add.reduceat(products, starts)

    def scores() -> np.ndarray:
        out = np.full(len(good), bias)
        out[filled] += sums(weight, column, shares, row_starts)
        return out

    weight, bias = np.zeros(len(active)), prior
    m, v = np.zeros(len(active)), np.zeros(len(active))
    scale = np.where(held, 0.0, np.where(good == 1, 0.5 / share, 0.5 / (1 - share)))
    scale /= scale.sum()
    for step in range(1, steps + 1):
        error = (_sigmoid(scores()) - good) * scale
        gradient = sums(error, column_rows, column_shares, column_starts) + penalty * weight
        bias -= 0.5 * error.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        weight -= 1.0 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[active] = weight
    score = scores()
    part = held if held.any() else ~held
    slope, offset = _platt(score[part], good[part])
    return QualityModel(weights.reshape(len(KINDS), -1).astype(np.float32), bias, slope, offset)


def _platt(score: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve of a score, by Newton's method; targets are smoothed as Platt proposes."""
    positives = good.sum()
    target = np.where(good == 1, (positives + 1) / (positives + 2), 1 / (len(good) - positives + 2))
    center, spread = score.mean(), score.std() + 1e-9
    x = np.stack([(score - center) / spread, np.ones(len(score))])
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(beta @ x)
        hessian = (x * (p * (1 - p))) @ x.T + 1e-4 * np.eye(2)
        beta = beta - 0.5 * np.linalg.solve(hessian, x @ (p - target) + 1e-4 * beta)
    return float(beta[0] / spread), float(beta[1] - beta[0] * center / spread)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents, those whose ids hash lowest."""
    known = labels.where(f"doc_id is not null and `{label}` is not null").groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(rows)
    return one_text_each(texts(docs).join(F.broadcast(chosen), "doc_id"))  # `rows` bounds the broadcast


def one_text_each(rows: DataFrame) -> DataFrame:
    """Of rows with one doc_id the text with the lowest hash, so that the number of ids bounds the sample."""
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids, labels = (batch.column(c).slice(row, 1) for c in ("doc_id", "label"))
            packed = [pa.array([part.tobytes()]) for part in features([text or b""])[0]]
            yield pa.RecordBatch.from_arrays([ids, labels, *packed], ["doc_id", "label", "numbers", "shares"])


def _fit_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("doc_id", kind="stable")
    found = [(np.frombuffer(n, np.int32), np.frombuffer(s, np.float32)) for n, s in zip(group["numbers"], group["shares"])]
    model = fit(found, group["label"].to_numpy(float))
    return pd.DataFrame({"model": [model.pack()]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit in one task, on the bounded sample; the model (1 MB) comes to the driver."""
    sample = training_rows(docs, labels, "quality", rows).mapInArrow(_counted, "doc_id long, label int, numbers binary, shares binary")
    packed = sample.groupBy(F.lit(0).alias("all")).applyInPandas(_fit_group, "model binary").collect()
    return QualityModel.unpack(packed[0][0]) if packed else fit([], np.empty(0))


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel.unpack(shared.value)
        for batch in batches:
            for first, held in chunked(batch.column("text").to_pylist()):
                kinds, words, bounds = ngram_slots(held)
                good = model.probability(kinds)
                counts = [base_counts(words[a:b], t) for a, b, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), held)]
                columns = [np.array(c, np.int64) for c in zip(*counts)]
                failed = (columns[0] < MIN_WORDS) | (100 * columns[4] > MOST_REPEATED_PERCENT * columns[0])
                kept = ~failed & (good >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(held)), *map(pa.array, columns), pa.array(failed), pa.array(good), pa.array(kept)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "good_probability", "kept"],
                )

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, good_probability, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows).pack())
    return texts(docs).mapInArrow(_score(shared, threshold), f"doc_id long, {BASE}, base_failed boolean, good_probability double, kept boolean")


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the rules keep, with all their columns; the model learns from the labelled rows of `labelled`.

    Each text is judged where it lies, without a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled, labels, rows).pack())

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        model = QualityModel.unpack(shared.value)
        out = []
        for _, held in chunked(list(text)):
            kinds, words, bounds = ngram_slots(held)
            good = model.probability(kinds)
            for a, b, t, p in zip(bounds[:-1].tolist(), bounds[1:].tolist(), held, good):
                n, _, _, _, repeated = base_counts(words[a:b], t)
                out.append(n >= MIN_WORDS and 100 * repeated <= MOST_REPEATED_PERCENT * n and bool(p >= threshold))
        return pd.Series(out, dtype=bool)

    return docs.where(kept(F.col("text").cast("binary")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    scored = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good_probability")
