"""Quality classifier: the labels of the nearest labelled documents in latent-semantic space, weighted by similarity.

Method, nearest-neighbour voting. A text becomes counts of hashed words and of hashed byte trigrams (A-Z apart from the
other case, as shouting is a sign of junk), and of a few terms for its shape: how long it is, how much of its words and
lines is new, how long its words are. Counts are damped by a logarithm and weighted by inverse document frequency over
all documents; both parts have unit length, the shape part times SHAPE_WEIGHT. Latent directions are the leading right
singular vectors of the labelled texts' matrix, found by subspace iteration. The labelled vectors go to all tasks (at
most TRAIN_ROWS of them, a documented bound); every document's cosine with each of them is computed in blocks of
documents, and its NEIGHBOURS best vote with weight cosine**SHARPNESS. The score is the share of votes for label 1.

Learnt from labelled documents only where crc32(doc_id as text) mod 5 is not 0, those whose ids hash lowest; labels,
lang, source and doc_id are no inputs of a score. Texts are counted where they lie; one task sees only the counts.

Defined results: null and empty texts have a shape (no words) and are scored by it; null labels are ignored, several
labels of an id count as the lowest; of labelled texts with equal counts one votes, with their mean label; ties between
neighbours go to the one that comes first by id; without any labels every score is 0.5; null ids have a null held_out.
Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table, texts
from .quality_rules import training_rows
from .text import SPACES, chunked, prefix_sums, span_hashes, word_spans

#: Labelled rows that vote, at most.
TRAIN_ROWS = 3000
#: Slots of words and of byte trigrams, 2**SLOT_BITS each, and of the shape terms.
SLOT_BITS = 12
TERMS = 2 << SLOT_BITS
SHAPES = (24, 9, 9, 16)
SLOTS = TERMS + sum(SHAPES)
SHAPE_WEIGHT = 0.5
RANK, NEIGHBOURS, SHARPNESS = 48, 20, 20
THRESHOLD = 0.3
#: Documents whose counts or cosines are held at a time.
BLOCK = 128


def shape_slots(words: np.ndarray, text: bytes, word_bytes: int) -> list[int]:
    """One slot for each kind of shape term: words (log2), shares of distinct words and lines (eighths), bytes a word."""
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    values = (n.bit_length(), 8 * len(np.unique(words)) // max(n, 1), 8 * len(set(lines)) // max(len(lines), 1), word_bytes // max(n, 1))
    first = TERMS + np.cumsum((0, *SHAPES[:-1]))
    return [int(f) + min(int(v), size - 1) for f, v, size in zip(first, values, SHAPES)]


def term_counts(texts_: list[bytes]) -> Iterator[np.ndarray]:
    """Counts of every slot (texts x SLOTS), BLOCK texts at a time."""
    for _, chunk in chunked(texts_):
        for k in range(0, len(chunk), BLOCK):
            held = chunk[k : k + BLOCK]
            out = np.zeros((len(held), SLOTS), np.float32)
            for row, text in zip(out, held):
                data = np.frombuffer(text, np.uint8)
                starts, ends = word_spans(data)
                words = span_hashes(prefix_sums(data), starts, ends)
                row[: 1 << SLOT_BITS] = np.bincount((words >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
                if len(data) > 2:
                    wide = data.astype(np.uint32)
                    three = (wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
                    row[1 << SLOT_BITS : TERMS] = np.bincount(three >> np.uint32(32 - SLOT_BITS), minlength=1 << SLOT_BITS)
                row[shape_slots(words, text, int((ends - starts).sum()))] = 1
            yield out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for counts in term_counts(batch.column("text").to_pylist()):
            total += (counts > 0).sum(0)
            rows += len(counts)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total], pa.list_(pa.int64()))], ["rows", "counts"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each slot from the number of documents that have it; the driver gets SLOTS numbers."""
    parts = texts(docs).select("text").mapInArrow(_document_counts, "rows long, counts array<long>")
    cells = parts.select(F.posexplode(F.array_append("counts", F.col("rows"))).alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(SLOTS + 1)
    for slot, n in cells.collect():
        found[slot] = n
    return (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32)


def weighted(counts: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Damped and weighted counts; the terms have length one, the shape SHAPE_WEIGHT, if there is anything."""
    out = np.log1p(counts) * inverse
    for part, weight in ((out[:, :TERMS], 1.0), (out[:, TERMS:], SHAPE_WEIGHT)):
        part *= weight / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-12)
    return out


def latent_directions(rows: np.ndarray, rank: int = RANK, rounds: int = 8) -> np.ndarray:
    """Leading right singular vectors as columns, by subspace iteration."""
    rank = min(rank, *rows.shape)
    start = np.random.default_rng(0).normal(size=(rows.shape[1], min(rank + 16, *rows.shape))).astype(np.float32)
    q = np.linalg.qr(start)[0]
    for _ in range(rounds):
        q = np.linalg.qr(rows.T @ (rows @ q))[0]
    _, _, turn = np.linalg.svd(rows @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :rank], np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class VotingModel:
    """Slot weights, latent directions, and the labelled vectors with their labels."""

    def __init__(self, inverse: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.inverse, self.directions, self.vectors, self.labels = inverse, directions, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, inverse: np.ndarray, rank: int = RANK) -> VotingModel:
        """Equal rows of counts become one, at the place of the first, with the mean label."""
        if not len(counts):
            return cls(inverse, np.zeros((SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
        _, first, which = np.unique([row.tobytes() for row in counts], return_index=True, return_inverse=True)
        mean = np.bincount(which, labels) / np.bincount(which)
        order = np.argsort(first)
        rows = weighted(counts[first[order]], inverse)
        directions = latent_directions(rows, rank)
        return cls(inverse, directions, _unit(rows @ directions), mean[order])

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = _unit(weighted(counts, self.inverse) @ self.directions) @ self.vectors.T
        if neighbours < len(self.labels):
            limit = np.partition(cosines, -neighbours, axis=1)[:, -neighbours][:, None]
            over, equal = cosines > limit, cosines == limit
            chosen = over | (equal & (np.cumsum(equal, 1) <= neighbours - over.sum(1, keepdims=True)))
        else:
            chosen = np.ones(cosines.shape, bool)
        weight = np.where(chosen, np.maximum(cosines, 0).astype(float) ** SHARPNESS, 0.0)
        total = weight.sum(1)
        return np.clip(np.where(total > 0, weight @ self.labels / np.where(total > 0, total, 1), self.prior), 0.0, 1.0)


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, values = [], []
        for counts in term_counts(batch.column("text").to_pylist()):
            for row in counts:
                at = np.flatnonzero(row)
                slots.append(at.astype("<u2").tobytes())
                values.append(row[at].tobytes())
        columns = [batch.column("doc_id"), batch.column("label"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "slots", "counts"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> VotingModel:
    """Counts are made where the labelled texts lie, fitting takes one task; the model (some 2 MB) comes to the driver."""
    usable = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counted = training_rows(docs, usable, "quality", rows).mapInArrow(_labelled_counts, "doc_id long, label int, slots binary, counts binary")
    inverse = inverse_frequencies(docs)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        counts = np.zeros((len(group), SLOTS), np.float32)
        for row, slots, values in zip(counts, group["slots"], group["counts"]):
            row[np.frombuffer(slots, "<u2")] = np.frombuffer(values, np.float32)
        model = VotingModel.fit(counts, group["label"].to_numpy(float), inverse)
        parts = (model.directions.shape[1], model.directions.tobytes(), model.vectors.tobytes(), model.labels.tobytes())
        return pd.DataFrame([parts], columns=["rank", "directions", "vectors", "labels"])

    packed = counted.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "rank int, directions binary, vectors binary, labels binary").collect()
    if not packed:
        return VotingModel.fit(np.empty((0, SLOTS)), np.empty(0), inverse)
    rank, directions, vectors, votes = packed[0]
    return VotingModel(inverse, np.frombuffer(directions, np.float32).reshape(-1, rank), np.frombuffer(vectors, np.float32).reshape(-1, rank), np.frombuffer(votes))


def quality_votes(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.scores(counts) for counts in term_counts(batch.column("text").to_pylist())]
            scores = np.concatenate(parts) if parts else np.empty(0)
            held_out = [None if d is None else zlib.crc32(str(d).encode()) % 5 == 0 for d in batch.column("doc_id").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(held_out, pa.bool_()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op13_quality_votes(spark, sf_dir: str) -> DataFrame:
    return quality_votes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
