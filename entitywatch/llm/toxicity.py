"""Toxicity: every significant toxic passage of a text, and a calibrated score of the whole.

Method, maximum-scoring segments over token log-odds. A token is a word without its outer punctuation, in lower case; its
units are the word itself and its first four and five characters, so that inflected forms of one stem share evidence.
The log-odds of a unit compare its share among toxic and clean labelled documents under a Dirichlet prior proportional
to its share in both; units whose log-odds are no more than noise (a z below MIN_Z, or below what the number of units tried makes likely) count nothing, and a token has the
largest log-odds of its units, or -DRIFT. A linear scan finds all maximal segments (Ruzzo and Tompa's). Segment scores
of unrelated text follow an extreme-value law (Karlin and Altschul): E(s) = K * words * exp(-lambda * s) segments of
score s are expected by chance. lambda solves sum(p * exp(lambda * score)) = 1 over the tokens of clean documents, K is
fitted to their best segments. A text's evidence is the sum of -log(E) of its significant segments; a logistic curve
fitted on the training rows turns it into the score.

Trained on labelled documents only where crc32(doc_id as text) mod 3 is not 1, at most TRAIN_ROWS of them, those whose
ids hash lowest (a documented bound; every row is scored); of copies among them one counts. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no segments and score like texts without evidence; null labels are ignored,
several labels of an id count as the highest; without both classes every score is the share of toxic rows; ties between
equal segments keep the first; repeated rows score alike.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table, texts
from .quality_rules import one_text_each
from .text import chunked, shingle_sets

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 8000
#: Least z of a unit that counts; more if many units are tried.
MIN_Z = 2.5
#: Score of a token without significant units.
DRIFT = 0.5
STEMS = (4, 5)
THRESHOLD = 0.7
#: Prior counts in all, in documents.
PRIOR = 100.0
#: Segments with at least this expected number by chance are no evidence.
LARGEST_E = 0.05
_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: bytes) -> list[str]:
    """Words in lower case without outer punctuation; words of punctuation alone are left out."""
    return [w for w in (x.strip(_OUTER) for x in text.decode("utf-8", "replace").lower().split()) if w]


def units(word: str) -> list[str]:
    return [word] + [word[:n] + "~" for n in STEMS if len(word) > n]


def unit_counts(texts_: list[bytes]) -> dict[str, int]:
    """In how many texts each unit occurs."""
    out: dict[str, int] = {}
    for text in texts_:
        for unit in {u for w in set(tokens(text)) for u in units(w)}:
            out[unit] = out.get(unit, 0) + 1
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Candidates are kept with the running total before and after them. A new positive score joins the candidates back to
    the nearest one that began at a lower total and ends lower than the new total; else it stands alone.
    """
    found: list[list] = []  # start, end, total before, total after, index of the nearest earlier with a lower start
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [at, at + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], at + 1, found[j][2], total, found[j][4]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


class ToxicityModel:
    def __init__(self, weights: dict[str, float], rate: float, factor: float, slope: float, offset: float) -> None:
        self.weights, self.rate, self.factor, self.slope, self.offset = weights, rate, factor, slope, offset
        self.cache: dict[str, float] = {}

    def word_score(self, word: str) -> float:
        if word not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = max((self.weights[u] for u in units(word) if u in self.weights), default=-DRIFT)
        return self.cache[word]

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Significant segments: start, end, score, expected number by chance."""
        scores = [self.word_score(w) for w in words]
        out = []
        for a, b, s in segments(scores) if any(x > 0 for x in scores) else []:
            expected = self.factor * len(words) * float(np.exp(-self.rate * s))
            if expected < LARGEST_E:
                out.append((a, b, s, expected))
        return out

    def evidence(self, found: list[tuple[int, int, float, float]]) -> float:
        return float(sum(-np.log(max(e, 1e-12)) for *_, e in found))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * np.log1p(evidence) + self.offset))))


def log_odds(toxic: pd.Series, clean: pd.Series, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Units with significant log-odds for toxic documents, from document counts under the Dirichlet prior."""
    both = toxic + clean
    prior = PRIOR * both / max(both.sum(), 1.0) + 0.5
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (n_toxic + PRIOR - a).clip(lower=1)) - np.log(b / (n_clean + PRIOR - b).clip(lower=1))
    z = odds / np.sqrt(1 / a + 1 / b)
    # the more units are tried, the more stand out by chance
    chosen = (z >= max(MIN_Z, np.sqrt(2 * np.log(max(len(z), 100) / 100)))) & (odds > 1.0)
    return dict(zip(both.index[chosen], odds[chosen].clip(upper=6.0)))


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive solution of mean(exp(x * score)) = 1."""
    if not (values > 0).any():
        return 1.0
    low, high = 1e-3, 50.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if (counts * np.exp(np.minimum(middle * values, 700))).sum() > counts.sum() else (middle, high)
    return low


def distinct_texts(texts_: list[bytes]) -> list[int]:
    """Numbers of texts that share none of their three lowest shingle hashes with an earlier one: copies say nothing new."""
    met: set[int] = set()
    out = []
    for first, held in chunked(texts_):
        for k, shingles in enumerate(shingle_sets(held)):
            low = shingles[:3].tolist()
            if not met.intersection(low):
                out.append(first + k)
            met.update(low)
    return out


def fit(texts_: list[bytes], toxic: np.ndarray) -> ToxicityModel:
    chosen = distinct_texts(texts_)
    texts_, toxic = [texts_[k] for k in chosen], toxic[chosen]
    share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3)) if len(toxic) else 0.1
    prior = float(np.log(share / (1 - share)))
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel({}, 1.0, 1.0, 0.0, prior)
    a, b = (pd.Series(unit_counts([t for t, y in zip(texts_, toxic) if y == c]), dtype=float) for c in (1, 0))
    a = a[a >= 3]
    weights = log_odds(a, b.reindex(a.index, fill_value=0.0), int(toxic.sum()), int((1 - toxic).sum()))
    model = ToxicityModel(weights, 1.0, 1.0, 0.0, prior)
    # the law of the best segment of clean texts: rate from all their token scores, factor by maximum likelihood
    number: dict[float, int] = {}
    best, lengths = [], []
    for text, y in zip(texts_, toxic):
        if y == 0:
            scores = [model.word_score(w) for w in tokens(text)]
            for value in scores:
                number[value] = number.get(value, 0) + 1
            best.append(max((s for *_, s in segments(scores)), default=0.0))
            lengths.append(max(len(scores), 1))
    rate = _decay(np.array(list(number)), np.array(list(number.values()), float)) if number else 1.0
    model.rate = max(0.2, min(rate, 5.0))
    model.factor = len(best) / float((np.array(lengths) * np.exp(-model.rate * np.array(best))).sum())
    evidence = np.array([np.log1p(model.evidence(model.passages(tokens(t)))) for t in texts_])
    model.slope, model.offset = _curve(evidence, toxic, prior)
    return model


def _curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic curve by Newton's method, never falling."""
    beta, data = np.array([1.0, prior]), np.stack([x, np.ones(len(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ data, -35, 35)))
        hessian = (data * (p * (1 - p))) @ data.T + 1e-2 * np.eye(2)
        beta = beta - 0.5 * np.linalg.solve(hessian, data @ (p - y) + 1e-2 * np.array([beta[0], 0.0]))
    return max(float(beta[0]), 0.0), float(beta[1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label) of the labelled documents trained on."""
    usable = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(rows)
    return one_text_each(texts(docs).join(F.broadcast(chosen), "doc_id"))  # `rows` bounds the broadcast


def _fit_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "text"], kind="stable")
    model = fit([t or b"" for t in group["text"]], group["label"].to_numpy(float))
    return pd.DataFrame({"model": [pickle.dumps((model.weights, model.rate, model.factor, model.slope, model.offset))]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit in one task, on the bounded sample; the model (significant units and four numbers) comes to the driver."""
    packed = training_rows(docs, labels, rows).groupBy(F.lit(0).alias("all")).applyInPandas(_fit_group, "model binary").collect()
    return ToxicityModel(*pickle.loads(packed[0][0])) if packed else fit([], np.empty(0))


def _score(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("text").to_pylist():
                found = model.passages(tokens(text or b""))
                scores.append(model.score(model.evidence(found)))
                passages.append([{"start": a, "end": b, "score": s} for a, b, s, _ in found])
            ids = batch.column("doc_id")
            held_out = [None if d is None else zlib.crc32(str(d).encode()) % 3 == 1 for d in ids.to_pylist()]
            columns = [ids, pa.array(held_out, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            if spans:
                columns.append(pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "passages"][: len(columns)])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and, with `spans`, the significant passages (token offsets and score)."""
    model = train(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.rate, model.factor, model.slope, model.offset))
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return texts(docs).mapInArrow(_score(shared, spans), schema + (", passages array<struct<start:int,end:int,score:double>>" if spans else ""))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
