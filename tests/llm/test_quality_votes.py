"""Voting of neighbours: held-out accuracy, brute force over the labelled vectors, odd rows."""

import random
import zlib

import numpy as np
from helpers import prose

from entitywatch.llm import quality_votes as qv

LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    pick, texts, labels = random.Random(8), [], []
    for k in range(n):
        words = prose(k, pick.randint(20, 120))
        good = pick.random() < 0.7
        if not good:
            words = [words[0]] * len(words) if k % 2 else [w + "%%%" for w in words]
        texts.append(" ".join(words))
        labels.append((k, int(good), 0))
    return texts, labels


def brute_force(model, counts):
    """Scores with plain loops."""
    out = []
    for row in counts:
        x = qv.weighted(row[None, :].copy(), model.inverse)[0] @ model.directions
        cosines = [float(x @ v) / max(float(np.linalg.norm(x)), 1e-12) for v in model.vectors]
        best = sorted(range(len(cosines)), key=lambda k: (-cosines[k], k))[: qv.NEIGHBOURS]
        weights = [max(cosines[k], 0) ** qv.SHARPNESS for k in best]
        out.append(sum(w * model.labels[k] for w, k in zip(weights, best)) / sum(weights) if sum(weights) else model.prior)
    return np.array(out)


def test_held_out_rows_and_brute_force(spark, make_docs):
    texts, labels = corpus(700)
    docs, known = make_docs(texts).repartition(4), spark.createDataFrame(labels, LABELS)
    rows = {r.doc_id: r for r in qv.quality_votes(docs, known).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(rows) == 700 and {k for k, r in rows.items() if r.held_out} == set(held)
    assert np.mean([rows[k].predicted == labels[k][1] for k in held]) > 0.97
    model = qv.train(docs, known)
    counts = np.concatenate(list(qv.term_counts([t.encode() for t in texts[:60]])))
    assert np.allclose(brute_force(model, counts), [rows[k].score for k in range(60)], atol=1e-4)
    flipped = spark.createDataFrame([(k, 1 - q if k in held else q, 1) for k, q, _ in labels], LABELS)
    assert {r.doc_id: r.score for r in qv.quality_votes(docs, flipped).collect()} == {k: r.score for k, r in rows.items()}


def test_inverse_frequencies_count_every_document(make_docs):
    texts = [" ".join(prose(k, 30)) for k in range(90)] + [None, "", "ab"]
    inverse = qv.inverse_frequencies(make_docs(texts).repartition(5))
    counts = np.concatenate(list(qv.term_counts([(t or "").encode() for t in texts])))
    assert np.allclose(inverse, np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1)


def test_copies_vote_once_and_directions_are_singular_vectors():
    rng = np.random.default_rng(9)
    counts = rng.poisson(0.02, (80, qv.SLOTS)).astype(np.float32)
    labels = rng.integers(0, 2, 80).astype(float)
    inverse = np.ones(qv.SLOTS, np.float32)
    copies = qv.VotingModel.fit(np.concatenate([counts, counts[:30], counts[:30]]), np.concatenate([labels, labels[:30], labels[:30]]), inverse)
    assert len(copies.labels) == 80 and (copies.labels == labels).all()
    rows = np.diag(np.linspace(9, 1, 20)) @ np.linalg.qr(rng.normal(size=(50, 20)))[0].T
    found = qv.latent_directions(rows.astype(np.float32), 5)
    assert np.allclose(np.abs(np.linalg.svd(rows)[2][:5] @ found), np.eye(5), atol=1e-3)


def test_odd_tables(spark, odd_docs, no_docs):
    known = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (4, 0, 0), (6, None, 0), (None, 1, 1), (99, 1, 1)], LABELS)
    rows = qv.quality_votes(odd_docs, known).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all((r.held_out is None) == (r.doc_id is None) for r in rows)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in qv.quality_votes(odd_docs, none).collect()} == {0.5}
    assert qv.quality_votes(no_docs, known).count() == 0
