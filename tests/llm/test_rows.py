"""Token counts, packing, quality rules, toxicity: whole texts, row by row."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import prose

from entitywatch.llm import packing, quality_rules, token_counts, toxicity
from entitywatch.llm.text import chunk_words, window_hashes

PIECES = ["a", "the ", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'l", "'re", "I'm", "1", "23", "é", "ñ!", "...", "😀", "漢字", " ", "\r\n", "#$%", " (", "tion", "ABC", "0's", "\x1c", "²"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())


def test_every_prefix_counts_as_in_the_library(library):
    pick = random.Random(4)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 12))) for _ in range(300)]
    texts += ["x<|endoftext|> y", "<|endoftext|><|endoftext|>", "  <|endoftext|>", "<|endoftext", "", " ".join(prose(3, 60)), "z" * 300, "=" * 200]
    counter = token_counts.PrefixTokenizer(token_counts.vocabulary_path())
    for text, counts in zip(texts, counter.text_counts(texts)):
        steps = range(1, len(text) + 1)
        assert counts.tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in steps], text


def test_token_counts(odd_docs, no_docs, library):
    texts = [r.text or "" for r in odd_docs.collect()]
    rows = token_counts.token_counts(odd_docs, token_counts.vocabulary_path(), limit=50, tables=True).collect()
    assert len(rows) == len(texts) and token_counts.token_counts(no_docs, token_counts.vocabulary_path()).count() == 0
    expected = Counter((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert Counter((r.n_bytes, r.n_tokens) for r in rows) == expected
    for r in rows:
        table = np.frombuffer(r.prefix_counts, "<i4")
        assert r.over_limit == (r.n_tokens > 50) and (r.fits_chars == len(table) or table[r.fits_chars] > 50)


def test_packing_gives_every_text_back(odd_docs, no_docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = token_counts.vocabulary_path("byte_bpe_50k.tiktoken")
    encoder = packing.WordEncoder(path)
    rows = packing.pack(odd_docs.coalesce(1), path, row_tokens=256, flush_tokens=20_000).collect()
    pieces = []
    for row in rows:
        ids, bounds = np.frombuffer(row.ids, "<u2"), row.cu_seqlens
        assert len(ids) == 256 and bounds[-1] == row.n_tokens and row.position_resets == bounds[:-1]
        assert (ids[row.n_tokens :] == encoder.end).all()
        assert packing.position_ids(bounds).tolist() == [k - a for a, b in zip(bounds[:-1], bounds[1:]) for k in range(a, b)]
        pieces += [(d, o, ids[a:b].tolist()) for d, o, a, b in zip(row.doc_ids, row.doc_offsets, bounds[:-1], bounds[1:])]
    assert isinstance(encoder.encoding, tiktoken.Encoding)
    texts = Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    ends, whole = Counter(), Counter()
    for d, _, ids in pieces:
        ends[d] += ids.count(encoder.end)
    assert ends == Counter(d for d, t in texts.elements())
    for doc in (2, 4, 5, 6, 8):
        ids = [i for _, _, part in sorted(p for p in pieces if p[0] == doc) for i in part]
        whole[doc, encoder.encoding.decode(ids[:-1])] += 1
    assert all(texts[key] for key in whole)
    assert packing.pack(no_docs, path).count() == 0


def test_best_fit_decreasing():
    sizes = np.random.default_rng(5).integers(1, 101, 400)
    rows = packing.best_fit(sizes, 100)
    assert sorted(p for r in rows for p in r) == list(range(400))
    room = []
    for piece in np.argsort(-sizes, kind="stable"):
        fit = [x for x in room if x >= sizes[piece]]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - sizes[piece])
        else:
            room.append(100 - sizes[piece])
    assert len(rows) == len(room) and sorted(100 - sizes[r].sum() for r in rows) == sorted(room)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {j for k, w in enumerate(windows) if count[w] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_base_counts():
    pick = random.Random(6)
    texts = ["", " \n", "a b " * 20, "x\ny\nx\n\n \ny z\n"] + ["".join(pick.choice(["a", "bb", "é", " ", "  ", "\n", "#", "|<", "\x0b", " ", "😀 "]) for _ in range(200)) for _ in range(60)]
    for text in texts:
        words, _ = chunk_words([text.encode()])
        assert quality_rules.base_counts(words, text.encode()) == brute_counts(text)


def test_character_ngrams_are_of_code_points():
    held = [("né" * 40).encode(), b"", "日本語の文".encode() * 3, b"ab", b"\xff\xfe bad"]
    kinds, _, _ = quality_rules.ngram_slots(held)
    for (slots, (first, last)), n in zip(kinds[:2], (3, 5)):
        for text, a, b in zip(held, first.tolist(), last.tolist()):
            text = text.decode("utf-8", "replace")
            grams = [text[k : k + n] for k in range(len(text) - n + 1)]
            assert b - a == len(grams)
            seen = {}
            assert all(seen.setdefault(g, s) == s for g, s in zip(grams, slots[a:b].tolist()))
            assert len(set(seen.values())) == len(seen)


def test_a_very_long_labelled_text(spark, make_docs):
    docs = make_docs(["good words here " * 3, "BAD ### " * 200_000] * 10)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(20)], "doc_id long, quality int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert all((r.good_probability > 0.5) == (r.doc_id % 2 == 0) for r in rows)


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    """Prose, shouting and symbols, and toxic words with many endings; labels for half of them."""
    pick = random.Random(8)
    texts, good, toxic = [], [], []
    for k in range(600):
        words = prose(1000 + k, pick.randint(30, 120))
        bad, rude = k % 5 == 0, k % 7 == 0
        if rude:
            for _ in range(3):
                words[pick.randrange(len(words))] = "grumb" + pick.choice(["le", "lor", "ling", "ler", "lings"])
        texts.append(" ".join(w.upper() + "!!" if bad and k % 2 else w + "###" if bad else w for w in words))
        good.append(int(not bad))
        toxic.append(int(rude))
    labels = spark.createDataFrame([(k, good[k], toxic[k]) for k in range(0, 600) if k % 3] + [(1, None, None), (None, 0, 1), (10_000, 0, 1)], "doc_id long, quality int, toxic int")
    return make_docs(texts), labels, good, toxic


def test_quality_rules(labelled, odd_docs, no_docs):
    docs, labels, good, _ = labelled
    rows = quality_rules.quality_rules(docs, labels).collect()
    held = [r for r in rows if r.doc_id % 3 == 0]
    assert np.mean([r.kept == bool(good[r.doc_id]) for r in held]) > 0.97
    again = quality_rules.quality_rules(docs.repartition(5), labels).collect()
    assert sorted((r.doc_id, r.kept) for r in rows) == sorted((r.doc_id, r.kept) for r in again)
    kept = quality_rules.keep_good(docs, docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    odd = quality_rules.quality_rules(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and not any(r.kept for r in odd if not r.n_words)
    assert quality_rules.keep_good(odd_docs, docs, labels).columns == odd_docs.columns
    assert quality_rules.quality_rules(no_docs, labels).count() == 0
    one_class = quality_rules.quality_rules(docs, labels.where("quality = 1")).collect()
    assert len({r.good_probability for r in one_class}) == 1


def test_toxicity(labelled, odd_docs, no_docs):
    docs, labels, _, toxic = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 300 and np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    assert all(r.passages and max(p.end for p in r.passages) for r in rows if r.predicted)
    odd = toxicity.toxicity(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score < 0.7 for r in odd)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert len({r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()}) == 1


def test_held_out_labels_change_nothing(labelled):
    from pyspark.sql import functions as F

    docs, labels, _, _ = labelled
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert one == two


def test_segments_are_maximal():
    pick = random.Random(9)
    for _ in range(200):
        scores = [pick.choice([-3.0, -1.0, -0.5, 1.0, 2.0, 4.0]) for _ in range(pick.randint(0, 25))]
        found = toxicity.segments(scores)
        best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        assert max((s for *_, s in found), default=0) == max(best, 0)
        covered = {k for a, b, _ in found for k in range(a, b)}
        assert {k for k, s in enumerate(scores) if s > 0} <= covered
        assert all(a >= e for (_, e, _), (a, _, _) in zip(found, found[1:]))
        for a, b, s in found:  # no proper part is better
            assert s == sum(scores[a:b]) == max(sum(scores[x:y]) for x in range(a, b) for y in range(x + 1, b + 1))


def test_window_hashes_of_short_texts():
    assert len(window_hashes(np.arange(3, dtype=np.uint64), 5)) == 0
