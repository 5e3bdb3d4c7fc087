"""Alignment of two vocabularies against a plain computation over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import prose

from entitywatch.llm import alignment
from entitywatch.llm.token_counts import vocabulary_path

PATHS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
PIECES = ["a", "the ", " ", "  ", "\n", "\t", "'s", "I'm", "123", "é", "ñ!", "...", "😀", "漢字 ", "\r\n ", " \x1c ", "\xa0", "  ", "<s>", "<|endoftext|>", "<0x41>", "\x00", " x\u200b y", "\ufeff"]


@pytest.fixture(scope="module")
def libraries():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(text, libraries, characters=alignment.byte_characters()):
    """(ids a, ids b, groups, links) over the whole text, by nested steps."""
    lib_a, lib_b = libraries
    raw = b" " + (text or "").encode()
    a, b = (lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)) if text else ([], [])
    bytes_a = [bytes(characters[c] for c in lib_a.id_to_token(k)) for k in a]
    names = [lib_b.id_to_piece(k) for k in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, names)]
    if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    common = sorted(set(ends_a) & set(ends_b))
    groups, last = [], 0
    for end in common:
        groups.append(([k for k, e in zip(a, ends_a) if last < e <= end], [k for k, e in zip(b, ends_b) if last < e <= end]))
        last = end
    links = [(x, y) for x, e, s in zip(a, ends_a, [0, *ends_a]) for y, f, t in zip(b, ends_b, [0, *ends_b]) if max(s, t) < min(e, f)]
    return a, b, groups, links


def expected(texts, libraries):
    parts = [plain(t, libraries) for t in texts]
    count = Counter(link for *_, links in parts for link in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in parts:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out, count


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_merge_to_the_whole(piece):
    rng = np.random.default_rng(piece)
    for n, m in ((0, 0), (0, 5), (9, 0), (300, 40), (40, 300)):
        a, b = np.sort(rng.integers(0, 200, n)), np.sort(rng.integers(0, 200, m))
        cut_a, cut_b = alignment.merge_path(a, b, piece)
        assert set(np.diff(cut_a + cut_b)[:-1].tolist()) <= {piece}
        values, from_b = alignment.merged(a, b, piece)
        order = sorted([(int(x), False) for x in a] + [(int(x), True) for x in b])
        assert list(zip(values.tolist(), from_b.tolist())) == order


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40, 0])
def test_every_document_against_the_plain_computation(spark, make_docs, libraries, hot_pairs, monkeypatch):
    pick = random.Random(6)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 14))) for _ in range(150)]
    texts += [" ".join(prose(k, 60)) for k in range(30)] * 2 + [None, "", " ", "  x", "x ", "one▁two", " ".join(prose(99, 700)), "z" * 500]
    docs = make_docs(texts, ids=[None if k % 50 == 49 else k for k in range(len(texts))]).repartition(3)
    rows, pairs = alignment.align(docs, *PATHS, hot_pairs=hot_pairs)
    result, count = expected(texts, libraries)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter(tuple(r[c] for c in names) for r in rows.collect())
    assert got == Counter((None if k % 50 == 49 else k, *r) for k, r in enumerate(result))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(count)


def test_long_texts_go_in_parts(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 300)
    encoder = alignment.Encoder(*PATHS)
    text = " ".join(prose(5, 400))
    numbers = encoder.numbers(encoder.cut(text))
    doc = alignment._Doc(1, 7, numbers)
    parts = [(doc, numbers[k : k + 50], k + 50 >= len(numbers)) for k in range(0, len(numbers), 50)]
    rows = [alignment._flush(encoder, [p], len(encoder.b.bytes))[1][0] for p in parts]
    (result,), _ = expected([text], libraries)
    assert tuple(sum(r[k] for r in rows) for k in range(2, 6)) == result[:4] and rows[-1][-1] == result[-1]


def test_odd_tables(odd_docs, no_docs, libraries):
    texts = [r.text for r in odd_docs.collect()]
    rows, _ = alignment.align(odd_docs, *PATHS)
    short = [t if t is None or len(t) < 10_000 else "" for t in texts]
    result, _ = expected(short, libraries)
    known = Counter((r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in rows.collect())
    assert sum(known.values()) == len(texts)
    assert all(known[(*r[:4], r[-1])] for t, r in zip(short, result) if t)
    assert alignment.align(no_docs, *PATHS)[0].count() == 0
