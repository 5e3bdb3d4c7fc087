"""Jaccard join, passages and repeats against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import prose

from entitywatch.llm import jaccard_join, passages, repeat_index
from entitywatch.llm.text import window_hashes


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def linked(rows):
    """component of each row number, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
                root[b] = a
    return [rows[find(i)][0] for i in range(len(rows))], [len(s) for s in sets]


def family(seed, size, copies):
    """A text and copies with a few changed words, so that chains of links arise."""
    words = prose(seed, size, 900)
    out = []
    for k in range(copies):
        own = list(words)
        for j in range(k):
            own[(37 * j + 11 * k) % size] = f"w{k}x{j}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def corpus():
    common = " ".join(prose(50, 60))
    texts = family(10, 200, 9) + family(11, 60, 6) + family(12, 900, 5) + [" ".join(prose(100 + k, 120)) + " " + common for k in range(25)]
    return texts + [texts[0], texts[0], texts[30], None, "", "a b", "A b", " "]


@pytest.mark.parametrize("region_shingles", [4_000_000, 700])
def test_components(make_docs, corpus, region_shingles):
    rows = jaccard_join.document_components(make_docs(corpus), region_shingles=region_shingles).collect()
    expected, sizes = linked(list(enumerate(corpus)))
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in rows} == {k: (expected[k], sizes[k]) for k in range(len(corpus))}


def test_components_of_odd_tables(odd_docs, no_docs):
    rows = jaccard_join.document_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 6, 7)) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (6, 6), (7, 6)]
    assert sorted(r.component_id or 0 for r in rows if r.doc_id is None) == [0, 1]
    assert jaccard_join.document_components(no_docs).count() == 0
    kept = jaccard_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "4", "5", "6", "8", "None"]


def test_triangle_windows_lose_no_link():
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 40, 400, replace=False).astype(np.uint64)
    sets = [np.sort(np.where(rng.random(400) < rate, base, rng.choice(1 << 40, 400).astype(np.uint64))) for rate in rng.uniform(0.6, 1, 60)]
    ids = np.arange(60)

    def groups(links):
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(k) for k in range(60)]

    brute = []
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (800 - both):
                brute.append((i, j))
    assert groups(jaccard_join.region_links(ids, sets, np.zeros(60, bool))) == groups(brute)


def test_members_of_two_pivots_are_compared():
    """A chain in which only neighbours link: whatever the order, its parts around different pivots are connected."""
    sets = [np.arange(11 * k, 11 * k + 100).astype(np.uint64) for k in range(6)]
    for order in itertools.permutations(range(6)):
        links = jaccard_join.region_links(np.arange(6), [sets[k] for k in order], np.zeros(6, np.int64))
        reached = {0}
        for _ in range(6):
            reached |= {x for pair in links if reached & set(pair) for x in pair}
        assert reached == set(range(6))


@pytest.mark.parametrize("region_shingles", [4_000_000, 450, 150])
def test_chains_stay_whole(make_docs, region_shingles):
    texts = [" ".join(f"c{c}w{k}" for k in range(11 * n, 11 * n + 104)) for n in range(6) for c in range(12)]
    rows = jaccard_join.document_components(make_docs(texts), region_shingles=region_shingles).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: k % 12 for k in range(72)}


def removed(texts, length):
    counts = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, gone) if not x)
        yield len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("kinds", [2000, 30, 1])
def test_anchors_in_many_surroundings(make_docs, kinds):
    """A passage of which every copy has another word somewhere: refined anchors find the same bytes as one index."""
    pick, words = random.Random(12), prose(31, 70)
    texts = []
    for k in range(600):
        own = list(words)
        own[pick.randrange(len(own))] = f"w{k}"
        own[pick.randrange(len(own))] = f"v{k % 90}"
        texts.append(" ".join(own))
    rows = repeat_index.remove_repeats(make_docs(texts).repartition(4), kinds=kinds)[0].collect()
    expected = dict(enumerate(removed([t.encode() for t in texts], 200)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected
    assert sum(e[1] > 0 for e in expected.values()) > 300


def test_halves_keep_every_string():
    data, length = bytes(range(256)) * 2, 200
    part, low = data[: length + 140], 145
    rounds = [[(0, part, low, low + 48)]]
    while len(rounds) < 9:
        rounds.append([(o + f, d[f : f + n - 1 + length], a, b) for o, d, lo, hi in rounds[-1] for f, n, a, b in repeat_index.halves(d, lo, hi, length)])
        assert sorted(o + k for o, d, _, _ in rounds[-1] for k in range(len(d) - length + 1)) == list(range(141))
        assert all(0 <= a and len(d) - length <= a and b <= length for _, d, a, b in rounds[-1])
    assert all(len(d) == length and (a, b) == (0, length) for _, d, a, b in rounds[-1])


@pytest.mark.parametrize("kinds", [2000, 1])
def test_repeats(make_docs, corpus, kinds):
    texts = corpus + ["xyz" * 200, "q" * 199, "q" * 200 + "r", "é" * 150 + "x", "ab" + "é" * 150]
    rows = repeat_index.remove_repeats(make_docs(texts), kinds=kinds)[0].collect()
    expected = dict(enumerate(removed([(t or "").encode() for t in texts], 200)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected


def test_repeats_in_parts(make_docs, monkeypatch):
    texts = [" ".join(prose(5, 900)), " ".join(prose(5, 900)[200:700]) + " tail"]
    monkeypatch.setattr(repeat_index, "PART", 1000)
    data = [t.encode() for t in texts]
    rows = []
    for held, names in repeat_index._parts(data, [0, 1], 200):
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])])
        owner, start, count, _, _ = repeat_index.stretches(np.frombuffer(b"".join(held), np.uint8), bounds)
        rows += [(names[o][0], names[o][1] + s + k) for o, s, c in zip(owner.tolist(), start.tolist(), count.tolist()) for k in range(c)]
    assert sorted(rows) == [(u, k) for u, t in enumerate(data) for k in range(len(t) - 199)]


def test_matching_statistics():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 200)
    text = np.concatenate([text, text[20:90], [0]])
    got = repeat_index.RunLengthIndex(text).matching_statistics()
    raw = bytes(text.astype(np.uint8))
    for k in range(len(raw)):
        longest = max(n for n in range(len(raw) - k + 1) if n == 0 or raw.find(raw[k : k + n]) != k or raw.find(raw[k : k + n], k + 1) >= 0)
        assert got[k] == longest


def test_repeats_of_odd_tables(odd_docs, no_docs):
    rows = repeat_index.remove_repeats(odd_docs)[0].collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id == 1) and all(r.n_bytes == 0 for r in rows if r.doc_id == 3)
    assert repeat_index.remove_repeats(no_docs)[0].count() == 0


def test_compact_windows():
    order = np.random.default_rng(2).integers(0, 1 << 62, 300).astype(np.uint64)
    at, first, last = passages.compact_windows(order, 20)
    covered = {}
    for c, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
        assert order[a : b + 1].min() == order[c] and b - a >= 19
        assert (a == 0 or order[a - 1] < order[c]) and (b == 299 or order[b + 1] < order[c])
        covered[c] = (a, b)
    for i in range(0, 280):
        for j in (i + 19, min(i + 60, 299)):
            c = i + int(order[i : j + 1].argmin())
            assert covered[c][0] <= i and covered[c][1] >= j


def test_passages(make_docs):
    shared = prose(70, 80, 2000)
    changed = shared[:40] + ["other"] + shared[41:]
    texts = [" ".join(prose(k, 150, 2000) + (shared if k % 2 else changed) + prose(k + 500, 100, 2000)) for k in range(20)]
    texts += [" ".join(prose(900, 40)), " ".join(prose(901, 40)), texts[3], texts[3], " ".join(prose(77, 200) + prose(70, 30, 2000)), None, ""]
    found, classes = passages.passages(make_docs(texts))
    ids = {r.uid: r.representative for r in classes.collect()}
    rows = found.collect()
    assert {ids[x] for r in rows for x in (r.uid, r.other)} == set(range(20))
    for r in rows:
        assert r.similarity >= 0.8 and 150 <= r.start + 3 and r.end <= 233 and r.end - r.start >= 50


def test_passages_recall(make_docs, corpus):
    found, classes = passages.passages(make_docs(corpus))
    ids = {r.uid: r.representative for r in classes.collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in found.collect():
        root[find(ids[r.uid])] = find(ids[r.other])
    own = [list(passages._shingles([(t or "").encode()], 5))[0] for t in corpus]
    holders = {}
    for k, s in enumerate(own):
        for h in window_hashes(s, 46).tolist():
            holders.setdefault(h, set()).add(min(j for j in range(len(corpus)) if corpus[j] == corpus[k]))
    pairs = {(min(x), y) for x in holders.values() for y in x if y != min(x)}
    assert sum(find(a) == find(b) for a, b in pairs) >= 0.97 * len(pairs) > 0


def edited(seed, length, edits):
    """Two texts around a passage and a copy with changed, added or left out words; the best similarity of both passages."""
    pick = np.random.default_rng(seed)
    passage = prose(seed, length, 2000)
    copy = list(passage)
    for k, at in enumerate(sorted(pick.choice(np.arange(5, length - 5), edits, replace=False).tolist(), reverse=True)):
        copy[at : at + int(pick.integers(0, 2))] = [f"new{k}"] * int(pick.integers(0, 2))
    one, two = prose(seed + 5000, 70, 2000) + passage + prose(seed + 6000, 40, 2000), prose(seed + 7000, 30, 2000) + copy + prose(seed + 8000, 90, 2000)
    a, b = shingles(" ".join(passage)), shingles(" ".join(copy))
    return " ".join(one), " ".join(two), len(a & b) / len(a | b) if min(len(passage), len(copy)) >= 50 else 0


def test_edited_passages_are_verified():
    """Passages of 50 to 130 words that differ by one to four words, each that is similar enough as a whole."""
    asked = 0
    for seed in range(400):
        length, edits = 50 + seed % 81, 1 + seed % 4
        one, two, similarity = edited(seed, length, edits)
        if similarity < 0.8:
            continue
        asked += 1
        mine, theirs = passages._shingles([one.encode(), two.encode()], 5)
        found = passages.verified_passages(mine, theirs, 46, 80)
        assert any(a <= 70 and b >= 70 + length - 4 and s >= 0.8 for a, b, _, _, s in found), (seed, length, edits, similarity)
    assert asked > 150


def test_passages_with_one_word_changed(make_docs):
    """The shared passage is reported at every length, not only where one side of the change is long enough alone."""
    lengths = [60, 70, 80, 90, 95]
    texts, pairs = [], []
    for k in range(40):
        shared = prose(3000 + k, lengths[k % 5], 2000)
        half = len(shared) // 2
        for own in (shared, shared[:half] + ["other"] + shared[half + 1 :]):
            texts.append(" ".join(prose(4000 + len(texts), 60, 2000) + own + prose(5000 + len(texts), 60, 2000)))
        pairs.append((2 * k, 2 * k + 1))
    found, classes = passages.passages(make_docs(texts))
    ids = {r.uid: r.representative for r in classes.collect()}
    got = {tuple(sorted((ids[r.uid], ids[r.other]))) for r in found.collect()}
    assert got <= set(pairs) and len(got) >= 0.9 * len(pairs)


def test_passages_side_by_side_in_one_text():
    one, two, gap = prose(1, 60, 2000), prose(2, 70, 2000), prose(3, 80, 2000)
    mine, theirs = passages._shingles([" ".join(one + two).encode(), " ".join(two + gap + one).encode()], 5)
    assert sorted(r[:4] for r in passages.verified_passages(mine, theirs, 46, 80)) == [(0, 56, 150, 206), (60, 126, 0, 66)]


def test_passages_of_odd_tables(odd_docs, no_docs):
    assert passages.passages(odd_docs)[0].where("similarity < 0.8").count() == 0
    assert passages.passages(no_docs)[0].count() == 0


def test_representatives_with_a_part_of_a_passage_hide_no_pair(make_docs):
    """Pairs of texts share 60 words; six others have only 44 of these, too few for a passage of their own."""
    rng, texts = np.random.default_rng(5), []

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 10**9, n)]

    for _ in range(40):
        common = words(44)
        passage = words(8) + common + words(8)
        texts += [" ".join(words(40) + passage + words(40)) for _ in range(2)]
        texts += [" ".join(words(40) + common + words(40)) for _ in range(6)]
    found, classes = passages.passages(make_docs(texts))
    ids = {r.uid: r.doc_id for r in classes.collect()}
    place = {d: k for k, d in enumerate(sorted(ids.values()))}
    pairs = {tuple(sorted((place[ids[r.uid]], place[ids[r.other]]))) for r in found.collect() if r.end - r.start >= 50}
    assert {(8 * k, 8 * k + 1) for k in range(40)} <= pairs


def test_windows_of_a_task_align_as_those_of_several_tasks_do():
    """An overlap of `width` is enough in a task too; what doesn't align with the star goes on, as do its further windows."""
    key, function = np.full(4, 7), np.zeros(4, np.int64)
    uid, at = np.array([1, 2, 3, 4]), np.array([100, 100, 100, 100])
    star = int(np.argmin(passages._priority(uid, function)))
    first, last = at - 60, at + 60
    first[star], last[star] = 100, 145
    first[(star + 1) % 4], last[(star + 1) % 4] = 60, 136
    first[(star + 2) % 4], last[(star + 2) % 4] = 60, 110
    sent, joined = passages._join_star(key, uid, function, at, first, last, 36)
    assert sorted(sent[1]) == sorted([uid[star], uid[(star + 2) % 4]])
    assert sorted(joined[1]) == sorted([uid[(star + 1) % 4], uid[(star + 3) % 4]])
