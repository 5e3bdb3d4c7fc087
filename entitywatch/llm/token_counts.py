"""Token counts: the exact number of byte-level BPE tokens of every prefix of a text.

Method, prefix dynamic programming. The tokens of a prefix are those of a shorter prefix plus one last token, and just one
token that ends there fits: the one that stays apart from the last token before it when BPE runs over both. So a table
from each prefix to its last token and count is filled from left to right, for many words at a time in NumPy, and answers
how many tokens any prefix has, or how much of a text fits a budget, without encoding again. Words are independent in
byte-level BPE, so the table of a text is made of word tables; words met before come from a bounded cache.

Whether two tokens stay apart is decided by undoing their merges along the seam, latest first: they do, unless some pair
across the seam would have merged earlier than the merges that made both.

Defined results: null and empty texts have no tokens; special strings in a text count as one token, as the library has
them by default; a prefix that ends inside a special string is ordinary text. Works on one row at a time, so repeated
rows, ties and hot groups don't matter; extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, texts
from .text import chunked, prefix_sums, span_hashes

LIMIT = 512
CACHED_WORDS = 1_000_000
# fixed values: the characters of \s, and the contractions that the split pattern keeps apart
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = "stmd", ("re", "ve", "ll")
OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary files are; every executor has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def character_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE] = BLANK
    out[32] = SPACE
    return out


def _byte_alphabet() -> dict[str, int]:
    """The visible character that stands for each byte in the vocabulary file."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def split_words(chars: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """First and last + 1 of the words that byte-level BPE encodes apart, for texts after each other.

    Also the places one character into a contraction of three, which a shorter text would split there.
    """
    n = len(chars)
    white = kind >= BLANK
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    filled = bounds[1:] > bounds[:-1]
    head[bounds[:-1][filled]] = True
    tail[bounds[1:][filled] - 1] = True
    prev_white, prev_kind = np.concatenate([[False], white[:-1]]), np.concatenate([[OTHER], kind[:-1]])
    next_word = np.concatenate([~white[1:], [False]]) & ~tail
    start = np.where(white, ~prev_white | next_word, np.where(prev_white, prev_kind == BLANK, prev_kind != kind)) | head
    broken = []
    padded = np.concatenate([chars, [0, 0]])
    for q in np.flatnonzero((chars == 39) & start & ~tail).tolist():
        one, two = chr(padded[q + 1]), "" if tail[q + 1] else chr(padded[q + 2])
        size = 2 if one in SHORT_CONTRACTIONS else 3 if one + two in LONG_CONTRACTIONS else 0
        if size:
            start[q + 1 : q + size] = False
            if q + size < n:
                start[q + size] = True
            if size == 3:
                broken.append(q + 1)
    first = np.flatnonzero(start)
    return first, np.concatenate([first[1:], [n]]), broken


class PrefixTokenizer:
    """Counts for every prefix. Tokens are numbered by rank: bytes first, then merges in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_alphabet()
        self.special = [x["content"] for x in spec["added_tokens"]]
        number = {bytes([b]): b for b in range(256)}
        left, right = list(range(256)), list(range(256))
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (bytes(byte_of[c] for c in x) for x in (a, b))
            left.append(number[a])
            right.append(number[b])
            number[a + b] = 256 + k
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        n = len(left)
        pairs = (self.left << 20) | self.right
        pairs[:256] = -1
        self.pair_order = np.argsort(pairs, kind="stable")[256:]
        self.pair_keys = pairs[self.pair_order]
        joined = b"".join(number)
        ends = np.cumsum([len(x) for x in number])
        sums = prefix_sums(np.frombuffer(joined, np.uint8))
        lengths = np.array([len(x) for x in number])
        hashes = span_hashes(sums, ends - lengths, ends)
        numbers = np.array(list(number.values()), np.int64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order]
        # which values of 20 bits occur: spares most searches
        self.token_bits, self.pair_bits = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        self.token_bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        self.pair_bits[self._pair_slot(self.left[256:], self.right[256:])] = True
        self.longest = int(lengths.max())
        alone = np.ones(n, bool)
        merged = np.arange(256, n)
        apart = self.apart(self.left[256:], self.right[256:], merged)
        for k in merged[~apart]:
            alone[k] = False
        for k in merged:  # a token made of one that BPE would never leave whole isn't reached either
            alone[k] &= alone[self.left[k]] and alone[self.right[k]]
        self.alone = alone
        self.kinds = character_classes()
        self.reset()

    def reset(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_at = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    @staticmethod
    def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 40503 + b * 1299709) & 0xFFFFF

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge to, or a very large number."""
        out = np.full(len(a), 1 << 40, np.int64)
        maybe = np.flatnonzero(self.pair_bits[self._pair_slot(a, b)])
        key = (a[maybe] << 20) | b[maybe]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        out[maybe] = np.where(self.pair_keys[at] == key, self.pair_order[at], 1 << 40)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE leaves tokens a and b side by side; `limit`: merges from this rank on are not looked at."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 39, np.int64) if limit is None else limit.astype(np.int64)
        while at.size:
            clash = self._merged(a, b) < limit
            out[at[clash]] = False
            go = ~clash
            at, a, b, limit = at[go], a[go], b[go], limit[go]
            # undo the later of the two merges; a byte can't be undone, then it is the other's turn
            first = ((a > b) & (a >= 256)) | (b < 256)
            ended = first & (a < 256)
            limit = np.where(first, np.minimum(a, limit), np.minimum(b + 1, limit))
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            go = ~ended
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def _tables(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts for the prefixes 0..length of each word, flat, and where each word's begin."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        counts, last = np.zeros(begins[-1], np.int32), np.zeros(begins[-1], np.int64)
        sums = prefix_sums(data)
        descending = lengths[order]
        for e in range(1, int(descending[0]) + 1 if len(order) else 1):
            open_ = order[: np.searchsorted(-descending, -e, side="right")]
            for size in range(min(e, self.longest), 0, -1):
                stop = starts[open_] + e
                h = span_hashes(sums, stop - size, stop)
                maybe = np.flatnonzero(self.token_bits[(h >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                same = self.hashes[at] == h[maybe]
                hit = maybe[same]
                if not hit.size:
                    continue
                token, word = self.numbers[at[same]], open_[hit]
                before = begins[word] + e - size
                good = self.alone[token] if size == e else self.apart(last[before], token)
                token, word, before = token[good], word[good], before[good]
                here = begins[word] + e
                last[here], counts[here] = token, counts[before] + 1
                if good.any():
                    found = np.zeros(len(open_), bool)
                    found[hit[good]] = True
                    open_ = open_[~found]
                    if not open_.size:
                        break
        return counts, begins[:-1]

    def _word_tables(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word where its table begins in the flat counts; new words are worked out and kept."""
        codes, distinct = pd.factorize(span_hashes(prefix_sums(data), starts, ends))
        sample = np.empty(len(distinct), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.known) > CACHED_WORDS:
            self.reset()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            flat, begins = self._tables(data, starts[sample[new]], ends[sample[new]])
            hashes, begins = np.concatenate([self.known, distinct[new]]), np.concatenate([self.known_at, begins + len(self.flat)])
            order = np.argsort(hashes, kind="stable")
            self.known, self.known_at, self.flat = hashes[order], begins[order], np.concatenate([self.flat, flat])
        return self.known_at[np.searchsorted(self.known, distinct)][codes], self.flat

    def prefix_counts(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each character of all strings, one after the other, and the bounds of each string.

        Special strings are taken as ordinary text here.
        """
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        chars = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        n = len(chars)
        if not n:
            return np.empty(0, np.int32), bounds
        kind = self.kinds[chars]
        first, stop, broken = split_words(chars, kind, bounds)
        tail = np.zeros(n, bool)
        tail[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        white = kind >= BLANK
        word = np.repeat(np.arange(len(first)), stop - first)
        # white space before a word keeps its last character out; a prefix that ends there has the whole run as one
        run = white[stop - 1] & ~tail[stop - 1] & np.concatenate([white, [False]])[stop]
        wide = (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(wide)])
        data = np.frombuffer("".join(strings).encode("utf-8"), np.uint8)
        table_at, flat = self._word_tables(data, at[first], at[stop + run])
        totals = flat[table_at + (at[stop] - at[first])].astype(np.int64)
        base = np.cumsum(totals) - totals
        ends = at[1:]
        inside = flat[table_at[word] + (ends - at[first][word])]
        counts = base[word] + inside
        # the last character of such a run
        k = np.flatnonzero(run)
        counts[stop[k]] = base[k] + flat[table_at[k] + (at[stop[k] + 1] - at[first[k]])]
        if broken:
            counts[broken] = base[word[broken]] + 2
        offset = base[word[np.minimum(bounds[:-1], n - 1)]]
        return (counts - np.repeat(offset, bounds[1:] - bounds[:-1])).astype(np.int32), bounds

    def text_counts(self, strings: list[str]) -> list[np.ndarray]:
        """For each string the counts after each character, special strings as one token."""
        counts, bounds = self.prefix_counts(strings)
        out = [counts[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k, s in enumerate(strings):
            if any(x in s for x in self.special):
                out[k] = self._with_special(s)
        return out

    def _with_special(self, s: str) -> np.ndarray:
        out, base, at = [], 0, 0
        while True:
            found = [(s.find(x, at), -len(x)) for x in self.special if s.find(x, at) >= 0]
            begin, stop = (min(found)[0], min(found)[0] - min(found)[1]) if found else (len(s), len(s))
            plain = base + self.prefix_counts([s[at:begin]])[0]
            out.append(plain)
            if not found:
                return np.concatenate(out).astype(np.int32)
            inside = base + self.prefix_counts([s[at:stop]])[0][begin - at :]
            base = (int(plain[-1]) if len(plain) else base) + 1
            inside[-1] = base
            out.append(inside)
            at = stop


_LOADED: dict[str, PrefixTokenizer] = {}


def tokenizer(path: str) -> PrefixTokenizer:
    if path not in _LOADED:
        _LOADED[path] = PrefixTokenizer(path)
    return _LOADED[path]


def _decoded(texts_: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts_]


def _counter(path: str, limit: int, tables: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizer(path)
        for batch in batches:
            for first, held in chunked(batch.column("text").to_pylist()):
                counts = counter.text_counts(_decoded(held))
                totals = [int(c[-1]) if len(c) else 0 for c in counts]
                fits = [int(np.max(np.flatnonzero(c <= limit), initial=-1)) + 1 for c in counts]
                columns = [
                    batch.column("doc_id").slice(first, len(held)), pa.array([len(t) for t in held], pa.int64()), pa.array(totals, pa.int64()),
                    pa.array([t > limit for t in totals]), pa.array(fits, pa.int64()),
                ]
                if tables:
                    columns.append(pa.array([c.astype("<i4").tobytes() for c in counts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars", "prefix_counts"][: len(columns)])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars (longest prefix, in characters, of at most `limit` tokens).

    With `tables` also prefix_counts: the count after each character, as little-endian 32-bit numbers.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
    return texts(docs).mapInArrow(_counter(path, limit, tables), schema + (", prefix_counts binary" if tables else ""))


def op2_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), path or vocabulary_path())
