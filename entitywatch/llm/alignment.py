"""Cross-tokenizer alignment: which tokens of one vocabulary (A) cover the same bytes as those of another (B).

Method, merge-path partitioning. Both tokenizations of a text are lists of token ends in bytes. Merging the two sorted
lists visits a grid from one corner to the other; the diagonals k * PIECE_ENDS of the grid meet that path at points which
a binary search finds without merging, for all diagonals at once. Between two diagonals lies a piece with the same
number of ends as every other, whatever the texts look like, and each is merged by itself. In merged order each
distinct end is an overlap of the A token and the B token that are open there; an end of both lists closes a group. Ends
that two pieces share, and groups over several pieces, are stitched at the pieces' borders.

On Spark a task aligns texts in chunks of some CHUNK_BYTES, a long text in several. Both tokenizers treat a run that
begins with a single space between two visible characters as if nothing stood before it (no token reaches over the space,
which is checked for B's vocabulary), so texts are cut there and each cut word is encoded once per task, in a bounded
cache. Links stay in packed chunks, in a table in the shared folder. Their counts over the corpus are added up by tasks
and then by pair. Counts of at most HOT_PAIRS pairs, the most frequent, go to all tasks (16 bytes a pair); what other
links a document has is counted by a join on the pair, so results don't depend on that bound.

Defined results: texts that are null, empty, not valid UTF-8, or not given back by one of the tokenizers (such as those
with U+2581) have no tokens: zeros and an empty hash. Each row is a document of its own, also if ids repeat or are null;
repeated texts count once per row. A pair's rank ties with equal counts. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialize, table, texts
from .token_counts import vocabulary_path

#: Token ends in a piece between two diagonals.
PIECE_ENDS = 4096
#: Bytes of text aligned at a time, and bytes of new words encoded at a time.
CHUNK_BYTES, RUN_BYTES = 1 << 20, 1 << 15
CACHED_WORDS = 300_000
#: Pairs whose counts are broadcast, at most; pairs a task counts before it hands them on.
HOT_PAIRS, HELD_PAIRS = 1 << 20, 1 << 21
#: Where a text may be cut: a space between characters that are no white space for either library.
_CUT = re.compile("(?<=[^\\s\\u180e\\u200b\\ufeff]) (?=[^\\s\\u180e\\u200b\\ufeff])")
_UNEVEN = re.compile("^ | $|[\\s\\u180e\\u200b\\ufeff] | [\\s\\u180e\\u200b\\ufeff]")
DOC = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: visible ones stand for themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Vocabulary:
    """Bytes of each id, their sizes, and each id as text before a comma or a closing sign."""

    def __init__(self, tokens: list[bytes], close: bytes) -> None:
        self.bytes = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.more = np.array([b"%d," % k for k in range(len(tokens))], object)
        self.last = np.array([b"%d" % k + close for k in range(len(tokens))], object)

    def joined(self, ids) -> bytes:
        return b"".join([self.bytes[k] for k in ids])


class _Ragged:
    """Lists of ids after each other."""

    def __init__(self) -> None:
        self.values, self.starts, self.used, self.rows = np.empty(1024, np.int32), np.zeros(1024, np.int64), 0, 0

    def extend(self, ids, ends) -> None:
        """Rows that end at `ends` in the ids."""
        while self.rows + len(ends) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + len(ids) > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.values[self.used : self.used + len(ids)] = ids
        self.starts[self.rows + 1 : self.rows + len(ends) + 1] = np.asarray(ends) + self.used
        self.used += len(ids)
        self.rows += len(ends)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of rows `at` after each other, and their lengths."""
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        before = np.cumsum(sizes) - sizes
        return self.values[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))], sizes


class Encoder:
    """Both tokenizers, and the ids of the words met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.lib_a, self.lib_b = tokenizers.Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.lib_a.encode_special_tokens = True
        byte_of = byte_characters()
        entries: list[str] = [""] * self.lib_a.get_vocab_size()
        for token, k in self.lib_a.get_vocab().items():
            entries[k] = token
        self.a = _Vocabulary([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in entries], b"|")
        pieces = [self.lib_b.id_to_piece(k) for k in range(self.lib_b.get_piece_size())]
        self.b = _Vocabulary([bytes([int(p[3:5], 16)]) if self.lib_b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)], b";")
        #: whether no piece reaches over a space
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.ids_a, self.ids_b, self.sizes, self.bad = _Ragged(), _Ragged(), [], []

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        return self.lib_a.encode(" " + text, add_special_tokens=False).ids, self.lib_b.encode(text)

    def _alone(self, words: list[str]) -> None:
        for word in words:
            raw = b" " + word.encode()
            a, b = self._ids(word)
            bad = self.a.joined(a) != raw or self.b.joined(b) != raw
            self._note([word], [len(raw)], bad)
            self.ids_a.extend([] if bad else a, [0 if bad else len(a)])
            self.ids_b.extend([] if bad else b, [0 if bad else len(b)])

    def _note(self, words: list[str], sizes: list[int], bad: bool) -> None:
        self.words.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.sizes.extend(sizes)
        self.bad.extend([bad] * len(words))

    def _run(self, words: list[str]) -> None:
        """Encode words that may stand after each other in one go."""
        text = " ".join(words)
        raw = b" " + text.encode()
        a, b = self._ids(text)
        sizes = [len(w) + 1 for w in raw[1:].split(b" ")]
        if len(sizes) != len(words) or self.a.joined(a) != raw or self.b.joined(b) != raw:
            return self._alone(words)
        ends, cuts = np.cumsum(sizes), []
        for ids, vocabulary in ((a, self.a), (b, self.b)):
            at = np.cumsum(vocabulary.size[ids])
            cut = np.searchsorted(at, ends)
            if (at[cut] != ends).any():
                return self._alone(words)
            cuts.append(cut + 1)
        self._note(words, sizes, False)
        self.ids_a.extend(a, cuts[0])
        self.ids_b.extend(b, cuts[1])

    def cut(self, text: str) -> list[str]:
        """Parts between which nothing crosses; joined by spaces they are the text."""
        if not self.cuttable:
            return [text]
        return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")

    def numbers(self, parts: list[str]) -> np.ndarray:
        """A number for each part, which is encoded if new."""
        held, size = [], 0
        for word in sorted(set(parts).difference(self.words)):
            if not word or word[0].isspace() or word[-1].isspace() or not self.cuttable:
                self._alone([word])
                continue
            held.append(word)
            size += len(word) + 1
            if size > RUN_BYTES:
                self._run(held)
                held, size = [], 0
        if held:
            self._run(held)
        return np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))


@functools.lru_cache(maxsize=2)
def encoder_of(path_a: str, path_b: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path_a, path_b)


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """How many of `a` and of `b` precede each diagonal k * piece of the merge of two sorted lists; `a` first among ties."""
    diagonal = np.minimum(np.arange(0, len(a) + len(b) + piece, piece), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        taken = np.zeros(len(low), bool)
        taken[open_] = a[middle[open_]] <= b[diagonal[open_] - 1 - middle[open_]]
        low, high = np.where(open_ & taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low, diagonal - low


def merged(a: np.ndarray, b: np.ndarray, piece: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether from b) of both sorted lists in order, each piece between diagonals merged by itself."""
    cut_a, cut_b = merge_path(a, b, piece)
    pieces = len(cut_a) - 1
    if pieces < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    of_a = np.repeat(np.arange(pieces), np.diff(cut_a))
    of_b = np.repeat(np.arange(pieces), np.diff(cut_b))
    rows = np.full(pieces * piece, np.iinfo(np.int64).max)
    rows[np.arange(len(a)) + cut_b[of_a]] = 2 * a
    rows[np.arange(len(b)) + cut_a[of_b + 1]] = 2 * b + 1
    rows = np.sort(rows.reshape(pieces, piece), axis=1, kind="stable").ravel()[: len(a) + len(b)]
    return rows >> 1, (rows & 1).astype(bool)


class Alignment:
    """Links and groups of texts that lie after each other; `bounds` are their ends in bytes."""

    def __init__(self, encoder: Encoder, a: np.ndarray, b: np.ndarray, bounds: np.ndarray, piece: int = PIECE_ENDS) -> None:
        self.encoder, self.a, self.b = encoder, a, b
        ends_a, ends_b = np.cumsum(encoder.a.size[a]), np.cumsum(encoder.b.size[b])
        values, from_b = merged(ends_a, ends_b, piece)
        first = np.flatnonzero(np.diff(values, prepend=-1))  # a distinct end, also where it lies across two pieces
        done_b = np.concatenate([[0], np.cumsum(from_b)])
        after = np.append(first[1:], len(values))
        open_b = done_b[first]
        open_a = first - open_b
        closed_b = done_b[after] - open_b
        common = (closed_b > 0) & (closed_b < after - first)
        self.link_a, self.link_b = a[open_a], b[open_b]
        distinct, self.shared = values[first], values[first][common]
        self.link_bounds = np.searchsorted(distinct, bounds, "right")
        self.group_bounds = np.searchsorted(self.shared, bounds, "right")
        self.bounds_a, self.bounds_b = np.searchsorted(ends_a, bounds, "right"), np.searchsorted(ends_b, bounds, "right")
        self.ends_a, self.ends_b = ends_a, ends_b

    def group_texts(self) -> Iterator[bytes]:
        """Groups of each text as `a1,a2|b1;a3|b2,b3`."""
        closed_a, closed_b = np.searchsorted(self.ends_a, self.shared, "right"), np.searchsorted(self.ends_b, self.shared, "right")
        of_a, of_b = np.searchsorted(self.shared, self.ends_a), np.searchsorted(self.shared, self.ends_b)
        out = np.empty(len(self.a) + len(self.b), object)
        at_a = np.arange(len(self.a)) + np.concatenate([[0], closed_b])[of_a]
        at_b = np.arange(len(self.b)) + closed_a[of_b]
        out[at_a], out[at_b] = self.encoder.a.more[self.a], self.encoder.b.more[self.b]
        out[at_a[closed_a - 1]] = self.encoder.a.last[self.a[closed_a - 1]]
        out[at_b[closed_b - 1]] = self.encoder.b.last[self.b[closed_b - 1]]
        begin = 0
        for end in (self.bounds_a + self.bounds_b).tolist():
            yield b"".join(out[begin:end].tolist())[:-1]
            begin = end


class _Doc:
    def __init__(self, row: int, doc_id, numbers: np.ndarray) -> None:
        self.row, self.doc_id, self.left, self.hash, self.any = row, doc_id, numbers, hashlib.sha256(), False


def _flush(encoder: Encoder, held: list[tuple[_Doc, np.ndarray, bool]], wide: int) -> tuple[bytes, list[tuple]]:
    """Packed links and the documents' rows of one chunk of (document, its words or a part of them, whether the last)."""
    whole = np.concatenate([w for _, w, _ in held]) if held else np.empty(0, np.int64)
    sizes = np.array(encoder.sizes, np.int64)[whole]
    counts = np.cumsum([len(w) for _, w, _ in held])
    bounds = np.concatenate([[0], np.cumsum(sizes)])[counts]
    (a, _), (b, _) = encoder.ids_a.take(whole), encoder.ids_b.take(whole)
    found = Alignment(encoder, a, b, bounds)
    rows, before = [], (0, 0, 0, 0)
    for k, ((doc, _, last), groups) in enumerate(zip(held, found.group_texts())):
        now = tuple(int(x[k]) for x in (found.bounds_a, found.bounds_b, found.group_bounds, found.link_bounds))
        doc.hash.update(b";" + groups if doc.any else groups)
        doc.any = True
        rows.append((doc.row, doc.doc_id, *(y - x for x, y in zip(before, now)), doc.hash.hexdigest() if last else None))
        before = now
    keys = found.link_a.astype(np.int64) * wide + found.link_b
    return keys.astype("<i8" if wide * len(encoder.a.bytes) >= 1 << 32 else "<u4").tobytes(), rows


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path_a, path_b)
        wide = len(encoder.b.bytes)
        doc_type = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DOC.split(", ")])

        def emit(held, none):
            links, rows = _flush(encoder, held, wide)
            packed = pa.compress(links, codec="zstd", asbytes=True)
            docs = pa.array([rows + none], pa.list_(doc_type))
            return pa.RecordBatch.from_arrays([pa.array([len(links)]), pa.array([packed], pa.binary()), docs], ["n_bytes", "links", "docs"])

        row = TaskContext.get().partitionId() << 40
        held, none, size = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                row += 1
                raw = raw.as_py() or b""
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = ""
                if len(encoder.words) > CACHED_WORDS:
                    if held or none:
                        yield emit(held, none)
                    held, none, size = [], [], 0
                    encoder.clear()
                numbers = encoder.numbers(encoder.cut(text)) if text else np.empty(0, np.int64)
                if not text or any(map(encoder.bad.__getitem__, set(numbers.tolist()))):
                    none.append((row, doc_id, 0, 0, 0, 0, ""))
                    if len(none) >= 10_000:
                        yield emit(held, none)
                        held, none, size = [], [], 0
                    continue
                doc = _Doc(row, doc_id, numbers)
                step = max(1, len(numbers) * CHUNK_BYTES // max(len(raw), 1))
                for first in range(0, len(numbers), step):
                    part = numbers[first : first + step]
                    held.append((doc, part, first + step >= len(numbers)))
                    size += len(raw) * len(part) // len(numbers)
                    if size >= CHUNK_BYTES:
                        yield emit(held, none)
                        held, none, size = [], [], 0
        if held or none:
            yield emit(held, none)

    return run


def _links(n_bytes: int, packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n_bytes, codec="zstd", asbytes=True), kind).astype(np.int64) if n_bytes else np.empty(0, np.int64)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return distinct, total


def _count(kind: str, most: int = HELD_PAIRS):
    """Counts of the pairs of a task; handed on when they are many, so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, kept = [], [], 0, 0
        for batch in batches:
            for n_bytes, packed in zip(batch.column("n_bytes").to_pylist(), batch.column("links")):
                own, number = np.unique(_links(n_bytes, packed.as_py(), kind), return_counts=True)
                keys.append(own)
                counts.append(number)
                held += len(own)
                if held > max(most, 2 * kept):
                    merged_ = _added(keys, counts)
                    keys, counts, held = [merged_[0]], [merged_[1]], len(merged_[0])
                    kept = held
                    if kept > most:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["pair", "n"])
                        keys, counts, held, kept = [], [], 0, 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(keys, counts)], ["pair", "n"])

    return run


def _looked_up(shared, kind: str, wide: int):
    """Per document or part: counts of its links among the hot pairs, and its other pairs."""
    doc_fields = [c.split()[0] for c in DOC.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, number, best = shared.value
        for batch in batches:
            for n_bytes, packed, docs in zip(batch.column("n_bytes").to_pylist(), batch.column("links"), batch.column("docs").to_pylist()):
                pairs, at = np.unique(_links(n_bytes, packed.as_py(), kind), return_inverse=True)
                place = np.minimum(np.searchsorted(hot, pairs), max(len(hot) - 1, 0))
                known = hot[place] == pairs if len(hot) else np.zeros(len(pairs), bool)
                count = np.where(known, number[place], 0) if len(hot) else np.zeros(len(pairs), np.int64)
                top = known & (count == best[pairs % wide])
                sums, tops = np.concatenate([[0], np.cumsum(count[at])]), np.concatenate([[0], np.cumsum(top[at])])
                cold = ~known[at]
                ends = np.cumsum([d["n_links"] for d in docs])
                begins = ends - [d["n_links"] for d in docs]
                rest = []
                for a, b in zip(begins.tolist(), ends.tolist()):
                    own, times = np.unique(pairs[at[a:b][cold[a:b]]], return_counts=True)
                    rest.append([{"pair": p, "times": t} for p, t in zip(own.tolist(), times.tolist())])
                columns = [pa.array([d[c] for d in docs], pa.string() if c == "groups_sha256" else pa.int64()) for c in doc_fields]
                columns += [pa.array(tops[ends] - tops[begins], pa.int64()), pa.array(sums[ends] - sums[begins], pa.int64())]
                columns.append(pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(columns, [*doc_fields, "n_best", "count_sum", "cold"])

    return run


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """n_bytes, links (packed pairs a * size of B + b, in text order) and the documents of each chunk."""
    return texts(docs).mapInArrow(_aligned(path_a, path_b), f"n_bytes long, links binary, docs array<struct<{DOC.replace(' ', ':')}>>".replace(",:", ","))


def hot_counts(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, as many whole sixteenths of a power of two as fit `most` pairs."""
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = sorted(pairs.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step)  # at most 63 * 16 + 1 rows
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r.step
    return pairs.where(step >= least) if least is not None else pairs.limit(0)


def align(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(a row per document, the table of id pairs with their counts: a, b, n)."""
    spark, encoder = docs.sparkSession, encoder_of(path_a, path_b)
    wide, kind = len(encoder.b.bytes), "<i8" if len(encoder.b.bytes) * len(encoder.a.bytes) >= 1 << 32 else "<u4"
    chunks = materialize(aligned_chunks(docs, path_a, path_b), "aligned")
    pairs = materialize(chunks.select("n_bytes", "links").mapInArrow(_count(kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    highest = pairs.groupBy((F.col("pair") % wide).alias("b")).agg(F.max("n").alias("best"))
    best = np.zeros(wide, np.int64)
    for b, n in highest.collect():  # a row per id of B
        best[b] = n
    hot = hot_counts(pairs, hot_pairs).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((hot["pair"].to_numpy(), hot["n"].to_numpy(), best))
    fields = [c.split()[0] for c in DOC.split(", ")]
    seen = materialize(chunks.mapInArrow(_looked_up(shared, kind, wide), f"{DOC}, n_best long, count_sum long, cold array<struct<pair:long,times:long>>"), "counted")
    other = seen.select("row", F.explode("cold").alias("c")).select("row", "c.pair", "c.times").join(pairs, "pair").join(F.broadcast(highest), F.col("pair") % wide == F.col("b"))
    other = other.groupBy("row").agg(F.sum(F.col("times") * (F.col("n") == F.col("best")).cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = [F.lit(None).cast("string" if c == "groups_sha256" else "long").alias(c) for c in fields[1:]]
    both = seen.select(*fields, "n_best", "count_sum").union(other.select("row", *none, "n_best", "count_sum"))
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    rows = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    table_ = pairs.select(F.floor(F.col("pair") / wide).alias("a"), (F.col("pair") % wide).alias("b"), "n")
    return rows.drop("row"), table_


def op12_align_tokens(spark, sf_dir: str) -> DataFrame:
    rows, _ = align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
