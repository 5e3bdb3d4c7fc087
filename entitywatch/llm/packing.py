"""Token-id output: documents packed into rows of fixed length, as binary id matrices.

Method, best-fit decreasing. Documents become token ids and an end-of-text id; one longer than a row is split into full
rows and a rest, so that no token is lost. A task takes pieces from large to small and puts each into the open row with
the least room that still suffices. A segment tree over the amounts of room finds it: each leaf counts the rows with so
much room left, inner nodes say whether there is one below. Rows carry ids (16-bit little-endian, padded), cumulative
segment lengths, the places where positions restart at 0, and document and offset of each segment.

Packing runs on FLUSH_TOKENS at a time, where the documents lie: no shuffle, and memory is bounded whatever the
partition. Rows are as full as best-fit makes them within such a part.

Words are encoded once and kept in a bounded cache; the split into words is that of the byte-level vocabulary.

Defined results: null and empty texts are one end-of-text id; special strings are ordinary text, so that decoding gives
the text back; ties in size go by order of input; repeated rows are packed as often as they occur; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table, texts
from .text import chunked, prefix_sums, span_hashes
from .token_counts import character_classes, split_words, vocabulary_path

ROW_TOKENS = 2048
FLUSH_TOKENS = 4_000_000
CACHED_WORDS = 1_000_000


class WordEncoder:
    """Token ids of texts, word by word."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.kinds = character_classes()
        self.reset()

    def reset(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.begins = np.empty(0, np.uint16), np.zeros(1, np.int64)

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings after each other, and how many each has."""
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        joined = "".join(strings)
        if not joined:
            return np.empty(0, np.uint16), np.zeros(len(strings), np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first, stop, _ = split_words(chars, self.kinds[chars], bounds)
        wide = (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(wide)])
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        codes, distinct = pd.factorize(span_hashes(prefix_sums(data), at[first], at[stop]))
        if len(self.known) > CACHED_WORDS:
            self.reset()
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            sample = np.empty(len(distinct), np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
            ids = [self.encoding.encode_ordinary(joined[a:b]) for a, b in zip(first[sample[new]].tolist(), stop[sample[new]].tolist())]
            hashes = np.concatenate([self.known, distinct[new]])
            slots = np.concatenate([self.slot, np.arange(len(ids)) + len(self.begins) - 1])
            order = np.argsort(hashes, kind="stable")
            self.known, self.slot = hashes[order], slots[order]
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) for x in ids])])
            self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], np.uint16)])
        slot = self.slot[np.searchsorted(self.known, distinct)][codes]
        begin = self.begins[slot]
        count = self.begins[slot + 1] - begin
        total = np.cumsum(count)
        out = self.flat[np.repeat(begin - (total - count), count) + np.arange(total[-1])]
        words = np.searchsorted(first, bounds)
        per = np.concatenate([[0], total])[words]
        return out, np.diff(per)


class RoomTree:
    """Rows by the room they have left: the least room that suffices, in steps of the tree's height."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the row with the least room of at least `least`."""
        node = self.size + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: np.ndarray, most: int) -> list[list[int]]:
    """Pieces of each row; sizes are 1..most."""
    tree, rows = RoomTree(most), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = tree.take(size)
        if found is None:
            rows.append([piece])
            room, row = most - size, len(rows) - 1
        else:
            room, row = found[0] - size, found[1]
            rows[row].append(piece)
        if room:
            tree.add(room, row)
    return rows


def _pack_rows(ids: list, starts: np.ndarray, counts: np.ndarray, tokens: np.ndarray, most: int, pad: int, first_id: int) -> pa.RecordBatch:
    """Split, pack and write out documents (counts include the end-of-text id)."""
    parts = -(-counts // most)
    owner = np.repeat(np.arange(len(counts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    offset = nth * most
    size = np.minimum(counts[owner] - offset, most)
    rows = best_fit(size, most)
    out = {k: [] for k in ("pack_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", "ids")}
    for k, row in enumerate(rows):
        matrix = np.full(most, pad, "<u2")
        ends = np.cumsum(size[row])
        for piece, end in zip(row, ends.tolist()):
            a = int(starts[owner[piece]] + offset[piece])
            matrix[end - size[piece] : end] = tokens[a : a + size[piece]]
        out["pack_id"].append(first_id + k)
        out["n_tokens"].append(int(ends[-1]))
        out["doc_ids"].append([ids[owner[p]] for p in row])
        out["doc_offsets"].append(offset[row].tolist())
        out["cu_seqlens"].append([0, *ends.tolist()])
        out["position_resets"].append([0, *ends[:-1].tolist()])
        out["ids"].append(matrix.tobytes())
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a row's tokens, from 0 in every segment."""
    return np.concatenate([np.arange(b - a) for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:])])


_ENCODERS: dict[str, WordEncoder] = {}


def _packer(path: str, most: int, flush_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        encoder = _ENCODERS[path]
        next_id = TaskContext.get().partitionId() << 33
        ids, counts, tokens, waiting = [], [], [], 0

        def flush():
            flat, size = np.concatenate(tokens), np.concatenate(counts)
            return _pack_rows(ids, np.cumsum(size) - size, size, flat, most, encoder.end, next_id)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for begin, held in chunked(batch.column("text").to_pylist()):
                flat, own = encoder.encode([t.decode("utf-8", "replace") for t in held])
                tokens.append(np.insert(flat, np.cumsum(own), encoder.end))
                counts.append(own + 1)
                ids += names[begin : begin + len(held)]
                waiting += len(tokens[-1])
                if waiting >= flush_tokens:
                    packed = flush()
                    yield packed
                    next_id += packed.num_rows
                    ids, counts, tokens, waiting = [], [], [], 0
        if ids:
            yield flush()

    return run


def pack(docs: DataFrame, path: str, row_tokens: int = ROW_TOKENS, flush_tokens: int = FLUSH_TOKENS) -> DataFrame:
    """Packed rows: pack_id, n_tokens, doc_ids, doc_offsets, cu_seqlens, position_resets, ids."""
    schema = "pack_id long, n_tokens long, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"
    return texts(docs).mapInArrow(_packer(path, row_tokens, flush_tokens), schema)


def op4_pack(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), path or vocabulary_path("byte_bpe_50k.tiktoken"))
