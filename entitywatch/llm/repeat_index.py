"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts elsewhere.

Method, run-length index. Where strings may repeat, a run-compressed Burrows-Wheeler transform of these places is built
with samples at the ends of its runs. From them the matching statistics of each place stream in text order: next to a
text position the suffix order has one neighbour before and one after it; the length it shares with a neighbour drops by
one from position to position inside a run and has to be compared only where a run starts or ends. A position whose
match is LENGTH or longer starts a repeated string.

An index of all texts would not fit a task, so the places are found first. Every string of LENGTH bytes has an anchor,
its K-gram of the lowest hash (the first of equals); strings with the same bytes have the same anchor, so only places
with equal anchors are compared. Consecutive strings with one anchor form a stretch.

1. Each task finds the stretches of its distinct texts (about one in LENGTH / 2.6 bytes): hash of the anchor and hash of
   all bytes. Of stretches that occur again in the task it sends one on; these repeat anyhow.
2. A stretch whose bytes occur twice repeats as a whole. A stretch whose anchor occurs only with other bytes around it
   is open: its bytes are fetched and indexed together with those of one stretch of each kind with that anchor.
   Anchors with more kinds than an index takes are refined first: a string has at least half of its remaining bytes
   either before its anchor or behind it, so its stretch falls into two whose anchors are longer by that half. Equal
   strings again have equal anchors, parts with equal bytes repeat as a whole, and the rest is indexed, or refined
   again; after eight halvings an anchor is a whole string.
3. Texts that occur more than once are removed whole (if long enough). The others are cut, each row in its own task.

Everything is exact but for collisions of 64-bit hashes. Defined results: null and empty texts and texts shorter than
LENGTH lose nothing; strings are judged on the input, same document included, overlaps count; equal texts, also under
one doc_id, are each other's repeats; very long texts are anchored in parts of PART bytes that overlap by LENGTH - 1;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bitmap, in_bitmap, materialize, table
from .text import CHUNK_BYTES, mix, prefix_sums, signed, span_hashes

LENGTH = 200
K = 48
#: Texts above this size are anchored in parts.
PART = 4 << 20
#: Stretches that a task gathers before it sends them on.
FLUSH_ROWS = 500_000
#: Kinds of stretches of one anchor that are indexed together at most; anchors with more are refined.
KINDS = 700
#: Bytes indexed at a time.
INDEX_BYTES = 1 << 18


def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, k: int = K):
    """Maximal runs of string starts with one anchor: owner, start, number of strings, anchor hash, hash of all bytes.

    `bounds` are the limits of the texts in `data`. A sliding minimum over values that hold the hash above the position.
    """
    width = length - k + 1
    n = len(data) - length + 1
    if n <= 0:
        return None
    sums = prefix_sums(data)
    at = np.arange(len(data) - k + 1, dtype=np.int64)
    grams = span_hashes(sums, at, at + k)
    low = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    done = 1
    while done * 2 <= width:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    anchor = (low[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
    sizes = np.diff(bounds)
    valid = np.zeros(n + 1, np.int8)
    long_ = sizes >= length
    np.add.at(valid, bounds[:-1][long_], 1)
    np.add.at(valid, bounds[:-1][long_] + sizes[long_] - length + 1, -1)
    inside = np.cumsum(valid[:n]) > 0
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [n]])
    good = inside[first]
    first, last = first[good], last[good]
    # two texts can only meet in a run if the first ends where the second starts, and then strings in between are not valid
    a = anchor[first]
    owner = np.searchsorted(bounds, first, side="right") - 1
    kind = mix(span_hashes(sums, first, last - 1 + length) + (a - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner, first - bounds[owner], last - first, grams[a], kind


def _parts(texts_: list[bytes], ids: list[int], length: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Texts, or overlapping parts of long ones, in chunks, with (id, offset) of each."""
    held, names, size = [], [], 0
    for text, uid in zip(texts_, ids):
        for offset in range(0, max(len(text) - length + 1, 1), PART):
            part = text[offset : offset + PART + length - 1] if len(text) > PART else text
            if held and size + len(part) > CHUNK_BYTES:
                yield held, names
                held, names, size = [], [], 0
            held.append(part)
            names.append((uid, offset))
            size += len(part)
    if held:
        yield held, names


_PLACES = ["anchor", "kind", "uid", "start", "count", "times", "settled"]


def _settle(rows: list) -> pa.RecordBatch:
    """Rows of a task with one for each stretch that occurs again in it set aside: it repeats, whatever other tasks have.

    The first of them stands for all (times 2), so a passage of very many texts is one row for each task.
    """
    columns = [np.concatenate(c) for c in zip(*rows)]
    order = np.lexsort((columns[1], columns[0]))
    anchor, kind = columns[0][order], columns[1][order]
    head = np.ones(len(order), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])
    sizes = np.diff(np.append(np.flatnonzero(head), len(order)))
    times = np.ones(len(order), np.int32)
    times[head] = np.minimum(sizes, 2)
    return pa.RecordBatch.from_arrays([*(pa.array(c[order]) for c in columns), pa.array(times), pa.array(~head)], _PLACES)


def _stretch_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        rows, waiting = [], 0
        for batch in batches:
            ids, held_all = batch.column("uid").to_pylist(), batch.column("text").to_pylist()
            new = [i for i, u in enumerate(ids) if u not in met and not met.add(u)]
            for held, names in _parts([held_all[i] for i in new], [ids[i] for i in new], length):
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in held])])
                found = stretches(np.frombuffer(b"".join(held), np.uint8), bounds, length, k)
                if found is None or not len(found[0]):
                    continue
                owner, start, count, anchor, kind = found
                uid, offset = (np.array(x, np.int64)[owner] for x in zip(*names))
                rows.append((signed(anchor), signed(kind), uid, (start + offset).astype(np.int32), count.astype(np.int32)))
                waiting += len(owner)
                if waiting > FLUSH_ROWS:
                    yield _settle(rows)
                    rows, waiting = [], 0
        if rows:
            yield _settle(rows)

    return run


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and their order."""
    order = np.argsort(keys)
    new = np.ones(len(keys), np.int64)
    new[0] = 0
    sorted_ = keys[order]
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:], casting="unsafe")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


class RunLengthIndex:
    """Run-compressed BWT of numbers that end in a distinct separator per text, with samples at run ends.

    Suffixes are sorted by doubling until no two are equal (within runs, neighbours must be neighbours in full order), from
    PACKED symbols at once; the ranks of each step are kept to compare suffixes where runs end.
    """

    PACKED = 4

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        bits = int(symbols.max() + 1).bit_length()
        if bits * self.PACKED > 62:
            raise ValueError("too many texts for one index")
        self.text = symbols
        key = np.zeros(n, np.int64)
        for k in range(self.PACKED):
            key <<= bits
            key[: n - k] += symbols[k:] + 1
        rank, self.order = _ranked(key)
        self.steps, step = [(self.PACKED, rank)], self.PACKED
        while rank[self.order[-1]] < n - 1:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            step *= 2
            rank, self.order = _ranked(key)
            self.steps.append((step, rank))
        bwt = symbols[self.order - 1]
        change = bwt[1:] != bwt[:-1]
        self.heads = np.concatenate([[0], np.flatnonzero(change) + 1])
        self.tails = np.concatenate([np.flatnonzero(change), [n - 1]])
        self.symbols = bwt[self.heads]

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length that the suffixes at a and b share."""
        n = len(self.order)
        out = np.zeros(len(a), np.int64)
        for step, rank in [*reversed(self.steps), *[(1, self.text)] * (self.PACKED - 1)]:
            i, j = a + out, b + out
            same = (i < n) & (j < n)
            same[same] = rank[i[same]] == rank[j[same]]
            out[same] += step
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match that starts elsewhere, streamed from the run ends."""
        n = len(self.order)
        out = np.zeros(n, np.int64)
        place = np.arange(n)
        for ends, shift in ((self.heads, -1), (self.tails, 1)):
            near = ends + shift
            real = (near >= 0) & (near < n)
            at = self.order[ends]
            length = np.zeros(len(ends), np.int64)
            length[real] = self._shared(at[real], self.order[near[real]])
            sample = np.zeros(n, np.int64)
            sample[at] = length
            from_ = np.zeros(n, np.int64)
            from_[at] = at
            from_ = np.maximum.accumulate(from_)
            out = np.maximum(out, sample[from_] - (place - from_))
        return out


def _repeated(contexts: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(context, first, last + 1) of runs of string starts that have another match among the contexts."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    symbols = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    body = np.ones(len(symbols), bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + len(sizes)
    symbols[ends] = np.arange(len(sizes))
    hit = np.zeros(len(symbols) + 2, np.int8)
    hit[1:-1] = RunLengthIndex(symbols).matching_statistics() >= length
    step = np.diff(hit)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(begins, first, side="right") - 1
    for c, a, b in zip(owner.tolist(), (first - begins[owner]).tolist(), (last - begins[owner]).tolist()):
        yield c, a, b


def _index_places(length: int):
    """Index the stretches of a partition sorted by anchor, a bounded number of bytes at a time."""

    def flush(rows):
        out = []
        if rows:
            for c, a, b in _repeated([r[4] for r in rows], length):
                if not rows[c][3]:
                    out.append((rows[c][1], rows[c][2] + a, rows[c][2] + b - 1 + length))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "uid", "start", "whole", "bytes"))):
                if size > INDEX_BYTES and row[0] != last:
                    found += flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
            yield _marks(found)
        yield _marks(flush(rows))

    return run


def _marks(found) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["uid", "start", "end"])


def halves(data: bytes, low: int, high: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first string, number of strings, new low, new high) of the two parts of a stretch with its anchor at low:high.

    Strings with half of their other bytes before the anchor go to the first part, the others have as many behind it.
    """
    count = len(data) - length + 1
    step = -(-(length - (high - low)) // 2)
    first = min(max(low - step + 1, 0), count)
    if first:
        yield 0, first, low - step, high
    if first < count:
        yield first, count - first, low - first, high - first + step


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


_PARTS = "anchor long, kind long, uid long, start int, count int, times int, settled boolean, whole boolean, low int, high int, bytes binary"


def _refined(length: int, k: int):
    """Both parts of each stretch; of equal parts in a task one is sent on, the others are settled."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]

    def settle(rows: dict) -> pa.RecordBatch:
        out = []
        for (anchor, kind), ((uid, start, count, whole, low, high, data), *others) in rows.items():
            out.append((anchor, kind, uid, start, count, 2 if others else 1, False, whole, low, high, data))
            out += [(anchor, kind, uid, start, count, 1, True, whole, None, None, None) for uid, start, count, whole, *_ in others]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = {}, 0
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("anchor", "uid", "start", "whole", "low", "high", "bytes"))
            for anchor, uid, start, whole, low, high, data in zip(*columns):
                if low is None:
                    at = np.arange(len(data) - k + 1)
                    grams = signed(span_hashes(prefix_sums(np.frombuffer(data, np.uint8)), at, at + k))
                    low = int(np.flatnonzero(grams == anchor)[0])
                    high = low + k
                for first, count, a, b in halves(data, low, high, length):
                    part = data[first : first + count - 1 + length]
                    side = b"<" if first == 0 and a < low else b">"
                    key = _digest(side + part[a:b]), _digest(b"%d " % a + part)
                    rows.setdefault(key, []).append((uid, start + first, count, whole, a, b, part))
                    held += 1
            if held > FLUSH_ROWS // 10:
                yield settle(rows)
                rows, held = {}, 0
        if rows:
            yield settle(rows)

    return run


def _classified(sent: DataFrame, label: str) -> DataFrame:
    """Stretches that repeat as a whole or share their anchor with other bytes; `nth` counts those with equal bytes.

    One shuffle, by anchor, for all windows; what repeats in a task comes as one row.
    """
    places = sent.repartition("anchor").select(
        "*", F.expr("sum(times) over (partition by anchor, kind)").alias("same"), F.expr("min(kind) over (partition by anchor)").alias("lowest"),
        F.expr("max(kind) over (partition by anchor)").alias("highest"), F.expr("row_number() over (partition by anchor, kind order by uid, start)").alias("nth"))
    places = places.where("same > 1 or lowest <> highest").withColumn("mixed", F.col("lowest") != F.col("highest"))
    return materialize(places.withColumn("whole", F.col("whole") | (F.col("same") > 1)).drop("times", "same", "settled", "lowest", "highest"), label)


def _open(places: DataFrame, kinds: int) -> DataFrame:
    """One stretch of each kind of the anchors that have several kinds and an unsettled one; `many` if more than `kinds`."""
    rows = places.where("mixed and nth = 1").drop("kind", "nth", "mixed")
    wanted = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("done")).where("not done").select("anchor", (F.col("n") > kinds).alias("many"))
    return rows.join(wanted, "anchor")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, kinds: int = KINDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, texts): narrow rows of all documents, spans (uid, start, end) of repeats, and uid with text.

    uid is a hash of the text; texts that occur more than once are not in the spans but have copies > 1 in the rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = docs.select("doc_id", text.alias("text")).withColumn("uid", F.xxhash64("text")).withColumn("n_bytes", F.length("text").cast("long"))
    rows = materialize(named.select("doc_id", "uid", "n_bytes", F.sha2("text", 256).alias("whole_sha256")), "rows")
    long_ = named.where(f"n_bytes >= {length}").select("uid", "text")
    sent = long_.mapInArrow(_stretch_rows(length, k), "anchor long, kind long, uid long, start int, count int, times int, settled boolean")
    sent = materialize(sent, "stretches")
    end = (F.col("start") + F.col("count") - 1 + length).cast("long").alias("end")
    span = ["uid", F.col("start").cast("long").alias("start"), end]
    places = _classified(sent.where("not settled").withColumn("whole", F.lit(False)), "places")
    spans = [places.where("whole").select(*span), sent.where("settled").select(*span)]
    open_ = _open(places, kinds)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(open_.select("uid").distinct(), "uid"))
    bytes_ = F.substring("text", F.col("start") + 1, F.col("count") - 1 + length).alias("bytes")
    fetched = _texts_of(long_, bits).join(open_, "uid").select("anchor", "uid", "start", "whole", "many", bytes_).dropDuplicates(["uid", "start"])
    fetched = materialize(fetched.withColumns({"low": F.lit(None).cast("int"), "high": F.lit(None).cast("int")}), "contexts")
    while True:
        few = fetched.where("not many").repartition("anchor").sortWithinPartitions("anchor", "uid", "start")
        few = few.select("anchor", "uid", F.col("start").cast("long").alias("start"), "whole", "bytes")
        spans.append(few.mapInArrow(_index_places(length), "uid long, start long, end long"))
        if fetched.where("many").isEmpty():
            break
        sent = materialize(fetched.where("many").select("anchor", "uid", "start", "whole", "low", "high", "bytes").mapInArrow(_refined(length, k), _PARTS), "refined")
        places = _classified(sent.where("not settled"), "refined-places")
        spans += [places.where("whole").select(*span), sent.where("settled").select(*span)]
        fetched = materialize(_open(places, kinds), "refined-contexts")
    return rows, materialize(functools.reduce(DataFrame.union, spans), "spans"), long_


def _texts_of(long_: DataFrame, bits) -> DataFrame:
    """Texts whose uid may be in the bitmap, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            ids = batch.column("uid").to_numpy(zero_copy_only=False)
            keep = in_bitmap(bits.value, ids)
            keep &= np.array([u not in met and not met.add(u) for u in ids.tolist()], bool)
            yield batch.filter(pa.array(keep))

    return long_.mapInArrow(run, "uid long, text binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the spans of each text; the rest by hash, and whole for those who ask for it."""
    for batch in batches:
        removed, runs, hashes, kept_all = [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            step = np.zeros(len(text) + 1, np.int64)
            for span in spans:
                step[span["start"]] += 1
                step[span["end"]] -= 1
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
            hashes.append(hashlib.sha256(kept).hexdigest())
            kept_all.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept_all, pa.binary())],
            ["uid", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, kinds: int = KINDS) -> tuple[DataFrame, DataFrame]:
    """(one row per document with doc_id, n_bytes, n_removed, n_spans, kept_sha256; cut texts by uid for those that lose a part)."""
    rows, spans, long_ = repeated_spans(docs, length, k, kinds)
    copies = rows.where(f"n_bytes >= {length}").groupBy("uid", "whole_sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = materialize(copies, "copies")  # two unequal texts of one uid are no copies
    merged = spans.join(copies, "uid", "left_anti").groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    merged = materialize(merged, "merged")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(merged, "uid"))
    cut = _texts_of(long_, bits).join(merged, "uid").mapInArrow(_cut, "uid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    narrow = materialize(cut.drop("kept"), "cut")
    out = rows.join(copies, ["uid", "whole_sha256"], "left").join(narrow, "uid", "left")
    gone = F.col("copies").isNotNull()
    out = out.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"), "uid",
    )
    return out, cut.select("uid", "kept")


def op9_remove_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))[0].drop("uid")
