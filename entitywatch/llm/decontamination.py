"""Benchmark decontamination: documents that hold a benchmark item, also one with other numbers, names or units.

Method, template canonicalisation. Words lose outer punctuation and case; numbers, names (capitalised inside a sentence)
and units (after a number) become typed placeholders. Windows of WINDOW template words are joined by hash with those of
the benchmark; windows with fewer than MIN_LITERALS plain words (or half of a short item) say too little as templates and
are joined on their words and values as they stand. Matched windows of one document and item on one diagonal (document
position minus item position) are an alignment. Its slots must be consistent: each value of an item's slot stands for
one value in the document throughout, and no two values of one type for the same. An item is reported in a document if
consistent alignments cover at least COVERAGE of its windows, one with a plain word among them.

Items with equal templates whose slots hold equal values in the same places are one class: its template windows come from
one of them, windows joined as they stand from all. A document that covers enough of an item's n windows has at least
one of any n - ceil(COVERAGE * n) + 1 of them, so pairs come only from as many of the item's windows, those that the
fewest items share: a phrase in many items and documents makes no pairs by itself. An item's first word is both a plain
word and, if it is capitalised, a name, as it may stand inside a sentence in a document.

Documents' windows are filtered in their tasks by a bitmap of the benchmark's window hashes, which has a fixed size
whatever the benchmark, and then joined by a shuffle, so neither table has to fit anywhere.

Defined results: null and empty texts match nothing; items of fewer words than a window are one window of all their
words; items of placeholders alone are not found; a class is reported by its smallest id (null if it has none) with the
number of its items; repeated rows of a document are one document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import KEY, bitmap, in_bitmap, keyed, materialize, row_key, split_by, table, texts
from .text import IS_SPACE, chunked, mix, prefix_sums, signed, span_hashes, window_hashes, word_spans

WINDOW = 8
#: Plain words that a window needs to be compared as a template.
MIN_LITERALS = 5
COVERAGE = 0.5
# fixed values: words that are units after a number
UNITS = """% g kg mg lb lbs oz t ton tons m km cm mm mi mile miles ft foot feet in inch inches yd yard yards s sec second
seconds min minute minutes h hr hour hours day days week weeks month months year years l ml litre litres liter liters
gallon gallons cent cents dollar dollars euro euros pound pounds usd eur gbp w kw kwh v hz khz mhz ghz b kb mb gb tb
degrees degree c f k percent mph kmh kph m2 m3 km2""".split()
NUMBER, NAME, UNIT, MEASURE = (np.uint64(x) for x in (0x1111, 0x2222, 0x3333, 0x4444))
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0]


UNIT_HASHES = np.sort(np.array([_word_hash(u) for u in UNITS], np.uint64))


def templates(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of all texts after each other: word, value and whether it is a slot, and the bounds of each text.

    Last, whether a word would be a name if it didn't begin a sentence.
    """
    joined = b"\n".join(texts_)
    raw, data = np.frombuffer(joined, np.uint8), np.frombuffer(joined.lower(), np.uint8)
    starts, ends = word_spans(raw)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts_])])
    line_start = np.zeros(len(starts), bool)
    if len(starts):
        lines = np.cumsum(raw == 10)
        line_start[0] = True
        line_start[1:] = lines[starts[1:]] != lines[starts[:-1]]
    sentence_end = _STOP[raw[ends - 1]] if len(ends) else np.empty(0, bool)
    a, b = starts.copy(), ends.copy()
    while (cut := (a < b) & _PUNCTUATION[raw[np.minimum(a, len(raw) - 1)]]).any():
        a += cut
    while (cut := (a < b) & _PUNCTUATION[raw[np.maximum(b - 1, 0)]]).any():
        b -= cut
    fresh = line_start | np.concatenate([[True], sentence_end[:-1]])[: len(starts)]
    percent = np.zeros(len(starts), bool) if not len(starts) else raw[np.minimum(b, len(raw) - 1)] == ord("%")
    full = a < b
    a, b, fresh, percent = a[full], b[full], fresh[full], percent[full]
    bounds = np.searchsorted(starts[full], begins)
    value = span_hashes(prefix_sums(data), a, b)
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    n_letters, n_digits = letters[b] - letters[a], digits[b] - digits[a]
    number = (n_digits > 0) & (n_letters == 0)
    measure = (n_digits > 0) & (n_letters > 0) & _DIGIT[raw[a]] if len(a) else number
    measure |= number & percent
    after = np.concatenate([[False], number[:-1]])[: len(a)]
    at = np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)
    unit = after & (UNIT_HASHES[at] == value)
    first, second = (raw[a], raw[np.minimum(a + 1, len(raw) - 1)]) if len(a) else (a, a)
    likely = (first >= 65) & (first <= 90) & (b - a > 1) & ~((second >= 65) & (second <= 90)) & ~number & ~measure & ~unit
    name = ~fresh & likely
    word = value.copy()
    for kind, which in ((NUMBER, number & ~measure), (MEASURE, measure), (UNIT, unit), (NAME, name)):
        word[which] = kind
    return mix(word), value, number | measure | unit | name, bounds, fresh & likely


def _windows(words: np.ndarray, values: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a text: hash, whether it is that of the template, and the number of plain words."""
    if len(words) < size:
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, int)
    need = MIN_LITERALS if size == WINDOW else -(-size // 2)
    count = np.concatenate([[0], np.cumsum(slots)])
    plain = size - (count[size:] - count[:-size])
    as_template = mix(window_hashes(words, size) + np.uint64(size))
    as_they_stand = mix(window_hashes(mix(values), size) + np.uint64(size + (1 << 32)))
    return np.where(plain >= need, as_template, as_they_stand), plain >= need, plain


_WINDOW = "at long, window long, plain boolean, kinds array<long>, slots array<long>"
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
ITEM = ["whole", "pattern"]


def _row(at: int, hashes, rich, plain, words, values, slots, i: int, size: int) -> tuple:
    """A window's position, hash, whether it has plain words, and its slots if it stands for a template."""
    where = np.flatnonzero(slots[i : i + size]) + i if rich[i] else np.empty(0, int)
    return at, int(signed(hashes[i : i + 1])[0]), bool(plain[i]), signed(words[where]).tolist(), signed(values[where]).tolist()


def _document_windows(sizes: list[int], shared):
    """Rows (id, window) of the windows that may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, held in chunked(batch.column("text").to_pylist()):
                words, values, slots, bounds, _ = templates(held)
                out = []
                for size in sizes:
                    hashes, rich, plain = _windows(words, values, slots, size)
                    k = np.flatnonzero(in_bitmap(shared.value, hashes)) if len(hashes) else np.empty(0, int)
                    owner = np.searchsorted(bounds, k, side="right") - 1
                    inside = k + size <= bounds[owner + 1]
                    for i, o in zip(k[inside].tolist(), owner[inside].tolist()):
                        out.append((ids[start + o], *_row(i - int(bounds[o]), hashes, rich, plain, words, values, slots, i, size)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *_TYPES])], ["id", "at", "window", "plain", "kinds", "slots"])

    return run


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Template windows of the items that stand for their class, and of all items the windows joined as they stand."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (*ITEM, "stands"))))
        out = []
        for start, held in chunked(batch.column("text").to_pylist()):
            words, values, slots, bounds, likely = templates(held)
            for o, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                whole, pattern, stands = keys[start + o]
                own = words[a:b], values[a:b], slots[a:b]
                variants = [own]
                if b > a and likely[a]:  # the first word as a name
                    named, slot = own[0].copy(), own[2].copy()
                    named[0], slot[0] = mix(np.array([NAME]))[0], True
                    variants.append((named, own[1], slot))
                size = min(WINDOW, b - a)
                for number, parts in enumerate(variants):
                    found = _windows(*parts, size) if size else ((), (), ())
                    for i in range(len(found[0]) if not number else min(1, len(found[0]))):
                        if stands or not found[1][i]:
                            out.append((whole, pattern, *_row(i, *found, *parts, i, size)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), *_TYPES])], [*ITEM, "at", "window", "plain", "kinds", "slots"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item the hash of its whole template, that of which slots hold equal values, and its number of words."""
    for batch in batches:
        whole, patterns, counts = [], [], []
        for _, held in chunked(batch.column("text").to_pylist()):
            words, values, slots, bounds, _ = templates(held)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                at = a + np.flatnonzero(slots[a:b])
                _, first, same = np.unique(mix(values[at] + words[at]), return_index=True, return_inverse=True)
                whole.append(int(signed(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)))[0]) if b > a else None)
                patterns.append(int(signed(window_hashes(first[same].astype(np.uint64), len(at)))[0]) if len(at) else 0)
                counts.append(b - a)
        columns = [batch.column("id"), batch.column("text"), pa.array(whole, pa.int64()), pa.array(patterns, pa.int64()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "text", *ITEM, "n"])


def _rarest(theirs: DataFrame, classes: DataFrame, coverage: float) -> DataFrame:
    """Of each item as many windows as a document that covers it can't avoid, those that the fewest items share."""
    shared = theirs.select("window", *ITEM).distinct().groupBy("window").agg(F.count("*").alias("items"))
    places = theirs.join(shared, "window").groupBy(*ITEM, "at").agg(F.max("items").alias("items")).join(classes.select(*ITEM, "windows"), ITEM)
    nth = F.row_number().over(Window.partitionBy(*ITEM).orderBy("items", "at"))  # within one item
    needed = F.greatest(F.col("windows") - F.ceil(F.col("windows") * coverage - 1e-9) + 1, F.lit(1))
    chosen = places.withColumn("nth", nth).where(F.col("nth") <= needed).select(*ITEM, "at")
    return theirs.join(chosen, [*ITEM, "at"]).select("window", *ITEM).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_items, matched_windows, item_windows, coverage, changed_slots) of documents with benchmark items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    members = materialize(items.mapInArrow(_whole, "id long, text binary, whole long, pattern long, n long").where("n > 0"), "items")
    stands = F.min_by("text", F.struct(F.col("id").isNull(), "id", "text")).alias("text")
    classes = members.groupBy(*ITEM).agg(F.min("id").alias("item_id"), F.count("*").alias("n_items"), F.min("n").alias("n"), stands)
    classes = materialize(classes.withColumn("windows", F.greatest(F.col("n") - WINDOW + 1, F.lit(1))), "item_classes")
    sizes = sorted({WINDOW, *(r[0] for r in classes.where(F.col("n") < WINDOW).select("n").distinct().collect())})
    both = classes.select(*ITEM, "text", F.lit(True).alias("stands")).union(members.select(*ITEM, "text", F.lit(False)))
    theirs = materialize(both.mapInArrow(_item_windows, f"whole long, pattern long, {_WINDOW}").distinct(), "item_windows")
    bits = spark.sparkContext.broadcast(bitmap(theirs, "window"))
    ours = materialize(texts(docs).mapInArrow(_document_windows(sizes, bits), f"id long, {_WINDOW}").distinct(), "windows")
    candidates = ours.select("id", "window").distinct().join(_rarest(theirs, classes, coverage), "window").select("id", *ITEM).distinct()
    wanted = candidates.join(theirs.select(*ITEM, F.col("at").alias("item_at"), F.col("window").alias("w"), F.col("slots").alias("item_slots")), ITEM)
    wanted = wanted.select(F.col("id").alias("doc_id"), *ITEM, "item_at", "w", "item_slots")
    pairs = ours.join(wanted, ours["id"].eqNullSafe(wanted["doc_id"]) & (ours["window"] == wanted["w"])).withColumn("diagonal", F.col("at") - F.col("item_at"))
    pairs = materialize(pairs.select("doc_id", *ITEM, "diagonal", "item_at", "plain", "kinds", "slots", "item_slots"), "matches")
    found = ["doc_id", *ITEM]
    key = [*found, "diagonal"]
    values = pairs.where("size(slots) > 0").select(*key, F.explode(F.arrays_zip("kinds", "slots", "item_slots")).alias("z")).select(*key, "z.*").distinct()
    clash = values.groupBy(*key, "kinds", "item_slots").agg(F.count("*").alias("n")).where("n > 1").select(*key)
    clash = clash.union(values.groupBy(*key, "kinds", "slots").agg(F.count("*").alias("n")).where("n > 1").select(*key)).distinct()
    changed = values.where("slots <> item_slots").groupBy(*found).agg(F.countDistinct("item_slots").alias("changed_slots"))
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]  # noqa: E731  doc_id may be null
    fine = pairs.join(clash, same(pairs, clash, key), "left_anti")
    covered = fine.groupBy(*found).agg(F.countDistinct("item_at").alias("matched_windows"), F.max("plain").alias("plain")).where("plain").drop("plain")
    out = covered.join(classes.select(*ITEM, "item_id", "n_items", F.col("windows").alias("item_windows")), ITEM)
    out = out.withColumn("coverage", F.col("matched_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    out = out.join(changed, same(out, changed, found), "left").select(out["*"], F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"))
    return out.select("doc_id", "item_id", "n_items", "matched_windows", "item_windows", "coverage", "changed_slots")


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without contaminated documents; each row is judged by its own text."""
    found = contaminated(docs.select(row_key(docs).alias("doc_id"), "text"), benchmark, coverage)
    gone = materialize(found.select(F.col("doc_id").alias("row_key")).distinct(), "contaminated")
    sure, maybe = split_by(keyed(docs), gone)
    return sure.select(docs.columns).union(maybe.join(gone.withColumnRenamed("row_key", KEY), KEY, "left_anti").select(docs.columns))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
