"""Mixing, sharding, decontamination and the pipeline."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

import corpus_pipeline
from entitywatch.llm import decontamination, mixing, quality_rules, sharding
from entitywatch.llm.common import keyed, materialize, row_key, spread
from entitywatch.llm.queries import QUERIES


def water_level(sizes, weights, most=3):
    """Targets by bisection of the common level."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights)) < total else (low, level)
    return [min(most * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_and_taken(spark, make_docs):
    pick = random.Random(1)
    names = [None, "b", "a", "ß", "Z", "e", "d"]
    texts, sources = [], []
    for k in range(700):
        s = 0 if k < 400 else pick.randrange(1, 7)
        sources.append(names[s])
        texts.append(" \t".join(prose(k, pick.randint(0, 3 if names[s] == "Z" else 60))))
    docs = make_docs(texts, sources=sources)
    rows = mixing.mix(docs, range_rows=50).collect()
    order = sorted(n for n in set(sources) if n is not None) + [None]
    size = Counter()
    for s, t in zip(sources, texts):
        size[s] += len(t.split())
    expected = dict(zip(order, water_level([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken = Counter()
    for r in rows:
        assert abs(r.target - expected[r.source]) < 1e-3 and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in order)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_quality_weights_draw_more(spark, make_docs):
    docs = make_docs(["w " * 10] * 2000 + ["w " * 10] * 2000, sources=["a"] * 2000 + ["b"] * 2000)
    quality = spark.createDataFrame([(k, 4.0 if k % 2 else 1.0) for k in range(4000)], "doc_id long, quality_weight double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    rows = [r for r in mixing.mix(docs, quality, weights).collect() if r.source == "a"]
    assert sum(r.taken for r in rows) == 10_000
    odd, even = (sum(r.taken for r in rows if r.doc_id % 2 == x) for x in (1, 0))
    assert odd > 1.8 * even > 0


def test_mix_of_odd_tables(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(no_docs).count() == 0 == mixing.mixed_documents(no_docs).count()


def test_ranges_hold_about_as_many_rows_whatever_the_weights(spark):
    key = F.when(F.col("id") % 3 == 0, F.pow(F.rand(1), F.lit(4.0))).when(F.col("id") % 3 == 1, F.lit(0.0)).otherwise(F.rand(2))
    rows = spark.range(60_000).select(F.lit("a").alias("source"), key.alias("sample_key"), F.lit(7).alias("doc_id"), F.xxhash64("id").alias("text_hash"), F.col("id").alias("row_key"))
    sizes = [r["count"] for r in mixing.in_ranges(rows, 40).groupBy("part").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / 40


def test_the_choice_recomputed(spark, make_docs):
    """Of one source the documents with the largest keys fill what whole epochs leave, the last one in part."""
    texts = ["w " * (1 + k % 9) for k in range(300)] + ["v " * 2000]
    docs = make_docs(texts, sources=["a"] * 300 + ["b"])
    weights = spark.createDataFrame([("a", 3.0), ("b", 2.2)], "source string, weight double")
    quality = spark.createDataFrame([(k, [0.25, 2.0, 0.0, None][k % 4]) for k in range(300)], "doc_id long, quality_weight double")
    rows = [r for r in mixing.mix(docs, quality, weights).collect() if r.source == "a"]
    size, target = sum(r.size for r in rows), rows[0].target
    epochs, rest = int(target // size), round(target - target // size * size)
    assert 0 < rest < size
    for r in sorted(rows, key=lambda r: (-r.sample_key, r.doc_id)):
        part = min(rest, r.size)
        rest -= part
        assert r.taken == epochs * r.size + part
        assert (r.sample_key == 0) == (r.doc_id % 4 == 2)


def test_rows_equal_in_all_columns_are_spread_over_tasks(spark, make_docs):
    docs = make_docs(["one two three"] * 500 + ["four"] * 3 + ["five six"], sources=["a"] * 504)
    same = docs.withColumn("doc_id", F.when(F.col("text") == "five six", 2).otherwise(1).cast(docs.schema["doc_id"].dataType))
    plan = materialize(same.select(row_key(same).alias("row_key"), F.monotonically_increasing_id().alias("__item")), "plan")
    for hot in (1000, 7, 2):
        rows = spread(keyed(same), plan, hot).select(*same.columns, "__item").collect()
        assert len({r["__item"] for r in rows}) == len(rows) == 504
        assert Counter((r.doc_id, r.text) for r in rows) == {(1, "one two three"): 500, (1, "four"): 3, (2, "five six"): 1}
    mixed = mixing.mixed_documents(same).collect()
    assert Counter(r.text for r in mixed) == {"one two three": 500, "four": 3, "five six": 1}
    slots = sharding.sharded_documents(same).collect()
    assert len(slots) == 504 == len({(r.shard, r.slot) for r in slots})


def smallest_largest(sizes, shards):
    """The smallest feasible capacity, tried one by one from the sums that a shard can have."""
    sums = {sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)}
    for capacity in sorted(sums):
        if capacity < max(sizes):
            continue
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity


@pytest.mark.parametrize("blocks", [4096, 3])
def test_shards(make_docs, blocks):
    pick = random.Random(2)
    texts = ["x" * pick.randint(0, 400) + str(k) for k in range(80)] + ["copy " * 30] * 25 + [None, "", "é"]
    rows = sharding.shard(make_docs(texts), 8, blocks, slot_rows=4).collect()
    assert len(rows) == len(texts) and {r.shard for r in rows} <= set(range(8))
    where, size = {}, Counter()
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        assert where.setdefault(text, r.shard) == r.shard
        size[r.shard] += r.size
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    # groups stand in the order of block and hash
    groups = {}
    for r in rows:
        groups.setdefault((int(r.text_md5[:8], 16) % blocks, r.text_md5), []).append(r.size)
    assert max(size.values()) == smallest_largest([sum(groups[k]) for k in sorted(groups)], 8)


def test_shards_of_odd_tables(odd_docs, no_docs):
    done = sharding.sharded_documents(odd_docs)
    assert done.count() == odd_docs.count() and sorted(done.columns) == sorted(odd_docs.columns)
    assert sharding.shard(odd_docs).count() == odd_docs.count()
    assert sharding.shard(no_docs).count() == 0 == sharding.sharded_documents(no_docs).count()


@pytest.fixture(scope="module")
def benchmark(spark):
    items = ["If a train runs 120 km in 3 hours then its mean speed over the whole way is 40 km per hour",
             "The old mill of Brandon ground 55 sacks of grain while Peter counted every one of them twice that day",
             "short item of six words", " ".join(prose(40, 50)), None, "", "1 2 3 4 5 6 7 8 9 10"]
    rows = [(k, t) for k, t in enumerate(items)] + [(20, items[0]), (None, items[1])]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(make_docs, benchmark, odd_docs, no_docs):
    pad = [" ".join(prose(60 + k, 40)) + ". " for k in range(12)]
    texts = [
        pad[0] + "If a train runs 120 km in 3 hours then its mean speed over the whole way is 40 km per hour. " + pad[1],
        pad[2] + "If a train runs 450 miles in 9 hours then its mean speed over the whole way is 50 miles per hour. " + pad[3],
        pad[4] + "The old mill of Winston ground 71 sacks of grain while Robert counted every one of them twice that day. " + pad[5],
        pad[6], pad[7] + "short item of six words", pad[8] + " ".join(prose(40, 50)[:12]), "1 2 3 4 5 6 7 8 9 10 " * 5, None, "", "IF A TRAIN " + pad[9],
    ]
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(make_docs(texts), benchmark).collect()}
    assert set(found) == {(0, 0), (1, 0), (2, 1), (4, 2)}
    assert found[0, 0].n_items == 2 and found[0, 0].changed_slots == 0 and found[1, 0].changed_slots >= 3
    clean = decontamination.clean_documents(make_docs(texts), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 7, 8, 9]
    assert decontamination.contaminated(odd_docs, benchmark).count() == 0
    assert decontamination.clean_documents(odd_docs, benchmark).count() == odd_docs.count()
    assert decontamination.contaminated(no_docs, benchmark).count() == 0
    assert decontamination.contaminated(make_docs(texts), benchmark.limit(0)).count() == 0


def test_inconsistent_slots_are_no_match(make_docs, spark):
    item = "Take x from 7 and add 9 to 7 before the second 7 comes back with the other 9 again"
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    good, bad = item.replace("7", "4").replace("9", "2"), "Take x from 4 and add 5 to 6 before the second 8 comes back with the other 3 again"
    assert [r.doc_id for r in decontamination.contaminated(make_docs([good, bad]), bench).collect()] == [0]


def test_items_of_one_template(make_docs, spark):
    """A copy is found whichever of the items of its template it copies, and whether or not their slots hold equal values."""
    item = "The farmer has {} red hens in the yard and then buys {} more of them from the man who sells {} every day"
    values = [(4, 4, 7), (4, 9, 7), (5, 8, 6), (3, 3, 3)]
    bench = spark.createDataFrame([(k, item.format(*v)) for k, v in enumerate(values)], "item_id long, text string")
    texts = [" ".join(prose(80 + k, 30)) + ". " + item.format(*v) for k, v in enumerate(values)]
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(make_docs(texts), bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 1), (3, 3)}
    assert {r.item_id: r.n_items for r in found.values()} == {0: 1, 1: 2, 3: 1}
    assert {k: r.changed_slots for k, r in found.items()} == {(0, 0): 0, (1, 1): 0, (2, 1): 3, (3, 3): 0}
    assert decontamination.clean_documents(make_docs(texts), bench).count() == 0


def test_windows_poor_in_words_and_items_without_id(make_docs, spark):
    sums = "Find {} + {} x {} - {} where x is {}"
    items = [(1, sums.format(12, 7, 3, 4, 9)), (2, sums.format(13, 8, 2, 5, 1)), (None, "How many steps does the tall man take from his red door to the old well in town"),
             (None, "Compute 1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [items[0][1], "so " + items[1][1] + " then", sums.format(12, 7, 3, 4, 8), items[2][1], "you know " + items[2][1], items[3][1], "1 2 3 4 5 6 7 8 9 10 11 12 13 14", None]
    found = sorted((r.doc_id, r.item_id or -1, r.item_windows) for r in decontamination.contaminated(make_docs(texts), bench).collect())
    assert found == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (3, -1, 11), (4, -1, 11), (5, -1, 8)]
    assert [r.doc_id for r in decontamination.clean_documents(make_docs(texts), bench).orderBy("doc_id").collect()] == [6, 7]


def test_a_common_phrase_makes_no_pairs(make_docs, spark, monkeypatch):
    phrase = "read the text below with care and then answer the question that follows it in full"
    items = [f"{phrase} {' '.join(prose(500 + k, 40))}" for k in range(60)]
    texts = [f"{' '.join(prose(900 + k, 20))}. {phrase} {' '.join(prose(1200 + k, 20))}" for k in range(60)] + items[:3]
    made = {}
    keep = decontamination.materialize
    monkeypatch.setattr(decontamination, "materialize", lambda df, label: made.setdefault(label, keep(df, label)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(make_docs(texts), bench).collect())
    assert found == [(60 + k, k) for k in range(3)]
    assert made["matches"].count() < 1000  # 63 x 60 pairs share nine windows of the phrase


def covered_items(text, items, coverage=0.5):
    """Which items a text covers, by plain loops over positions of windows of eight words."""
    def parts(t):
        words, values, slots, _, likely = decontamination.templates([t.encode()])
        return words.tolist(), values.tolist(), slots.tolist(), likely.tolist()

    def key(p, i, n, first_named=False):
        words, slots = list(p[0][i : i + n]), list(p[2][i : i + n])
        if first_named:
            words[0], slots[0] = int(decontamination.mix(decontamination.np.array([decontamination.NAME]))[0]), True
        rich = slots.count(False) >= (5 if n == 8 else -(-n // 2))
        where = [k for k in range(n) if slots[k]]
        return ("t", tuple(words), [(words[k], p[1][i + k]) for k in where]) if rich else ("v", tuple(p[1][i : i + n]), []), slots.count(False)

    doc, out = parts(text), set()
    for number, item in enumerate(items):
        own = parts(item)
        n = min(8, len(own[0]))
        places, plain = {}, False
        for i in range(len(own[0]) - n + 1 if n else 0):
            for named in (False, True) if i == 0 and own[3][0] else (False,):
                (kind, mark, mine), _ = key(own, i, n, named)
                for d in range(len(doc[0]) - n + 1):
                    (k2, m2, theirs), literal = key(doc, d, n)
                    if (kind, mark) == (k2, m2):
                        places.setdefault(d - i, []).append((i, literal, [(a[0], a[1], b[1]) for a, b in zip(mine, theirs)]))
        hit = set()
        for found in places.values():
            triples = {t for *_, ts in found for t in ts}
            if len({t[:2] for t in triples}) == len(triples) == len({(t[0], t[2]) for t in triples}):
                hit |= {i for i, *_ in found}
                plain |= any(literal for _, literal, _ in found)
        if plain and len(hit) >= coverage * (len(own[0]) - n + 1):
            out.add(number)
    return out


def test_against_plain_loops(make_docs, spark):
    pick = random.Random(77)
    fill = ["the", "man", "sold", "red", "hens", "at", "noon", "Peter", "Anna", "7", "12", "9", "km", "kg", "for", "each", "of", "them.", "Then", "x"]
    items = list(dict.fromkeys(" ".join(pick.choice(fill) for _ in range(pick.randint(3, 24))) for _ in range(25)))
    texts = []
    for _ in range(60):
        words = pick.choice(items).split()
        for _ in range(pick.randint(0, 3)):
            words[pick.randrange(len(words))] = pick.choice(fill)
        texts.append(" ".join([*pick.choices(fill, k=pick.randint(0, 6)), *words, *pick.choices(fill, k=pick.randint(0, 6))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.contaminated(make_docs(texts), bench).collect()
    assert all(r.n_items == 1 for r in rows)
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, k) for d, t in enumerate(texts) for k in covered_items(t, items)}


def test_pipeline(spark, tmp_path, make_docs):
    """Each stage against what the plain rules say of a small corpus."""
    item = " ".join(prose(40, 50))
    texts = [" ".join(prose(2000 + k, 60)) for k in range(60)]
    texts += [texts[0], texts[1] + " end", "JUNK!! " * 30, "few words", texts[2] + ". " + item, None, ""]
    docs = make_docs(texts, sources=[("a", "b", "c")[k % 3] for k in range(len(texts))])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        seen.append(kept.collect())
        assert kept.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
    assert {r.doc_id for r in seen[0]} == {*range(60), 60, 61, 64}
    assert {r.doc_id for r in seen[1]} == {*range(60), 64}
    assert {r.doc_id for r in seen[2]} == set(range(60))
    words = Counter()
    for r in seen[3]:
        words[r.source] += len(r.text.split())
    assert sorted(words.values()) == sorted(round(x) for x in water_level([1200] * 3, [5, 2, 1]))
    assert len(seen[4]) == len(seen[3]) and Counter(r.doc_id for r in seen[4]) == Counter(r.doc_id for r in seen[3])
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in run) == sorted((r.doc_id, r.shard, r.slot) for r in seen[4])


def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "mix_sources", "sharding"]


def test_the_fit_holds_little_beside_its_counts():
    """All n-grams of the sample lie in one task: the fit may take 48 bytes for each of them, sorting included."""
    rng = np.random.default_rng(2)
    found = [(np.unique(rng.integers(0, 4 << quality_rules.SLOT_BITS, 3000)).astype(np.int32),) for _ in range(1000)]
    found = [(numbers, np.full(len(numbers), 1e-3, np.float32)) for numbers, in found]
    tracemalloc.start()
    quality_rules.fit(found, (np.arange(1000) % 3 == 0).astype(float), steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * sum(len(numbers) for numbers, _ in found)
