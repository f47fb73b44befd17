"""Operators on tables of documents, vectors and conversations against brute force on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.llm import chat, leaks, neardup, shards, topk
from nearkin.llm.components import connected
from tests.llm.test_llm_text import prose


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5), (10, 10), (None, 3)]
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in found} == {1: 1, 2: 1, 3: 1, **{i: 4 for i in range(4, 10)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark):
    r = random.Random(1)
    rows = [(i, prose(i, r.choice([3, 8, 60]))) for i in range(0, 60)]
    base = prose(500, 120).split()
    for i in range(100, 220):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = f"w{r.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one two"), (304, "ONE  two"), (5, rows[5][1]), (5, rows[5][1])]
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, "alone " * 9)], "doc_id long, text string")
    out = neardup.near_duplicates(df.withColumn("digest", F.lit("x")), percent=85).collect()
    assert len(out) == len(rows) + 2
    for row in out:
        if row["doc_id"] is not None:
            i = row["doc_id"]
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[i]), find(i), find(i) == i)
    assert sorted(row["kept"] for row in out if row["doc_id"] is None) == [False, True]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    words = prose(7, 200).split()
    rows = [(i, " ".join(words[:i] + [f"n{i}"] + words[i + 1 :])) for i in range(60)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {r["component_id"] for r in out} == {0}


def test_estimate_follows_jaccard():
    r = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        n = 4000
        both = r.integers(0, 2**63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.append(both, r.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64))) * np.uint64(2) for _ in range(2)]
        one, two = (neardup.registers(np.unique(s)) for s in sets)
        value, used = neardup.estimate(one, len(sets[0]), two[None], np.array([len(sets[1])]))
        assert abs(value[0] - share) < 5 * (share * (1 - share) / used[0]) ** 0.5 + 0.01


def test_estimate_is_corrected_for_registers_equal_by_chance():
    r = np.random.default_rng(5)
    n, count = 3000, 400
    sketches = np.stack([neardup.registers(np.unique(r.integers(0, 2**64, n, dtype=np.uint64))) for _ in range(count)])
    assert sketches.dtype == np.uint16
    sizes, raw, corrected = np.full(count, n), [], []
    for i in range(count - 1):
        value, used = neardup.estimate(sketches[i], n, sketches[i + 1 :], sizes[i + 1 :])
        corrected.append(value)
        raw.append((sketches[i + 1 :] == sketches[i]).sum(axis=1) / used)
    raw, corrected = np.concatenate(raw).mean(), np.concatenate(corrected).mean()
    # Sets without a common element agree in about 1,800 of ten million registers; the correction takes these off.
    assert raw > 1e-4
    assert abs(corrected) < raw / 5


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=20)]) for i in range(0, 450)]
    rows += [(500, None), (501, [None] + [0.0] * 19), (502, [float("nan")] * 20), (600, [1.0, 2.0]), (601, [3.0, 1.0])]
    rows += [(700, rows[3][1]), (700, rows[3][1]), (None, rows[1][1]), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {i: v for i, v in good if i % 100 == 0}
    expected = {}
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:10]
        expected.update({(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)})
    out = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out} == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_in_many_blocks_and_beyond_32_bits(spark, monkeypatch):
    """Several query blocks and packets a task, no broadcast, and finite values of any size."""
    monkeypatch.setattr(topk, "PACKET", 7)
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=9) * 10.0 ** r.choice([0, 0, 0, 7, 12, 60])]) for i in range(300)]
    rows += [(i, [float(x) for x in r.normal(size=5)]) for i in range(300, 330)] + [(330, [1e308] * 9), (331, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if np.isfinite(1024 * np.array(v)).all()}
    expected = {}
    for q, v in good.items():
        if q % 10 == 0:
            clamped = lambda s: min(max(s, -(2**63)), 2**63 - 1)
            best = sorted((-clamped(sum(a * b for a, b in zip(v, w))), i) for i, w in good.items() if i != q and len(w) == len(v))[:10]
            expected.update({(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)})
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        out = topk.top_k(df, F.col("vec_id") % 10 == 0)
        assert {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in out.collect()} == expected
        plan = out._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert 330 not in good and max(abs(s) for _, s in expected.values()) >= 2**63 - 1


def brute_best_fit(sizes, capacity):
    left = []
    for size in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= size]
        if fits:
            left[min(fits)[1]] -= size
        else:
            left.append(capacity - size)
    return sorted(left)


def test_best_fit_decreasing():
    r = random.Random(6)
    for _ in range(60):
        sizes = [r.choice([r.randint(1, 100), 7, 50]) for _ in range(r.randint(1, 80))]
        runs, left = shards.best_fit(sorted(Counter(sizes).items(), reverse=True), 100)
        assert sorted(left.values()) == brute_best_fit(sizes, 100)
        assert sum(end - first for _, first, end, _ in runs) == len(sizes)


def test_shards(spark):
    r = random.Random(8)
    rows = [(i, prose(i, r.randint(1, 40))) for i in range(600)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(2000 + i, "hot text " * 5) for i in range(500)]
    rows += [(1, rows[1][1])] * 3 + [(None, "x"), (3000, None), (3001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("a"))
    out = shards.shard(df, shards=10).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in rows)
    by = defaultdict(list)
    for x in out:
        by[x["shard"]].append(x)
    assert set(by) == set(range(10)) and all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in by.values())
    total = [sum(x["size"] for x in s) for s in by.values()]
    assert max(total) - min(total) < 0.05 * max(total)
    text = dict(rows)
    homes = defaultdict(set)
    for x in out:
        if x["doc_id"] is not None:
            homes[text[x["doc_id"]] or ""].add(x["shard"])
    assert {t for t, s in homes.items() if len(s) > 1} <= {"hot text " * 5}
    full = shards.shard(df, capacity=2000).collect()
    loads = Counter()
    for x in full:
        loads[x["shard"]] += x["size"]
    assert max(loads.values()) <= 2000 and len(full) == len(rows)
    assert shards.shard(df.limit(0), shards=3).count() == 0
    with pytest.raises(ValueError):
        shards.shard(df)


def test_chat(spark):
    hostile = r"\### a: </turn> #<\b\h ### assistant: x"
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", hostile), (1, 3, "user", None),
        (1, 4, "assistant", ""), (2, 0, "user", hostile), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"),
        (3, None, "us: er", "é\n"), (None, 0, None, "x"), (4, 0, "assistant", "ok"), (4, 0, "assistant", "ok"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(0))
    out = chat.expand(df).select("*", chat.trainable().alias("loss"), chat.parse(F.col("formatted")).alias("turns")).collect()
    by = defaultdict(list)
    for x in sorted(out, key=lambda x: x["example"]):
        by[x["conv_id"]].append(x)
    for conv in (1, 2, 3, 4, None):
        order = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        told = [(role or "", text or "") for _, _, role, text in order]
        assert [(t["role"], t["text"]) for t in by[conv][-1]["turns"]] == told
        assert [x["loss"] for x in by[conv] if x["loss_end"] > x["loss_start"] or x["turns"][-1]["role"] == "assistant"] == [
            t for role, t in told if role == "assistant"
        ]
    assert chat.expand(df.limit(0)).count() == 0


def test_leaks(spark):
    items = [(i, prose(100 + i, n)) for i, n in enumerate([12, 30, 45, 3, 60])]
    items += [(9, items[1][1]), (1, items[1][1]), (10, None), (11, "")]
    near = items[4][1].split()
    near[30] = "changed"
    rows = [
        (1, prose(1, 80) + " " + items[1][1].upper() + " " + prose(2, 10)), (2, prose(3, 200)), (3, items[3][1]),
        (4, "x " + " ".join(near)), (5, " ".join(items[2][1].split()[:30])), (6, None), (7, ""), (8, items[0][1]), (8, items[0][1]),
        (None, items[0][1]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("a"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    out = {(x["doc_id"], x["item_id"]): x for x in leaks.find_leaks(df, bench).collect()}
    assert set(out) == {(1, 1), (1, 9), (3, 3), (4, 4), (8, 0), (None, 0)}
    assert out[1, 1]["start"] == 80 and out[1, 1]["similarity"] == 1 and out[1, 1]["distance"] == 0
    assert out[4, 4]["start"] == 1 and abs(out[4, 4]["similarity"] - 51 / 61) < 1e-9
    assert leaks.find_leaks(df.limit(0), bench).count() == 0 and leaks.find_leaks(df, bench.limit(0)).count() == 0
    monkey = leaks.BROADCAST_ROWS
    leaks.BROADCAST_ROWS = 0
    try:
        assert {(x["doc_id"], x["item_id"]) for x in leaks.find_leaks(df, bench).collect()} == set(out)
    finally:
        leaks.BROADCAST_ROWS = monkey


def bag_of(text, k):
    words = text.lower().split()
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def test_leaks_out_of_order(spark, monkeypatch):
    r = random.Random(12)
    items, rows = [], []
    for i, n in enumerate([20, 40, 60, 100, 100]):
        words = prose(700 + i, n).split()
        cut = n * 7 // 10
        items.append((i, " ".join(words)))
        # Swapped blocks, turned by a few words, three blocks in another order, near copies, and pieces at both ends.
        third = n // 3
        shapes = [words[cut:] + words[:cut], words[5:] + words[:5], words[-3:] + words[:-3]]
        shapes += [words[2 * third :] + words[third : 2 * third] + words[:third], words[: n // 2] + ["new"] + words[n // 2 + 1 :], words[4:], words[:-4]]
        for shape in shapes:
            head, tail = (prose(r.randrange(10**6), r.choice([0, 0, 30, 81])) for _ in range(2))
            rows.append((len(rows), " ".join([head, *shape, tail])))
    expected = {}
    for doc, text in rows:
        have = bag_of(text, 5)
        for item, told in items:
            bag = Counter(bag_of(told, 5))
            m = sum(bag.values())
            for s in range(1 - m, len(have)):
                window = Counter(have[max(s, 0) : s + m])
                both = sum((window & bag).values())
                share = both / (m + sum(window.values()) - both)
                if share >= 0.8:
                    expected[doc, item] = max(share, expected.get((doc, item), 0))
    swapped = {(7 * i, i) for i in (3, 4)}
    assert swapped <= set(expected)
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (leaks.BROADCAST_ROWS, 0):
        monkeypatch.setattr(leaks, "BROADCAST_ROWS", limit)
        out = {(x["doc_id"], x["item_id"]): x["similarity"] for x in leaks.find_leaks(df, bench).collect()}
        assert out == pytest.approx(expected)


def test_fingerprints_of_many_shingles(spark):
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 40_000, 70_000):
        hashes = r.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        hashes[: n // 50] = hashes[0]
        counts = ((hashes.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
        expected = sum(1 << b for b in range(64) if 2 * int(counts[b]) > n)
        df = spark.createDataFrame([(1, hashes.tolist())], "key long, hashes array<long>")
        [row] = leaks.fingerprints(df, ["key"], "hashes").collect()
        assert row["print"] % 2**64 == expected


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two, three = (prose(800 + i, 60) for i in range(3))
    rows = [(5, one), (5, two), (7, two + " more"), (8, one + " more"), (9, three), (10, three), (10, prose(900, 60)), (11, prose(901, 60))]
    for order in (rows, rows[::-1]):
        out = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(out) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in out} == {5: 5, 7: 5, 8: 5, 9: 9, 10: 9, 11: 11}
        assert all(r["kept"] == (r["doc_id"] in (5, 9, 11)) for r in out)
