import os
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatemeter.llm.components import components
from gatemeter.llm.neardup import NearRules, chunk_keys, chunk_longs, chunk_values, dedup, distance, first_place, linked, shingle_sets, signatures
from gatemeter.llm.shared import Scratch

DDL = "doc_id bigint, text string"


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def corpus():
    r = random.Random(17)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 100
    passage = [r.choice(vocab) for _ in range(60)]
    for family in range(14):
        base = [r.choice(vocab) for _ in range(r.choice([3, 12, 40, 150]))]
        if family % 4 == 0:
            base = passage + base
        for _ in range(r.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
            i += r.randint(1, 3)
    r.shuffle(rows)
    return [*rows, (1, None), (2, ""), (3, " \t"), (4, "solo"), (5, "SOLO"), (6, "a b"), (7, "a  b"), (7, "a  b"), (8, "b a"), (None, "a b"), (9, "x" * 5000 + " y"), (10, rows[0][1] + " " + " ".join(f"q{i}" for i in range(9000)))]


def test_components_equal_brute_force(spark):
    rows = corpus()
    for k, block in ((2, 2), (5, 1000)):  # small blocks cut almost every key of the last join
        got = linked(spark.createDataFrame(rows, DDL).repartition(3), NearRules(words=k, block=block)).collect()
        want = brute(rows, k)
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None), r
            assert r["kept"] == (r["doc_id"] is not None and r["component_id"] == r["doc_id"])
        sizes = {(i, len(shingles(t, k))) for i, t in rows}
        assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(i, t, None, "c") for i, t in corpus()]
    docs = spark.createDataFrame(rows, DDL + ", kept string, component_id string")
    out = dedup(docs, NearRules(words=2))
    want = brute(corpus(), 2)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted({*want.values()}) and ids.count(None) == 1


def test_dedup_loses_no_clean_text_of_a_repeated_id(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, one, 1), (5, one + " more", 2), (5, two, 3), (5, two, 4), (7, two + " end", 5), (8, three, 6), (8, "", 7), (8, None, 7)]
    made = [sorted(map(tuple, dedup(spark.createDataFrame(x, "doc_id bigint, text string, n int").repartition(3)).collect()), key=str) for x in (rows, rows[::-1])]
    assert made[0] == made[1]
    assert sorted((i, t or "") for i, t, _ in made[0]) == sorted([(3, one), (5, two), (8, three), (8, "")])


def test_empty_table(spark):
    assert linked(spark.createDataFrame([], DDL)).count() == 0 and dedup(spark.createDataFrame([], DDL)).count() == 0


def test_every_pair_under_the_distance_shares_a_key(spark):
    rules, r = NearRules(), np.random.default_rng(5)
    bound = 2 * rules.chunks - 1
    a = r.integers(0, 256, (400, rules.values), dtype=np.uint8)
    b = a.copy()
    for i in range(400):
        at = r.choice(rules.values, bound, replace=False)
        b[i, at] ^= r.integers(1, 256, bound, dtype=np.uint8)
    p, q = chunk_keys(a, rules), chunk_keys(b, rules)
    assert all(set(x) & set(y) for x, y in zip(p.tolist(), q.tolist(), strict=True))
    assert (chunk_values(chunk_longs(a, rules), rules) == a).all()
    pairs = spark.createDataFrame([(x, y) for x, y in zip(chunk_longs(a, rules).tolist(), chunk_longs(b, rules).tolist(), strict=True)], "x array<bigint>, y array<bigint>")
    got = pairs.select(distance("x", "y", rules).alias("d"), first_place("x", "y", rules).alias("p")).collect()
    assert {r["d"] for r in got} == {bound}
    for r, x, y in zip(got, p.tolist(), q.tolist(), strict=True):
        assert x[r["p"]] == y[r["p"]]


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(2000)]
    texts = pa.array([" ".join(words), " ".join(words[:1600] + [f"z{i}" for i in range(200)])])
    hashes, counts = shingle_sets(texts, 1)
    x, y = signatures(hashes, counts, 512)
    assert abs((x == y).mean() - 1600 / 2200) < 0.08


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 250)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[300] == got[250] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint").select(F.col("a"), F.col("b")), Scratch(spark)).count() == 0


def test_scratch_tables_are_few_plain_files(spark, tmp_path):
    """Every file of a local folder, one of checksums too, has executors start processes, and then their memory counts twice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        scratch = Scratch(spark)
        edges = spark.createDataFrame([(i, i // 2) for i in range(1, 500)], "a bigint, b bigint").repartition(40)
        some, all_ = scratch.cut(edges, 499), scratch.cut(edges)
        labels = components(edges, scratch)
        assert {r["label"] for r in labels.collect()} == {0} and labels.count() == 500 and some.count() == all_.count() == 499
        top = scratch.top.removeprefix("file://")
        files = [os.path.join(d, x) for d, _, names in os.walk(top) for x in names]
        assert files and all(x.endswith(".parquet") for x in files), files
        count = lambda table: len(os.listdir(table.scratch_path.removeprefix("file://")))
        assert count(all_) > 20 and count(some) <= 4 and count(labels) <= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
