import hashlib
import random
import re

import pytest
import xxhash

from gatemeter.llm.simhash import RADIUS, fingerprints, near, near_pairs, query, shown

DDL = "doc_id bigint, text string"


def xx_long(v, seed):
    return xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed)


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if not words:
        return "0" * 32
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    votes, n = [0] * 128, 0
    for i in range(max(len(words) - 5, 0) + 1):
        t1 = 42
        for h in hashes[i : i + 5]:
            t1 = xx_long(h, t1)
        t2 = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), xx_long(t1, 42))
        n += 1
        for b in range(64):
            votes[b] += t2 >> b & 1
            votes[64 + b] += t1 >> b & 1
    return f"{sum(1 << b for b in range(128) if 2 * votes[b] > n):032x}"


def corpus():
    r = random.Random(11)
    words = [f"w{i}é" for i in range(300)]
    made = [(i * 3, " ".join(r.choice(words) for _ in range(r.randint(1, 80)))) for i in range(120)]
    return [*made, (1, None), (4, ""), (7, "one"), (10, " \n"), (13, "a b c d e f " * 3000), (16, made[3][1]), (16, made[3][1]), (None, "null id here ok"), (2**60, "far away id")]


def test_prints_equal_brute_force(spark):
    rows = corpus()
    got = fingerprints(spark.createDataFrame(rows, DDL).dropDuplicates(), ["doc_id"]).select("doc_id", shown("hi", "lo").alias("f")).collect()
    by = dict(rows)
    for r in got:
        assert r["f"] == brute(by[r["doc_id"]])


@pytest.mark.parametrize("rows", [corpus(), [(5, "only one text of some words here")], [(1, "a b"), (2, "c d e f g h")]])
def test_query_edits_and_neighbours(spark, rows):
    order = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        f, g, h = (int(brute(x), 16) for x in (text, edited, after))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:032x}", f"{g:032x}", 1 - (f ^ g).bit_count() / 128, 1 - (f ^ h).bit_count() / 128))
    got = [((-(2**63) if r[0] is None else r[0]), *r[1:]) for r in query(spark.createDataFrame(rows, DDL).repartition(5)).collect()]
    assert sorted(r[:-1] for r in got) == sorted(want)
    prints = [int(r[3], 16) for r in got]
    for r in got:
        assert r[-1] == (sum((int(r[3], 16) ^ p).bit_count() <= RADIUS for p in prints) - 1 if r[0] % 20 == 0 and r[0] >= 0 else None)


def test_empty_table(spark):
    out = query(spark.createDataFrame([], DDL))
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"] and out.count() == 0


def test_all_pairs_within_the_radius(spark):
    r = random.Random(3)
    values = [r.getrandbits(128) for _ in range(30)]
    for v in list(values):
        for k in (1, 3, 5, 6, 7):
            values.append(v ^ sum(1 << b for b in r.sample(range(128), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(v >> 64), signed(v & (2**64 - 1))) for i, v in enumerate([*values, values[0]])]
    rows.append((None, None, None))
    table = spark.createDataFrame(rows, "doc_id bigint, hi bigint, lo bigint")
    want = {frozenset((f"{a:032x}", f"{b:032x}")) for a in values for b in values if a < b and (a ^ b).bit_count() <= 6}
    for most in (2000, 2):  # the second cuts almost every key
        pairs, members = near_pairs(table, radius=6, spare=2, most=most)
        got = [frozenset((x["a"], x["b"])) for x in pairs.collect()]
        assert set(got) == want and len(got) == len(want)
    assert members.count() == len(rows) and near(table.limit(0), table).count() == near(table, table.limit(0)).count() == 0


def test_a_key_that_all_share_is_cut(spark):
    rows = [(i, 5, i % 100) for i in range(3000)] + [(5000, -1, -(2**63)), (5001, -(2**63), 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, hi bigint, lo bigint")
    got = {(r["hi"], r["lo"]): r["n"] for r in near(table, table, radius=3, most=7).groupBy("hi", "lo").count().withColumnRenamed("count", "n").collect()}
    values = {(h, lo) for _, h, lo in rows}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {v: sum(bits(v[0], w[0]) + bits(v[1], w[1]) <= 3 for w in values) for v in values}
