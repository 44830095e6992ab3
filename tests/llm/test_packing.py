import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gatemeter.llm.bestfit import best_fit, matrices, pack_matrices
from gatemeter.llm.packing import PackRules, pack, pack_documents
from gatemeter.llm.wordbpe import WordBpe, vocabulary

DDL = "doc_id bigint, text string"
TEXTS = [
    None, "", "  \n", "Hello, World's best 42nd <|endoftext|> éÅ", "don't we'll THEY'RE ''s \"'d", "naïve Ünïcode × ÷ straße ÿ", "日本語 テキスト ΑΣ ΑΣΑ İstanbul ﬁ", "a b c\x1cd\x85e\x0bf",
    "#" * 300 + "x" * 400, "1234567 3½ ٣", "<|startoftext|>hi", " ".join(f"w{i} Thé{i % 7}." for i in range(4000)),
]


@pytest.fixture(scope="module")
def coder():
    return WordBpe(vocabulary("word_bpe_49k.json"))


def test_ids_equal_the_library(coder, monkeypatch):
    r = random.Random(3)
    letters = "abcXYZéÀß0129 .,'\"-\n\t<|>sdḿ дß漢"
    made = [t or "" for t in TEXTS] + ["".join(r.choice(letters) for _ in range(r.randint(1, 120))) for _ in range(1500)]
    for cut in (1 << 20, 50):
        monkeypatch.setattr("gatemeter.llm.wordbpe.BLOCK_CHARS", cut)
        for t in made:
            assert coder.encode(t).tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pack_is_lossless_and_tight():
    r = random.Random(1)
    rules = PackRules(seq_len=64)
    for _ in range(60):
        lengths = [r.choice([1, 2, 63, 64, 65, 200, r.randint(1, 300)]) for _ in range(r.randint(0, 200))]
        pieces = pack(lengths, rules)
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for d, start, n, k, offset in pieces:
            assert n > 0
            by_doc[d].append((start, n))
            by_seq[k].append((offset, n))
        for d, n in enumerate(lengths):
            at = 0
            for start, m in sorted(by_doc[d]):
                assert start == at
                at += m
            assert at == n
        for parts in by_seq.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 64
        assert len(by_seq) == -(-sum(lengths) // 64)


def test_lowest_cost_with_room():
    rules = PackRules(seq_len=10, linear=1, quadratic=1)
    pieces = pack([6, 5, 4, 3, 2], rules)
    # two sequences; 6 and 5 open them, 4 goes to the cheaper one, then 3 to the one with room, 2 is cut
    assert [(d, n, k) for d, _, n, k, _ in pieces][:4] == [(0, 6, 0), (1, 5, 1), (2, 4, 1), (3, 3, 0)]
    assert sum(n for d, _, n, _, _ in pieces if d == 4) == 2


def test_costs_are_balanced():
    r = random.Random(4)
    rules = PackRules()
    cost = defaultdict(float)
    for _, _, n, k, _ in pack([r.randint(10, 900) for _ in range(4000)], rules):
        cost[k] += rules.cost(n)
    values = sorted(cost.values())
    assert values[-1] < 1.35 * values[len(values) // 2]


def test_pack_documents(spark, coder):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "x")]
    out = pack_documents(spark.createDataFrame(rows, DDL).repartition(3)).collect()
    ids = {i: np.append(coder.encode(t or ""), np.uint32(1)).astype("<u4") for i, t in rows}
    got, places = defaultdict(int), defaultdict(list)
    for p in out:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        got[p["doc_id"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == {i: len(v) * (2 if i == 3 else 1) for i, v in ids.items()}
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert pack_documents(empty).count() == 0 and pack_matrices(empty).count() == 0


def brute_best_fit(lengths, size):
    free, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            best = min(fits)
            free.remove(best)
        else:
            best = size
            out.append(1)
        free.append(best - n)
    return len(out), sorted(free)


def test_best_fit_equals_brute_force():
    r = random.Random(2)
    for _ in range(80):
        lengths = [r.randint(1, 40) for _ in range(r.randint(1, 120))]
        sequences = best_fit(lengths, 40)
        free = sorted(40 - sum(n for _, _, n in s) for s in sequences)
        assert (len(sequences), free) == brute_best_fit(lengths, 40)
    assert best_fit([100], 40) == [[(0, 0, 40)], [(0, 40, 40)], [(0, 80, 20)]]


def test_matrices_round_trip(spark, coder):
    rows = list(enumerate(TEXTS))
    packed = pack_matrices(spark.createDataFrame(rows, DDL).coalesce(1)).collect()
    ids, places, cu, first = matrices(packed)
    back = defaultdict(dict)
    for k, row in enumerate(packed):
        own = cu[first[k] : first[k + 1]]
        assert own[0] == 0 and own[-1] == row["n_tokens"]
        for s, (d, start) in enumerate(zip(row["doc_ids"], row["starts"], strict=True)):
            back[d][start] = ids[k, own[s] : own[s + 1]]
            assert places[k, own[s] : own[s + 1]].tolist() == list(range(own[s + 1] - own[s]))
    for d, text in rows:
        assert np.concatenate([back[d][s] for s in sorted(back[d])]).tolist() == [*coder.encode(text or "").tolist(), 1]
