import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from test_neardup import brute as components_of
from test_quality import brute as quality_of

import corpus_pipeline
from gatemeter.llm.packing import pack_documents
from gatemeter.llm.secrets import redacted, spans_of
from gatemeter.llm.wordbpe import WordBpe, vocabulary

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):
        words = [r.choice(vocab) for _ in range(r.choice([4, 30, 200]))]
        rows.append((i * 5, " ".join(words)))
        if i % 4 == 0:
            words[r.randrange(len(words))] = "changed"
            rows.append((i * 5 + 1, " ".join(words)))
    rows += [(901, 'set token = "0123456789abcdef0123456789abcdef" ' + " ".join(vocab[:60])), (902, "spam " * 50), (903, None), (904, rows[3][1]), (905, "x\n" * 40)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DDL).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t, *_ in rows if quality_of(t)["kept"]]
    label = components_of(kept, 5)
    kept = [(i, t) for i, t in kept if label[i] == i]
    assert 0 < len(kept) < len(rows)
    coder = WordBpe(vocabulary("word_bpe_49k.json"))
    want = {}
    for i, t in kept:
        clean = redacted(t, spans_of(pa.array([t]))[0], "[SECRET]")
        want[i] = np.append(coder.encode(clean), np.uint32(1)).astype("<u4")
    seen = defaultdict(int)
    for p in got:
        own = want[p["doc_id"]]
        assert zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(own)
        seen[p["doc_id"]] += p["length"]
    assert seen == {i: len(v) for i, v in want.items()}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows = [(*x, 1, "z") for x in corpus()]
    docs = spark.createDataFrame(rows, DDL + ", kept int, component_id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*re.findall(r"(\w+) \w+", DDL), "kept", "component_id"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.where("text LIKE '%[SECRET]%' AND n_chars = length(text)").count() == 1
    assert pack_documents(docs).count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_cases_of_all_stages(spark, tmp_path):
    """Null ids stay, a repeated row is one, another text under the same id stays, empty texts are rejected, long ones are whole."""
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(n))
    a, b, c, long = text(60), text(70), text(50), text(60_000)
    rows = [(None, c, None, None, None), (1, a, "en", "s", 3), (1, a, "en", "s", 3), (1, b, None, "s", None), (2, a, "en", None, 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, long, None, None, None)]
    assert all(quality_of(t)["kept"] for t in (a, b, c, long))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    coder = WordBpe(vocabulary("word_bpe_49k.json"))
    want = sorted((-1 if i is None else i, len(coder.encode(t)) + 1) for i, t in ((None, c), (1, a), (1, b), (5, long)))
    assert sorted((-1 if p["doc_id"] is None else p["doc_id"], p["doc_tokens"]) for p in got if p["start"] == 0) == want
    total = defaultdict(int)
    for p in got:
        total[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert all(n == tokens for (_, tokens), n in total.items())
