import random
import zlib

import pytest
import sentencepiece

from gatemeter.llm.pieces import UNIGRAM, Coder, Model, decode_documents, encode_documents, query
from gatemeter.llm.wordbpe import vocabulary

DDL = "doc_id bigint, text string"
PATH = vocabulary("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a ", "Hello  world\n\n x\ty", "</s><s> <unk> <0x41>", "▁lit▁▁eral ▁", "日本語 \U0001f600 é́", "\x00\x1f", "word " * 20_000, "x" * 3000]


def made():
    r = random.Random(6)
    letters = "abe tion the  \n▁éß日<s>0.,\t"
    return TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(500)]


@pytest.fixture(scope="module")
def own():
    return Coder(PATH)


def test_ids_equal_sentencepiece(own):
    other = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t or "" for t in made()]
    for t, (ids, differ) in zip(texts, own.encode(texts), strict=True):
        want = other.encode(t)
        assert list(memoryview(ids).cast("I")) == want and differ == 0, t
        if t and len(t) < 5000:
            assert own.full.encode(t, add_special_tokens=False).ids == want, t
        assert own.decode(ids) == t.replace("▁", " ")


def test_whole_texts_give_the_same(own):
    whole = Coder(PATH)
    whole.chunked = False
    texts = [t or "" for t in made() if len(t or "") < 5000]
    assert whole.encode(texts) == own.encode(texts)


def test_model_is_read(own):
    assert len(own.model.pieces) == 32000 and own.model.byte_fallback and own.model.pieces[:3] == ["<unk>", "<s>", "</s>"]


def test_unigram_scores_and_fallback():
    pieces = ["<unk>", "▁a", "b", "ab", "▁", "a", *[f"<0x{b:02X}>" for b in range(256)]]
    m = Model(pieces, [0, -1.0, -1.5, -1.0, -2.0, -3.0, *[0.0] * 256], [2, *[1] * 5, *[6] * 256], UNIGRAM, True, b"", True, False, True)
    full, _ = m.tokenizer()
    assert full.encode("ab").ids == [1, 2] and full.decode(full.encode("ab é").ids) == "ab é"


def test_query_and_decode(spark):
    rows = list(enumerate(made()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], DDL + ", n_tokens int").repartition(2)
    got = query(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    other = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, t in rows:
        assert by[i]["n_tokens"] == len(other.encode(t or "")) and by[i]["n_differ"] == 0 and by[i]["round_trip"] and by[i]["ids_crc32"] == zlib.crc32(by[i]["ids"])
    assert {r["doc_id"]: r["text"] for r in decode_documents(got).collect()} == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert encode_documents(spark.createDataFrame([], DDL)).count() == 0


def test_a_chunk_that_differs_is_counted_where_it_stands():
    own = Coder(PATH)
    real = own.other

    class Other:
        def encode(self, text):
            ids = real.encode(text)
            bad = real.encode("zebra")
            return [x for i, x in enumerate(ids) if ids[i : i + len(bad)] != bad]

    own.other = Other()
    assert [d for _, d in own.encode(["a zebra and a zebra\nb", "no such", "zebra"])] == [2, 0, 1]


def test_ids_stay_the_same_when_chunk_generations_change(own, monkeypatch):
    monkeypatch.setattr("gatemeter.llm.pieces.CACHE_CHUNKS", 40)
    small = Coder(PATH)
    texts = [t or "" for t in made()]
    got = [small.encode(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    assert [x for part in got for x in part] == own.encode(texts) and len(small.known) < 300
