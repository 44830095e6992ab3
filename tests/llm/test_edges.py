"""Every operator on nulls, repeated rows, long texts, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from gatemeter.llm import bestfit, chat, licences, neardup, packing, pages, pieces, quality, registry, secrets, simhash

TEXTS = [(1, "one two three"), (2, None), (2, None), (3, ""), (4, " \n\t "), (5, "one two three"), (None, "four"), (6, "word " * 30_000), (7, "x" * 200_000), (8, "\x00 é😀 ퟿ �"), (9, "a\r\nb\vc\fd")]
#: names that operators use inside or return
CLASHES = "rep key label a b sig set_key members n_shingles component_id kept class_id pivot v p q hi lo w t1 t2 part place ghost k next_text digest known_digest licence ids start length offset sequence_id doc_tokens spans n_words base_failed host texts html url".split()
OPERATORS = {
    "op2": bestfit.pack_matrices, "op3": simhash.query, "op4": neardup.query, "op6": quality.query, "op7": secrets.query, "op8": pieces.query, "op9": licences.query, "op10": packing.pack_documents,
}


def documents(spark, rows=TEXTS):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    docs = documents(spark).repartition(3)
    rows = OPERATORS[name](docs).collect()
    ids = [r["doc_id"] for r in rows] if name != "op2" else [i for r in rows for i in r["doc_ids"]]
    want = sorted((i for i, _ in TEXTS), key=str)
    assert sorted(ids if name not in ("op2", "op10") else set(ids), key=str) == (want if name not in ("op2", "op10") else sorted(set(want), key=str))
    plain = docs.select("doc_id", "text")
    assert {c: t for c, t in OPERATORS[name](plain).dtypes} == {c: t for c, t in OPERATORS[name](docs).dtypes}
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_stages_keep_rows_of_other_columns(spark):
    docs = documents(spark).repartition(2)
    for stage in (quality.filter_quality, neardup.dedup, secrets.redact):
        out = stage(docs)
        assert out.columns == docs.columns and out.where("rep <> 'clash' OR kept <> 'clash' OR a <> 'clash'").count() == 0
        assert stage(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in secrets.redact(docs).collect()) == sorted(i or 0 for i, _ in TEXTS)


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "assistant", "y"), (2, None, None, "z"), (3, 0, "assistant", "w " * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("clash") for c in ("transcript", "examples", "turns", "loss", "shown", "end")})
    got = {r["conv_id"]: r for r in chat.query(turns).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, None: 1, 2: 1, 3: 1, -7: 2} and got[1]["loss_chars"] == 2 and got[2]["loss_chars"] == 0 and got[3]["loss_chars"] == 200_000
    assert chat.query(turns.limit(0)).count() == 1


def test_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "http://a.example/x", ""), (2, "http://a.example/x", ""), (3, "no url", "<article>&lt;b&gt;  t&nbsp;u<p>v</article>"), (None, "http://a.example/y", "plain < text"), (4, "http://b.example", deep), (5, "http://b.example", "<article>" + "<p>w " * 20_000)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "texts", "wrapper", "salt", "text", "n_chars")})
    got = {r["page_id"]: r for r in pages.query(table).collect()}
    assert got[3]["text"] == "<b> t u\nv" and got[1]["text"] == got[2]["text"] == "" and got[None]["text"] == "plain < text" and got[4]["text"] == "deep" and got[5]["text"].count("\n") == 19_999
    assert pages.query(table).count() == len(rows) and pages.query(table.limit(0)).count() == 0


def test_all_are_registered():
    names = {q.split("_")[0] for q in registry.QUERIES}
    assert names == {*(f"op{i}" for i in range(1, 11)), "pipeline"} and registry.ORACLES.keys() <= registry.QUERIES.keys()
