import hashlib
import random

from pyspark.sql import functions as F

from gatemeter.llm import chat
from gatemeter.llm.chat import examples, format_conversations, query, read_turns, transcript

DDL = "conv_id bigint, turn bigint, role string, text string"


def rows():
    r = random.Random(7)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "[\\INST]", "<\\\\/s>", "[OUT] ", "[", "<", "\\", "a", "é\U0001f600", "\n", "$1", " ", "[/ROLE]", "[TURN]"]
    out = []
    for conv in range(40):
        for turn in range(r.randint(1, 9)):
            out.append((conv, turn, r.choice(["user", "assistant", "system", "tool", "[/ROLE]<s>", "", None]), r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))])))
    out += [(50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, None, "user", "z"), (None, 0, "user", "x"), (51, 0, "assistant", "x " * 200_000)]
    return out + [(60, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(600)]


def expected(given):
    convs = {}
    for conv, turn, role, text in given:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    return {k: [(r, t) for _, r, t in sorted(v)] for k, v in convs.items()}


def test_digests_equal_the_input(spark):
    given = rows()
    got = {r["conv_id"]: r for r in query(spark.createDataFrame(given, DDL)).collect()}
    want = expected([*given, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert got.keys() == want.keys()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k]["n_examples"] == sum(r == "assistant" for r, _ in turns)
        assert (got[k]["context_chars"] > got[k]["loss_chars"]) or got[k]["n_examples"] < 2


def test_each_example_has_its_context_and_only_its_reply(spark):
    given = [x for x in rows() if x[0] != 51]
    made = examples(format_conversations(spark.createDataFrame(given, DDL)))
    made = made.withColumn("turns", read_turns(F.col("text"))).withColumn("loss", F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))"))
    seen = {}
    for r in made.orderBy("conv_id", "example").collect():
        seen.setdefault(r["conv_id"], []).append(r)
    for k, turns in expected(given).items():
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        assert len(seen.get(k, [])) == len(replies)
        for i, r in zip(replies, seen.get(k, []), strict=True):
            assert [tuple(x) for x in r["turns"]] == turns[: i + 1]
            assert r["loss_end"] == len(r["text"]) - len("</s>")
            assert r["loss"] == r["text"][r["loss_start"] : r["loss_end"]] and r["text"].startswith("<s>") and r["text"][: r["loss_start"]].endswith("[OUT] ")


def test_pieces_make_up_the_transcript(spark):
    made = format_conversations(spark.createDataFrame(rows(), DDL)).withColumn("whole", transcript())
    for r in made.collect():
        assert r["whole"] == "<s>" + "".join(e["piece"] for e in r["examples"]) + r["rest"]
        assert [e["example"] for e in r["examples"]] == list(range(len(r["examples"])))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DDL + ", transcript string, examples int")
    assert [r["conv_id"] for r in query(empty).collect()] == [-7]
    assert format_conversations(empty).count() == 0


def test_query_reads_whole_examples(spark, monkeypatch):
    """Each row that the query digests holds all turns before its reply, and the digests follow from these texts."""
    given = [x for x in rows() if x[0] in (3, 50, 60)] + [(70, 0, "user", "no reply")]
    seen, read = [], chat._read_back
    monkeypatch.setattr(chat, "_read_back", lambda written: seen.append(written) or read(written))
    plain = {r["conv_id"]: r for r in query(spark.createDataFrame(given, DDL)).collect()}
    texts = {}
    for r in seen[0].select("*", read_turns(F.col("text")).alias("turns")).orderBy("conv_id", "example").collect():
        texts.setdefault(r["conv_id"], []).append(r)
    for k, turns in expected(given).items():
        replies = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        assert [[tuple(x) for x in r["turns"]] for r in texts[k]] == ([turns[: i + 1] for i in replies] or [[]])
        assert plain[k]["context_chars"] == sum(r["loss_start"] or 0 for r in texts[k])
    monkeypatch.setattr(chat, "_read_back", lambda written: read(written.withColumn("text", F.regexp_replace("text", "turn 0 ", "other "))))
    changed = {r["conv_id"]: r for r in query(spark.createDataFrame(given, DDL)).collect()}
    assert {k for k in plain if plain[k]["turns_sha256"] != changed[k]["turns_sha256"]} == {60}
