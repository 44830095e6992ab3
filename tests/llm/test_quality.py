import random
import re
from collections import Counter

import pyarrow as pa

from gatemeter.llm.quality import DEFAULT, filter_quality, measure, query, score, verdicts

WORD = re.compile("[^\x20\x09-\x0d]+")
DDL = "doc_id bigint, text string"


def brute(text):
    text = text or ""
    spans = WORD.findall(text)
    out = {"n_words": len(spans), "word_chars": sum(map(len, spans)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}

    def coverage(n):
        windows = [tuple(spans[i : i + n]) for i in range(len(spans) - n + 1)]
        count = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(n)}
        return len(inside), sum(len(spans[i]) for i in inside)

    out["n_repeat_words"] = coverage(5)[0]
    seen, dup, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, chars = dup + 1, chars + len(line)
            seen.add(line)
    out |= {"n_dup_lines": dup, "dup_line_chars": chars}
    for n, _ in DEFAULT.max_coverage:
        out[f"gram{n}_chars"] = coverage(n)[1]
    out["base_failed"] = out["n_words"] < 10 or 100 * out["n_repeat_words"] > 20 * out["n_words"]
    out["kept"] = not out["base_failed"] and not any(out[f"gram{n}_chars"] > s * out["word_chars"] for n, s in DEFAULT.max_coverage) and out["dup_line_chars"] <= DEFAULT.max_line_coverage * out["word_chars"]
    return out


def texts():
    r = random.Random(5)
    made = [None, "", " \n\t", "a", "a b c d e a b c d e", "\n\nx\n\nx\n", "é ü  é ü ", "x|y #1\x0b$5\x1cq", " a b"]
    for _ in range(60):
        made.append("".join(r.choice(["a", "bé", "c", "日本", " ", " ", "\n", "\t"]) for _ in range(r.randint(0, 200))))
    line = "the same line of several words again\n"
    return [*made, line * 3 + "z " * 40, "w%d " * 5, line * 400, " ".join(f"w{i}" for i in range(30_000))]


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r.asDict() for r in score(spark.createDataFrame(rows, DDL)).collect()}
    for i, text in rows:
        expected = brute(text)
        assert {k: got[i][k] for k in expected} == expected, text


def test_no_words_and_empty_batch():
    assert not verdicts(measure(pa.array(["", "   "])))[1].any()
    assert len(measure(pa.array([], pa.string())).n_words) == 0


def test_filter_keeps_columns_and_repeats(spark):
    good = " ".join(f"word{i}" for i in range(50))
    rows = [(1, "base_failed", good, None), (1, "base_failed", good, None), (None, None, None, 2), (3, "x", "spam " * 100, 3)]
    kept = filter_quality(spark.createDataFrame(rows, "doc_id bigint, kept string, text string, n_words int"))
    assert kept.columns == ["doc_id", "kept", "text", "n_words"] and kept.count() == 2


def test_empty_table(spark):
    out = query(spark.createDataFrame([], DDL))
    assert out.collect() == [] and out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
