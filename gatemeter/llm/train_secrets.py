"""Made-up training lines for the secret tagger; ``python -m gatemeter.llm.train_secrets`` writes its weights."""

from __future__ import annotations

import random
import re
import string
from pathlib import Path

from gatemeter.llm.crf import Crf
from gatemeter.llm.secrets import _TOKEN, about, features, hinted

_WORD = re.compile(r"\S+")
_ODD = re.compile(r"\d|[a-z][A-Z]")
_SYLLABLES = "an be co de er ing the ou st tion re le men ich ung ado que en al pre si on ta".split()


def _pick(r: random.Random, letters: str, lo: int, hi: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(lo, hi)))


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _secret(r: random.Random) -> str:
    alnum, b64, hexes = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    kind = r.randrange(8)
    if kind == 0:
        return _pick(r, alnum, 20, 44)
    if kind == 1:
        return r.choice(["sk_live_", "pk_test_", "ghp_", "gho_", "glpat-", "AIza"]) + _pick(r, alnum, 20, 36)
    if kind == 2:
        return "eyJ" + _pick(r, alnum, 12, 24) + "." + "eyJ" + _pick(r, alnum, 16, 40) + "." + _pick(r, alnum, 20, 43)
    if kind == 3:
        return _pick(r, b64, 30, 60) + r.choice(["", "=", "=="])
    if kind == 4:
        return _pick(r, hexes.upper() if r.random() < 0.3 else hexes, 32, 64)
    if kind == 5:
        return "xox" + r.choice("abp") + "-" + _pick(r, string.digits, 10, 12) + "-" + _pick(r, alnum, 20, 26)
    if kind == 6:
        return r.choice(["AKIA", "ASIA"]) + _pick(r, string.ascii_uppercase + string.digits, 16, 16)
    return _pick(r, string.ascii_lowercase + string.digits, 24, 40)


def _harmless(r: random.Random) -> str:
    d = lambda n: _pick(r, string.digits, n, n)
    kind = r.randrange(18)
    return (
        lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: d(16), lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: f"{_word(r)}.{d(2)}@mail{d(1)}.example.com",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"https://{_word(r)}.example.org/{_word(r)}/{d(3)}?id={d(4)}", lambda: d(r.randint(1, 12)),
        lambda: f"{_word(r).title()}{_word(r).title()}", lambda: f"{_pick(r, string.ascii_uppercase, 2, 3)}-{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{_word(r)}_{d(2)}", lambda: f"#{_pick(r, '0123456789abcdef', 6, 6)}",
        lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}", lambda: "-".join(_pick(r, "0123456789abcdef", n, n) for n in (8, 4, 4, 4, 12)), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(1)}.0.", lambda: f"get{_word(r).title()}By{_word(r).title()}Id",
    )[kind]()


def line(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text and the spans of its secrets."""
    parts, spans, size = [], [], 0

    def say(x: str, secret: bool = False) -> None:
        nonlocal size
        if secret:
            spans.append((size, size + len(x)))
        parts.append(x)
        size += len(x)

    words = lambda lo, hi: say(" ".join(_word(r) for _ in range(r.randint(lo, hi))) + " ")
    for _ in range(r.randint(1, 3)):
        words(1, 8)
        kind = r.random()
        if kind < 0.25:
            name = r.choice(["password", "pwd", "client_secret", "SECRET_KEY", "auth", "API_TOKEN", "key", "credential", "DB_PASS", "access_key"])
            before, after = r.choice([("=", ""), (": ", ""), (' = "', '"'), (": '", "'"), (":", ""), (" is ", "")])
            say(name + before)
            say(_secret(r), True)
            say(after + " ")
        elif kind < 0.35:
            say("Authorization: Bearer ")
            say(_secret(r), True)
            say(" ")
        elif kind < 0.48:
            say(r.choice(["", '"', "("]))
            say(_secret(r), True)
            say(r.choice(["", '"', ".", ","]) + " ")
        else:
            if r.random() < 0.15:
                say(r.choice(["key: ", "the token ", "auth ", "password "]))
            say(_harmless(r) + r.choice(["", ".", ",", ""]) + " ")
    words(0, 6)
    return "".join(parts), spans


def hinted_line(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text with a secret of letters of one case after a hint word, or with a plain word there."""
    words = lambda lo, hi: " ".join(_word(r) for _ in range(r.randint(lo, hi)))
    name = r.choice(["pwd", "pass", "auth", "key", "DB_PASS", "credential", "PWD", "bearer", "access_key", "credentials", "AUTH"])
    before, after = r.choice([("=", ""), (": ", ""), (' = "', '"'), (": '", "'"), (":", ""), (" = ", "")])
    head = f"{words(1, 8)} {name}{before}"
    if r.random() < 0.5:
        value = _pick(r, r.choice([string.ascii_lowercase, string.ascii_uppercase]), 10, 23)
        return f"{head}{value}{after} {words(0, 6)}", [(len(head), len(head) + len(value))]
    value = _word(r)
    return f"{head}{r.choice([value, value.title(), value.upper()])}{after} {words(0, 6)}", []


def example(text: str, spans: list[tuple[int, int]]) -> tuple[list[list[str]], list[bool], list[int]]:
    tokens, free, tags, n_odd, after = [], [], [], 0, hinted(text)
    for w in _WORD.finditer(text):
        odd = bool(_ODD.search(w[0])) or len(w[0].encode()) >= 24
        n_odd += odd
        for m in _TOKEN.finditer(text, w.start(), w.end()):
            inside = next(((a, b) for a, b in spans if a <= m.start() and m.end() <= b), None)
            tokens.append(m[0])
            free.append(odd or m.start() in after)
            tags.append(0 if not inside or not free[-1] else 1 if m.start() == inside[0] else 2)
    return features(tokens, about(len(text), text.count("="), n_odd)), free, tags


def trained(n: int = 1500, seed: int = 4, epochs: int = 6, n_hinted: int = 500) -> Crf:
    r = random.Random(seed)
    crf = Crf()
    crf.fit([example(*line(r)) for _ in range(n)] + [example(*hinted_line(r)) for _ in range(n_hinted)], epochs=epochs)
    return crf


if __name__ == "__main__":
    Path(__file__).with_name("secret_crf.json").write_text(trained().dump() + "\n")
