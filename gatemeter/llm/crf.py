"""A linear-chain conditional random field over string features: training and Viterbi."""

from __future__ import annotations

import json
import math
from collections import defaultdict

import numpy as np

TAGS = ("O", "B", "I")
O, B, I = range(3)
_NEVER = -1e9
#: I must follow B or I.
_BARRED = ((O, I),)


class Crf:
    def __init__(self, weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.weights = weights or {}
        self.moves = np.array(moves if moves is not None else np.zeros((3, 3)), float)
        for a, b in _BARRED:
            self.moves[a, b] = _NEVER

    def scores(self, tokens: list[list[str]], free: list[bool]) -> list[list[float]]:
        """A score for each tag of each token; a token that isn't free can only be outside."""
        out = []
        for features, may in zip(tokens, free, strict=True):
            s = [0.0, 0.0, 0.0]
            for f in features:
                w = self.weights.get(f)
                if w:
                    s[0] += w[0]
                    s[1] += w[1]
                    s[2] += w[2]
            out.append(s if may else [s[0], _NEVER, _NEVER])
        if out:
            out[0][I] = _NEVER
        return out

    def decode(self, tokens: list[list[str]], free: list[bool]) -> list[int]:
        """The tags of the best path."""
        scores = self.scores(tokens, free)
        if not scores:
            return []
        moves = self.moves.tolist()
        best, back = scores[0], []
        for s in scores[1:]:
            step, came = [], []
            for b in range(3):
                a = max(range(3), key=lambda a: best[a] + moves[a][b])
                came.append(a)
                step.append(best[a] + moves[a][b] + s[b])
            best = step
            back.append(came)
        tag = max(range(3), key=best.__getitem__)
        path = [tag]
        for came in reversed(back):
            tag = came[tag]
            path.append(tag)
        return path[::-1]

    def log_likelihood(self, tokens: list[list[str]], free: list[bool], tags: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood, gradient by token and tag, gradient of the moves)."""
        s = np.array(self.scores(tokens, free))
        n = len(s)
        forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
        forward[0] = s[0]
        for i in range(1, n):
            forward[i] = s[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.moves, 0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.moves + (s[i + 1] + backward[i + 1])[None, :], 1)
        total = np.logaddexp.reduce(forward[-1])
        by_token = -np.exp(forward + backward - total)
        by_move = np.zeros((3, 3))
        for i in range(1, n):
            by_move -= np.exp(forward[i - 1][:, None] + self.moves + (s[i] + backward[i])[None, :] - total)
        value = -total
        for i, t in enumerate(tags):
            by_token[i, t] += 1
            value += s[i, t]
            if i:
                by_move[tags[i - 1], t] += 1
                value += self.moves[tags[i - 1], t]
        return float(value), by_token, by_move

    def fit(self, data: list[tuple[list[list[str]], list[bool], list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> list[float]:
        """AdaGrad on the log-likelihood; gives its sum for each epoch."""
        rng = np.random.default_rng(seed)
        weights = defaultdict(lambda: np.zeros(3), {k: np.array(v) for k, v in self.weights.items()})
        seen, seen_moves, history = defaultdict(lambda: np.full(3, 1e-3)), np.full((3, 3), 1e-3), []
        for _ in range(epochs):
            total = 0.0
            for k in rng.permutation(len(data)):
                tokens, free, tags = data[k]
                self.weights = weights
                value, by_token, by_move = self.log_likelihood_of(weights, tokens, free, tags)
                total += value
                for features, g in zip(tokens, by_token, strict=True):
                    for f in features:
                        seen[f] += g * g
                        weights[f] += rate * (g / np.sqrt(seen[f]) - decay * weights[f])
                seen_moves += by_move**2
                self.moves += rate * by_move / np.sqrt(seen_moves)
                for a, b in _BARRED:
                    self.moves[a, b] = _NEVER
            history.append(total)
        self.weights = {k: v.tolist() for k, v in weights.items()}
        return history

    def log_likelihood_of(self, weights, tokens, free, tags):
        self.weights = {f: weights[f].tolist() for features in tokens for f in features}
        return self.log_likelihood(tokens, free, tags)

    def dump(self) -> str:
        kept = {k: [round(x, 3) for x in v] for k, v in sorted(self.weights.items()) if max(map(abs, v)) > 0.02}
        return json.dumps({"weights": kept, "moves": [[round(x, 4) if math.isfinite(x) else _NEVER for x in row] for row in self.moves.tolist()]}, indent=0)

    @classmethod
    def load(cls, text: str) -> Crf:
        said = json.loads(text)
        return cls(said["weights"], said["moves"])
