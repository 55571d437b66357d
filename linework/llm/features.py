"""Dense features of whole texts, as numpy arrays, for the classifiers."""

from __future__ import annotations

import re

import numpy as np

QUALITY_FEATURES = ("log_words", "distinct", "repeat_next", "word_chars", "symbol_words", "mark_words", "capital_words", "alpha", "digits", "pipes", "long_words", "stop_marks")
MARK = re.compile(rb"[%$&*#@^~+=<>{}\[\]_]{2,}|[!?]{2,}")
PIPE = re.compile(rb"[|\\/]")
ALPHA, DIGIT, UPPER = (bytes(c for c in range(256) if f(c)) for f in (lambda c: chr(c).isalpha() and c < 128 or c >= 128, lambda c: 48 <= c < 58, lambda c: 65 <= c < 91))


def quality_features(text: str | None) -> list[float]:
    """QUALITY_FEATURES of one text; an empty one has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(QUALITY_FEATURES)
    size = len(raw)
    alpha = size - len(raw.translate(None, ALPHA))
    digits = size - len(raw.translate(None, DIGIT))
    return [
        np.log1p(n), len(set(words)) / n ** 0.9, sum(map(bytes.__eq__, words, words[1:])) / n, size / n / 10,
        (size - len(raw.translate(None, b"|*%$&#@!^~=<>{}[]_"))) / n, len(MARK.findall(raw)) / n, sum(map(bytes.isupper, words)) / n,
        alpha / size, digits / size, len(PIPE.findall(raw)) / n, sum(len(w) > 24 for w in words) / n, (raw.count(b".") + raw.count(b",")) / n,
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
