"""Statistics of whole texts, computed in tasks from a text's bytes. Words are runs of other than ASCII white space."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WINDOW = 8

# The character classes that are counted.
SYMBOLS = b"#*$%&|<>"
STOPS = b".!?"
PUNCTUATION = b",;:'\"()-"

#: What stats() returns, in order. The first five are the counts a caller may report.
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_stops", "n_bangs", "n_punctuation", "n_wide", "n_distinct", "n_top_word", "n_short", "longest_word", "n_stopped_lines", "n_capital_words",
)

#: Ratios of those counts that models look at.
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share",
    "words_per_line", "upper_share", "digit_share", "stops_per_word", "bangs_per_word", "punctuation_per_word", "wide_share", "distinct_share", "top_word_share", "short_share", "log_longest", "stopped_line_share", "capital_share",
)


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included. Windows are compared exactly: ranks of
    pairs, then of pairs of pairs, until a rank stands for a whole window, whose length is a power of two."""
    if len(ids) <= window:
        return 0
    ranks, size = ids.astype(np.int64), 1
    while size < window:
        keys = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
        _, ranks, counts = np.unique(keys, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        size *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def stats(text: bytes) -> list[int]:
    """The counts of NAMES for a text in UTF-8."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    of = lambda chars: int(counts[list(chars)].sum())
    blank = of(b" \t\n\r\x0b\x0c")
    return [
        len(words),
        len(text) - blank - int(counts[0x80:0xC0].sum()),
        of(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        int(counts[65:91].sum()),
        int(counts[48:58].sum()),
        of(STOPS),
        int(counts[33]),
        of(PUNCTUATION),
        int(counts[0xC0:].sum()),
        len(number),
        int(np.bincount(ids).max()) if words else 0,
        sum(len(w) * ids_count for w, ids_count in zip(number, np.bincount(ids) if words else (), strict=False) if len(w) == 1),
        max(map(len, number), default=0),
        sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines),
        sum(1 for w in number if w[:1].isupper()),
    ]


def features(rows: Iterable[list[int]]) -> np.ndarray:
    """A row of FEATURES for each row of stats(); all finite, for empty texts too."""
    a = np.array(list(rows), np.float64).reshape(-1, len(NAMES))
    at = {n: a[:, i] for i, n in enumerate(NAMES)}
    words, chars, lines = np.maximum(at["n_words"], 1), np.maximum(at["word_chars"], 1), np.maximum(at["n_lines"], 1)
    return np.column_stack([
        np.log1p(at["n_words"]), at["word_chars"] / words, at["n_symbols"] / words, at["n_dup_lines"] / lines, at["n_repeat_words"] / words,
        at["n_words"] / lines, at["n_upper"] / chars, at["n_digits"] / chars, at["n_stops"] / words, at["n_bangs"] / words, at["n_punctuation"] / words, at["n_wide"] / chars, at["n_distinct"] / words, at["n_top_word"] / words, at["n_short"] / words, np.log1p(at["longest_word"]), at["n_stopped_lines"] / lines, at["n_capital_words"] / np.maximum(at["n_distinct"], 1),
    ])
