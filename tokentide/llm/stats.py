"""Counts over one whole text, from its bytes."""

from __future__ import annotations

import numpy as np

from tokentide.llm.text import spaced_words

_BYTES = {
    "space": np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8),
    "symbol": np.frombuffer(b"#*$%&|<>", np.uint8),
    "mark": np.frombuffer(b"!?", np.uint8),
    "upper": np.arange(0x41, 0x5B),
    "digit": np.arange(0x30, 0x3A),
    "tail": np.arange(0x80, 0xC0),
}
WINDOW = 5

#: Names, in order, of what text_counts returns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_digits", "n_distinct", "n_echoes", "n_lines")


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice, first occurrences included."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    grams = numbers[:n].astype(np.int64)
    for k in range(1, window):
        base = int(numbers.max()) + 1
        if int(grams.max()) >= (1 << 62) // base:  # number the prefixes anew rather than overflow
            grams = np.unique(grams, return_inverse=True)[1]
        grams = grams * base + numbers[k : k + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(numbers) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts named in COUNTS. A null text has none of anything, not even a line.

    ``n_marks``: exclamation and question marks; ``n_upper``, ``n_digits``: ASCII ones;
    ``n_echoes``: words equal to the one before; lines are split at line feeds.
    """
    if not text:
        return (0,) * (len(COUNTS) - 1) + (0 if text is None else 1,)
    words = spaced_words(text)
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = {name: int(bytes_of[codes].sum()) for name, codes in _BYTES.items()}
    number: dict[bytes, int] = {}
    numbers = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = text.split(b"\n")
    worded = [x for x in lines if x.strip()] if len(lines) > 1 else []
    return (
        len(words),
        len(text) - of["tail"] - of["space"],
        of["symbol"],
        len(worded) - len(set(worded)),
        repeated_words(numbers),
        of["mark"],
        of["upper"],
        of["digit"],
        len(number),
        int((numbers[1:] == numbers[:-1]).sum()),
        len(lines),
    )
