"""Statistics of whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from touchline.llm.common import windows, word_hashes

_SPACE = np.array([0x20, 9, 10, 11, 12, 13])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_STOPS, _MARKS = np.frombuffer(b".,;:", np.uint8), np.frombuffer(b"!?", np.uint8)
_LEADS = np.arange(0xC0, 0x100)

#: The counts, in the order of text_counts().
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The ratios that models see, in the order of text_ratios(); none grows with the length of a clean text.
RATIOS = ("symbols", "pipes", "upper", "digits", "stops", "marks", "foreign", "word_length", "dup_lines", "repeats", "distinct", "line_words", "longest")
_NONE = np.zeros(len(COUNTS) + len(RATIOS))


def text_stats(data: bytes | None) -> np.ndarray:
    """The COUNTS and RATIOS of one text; zeros for null and for texts without words."""
    if not data:
        return _NONE
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(hist.sum() - hist[0x80:0xC0].sum())
    word_chars = chars - int(hist[_SPACE].sum())
    if not word_chars:
        return _NONE
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    hashes = word_hashes(words)
    again = repeat_words(hashes)
    symbols = int(hist[_SYMBOLS].sum())
    upper, letters = int(hist[_UPPER].sum()), int(hist[_UPPER].sum() + hist[_LOWER].sum() + hist[_LEADS].sum())
    ratios = (
        symbols / word_chars,
        int(hist[124]) / n,
        upper / max(letters, 1),
        int(hist[_DIGIT].sum()) / word_chars,
        int(hist[_STOPS].sum()) / n,
        int(hist[_MARKS].sum()) / n,
        int(hist[_LEADS].sum()) / max(letters, 1),
        word_chars / n,
        repeated / len(lines),
        again / n,
        np.log1p(len(np.unique(hashes))) / np.log1p(n),
        min(n / len(lines), 400.0),
        min(max(map(len, words)), 200),
    )
    return np.array((n, word_chars, symbols, repeated, again, *ratios), float)


def repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more in the text."""
    grams = windows(hashes, 3)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    often = np.zeros(len(grams), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : i + len(grams)] |= often
    return int(covered.sum())
