"""Numeric features of a whole text, shared by the trained classifiers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash

#: Names of ``text_shape``'s values, in order.
SHAPE = (
    "log_chars", "log_words", "word_chars", "upper", "digit", "space", "newline", "letter",
    "bang", "pipe", "mark", "stop", "distinct_words", "top_word", "repeat_next",
    "repeat_line", "shared_lines", "end_marks", "long_words", "short_words",
)


def text_shape(text: str | None) -> list[float]:
    """Shape of a whole text: shares of kinds of characters, and how often
    words and lines repeat.  NULL counts as empty; an empty text is all 0."""
    text = text or ""
    if not text:
        return [0.0] * len(SHAPE)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    size = len(raw)
    wide = seen[128:].sum()
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    digits = seen[48:58].sum()
    space = seen[32] + seen[9] + seen[10] + seen[13]
    marks = seen[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum()
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    line_counts = Counter(lines)
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()),
        upper / size, digits / size, space / size, seen[10] / size,
        (upper + lower + wide) / size, seen[33] / size, seen[124] / size, marks / size,
        (seen[46] + seen[44]) / size, len(counts) / n,
        max(counts.values(), default=0) / n, repeats / n,
        1 - len(line_counts) / max(len(lines), 1), len(lines) / n,
        float(np.fromiter((w[-1] in "!#$%&*|" for w in words), bool, len(words)).mean()) if words else 0.0,
        float((lengths > 15).mean()), float((lengths <= 2).mean()),
    ]


class WordSlots:
    """lower-case word (bytes) → the slots, below 2**bits, of the word and of
    its first four bytes, by a fixed hash; ``packed`` holds both in one number."""

    def __init__(self, bits: int, most: int = 100_000):
        self.bits, self.mask, self.packed = bits, (1 << bits) - 1, _Packed(bits, most)

    def __getitem__(self, word: bytes) -> tuple[int, int]:
        return self.packed[word] >> self.bits, self.packed[word] & self.mask


class _Packed(dict):
    def __init__(self, bits: int, most: int):
        super().__init__()
        self.bits, self.mask, self.most = bits, (1 << bits) - 1, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(_STRIP)
        hashed = xxhash.xxh3_64_intdigest
        both = self[word] = (hashed(bare) & self.mask) << self.bits | hashed(b"^" + bare[:4]) & self.mask
        return both


_STRIP = b".,;:!?\"'()[]{}<>#$%&*|-"


def word_slots(text: str | None, slots: WordSlots, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted slots, counts) of the words of a whole text, without the marks
    around them; NULL counts as empty.  With ``kept``, a flag per slot, only
    slots that it marks."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    found = Counter(words)
    both = np.fromiter(map(slots.packed.__getitem__, found), np.int64, len(found))
    times = np.fromiter(found.values(), np.int64, len(found))
    index, times = np.concatenate([both >> slots.bits, both & slots.mask]), np.concatenate([times, times])
    if kept is not None:
        held = kept[index]
        index, times = index[held], times[held]
    index, where = np.unique(index, return_inverse=True)
    return index, np.bincount(where.ravel(), times, len(index)).astype(np.int64)
