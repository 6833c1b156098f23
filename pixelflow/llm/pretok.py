"""Matches of the byte-level BPE pattern, found for whole batches of texts at once.

The pattern's alternatives become runs of four character classes (white space, letters,
digits, others): a plain space before a run joins it; of a run of white space before
other characters the last one stands apart; an apostrophe that begins a match takes a
contraction's letters with it. Tests compare this with the pattern itself.
"""

from __future__ import annotations

import numpy as np
import regex

SPACE, LETTER, DIGIT, OTHER = range(4)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point; surrogates count as others."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[[ord(c) for c in m[0]]] = kind
        _classes = table
    return _classes


def _letters(cp: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many letters after an apostrophe a contraction takes (0 to 2)."""
    size = len(cp)
    one = cp[np.minimum(at, size - 1)]
    two = cp[np.minimum(at + 1, size - 1)]
    room = last - at
    is_ = lambda x, c: x == ord(c)
    single = (room >= 1) & (is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d"))
    double = (room >= 2) & ((is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")))
    return np.where(double, 2, np.where(single, 1, 0))


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which matches begin, over all texts in a row; matches fill every text."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    byte_at = np.flatnonzero(lead)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[cp]
    size = len(cp)
    edge = np.zeros(size + 1, bool)
    edge[np.searchsorted(byte_at, offsets)] = True  # texts begin here
    begin = edge.copy()
    begin[1:size] |= kind[1:] != kind[:-1]
    begin[size] = True
    runs = np.flatnonzero(begin)
    first, last = runs[:-1], runs[1:]
    what = kind[first]
    opens = edge[last]  # the run ends its text
    # white space before others in the same text: its last character goes apart, or, a plain space, to the next run
    tail = np.flatnonzero((what == SPACE) & ~opens)
    tail_at = last[tail] - 1
    mark = begin[:size].copy()
    mark[tail_at] = True
    joined = cp[tail_at] == 0x20
    mark[last[tail[joined]]] = False
    # contractions: an apostrophe that begins a match, alone in its run, before letters of the same text
    quote = np.flatnonzero((what == OTHER) & (cp[first] == 0x27) & (last - first == 1) & ~opens)
    quote = quote[mark[first[quote]]]
    quote = quote[what[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        taken = _letters(cp, last[quote], last[quote + 1])
        quote, taken = quote[taken > 0], taken[taken > 0]
        mark[last[quote]] = False
        rest = last[quote] + taken
        inside = rest < last[quote + 1]
        mark[rest[inside]] = True
    return byte_at[mark]
