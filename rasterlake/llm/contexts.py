"""Which tokens of many texts may stand in the context of a wanted pattern.

All tokens of some texts are looked at as arrays of code points: their words before
and after are hashed and looked up in a bit set.  A token may be marked that has no
such pattern, but none that has one is left out, so an exact look at the marked ones
gives all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rasterlake.llm import idfilter
from rasterlake.llm.kernels import JOIN, U64, mix, signed

PLANE = 1 << 16
PIECE_CHARS = 1 << 17


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character its lower case, whether that is part of a word, and whether it is not settled by itself."""
    low = [chr(c).lower() if not 0xD800 <= c < 0xE000 else chr(c) for c in range(PLANE)]
    odd = np.array([len(s) != 1 or ord(s) >= PLANE for s in low] + [True])
    odd[0x3A3] = True  # a final sigma differs
    lower = np.array([ord(s) if len(s) == 1 and ord(s) < PLANE else c for c, s in enumerate(low)] + [PLANE], np.int64)
    inside = np.ones(PLANE + 1, bool)
    word = re.compile(r"\w")
    inside[:-1] = [word.match(s) is not None for s in low]
    return lower, inside | odd, odd


LOWER, INSIDE, ODD = _tables()


def _among(chars: str) -> np.ndarray:
    out = np.zeros(PLANE + 1, bool)
    out[list(map(ord, chars))] = True
    return out


SPACE, MARK = _among(" \t\n\v\f\r"), _among(":=#")


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's characters."""
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = mix((place << 17 | low[place + np.repeat(starts, size)]).astype(U64) + U64(JOIN))
    return mix(np.add.reduceat(value, first) + size.astype(U64))


def _ids(a: np.ndarray, b: np.ndarray | int, form: int) -> np.ndarray:
    return mix(mix(a * U64(JOIN) + (b if isinstance(b, np.ndarray) else U64(b))) + U64(form))


def pattern_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of patterns ``a b _``, ``a _ b`` and ``a: _``."""
    for batch in batches:
        out = [np.zeros(0, U64)]
        forms: dict[int, list[tuple[str, str]]] = {0: [], 1: [], 2: []}
        for p in batch.column(0).to_pylist():
            parts = p.split(" ")
            if len(parts) == 2:
                forms[2].append((parts[0][:-1], ""))
                continue
            if parts[2] == "_":  # a word may be "_" itself
                forms[0].append((parts[0], parts[1]))
            if parts[1] == "_":
                forms[1].append((parts[0], parts[2]))
        for form, pairs in forms.items():
            a, b = (_word_hashes([w[i] for w in pairs]) for i in (0, 1))
            out.append(_ids(a, b if form < 2 else 0, form))
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out)))], names=["id"])


def _word_hashes(words: list[str]) -> np.ndarray:
    size = np.array(list(map(len, words)), np.int64)
    end = np.cumsum(size)
    some = size > 0
    out = np.zeros(len(words), U64)
    out[some] = _hashes(np.minimum(_points("".join(words)), PLANE), (end - size)[some], end[some])
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE_CHARS`` characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def marked(texts: list[str], bits: np.ndarray, lead: str, trail: str, width: int) -> list[list[tuple[int, int]]]:
    """Start and end of each text's tokens, without ``lead`` and ``trail``, that may have a pattern of the set.

    The words before and after are those within ``width`` characters.
    """
    c = np.minimum(_points("\n".join(texts)), PLANE)
    size = np.array(list(map(len, texts)), np.int64)
    stop = np.cumsum(size + 1) - 1
    space = SPACE[c]
    s, e = _runs(~space)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(s):
        return out
    free = np.append(np.flatnonzero(~_among(lead)[c]), len(c))
    s = free[np.searchsorted(free, s)]
    free = np.insert(np.flatnonzero(~_among(trail)[c]), 0, -1)
    e = free[np.searchsorted(free, e) - 1] + 1
    some = s < e
    s, e = s[some], e[some]
    row = np.searchsorted(stop, s)
    ws, we = _runs(INSIDE[c])
    h = _hashes(LOWER[c], ws, we)
    # sentinels: two words far before and one far behind
    far = 4 * (len(c) + width)
    ws, we = np.concatenate([[-far, -far], ws, [far]]), np.concatenate([[-far, -far], we, [far]])
    h = np.concatenate([np.zeros(2, U64), h, np.zeros(1, U64)])
    b1 = np.searchsorted(we, s, "right") - 1
    b0, a1 = b1 - 1, np.searchsorted(ws, e)
    lo, hi = np.maximum(stop[row] - size[row], s - width), np.minimum(stop[row], e + width)
    has1, has0, after = ws[b1] >= lo, ws[b0] >= lo, we[a1] <= hi
    # a word that the width cuts
    maybe = (~has1 & (we[b1] > lo)) | (has1 & ~has0 & (we[b0] > lo)) | (has1 & ~after & (ws[a1] < hi))
    if ODD[c].any():
        odd = np.concatenate([[0], np.cumsum(ODD[c])])
        maybe |= odd[hi] > odd[lo]
    first, second = h[b1], np.zeros(0)
    for form, at in ((0, has0), (1, has1 & after), (2, has1 & (MARK[c[s - 1]] | MARK[c[s - 2]]))):
        at = np.flatnonzero(at & ~maybe)
        if form == 0:
            first, second = h[b0[at]], h[b1[at]]
        else:
            first, second = h[b1[at]], h[a1[at]] if form == 1 else 0
        slot = idfilter._slots(signed(_ids(first, second, form)))
        maybe[at[(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]] = True
    at = np.flatnonzero(maybe)
    begin = (stop - size)[row[at]]
    for r, x, y in zip(row[at].tolist(), (s[at] - begin).tolist(), (e[at] - begin).tolist()):
        out[r].append((x, y))
    return out
