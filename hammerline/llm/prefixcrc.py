"""CRC-32 of any run of words of a document, from running CRCs at the words' borders.

For strings A and B, crc(AB) = shift(crc(A), len(B)) ^ crc(B), where shift multiplies by x**(8 len(B)) over
GF(2) modulo the CRC's polynomial. So the CRC of words i to j is the running CRC at the end of word j, from
which the shifted running CRC at the start of word i is cancelled. The document is scanned once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from zlib import crc32

import numpy as np

#: Reflected polynomial of CRC-32 (fixed value).
_POLYNOMIAL = 0xEDB88320
#: A-Z lower-cased; 0-9, a-z and all non-ASCII bytes stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are handled at once.
SPAN_BYTES = 1 << 20
#: Lengths up to this have a table of their own; longer ones are composed of powers of two.
_SHORT = 64


def _byte_step() -> np.ndarray:
    """What a zero byte makes of each of the 256 low bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


_STEP = _byte_step()


def _one_byte(c: np.ndarray) -> np.ndarray:
    return (c >> np.uint32(8)) ^ _STEP[c & np.uint32(255)]


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """tables (4, 256): the linear map's values for each byte of its argument."""
    return tables[0][c & np.uint32(255)] ^ tables[1][c >> np.uint32(8) & np.uint32(255)] ^ tables[2][c >> np.uint32(16) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]


def _identity() -> np.ndarray:
    return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])


@cache
def _short_tables() -> np.ndarray:
    """(byte of the argument, 256 * length + value): shifts by 0 to _SHORT bytes."""
    tables = [_identity()]
    for _ in range(_SHORT):
        tables.append(_one_byte(tables[-1]))
    return np.stack(tables).transpose(1, 0, 2).reshape(4, -1)


@cache
def _doubling(k: int) -> np.ndarray:
    """Shift by 2**k bytes."""
    if k == 0:
        return _one_byte(_identity())
    half = _doubling(k - 1)
    return _apply(half, half)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs of strings as they count before `by` more bytes."""
    short = by <= _SHORT
    at = np.where(short, by, 0) << 8
    tables = _short_tables()
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= tables[k][at + (crc >> np.uint32(8 * k) & np.uint32(255))]
    if not short.all():
        far = np.flatnonzero(~short)
        c, n, k = crc[far], by[far], 0
        while n.any():
            odd = (n & 1).astype(bool)
            c[odd] = _apply(_doubling(k), c[odd])
            n, k = n >> 1, k + 1
        out[far] = c
    return out


def spans(text: str | None) -> Iterator[tuple[list[bytes], bool]]:
    """Lists of words of a text, each from about SPAN_BYTES of it, and whether the list begins with the last
    word of the one before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at, last = 0, []
    while at < len(raw):
        held = raw[at : at + SPAN_BYTES].translate(_FOLD)
        at += len(held)
        while at < len(raw) and held[-1] != 32:  # a word that goes on belongs to this span
            more = raw[at : at + 4096].translate(_FOLD)
            cut = more.find(b" ") + 1 or len(more)
            held, at = held + more[:cut], at + cut
        words = held.split()
        if words:
            yield last + words, bool(last)
            last = words[-1:]


def ngram_crcs(words: list[bytes], most: int, skip: bool = False) -> np.ndarray:
    """CRC-32 of all runs of 1 to `most` consecutive words, joined by one space; unsigned. skip: leave out
    runs that lie in the first word alone."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    spaced = [words[0], *map(b" ".__add__, words[1:])]
    running = np.fromiter(accumulate(spaced, lambda c, w: crc32(w, c), initial=0), np.uint32, n + 1)
    ends, begins = running[1:], running[:-1].copy()
    begins[1:] = ~_one_byte(~begins[1:] ^ np.uint32(32))  # the space before each word but the first
    out = []
    size = np.zeros(n, np.int64)
    for k in range(1, min(most, n) + 1):
        size = size[: n - k + 1] + lengths[k - 1 :] + (k > 1)
        crcs = ends[k - 1 :] ^ shifted(begins[: n - k + 1], size)
        out.append(crcs[1:] if skip and k == 1 else crcs)
    return np.concatenate(out)
