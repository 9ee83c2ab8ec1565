"""Words of a batch of texts as arrays of places and 64-bit hashes, computed with numpy inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are cut into words some of them at a time: a slice has this many bytes, or is one text.
SLICE_BYTES = 4 << 20
#: Odd multipliers of the two hash families.
FIRST = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SECOND = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def byte_table(members: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[members] = True
    return out


#: Bytes of words between ASCII white space, and of words of digits, letters and bytes beyond ASCII.
SPACED = ~byte_table([0x20, *range(0x09, 0x0E)])
LETTERS = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def words_of(
    raw: np.ndarray, offsets: np.ndarray, of_word: np.ndarray, fold: np.ndarray = SAME, families: tuple = (FIRST,)
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each word: its text and its number in it; and its hashes, one array a family."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in families]
    raw = fold[raw]
    inside = of_word[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    first[1:] |= ~inside[:-1]
    first &= inside
    starts = np.flatnonzero(first)
    if not len(starts):
        return words_of(raw[:0], offsets[:1], of_word, fold, families)
    own = raw[inside]
    at = np.flatnonzero(first[inside])
    length = np.diff(at, append=len(own))
    local = np.arange(len(own)) - np.repeat(at, length)
    values = own.astype(np.uint64) + np.uint64(1)
    hashes = []
    for base, spread in families:
        h = np.add.reduceat(values * powers(base, int(length.max()))[local], at)
        hashes.append(mixed(h + length.astype(np.uint64) * spread))
    text = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    return text, nth, hashes


def windows_of(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``n`` successive word hashes (at the last ``n - 1`` places, of what is left of them)."""
    out = np.zeros(len(hashes), np.uint64)
    for k, p in enumerate(powers(base, min(n, len(hashes)))):
        out[: len(hashes) - k] += hashes[k:] * p
    return mixed(out)
