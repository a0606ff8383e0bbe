"""Vectorised text kernels over Arrow string buffers, shared by the llm operators.

A batch of texts is one UTF-8 byte buffer with offsets. Tokens are runs of ASCII letters and
digits or of bytes above 0x7F, ASCII letters in lower case; a token's hash is a polynomial over
its bytes, so a whole batch is hashed in a few array passes. Nothing here truncates a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    h = h ^ (h >> U64(30))
    h = h * _MIX1
    h = h ^ (h >> U64(27))
    h = h * _MIX2
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_BYTE = _BYTE[LOWER]
_pow = np.cumprod(np.concatenate([[U64(1)], np.full(1023, _BASE, dtype=U64)]))


def powers(n: int) -> np.ndarray:
    global _pow
    if n > len(_pow):
        _pow = np.cumprod(np.concatenate([[U64(1)], np.full(2 * n, _BASE, dtype=U64)]))
    return _pow


def slices(column: pa.Array, at_most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of runs of rows of about `at_most` bytes.

    Nulls count as empty texts. One text longer than `at_most` is a run of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + at_most, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def token_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens in order, offsets of each text's tokens)."""
    starts, _, lengths, where = token_spans(buf, offs)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(where)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTE[buf[where]] * powers(int(lengths.max()))[place], first)
    return mix(h), np.searchsorted(starts, offs)


def token_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, past the end, length of each token, positions of all their bytes)."""
    word = IS_WORD[buf]
    before = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
        before[offs[:-1][offs[:-1] < len(word)]] = False
    starts = np.flatnonzero(word & ~before)
    where = np.flatnonzero(word)
    if not len(starts):
        return starts, starts, starts, where
    first = np.searchsorted(where, starts)
    lengths = np.diff(np.append(first, len(where)))
    return starts, starts + lengths, lengths, where


_N = mix(np.arange(11, 43, dtype=U64) * _BASE) | U64(1)


def ngram_hashes(h: np.ndarray, tok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of n tokens, offsets of each text's runs).

    A text with tokens, but fewer than n, has one gram: all its tokens.
    """
    count = np.diff(tok)
    grams = np.maximum(count - n + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(grams)])
    if not len(h):
        return np.zeros(0, U64), out
    padded = np.concatenate([h, np.zeros(n, U64)])
    at = np.repeat(tok[:-1], grams) + (np.arange(out[-1]) - np.repeat(out[:-1], grams))
    end = np.repeat(tok[1:], grams)
    total = np.zeros(len(at), U64)
    for k in range(n):
        total += np.where(at + k < end, padded[at + k] * _N[k], U64(0))
    return mix(total), out


def gram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text in order."""
    for i, j, buf, offs in slices(column):
        grams, at = ngram_hashes(*token_hashes(buf, offs), n)
        for k in range(j - i):
            s = np.sort(grams[at[k] : at[k + 1]])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield i + k, s


def text_tokens(text: str) -> list[str]:
    """The tokens of one text, for tests and small inputs."""
    data = text.encode()
    buf = LOWER[np.frombuffer(data, np.uint8)]
    s, e, _, _ = token_spans(buf, np.array([0, len(data)]))
    raw = buf.tobytes()
    return [raw[a:b].decode() for a, b in zip(s, e)]
