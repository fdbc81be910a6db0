"""Vectorised text kernels on Arrow buffers (executor side).

Hashes are polynomial over random byte weights modulo 2**64 with a final mix.
They depend on bytes only, so every executor computes the same values.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker.

    Functions are pickled by value, so a task gets fresh module globals; what
    tasks of one worker are to share must hang elsewhere.
    """
    if "_folia_worker" not in sys.modules:
        module = types.ModuleType("_folia_worker")
        module.state = {}
        sys.modules["_folia_worker"] = module
    return sys.modules["_folia_worker"].state


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_weights() -> np.ndarray:
    state = worker_state()
    if "weights" not in state:
        state["weights"] = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)
    return state["weights"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    state = worker_state()
    if "powers" not in state or len(state["powers"][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        state["powers"] = np.cumprod(up), np.cumprod(down)
    up, down = state["powers"]
    return up[:n], down[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(byte_weights()[buf] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def text_blocks(column, most: int = 1 << 19):
    """Yield (first row, bytes, offsets) over a string column in pieces of about ``most`` bytes.

    A null is an empty text.  A text is never cut: one that is longer makes a
    piece of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, whole[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and where each text's words begin.

    Words are maximal runs of bytes other than space and 0x09-0x0D, so UTF-8
    sequences stay whole.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD_BYTE[buf]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(buf)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin.

    One long text is hashed in parts of about ``most`` bytes, cut at white
    space, so what is held besides the hashes doesn't grow with it.
    """
    if len(offsets) != 2 or len(buf) <= 2 * most:
        starts, ends, at = word_spans(buf, offsets)
        return span_hash(prefix_hash(buf), starts, ends), at
    parts, a = [], 0
    while a < len(buf):
        b = min(len(buf), a + most)
        while b < len(buf) and _WORD_BYTE[buf[b]]:
            inside = _WORD_BYTE[buf[b : b + most]]
            b = b + (len(inside) if inside.all() else int(inside.argmin()))
        part = buf[a:b]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        parts.append(span_hash(prefix_hash(part), starts, ends))
        a = b
    out = np.concatenate(parts)
    return out, np.array([0, len(out)])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of ``width`` neighbours, by doubling."""
    out, have = a, 1
    while have * 2 <= width:
        out = f(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)
