"""Whole numbers in few bytes: what shuffles carry as binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

LOW_BITS = 52  # of an id; above them is the term's frequency
LOW = (1 << LOW_BITS) - 1


def spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places starts[i], ..., starts[i] + n[i] - 1 of all i."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


def firsts(n: np.ndarray) -> np.ndarray:
    """Where each of groups of n values begins."""
    return np.cumsum(n) - n


def sorted_within(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by group, then value; numbers of groups of two bytes are sorted without comparing them."""
    order = np.argsort(values, kind="stable")
    groups = groups[order]
    if groups.max(initial=0) < 1 << 16:
        groups = groups.astype(np.uint16)
    return order[np.argsort(groups, kind="stable")]


def packed(values: np.ndarray) -> bytes:
    """Numbers of 0 or more, byte by byte, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : data[0]] = planes.T
    return values.view("<u8").ravel().astype(np.int64)


def stepped(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps inside groups of n ascending values, the first of each as it is."""
    out = np.diff(values, prepend=values[:1] * 0)
    first = firsts(n)[n > 0]
    out[first] = values[first]
    return out


def summed(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values again."""
    total = np.cumsum(steps)
    return total - np.repeat((total - steps)[firsts(n)[n > 0]], n[n > 0])


def split_ids(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending ids, in groups of n, the steps of their frequencies and those of the rest among equal frequencies."""
    high = stepped(ids >> LOW_BITS, n)
    fresh = high > 0  # frequencies are above 0, so the first of a group is fresh
    return high, stepped(ids & LOW, np.diff(np.flatnonzero(np.append(fresh, True))))


def joined_ids(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    runs = np.diff(np.flatnonzero(np.append(high > 0, True)))
    return summed(high, n) << LOW_BITS | summed(low, runs)


def as_binary(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """One value a group of n ascending ids, equal for equal groups: two numbers an id, seven bits a byte."""
    v = np.stack(split_ids(ids, n), 1).ravel()
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= 1 << 7 * k
    at, data = firsts(size), np.zeros(size.sum(), np.uint8)
    for k in range(int(size.max(initial=0))):
        m = size > k
        data[at[m] + k] = v[m] >> 7 * k & 127 | (size[m] > k + 1) * 128
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(2 * n)])]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def from_binary(column: pa.Array | pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """The ids of all groups, one after another."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    end = np.flatnonzero(data < 128)
    at = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    size, v = end - at + 1, np.zeros(len(end), np.int64)
    for k in range(int(size.max(initial=0))):
        m = size > k
        v[m] |= (data[at[m] + k] & 127).astype(np.int64) << 7 * k
    return joined_ids(v[::2], v[1::2], n)
