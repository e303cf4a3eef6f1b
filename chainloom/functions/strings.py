"""Edit distance and the segment scheme for joining strings within k edits.

A string is cut into k+1 segments; a string within k edits of it holds one of
them unchanged, at a position that differs by few places.  ``windows`` gives
those places (multi-match-aware), so both sides meet on equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k+1 even segments of a string."""
    parts, small = k + 1, length // (k + 1)
    larger, out, start = length - small * parts, [], 0
    for i in range(parts):
        size = small + (i >= parts - larger)
        out.append((start, size))
        start += size
    return out


def windows(own: int, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(segment number, start, size) of the substrings of a string of length
    ``own`` that can equal a segment of a string of ``length`` within k edits."""
    delta = own - length
    for i, (start, size) in enumerate(segments(length, k)):
        if not size:
            yield i, 0, 0
            continue
        low = max(0, start - i, start + delta - (k - i))
        high = min(own - size, start + i, start + delta + (k - i))
        for at in range(low, high + 1):
            yield i, at, size


def banded_distance(a: str, b: str, k: int) -> int:
    """Levenshtein distance, k + 1 where it is larger."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    if len(a) > len(b):
        a, b = b, a
    far = k + 1
    row = [j if j <= k else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - k), min(len(b), i + k)
        new = [far] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        row = new
        if min(row[max(0, low - 1) : high + 1]) >= far:
            return far
    return row[len(b)]
