"""Shortest edit scripts between lists of lines, in time by the number of differences and memory by the number of lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def turning_points(a: Sequence[int], b: Sequence[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """Ends (x, y), (u, v) of a run of equal lines in the middle of a shortest script from a[a0:a1] to b[b0:b1], both of which have lines.

    Scripts of 0, 1, 2, ... edits go on from both ends at once; for each diagonal the farthest place is kept. Where the two meet, half the edits lie on either side.
    """
    n, m = a1 - a0, b1 - b0
    gap = n - m
    ahead: dict[int, int] = {}
    back: dict[int, int] = {}
    edits = 0
    while True:
        for seen, other, forward in ((ahead, back, True), (back, ahead, False)):
            new = {}
            for k in range(max(-edits, -m + (edits + m) % 2), min(edits, n - (edits + n) % 2) + 1, 2):
                down, right = seen.get(k + 1, -1), seen.get(k - 1, -2) + 1
                x = 0 if edits == 0 else max(down if down - k <= m else -1, right if right <= n else -1)
                y = x - k
                if x < 0 or y < 0:
                    continue
                x_, y_ = x, y
                if forward:
                    while x < n and y < m and a[a0 + x] == b[b0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                        x, y = x + 1, y + 1
                new[k] = x
                if x + other.get(gap - k, -1) >= n and (gap - k) in other:
                    return (a0 + x_, b0 + y_, a0 + x, b0 + y) if forward else (a1 - x, b1 - y, a1 - x_, b1 - y_)
            seen.update(new)
        edits += 1


def equal_runs(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of a longest common subsequence, in order, neighbours joined."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        start = a0
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        if a0 > start:
            out.append((start, b0 - (a0 - start), a0 - start))
        end = a1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a1 < end:
            out.append((a1, b1, end - a1))
        if a0 < a1 and b0 < b1:
            x, y, u, v = turning_points(a, b, a0, a1, b0, b1)
            if u > x:
                out.append((x, y, u - x))
            todo += [(a0, x, b0, y), (u, a1, v, b1)]
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(out):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, k = joined.pop()
            n += k
        joined.append((i, j, n))
    return joined


def opcodes(old: Sequence[str], new: Sequence[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """(op, old_from, old_to, new_from, new_to) of a shortest script: equal, delete, insert, or replace where both meet.

    Lines that only one side has are in no common subsequence, so they are taken out first: what is left to search has lines of both.
    """
    numbers = {x: i for i, x in enumerate(dict.fromkeys(old))}
    both = numbers.keys() & set(new)
    a_at, b_at = ([i for i, x in enumerate(lines) if x in both] for lines in (old, new))
    runs = equal_runs([numbers[old[i]] for i in a_at], [numbers[new[j]] for j in b_at])
    i = j = start_i = start_j = 0

    def edit(to_i: int, to_j: int) -> Iterator[tuple[str, int, int, int, int]]:
        if start_i < i:
            yield "equal", start_i, i, start_j, j
        if i < to_i or j < to_j:
            yield "replace" if i < to_i and j < to_j else "delete" if i < to_i else "insert", i, to_i, j, to_j

    for x, y in ((a_at[p + k], b_at[q + k]) for p, q, n in runs for k in range(n)):
        if (x, y) != (i, j):
            yield from edit(x, y)
            start_i, start_j = x, y
        i, j = x + 1, y + 1
    yield from edit(len(old), len(new))
