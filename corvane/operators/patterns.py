"""Sparsity patterns: fill that elimination makes, and whether any values make a matrix regular."""

from __future__ import annotations


def elimination_fill(rows: dict[int, set[int]], n: int) -> dict[int, set[int]]:
    """The pattern of rows after symbolic elimination without pivoting: below a pivot, rows that have its column take in its row's later columns."""
    out = {i: set(rows.get(i, ())) for i in range(n)}
    for k in range(n):
        later = {j for j in out[k] if j > k}
        for i in range(k + 1, n):
            if k in out[i]:
                out[i] |= later
    return out


def structural_rank(rows: dict[int, set[int]]) -> int:
    """The most elements of which no two share a row or column; below n, every matrix of the pattern is singular."""
    owner: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in rows[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in rows)
