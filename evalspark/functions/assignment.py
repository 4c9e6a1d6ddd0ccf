"""The cheapest assignment of rows to columns, exactly, by shortest augmenting paths."""

from __future__ import annotations

from collections.abc import Sequence

_INFINITE = float("inf")
#: Costs that differ by less are equal.
TIE = 1e-9


def _potentials(cost: Sequence[Sequence[float]]) -> tuple[list[int], list[float], list[float]]:
    """The row of each column (-1 for none), and prices of rows and columns under which every matched pair costs nothing
    and no pair less. Each row enters by one search for the nearest free column; O(rows ** 2 * columns) in all."""
    n, m = len(cost), len(cost[0])
    of, row_price, column_price = [-1] * m, [0.0] * n, [0.0] * m
    for row in range(n):
        nearest, came, done = [_INFINITE] * m, [-1] * m, [False] * m
        at, column, walked = row, -1, 0.0
        while True:
            for j in range(m):
                if not done[j]:
                    through = walked + cost[at][j] - row_price[at] - column_price[j]
                    if through < nearest[j]:
                        nearest[j], came[j] = through, column
            column = min((j for j in range(m) if not done[j]), key=nearest.__getitem__)
            walked, done[column] = nearest[column], True
            if of[column] < 0:
                break
            at = of[column]
        row_price[row] += walked
        for j in range(m):
            if done[j] and j != column:
                row_price[of[j]] += walked - nearest[j]
                column_price[j] -= walked - nearest[j]
        while column >= 0:
            before = came[column]
            of[column] = of[before] if before >= 0 else row
            column = before
    return of, row_price, column_price


def assignment(cost: Sequence[Sequence[float]]) -> list[int]:
    """The column of each row so that the sum of costs is least; of several such, the first in lexical order.

    There must be as many columns as rows, or more.
    """
    if not cost:
        return []
    n, m = len(cost), len(cost[0])
    # with a row of no cost for every column too many, each column is used, and prices tell all optimal assignments
    square = [*cost, *[[0.0] * m] * (m - n)]
    of, row_price, column_price = _potentials(square)
    tight = [[j for j in range(m) if square[i][j] - row_price[i] - column_price[j] <= TIE] for i in range(m)]
    column_of = [0] * m
    for j, i in enumerate(of):
        column_of[i] = j

    def moved(i: int, free: int, barred: set[int], fixed: int) -> bool:
        """Whether row i can take another tight column, along rows after `fixed`, so that `free` is used."""
        for j in tight[i]:
            if j in barred:
                continue
            barred.add(j)
            if j == free or of[j] > fixed and moved(of[j], free, barred, fixed):
                of[j], column_of[i] = i, j
                return True
        return False

    for i in range(n):
        for j in tight[i]:
            if j == column_of[i]:
                break
            owner = of[j]
            # rows before i keep what they have
            if owner > i and moved(owner, column_of[i], {j}, i):
                of[j], column_of[i] = i, j
                break
    return column_of[:n]
