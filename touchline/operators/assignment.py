"""Minimum-cost assignment: a small numpy solver used inside one frame or one component."""

from __future__ import annotations

import math
from collections import Counter
from heapq import heappop, heappush

import numpy as np

FORBIDDEN = 1e6


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest full assignment; needs no more rows than columns.

    Shortest augmenting paths with dual prices, one row at a time.
    """
    n, width = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(width + 1)
    owner = np.zeros(width + 1, dtype=int)  # 1-based; column 0 stands for the row being placed
    for row in range(1, n + 1):
        owner[0], at = row, 0
        slack = np.full(width + 1, np.inf)
        came_from = np.zeros(width + 1, dtype=int)
        done = np.zeros(width + 1, dtype=bool)
        while True:
            done[at] = True
            here = owner[at]
            reduced = cost[here - 1] - row_price[here] - col_price[1:]
            closer = np.flatnonzero(~done[1:] & (reduced < slack[1:])) + 1
            slack[closer] = reduced[closer - 1]
            came_from[closer] = at
            after = int(np.argmin(np.where(done, np.inf, slack)))
            move = slack[after]
            row_price[owner[done]] += move
            col_price[done] -= move
            slack[~done] -= move
            at = after
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[came_from[at]]
            at = came_from[at]
    out = np.full(n, -1)
    taken = np.flatnonzero(owner[1:])
    out[owner[1:][taken] - 1] = taken
    return out


def match_gated(cost: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int]]:
    """Most allowed pairs, then least cost. Pairs nobody else wants are taken directly."""
    pairs = []
    by_row, by_col = allowed.sum(1), allowed.sum(0)
    rows, cols = np.nonzero(allowed)
    alone = (by_row[rows] == 1) & (by_col[cols] == 1)
    pairs += list(zip(rows[alone].tolist(), cols[alone].tolist()))
    left_rows = np.setdiff1d(np.flatnonzero(by_row), rows[alone])
    left_cols = np.setdiff1d(np.flatnonzero(by_col), cols[alone])
    if len(left_rows) and len(left_cols):
        sub = np.where(allowed, cost, FORBIDDEN)[np.ix_(left_rows, left_cols)]
        flip = sub.shape[0] > sub.shape[1]
        chosen = assign(sub.T if flip else sub)
        for i, j in enumerate(chosen):
            r, c = (j, i) if flip else (i, j)
            if sub[r, c] < FORBIDDEN:
                pairs.append((int(left_rows[r]), int(left_cols[c])))
    return pairs


def _assign_few(cost: list[list[float]]) -> list[int]:
    """``assign`` over plain numbers, in the same steps: quicker where there are only a few rows and columns."""
    n, width = len(cost), len(cost[0])
    row_price, col_price, owner = [0.0] * (n + 1), [0.0] * (width + 1), [0] * (width + 1)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        slack, came_from, done = [math.inf] * (width + 1), [0] * (width + 1), [False] * (width + 1)
        while True:
            done[at] = True
            here = owner[at]
            costs, price = cost[here - 1], row_price[here]
            after, move = 0, math.inf
            for c in range(1, width + 1):
                if not done[c]:
                    reduced = costs[c - 1] - price - col_price[c]
                    if reduced < slack[c]:
                        slack[c], came_from[c] = reduced, at
                    if slack[c] < move:
                        after, move = c, slack[c]
            for c in range(width + 1):
                if done[c]:
                    row_price[owner[c]] += move
                    col_price[c] -= move
                else:
                    slack[c] -= move
            at = after
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[came_from[at]]
            at = came_from[at]
    out = [-1] * n
    for c in range(1, width + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


def match_few(costs: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """``match_gated`` of the allowed pairs and their costs, by row and column: the same pairs in the same order."""
    by_row, by_col = Counter(r for r, _ in costs), Counter(c for _, c in costs)
    pairs = [(r, c) for r, c in costs if by_row[r] == 1 and by_col[c] == 1]
    if len(pairs) == len(costs):
        return pairs
    for r, c in pairs:
        del by_row[r], by_col[c]
    rows, cols = sorted(by_row), sorted(by_col)
    flip = len(rows) > len(cols)
    if flip:
        chosen = [(rows[i], cols[j]) for j, i in enumerate(_assign_few([[costs.get((r, c), FORBIDDEN) for r in rows] for c in cols]))]
    else:
        chosen = [(rows[i], cols[j]) for i, j in enumerate(_assign_few([[costs.get((r, c), FORBIDDEN) for c in cols] for r in rows]))]
    return pairs + [pair for pair in chosen if costs.get(pair, FORBIDDEN) < FORBIDDEN]


def match_sparse(edges: dict[int, list[tuple[int, float]]], unmatched: float) -> dict[int, int]:
    """Cheapest choice of at most one right per left and one left per right; a left without one costs ``unmatched``.

    Shortest augmenting paths over the edges that exist: memory follows the edges, and a search stops at the first free
    right or at the left that had better go without.
    """
    left_price = {s: 0.0 for s in edges}
    right_price: dict[int, float] = {}
    right_of: dict[int, int] = {}
    left_of: dict[int, int] = {}
    for start in edges:
        dist, came_from, done, heap = {}, {}, {}, []
        left, reached = start, 0.0
        quit_at, quit_left = np.inf, start
        while True:
            price = left_price[left]
            if reached + unmatched - price < quit_at:
                quit_at, quit_left = reached + unmatched - price, left
            for right, cost in edges[left]:
                if right not in done:
                    far = reached + cost - price - right_price.get(right, 0.0)
                    if far < dist.get(right, np.inf):
                        dist[right], came_from[right] = far, left
                        heappush(heap, (far, right))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= quit_at:
                total, free = quit_at, None
                break
            far, right = heappop(heap)
            if right not in left_of:
                total, free = far, right
                break
            done[right] = far
            left, reached = left_of[right], far
        left_price[start] += total
        for right, far in done.items():
            right_price[right] = right_price.get(right, 0.0) - (total - far)
            left_price[left_of[right]] += total - far
        if free is None:
            free = right_of.pop(quit_left, None)
        while free is not None:
            left = came_from[free]
            after = right_of.get(left)
            right_of[left], left_of[free] = free, left
            free = None if left == start else after
    return right_of


def place_lefts(edges: dict[int, list[tuple[int, int]]], todo: list[int], unmatched: int, left_price: dict[int, int],
                right_price: dict[int, int], right_of: dict[int, int], left_of: dict[int, int], own: set[int]) -> set[int]:
    """Place those of ``todo`` whose cheapest way stays among ``edges``' lefts and the rights in ``own``; tells which.

    Prices and partners are those of a matching under way and are changed in place. A search that would have to go through a
    right of others, or a right whose partner is not here, changes nothing. A left that better goes without is placed.
    """
    placed = set()
    for start in todo:
        dist, came_from, done, heap = {}, {}, {}, []
        left, reached = start, 0
        quit_at, quit_left = None, start
        free, total = None, None
        while True:
            price = left_price[left]
            if quit_at is None or reached + unmatched - price < quit_at:
                quit_at, quit_left = reached + unmatched - price, left
            for right, cost in edges[left]:
                if right not in done:
                    far = reached + cost - price - right_price.get(right, 0)
                    if right not in dist or far < dist[right]:
                        dist[right], came_from[right] = far, left
                        heappush(heap, (far, right))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= quit_at:
                total = quit_at
                break
            far, right = heappop(heap)
            if right not in own:
                break
            if right not in left_of:
                total, free = far, right
                break
            if left_of[right] not in edges:
                break
            done[right] = far
            left, reached = left_of[right], far
        if total is None:
            continue
        left_price[start] += total
        for right, far in done.items():
            right_price[right] = right_price.get(right, 0) - (total - far)
            left_price[left_of[right]] += total - far
        if free is None:
            free = right_of.pop(quit_left, None)
        while free is not None:
            left = came_from[free]
            after = right_of.get(left)
            right_of[left], left_of[free] = free, left
            free = None if left == start else after
        placed.add(start)
    return placed
