"""Cutting-stock column generation over a histogram of lengths.

Sequences are the stock, documents the orders. Lengths are counted in steps of a few tokens, so that
the linear program has one row per length class however many documents there are. A column is either a
pattern (a set of classes that fits one sequence) or a cut (a document of one class becomes two pieces).
New patterns come from a knapsack by dynamic programming with the dual prices as values, new cuts from
comparing the price of a class with the prices of its two parts.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

#: The program ends when no column helps by this much, when its sequences exceed the sum of all lengths by less than
#: this share, or when a hundred rounds have gained less than that. Any end leaves a plan that serves every document.
TOLERANCE = 2e-4
ROUNDS, PATIENCE = 6_000, 100


@dataclass(frozen=True)
class Run:
    """Documents `first` .. `first + count - 1` of a class each give the piece [start, start + size) (in steps)
    to the sequence `sequence + (rank - first)`, as its piece number `slot`."""
    origin: int
    first: int
    count: int
    start: int
    size: int
    sequence: int
    slot: int


def knapsack(prices: np.ndarray) -> tuple[float, dict[int, int]]:
    """The most valuable pattern: `prices[k]` is the value of class k + 1, the capacity is the last class."""
    room = len(prices)
    best, choice = np.zeros(room + 1), np.zeros(room + 1, dtype=int)
    for c in range(1, room + 1):
        values = best[c - 1::-1][:c] + prices[:c]  # class 1 leaves c - 1, class c leaves nothing
        k = int(values.argmax())
        best[c], choice[c] = max((values[k], k + 1), (best[c - 1], 0))
    pattern: dict[int, int] = {}
    c = room
    while c > 0:
        k = int(choice[c])
        if k:
            pattern[k] = pattern.get(k, 0) + 1
        c -= k or 1
    return float(best[room]), pattern


def best_cut(prices: np.ndarray) -> tuple[float, int, int]:
    """The class whose price exceeds the prices of two parts by most, and the smaller part."""
    gain, whole, part = -np.inf, 0, 0
    for k in range(2, len(prices) + 1):
        half = k // 2
        value = prices[k - 1] - (prices[:half] + prices[k - 2:k - 2 - half:-1] if half < k - 1 else prices[:half] + prices[:half][::-1])
        a = int(value.argmax())
        if value[a] > gain:
            gain, whole, part = float(value[a]), k, a + 1
    return gain, whole, part


def solve(demand: np.ndarray, cut_cost: float) -> list[tuple[str, dict[int, int], float]]:
    """Columns of an optimal basis with their values: ('pattern', {class: copies}, x) and ('cut', {whole: 1, ...}, y).

    Revised simplex with an explicit inverse. The start is one pattern per class that repeats the class.
    """
    room = len(demand)
    scale = max(float(demand.sum()), 1.0)
    need = demand / scale + 1e-9 * (1 + np.arange(room))  # the offset keeps the basis from being degenerate
    kinds: list[tuple[str, dict[int, int]]] = [("pattern", {k: room // k}) for k in range(1, room + 1)]
    inverse = np.diag([1.0 / (room // k) for k in range(1, room + 1)])
    matrix = np.diag([float(room // k) for k in range(1, room + 1)])
    cost = np.ones(room)
    value = inverse @ need
    bound, before = float(need @ np.arange(1, room + 1)) / room, np.inf
    for step in range(ROUNDS):
        now = float(cost @ value)
        if now <= bound * (1 + TOLERANCE):
            break
        if step % PATIENCE == 0:
            if now > before * (1 - TOLERANCE):
                break
            before = now
        prices = cost @ inverse
        worth, pattern = knapsack(prices)
        gain, whole, part = best_cut(prices)
        column = np.zeros(room)
        surplus = int(prices.argmin())
        options = [(worth - 1.0, "pattern"), (gain - cut_cost, "cut"), (-float(prices[surplus]), "surplus")]
        best, kind = max(options)
        if best <= TOLERANCE * (1.0 if kind == "pattern" else 0.1):
            break
        if kind == "pattern":
            price, entry = 1.0, pattern
            for k, n in pattern.items():
                column[k - 1] = n
        elif kind == "cut":
            price, entry = cut_cost, {0: whole, 1: part, 2: whole - part}
            column[whole - 1] += 1
            column[part - 1] -= 1
            column[whole - part - 1] -= 1
        else:
            price, entry = 0.0, {}
            column[surplus] = -1
        direction = inverse @ column
        ratios = np.full(room, np.inf)
        np.divide(value, direction, out=ratios, where=direction > 1e-9)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        move = ratios[leave]
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        value = np.maximum(value - move * direction, 0.0)
        value[leave] = move
        kinds[leave], cost[leave] = (kind, entry), price
        matrix[:, leave] = column
        if step % PATIENCE == PATIENCE - 1:  # one Newton step, so that rounding errors of the updates do not add up
            error = np.eye(room) - np.einsum("ij,jk->ik", matrix, inverse)
            inverse += np.einsum("ij,jk->ik", inverse, error)
            value = np.maximum(inverse @ need, 0.0)
    return [(kind, entry, float(x) * scale) for (kind, entry), x in zip(kinds, value) if kind != "surplus"]


def plan(demand: np.ndarray, cut_cost: float = 0.002) -> tuple[list[Run], int]:
    """Runs that give every document of every class a place, and the number of sequences.

    Columns are rounded down; what then remains (bounded by classes, not by documents) is laid end to end and
    cut where a sequence is full. Classes are served from the longest to the shortest, because a cut only
    makes shorter pieces.
    """
    room = len(demand)
    columns = solve(demand, cut_cost) if demand.sum() else []
    supply: list[deque[tuple[int, int, int, int]]] = [deque() for _ in range(room + 1)]  # origin, first, count, start
    for k in range(1, room + 1):
        if demand[k - 1]:
            supply[k].append((k, 0, int(demand[k - 1]), 0))

    def take(k: int, count: int):
        while count > 0 and supply[k]:
            origin, first, have, start = supply[k].popleft()
            used = min(have, count)
            if used < have:
                supply[k].appendleft((origin, first + used, have - used, start))
            count -= used
            yield origin, first, used, start

    cuts = sorted((e[0], e[1], e[2], int(x + 1e-6)) for kind, e, x in columns if kind == "cut")
    for whole, a, b, count in reversed(cuts):
        for origin, first, used, start in list(take(whole, count)):
            supply[a].append((origin, first, used, start))
            supply[b].append((origin, first, used, start + a))

    runs, sequences = [], 0
    patterns = sorted(((int(x + 1e-6), sorted(e.items(), reverse=True)) for kind, e, x in columns if kind == "pattern"), reverse=True)
    for count, pattern in patterns:
        count = min([count, *(sum(s[2] for s in supply[k]) // copies for k, copies in pattern)])  # no sequence with an empty place
        slot = 0
        for k, copies in pattern if count else []:
            for _ in range(copies):
                at = sequences
                for origin, first, used, start in take(k, count):
                    runs.append(Run(origin, first, used, start, k, at, slot))
                    at += used
                slot += 1
        sequences += count
    filled, slot = 0, 0
    for k in range(room, 0, -1):
        for origin, first, count, start in supply[k]:
            for rank in range(first, first + count):
                at = 0
                while at < k:
                    piece = min(k - at, room - filled)
                    runs.append(Run(origin, rank, 1, start + at, piece, sequences, slot))
                    at, filled, slot = at + piece, filled + piece, slot + 1
                    if filled == room:
                        sequences, filled, slot = sequences + 1, 0, 0
    return runs, sequences + (filled > 0)
