"""Cutting-stock planning over a length histogram, by column generation.

A histogram has a bounded number of classes whatever the size of the corpus, so the plan is made on the
driver from a few hundred counts: a linear program over patterns (multisets of classes that fit a
sequence) and cuts (a class taken apart at a grid position, at a small price). A knapsack dynamic program
prices patterns against the current duals and the best cut is priced directly; a revised simplex step
brings the better column in. The fractional plan is rounded down and what is left is filled greedily,
largest first, cutting where nothing fits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Run:
    """Items ``first .. first+count-1`` of an original class, or the same part of each: [start, start+size) in units."""

    origin: int
    first: int
    count: int
    start: int
    size: int


@dataclass
class Placed:
    """A run that fills sequences: item i goes to sequence ``sequence + (index+i) % times``, slot ``slot + (index+i) // times``."""

    run: Run
    sequence: int
    times: int
    index: int
    slot: int


def price_pattern(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern worth most: an unbounded knapsack over the capacity. ``duals[k-1]`` is the worth of class k."""
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        m = min(c, len(duals))
        options = duals[:m] + worth[c - m : c][::-1]
        k = int(options.argmax())
        worth[c], last[c] = options[k], k + 1
        if worth[c - 1] >= worth[c]:
            worth[c], last[c] = worth[c - 1], 0
    pattern, c = np.zeros(len(duals)), capacity
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(worth[capacity]), pattern


def solve(counts: np.ndarray, capacity: int, grid: int, cut_price: float = 0.004, gap: float = 5e-4, most_steps: int = 4000) -> tuple[list[tuple[np.ndarray, float]], list[tuple[int, int, float]]]:
    """(pattern, times) and (class, cut position, times) of the linear program's solution.

    ``counts[k-1]`` items of class k have to be placed in sequences of ``capacity`` units; a class may be cut
    at multiples of ``grid`` units. Stops at ``gap`` from the bound that the duals prove.
    """
    n = len(counts)
    columns = [np.zeros(n) for _ in range(n)]
    for k in range(n):
        columns[k][k] = capacity // (k + 1)
    kinds: list[tuple[int, int] | None] = [None] * n
    inverse = np.diag([1.0 / (capacity // (k + 1)) for k in range(n)])
    # a tiny, fixed perturbation keeps steps from cycling
    amount = inverse @ (counts + 1e-6 * (1 + np.arange(n) / n))
    cost = np.ones(n)
    sizes, cuts = np.arange(1, n + 1), np.arange(grid, n, grid)
    can = cuts[None, :] < sizes[:, None]
    for _ in range(most_steps):
        duals = np.maximum(cost @ inverse, -1.0)
        worth, pattern = price_pattern(np.maximum(duals, 0), capacity)
        if len(cuts):
            saving = np.where(can, duals[:, None] - duals[cuts - 1][None, :] - duals[np.clip(sizes[:, None] - cuts[None, :] - 1, 0, n - 1)], -np.inf) - cut_price
            k, c = np.unravel_index(int(saving.argmax()), saving.shape)
            best_cut = float(saving[k, c])
        else:
            best_cut = -np.inf
        if worth <= 1 + gap and best_cut <= gap:
            break
        if worth - 1 >= best_cut:
            column, kind, price = pattern, None, 1.0
        else:
            column, kind, price = np.zeros(n), (int(k) + 1, int(cuts[c])), cut_price
            column[k] += 1
            column[cuts[c] - 1] -= 1
            column[k - cuts[c]] -= 1
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out], kinds[out], cost[out] = column, kind, price
    patterns = [(columns[i], float(amount[i])) for i in range(n) if kinds[i] is None]
    return patterns, [(*kinds[i], float(amount[i])) for i in range(n) if kinds[i] is not None]


class Pool:
    """Items waiting to be placed, as runs by class."""

    def __init__(self, counts: np.ndarray) -> None:
        self.runs: dict[int, list[Run]] = {k + 1: [Run(k + 1, 0, int(c), 0, k + 1)] for k, c in enumerate(counts) if c}
        self.left = {k: sum(r.count for r in x) for k, x in self.runs.items()}

    def add(self, run: Run) -> None:
        self.runs.setdefault(run.size, []).append(run)
        self.left[run.size] = self.left.get(run.size, 0) + run.count

    def take(self, size: int, count: int) -> list[Run]:
        if count <= 0:
            return []
        self.left[size] -= count
        out, runs = [], self.runs[size]
        while count:
            run = runs[-1]
            n = min(count, run.count)
            out.append(Run(run.origin, run.first + run.count - n, n, run.start, size))
            run.count -= n
            count -= n
            if not run.count:
                runs.pop()
        return out

    def cut(self, size: int, at: int, count: int) -> None:
        for run in self.take(size, count):
            self.add(Run(run.origin, run.first, run.count, run.start, at))
            self.add(Run(run.origin, run.first, run.count, run.start + at, size - at))


def plan(counts: np.ndarray, capacity: int, grid: int, most_steps: int = 4000) -> tuple[list[Placed], int]:
    """Where every item goes, as a bounded number of runs, and the number of sequences. Cuts lie at multiples of ``grid``; with one of the capacity nothing is cut."""
    counts = np.asarray(counts)
    pool, placed, sequence = Pool(counts), [], 0
    if not counts.any():
        return placed, 0

    def place(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        slot = 0
        for size, each in sorted(pattern.items(), reverse=True):
            index = 0
            for run in pool.take(size, each * times):
                placed.append(Placed(run, sequence, times, index, slot))
                index += run.count
            slot += each
        sequence += times

    patterns, cuts = solve(counts, capacity, grid, most_steps=most_steps)
    for size, at, times in sorted(cuts, reverse=True):
        pool.cut(size, at, min(int(times + 1e-6), pool.left.get(size, 0)))
    for pattern, times in sorted(patterns, key=lambda x: -x[1]):
        sizes = {k + 1: int(a) for k, a in enumerate(pattern) if a}
        n = min([int(times + 1e-3), *(pool.left.get(k, 0) // a for k, a in sizes.items())])
        if n > 0 and sum(k * a for k, a in sizes.items()) >= 0.98 * capacity:
            place(sizes, n)
    while sizes := sorted((k for k, n in pool.left.items() if n), reverse=True):
        room, pattern, cut = capacity, {}, None
        for k in sizes:
            n = min(room // k, pool.left[k])
            if n:
                pattern[k] = n
                room -= n * k
        if room >= grid and (larger := [k for k in sizes if pool.left[k] > pattern.get(k, 0) and k > room]):
            cut = (larger[-1], room // grid * grid)
        times = min(pool.left[k] // a for k, a in pattern.items()) if pattern else pool.left[cut[0]]
        if cut:
            size, at = cut
            times = min(times, (pool.left[size] - pattern.get(size, 0) * times) or 1)
            while times > 1 and pool.left[size] < (pattern.get(size, 0) + 1) * times:
                times -= 1
            pool.cut(size, at, times)
            pattern[at] = pattern.get(at, 0) + 1
        place(pattern, times)
    return placed, sequence
