"""Cutting stock by column generation over a length histogram; its size does not depend on the corpus.

The master program chooses how often to use each pattern (how many pieces of each length share one
sequence); its duals price lengths, and an unbounded knapsack, solved by dynamic programming over the
capacity, finds the pattern that pays most.  It ends when no pattern pays or the bound is close enough.
"""

from __future__ import annotations

import numpy as np


def price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest total dual within the capacity, and that total."""
    use = np.flatnonzero(duals > 1e-12)
    use = use[np.argsort(sizes[use])]
    s, d = sizes[use], duals[use]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if n := fits[w]:
            gain = best[w - s[:n]] + d[:n]
            i = int(gain.argmax())
            if gain[i] > best[w]:
                best[w], pick[w] = gain[i], i
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[use[pick[w]]] += 1
            w -= s[pick[w]]
    return float(best[capacity]), pattern


def relax(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often to use them, fractional: within ``gap`` of the least number of
    sequences. All ``counts`` must be positive."""
    m = len(sizes)
    each = capacity // sizes
    patterns, inverse, x = np.diag(each.astype(float)), np.diag(1.0 / each), counts / each
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, new = price(sizes, duals, capacity)
        if value <= 1 + 1e-9 or duals @ counts / value >= (1 - gap) * x.sum():
            break
        d = inverse @ new
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * d, 0)
        x[r] = ratio[r]
        patterns[:, r] = new
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
    assert patterns.shape == (m, m)
    return patterns, x


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sequences of single pieces (indexes of ``sizes``), longest first into the fullest that has room."""
    room: dict[int, list[int]] = {}
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left = min((r for r, held in room.items() if held and r >= sizes[i]), default=None)
        if left is None:
            out.append([])
            b, left = len(out) - 1, capacity
        else:
            b = room[left].pop()
        out[b].append(i)
        room.setdefault(left - sizes[i], []).append(b)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Whole sequences for all pieces of the histogram (length to count), as rows (length, first rank, rank
    after the last, first sequence, pieces of that length in a sequence, first slot): the pieces of a length,
    in the order of their ranks, fill the rows' sequences one after another."""
    items = sorted((s, n) for s, n in histogram.items() if n > 0 and s < capacity)
    rows, sequence = [], 0
    if full := histogram.get(capacity, 0):
        rows.append((capacity, 0, full, 0, 1, 0))
        sequence = full
    if not items:
        return rows
    sizes, counts = np.array([s for s, _ in items]), np.array([n for _, n in items])
    patterns, x = relax(sizes, counts.astype(float), capacity)
    used = np.zeros(len(sizes), np.int64)

    def place(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal sequence
        slot = 0
        for c, each in pattern:
            rows.append((int(sizes[c]), int(used[c]), int(used[c] + each * times), sequence, each, slot))
            used[c] += each * times
            slot += each
        sequence += times

    for p in np.argsort(-x):
        pattern = [(int(c), int(patterns[c, p])) for c in np.flatnonzero(patterns[:, p])]
        # Rounded down; what is left over is at most a sequence or so a pattern.
        times = min([int(x[p] + 1e-9), *(int((counts[c] - used[c]) // each) for c, each in pattern)])
        if times > 0:
            place(pattern, times)
    rest = [c for c in range(len(sizes)) for _ in range(counts[c] - used[c])]
    for held in first_fit([int(sizes[c]) for c in rest], capacity):
        cs = [rest[i] for i in held]
        place([(c, cs.count(c)) for c in sorted(set(cs))], 1)
    return rows
