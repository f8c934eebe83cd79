"""Plain restatements of operators, for tables small enough to hold in memory."""

from __future__ import annotations

import math

import numpy as np


def excursion(k: int, hi: list, lo: list, ref: list) -> float:
    """How far bar k lies, on one side, from the closes of a bar before and a bar after, at most five bars apart; the best pair counts."""
    best = -math.inf
    for b in range(max(0, k - 4), k):
        for a in range(k + 1, min(len(ref), b + 6)):
            if None not in (ref[b], ref[a], hi[k]):
                best = max(best, min(hi[k] - ref[b], hi[k] - ref[a]), min(ref[b] - lo[k], ref[a] - lo[k]))
    return best


def cutoff(z: list[float], risk: float, tail: float) -> float | None:
    """Peaks over threshold from quantile spacings; quantiles from classes of a 64th in logarithms."""
    classes: dict[int, int] = {}
    for v in z:
        if v > 0:
            c = math.floor(math.log(v) * 64)
            classes[c] = classes.get(c, 0) + 1
    total = sum(classes.values())
    q = {}
    for k in (1, 2, 4):
        above, want = 0, total * k * tail
        for c in sorted(classes, reverse=True):
            above += classes[c]
            if above >= want:
                q[k] = math.exp((c + (above - want) / classes[c]) / 64)
                break
    if len(q) < 3:
        return None
    ratio = (q[1] - q[2]) / (q[2] - q[4]) if q[2] != q[4] else 0.0
    shape = max(-0.5, min(0.5, math.log2(ratio))) if ratio > 0 else 1e-6
    shape = shape if abs(shape) >= 1e-6 else 1e-6
    sigma = (q[2] - q[4]) * shape / (2**shape - 1)
    return max(q[1], q[4] + sigma / shape * ((4 * tail / risk) ** shape - 1))


def flagged_bars(rows: list[tuple], risk: float | None = 3e-3, tail: float = 0.04) -> set:
    """Ids of implausible bars. rows: (bar_id, symbol, at, open, high, low, close), None for nulls. Without a risk there is no tail fit, only the rule."""
    rows = sorted(set(rows), key=lambda r: (str(r[1]), str(r[2]), r[0]))
    cases, by = set(), {}
    bad = {}
    for r in rows:
        prices = [p for p in r[3:7] if p is not None and p == p]
        high, low = r[4], r[5]
        wrong = any(p <= 0 for p in prices)
        if high is not None and any(p > high for p in prices) or low is not None and any(p < low for p in prices):
            wrong = True
        bad[r] = wrong
        if wrong:
            cases.add(r[0])
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[1], []).append(r)
    for own in by.values():
        n = len(own)
        lc = [math.log(r[6]) if r[6] is not None and r[6] > 0 else None for r in own]
        move = [abs(lc[i] - lc[i - 1]) if i and lc[i] is not None and lc[i - 1] is not None else None for i in range(n)]
        moves = [m for m in move if m]
        repeat = [i > 0 and own[i][6] is not None and own[i][6] == own[i - 1][6] for i in range(n)]
        if sum(repeat) / n < 0.1:
            i = 0
            while i < n:
                j = i
                while j < n and repeat[j]:
                    j += 1
                if j - i >= 6:
                    cases |= {own[k][0] for k in range(i, j)}
                i = max(j, i + 1)
        if not moves:
            continue
        usual = float(np.median(moves))
        hi, lo = [], []
        for r in own:
            prices = [p for p in r[3:7] if p is not None]
            usable = prices and min(prices) > 0
            hi.append(math.log(max(prices)) if usable else None)
            lo.append(math.log(min(prices)) if usable else None)
        ref = [None if bad[r] else c for r, c in zip(own, lc)]
        level = [20 * usual] * n
        if risk is not None:
            hours = [r[2].hour for r in own]
            by_hour = {h: [min(m, 4 * usual) for m, g in zip(move, hours) if g == h and m is not None] for h in set(hours)}
            scale = {h: sum(v) / len(v) if v else None for h, v in by_hour.items()}
            z = [excursion(k, hi, lo, ref) / scale[hours[k]] for k in range(n) if scale[hours[k]]]
            cut = cutoff(z, risk, tail) or 0.0
            level = [max(v, cut * (scale[g] or 0.0)) for v, g in zip(level, hours)]
        while True:  # the most extreme bar beyond its level is settled first, then all are measured again
            size, k = max(((excursion(k, hi, lo, ref), -k) for k in range(n) if excursion(k, hi, lo, ref) > level[k]), default=(None, None))
            if size is None:
                break
            cases.add(own[-k][0])
            ref[-k] = None
            hi[-k] = None
    return cases

