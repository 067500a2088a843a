"""Split search on the statistics of one node, which hold bins x classes numbers for each feature."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.impurity import entropy_value, weight_value
from ..functions.indexing import subset_positions

INVALID = -1.7976931348623157e308


@dataclass(frozen=True)
class Candidate:
    gain: float
    feature: int
    bins: tuple  # that go left, or all bins of a multi-way split
    masses: tuple
    counts: tuple
    impurities: tuple

    def __str__(self) -> str:
        parts = "; ".join(f"{[round(float(x), 6) for x in m]} (entropy {h:.6g})" for m, h in zip(self.masses, self.impurities))
        return f"feature {self.feature}, bins {sorted(self.bins)}, gain {self.gain:.6g}: {parts}"


def gain_of(parts: list, impurity: float, min_gain: float) -> tuple[float, tuple]:
    """Information gain of a split into parts (class masses); INVALID below min_gain or if all parts weigh nothing."""
    entropies = tuple(entropy_value(p) for p in parts)
    weights = [weight_value(float(sum(p))) for p in parts]
    if not sum(weights):
        return INVALID, entropies
    gain = impurity - sum(h * n for h, n in zip(entropies, weights)) / sum(weights)
    return (gain if gain >= min_gain else INVALID), entropies


def best(found: list[Candidate]) -> Candidate | None:
    """Largest gain (to 12 places), then first."""
    top = None
    for c in found:
        if c.gain != INVALID and (top is None or round(c.gain, 12) > round(top.gain, 12)):
            top = c
    return top


def centroid_order(u: np.ndarray, num_classes: int) -> list[int]:
    """Bins in order of entropy (many classes) or majority class (two); bins of no weight last; ties by bin."""
    def centroid(m):
        if weight_value(float(m.sum())) == 0:
            return float("inf")
        return round(entropy_value(m), 12) if num_classes > 2 else float(np.argmax(m))

    return sorted(range(len(u)), key=lambda b: (centroid(u[b]), b))


def binary_candidates(u: list, f: list, meta, history: dict, impurity: float) -> list[Candidate]:
    """All splits in two. u and f: for each feature an array bins x classes."""
    found = []
    for k in range(meta.num_features):
        own, bins = history.get(k), meta.bins(k)
        total_u, total_f = u[k].sum(0), f[k].sum(0)
        if meta.continuous(k):
            low, high = (0, bins - 1) if own is None else (min(own), max(own))
            options = [tuple(range(low, s + 1)) for s in range(low, high)]
        elif k in meta.unordered:
            subsets = [tuple(subset_positions(code, bins)) for code in range(1, meta.num_splits(k) + 1)]
            options = [s for s in subsets if own is None or (set(s) < set(own))]
        else:
            order = centroid_order(u[k], meta.params.num_classes)
            options = [tuple(order[: s + 1]) for s in range(bins - 1) if own is None or (order[s] in own and len(own) != 1)]
        for left in options:
            lu, lf = u[k][list(left)].sum(0), f[k][list(left)].sum(0)
            ru, rf = total_u - lu, total_f - lf
            gain, entropies = gain_of([lu, ru], impurity, meta.params.min_info_gain)
            found.append(Candidate(gain, k, left, (lu, ru), (lf, rf), entropies))
    return found


def multi_candidates(u: list, f: list, meta, used: set, impurity: float) -> list[Candidate]:
    """A split by each feature not used yet."""
    found = []
    for k in range(meta.num_features):
        if k not in used:
            gain, entropies = gain_of(list(u[k]), impurity, meta.params.min_info_gain)
            found.append(Candidate(gain, k, tuple(range(meta.bins(k))), tuple(u[k]), tuple(f[k]), entropies))
    return found


def best_binary(*about) -> Candidate | None:
    return best(binary_candidates(*about))


def best_multi(*about) -> Candidate | None:
    return best(multi_candidates(*about))
