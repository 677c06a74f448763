"""SetSketch registers of shingle sets.

Every element throws a Poisson process of points over the registers; a register
keeps its smallest point, truncated to a power of the base: K = floor(1 - log_b x).
Registers of a union are the register-wise maxima (mergeable), and the share of
equal registers grows with the Jaccard similarity (locality-sensitive).  Points
beyond a bound that all registers reach with high probability are never made, so
a set of n elements costs about n + REGISTERS * log(REGISTERS) points; the rare
sets that leave a register empty are done again with a larger bound.
"""

from __future__ import annotations

import numpy as np

#: Registers (BANDS of ROWS), base and rate of the process. With ROWS = 5 and 40 bands a pair at
#: similarity 0.8 shares no band once in some 8 million cases (0.672 ** 40), and truncation only lowers that.
BANDS, ROWS = 40, 5
REGISTERS, BASE, RATE = BANDS * ROWS, 1.02, 20.0
G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minima(elements: np.ndarray, owner: np.ndarray, sizes: np.ndarray, slack: float = 4.0) -> np.ndarray:
    """Smallest points, one row of REGISTERS per owner (0..len(sizes)-1)."""
    m = REGISTERS
    out = np.full(len(sizes) * m, np.inf)
    bound = (np.log(m) + slack) / (np.maximum(sizes, 1) * RATE)
    with np.errstate(over="ignore"):
        state, at, who = mix(elements + G), np.zeros(len(elements)), owner
        while len(state):
            state = state + G
            u = mix(state)
            # 40 bits make the gap, the other 24 the register.
            at = at - np.log(((u >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / (m * RATE)
            keep = at < bound[who]
            state, at, who, u = state[keep], at[keep], who[keep], u[keep]
            register = ((u & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(out, who * m + register, at)
    out = out.reshape(len(sizes), m)
    empty = np.flatnonzero(np.isinf(out).any(1) & (sizes > 0))
    if len(empty):
        pick = np.isin(owner, empty)
        again = np.searchsorted(empty, owner[pick])
        out[empty] = minima(elements[pick], again, sizes[empty], slack + 6)
    return out


def registers(elements: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Truncated registers as 16-bit integers; an empty set has zeros."""
    x = minima(elements, owner, sizes)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(x) / np.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0), 0, 32767).astype(np.int16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band, of the band's number and register values."""
    with np.errstate(over="ignore"):
        v = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * G, (len(regs), BANDS))
        for r in range(ROWS):
            key = mix(key + v[:, :, r] + np.uint64(1))
    return key.astype(np.int64)


def log_likelihood(j: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Of similarity j, given sizes and the numbers of registers where u's is larger (up) or smaller (down)."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    a, b = p(u - v * j), p(v - u * j)
    return up * np.log(a) + down * np.log(b) + (REGISTERS - up - down) * np.log(np.clip(1 - a - b, 1e-12, 1))


def may_reach(threshold: float, n_u: np.ndarray, n_v: np.ndarray, regs_u: np.ndarray, regs_v: np.ndarray, odds: float = 14.0) -> np.ndarray:
    """False where the joint likelihood of some lower similarity beats the threshold's by e**odds: such a pair is below it."""
    up, down = (regs_u > regs_v).sum(1), (regs_u < regs_v).sum(1)
    most = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    at = log_likelihood(np.minimum(threshold, most), n_u, n_v, up, down)
    best = np.full(len(n_u), -np.inf)
    for j in np.linspace(0.02, threshold, 40):
        best = np.maximum(best, log_likelihood(np.minimum(j, most), n_u, n_v, up, down))
    return (most >= threshold * (1 - 1e-12)) & (best - at < odds)
