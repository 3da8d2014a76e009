"""Incremental eigendecomposition of scatter matrices: rank-one updates in numpy.

A lane is a scatter matrix kept as eigenvalues d and orthonormal vectors u, so that the
scatter is u diag(d) u'.  Adding rho * v v' changes it to u (diag(d) + rho z z') u' with
z = u'v.  The new eigenvalues are the roots of the secular equation
1 + rho * sum_j z_j^2 / (d_j - x) = 0, one between any two neighbouring d_j; entries that
have (almost) no part in z, or whose eigenvalues (almost) coincide, are deflated first.
Several lanes are updated side by side, each array's first axis being the lane.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
ROUNDS = 60


def _take(a: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(a, order, axis=1)


def _turned(u: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(u, order[:, None, :], axis=2)


def _rotate_equal(d: np.ndarray, z: np.ndarray, u: np.ndarray, active: np.ndarray, tol: np.ndarray) -> None:
    """Givens rotations, in place, that clear z_i wherever d_i and d_(i+1) coincide."""
    for i in range(d.shape[1] - 1):
        r = np.hypot(z[:, i], z[:, i + 1])
        safe = np.where(r > 0, r, 1.0)
        s, c = z[:, i] / safe, z[:, i + 1] / safe
        close = active[:, i] & active[:, i + 1] & (np.abs((d[:, i + 1] - d[:, i]) * c * s) <= tol)
        if not close.any():
            continue
        k = np.flatnonzero(close)
        c, s, r = c[k], s[k], r[k]
        lo, hi = d[k, i].copy(), d[k, i + 1].copy()
        d[k, i], d[k, i + 1] = c * c * lo + s * s * hi, s * s * lo + c * c * hi
        z[k, i], z[k, i + 1] = 0.0, r
        active[k, i] = False
        a, b = u[k, :, i].copy(), u[k, :, i + 1].copy()
        u[k, :, i], u[k, :, i + 1] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b


def secular_roots(d: np.ndarray, zz: np.ndarray, rho: np.ndarray, upper: np.ndarray, active: np.ndarray):
    """(near pole of every root, distance from it) for ascending d; `upper` bounds each root.

    The root of an active entry lies between its own d and `upper`.  It is sought from the
    nearer of the two poles by a two-pole interpolation that falls back to bisection, so
    that its distance from that pole has full relative accuracy.  Entries that are not
    active have no weight and come last, at the last pole.  Roots found leave the arrays."""
    n = d.shape[1]
    lane, at = np.nonzero(active)
    count = active.sum(axis=1)
    poles, weight = d, rho[:, None] * zz
    if (count < n).any():  # places of idle entries: any number that is no root
        top = np.abs(np.where(active, upper, 0.0)).max(axis=1, keepdims=True)
        poles = np.where(active, d, 3 * top + 1)
    own, width = d[lane, at], (upper - d)[lane, at]
    last = at == count[lane] - 1
    p, w = poles[lane], weight[lane]
    gap = p - own[:, None]
    gap -= (width / 2)[:, None]
    gap[gap == 0] = np.finfo(np.float64).tiny
    at_middle = 1.0 + np.einsum("ij,ij->i", w, 1.0 / gap)
    left = (at_middle >= 0) | last  # f rises from -inf to inf; beyond the last pole there is none
    origin = np.where(left, own, upper[lane, at])
    d1, d2 = np.where(left, 0.0, -width), np.where(left, width, 0.0)
    lo = np.where(left, np.where(last & (at_middle < 0), width / 2, 0.0), -width / 2)
    hi = np.where(left, np.where(last & (at_middle < 0), width, width / 2), 0.0)
    tau = (lo + hi) / 2
    p = p - origin[:, None]
    before = (np.arange(n)[None, :] <= at[:, None]).astype(np.float64)
    found = tau.copy()
    live = np.arange(len(tau))
    for _ in range(ROUNDS):
        inv = p - tau[:, None]
        with np.errstate(divide="ignore"):
            np.divide(1.0, inv, out=inv)
        term = w * inv
        f = 1.0 + term.sum(axis=1)
        below = np.einsum("ij,ij->i", term, before)
        flat = np.abs(f) <= 16 * EPS * (f - 2 * below)  # the size of the sum's terms, all below negative
        term *= inv
        total = term.sum(axis=1)
        psi = np.einsum("ij,ij->i", term, before)
        rising = f >= 0
        lo, hi = np.where(rising, lo, tau), np.where(rising, tau, hi)
        # f is taken as c + a / (own pole - x) + b / (next pole - x), exact in value and slope
        # of the terms on either side.
        e1, e2 = d1 - tau, d2 - tau
        c = f - e1 * psi - e2 * (total - psi)
        a = (e1 + e2) * f - e1 * e2 * total
        b = e1 * e2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            new = tau + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where(flat, tau, np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2))
        near = flat | (np.abs(new - tau) <= 8 * EPS * np.abs(new)) | (hi - lo <= 4 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        tau = new
        found[live] = tau
        if 2 * near.sum() >= len(near):  # else the copies cost more than they save
            go = ~near
            if not go.any():
                break
            live, tau, lo, hi, p, w, before, d1, d2 = (x[go] for x in (live, tau, lo, hi, p, w, before, d1, d2))
    origins, taus = np.zeros_like(d), np.zeros_like(d)
    origins[lane, at], taus[lane, at] = origin, found
    return origins, taus


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of u diag(d) u' + rho v v' for every lane; rho >= 0."""
    lanes, n = d.shape
    z = (v[:, None, :] @ u)[:, 0, :]
    scale = np.sqrt((z * z).sum(axis=1))
    rho = rho * scale * scale
    z = z / np.where(scale > 0, scale, 1.0)[:, None]
    tol = 8 * EPS * np.maximum(np.abs(d).max(axis=1), rho)
    active = (rho[:, None] * np.abs(z) > tol[:, None]) & (rho > 0)[:, None]
    if not active.any():
        return d, u
    d, z, u, active = _active_first(d, z, u, active)
    with np.errstate(invalid="ignore", divide="ignore"):
        t = np.abs(np.diff(d) * z[:, 1:] * z[:, :-1]) / (z[:, 1:] ** 2 + z[:, :-1] ** 2)
    if (active[:, 1:] & active[:, :-1] & ~(t > tol[:, None])).any():
        _rotate_equal(d, z, u, active, tol)
        d, z, u, active = _active_first(d, z, u, active)
    zz = np.where(active, z * z, 0.0)
    following = np.zeros_like(active)
    following[:, :-1] = active[:, 1:]
    top = d + (rho * zz.sum(axis=1))[:, None]
    upper = np.where(following, np.concatenate([d[:, 1:], d[:, -1:]], axis=1), top)
    origin, tau = secular_roots(d, zz, rho, upper, active)
    values = np.where(active, origin + tau, d)
    # gap[i, j] = root_j - d_i, from the root's distance to its pole.
    gap = origin[:, None, :] - d[:, :, None]
    gap += tau[:, None, :]
    apart = d[:, None, :] - d[:, :, None]
    diagonal = np.arange(n)
    apart[:, diagonal, diagonal] = 1.0
    idle = ~active
    if idle.any():
        both = active[:, :, None] & active[:, None, :]
        gap, apart = np.where(both, gap, 1.0), np.where(both, apart, 1.0)
    gap[gap == 0] = np.finfo(np.float64).tiny
    # The z for which these roots are exact makes the vectors orthogonal.
    np.divide(gap, apart, out=apart)
    zhat = np.where(active, np.copysign(np.sqrt(np.abs(np.prod(apart, axis=2))), z), 0.0)
    w = np.divide(zhat[:, :, None], gap, out=gap)
    if idle.any():
        w = np.where(both, w, 0.0)
    norm = np.sqrt(np.einsum("lij,lij->lj", w, w))
    w /= np.where(norm > 0, norm, 1.0)[:, None, :]
    if idle.any():
        w[:, diagonal, diagonal] = np.where(idle, 1.0, w[:, diagonal, diagonal])
        order = np.argsort(values, axis=1, kind="stable")
        values, w = _take(values, order), _turned(w, order)
    return values, u @ w


def _active_first(d: np.ndarray, z: np.ndarray, u: np.ndarray, active: np.ndarray):
    """All four with the active entries first, by ascending d."""
    if active.all() and (d[:, 1:] >= d[:, :-1]).all():
        return d, z, u, active
    order = np.argsort(np.where(active, d, np.inf), axis=1, kind="stable")
    return _take(d, order), _take(z, order), _turned(u, order), _take(active, order)


class Spectra:
    """Lanes of (count, mean, eigenvalues, vectors) of centred scatter matrices."""

    def __init__(self, lanes: int, dim: int) -> None:
        self.n = np.zeros(lanes)
        self.mean = np.zeros((lanes, dim))
        self.d = np.zeros((lanes, dim))
        self.u = np.broadcast_to(np.eye(dim), (lanes, dim, dim)).copy()

    @classmethod
    def of(cls, n, mean, d, u) -> Spectra:
        out = cls(0, mean.shape[1])
        out.n, out.mean, out.d, out.u = n, mean, d, u
        return out

    def add(self, rows: np.ndarray) -> None:
        """One row for each of the first len(rows) lanes: a centred rank-one update."""
        k = len(rows)
        apart = rows - self.mean[:k]
        rho = self.n[:k] / (self.n[:k] + 1)
        self.d[:k], self.u[:k] = rank_one(self.d[:k], self.u[:k], apart, rho)
        self.n[:k] += 1
        self.mean[:k] += apart / self.n[:k, None]

    def merged(self) -> Spectra:
        """One lane for every two: the second's spectrum goes into the first by successive
        rank-one updates, and so does the distance of the means."""
        k = len(self.n) // 2
        a, b = slice(0, k), slice(k, 2 * k)
        d, u = self.d[a], self.u[a]
        for j in range(self.d.shape[1]):
            d, u = rank_one(d, u, self.u[b][:, :, j], np.maximum(self.d[b][:, j], 0.0))
        n = self.n[a] + self.n[b]
        some = np.where(n > 0, n, 1.0)
        apart = self.mean[b] - self.mean[a]
        d, u = rank_one(d, u, apart, self.n[a] * self.n[b] / some)
        mean = self.mean[a] + apart * (self.n[b] / some)[:, None]
        rest = slice(2 * k, None)
        cat = np.concatenate
        return Spectra.of(cat([n, self.n[rest]]), cat([mean, self.mean[rest]]), cat([d, self.d[rest]]), cat([u, self.u[rest]]))

    def combined(self) -> Spectra:
        out = self
        while len(out.n) > 1:
            out = out.merged()
        return out
