"""Leading eigenvalues and eigenvectors of a symmetric matrix by slicing its spectrum.

The matrix is brought to tridiagonal form once (the eigenvalues stay). The LDLᵀ factors of that form less a shift have as many
negative pivots as there are eigenvalues below the shift (Sylvester's law of inertia); halving intervals by these counts
isolates every wanted eigenvalue. Rayleigh quotient iteration on the matrix itself then converges cubically inside the interval: a step
counts only if the quotient's error bound lies within the interval, otherwise the interval is halved again. Eigenvalues that
are equal, or as close as rounding, end in an interval of that width and get vectors orthogonal to each other. At the end
the counts on both sides of every value certify its number.

The matrix has the size of the vectors' dimension, whatever the number of vectors: the work is cubic in the dimension.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(np.float64).eps
_STEPS = 200


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and the entries beside it of a tridiagonal matrix with the same eigenvalues (Householder reflections)."""
    rest = np.array(matrix, dtype=np.float64)
    for k in range(len(rest) - 2):
        mirror = rest[k + 1 :, k].copy()
        mirror[0] += np.copysign(np.linalg.norm(mirror), mirror[0])
        length = np.linalg.norm(mirror)
        if length == 0:
            continue
        mirror /= length
        part = rest[k + 1 :, k:]
        part -= 2 * np.outer(mirror, mirror @ part)
        part = rest[k:, k + 1 :]
        part -= 2 * np.outer(part @ mirror, mirror)
    return np.diagonal(rest).copy(), np.diagonal(rest, -1).copy()


def below(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each shift, how many eigenvalues lie below it: negative pivots of LDLᵀ of the matrix less the shift."""
    least = np.finfo(np.float64).tiny * max(1.0, float(np.max(beside**2, initial=0.0)))
    pivot = diagonal[0] - shifts
    count = np.zeros(len(shifts), dtype=np.int64)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shifts - beside[i - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) <= least, -least, pivot)
        count += pivot < 0
    return count


class Spectrum:
    """Counts over one matrix, and its leading pairs."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.array(matrix, dtype=np.float64)
        self.size = len(self.matrix)
        self.diagonal, self.beside = tridiagonal(self.matrix)
        around = np.abs(np.concatenate([[0], self.beside])) + np.abs(np.concatenate([self.beside, [0]]))
        self.scale = float(np.max(np.abs(self.diagonal) + around, initial=0.0))
        #: what rounding may move an eigenvalue by
        self.blur = 8 * self.size * _EPS * self.scale
        self.low = float(np.min(self.diagonal - around, initial=0.0)) - 2 * self.blur
        self.high = float(np.max(self.diagonal + around, initial=0.0)) + 2 * self.blur

    def below(self, shifts) -> np.ndarray:
        return below(self.diagonal, self.beside, np.atleast_1d(np.asarray(shifts, dtype=np.float64)))

    def isolate(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Low and high end of an interval around each of the ``count`` largest eigenvalues, largest first.

        An interval holds no other eigenvalue, or is as narrow as rounding allows.
        """
        own = self.size - 1 - np.arange(count)  # place from below
        low, high = np.full(count, self.low), np.full(count, self.high)
        under, upto = np.zeros(count, dtype=np.int64), np.full(count, self.size, dtype=np.int64)
        while len(open_ := np.flatnonzero((upto - under > 1) & (high - low > self.blur))):
            middle = (low[open_] + high[open_]) / 2
            found = self.below(middle)
            left = found > own[open_]
            high[open_[left]], upto[open_[left]] = middle[left], found[left]
            low[open_[~left]], under[open_[~left]] = middle[~left], found[~left]
        return low, high

    def _solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        while True:
            try:
                made = np.linalg.solve(self.matrix - shift * np.eye(self.size), right)
                if np.isfinite(made).all():
                    return made
            except np.linalg.LinAlgError:
                pass
            shift += max(_EPS * abs(shift), _EPS * self.scale)  # the shift is an eigenvalue

    def refine(self, number: int, low: float, high: float, others: np.ndarray) -> tuple[float, np.ndarray]:
        """The eigenvalue ``number`` (1 is the largest) in an interval, and its vector, orthogonal to ``others``."""
        own, enough = self.size - number, 4 * np.sqrt(self.size) * _EPS * self.scale
        guess = np.random.default_rng(number).standard_normal(self.size)
        shift, best = (low + high) / 2, (np.inf, 0.0, guess)
        for _ in range(_STEPS):
            guess = self._solve(shift, guess)
            guess /= np.linalg.norm(guess)
            for _ in range(2):
                guess -= others.T @ (others @ guess)
                guess /= np.linalg.norm(guess)
            image = self.matrix @ guess
            value = float(guess @ image)
            error = float(np.linalg.norm(image - value * guess))
            inside = low - self.blur <= value <= high + self.blur
            if inside and error < best[0]:
                best = (error, value, guess)
            elif inside and best[0] <= self.blur:
                break  # no step makes it better
            if inside and error <= enough:
                break
            if low < value < high and error < min(value - low, high - value):
                shift = value
            elif high - low > self.blur:
                middle = (low + high) / 2
                low, high = (low, middle) if self.below(middle)[0] > own else (middle, high)
                shift = (low + high) / 2
        if best[0] > self.blur:
            raise ArithmeticError(f"eigenvalue {number} has not converged: error {best[0]}")
        return best[1], best[2]

    def leading(self, count: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The up to ``count`` largest eigenvalues above ``floor``, falling, and their unit vectors as rows."""
        count = min(count, int(self.size - self.below(floor)[0])) if self.size else 0
        low, high = self.isolate(count)
        values, vectors = np.zeros(count), np.zeros((count, self.size))
        for k in range(count):
            near = [j for j in range(k) if low[j] - high[k] <= 1e-3 * self.scale]  # as close ones lose their right angle
            values[k], vectors[k] = self.refine(k + 1, low[k], high[k], vectors[near])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
        places = self.size - 1 - np.arange(count)
        if not ((self.below(values - self.blur) <= places) & (self.below(values + self.blur) > places)).all():
            raise ArithmeticError("the counts do not certify the numbering of the eigenvalues")
        return values, vectors
