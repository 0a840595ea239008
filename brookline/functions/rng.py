"""PCG-XSH-RR 32-bit numbers (O'Neill 2014) and probability mass functions; sequential by nature, so on the driver."""

from __future__ import annotations

import math

_MASK = (1 << 64) - 1


class Pcg32:
    """Seeded generator: next32(), double in [0, 1), and unbiased integers below a bound. A seed is the state itself, and
    the first number is thrown away."""

    def __init__(self, seed: int, increment: int = 1442695040888963407) -> None:
        self.increment = (increment | 1) & _MASK
        self.state = seed & _MASK
        self.next32()

    def next32(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.increment) & _MASK
        x, turn = ((old >> 18 ^ old) >> 27) & 0xFFFFFFFF, old >> 59
        return (x >> turn | x << (-turn & 31)) & 0xFFFFFFFF

    def double(self) -> float:
        return self.next32() / 2**32

    def below(self, bound: int) -> int:
        """Lemire's multiply-and-reject."""
        least = (1 << 32) % bound
        while True:
            m = self.next32() * bound
            if m & 0xFFFFFFFF >= least:
                return m >> 32


class Pmf:
    """A distribution over values. Probabilities are checked and made to sum to one."""

    def __init__(self, values: list[float], probabilities: list[float]) -> None:
        if len(values) != len(probabilities) or not values:
            raise ValueError("a PMF needs as many probabilities as values")
        if len(set(values)) != len(values):
            raise ValueError("a PMF's values differ")
        if any(not math.isfinite(x) for x in [*values, *probabilities]) or min(probabilities) < 0 or sum(probabilities) <= 0:
            raise ValueError("a PMF's probabilities are finite, not negative, and not all zero")
        total = sum(probabilities)
        total = total if abs(total - 1) > 1e-6 else 1.0
        self.values, self.probabilities = list(map(float, values)), [p / total for p in probabilities]

    @property
    def mean(self) -> float:
        return sum(v * p for v, p in zip(self.values, self.probabilities, strict=True))

    @property
    def variance(self) -> float:
        m = self.mean
        return sum(p * (v - m) ** 2 for v, p in zip(self.values, self.probabilities, strict=True))

    @property
    def cv(self) -> float:
        return math.sqrt(self.variance) / abs(self.mean) if self.mean else 0.0

    @classmethod
    def from_summary(cls, low: float, high: float, middle: float | None = None, mean: float | None = None) -> Pmf:
        """Quarter, half, quarter at the minimum, the median (else the mean, else half way) and the maximum; one point for a
        range of nothing. Equal values are one."""
        if abs(high - low) < 1e-9:
            return cls([low], [1.0])
        peak = next(x for x in (middle, mean, (low + high) / 2) if x is not None)
        parts: dict[float, float] = {}
        for v, p in ((low, 0.25), (peak, 0.5), (high, 0.25)):
            parts[v] = parts.get(v, 0.0) + p
        return cls(list(parts), list(parts.values()))

    def fits(self, bins: int, policy: str = "repeat") -> None:
        """Raises unless the values are as many as bins or, under the policy "repeat", tile them."""
        n = len(self.values)
        if n != bins and (policy != "repeat" or bins % n):
            raise ValueError(f"a PMF of {n} values does not fit {bins} bins (policy: {policy})")

    def sample(self, n: int, seed: int) -> list[float]:
        """Inverse transform: the first value whose cumulative probability is not below the draw."""
        r, out = Pcg32(seed), []
        for _ in range(n):
            u, total = r.double(), 0.0
            for v, p in zip(self.values, self.probabilities, strict=True):
                total += p
                if u <= total:
                    break
            out.append(v)
        return out
