"""PCG-XSH-RR numbers as Columns: every row draws by itself, wherever it is in a sequence.

The generator's state moves by s -> s * A + C modulo 2 ** 64, so n steps are one such step too, and those of 1, 2, 4, 8 ...
steps are constants. A row's n-th number takes the steps of n's binary digits, with 64-bit words as two halves of 32
bits, whose products are made in pieces that a signed long holds (Spark's own multiplication raises on overflow)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import Pmf

MULTIPLIER, INCREMENT, LOW = 6364136223846793005, 1442695040888963407, 0xFFFFFFFF
#: Binary digits of the greatest place in a sequence.
DIGITS = 40


def jumps(digits: int = DIGITS, increment: int = INCREMENT) -> list[tuple[int, int]]:
    """Factor and addend of 1, 2, 4, ... steps."""
    mask, out, a, c = (1 << 64) - 1, [], MULTIPLIER, increment | 1
    for _ in range(digits):
        out.append((a, c))
        a, c = a * a & mask, (a + 1) * c & mask
    return out


def _bits(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def _times32(x: Column, low16: Column, high16: Column) -> Column:
    """x times a 32-bit number given as two halves, modulo 2 ** 32; x is below 2 ** 32."""
    return _bits(x * low16 + F.shiftleft(_bits(x * high16, 0xFFFF), 16), LOW)


def _step(hi: Column, lo: Column, jump: Column) -> Column:
    """The state (hi, lo) after a jump (a: four 16-bit pieces from the lowest on, c: both halves)."""
    a, p1 = jump["a"], lo * jump["a"][1]
    low = lo * a[0] + F.shiftleft(_bits(p1, 0xFFFF), 16) + jump["c"][1]
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + _times32(lo, a[2], a[3]) + _times32(hi, a[0], a[1]) + jump["c"][0]
    return F.struct(_bits(high, LOW).alias("hi"), _bits(low, LOW).alias("lo"))


def state_at(seed: Column, n: Column, digits: int = DIGITS) -> Column:
    """The state n steps after the seed (a long; negative ones stand for those above 2 ** 63), as a struct of both halves."""
    table = F.array(*[F.struct(F.array(*[F.lit(a >> 16 * i & 0xFFFF).cast("long") for i in range(4)]).alias("a"), F.array(F.lit(c >> 32).cast("long"), F.lit(c & LOW).cast("long")).alias("c")) for a, c in jumps(digits)])
    seed, n = seed.cast("long"), n.cast("long")
    wanted = F.filter(F.transform(table, lambda j, k: F.struct(j.alias("j"), k.alias("k"))), lambda x: _bits(F.call_function("shiftright", n, x["k"]), 1) == 1)
    start = F.struct(F.shiftrightunsigned(seed, 32).alias("hi"), _bits(seed, LOW).alias("lo"))
    return F.aggregate(wanted, start, lambda s, x: _step(s["hi"], s["lo"], x["j"]))


def number(state: Column) -> Column:
    """The 32-bit number that a state gives, as a long."""

    def out(s: Column) -> Column:
        hi, lo = s["hi"], s["lo"]
        x = F.shiftright(hi, 18).bitwiseXOR(hi), _bits(F.shiftleft(hi, 14).bitwiseOR(F.shiftright(lo, 18)), LOW).bitwiseXOR(lo)
        v, turn = _bits(F.shiftleft(x[0], 5).bitwiseOR(F.shiftright(x[1], 27)), LOW), F.shiftright(hi, 27).cast("int")
        return _bits(F.call_function("shiftright", v, turn).bitwiseOR(F.call_function("shiftleft", v, _bits(-turn, 31))), LOW)

    return F.element_at(F.transform(F.array(state), out), 1)


def draw(seed: Column, n: Column) -> Column:
    """The n-th number (from 0) of a seed's sequence; the generator throws its first number away."""
    return number(state_at(seed, n + 1))


def uniform(seed: Column, n: Column) -> Column:
    """The n-th number as a double in [0, 1)."""
    return draw(seed, n) / F.lit(float(1 << 32))


def below(seed: Column, n: Column, bound: int, tries: int = 8) -> Column:
    """A whole number below the bound without bias, by multiplying and rejecting; each row has `tries` numbers of the sequence
    to itself (all are rejected once in 2 ** (8 * tries) rows at a bound of 2 ** 24; the last is taken then)."""
    if not 0 < bound <= 1 << 31:
        raise ValueError("a bound is positive and at most 2 ** 31")
    least = (1 << 32) % bound
    one = lambda i: F.transform(F.array(draw(seed, n * tries + i)), lambda v: v * F.lit(bound))
    fine = F.flatten(F.array(*[F.filter(one(i), lambda m: _bits(m, LOW) >= least) if i < tries - 1 else one(i) for i in range(tries)]))
    return F.shiftright(F.element_at(fine, 1), 32)


def sample(pmf: Pmf, u: Column) -> Column:
    """By inverse transform: the first value whose cumulative probability is not below u; the last if none is."""
    total, sums = 0.0, []
    for p in pmf.probabilities:
        total += p
        sums.append(total)
    return _first(pmf.values, sums, u)


def _first(values: Sequence[float], sums: Sequence[float], u: Column) -> Column:
    out = F.lit(values[-1])
    for v, s in reversed(list(zip(values[:-1], sums[:-1], strict=True))):
        out = F.when(u <= s, F.lit(v)).otherwise(out)
    return out
