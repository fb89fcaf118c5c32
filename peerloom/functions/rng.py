"""SplitMix64 as column expressions that hold under ANSI arithmetic.

A 64-bit product or sum that wraps would raise an overflow, so both are taken
in 32-bit halves. Every operand that is used more than once is bound by
``let``; chained plain columns would be inlined over and over by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator.
GAMMA = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB

_LOW = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signed(x: int) -> int:
    """The signed 64-bit number with the bits of the unsigned ``x``."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def times(a: Column, c: int) -> Column:
    """``a * c`` modulo 2^64."""
    c0, c1, c2, c3 = [F.lit((c >> s) & 0xFFFF).cast("long") for s in (0, 16, 32, 48)]

    def body(x):
        lo, hi = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
        p0, p1 = lo * c0, lo * c1
        low = p0.bitwiseAND(F.lit(_LOW)) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16)
        cross = lo * c2 + F.shiftleft((lo * c3).bitwiseAND(F.lit(0xFFFF)), 16) + hi * c0
        cross = cross + F.shiftleft((hi * c1).bitwiseAND(F.lit(0xFFFF)), 16)
        high = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(low, 32) + cross
        return _join(high, low)

    return let(a, body)


def plus(a: Column, b: Column) -> Column:
    """``a + b`` modulo 2^64."""

    def body(p):
        x, y = p.getField("x"), p.getField("y")
        low = x.bitwiseAND(F.lit(_LOW)) + y.bitwiseAND(F.lit(_LOW))
        return _join(F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(low, 32), low)

    return let(F.struct(a.alias("x"), b.alias("y")), body)


def finish(z: Column) -> Column:
    """The output function of the generator."""
    z = times(let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 30))), MIX1)
    z = times(let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 27))), MIX2)
    return let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 31)))


def output(seed: Column, k: Column | int) -> Column:
    """The ``k``-th output (from 1) of the stream that starts at ``seed``: counter-based, so in any order."""
    step = F.lit(signed(k * GAMMA)) if isinstance(k, int) else times(k.cast("long"), GAMMA)
    return finish(plus(seed.cast("long"), step))


def unsigned_text(x: Column) -> Column:
    return F.conv(F.hex(x), 16, 10)


def uniform(x: Column) -> Column:
    """A double in [0, 1) from the top 53 bits."""
    return F.shiftrightunsigned(x, 11) * F.lit(2.0**-53)


def unsigned_mod(x: Column, m: int) -> Column:
    """``x`` modulo ``m``, its 64 bits taken as an unsigned number."""
    half = F.shiftrightunsigned(x, 1) % F.lit(m)
    return (half * 2 + x.bitwiseAND(F.lit(1))) % F.lit(m)


def round_seed(base: Column, round_no: Column | int) -> Column:
    """The seed that all nodes shuffle by in a round (from 1)."""
    return output(base, round_no + 1)


def churn_uniform(seed: Column, round_no: Column, peer: Column, receiver: Column | None = None) -> Column:
    """The draw that drops a peer in a round; the same for every receiver unless one is given."""
    z = plus(seed.cast("long"), times((round_no + 2).cast("long"), GAMMA))
    z = plus(z, times(peer.cast("long"), MIX1))
    if receiver is not None:
        z = plus(z, times(receiver.cast("long"), MIX2))
    return uniform(finish(z))


def normal(seed: Column, i: Column) -> Column:
    """The ``i``-th (from 0) standard normal: Box-Muller on outputs 2j+1 and 2j+2, cosine then sine."""
    pair = F.floor(i / 2).cast("long") * 2
    r = F.sqrt(-2 * F.log(uniform(output(seed, pair + 1))))
    angle = 2 * F.pi() * uniform(output(seed, pair + 2))
    return F.when(i % 2 == 0, r * F.cos(angle)).otherwise(r * F.sin(angle))


class SplitMix64:
    """The same stream on the driver or inside a grouped function."""

    def __init__(self, seed: int):
        self.state = seed & ((1 << 64) - 1)

    def next(self) -> int:
        self.state = (self.state + GAMMA) & ((1 << 64) - 1)
        z = self.state
        z = ((z ^ (z >> 30)) * MIX1) & ((1 << 64) - 1)
        z = ((z ^ (z >> 27)) * MIX2) & ((1 << 64) - 1)
        return z ^ (z >> 31)

    def below(self, bound: int) -> int:
        """Unbiased integer in [0, bound): outputs from the last partial range are drawn again."""
        top = (1 << 64) - 1
        while (x := self.next()) >= top - top % bound:
            pass
        return x % bound

    def permutation(self, n: int) -> list[int]:
        out = list(range(n))
        for i in range(n - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out
