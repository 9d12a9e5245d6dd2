"""Numbers of a sample from their index alone: low-discrepancy points and keyed permutations.

Both are arithmetic on whole numbers in built-in expressions, so a row needs no other row: no
window, no sort, and any slice of a sample can be made anywhere.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backtest import MODULUS, mixed

BITS = 32
#: Degree, inner coefficients of the primitive polynomial, and first numbers, of
#: each dimension of the sequence from the second on (Joe and Kuo, 2008).
POLYNOMIALS = [
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)), (6, 19, (1, 1, 1, 15, 7, 5)),
    (6, 22, (1, 3, 1, 15, 13, 25)), (6, 25, (1, 1, 5, 5, 19, 61)), (7, 1, (1, 3, 7, 11, 23, 15, 103)), (7, 4, (1, 3, 7, 13, 13, 15, 69)),
]


def mixed_number(x: int, salt: int) -> int:
    """``backtest.mixed`` of two numbers."""
    a = (x % 1000003 * 48271 + salt * 69621 + 7) % MODULUS
    b = (a * a + x) % MODULUS
    return (b % 46337 * (b % 46327) + b * 16807 + x) % MODULUS


def directions(dim: int) -> list[int]:
    """The direction numbers of a dimension (from 0), as fractions of 2^32."""
    if dim == 0:
        return [1 << (BITS - i) for i in range(1, BITS + 1)]
    s, inner, m = POLYNOMIALS[dim - 1]
    m = list(m)
    for i in range(s, BITS):
        new = m[i - s] ^ (m[i - s] << s)
        for k in range(1, s):
            if inner >> (s - 1 - k) & 1:
                new ^= m[i - k] << k
        m.append(new)
    return [x << (BITS - i) for i, x in enumerate(m, 1)]


def sobol_number(index: str, dim: int, n: int, seed: int = 0, xor=lambda a, b: f"({a} ^ {b})") -> str:
    """SQL of the point's coordinate in (0, 1): Sobol's sequence in Gray code, shifted by a seed.

    ``index`` runs from 0 to ``n - 1``. Every power of two of consecutive points is spread as
    evenly as before the shift. Dimensions beyond the table's are hashed uniforms.
    """
    if dim > len(POLYNOMIALS):
        return f"(({mixed(index, str(dim + 1000 * seed))}) + 0.5) / {MODULUS}"
    gray = xor(f"cast({index} as bigint)", f"cast(floor({index} / 2) as bigint)")
    value = str((mixed_number(dim, seed) << 16 ^ mixed_number(dim + 7919, seed)) & ((1 << BITS) - 1))
    for bit, v in enumerate(directions(dim)[: max(1, (n - 1).bit_length())]):
        value = xor(f"cast({value} as bigint)", f"cast(floor({gray} / {1 << bit}) as bigint) % 2 * {v}")
    return f"({value} + 0.5) / {1 << BITS}"


def _sides(n: int) -> tuple[int, int]:
    """a, b with a * b a little over n, or n itself, and neither much larger than the other."""
    root = isqrt(n)
    return min(((a, -(-n // a)) for a in range(max(1, root // 2), 2 * root + 2)), key=lambda x: (x[0] * x[1] - n, abs(x[0] - x[1])))


def permutation(x: str, n: int, key: int, prefix: str, rounds: int = 3) -> list[tuple[str, str]]:
    """Columns to be added in turn, name and SQL; the last one is a permutation of 0 .. n - 1 applied to ``x``.

    ``x`` is cut into two digits of unlike bases, and a digit is shifted by a keyed hash of the other one in
    turn; that permutes the numbers below the product of the bases. The few from n on are
    sent through again until they are below n: as they are permuted, no more rounds than
    there are such numbers can be needed.
    """
    a, b = _sides(n)
    steps, now = [], x
    for turn in range(a * b - n + 1):
        p = f"{prefix}_{turn}"
        left, right = f"cast(({now} - {now} % {b}) / {b} as bigint)", f"{now} % {b}"
        for r in range(rounds):
            steps.append((f"{p}l{r}", f"({left} + {mixed(right, str(key + 2 * r))}) % {a}"))
            left = f"{p}l{r}"
            steps.append((f"{p}r{r}", f"({right} + {mixed(left, str(key + 2 * r + 1))}) % {b}"))
            right = f"{p}r{r}"
        made = f"{left} * {b} + {right}"
        steps.append((p, made if turn == 0 else f"case when {now} < {n} then {now} else {made} end"))
        now = p
    return steps


def permuted(df: DataFrame, x: str, n: int, key: int, out: str) -> DataFrame:
    """``df`` with ``out``: the place of column ``x`` (0 .. n - 1) in an order that follows from ``key``."""
    steps = permutation(x, n, key, f"_{out}")
    for name, sql in steps:
        df = df.withColumn(name, F.expr(sql))
    return df.withColumn(out, F.col(steps[-1][0])).drop(*[name for name, _ in steps])
