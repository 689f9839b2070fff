"""Exact and summary statistics."""

from __future__ import annotations

from collections.abc import Callable
from decimal import MAX_EMAX, MIN_EMIN, ROUND_CEILING, ROUND_FLOOR, Context, Decimal, Inexact, InvalidOperation, localcontext
from functools import lru_cache
from math import sumprod

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "numerator string, denominator string, p double, significant boolean"


#: Decimals as whole numbers of any length: products take little more than linear time, and writing them none. Whatever
#: would round is an error.
WHOLE = Context(prec=10**9, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[Inexact, InvalidOperation])

Matrix = list[list]


def times(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b, strict=True))
    return [[sumprod(row, column) for column in columns] for row in a]


def span(step: Callable[[int], tuple[Matrix, int]], first: int, last: int) -> tuple[Matrix, Decimal]:
    """The product of the steps ``first`` to ``last``, the last on the left, and that of their divisors."""
    if last - first < 16:
        whole, by = step(first)
        for k in range(first + 1, last + 1):
            matrix, divisor = step(k)
            whole, by = times(matrix, whole), by * divisor
        return [[Decimal(x) for x in row] for row in whole], Decimal(by)
    half = (first + last) // 2
    (a, d), (b, e) = span(step, first, half), span(step, half + 1, last)
    return times(b, a), d * e


def walk(state: list[Decimal], step: Callable[[int], tuple[Matrix, int]], first: int, last: int) -> list[Decimal]:
    """``state`` after the steps ``first`` to ``last``, each a matrix and a divisor of what it yields. So many are made
    at once that their product is about half as long as the state: many short steps become a few long products."""
    while first <= last:
        to = min(last, first + max(64, max(x.adjusted() for x in state) // 12))
        matrix, by = span(step, first, to)
        pairs = [divmod(x, by) for (x,) in times(matrix, [[x] for x in state])]
        if any(rest for _, rest in pairs):
            raise ArithmeticError("the recurrence must divide without rest")
        state, first = [c for c, _ in pairs], to + 1
    return state


def middle(n1: int, n2: int, n3: int) -> list[Decimal]:
    """The coefficients of P (see ``sign_swap_tail``) in the middle or next above it, and the two that follow.

    At x = e^(2ia) and v = (2 cos a)^2, P is (2 cos a)^(n1+n3) (v-2)^n2 (v-3)^n3 but for a power of x, and the means J_k
    of v^(h+k) (v-2)^b (v-3)^c over the circle, k = 0, 1, 2, hold these coefficients. J_3 is a fraction of those three,
    as the derivative of v^(h+1/2) (4-v)^(1/2) (v-2)^(b+1) (v-3)^(c+1) has the mean 0. So one step raises h or b by 1.
    The first three, for h = n3/2 rounded up and b = 0, are multiples of a binomial coefficient in the middle.
    """

    def raised(root: int, h: int, b: int) -> tuple[Matrix, int]:
        d = h + b + n3 + 3
        return [[-root * d, d, 0], [0, -root * d, d], [24 * h + 12, -(26 * h + 12 * b + 8 * n3 + 36), 9 * h + 7 * b + 6 * n3 + 20 - root * d]], d

    low, high = (n3 + 1) // 2, (n1 + n3 + 1) // 2
    (c,) = walk([Decimal(1)], lambda k: ([[4 * k - 2]], k), 1, low)
    j = [0 * c, c, 5 * c] if n3 % 2 else [c, 2 * c, 6 * c]
    j = walk(j, lambda h: raised(0, h, 0), low, high - 1)
    j0, j1, j2 = walk(j, lambda b: raised(2, high, b), 0, n2 - 1)
    if (n1 + n3) % 2:
        return [j0 // 2, (j1 - 3 * j0) // 2, (j2 - 5 * j1 + 5 * j0) // 2]
    return [j0, (j1 - 2 * j0) // 2, (j2 - 4 * j1 + 2 * j0) // 2]


@lru_cache(maxsize=16)
def sign_swap_tail(n1: int, n2: int, n3: int, observed: int) -> tuple[Decimal, Decimal]:
    """How many of the 2^(n1+n2+n3) sign choices over n1 ones, n2 twos and n3 threes give a sum of at least
    ``observed`` in absolute value, and the number of choices; both are whole.

    Negating i ones, j twos and k threes lowers the sum by 2 (i + 2j + 3k), so the lower tail is a sum of coefficients
    of P(x) = (1+x)^n1 (1+x^2)^n2 (1+x^3)^n3, and symmetry gives the other tail. As 1+x divides 1+x^3, multiplying
    P'/P by (1+x^2)(1+x^3) leaves no fraction, which gives each coefficient from the five before it. They are summed
    from the lowest on, or from the middle to the tail, whichever takes less.
    """
    if min(n1, n2, n3, observed) < 0:
        raise ValueError("counts and the observed statistic must not be negative")
    weight = n1 + 2 * n2 + 3 * n3
    if observed > weight or (weight - observed) % 2:
        raise ValueError("the observed statistic can't arise from these weights")

    def following(k: int) -> tuple[Matrix, int]:
        """From the five coefficients before the k-th, the last first, and a sum: the same with the k-th."""
        new = [n1, 2 * n2 - n1 - k + 2, 2 * n1 + 3 * n3 - k + 3, -n1, weight - k + 5]
        return [[*new, 0], *([k * (i == j) for j in range(6)] for i in range(4)), [*new, k]], k

    with localcontext(WHOLE):
        total, lower = Decimal(2) ** (n1 + n2 + n3), (weight - observed) // 2
        if observed == 0:
            return total, total
        if lower <= (n1 // 2 + n2) // 6 + observed // 2:  # a step of five coefficients and a sum costs about six of three means
            return 2 * walk([Decimal(x) for x in (1, 0, 0, 0, 0, 1)], following, 1, lower)[-1], total
        near, centre, odd = middle(n1, n2, n3), (weight + 1) // 2, weight % 2
        inner = sum(near[: weight - lower - centre], Decimal(0))
        state = [*near[::-1], *(near[:2] if odd else near[1:]), inner]
        inner = walk(state, following, centre + 3, weight - lower - 1)[-1]
        return total - 2 * inner + (0 if odd else near[0]), total


def quotient(a: Decimal, b: Decimal) -> float:
    """The double next to a / b: 60 digits tell it, else all of them do."""
    low, high = (float(Context(prec=60, rounding=r, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[]).divide(a, b)) for r in (ROUND_FLOOR, ROUND_CEILING))
    return low if low == high else int(a) / int(b)


def exact_row(n1: int | None, n2: int | None, n3: int | None, difference: int | None) -> tuple | None:
    if None in (n1, n2, n3, difference):
        return None
    num, den = sign_swap_tail(n1, n2, n3, abs(difference))
    with localcontext(WHOLE):
        return str(num), str(den), quotient(num, den), 20 * num < den


def exact_test(*counts: str) -> Column:
    """Two-sided exact test of paired differences (n1, n2, n3, difference). Big integers are text; significance is
    20 * numerator < denominator, in integers."""

    @F.pandas_udf(EXACT)
    def run(n1: pd.Series, n2: pd.Series, n3: pd.Series, difference: pd.Series) -> pd.DataFrame:
        rows = [exact_row(*(None if pd.isna(x) else int(x) for x in r)) or (None,) * 4 for r in zip(n1, n2, n3, difference, strict=True)]
        return pd.DataFrame(rows, columns=["numerator", "denominator", "p", "significant"]).astype({"p": float})

    return run(*counts)


def sem(value: Column) -> Column:
    """Standard error of the mean; null for one value."""
    return F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null for fewer than two rows or where either side doesn't vary."""
    varies = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) > 1) & (F.stddev_samp(x) > 0) & (F.stddev_samp(y) > 0)
    return F.when(varies, F.corr(x, y))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
