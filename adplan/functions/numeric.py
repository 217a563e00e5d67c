"""Rounding, safe ratios and order-independent sums."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(28,9)"
NANOS = 1_000_000_000
# Short enough to be finite in any case: 40 digits, two of them in the exponent.
NUMBER_PATTERN = r"^[+-]?(?=[\d.eE+-]{1,40}$)(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,2})?$"
# Larger amounts do not fit a long; they count as none.
LARGEST = 9.2e18
WHITESPACE = " \t\r\n\x0b\x0c "


def have(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that ``df`` carries, in the order asked for (metadata only)."""
    present = set(df.columns)
    return [n for n in names if n in present]


def rnd(c: Column, digits: int) -> Column:
    """Half-even rounding on doubles: scale, rint, scale back."""
    if digits == 0:
        return F.rint(c)
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def ratio(num: Column, den: Column, digits: int, scale: float | None = None) -> Column:
    """Rounded ``num / den * scale``; null where the denominator is 0 or null."""
    q = F.try_divide(num, den)
    return rnd(q if scale is None else q * F.lit(scale), digits)


def positive_ratio(num: Column, den: Column, digits: int, scale: float | None = None) -> Column:
    """Like :func:`ratio`, but null unless the denominator is above 0."""
    return ratio(num, F.when(den > 0, den), digits, scale)


def finite(c: Column) -> Column:
    """The value, or null for NaN (which compares as the largest number), infinities and what a long can't hold."""
    return F.when(F.abs(c) < LARGEST, c)


def parts(df: DataFrame, name: str, where: str | None = None, wide: bool = False) -> list[str]:
    """What to sum, row by row, so that the total does not depend on row order (as SQL).

    A double becomes its whole part and the billionths of the rest, these in millionths and a remainder:
    three sums of longs don't depend on the order of rows, hold totals up to 9.2e18, and stay in the fast
    aggregation path, which sums of wide decimals do not. NaN, infinities and single values of 9.2e18 and more
    count as no amount. ``wide`` is for values that are totals themselves and may not fit a long.
    """
    c = f"`{name}`"
    real = dict(df.dtypes)[name] in ("double", "float")
    if real:
        c = f"if(abs({c}) < {LARGEST}D, {c}, null)"
    if wide:
        out = [f"cast({c} as {MONEY})"]
    elif not real:
        out = [c]
    else:
        whole = f"floor({c})"
        nanos = f"cast(rint(({c} - {whole}) * {NANOS}D) as bigint)"
        out = [whole, f"{nanos} div 1000", f"{nanos} % 1000"]
    return out if where is None else [f"if({where}, {p}, null)" for p in out]


def joined(sums: Sequence[str]) -> Column:
    """The total as DOUBLE from the sums (as SQL) of its parts; 0 when there was nothing to add."""
    whole = [f"coalesce({s}, 0)" for s in sums]
    if len(whole) == 1:
        return F.expr(f"cast({whole[0]} as double)")
    high, middle, low = (f"cast({w} as decimal(20,0))" for w in whole)
    return F.expr(f"cast({high} + {middle} * 0.000001BD + {low} * 0.000000001BD as double)")


def total(df: DataFrame, name: str, where: str | None = None, wide: bool = False) -> Column:
    """Aggregate: exact sum of a measure as DOUBLE, of the rows that meet a condition."""
    return joined([f"sum({p})" for p in parts(df, name, where, wide)])


def totals(df: DataFrame, names: Sequence[str], wide: bool = False) -> list[Column]:
    return [total(df, n, wide=wide).alias(n) for n in have(df, names)]


def summable(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (),
             conditional: Mapping[str, tuple[str, str]] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with what is to be summed, computed once a row, and the totals (aggregates) over them.

    The rows have the ``keep`` columns and the parts of the present measures, so that grouping sets repeat values
    rather than expressions. ``conditional`` adds totals of a measure over the rows that meet a condition: name -> (measure,
    condition as SQL).
    """
    present, flags = have(df, names), dict(conditional or {})
    kinds = dict(df.dtypes)
    measured = list(dict.fromkeys([*present, *[m for m, _ in flags.values()]]))
    if not measured:
        return df.select(*keep), {}
    real = {n for n in measured if kinds[n] in ("double", "float")}
    clean = df.select(*keep, *[(finite(F.col(n)) if n in real else F.col(n)).alias(f"__v_{n}") for n in measured],
                      *[F.expr(c).alias(f"__f_{n}") for n, (_, c) in flags.items()])
    fields, count = [], {}
    for n in measured:
        v = f"`__v_{n}`"
        nanos = f"cast(rint(({v} - floor({v})) * {NANOS}D) as bigint)"
        pieces = [f"floor({v})", f"{nanos} div 1000", f"{nanos} % 1000"] if n in real else [v]
        count[n] = len(pieces)
        fields += [F.expr(p).alias(f"{n}__{i}") for i, p in enumerate(pieces)]
    rows = clean.select(*keep, *[f"__f_{n}" for n in flags], *fields)
    totals_ = {n: joined([f"sum(`{n}__{i}`)" for i in range(count[n])]) for n in present}
    totals_ |= {n: joined([f"sum(if(`__f_{n}`, `{m}__{i}`, null))" for i in range(count[m])]) for n, (m, _) in flags.items()}
    return rows, totals_


def aliased(sums: Mapping[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in sums.items()]


def above_zero(c: Column) -> Column:
    """The value when it is above 0, else null (the ``x if x and x > 0`` idiom)."""
    return F.when(c > 0, c)


def text_to_number(c: Column) -> Column:
    """``$1,234.50`` -> 1234.5, ``12.5%`` -> 12.5; anything that is not a number -> null."""
    # Searched byte by byte: translate takes cells apart by character, which costs more than all the rest.
    for sign in "$%,":
        c = F.replace(c, F.lit(sign), F.lit(""))
    bare = F.btrim(c, F.lit(WHITESPACE))
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))
