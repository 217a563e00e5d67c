"""Date texts and calendar buckets."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = ("january february march april may june july august september "
          "october november december").split()
FULL_YEAR_DAYS = 350

_SPELLINGS = {s: i for i, m in enumerate(MONTHS, start=1) for s in (m, m[:3], *["sept"] * (i == 9))}
_WORD = "[A-Za-z]+|[0-9]+"
_DATE_WORD = rf"\b(?:(?i:{'|'.join(sorted(_SPELLINGS, key=len, reverse=True))})|[0-9]+)\b"
# Numbers of two digits (or one) before a year, as in 31/01/2025.
_LOOSE = r"(?<![0-9A-Za-z])([0-9]{2}|[0-9](?=[^0-9]))[/.-]([0-9]{2}|[0-9](?=[^0-9]))[/.-][0-9]{4}(?![0-9])"
_TIME_OF_DAY = r"T?\d+:[\d:.]+\s*(?:[AaPp]\.?[Mm]\.?|Z)?"


class Reading(NamedTuple):
    """What a column of date texts is: rows with a text, rows with a date, and the order of day and month."""

    filled: int
    dated: int
    day_first: bool

    @property
    def undated(self) -> int:
        return self.filled - self.dated


def _settled(df: DataFrame, keep: list[str], value: Column, out: str) -> DataFrame:
    """Add a costly column through a one-element generator.

    Catalyst moves filters below projections by copying the projected expressions into
    them; it does not move them below a generator, so a filter on the column reads the
    value instead of computing it again. It also keeps the generated code of a step
    small enough for the JIT compiler.
    """
    return df.select(*keep, F.explode(F.array(value)).alias(out))


def _with_words(df: DataFrame, keep: list[str], source: Column) -> DataFrame:
    """``__day`` of plain ISO texts; the words and numbers of all others as ``__words``, ``__n`` of them.

    A time of day goes first. Six words with a dash among them are two dates. Where there are more, only numbers and
    months count; other numbers of words are no date.
    """
    cut = df.select(*keep, F.trim(source.cast("string")).alias("__text"))
    text = F.col("__text")
    plain = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    bare = F.when(text.contains(":"), F.regexp_replace(text, _TIME_OF_DAY, " ")).otherwise(text)
    words = F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0))
    cut = _settled(cut.withColumn("__day", F.when(plain, text.try_cast("date"))), [*keep, "__text", "__day"], F.when(~plain, words), "__words")
    n, dash = F.size("__words"), text.contains("-") | text.contains("–")
    words = F.when((n > 6) & dash, F.regexp_extract_all(bare, F.lit(_DATE_WORD), F.lit(0))).otherwise(F.col("__words"))
    cut = cut.select(*keep, "__day", words.alias("__words"), dash.alias("__dash"))
    return cut.select(*keep, "__day", "__words", F.when((n <= 3) | ((n == 6) & F.col("__dash")), n).alias("__n"))


def _with_parts(df: DataFrame, at: int, name: str, n: Column) -> DataFrame:
    """Read up to three words from position ``at`` as the texts of year, month and day.

    ``loose`` tells that two numbers before the year could be either: month and day are then in the
    order of the text.
    """
    keep = df.columns
    number = F.create_map(*[F.lit(str(x)) for pair in _SPELLINGS.items() for x in pair])
    words = [F.get("__words", F.lit(at + i)) for i in range(3)]
    named = [w > "9z" for w in words[:2]]
    a, b = (F.when(x, F.try_element_at(number, F.lower(w))).otherwise(w) for x, w in zip(named, words, strict=False))
    cut = df.select(*keep, n.alias("__k"), a.alias("__a"), b.alias("__b"), words[2].alias("__c"), named[0].alias("__x"), named[1].alias("__y"))
    k, a, b, c, x, y = (F.col(f"__{i}") for i in "kabcxy")
    first = F.length(a) == 4
    three = F.when(first, _parts(a, b, c)).when(y, _parts(c, b, a)).otherwise(_parts(c, a, b, F.coalesce(~x, F.lit(False))))
    two = F.when(first, _parts(a, b, F.lit("1"))).otherwise(_parts(b, a, F.lit("1")))
    one = F.when(F.length(a) == 8, _parts(F.substring(a, 1, 4), F.substring(a, 5, 2), F.substring(a, 7, 2)))
    return _settled(cut, keep, F.when(k == 3, three).when(k == 2, two).when(k == 1, one), name)


def _parts(year: Column, month: Column, day: Column, loose: Column | None = None) -> Column:
    return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), (F.lit(False) if loose is None else loose).alias("loose"))


def _date(parts: str, day_first: bool) -> Column:
    """The date of year, month and day; null where there is none, which the cast finds without an exception."""
    y, m, d = (F.col(f"{parts}.{x}") for x in "ymd")
    shown = F.concat_ws("-", y, m, d)
    if day_first:
        shown = F.when(F.col(f"{parts}.loose"), F.concat_ws("-", y, d, m)).otherwise(shown)
    return F.when((F.length(y) == 4) & m.isNotNull() & d.isNotNull(), shown.try_cast("date"))


def _with_reading(df: DataFrame, keep: list[str], source: Column, ranges: bool) -> DataFrame:
    """``__day`` of plain texts, ``__start`` (and ``__end`` for ranges) as parts of all others."""
    read = _with_words(df, keep, source)
    n = F.col("__n")
    if not ranges:
        return _with_parts(read, 0, "__start", F.when(n <= 3, n))
    return _with_parts(_with_parts(read, 0, "__start", F.least(n, F.lit(3))), 3, "__end", F.when(n == 6, F.lit(3)))


def _found(ranges: bool, day_first: bool) -> Column:
    start = _date("__start", day_first)
    if ranges:
        short = F.datediff(_date("__end", day_first), start) < FULL_YEAR_DAYS
        start = F.when((F.col("__n") <= 3) | short, start)
    return F.coalesce("__day", start)


def _votes(df: DataFrame, columns: Mapping[str, bool]) -> DataFrame:
    """column, vote: rows for the day first less rows for the month first. Patterns are matched once per distinct text."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("text")) for n in columns])
    seen = (df.select(F.explode(cells).alias("c")).select("c.*").filter("text is not null")
            .groupBy("column", "text").agg(F.count(F.lit(1)).alias("rows")))

    def above(x: Column) -> Column:
        return ((F.length(x) == 2) & (x > "12")).cast("int")  # of two digits, a larger text is a larger number

    def vote(pattern: str) -> Column:
        first, second = (F.regexp_extract("text", pattern, i) for i in (1, 2))
        return above(first) - above(second)

    both = F.col("column").isin(*[n for n, ranges in columns.items() if ranges])
    vote_of_text = vote(_LOOSE) + F.when(both, vote(f".*{_LOOSE}")).otherwise(0)
    return seen.groupBy("column").agg(F.sum(F.col("rows") * vote_of_text).alias("vote"))


def day_first(df: DataFrame, columns: Mapping[str, bool]) -> dict[str, bool]:
    """Whether numbers before a year have the day first, for each text column (name: whether it holds ranges),
    from one aggregation over all rows.

    A first number above 12 speaks for the day first, a second one above 12 for the month first. The majority
    holds for the whole column; without any, the month is first. Of ranges both ends speak. Rows of a text are
    counted first, so that a report with few dates has few texts to match.
    """
    found = {r.column: r.vote for r in _votes(df, columns).collect()} if columns else {}
    return {n: found.get(n, 0) > 0 for n in columns}


def date_readings(df: DataFrame, columns: Mapping[str, bool]) -> dict[str, Reading]:
    """How each of some text columns reads (name: whether it holds ranges): filled and dated rows, day first or not."""
    order = day_first(df, columns)
    out: dict[str, Reading] = {}
    for n, ranges in columns.items():
        read = (with_range_start if ranges else with_date)(df.select(F.col(f"`{n}`").cast("string").alias("t")), F.col("t"), "d", order[n])
        r = read.agg(F.count("t").alias("filled"), F.count("d").alias("dated")).first()
        out[n] = Reading(r.filled, r.dated, order[n])
    return out


def _order(df: DataFrame, source: Column, ranges: bool, told: bool | None) -> bool:
    return told if told is not None else day_first(df.select(source.alias("t")), {"t": ranges})["t"]


def with_date(df: DataFrame, source: Column, out: str, day_first: bool | None = None) -> DataFrame:
    """Add a date read from a text in any of the usual report spellings, else null.

    ``2025-01-31``, ``2025/1/31``, ``20250131``, ``2025-01``, ``1/31/2025``, ``31/1/2025``,
    ``Jan 31, 2025``, ``31 January 2025``, ``Jan 2025``; a time of day may follow. Whether the day or the
    month is first in ``1/2/2025`` holds for the whole column: as told, or as its rows show (one job).
    """
    first = _order(df, source, False, day_first)
    keep = [c for c in df.columns if c != out]
    return _settled(_with_reading(df, keep, source, False), keep, _found(False, first), out)


def with_range_start(df: DataFrame, source: Column, out: str, day_first: bool | None = None) -> DataFrame:
    """Add the start of a date range; null for ranges of a year or so.

    A range is two dates of three words each with a dash between. A text that holds one never falls through
    to the single-date reading, even when the range itself is unusable.
    """
    first = _order(df, source, True, day_first)
    keep = [c for c in df.columns if c != out]
    return _settled(_with_reading(df, keep, source, True), keep, _found(True, first), out)


def period_start(c: Column, freq: str) -> Column:
    """First day of the week (Monday, freq ``W``) or of the month (freq ``M``)."""
    unit = {"W": "week", "M": "month"}[freq]
    return F.date_trunc(unit, c).cast("date")
