"""Text normalisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from adplan.functions.numeric import WHITESPACE
from adplan.functions.schema import CAMPAIGN_TYPES, NA_TOKENS


def blank_to_null(c: Column) -> Column:
    """Map the no-value tokens to null."""
    return F.when(~c.isin(*NA_TOKENS), c)


def title_case(c: Column) -> Column:
    """Capital after every non-letter: ``tv-ads`` -> ``Tv-Ads``."""
    pieces = F.split(c, r"(?<=[^\p{Lu}\p{Ll}\p{Lt}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def campaign_type(c: Column, null_label: str | None = None) -> Column:
    """One name per ad product; unknown products in title case."""
    key = F.lower(F.btrim(c, F.lit(WHITESPACE)))
    known = F.create_map(*[F.lit(v) for v in chain.from_iterable(CAMPAIGN_TYPES.items())])
    name = F.coalesce(F.try_element_at(known, key), title_case(key))
    return name if null_label is None else F.coalesce(name, F.lit(null_label))
