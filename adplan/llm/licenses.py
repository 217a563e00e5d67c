"""License notices in texts, from DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle; hash functions, each a band of one row. A window goes by bands alone only if every template
#: that it can hold has a similarity of SIMILAR or more to it (all bands are missed once in 4 * 10^9 at most);
#: fuller windows are retrieved by every shingle, which misses none.
SHINGLE, BANDS, SIMILAR = 3, 32, 0.5
#: Share of a template's shingles that a window must hold; words around a window in which a license's key may reach.
CONTAINED, AROUND = 0.8, 8
#: Window strides in words; a template goes by the smallest that is as long as it is.
STRIDES = (8, 32, 128)

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License {}"
_EITHER, _ONLY = "as published by the Free Software Foundation, either version {} of the License", "version {} as published by the Free Software Foundation"


def _gnu(kind: str, version: str) -> list[str]:
    return [f"This work is licensed under the GNU {kind}General Public License, version {version}.",
            *[_GNU.format(kind, how.format(version)) for how in (_EITHER, _ONLY)]]


def _cc(kind: str, name: str) -> list[str]:
    return [f"Licensed under CC BY{kind} 4.0.", f"This work is licensed under a Creative Commons Attribution{name} 4.0 International License."]


#: Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "GPL-2.0": _gnu("", "2"),
    "GPL-3.0": _gnu("", "3"),
    "LGPL-2.0": _gnu("Library ", "2"),
    "LGPL-2.1": _gnu("Lesser ", "2.1"),
    "LGPL-3.0": _gnu("Lesser ", "3"),
    "AGPL-3.0": _gnu("Affero ", "3"),
    "CC-BY-4.0": _cc("", ""),
    "CC-BY-NC-4.0": _cc("-NC", "-NonCommercial"),
    "CC-BY-SA-4.0": _cc("-SA", "-ShareAlike"),
    "CC-BY-ND-4.0": _cc("-ND", "-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("-NC-SA", "-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("-NC-ND", "-NonCommercial-NoDerivatives"),
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def _named(name: str, version: str) -> str:
    """A name and the first version after it, at most 16 words on; no other GNU license in between."""
    return rf"(?<!\S){name} licen[cs]e(?:(?: (?!version |v ?\d|gnu )\S+){{0,16}} (?:version |v ?)| ){version}(?!\S)"


def _named_cc(kind: str, name: str) -> str:
    return rf"(?<!\S)(?:cc by{kind}|commons attribution{name}) 4 0(?!\S)"


#: What tells a license from its relatives, on words in lower case with a blank in between. BSD stands for
#: all that share its sentence, MIT for all that share its grant (MIT-0 and X11 do).
KEYS = {
    "Apache-2.0": _named("apache(?: software)?", "2"),
    "MIT": r"(?<!\S)(?:mit licen[cs]e|deal in (?:the|this) software)(?!\S)",
    "GPL-2.0": _named("gnu general public", "2"),
    "GPL-3.0": _named("gnu general public", "3"),
    "LGPL-2.0": _named("gnu (?:library|lesser) general public", "2(?! 1(?!\\S))"),
    "LGPL-2.1": _named("gnu (?:library|lesser) general public", "2 1"),
    "LGPL-3.0": _named("gnu (?:library|lesser) general public", "3"),
    "AGPL-3.0": _named("gnu affero general public", "3"),
    "CC-BY-4.0": _named_cc("", ""),
    "CC-BY-NC-4.0": _named_cc(" nc", " noncommercial"),
    "CC-BY-SA-4.0": _named_cc(" sa", " sharealike"),
    "CC-BY-ND-4.0": _named_cc(" nd", " noderivatives"),
    "CC-BY-NC-SA-4.0": _named_cc(" nc sa", " noncommercial sharealike"),
    "CC-BY-NC-ND-4.0": _named_cc(" nc nd", " noncommercial noderivatives"),
    "MPL-2.0": _named("mozilla public", "2"),
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashes(words: Column) -> Column:
    """Hashes of all shingles, in order of place; fewer words than a shingle has give none."""
    return F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]),
    )).otherwise(F.array().cast("array<bigint>"))


def _bands(hashes: Column) -> Column:
    """The least value of each hash function over the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, i))).alias("value")))


def template_table(spark: SparkSession, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """license, template, stride, hashes of each template; those shorter than a shingle are left out."""
    rows = [(name, k, text) for name, texts in (templates or TEMPLATES).items() for k, text in enumerate(texts)]
    stride = F.lit(STRIDES[-1])
    for s in STRIDES[-2::-1]:
        stride = F.when(F.size("words") <= s, s).otherwise(stride)
    words = spark.createDataFrame(rows, "license string, template int, text string").select("license", "template", _words(F.col("text")).alias("words"))
    return words.select("license", "template", stride.alias("stride"), F.array_distinct(_hashes(F.col("words"))).alias("hashes")).where(F.size("hashes") > 0)


def find_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (best share of a template's shingles in a window), first_word (of the first such window).

    Windows are two strides long and start at every stride, so each template that stands in a
    text lies whole in one. Shingles that no template has cannot count towards containment and
    are left out of windows first. Bands retrieve templates for a window, and any shared shingle
    does where a window holds so many that a small template could be lost among them; the share of
    the template's shingles in the window decides, and the license's key (its own name variant and
    version, a regular expression; KEYS for TEMPLATES) must stand there in full. Each license
    is judged by its own key, so several of a family in one window are all reported. Null and
    empty texts have no license; repeated rows of a doc_id count once; extra columns are
    ignored; an empty table gives no rows. Templates are a fixed, small table and are broadcast.
    """
    keys = keys or (KEYS if templates is None else {})
    known = template_table(docs.sparkSession, templates)
    key = F.lit("")
    for name, pattern in keys.items():
        key = F.when(F.col("license") == name, F.lit(pattern)).otherwise(key)
    known = known.withColumn("key", key)
    by_stride, least, full = {}, {}, {}
    for r in known.select("stride", "hashes").collect():  # a few hundred numbers, given by the templates
        by_stride.setdefault(r.stride, set()).update(r.hashes)
        n = len(r.hashes)
        held = next(c for c in range(n + 1) if c / n >= CONTAINED)
        # Of w shingles in the window, held are the template's: similarity held / (w + n - held).
        least[r.stride] = min(held, least.get(r.stride, held))
        full[r.stride] = min(int(held / SIMILAR) - n + held, full.get(r.stride, 1 << 30))
    of_stride = lambda bounds: F.coalesce(*[F.when(F.col("stride") == s, n) for s, n in bounds.items()])
    every = sorted(set().union(*by_stride.values()))
    # Generators keep Catalyst from copying the word and hash arrays into filters and lambda bodies.
    words = docs.select("doc_id", F.inline(F.array(F.struct(_words(F.coalesce("text", F.lit(""))).alias("_w")))))
    hashed = words.select("doc_id", "_w", F.inline(F.array(F.struct(_hashes(F.col("_w")).alias("_h")))))
    hits = hashed.select("doc_id", "_w", F.inline(F.array(F.struct(F.filter(
        F.transform("_h", lambda h, i: F.when(h.isin(every), F.struct(i.alias("at"), h.alias("h")))), lambda x: x.isNotNull()).alias("hits")))))
    windows = hits.where(F.size("hits") > 0).select("doc_id", "_w", "hits", F.explode(F.array(*[F.lit(s) for s in sorted(by_stride)])).alias("stride"))
    starts = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(
        F.floor(x.at / F.col("stride")), F.greatest(F.floor(x.at / F.col("stride")) - 1, F.lit(0))))))
    inside = lambda x, w: (x.at >= w * F.col("stride")) & (x.at < (w + 2) * F.col("stride"))
    begin = lambda w: F.greatest(w * F.col("stride") - AROUND, F.lit(0))
    windows = windows.select("doc_id", "stride", F.inline(F.transform(starts, lambda w: F.struct(
        (w * F.col("stride")).cast("long").alias("first_word"),
        F.array_distinct(F.transform(F.filter("hits", lambda x: inside(x, w)), lambda x: x.h)).alias("held"),
        F.array_join(F.slice("_w", (begin(w) + 1).cast("int"), ((w + 2) * F.col("stride") + SHINGLE - 1 + AROUND - begin(w)).cast("int")), " ").alias("said")))))
    single = lambda hashes: F.transform(hashes, lambda h: F.struct(F.lit(-1).alias("band"), h.alias("value")))
    ways = F.when(F.size("held") > of_stride(full), F.concat(_bands(F.col("held")), single("held"))).otherwise(_bands(F.col("held")))
    banded = windows.where(F.size("held") >= of_stride(least)).select("doc_id", "stride", "first_word", "held", "said", F.explode(ways).alias("b"))
    wanted = known.select("stride", "license", "template", "hashes", "key", F.explode(F.concat(_bands(F.col("hashes")), single("hashes"))).alias("b"))
    met = banded.select("doc_id", "stride", "first_word", "held", "said", "b.band", "b.value").join(
        F.broadcast(wanted.select("stride", "license", "template", "hashes", "key", "b.band", "b.value")), ["stride", "band", "value"])
    share = F.size(F.array_intersect("held", "hashes")) / F.size("hashes")
    # CASE keeps the order: patterns are matched only where the share is reached.
    told = F.when(F.col("containment") >= CONTAINED, F.regexp_like("said", F.col("key"))).otherwise(F.lit(False))
    return met.withColumn("containment", share).where(told).groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
