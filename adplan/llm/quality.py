"""Text statistics and learned decision lists, both as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adplan.llm.common import SPACES, let

#: Labelled rows that a list is learned from, at most.
LABELLED_ROWS = 20_000
#: Thresholds tried per statistic, conditions per rule, rules per list.
CUTS, CONDITIONS, RULES = 24, 3, 8
#: Share of rejected rows that must be truly bad among the rows kept back for pruning.
PRECISION = 0.95

FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"), "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}


def text_statistics(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, and counts of each whole text.

    Null and empty texts count 0 everywhere. Repeated rows give repeated rows; an empty table
    gives none. Columns of docs that are neither doc_id, text nor in extra are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *extra, text.alias("_t"), F.array_remove(F.split(text, SPACES), "").alias("_w"),
                       F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    kept = lambda regex: F.char_length(F.regexp_replace("_t", regex, "")).cast("long")
    windows = F.when(F.size("_w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    # Generators keep Catalyst from copying these expressions into filters and lambda bodies.
    counted = base.select("doc_id", *extra, F.inline(F.array(F.struct(
        F.size("_w").cast("long").alias("n_words"), kept(SPACES).alias("word_chars"),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"), kept(r"\P{Lu}+").alias("n_upper"), kept(r"[^!?.,;:]+").alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("_h")))))
    repeats = F.when(F.size("_h") == F.size(F.array_distinct("_h")), F.lit(0)).otherwise(_covered(F.col("_h")))
    return counted.select("*", F.inline(F.array(F.struct(repeats.cast("long").alias("n_repeat_words"))))).drop("_h")


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a.h == b.h, F.lit(False))
    twice = let(ordered, lambda o: F.filter(
        o, lambda x, k: same(F.get(o, k + 1), x) | (F.when(k > 0, same(F.get(o, k - 1), x)).otherwise(F.lit(False)))))
    at = F.sort_array(F.transform(twice, lambda x: x.i))
    # Each window adds three words but those that the window before it has added.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(at, start, lambda a, i: F.struct(
        i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")), lambda a: a.n)


def base_failed() -> Column:
    """The fixed rule: fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    """stats with the shares that rules look at; 0 where there is nothing to share."""
    return stats.withColumns({name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
                              for name, (a, b) in FEATURES.items()})


@dataclass(frozen=True)
class Rule:
    """Rejects rows that meet all conditions (statistic, ">=" or "<=", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (F.col(name) >= at if sign == ">=" else F.col(name) <= at)
        return out

    def meets(self, row: dict) -> bool:
        return all(row[n] >= t if s == ">=" else row[n] <= t for n, s, t in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules; the first that fits rejects, rows that none fits are kept."""

    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        """The ordered conditional expression: the number of the first rule that fits, else null."""
        out = None
        for k, rule in enumerate(self.rules):
            out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
        return F.lit(None).cast("int") if out is None else out


def learn(rows: list[dict], names: list[str] | None = None) -> DecisionList:
    """Sequential covering over rows with the statistics and `bad` (bool).

    Every third row (by position) is kept back. A rule grows by the condition of the largest
    information gain, loses trailing conditions while that doesn't hurt it on the rows kept
    back, and joins the list if it is precise there; rows it covers are then set aside.
    """
    names = names or list(FEATURES)
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    cuts = {}
    for n in names:
        values = sorted(r[n] for r in grow)
        bad = sorted(r[n] for r in grow if r["bad"])
        both = [v for x in (values, bad) if x for v in (x[(len(x) - 1) * k // CUTS] for k in range(CUTS + 1))]
        cuts[n] = sorted(set(both))
    found = DecisionList()

    def counts(data: list[dict]) -> tuple[int, int]:
        p = sum(r["bad"] for r in data)
        return p, len(data) - p

    while len(found.rules) < RULES and any(r["bad"] for r in grow):
        covered, conditions = grow, []
        while len(conditions) < CONDITIONS and counts(covered)[1]:
            p0, n0 = counts(covered)
            best, gain = None, 0.0
            for name in names:
                ordered = sorted((r[name], r["bad"]) for r in covered)
                for sign in (">=", "<="):
                    walk = ordered[::-1] if sign == ">=" else ordered
                    p = n = k = 0
                    for at in (cuts[name][::-1] if sign == ">=" else cuts[name]):
                        while k < len(walk) and (walk[k][0] >= at if sign == ">=" else walk[k][0] <= at):
                            p, n, k = p + walk[k][1], n + (not walk[k][1]), k + 1
                        if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain + 1e-9:
                            best, gain = (name, sign, at), g
            if best is None:
                break
            conditions.append(best)
            covered = [r for r in covered if Rule((best,)).meets(r)]

        def worth(cond: list, data: list[dict]) -> float:
            p, n = counts([r for r in data if Rule(tuple(cond)).meets(r)])
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1], prune) >= worth(conditions, prune):
            conditions.pop()
        if not conditions or (worth(conditions, prune) + 1) / 2 < PRECISION:
            break
        rule = Rule(tuple(conditions))
        found.rules.append(rule)
        grow, prune = ([r for r in part if not rule.meets(r)] for part in (grow, prune))
    return found


def learn_list(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DecisionList:
    """The list learned from at most `most` labelled documents, those with the smallest hashes of doc_id.

    Labels without a quality or a doc_id are not used; of several for a document the worst
    counts. Without any labelled row the list is empty.
    """
    sample = (labels.where("quality is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # bounds what is broadcast and collected
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = features(text_statistics(known, ("_quality",))).select("doc_id", "_quality", *FEATURES)
    ordered = rows.orderBy(F.xxhash64("doc_id"), *FEATURES).limit(most)
    return learn([r.asDict() | {"bad": r["_quality"] == 0} for r in ordered.collect()])


def quality_verdicts(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS,
                     extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, statistics, base_failed, rule (null: none fits), kept for every row of docs.

    Repeated rows are judged each. An empty table gives no rows.
    """
    rules = learn_list(docs, labels, most)
    judged = features(text_statistics(docs, extra)).withColumns(
        {"base_failed": base_failed(), "rule": rules.column()})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
