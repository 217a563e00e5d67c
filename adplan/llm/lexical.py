"""Ranked lexical search: posting lists blocked by document similarity, exact bounds from block maxima."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adplan.llm.common import settle

#: Documents and postings of a shard, documents of a block, dimensions in which documents are compared.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, DIMENSIONS = 16_384, 4_000_000, 64, 16
#: About so many documents are scored in full beforehand; what they score bounds the search from below.
SAMPLE = 16_384
#: Items that share a pass over the documents have about so many terms together.
ITEM_TERMS = 200_000

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: str) -> list[str]:
    """The terms of a text in order: runs of ASCII letters, digits and any other characters; A-Z in lower case."""
    return _TERM.findall(text.encode().translate(_LOWER).decode())


@dataclass
class Items:
    """Queries of one pass: their terms by number, in the order of `terms`."""

    ids: list
    terms: list[str]
    held: list[np.ndarray]

    def beside(self) -> dict[int, np.ndarray]:
        """For each term the terms of the items that hold it: the coordinates its bounds need."""
        out: dict[int, set] = {}
        for own in self.held:
            for t in own.tolist():
                out.setdefault(t, set()).update(own.tolist())
        return {t: np.array(sorted(s)) for t, s in out.items()}


@dataclass
class Weights:
    """Collection counts, and what follows from them for the terms of the items."""

    n_docs: int
    n_terms: int
    weight: np.ndarray
    most: np.ndarray

    def part(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A term's share of a document's score, before its weight."""
        m = 100 - 50 + (50 * length * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def item_terms(queries: DataFrame, item: str) -> DataFrame:
    """item_id, term: the distinct terms of each item (rows of one item together; null items are one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([t for f in found for t in f], pa.string())], names=["item_id", "term"])

    rows = queries.select(F.col(item).alias("item_id"), "text").where("text is not null")
    return rows.mapInArrow(run, f"item_id {dict(rows.dtypes)['item_id']}, term string").distinct()


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """shard, place in it, doc_id, n (all terms with repeats), terms (numbers, ascending) and tfs of the documents
    with a term. Documents that follow each other in a task make up shards of bounded size.
    """
    number = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, postings = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            shards, places, rows, ns, ends, own, tfs = [], [], [], [], [0], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                hits = sorted((number[t], k) for t, k in Counter(found).items() if t in number)
                if held >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    shard, held, postings = shard + 1, 0, 0
                shards.append(shard)
                places.append(held)
                held, postings = held + 1, postings + len(hits)
                rows.append(row)
                ns.append(len(found))
                own += [t for t, _ in hits]
                tfs += [k for _, k in hits]
                ends.append(len(own))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array(places, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(own, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))],
                names=["shard", "place", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.mapInArrow(run, "shard long, place int, doc_id long, n long, terms array<int>, tfs array<int>")


def weigh(found: DataFrame, terms: list[str]) -> Weights:
    """Counts over all documents; per term its weight and the largest part any document gives it."""
    total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(total[0]), int(total[1])
    m = F.lit(100 - 50) + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L")
    posts = found.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("m", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))
    per = posts.groupBy("term").agg(F.count("*").alias("df"), F.max(F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")).alias("most"))
    weight, most = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for r in per.toLocalIterator():  # one row per term of the items
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        most[r.term] = r.most
    return Weights(n_docs, n_terms, weight, most)


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class Shard:
    """Documents of a shard, by doc_id and place, as arrays: where their postings start, terms and parts."""

    def __init__(self, rows: pa.Table, weights: Weights):
        rows = rows.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        own, n = _column(rows, "terms"), _column(rows, "n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = _column(rows, "doc_id")
        self.size = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.size) - self.size
        self.terms = _flat(own)
        self.parts = weights.part(_flat(_column(rows, "tfs")), np.repeat(n, self.size))

    def places(self, docs: np.ndarray) -> np.ndarray:
        """Places of all postings of the documents, one document after the other."""
        size = self.size[docs]
        ends = np.cumsum(size)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - size), size)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents that hold a posting each."""
        at = self.places(docs)
        size = self.size[docs]
        return np.add.reduceat(weight[self.terms[at]] * self.parts[at], np.cumsum(size) - size) if len(docs) else np.zeros(0, np.int64)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents in the order of their terms, and where each list starts: the posting lists."""
        order = np.argsort(self.terms, kind="stable")
        docs = np.repeat(np.arange(len(self.size)), self.size)[order]
        return docs, order

    def compared(self, weight: np.ndarray) -> np.ndarray:
        """Each document in a few dimensions: random projections of its weighted, normed vector."""
        signs = np.random.default_rng(11).choice(np.array([-1.0, 1.0], np.float32), (DIMENSIONS, len(weight)))
        value = (weight[self.terms] * self.parts).astype(np.float64)
        held = self.size > 0
        starts = self.starts[held]
        out = np.zeros((len(self.size), DIMENSIONS))
        if len(starts):
            norm = np.sqrt(np.add.reduceat(value * value, starts)) + 1e-9
            for d in range(DIMENSIONS):
                out[held, d] = np.add.reduceat(value * signs[d][self.terms], starts) / norm
        return out


def clustered(docs: np.ndarray, points: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Blocks of similar documents: a list is halved where its documents differ most, until they are small."""
    waiting = [docs]
    while waiting:
        some = waiting.pop()
        if len(some) <= size:
            yield some
            continue
        own = points[some]
        order = np.argsort(own[:, own.var(axis=0).argmax()], kind="stable")
        half = len(order) // 2
        waiting += [some[order[:half]], some[order[half:]]]


def index(found: DataFrame, items: Items, weights: Weights, wanted: np.ndarray, block_size: int = BLOCK) -> DataFrame:
    """shard, term, docs (places in the shard), coords, maxima: blocks of the wanted terms' posting lists.

    A block's summary has, for each term that stands beside its own in an item, the largest part that any
    of its documents gives that term.
    """
    beside = items.beside()
    listed = np.zeros(len(items.terms), bool)
    listed[wanted] = True

    def build(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, weights)
        docs, order = shard.lists()
        terms = shard.terms[order]
        starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, int)
        points = shard.compared(weights.weight)
        spot = np.full(len(items.terms), -1)
        out_term, out_docs, out_coords, out_maxima = [], [], [], []
        for start, end in zip(starts, np.r_[starts, len(terms)][1:], strict=True):
            t = int(terms[start])
            if not listed[t]:
                continue
            coords = beside[t]
            spot[coords] = np.arange(len(coords))
            blocks = list(clustered(docs[start:end], points, block_size))
            members = np.concatenate(blocks)
            at = shard.places(members)
            block = np.repeat(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]), shard.size[members])
            place = spot[shard.terms[at]]
            inside = place >= 0
            most = np.zeros(len(blocks) * len(coords), np.int32)
            np.maximum.at(most, block[inside] * len(coords) + place[inside], shard.parts[at][inside].astype(np.int32))
            for b, row in zip(blocks, most.reshape(len(blocks), -1), strict=True):
                held = np.flatnonzero(row)
                out_term.append(t)
                out_docs.append(b.astype(np.int32))
                out_coords.append(coords[held].astype(np.int32))
                out_maxima.append(row[held])
            spot[coords] = -1
        first = rows.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([first] * len(out_term), pa.int64()), "term": pa.array(out_term, pa.int32()), "docs": _lists(out_docs),
                         "coords": _lists(out_coords), "maxima": _lists(out_maxima)})

    return found.groupBy("shard").applyInArrow(build, "shard long, term int, docs array<int>, coords array<int>, maxima array<int>")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def floors(sample: DataFrame, items: Items, weights: Weights, k: int) -> np.ndarray:
    """What the k-th of some documents scores for each item, 1 where fewer score: no lower score can be among the k."""

    def run(rows: pa.Table) -> pa.Table:
        shard = Shard(rows, weights)
        docs, order = shard.lists()
        terms = shard.terms[order]
        numbers, least = [], []
        for i, own in enumerate(items.held):
            score = np.zeros(len(shard.size), np.int64)
            for t, a, b in zip(own, np.searchsorted(terms, own), np.searchsorted(terms, own, "right"), strict=True):
                score[docs[a:b]] += weights.weight[t] * shard.parts[order[a:b]]
            if len(score) >= k:
                numbers.append(i)
                least.append(int(np.partition(score, len(score) - k)[len(score) - k]))
        return pa.table({"item": pa.array(numbers, pa.int32()), "least": pa.array(least, pa.int64())})

    out = np.ones(len(items.held), np.int64)
    for r in sample.withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(run, "item int, least long").collect():
        out[r.item] = max(1, r.least)
    return out


def essential(items: Items, weights: Weights, least: np.ndarray) -> list[np.ndarray]:
    """The terms of each item without which no document reaches its floor."""
    out = []
    for own, floor in zip(items.held, least, strict=True):
        bound = weights.weight[own] * weights.most[own]
        order = np.argsort(bound, kind="stable")
        out.append(own[order[np.cumsum(bound[order]) >= floor]])
    return out


def answer(found: DataFrame, blocks: DataFrame, items: Items, weights: Weights, asked: list[np.ndarray], least: np.ndarray, k: int) -> DataFrame:
    """item (number), doc_id, score: the k best of each shard for each item, as far as they reach its floor."""

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        shard = Shard(rows, weights)
        own = own.sort_by("term")
        term = _column(own, "term").to_numpy(zero_copy_only=False)
        docs, coords, maxima = (_flat(_column(own, c)) for c in ("docs", "coords", "maxima"))
        doc_ends, coord_ends = (np.r_[0, np.cumsum(_column(own, c).value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64) for c in ("docs", "coords"))
        weight = np.zeros(len(items.terms), np.int64)
        seen = np.zeros(len(shard.size), bool)
        numbers, ids, values = [], [], []
        for i, lists in enumerate(asked):
            weight[items.held[i]] = weights.weight[items.held[i]]
            at, bounds = [], []
            for a, b in zip(np.searchsorted(term, lists), np.searchsorted(term, lists, "right"), strict=True):
                if a < b:
                    lo, hi = coord_ends[a], coord_ends[b]
                    bounds.append(np.add.reduceat(weight[coords[lo:hi]] * maxima[lo:hi], coord_ends[a:b] - lo))
                    at.append(np.arange(a, b))
            best, scored = np.zeros(0, int), np.zeros(0, np.int64)
            floor = int(least[i])
            if at:
                at, bounds = np.concatenate(at), np.concatenate(bounds)
                order = np.argsort(-bounds, kind="stable")
                at, bounds = at[order], bounds[order]
                next_, wave = 0, 8
                # Blocks by falling bound: the first whose bound is under the floor ends the search.
                while next_ < len(at) and bounds[next_] >= floor:
                    some = at[next_:next_ + wave][bounds[next_:next_ + wave] >= floor]
                    next_, wave = next_ + wave, 2 * wave
                    fresh = np.unique(np.concatenate([docs[doc_ends[b]:doc_ends[b + 1]] for b in some]))
                    fresh = fresh[~seen[fresh]]
                    seen[fresh] = True
                    score = shard.scores(fresh, weight)
                    best, scored = np.r_[best, fresh[score >= floor]], np.r_[scored, score[score >= floor]]
                    if len(best) > k:
                        # Documents are numbered by doc_id: of equal scores the smaller number is first.
                        keep = np.lexsort((best, -scored))[:k]
                        best, scored = best[keep], scored[keep]
                    if len(best) == k:
                        floor = max(floor, int(scored.min()))
                seen[:] = False
            weight[items.held[i]] = 0
            numbers += [i] * len(best)
            ids.append(best)
            values.append(scored)
        every = np.concatenate(ids) if ids else np.zeros(0, int)
        return pa.table({"item": pa.array(numbers, pa.int32()), "doc_id": shard.ids.take(pa.array(every.astype(np.int64))),
                         "score": pa.array(np.concatenate(values) if values else [], pa.int64())})

    return found.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 50, item: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id integer, text) with a score above 0 for each item.

    The scores are those of the formula in the README, in whole numbers. Equal scores rank by doc_id, null
    ones last. Rows that repeat a doc_id are documents of their own; rows that repeat an item are one item.
    Null and empty texts have no terms: such documents don't count and such items have no rows. Extra columns
    are ignored; an empty table gives no rows.

    Every document is indexed, in shards that a task can hold. In a shard each item term has a posting
    list, cut into blocks of similar documents with coordinatewise maxima of their parts. What a sample
    of documents scores gives each item a floor. Terms that together cannot reach it need no list; a
    block is skipped only where the bound from its maxima is under the floor, which rises as k documents are
    found. Items go through the documents in sets of about ITEM_TERMS terms.
    """
    asked = settle(item_terms(queries, item), "item-terms")
    sets = 1 + asked.count() // ITEM_TERMS
    out = None
    for at in range(sets):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == at)
        out = _ranked(docs, mine, k) if out is None else out.unionByName(_ranked(docs, mine, k))
    return out


def _ranked(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    held: dict = {}
    for r in asked.toLocalIterator():
        held.setdefault(r.item_id, []).append(r.term)
    terms = sorted({t for own in held.values() for t in own})
    number = {t: i for i, t in enumerate(terms)}
    items = Items(list(held), terms, [np.array(sorted(number[t] for t in own)) for own in held.values()])
    found = settle(vectors(docs, terms), "vectors")
    weights = weigh(found, terms)
    some = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, weights.n_docs // SAMPLE))) == 0
    least = floors(found.where(some).limit(2 * SAMPLE), items, weights, k)
    wanted = essential(items, weights, least)
    blocks = settle(index(found, items, weights, np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, int)), "blocks")
    best = answer(found, blocks, items, weights, wanted, least, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {dict(asked.dtypes)['item_id']}")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
