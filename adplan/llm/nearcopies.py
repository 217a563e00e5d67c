"""Near-duplicate documents: SetSketch registers, banded; joint likelihood; exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.llm.common import settle

#: Registers per sketch, registers per band: at a similarity of 0.8 a pair misses all bands once in 10^7.
REGISTERS, ROWS = 128, 4
#: Base of the exponential spacing, rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: A pair whose estimated similarity lies this far below the threshold is not verified: over 5 deviations.
SLACK = 0.2
#: Rows of a bucket that meet in one block, rows of blocks that share a call, shingles of either, pairs
#: estimated at a time, and pairs of one centre that share a task.
PART, BUNDLE, HASHES, AT_ONCE, SPREAD = 1000, 4000, 1_000_000, 65_536, 1000

_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_MUL = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; fewer words count as one shingle."""
    b = np.frombuffer((text or "").encode("utf-8", "replace").translate(_LOWER), np.uint8)
    inside = ~_SPACE[b]
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]]) if len(b) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, np.uint64)
    # A word's hash is a polynomial in its bytes, added up from its start to the next word's.
    offset = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
    power = np.cumprod(np.full(int(offset.max()) + 1, _P, np.uint64))
    values = np.where(inside[starts[0]:], _BYTE[b[starts[0]:]] * power[offset], np.uint64(0))
    words = _mix(np.add.reduceat(values, starts - starts[0]))
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mix(h * _P + words[i:len(words) - n + 1 + i])
    return np.unique(h)


def registers(h: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes: the least of each register's draws, on an exponential scale."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[None, at:at + 4096] * _MUL + _ADD
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part ^= part >> np.uint32(13)
        least = np.minimum(least, part.min(axis=1))
    draw = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity for rows of two register arrays and the sets' sizes: from how many
    registers of the one are larger, smaller and equal, over a grid of similarities."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p, q = np.clip(u - v * j, 1e-9, 1), np.clip(v - u * j, 1e-9, 1)
    same = np.clip(1 - p - q, 1e-9, 1)
    likely = more * np.log(p) + less * np.log(q) + (REGISTERS - more - less) * np.log(same)
    return j[np.arange(len(j)), likely.argmax(axis=1)]


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether `estimate` reaches `least`, for rows of two register arrays and the sets' sizes.

    The joint likelihood is concave in the similarity, so its peak lies at `least` or beyond where
    its slope there isn't negative.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = na / (na + nb)
    v = 1 - u
    p, q = u - v * least, v - u * least
    slope = (REGISTERS - more - less) / least - more * v / np.maximum(p, 1e-9) - less * u / np.maximum(q, 1e-9)
    return (p > 0) & (q > 0) & (slope >= 0)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id (binary; equal sets, equal ids; null: empty), regs (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(t, k) for t in batch.column("text").to_pylist())
            n, ids, regs = [], [], []
            for s in sets:
                n.append(len(s))
                ids.append(_set_id(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.binary())],
                                             names=["doc_id", "n_shingles", "set_id", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, regs binary")


def _set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def full_sets(wanted: DataFrame, sets: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """rep, hashes (binary, sorted 64-bit shingle hashes): once per wanted set, from a text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, hashes = [], []
            for rep, set_id, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "set_id", "text")), strict=True):
                s = shingles(text, k)
                if _set_id(s) == set_id:  # further texts of the id have sets of their own
                    reps.append(rep)
                    hashes.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(hashes, pa.binary())], names=["rep", "hashes"])

    named = sets.select("rep", "first", "set_id").join(wanted.select("rep").distinct(), "rep")
    texts = named.join(docs.select(F.col("doc_id").cast("long").alias("first"), "text"), "first").select("rep", "set_id", "text")
    return texts.mapInArrow(run, "rep long, hashes binary").dropDuplicates(["rep"])


def star_pairs(shared: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """At most one pair a, b for each set b: with the centre (smallest set of a bucket) that shares most
    buckets with it, if sizes and registers allow the threshold."""

    @F.pandas_udf("boolean")
    def joint(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        return pd.Series(plausible(_stack(x), _stack(y), nx.to_numpy(float), ny.to_numpy(float), threshold - SLACK))

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("regs").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    nearest = (shared.where("a <> rep").groupBy("rep", "a").agg(F.count("*").alias("both"))
               .groupBy("rep").agg(F.max(F.struct("both", (-F.col("a")).alias("a"))).alias("top")).select((-F.col("top.a")).alias("a"), F.col("rep").alias("b")))
    both = nearest.join(side("b"), "b").join(side("a"), "a").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return both.where(joint("ra", "rb", "na", "nb")).select("a", "b")


def star_links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b of the first documents of those pairs of sets whose full sets reach the similarity.

    A centre's set is repeated once for each SPREAD of its pairs, so no task holds a hot centre's pairs.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    whole = settle(full_sets(ends, sets, docs, k).join(sets.select("rep", "first"), "rep"), "near-sets")
    side = lambda c: whole.select(F.col("rep").alias(c), F.col("first").alias(f"f{c}"), F.col("hashes").alias(f"h{c}"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    centres = parts.join(side("a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    near = dealt.join(side("b"), "b").join(centres, ["a", "part"]).where(linked("ha", "hb"))
    return settle(near.where("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes in links a, b: labels of neighbours, then of labels."""
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = settle(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = settle(lower.join(jump, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels


def _stack(regs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(regs), np.uint16).reshape(len(regs), REGISTERS)


class Block:
    """Rows of several blocks that meet in one call, in the order of their blocks.

    Each has block, band, rep, component, regs, n, right (asks), left (is asked) and minor (outside the largest
    component of its bucket).
    """

    def __init__(self, rows: pd.DataFrame, threshold: float) -> None:
        rows = rows.sort_values(["block", "rep"])
        self.block, self.band, self.rep, self.right, self.left, self.minor, self.component, self.n = (
            rows[c].to_numpy() for c in ("block", "band", "rep", "right", "left", "minor", "component", "n"))
        self.regs, self.n, self.threshold = _stack(rows.regs), self.n.astype(float), threshold
        self.bands = self.regs.view(np.uint64)  # ROWS registers of 16 bits
        self.component, self.rows = self.component.copy(), rows

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i, j of likely pairs in different components, in bounded steps; each pair of sets
        only in the first band in which its registers agree."""
        starts = np.r_[np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]]), len(self.block)]
        lefts, rights, waiting = [], [], 0
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            own = np.arange(start, end)
            a, b = own[self.left[own]], own[self.right[own]]
            step = max(1, AT_ONCE // max(1, len(a)))
            for at in range(0, len(b), step):
                c = b[at:at + step, None]
                other = (self.component[a] != self.component[c]) & (np.minimum(self.n[a], self.n[c]) >= self.threshold * np.maximum(self.n[a], self.n[c]))
                # Where both may ask each other, the larger one does.
                other &= (self.rep[a] < self.rep[c]) | ~(self.right[a] | self.minor[a])
                j, i = np.nonzero(other)
                lefts.append(a[i])
                rights.append(c[j, 0])
                waiting += len(i)
                if waiting >= AT_ONCE:
                    yield self.weigh(np.concatenate(lefts), np.concatenate(rights))
                    lefts, rights, waiting = [], [], 0
        if waiting:
            yield self.weigh(np.concatenate(lefts), np.concatenate(rights))

    def weigh(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = self.bands[i] == self.bands[j]
        here = (same.argmax(axis=1) == self.band[i]) & same[np.arange(len(i)), self.band[i]]
        i, j = i[here], j[here]
        good = plausible(self.regs[i], self.regs[j], self.n[i], self.n[j], self.threshold - SLACK)
        return i[good], j[good]


def asked_for(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of a call that have a likely partner in another component."""
    block = Block(rows, threshold)
    wanted = np.zeros(len(rows), bool)
    for i, j in block.pairs():
        wanted[i] = wanted[j] = True
    return block.rows[wanted][["bundle", "block", "band", "rep", "first", "component", "right", "left", "minor"]]


def verified(rows: pd.DataFrame, threshold: float, percent: int) -> pd.DataFrame:
    """Links a, b between first documents that bring the components of a call together: full sets
    decide each likely pair, unless links found before join its two components."""
    block = Block(rows, threshold)
    hashes = [np.frombuffer(h, np.uint64) for h in block.rows.hashes]
    sizes = np.array([len(h) for h in hashes])
    starts = np.r_[0, np.cumsum(sizes)]
    code = np.unique(np.concatenate(hashes), return_inverse=True)[1].reshape(-1)
    own, first, out = np.zeros(code.max() + 1, bool), block.rows["first"].to_numpy(), []
    for left, right in block.pairs():
        order = np.argsort(right, kind="stable")
        left, right = left[order], right[order]
        at = np.r_[np.flatnonzero(np.r_[True, right[1:] != right[:-1]]), len(right)] if len(right) else []
        for s, e in zip(at[:-1], at[1:], strict=True):
            j, i = right[s], left[s:e]
            i = i[block.component[i] != block.component[j]]
            own[code[starts[j]:starts[j + 1]]] = True
            for chunk in np.array_split(i, 1 + int(sizes[i].sum()) // HASHES):
                if not len(chunk):
                    continue
                ends = np.cumsum(sizes[chunk])
                places = np.arange(ends[-1]) + np.repeat(starts[chunk] - (ends - sizes[chunk]), sizes[chunk])
                both = np.add.reduceat(own[code[places]].astype(np.int64), ends - sizes[chunk])
                for x in chunk[(both > 0) & (100 * both >= percent * (sizes[chunk] + sizes[j] - both))]:
                    if block.component[x] != block.component[j]:
                        out.append((first[x], first[j]))
                        block.component[block.component == block.component[x]] = block.component[j]
            own[code[starts[j]:starts[j + 1]]] = False
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def meet(shared: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int, across: bool) -> DataFrame | None:
    """Links between rows of a bucket that labels leave in different components; None without such buckets.

    A bucket of many rows or shingles is cut into parts. Each part is compared within itself or, with
    `across`, all rows with those outside the bucket's largest component, part by part. Calls share
    blocks up to about BUNDLE rows. Registers travel first; full sets only for rows that have a likely partner.
    """
    threshold = percent / 100
    placed = shared.join(labels.withColumnRenamed("node", "first"), "first", "left").select(
        "key", "band", "rep", "first", "n", F.coalesce("component", "first").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    mixed = per.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.max(F.struct("rows", "size", "component")).alias("top"), F.count("*").alias("groups"))
    weight = lambda rows, size: F.ceil(F.greatest(rows / F.lit(PART), size / F.lit(HASHES))).cast("int")
    mixed = mixed.where("groups > 1").select("key", F.col("top.component").alias("largest"), weight(F.col("rows"), F.col("size")).alias("parts"),
                                             weight(F.col("rows") - F.col("top.rows"), F.col("size") - F.col("top.size")).alias("owns"))
    mixed = settle(mixed.where("parts > 1") if across else mixed, "mixed")
    if mixed.isEmpty():
        return None
    rows = placed.join(mixed, "key").withColumn("minor", F.col("component") != F.col("largest"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    cols = ["key", "band", "rep", "first", "n", "component", "minor"]
    if across:
        own = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("owns"))
        asked = rows.select(*cols, F.lit(False).alias("right"), F.lit(True).alias("left"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("owns") - 1)).alias("own"))
        asking = rows.where("minor").select(*cols, F.lit(True).alias("right"), F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), own.alias("own"))
        rows = asked.unionByName(asking.select(asked.columns))
    else:
        rows = rows.select(*cols, F.lit(True).alias("right"), F.lit(True).alias("left"), part.alias("part"), F.lit(0).alias("own"))
    rows = settle(rows.withColumn("block", F.xxhash64("key", "part", "own")).drop("key", "part", "own"), "meeting")
    bundles = lambda n: F.pmod(F.xxhash64("block"), F.lit(1 + n))
    regs = sets.select("rep", "regs")
    cheap = "bundle long, block long, band int, rep long, first long, component long, right boolean, left boolean, minor boolean"

    def ask(block: pd.DataFrame) -> pd.DataFrame:
        return asked_for(block, threshold)

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        return verified(block, threshold, percent)

    met = rows.withColumn("bundle", bundles(rows.count() // BUNDLE)).join(regs, "rep").groupBy("bundle").applyInPandas(ask, cheap)
    wanted = settle(met.drop("bundle").join(sets.select("rep", "n"), "rep"), "wanted")
    size = wanted.agg(F.sum("n")).first()[0]
    if not size:
        return None
    whole = full_sets(wanted, sets, docs, k).join(regs, "rep")
    return settle(wanted.withColumn("bundle", bundles(size // HASHES)).join(whole, "rep").groupBy("bundle").applyInPandas(
        verify, "a long, b long").distinct(), "near-links")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one per row of docs (doc_id integer, text).

    Documents with 100 * common >= percent * all shingles are linked; components are what links
    reach. Documents of equal sets count as one before anything is compared. Each set is first
    compared with one centre; buckets of equal bands that still hold several components are then
    compared part by part, and those of several parts across their parts, all of them pairs that
    registers allow. Calls return links that join components only, so what moves grows with the
    rows, and a bucket's size costs no link. Empty and null texts, and rows without doc_id, link with nothing
    (component_id is the doc_id itself). Rows with words that repeat a doc_id share its component,
    whatever their texts: each set is compared by its own sketch, and sets that share a doc_id are
    linked. Extra columns are ignored; an empty table gives no rows.
    """
    sketched = settle(sketch(docs, k), "sketches")
    sets = settle(sketched.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("first"), F.min("regs").alias("regs"), F.min("n_shingles").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "sets")
    slices = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS).alias("r")) for i in range(REGISTERS // ROWS)])
    bands = sets.select("rep", "first", "n", F.explode(slices).alias("slice")).select(F.xxhash64("slice.i", "slice.r").alias("key"), F.col("slice.i").alias("band"), "rep", "first", "n")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    shared = settle(bands.join(buckets, "key").select("key", "band", "rep", "first", "n", "a"), "buckets")
    # Sets that share a doc_id, through the smallest first document among them; most ids have one set.
    holders = sketched.where("doc_id is not null").join(sets.select("set_id", "first"), "set_id").select("doc_id", "first").distinct()
    several = holders.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("most")).where("a <> most").select("doc_id", "a")
    same_id = settle(holders.join(several, "doc_id").where("first <> a").select("a", F.col("first").alias("b")).distinct(), "same-id")
    links = star_links(settle(star_pairs(shared, sets, percent / 100), "pairs"), sets, docs, k, percent).union(same_id)
    labels = components(links)
    for across in (False, True):
        found = meet(shared, labels, sets, docs, k, percent, across)
        if found is not None and not found.isEmpty():
            links = links.union(found)
            labels = components(links)
    of_set = sets.join(labels.withColumnRenamed("node", "first"), "first", "left").select("set_id", F.coalesce("component", "first").alias("component_id"))
    out = sketched.join(of_set, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
