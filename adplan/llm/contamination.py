"""Benchmark passages in documents: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a gram; edits allowed as a share of a passage's bytes.
Q, EDITS = 6, 0.12
#: Bytes of passages that one scan looks for; more passages take more scans.
SCAN_BYTES = 8 << 20
#: Bytes of text that are searched at a time, and hits of grams that are listed at a time.
CHUNK_BYTES, HITS = 1 << 20, 1 << 20
#: Passages of fewer bytes say too little to mark a document.
LEAST = 20
#: Stands between texts; no byte of UTF-8.
GAP = 0xFF

_FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = 22


def fold(text: str) -> bytes:
    """Text as compared: UTF-8, A-Z in lower case, white space as blanks."""
    return text.encode("utf-8", "replace").translate(_FOLD)


def budget(length: int) -> int:
    """Edits a passage may have. Its floor(length / Q) disjoint grams lose one an edit at most, so
    length // Q - budget of them are found in a text that holds it; at least one must be left."""
    return max(0, min(int(EDITS * length), length // Q - 1))


def _codes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(data) - Q + 1), np.uint64)
    for k in range(Q):
        out = out << np.uint64(8) | data[k:len(out) + k]
    return out


class Passages:
    """Grams of a set of passages."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        kept = [(i, t) for i, t in ((i, fold(t)) for i, t in items) if len(t) >= LEAST]
        self.ids, self.texts = [i for i, _ in kept], [np.frombuffer(t, np.uint8) for _, t in kept]
        self.edits = np.array([budget(len(t)) for t in self.texts], np.int64)
        self.bound = np.array([len(t) // Q for t in self.texts], np.int64) - self.edits
        code, item, place = [], [], []
        for n, t in enumerate(self.texts):
            own = _codes(t)[::Q]
            code.append(own)
            item.append(np.full(len(own), n))
            place.append(np.arange(len(own)) * Q)
        code, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (code, item, place))
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.codes.astype(np.uint64))] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, band and shared grams of all bands of data that meet the bound. Bands are twice the
        edit budget wide and start at every multiple of it, so one holds all grams of a match.

        Hits are listed some at a time; what is kept of them is one key for each gram of a passage that a band
        shares, which grows with the text alone, however often a gram repeats.
        """
        code = _codes(data)
        at = np.flatnonzero(self.seen[self._slot(code)])
        found = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        good = self.codes[found] == code[at]
        at, found = at[good], found[good]
        step = np.maximum(1, self.edits)
        before = int(max(len(t) // k for t, k in zip(self.texts, step, strict=True))) + 2  # bands that start ahead of the data
        bands, places = len(data) // int(step.min()) + 2 * before, max(len(t) for t in self.texts) // Q + 1
        upto, cuts = np.cumsum(self.count[found]), [0]
        while cuts[-1] < len(at):
            done = upto[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, done + HITS, "right"))))

        def hits(begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = self.count[found[begin:end]]
            hit = np.repeat(self.first[found[begin:end]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, place = self.item[hit], self.place[hit]
            # Doubles divide these small whole numbers exactly enough for the floor, and faster.
            band = np.floor((np.repeat(at[begin:end], n) - place) / step[item]).astype(np.int64)
            return item * bands + band + before, item, place

        # Hits a band, by hash: most bands fall short of the bound with all of their hits, and need no second look.
        full, last = np.zeros(1 << _BITS, np.int64), None
        for begin, end in zip(cuts, cuts[1:], strict=False):
            last = hits(begin, end)
            for g in (last[0], last[0] - 1):
                full += np.bincount(self._slot(g.astype(np.uint64)).astype(np.int64), minlength=len(full))
        keys = []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            g, item, place = last if len(cuts) == 2 else hits(begin, end)
            for group in (g, g - 1):
                keep = full[self._slot(group.astype(np.uint64)).astype(np.int64)] >= self.bound[item]
                keys.append(np.unique(group[keep] * places + place[keep] // Q))
        key = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0] if keys else np.zeros(0, np.int64)
        group, shared = np.unique(key // places, return_counts=True) if len(key) else (key, key)
        item = group // bands
        keep = shared >= self.bound[item]
        return item[keep], (group % bands - before)[keep], shared[keep]

    def align(self, data: np.ndarray, n: int, bands: np.ndarray) -> np.ndarray:
        """Least edits between passage n and any stretch of data on each band's diagonals."""
        k, text = int(self.edits[n]), self.texts[n]
        step, width = max(1, k), 2 * max(1, k) + 2 * k + 1
        padded = np.r_[np.full(width, GAP, np.uint8), data, np.full(len(text) + 2 * width, GAP, np.uint8)]
        start = bands * step - k + width  # diagonal of the first cell, in padded places
        start = np.clip(start, 0, len(padded) - len(text) - width)
        cost = np.zeros((len(bands), width), np.int32)
        index, cells = np.arange(width, dtype=np.int32), np.arange(width)
        for i, byte in enumerate(text):
            seen = padded[start[:, None] + i + cells[None, :]]
            across = cost + (seen != byte)
            across[:, :-1] = np.minimum(across[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(across - index, axis=1) + index
        return cost.min(axis=1)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, shared_grams: one row for each pair whose document holds the passage
    with at most budget(length) edits (bytes of folded text), anywhere in the whole text.

    Null and empty texts hold nothing. Passages shorter than LEAST bytes are never found. No match spans two
    documents: between texts stand more bytes than any passage may have edits. Texts longer than CHUNK_BYTES
    are searched in stretches that overlap by more than a passage with its edits. Of repeated
    rows of a doc_id (or an item_id) the best match counts; null ids stay null. Extra columns are
    ignored; empty tables give no rows. The passages are the stated query set: they travel to
    all tasks in blocks of about SCAN_BYTES, one scan each.
    """
    items = benchmark.where("text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scans = size // SCAN_BYTES + 1
    schema = docs.select("doc_id").schema.add("item_id", "long").add("edits", "long").add("shared_grams", "long")
    out = None
    for scan in range(scans):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == scan).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages = Passages(shared.value)
            if not passages.ids:
                return
            most = max(len(t) for t in passages.texts) + 4 * int(passages.edits.max()) + Q
            for batch in batches:
                pieces = []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    folded = fold(text) if text else b""
                    pieces += [(row, folded[at:at + CHUNK_BYTES + most]) for at in range(0, max(1, len(folded) - most), CHUNK_BYTES)]
                at = 0
                while at < len(pieces):
                    begin, held = at, 0
                    while at < len(pieces) and (at == begin or held + len(pieces[at][1]) <= CHUNK_BYTES):
                        held += len(pieces[at][1])
                        at += 1
                    yield search(passages, batch.column("doc_id"), pieces[begin:at])

        def search(passages: Passages, ids: pa.Array, pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
            gap = bytes([GAP]) * max(64, int(passages.edits.max()) + 1)
            data = np.frombuffer(gap.join(t for _, t in pieces), np.uint8)
            starts = np.cumsum([0] + [len(t) + len(gap) for _, t in pieces])[:-1]
            item, band, shared_grams = passages.regions(data)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for n in np.unique(item):
                mine = np.flatnonzero(item == n)
                for part in np.array_split(mine, len(mine) // 256 + 1):
                    edits = passages.align(data, int(n), band[part])
                    for k, e in zip(part, edits, strict=True):
                        if e <= passages.edits[n]:
                            middle = band[k] * max(1, passages.edits[n]) + len(passages.texts[n]) // 2 + passages.edits[n]
                            doc = max(0, int(np.searchsorted(starts, middle, "right")) - 1)
                            key = (pieces[doc][0], int(n))
                            best[key] = min(best.get(key, (1 << 30, 0)), (int(e), -int(shared_grams[k])))
            rows = sorted(best)
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array([d for d, _ in rows], pa.int64())), pa.array([passages.ids[n] for _, n in rows], pa.int64()),
                 pa.array([best[r][0] for r in rows], pa.int64()), pa.array([-best[r][1] for r in rows], pa.int64())],
                names=["doc_id", "item_id", "edits", "shared_grams"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("shared_grams").alias("shared_grams"))
