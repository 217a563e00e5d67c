"""Exact removal of repeated byte strings by a column-wise built Burrows-Wheeler transform.

A 50-byte string lies whole in one *piece*: the run of windows that share the smallest 32-byte
gram (the anchor) among their own. Equal strings have equal anchors, so pieces dealt out by
anchor bring all occurrences of a string together. Three passes over blocks of documents:

1. Blocks send the anchors they hold; anchors of one document only are out of the running.
2. Blocks send the distinct pieces around the others, each with its smallest document. Equal pieces
   are one. A string of 50 bytes reaches 9 or more beyond its anchor on one side, so a piece that
   agrees so far with no other piece has nothing to be compared with. Over all others of a deal a
   collection transform and common prefixes are built, one symbol per piece and round, and neighbours
   with a common prefix of 50 bytes are equal strings.
3. Blocks get back, for each window, the smallest document that holds it, and cut.
"""

from __future__ import annotations

import gc
import tempfile
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import count
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a string that counts as repeated; bytes of an anchor.
LENGTH, GRAM = 50, 32
#: Bytes by which a string reaches beyond its anchor on at least one side.
SIDE = (LENGTH - GRAM + 1) // 2
#: Bytes of text in a block of documents, about.
BLOCK_BYTES = 4 << 20
#: Windows whose anchors are sought at once, so that all arrays stay in the processor's cache.
STRETCH = 1 << 13
#: Low bits that a gram's place within a stretch takes in its sort key.
PLACE = np.uint64((1 << 16) - 1)
#: Pieces of one anchor from which on its windows are dealt out by their own bytes.
HOT_PIECES = 2000
#: Number of anchor codes; as a code, that of a window that was dealt out by its own bytes.
CODES = 1 << 24

_NONE = np.iinfo(np.int64).max
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@contextmanager
def no_collector() -> Iterator[None]:
    """Without the search for reference cycles, which many small objects would set off again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def anchors_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of data: the start of its anchor; for each gram: its hash. Data has fewer bytes than PLACE."""
    h = _TABLE[data]
    for k, odd in enumerate(_ODD):  # grams of 2, 4, 8, 16, 32 bytes
        step = 1 << k
        right = h[step:]
        mixed = right >> np.uint64(29)
        mixed ^= right
        mixed += h[:-step] * odd
        h = mixed
    h = _mix(h)
    # The leftmost smallest gram of each window, by doubling; the place in the low bits settles ties.
    best = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    return (best & PLACE).astype(np.int64), h


def pieces_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts that end at `ends` in data: first window, number of windows, text number, anchor's place in the piece and anchor hash of each piece."""
    whole = max(len(data) - LENGTH + 1, 0)
    begins = np.r_[0, ends[:-1]] if len(ends) else ends
    # Windows that lie in one text; those before them that don't.
    windows = np.maximum(ends - begins - LENGTH + 1, 0)
    edge = np.zeros(len(data) + 1, np.int8)
    some = windows > 0
    edge[begins[some]] += 1
    edge[begins[some] + windows[some]] -= 1
    inside = np.cumsum(edge, dtype=np.int8)[:whole].view(bool)
    new_text = edge == 1
    found, before = [], -1
    for i in range(0, whole, STRETCH):
        at, h = anchors_at(data[i:min(i + STRETCH, whole) + LENGTH - 1])
        first = np.empty(len(at), bool)
        first[0] = at[0] + i != before
        np.not_equal(at[1:], at[:-1], out=first[1:])
        first |= new_text[i:i + len(at)]
        first &= inside[i:i + len(at)]
        w = np.flatnonzero(first)
        found.append((w + i, at[w] - w, h[at[w]]))
        before = at[-1] + i
    if not some.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    start, offset, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(ends, start, side="right")
    # A piece ends where the next one of its text begins, or with the windows of the text.
    upto = np.minimum(np.r_[start[1:], whole], (begins + windows)[text])
    return start, upto - start, text, offset, anchor


def numbered(pieces: Iterable[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Numbers that equal pieces share, in order of first appearance, and the distinct pieces."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    return np.array([known[p] for p in pieces], np.int64), list(known)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of them, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Found(NamedTuple):
    """Distinct candidate strings of a block in one bucket, in order of codes, each with its code, its anchor's place and its smallest document; and of each occurrence number of the string, first window and document."""

    pieces: list[bytes]
    code: np.ndarray
    place: np.ndarray
    least: np.ndarray
    number: np.ndarray
    start: np.ndarray
    doc: np.ndarray


class Block:
    """The documents of one block, ordered by id, and their pieces."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("doc", "ascending"), ("row", "ascending")])
        self.docs = table["doc"].to_numpy()
        self.rows = table["row"]
        self.bytes = b"".join(table["text"].to_pylist())
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum(pc.binary_length(table["text"]).to_numpy(), dtype=np.int64)
        self.start, self.n, self.text, self.offset, self.anchor = pieces_of(self.data, self.ends)

    def anchors(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """bucket, codes (sorted, packed), for each: 128 if several documents hold it, plus its distinct pieces up to 127."""
        code, bucket = _split(self.anchor, buckets)
        key = bucket.astype(np.uint64) << np.uint64(32) | code
        order = np.argsort(key, kind="stable")  # pieces are in order of documents already
        k, d = key[order], self.docs[self.text][order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        last = np.r_[first[1:], len(k)].astype(int) - 1 if len(k) else first
        flags = (np.where(d[first] != d[last], 128, 0) + np.minimum(last - first + 1, 127)).astype(np.uint8)
        unique = k[first]
        of = (unique >> np.uint64(32)).astype(np.int64)
        for b in np.unique(of):
            mine = slice(*np.searchsorted(of, [b, b + 1]))
            yield int(b), pack_codes(unique[mine] & np.uint64(0xFFFFFFFF)), flags[mine].tobytes()

    @no_collector()
    def candidates(self, buckets: int, marks: dict[int, tuple[bytes, bytes]]) -> dict[int, Found]:
        """By bucket: the candidate strings and their occurrences, in order of documents; marks from pass 1."""
        code, bucket = _split(self.anchor, buckets)
        state = np.zeros(len(code), np.uint8)
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | code, kind="stable")
        sorted_buckets = bucket[order]
        for b, (codes, mark) in marks.items():
            mine = order[slice(*np.searchsorted(sorted_buckets, [b, b + 1]))]
            known, value = unpack_codes(codes), np.frombuffer(mark, np.uint8)
            at = np.minimum(np.searchsorted(known, code[mine].astype(np.int64)), len(known) - 1)
            state[mine] = np.where(known[at] == code[mine].astype(np.int64), value[at], 0)
        cold, hot = (order[state[order] == kind] for kind in (1, 2))
        n = self.n[hot]
        windows = spread(self.start[hot], n)
        dealt = np.array([zlib.crc32(self.bytes[i:i + LENGTH]) % buckets for i in windows.tolist()], np.int64)
        of = np.r_[bucket[cold], dealt]
        by = np.argsort(of, kind="stable")

        def all_of(cold_values: np.ndarray, hot_values: np.ndarray) -> np.ndarray:
            return np.r_[cold_values.astype(np.int64), hot_values][by]

        of, start = of[by], all_of(self.start[cold], windows)
        end = start + all_of(self.n[cold] - 1 + LENGTH, np.full(len(windows), LENGTH))
        doc = all_of(self.docs[self.text[cold]], np.repeat(self.docs[self.text[hot]], n))
        code, place = all_of(code[cold], np.full(len(windows), CODES)), all_of(self.offset[cold], np.zeros(len(windows), np.int64))
        out = {}
        for b in np.unique(of).tolist():
            mine = slice(*np.searchsorted(of, [b, b + 1]))
            number, pieces = numbered([self.bytes[s:e] for s, e in zip(start[mine].tolist(), end[mine].tolist(), strict=True)])
            first = np.flatnonzero(np.r_[True, number[1:] > np.maximum.accumulate(number)[:-1]])
            out[b] = Found(pieces, code[mine][first], place[mine][first], doc[mine][first], number, start[mine], doc[mine])
        return out


def agreeing(pieces: list[bytes], places: np.ndarray) -> np.ndarray:
    """Whether a piece agrees with another one in its anchor, which starts at its place, and in the SIDE bytes before or in those behind it."""
    several = np.zeros(len(pieces), bool)
    size = np.array([len(p) for p in pieces], np.int64)
    for has, shift, width in ((places >= SIDE, -SIDE, SIDE + GRAM), (places + GRAM + SIDE <= size, 0, GRAM + SIDE)):
        some = np.flatnonzero(has)
        number, _ = numbered([pieces[i][at:at + width] for i, at in zip(some.tolist(), (places[some] + shift).tolist(), strict=True)])
        several[some] |= np.bincount(number)[number] > 1
    return several


def _split(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return anchor % np.uint64(CODES), ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pack_codes(codes: np.ndarray) -> bytes:
    """Ascending whole numbers as 16-bit steps; a step of 65535 or more has one filler for each 65535."""
    step = np.diff(codes.astype(np.int64), prepend=0)
    fillers = step // 65535
    out = np.full(len(step) + int(fillers.sum()), 65535, np.uint16)
    out[np.arange(len(step)) + np.cumsum(fillers)] = step % 65535
    return out.tobytes()


def unpack_codes(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint16)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


def pack_longs(values: np.ndarray) -> bytes:
    """Longs as their least and the distances from it, in as few bytes each as hold the largest."""
    least = values.min()
    far = values.astype(np.uint64) - np.uint64(least.astype(np.uint64))
    kind = np.min_scalar_type(int(far.max()))
    return bytes([kind.itemsize]) + least.astype(np.int64).tobytes() + far.astype(kind).tobytes()


def unpack_longs(packed: bytes) -> np.ndarray:
    far = np.frombuffer(packed, f"u{packed[0]}", offset=9).astype(np.uint64)
    return (far + np.frombuffer(packed, np.int64, 1, 1).astype(np.uint64)).astype(np.int64)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


class ExternalColumn:
    """An array in a file that is read whole in order and written over in order; it never gets shorter."""

    def __init__(self, folder: str, name: str, kind: type) -> None:
        self.path, self.kind = Path(folder, name), kind

    def write(self, values: np.ndarray) -> None:
        with self.path.open("r+b" if self.path.exists() else "wb") as f:
            values.astype(self.kind, copy=False).tofile(f)

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, self.kind)


def collection_transform(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (symbols plus 1; 0 before a whole piece) and common prefixes of all suffixes.

    Round j puts the suffixes of length j of all pieces among the shorter ones. A suffix c·x
    stands where c's occurrence before x stands among the transform's symbols, so one stable
    sort of the symbols places all of them, and its common prefix with the one before is 1 more
    than the least common prefix between the two places it came from. Both columns lie in
    files, read and written once a round.
    """
    n = len(pieces)
    length = np.array([len(p) for p in pieces])
    longest = int(length.max()) if n else 0
    # symbols[i, j]: the symbol before the suffix of length j of piece i
    symbols = np.zeros((n, longest + 1), np.uint16)
    for i, p in enumerate(pieces):
        symbols[i, :len(p)] = np.frombuffer(p, np.uint8)[::-1].astype(np.uint16) + 1
    with tempfile.TemporaryDirectory() as folder:
        bwt, lcp = ExternalColumn(folder, "bwt", np.uint16), ExternalColumn(folder, "lcp", np.uint16)
        bwt.write(symbols[:, 0])
        lcp.write(np.zeros(n, np.uint16))
        place, active = np.arange(n), np.arange(n)
        for j in range(1, longest + 1):
            b, common = bwt.read(), lcp.read()
            active = active[length[active] >= j]
            order, rank = _first_column(b)
            place[active] = n + rank[place[active]]
            fresh = place[active]
            total = len(b) + len(active)
            is_new = np.zeros(total, bool)
            is_new[fresh] = True
            new_b, new_c = np.empty(total, np.uint16), np.zeros(total, np.uint16)
            new_b[~is_new], new_c[~is_new] = b, common
            new_b[fresh] = symbols[active, j]
            # Places whose neighbour before them is new, or that are new.
            near = is_new.copy()
            near[1:] |= is_new[:-1]
            near[:n + 1] = False
            touched = np.flatnonzero(near)
            here, before = order[touched - n], order[touched - n - 1]
            new_c[touched] = 0
            equal = b[here] == b[before]
            touched, lo, hi = touched[equal], before[equal] + 1, here[equal] + 1
            if len(touched):
                down = np.argsort(-lo, kind="stable")
                bounds = np.empty(2 * len(down), np.int64)
                bounds[::2], bounds[1::2] = lo[down], hi[down]
                least = np.minimum.reduceat(np.r_[common, np.uint16(0)], bounds)[::2]
                new_c[touched[down]] = least + 1
            if j == 1 or len(active):
                bwt.write(new_b)
                lcp.write(new_c)
        return bwt.read(), lcp.read()


def _first_column(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the symbols in the order of the first column, and its inverse; ends of pieces have none."""
    some = np.flatnonzero(b).astype(np.int32)
    order = some[np.argsort((b[some] - 1).astype(np.uint8), kind="stable")]  # of one byte, so sorted by counting once
    rank = np.zeros(len(b), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank


def smallest_holders(pieces: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For all windows of the distinct pieces, piece by piece: the smallest document that holds it, among all pieces."""
    n = len(pieces)
    if not n:
        return np.zeros(0, np.int64)
    b, common = collection_transform(pieces)
    _, rank = _first_column(b)
    length = np.array([len(p) for p in pieces])
    run = np.cumsum(common < LENGTH)
    place, owner, suffix, runs = np.arange(n), [], [], []
    for j in range(1, int(length.max()) + 1):
        live = np.flatnonzero(length >= j)
        place[live] = n + rank[place[live]]
        if j >= LENGTH:
            owner.append(live)
            suffix.append(np.full(len(live), j))
            runs.append(run[place[live]])
    owner, suffix, runs = np.concatenate(owner), np.concatenate(suffix), np.concatenate(runs)
    order = np.argsort(runs, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(runs[order]) != 0])
    least = np.empty(len(runs), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[owner][order], first), np.diff(np.r_[first, len(order)]))
    window = length[owner] - suffix
    by = np.lexsort((window, owner))
    return least[by]


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """row, n_bytes, spans (array of start and end of removed runs), kept, one per row of docs.

    kept holds the other bytes; with as_text it is a string, without bytes that the cuts left of a character.

    docs has key (integer or null), text (string or null) and `row` (string that tells rows apart).
    A byte goes if a LENGTH-byte string that covers it also starts in a text of a smaller key,
    judged on the texts as they are. Null texts are empty; a null key is larger than all others;
    rows of one key don't affect each other. An empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NONE)).alias("doc"), F.col("row"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(12, size // BLOCK_BYTES + 1)
    buckets = blocks
    # This exchange is planned once and read by all three passes.
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc", "row"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    grouped = dealt.groupBy("block")

    def send_anchors(table: pa.Table) -> pa.Table:
        block, rows = table["block"][0].as_py(), list(Block(table).anchors(buckets))
        return _rows({"bucket": ([r[0] for r in rows], pa.int32()), "block": ([block] * len(rows), pa.int32()),
                      "codes": ([r[1] for r in rows], pa.binary()), "flags": ([r[2] for r in rows], pa.binary())})

    def find_shared(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        codes = [unpack_codes(x) for x in table["codes"].to_pylist()]
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table["flags"].to_pylist()])
        unique, at, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        several = np.bincount(at, flags >= 128, len(unique)) > 0
        hot = np.bincount(at, flags & 127, len(unique)) > HOT_PIECES
        mark = np.where(several | (n > 1), np.where(hot, 2, 1), 0).astype(np.uint8)
        out, begin = [], 0
        for row, c in zip(table.select(["block", "bucket"]).to_pylist(), codes, strict=True):
            mine, begin = mark[at[begin:begin + len(c)]], begin + len(c)
            if mine.any():
                out.append((row["block"], row["bucket"], pack_codes(c[mine > 0]), mine[mine > 0].tobytes()))
        return _message(out, 1)

    def _message(rows: list[tuple[int, int, bytes, bytes]], kind: int) -> pa.Table:
        return _rows({"block": ([r[0] for r in rows], pa.int32()), "kind": ([kind] * len(rows), pa.int32()), "bucket": ([r[1] for r in rows], pa.int32()),
                      "a": ([r[2] for r in rows], pa.binary()), "b": ([r[3] for r in rows], pa.binary())})

    message = "block int, kind int, bucket int, a binary, b binary"
    shared = (grouped.applyInArrow(send_anchors, "bucket int, block int, codes binary, flags binary")
              .groupBy("bucket").applyInArrow(find_shared, message))

    def marks_of(messages: list[dict]) -> dict[int, tuple[bytes, bytes]]:
        return {m["bucket"]: (m["a"], m["b"]) for m in messages if m["kind"] == 1}

    def send_pieces(table: pa.Table, messages: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and messages.num_rows:
            number = table["block"][0].as_py()
            for bucket, found in Block(table).candidates(buckets, marks_of(messages.to_pylist())).items():
                codes = pack_codes(found.code)
                sizes, places = bytes(map(len, found.pieces)), found.place.astype(np.uint8).tobytes()
                rows.append((number, bucket, squeeze(sizes + places + b"".join(found.pieces)),
                             len(codes).to_bytes(4, "little") + codes + pack_longs(found.least)))
        return _message(rows, 2)

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        own, codes, places, holders = [], [], [], []
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            cut_at = 4 + int.from_bytes(b[:4], "little")
            codes.append(unpack_codes(b[4:cut_at]))
            holders.append(unpack_longs(b[cut_at:]))
            a, n = unsqueeze(a), len(holders[-1])
            places.append(np.frombuffer(a, np.uint8, n, n))
            ends = 2 * n + np.cumsum(np.frombuffer(a, np.uint8, n), dtype=np.int64)
            own.append([a[s:e] for s, e in zip([2 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)])
        number, pieces = numbered(p for mine in own for p in mine)
        least = np.full(len(pieces), _NONE)
        np.minimum.at(least, number, np.concatenate(holders))
        code, place = np.empty((2, len(pieces)), np.int64)
        code[number], place[number] = np.concatenate(codes), np.concatenate(places)
        # A window that was dealt out by its own bytes is equal to itself only.
        _, at, at_anchor = np.unique(code, return_inverse=True, return_counts=True)
        compared = np.flatnonzero((code != CODES) & (at_anchor[at] > 1))
        several = compared[agreeing([pieces[i] for i in compared.tolist()], place[compared])]
        # Runs of windows with one smallest document: of each piece one, and behind them those of the pieces built in.
        n_windows = np.array([len(p) for p in pieces], np.int64) - LENGTH + 1
        holder = smallest_holders([pieces[i] for i in several.tolist()], least[several])
        of = np.repeat(np.arange(len(several)), n_windows[several])
        first = np.flatnonzero(np.r_[True, (holder[1:] != holder[:-1]) | (of[1:] != of[:-1])][:len(holder)])
        length = np.r_[n_windows, np.diff(np.r_[first, len(holder)])].astype(np.uint8)
        value = np.r_[least, holder[first]]
        runs, begin = np.ones(len(pieces), np.int64), np.arange(len(pieces))
        runs[several] = np.bincount(of[first], minlength=len(several))
        begin[several] = len(pieces) + np.cumsum(runs[several]) - runs[several]
        out, done = [], 0
        for row, mine in zip(table.select(["block", "bucket"]).to_pylist(), own, strict=True):
            sent, done = number[done:done + len(mine)], done + len(mine)
            chosen = spread(begin[sent], runs[sent])
            out.append((row["block"], row["bucket"], runs[sent].astype(np.uint8).tobytes() + length[chosen].tobytes(), pack_longs(value[chosen])))
        return _message(out, 3)

    judged = (grouped.cogroup(shared.groupBy("block")).applyInArrow(send_pieces, message)
              .groupBy("bucket").applyInArrow(judge, message))

    def cut(table: pa.Table, messages: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows({"row": ([], pa.string()), "n_bytes": ([], pa.int64()), "spans": ([], spans_type), "kept": ([], kept_type)})
        block = Block(table)
        got = messages.to_pylist()
        verdicts = {m["bucket"]: (m["a"], m["b"]) for m in got if m["kind"] == 3}
        cover = np.zeros(len(block.data) + 1, np.int32)
        for bucket, found in block.candidates(buckets, marks_of(got)).items():
            lengths, values = verdicts[bucket]
            n = len(found.pieces)
            runs, length = np.frombuffer(lengths, np.uint8, n).astype(np.int64), np.frombuffer(lengths, np.uint8, offset=n).astype(np.int64)
            begin, offset = np.cumsum(runs) - runs, np.cumsum(length) - length
            offset -= np.repeat(offset[begin], runs)
            of = runs[found.number]
            chosen = spread(begin[found.number], of)
            cuts = unpack_longs(values)[chosen] < np.repeat(found.doc, of)
            lo = (np.repeat(found.start, of) + offset[chosen])[cuts]
            np.add.at(cover, lo, 1)
            np.subtract.at(cover, lo + length[chosen][cuts] - 1 + LENGTH, 1)
        gone = np.cumsum(cover[:-1]) > 0
        begin, n_bytes, spans, kept = 0, [], [], []
        for end in block.ends.tolist():
            mask = gone[begin:end]
            edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
            spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            left = block.data[begin:end][~mask].tobytes()
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            n_bytes.append(end - begin)
            begin = end
        return pa.table({"row": block.rows, "n_bytes": pa.array(n_bytes, pa.int64()), "spans": pa.array(spans, spans_type), "kept": pa.array(kept, kept_type)})

    kept_type = pa.string() if as_text else pa.binary()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return grouped.cogroup(shared.unionByName(judged).groupBy("block")).applyInArrow(
        cut, f"row string, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")
