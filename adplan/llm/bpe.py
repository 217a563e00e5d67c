"""Byte-level BPE: frequent words from a minimal acyclic transducer, unseen words by exact merges."""

from __future__ import annotations

import heapq
import json
import mmap
import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adplan.llm.common import settle

#: Fixed value: the pattern that parts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words compiled into the transducer, at most.
LEXICON_WORDS = 32_768
#: Words a task remembers before it starts anew, and code points up to which it does; this bounds memory and changes no result.
REMEMBERED, LONGEST = 250_000, 64


@dataclass(frozen=True)
class Vocabulary:
    """Byte strings of all ids, ids of single bytes, merges (pair of ids: rank, new id), special strings."""

    pieces: list[bytes]
    single: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    ranks: dict[int, int]  # merges with pair and (rank, new id) packed into integers


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file of byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Bytes that print stand for themselves, the others for code points from 256 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    as_byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ids = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for piece, i in ids.items():
        if piece not in special:
            pieces[i] = bytes(as_byte[c] for c in piece)
    for text, i in special.items():
        pieces[i] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
    as_char = {b: c for c, b in as_byte.items()}
    ranks = {a << 20 | b: rank << 20 | new for (a, b), (rank, new) in merges.items()}
    return Vocabulary(pieces, [ids[as_char[b]] for b in range(256)], merges, special, ranks)


#: Bytes of a word up to which a scan for the lowest rank beats a heap; words merged at a time.
SHORT, AT_ONCE = 64, 4096
_NEVER = 1 << 62


def merge(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of a word: always the pair of the lowest rank, the leftmost first."""
    ids = [v.single[b] for b in word]
    if len(ids) > SHORT:
        return _merge_long(ids, v)
    get = v.ranks.get
    found = [get(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
    while found and (best := min(found)) != _NEVER:
        i = found.index(best)
        new = ids[i] = best & 0xFFFFF
        del ids[i + 1], found[i]
        if i:
            found[i - 1] = get(ids[i - 1] << 20 | new, _NEVER)
        if i < len(found):
            found[i] = get(new << 20 | ids[i + 1], _NEVER)
    return ids


class Merger:
    """Merges many words at a time: every step merges in each word the pair of the lowest rank, the leftmost first."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.single = v, np.array(v.single, np.int64)
        self.keys = np.array(sorted(v.ranks), np.int64)
        self.found = np.array([v.ranks[k] for k in self.keys.tolist()] + [_NEVER], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of pairs, packed; -1 stands for no id."""
        pair = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == pair, self.found[at], _NEVER) if len(self.keys) else np.full(pair.shape, _NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > SHORT:
            k = order.pop()
            ids = merge(words[k], self.v)
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(order), AT_ONCE):
            self._merge_some(words, np.array(order[at:at + AT_ONCE]), out)
        return out

    def _merge_some(self, words: list[bytes], rows: np.ndarray, out: list[bytes]) -> None:
        sizes = np.array([len(words[k]) for k in rows])
        ids = np.full((len(rows), max(int(sizes.max()), 1) + 1), -1, np.int64)  # one free place at the end
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.single[np.frombuffer(b"".join(words[k] for k in rows), np.uint8)]
        pairs = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = pairs.argmin(axis=1)
            low = pairs[np.arange(len(rows)), best]
            done = low == _NEVER
            if done.any():
                whole = ids[done].astype("<u4")
                for k, row, n in zip(rows[done].tolist(), whole, (ids[done] >= 0).sum(axis=1).tolist(), strict=True):
                    out[k] = row[:n].tobytes()
                rows, ids, pairs, best, low = rows[~done], ids[~done], pairs[~done], best[~done], low[~done]
            if not len(rows):
                return
            every, new = np.arange(len(rows)), low & 0xFFFFF
            ids[every, best] = new
            place = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, place + (place > best[:, None]), axis=1)
            ids = np.concatenate([ids, np.full((len(rows), 1), -1)], axis=1) if ids.shape[1] < 2 else ids
            place = np.arange(ids.shape[1] - 1)
            pairs = np.take_along_axis(pairs, np.minimum(place + (place >= best[:, None]), pairs.shape[1] - 1), axis=1)
            inner = best > 0
            pairs[every[inner], best[inner] - 1] = self.ranks(ids[every[inner], best[inner] - 1], new[inner])
            inner = best < ids.shape[1] - 1
            pairs[every[inner], best[inner]] = self.ranks(new[inner], ids[every[inner], best[inner] + 1])


def _merge_long(ids: list[int], v: Vocabulary) -> list[int]:
    """The same with a heap of pairs, for words of any length."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := v.merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue  # one side has gone into another merge
        ids[i], ids[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else n
            if right < n and (m := v.merges.get((ids[left], ids[right]))):
                heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
    return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words, numbered so that a path's sum is the word's place in the id table.

    Words are added in order; when a branch is left, its states merge with equal ones seen
    before, so suffixes are shared as prefixes are. Every edge holds the number of words that
    precede it at its state.
    """
    final, edges, register = [False], [{}], {}
    path: list[tuple[int, int]] = []  # (state, label) of the last word

    def settle_down(depth: int) -> None:
        while len(path) > depth:
            state, label = path.pop()
            child = edges[state][label]
            edges[state][label] = register.setdefault((final[child], tuple(edges[child].items())), child)

    last = b""
    for word in sorted(words):
        same = next((i for i, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
        settle_down(same)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for label in word[same:]:
            final.append(False)
            edges.append({})
            edges[state][label] = len(edges) - 1
            path.append((state, label))
            state = len(edges) - 1
        final[state] = True
        last = word
    settle_down(0)
    # States get numbers in the order they are met; words below each are counted from the leaves up.
    number, order = {0: 0}, [0]
    for state in order:
        for child in edges[state].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
    below: dict[int, int] = {}
    todo = [0]
    while todo:
        state = todo[-1]
        missing = [c for c in edges[state].values() if c not in below]
        if missing:
            todo += missing
        else:
            below[state] = final[state] + sum(below[c] for c in edges[state].values())
            todo.pop()
    first, label, target, skip = [0], [], [], []
    for state in order:
        seen = int(final[state])
        for byte, child in edges[state].items():
            label.append(byte)
            target.append(number[child])
            skip.append(seen)
            seen += below[child]
        first.append(len(label))
    ids = [words[w] for w in sorted(words)]
    starts = list(accumulate(map(len, ids), initial=0))
    flat = [i for x in ids for i in x]
    numbers = first + target + skip + starts + flat
    head = struct.pack("<4I", len(order), len(label), len(ids), len(flat))
    return head + struct.pack(f"<{len(numbers)}I", *numbers) + bytes(label) + bytes(final[s] for s in order)


class Lexicon:
    """A compiled lexicon, memory-mapped from a file that goes when the process ends."""

    def __init__(self, compiled: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, flat = struct.unpack_from("<4I", self._map)
        numbers = memoryview(self._map)[16:16 + 4 * (states + 1 + 2 * edges + words + 1 + flat)].cast("I")
        ends = list(accumulate([states + 1, edges, edges, words + 1, flat], initial=0))
        self._first, self._target, self._skip, self._starts, self._ids = (
            numbers[a:b] for a, b in zip(ends, ends[1:], strict=False))
        self._labels = 16 + 4 * len(numbers)
        self._final = self._labels + edges

    def get(self, word: bytes) -> list[int] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        state = place = 0
        for i in range(len(word)):
            edge = self._map.find(word[i:i + 1], self._labels + self._first[state], self._labels + self._first[state + 1])
            if edge < 0:
                return None
            edge -= self._labels
            place += self._skip[edge]
            state = self._target[edge]
        if not self._map[self._final + state]:
            return None
        return self._ids[self._starts[place]:self._starts[place + 1]].tolist()


class Encoder:
    """Texts to their ids as little-endian 32-bit integers, a batch at a time: each word is looked up once, those
    not remembered come from the lexicon, and what that lacks is merged together."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.v, self.lexicon, self.merger = vocabulary, lexicon, Merger(vocabulary)
        self.words, self.known = regex.compile(PATTERN).findall, {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.pieces = pa.array(vocabulary.pieces, pa.large_binary())

    def parts(self, text: str) -> Iterator[list[str] | str]:
        """Lists of words and, between them, special strings."""
        if self.special is None or not any(s in text for s in self.v.special):
            yield self.words(text)
            return
        for k, part in enumerate(self.special.split(text)):
            yield part if k % 2 else self.words(part)

    def learn(self, met: set[str]) -> dict[str, bytes]:
        """Ids of those words; short ones are remembered, as long as REMEMBERED allows."""
        new = met.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = met
        found, rest = {}, []
        for word in new:
            ids = self.lexicon.get(word.encode())
            if ids is None:
                rest.append(word)
            else:
                found[word] = struct.pack(f"<{len(ids)}I", *ids)
        found.update(zip(rest, self.merger.merge([w.encode() for w in rest]), strict=True))
        self.known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [list(self.parts(t)) for t in texts]
        met = set().union(*(part for parts in cut for part in parts if isinstance(part, list)))
        found = self.learn(met)
        ids = self.known if all(len(w) <= LONGEST for w in found) else self.known | found
        return [b"".join(b"".join(map(ids.__getitem__, p)) if isinstance(p, list) else struct.pack("<I", self.v.special[p]) for p in parts) for parts in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of several lists of ids."""
        flat = pa.array(np.frombuffer(b"".join(ids), np.uint32))
        taken = self.pieces.take(flat)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
        at = ends[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        joined = memoryview(taken.buffers()[2]) if len(flat) else memoryview(b"")
        return [str(joined[a:b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def word_counts(docs: DataFrame, special: Iterable[str]) -> DataFrame:
    """word, n over the texts; special strings part words and are none themselves. Words of over LONGEST code points are left out."""
    text, special = F.col("text"), list(special)
    if special:
        held = reduce(or_, [text.contains(s) for s in special])
        text = F.explode(F.when(held, F.split(text, "|".join(rf"\Q{s}\E" for s in special))).otherwise(F.array(text)))
    words = F.explode(F.regexp_extract_all("part", F.lit(PATTERN.replace("White_Space", "IsWhite_Space")), F.lit(0)))
    return (docs.where("text is not null").select(text.alias("part")).select(words.alias("word"))
            .where(F.char_length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def frequent_words(docs: DataFrame, special: Iterable[str], most: int = LEXICON_WORDS) -> list[str]:
    """The commonest words of all texts, `most` at most: all words whose count lies in the highest classes that fit.

    A class spans an eighth of a power of two, so a few hundred rows tell how many words each holds.
    """
    counted = settle(word_counts(docs, special).where("n > 1")
                     .withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    room, least = most, None
    for r in counted.groupBy("class").count().orderBy(F.desc("class")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["class"]
    if least is None:
        return []
    return sorted(r.word for r in counted.where(F.col("class") >= least).select("word").collect())


def encode_and_decode(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> DataFrame:
    """docs' columns but text, and n_tokens long, ids binary (little-endian 32-bit), decoded string.

    tokenizer is the path of a byte-level BPE file; its special strings are special in texts too.
    A null text counts as empty: no ids, decoded ''. Repeated rows and extra columns stay; docs
    must have no other column called n_tokens, ids or decoded (such are replaced). An empty
    table gives no rows. The lexicon holds the `most` commonest words, counted over all texts; it
    is bounded, so it travels as a broadcast value, and it changes speed, never ids.
    A task asks it once for each word it meets and remembers the answer.
    """
    vocabulary = read_vocabulary(tokenizer)
    words = frequent_words(docs, vocabulary.special, most)
    compiled = compile_lexicon({w.encode(): merge(w.encode(), vocabulary) for w in words})
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, compiled))
    kept = docs.drop("n_tokens", "ids", "decoded")
    others = [f for f in kept.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lexicon = shared.value
        encoder = Encoder(v, Lexicon(lexicon))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what a batch holds at a time
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = encoder.encode(texts)
                columns = {f.name: part.column(f.name) for f in others} | {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()),
                    "decoded": pa.array(encoder.decode(ids), pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = kept.select(*[f.name for f in others]).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")
    return kept.mapInArrow(run, schema)
