"""Spelling variants: words at one edit, found over reduced alphabets and verified on the words themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adplan.llm.common import settle

#: Symbols that letters are hashed to. Fewer make shorter neighbourhoods and more pairs to verify.
SYMBOLS = 6
#: Words of one reduced word that travel in one row.
CLASS = 256

_RUN = re.compile(r"[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 2**64))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all rows of docs (doc_id, text): runs of letters in lower case (A-Z only).

    A run whose CRC-32 of ``<doc_id>:<run>`` is a multiple of 199 loses the code point at the CRC modulo
    its length. A null doc_id is written as an empty text there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % 199 == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    counts[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text").where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(words: list[str], symbols: int) -> np.ndarray:
    """The reduced words of words of one length, one row each: symbols from 1."""
    points = np.array([[ord(c) for c in w] for w in words], np.uint64)
    return (points * _P >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h + np.uint64(length)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x94D049BB133111EB)).view(np.int64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _P, np.uint64)])


def reduced_keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """A 64-bit key of each reduced word: a polynomial in its symbols."""
    out = np.zeros(len(words), np.int64)
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        s = _symbols([words[i] for i in at], symbols)
        out[at] = _mixed((s * _powers(int(n))[:n]).sum(axis=1), int(n))
    return out


def neighbourhoods(words: list[str], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words of one length after the other: their places in the list, and a row of keys each: the
    reduced word itself and all that one deleted, replaced or inserted symbol makes of it, sorted
    (a key may repeat)."""
    lengths = np.array([len(w) for w in words])
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    for n in map(int, np.unique(lengths)):
        at = np.flatnonzero(lengths == n)
        s, power = _symbols([words[i] for i in at], symbols), _powers(n)
        terms = s * power[:n]
        none = np.zeros((len(s), 1), np.uint64)
        before = np.concatenate([none, np.cumsum(terms, axis=1)], axis=1)  # symbols before each place
        after = before[:, -1:] - before  # symbols from each place on
        deleted = before[:, :-1] + after[:, 1:] * _INVERSE
        changed = (before[:, :-1] + after[:, 1:])[:, :, None] + power[:n, None] * every
        added = (before + after * _P)[:, :, None] + power[:, None] * every
        keys = np.concatenate([_mixed(deleted, n - 1), _mixed(changed.reshape(len(s), -1), n), _mixed(added.reshape(len(s), -1), n + 1)], axis=1)
        yield at, np.sort(keys, axis=1)


def _classes(words: DataFrame, symbols: int, size: int) -> DataFrame:
    """key, part, words (array of word, n): words of equal keys, `size` to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(reduced_keys(batch.column(0).to_pylist(), symbols), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1)], names=["key", "word", "n"])

    keyed = words.select("word", "n").mapInArrow(run, "key long, word string, n long")
    place = F.row_number().over(Window.partitionBy("key").orderBy("word")) - 1
    return keyed.withColumn("part", F.floor(place / size)).groupBy("key", "part").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def near_words(words: DataFrame, symbols: int = SYMBOLS, size: int = CLASS) -> DataFrame:
    """word, n, other, other_n for all ordered pairs at exactly one edit among words (word, n; distinct).

    Letters are hashed to `symbols` symbols. Words at one edit have reduced words that are equal or at one
    edit, so the full one-edit neighbourhood of every reduced word is joined with the reduced words that
    exist; neighbourhoods are symmetric, so of a key and its neighbour only the larger asks for the smaller.
    Keys are hashes: equal keys of different reduced words only add pairs to verify. The words of the
    classes that met are verified by their edit distance; a class travels in rows of `size` words.
    """
    classes = settle(_classes(words, symbols, size), "word-classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at, keys in neighbourhoods(texts, symbols):
                for some in range(0, len(at), 1024):
                    block = keys[some:some + 1024]
                    mine = own[at[some:some + 1024]][:, None]
                    fresh = (block <= mine) & np.concatenate([np.ones((len(block), 1), bool), block[:, 1:] != block[:, :-1]], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine[:, 0], fresh.sum(axis=1))), pa.array(block[fresh])], names=["a", "b"])

    # One word stands for its reduced word; words of one key and different reduced words would need one each.
    samples = classes.select("key", F.explode("words.word").alias("word"))
    samples = samples.groupBy("key", _reduced(F.col("word"), symbols).alias("reduced")).agg(F.min("word").alias("word"))
    asked = samples.select("key", "word").mapInArrow(run, "a long, b long")
    existing = classes.where("part = 0").select(F.col("key").alias("b"))
    met = asked.join(existing, "b").distinct()
    side = lambda c: classes.select(F.col("key").alias(c), F.col("words").alias(f"words_{c}"))
    pairs = met.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select((F.col("a") == F.col("b")).alias("own"), F.explode("words_a").alias("x"), "words_b").select("own", "x", F.explode("words_b").alias("y"))
    close = F.abs(F.char_length("x.word") - F.char_length("y.word")) <= 1
    near = pairs.where(close).where(F.levenshtein("x.word", "y.word", 1) == 1)
    both = F.when(F.col("own"), F.array(F.struct("x", "y"))).otherwise(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return near.select(F.explode(both).alias("p")).select("p.x.word", "p.x.n", F.col("p.y.word").alias("other"), F.col("p.y.n").alias("other_n"))


def _reduced(word: Column, symbols: int) -> Column:
    """The reduced word as text, for grouping alone."""
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    return F.translate(word, "".join(letters), "".join(chr(96 + int(s)) for s in _symbols(letters, symbols).ravel()))


def variant_groups(docs: DataFrame, least_length: int = 6, least: int = 5, factor: int = 5, symbols: int = SYMBOLS, size: int = CLASS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs (doc_id, text).

    Words are the runs that `count_words` counts, of at least `least_length` code points and `least`
    occurrences. A word's form is the near word (one edit) with the largest count, of equals the smallest in
    code-point order, if it occurs at least `factor` times as often; else null. Root: the last of the forms
    from the word on. A form occurs `factor` times as often, so the way is short; each round of the
    search for roots doubles the steps taken. Null and empty texts have no words; rows that repeat count each;
    extra columns are ignored; an empty table gives no rows.
    """
    words = settle(count_words(docs.select("doc_id", "text")).where((F.col("n") >= least) & (F.char_length("word") >= least_length)), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    near = near_words(words, symbols, size).groupBy("word").agg(F.count("*").alias("n_near"), best)
    often = -F.col("best.less") >= factor * F.col("n")
    table = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "variants")
    steps = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = settle(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
