"""Ranked search, streaming exact copies and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adplan.llm import exactcopies, lexical, spelling

random.seed(8)
WORDS = ["".join(random.choice("abcdeéó") for _ in range(random.randint(1, 9))) for _ in range(120)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n: int) -> str:
    return " ".join(random.choice(WORDS) for _ in range(n))


TEXTS = [prose(random.randint(1, 80)) for _ in range(300)] + [None, "", " ,.;", "ÉÓ éÓ A a", "X" * 5000, prose(20_000)]
TEXTS += [TEXTS[0]] * 40 + [TEXTS[1].upper()] * 3 + [TEXTS[3].replace("a", "A")]
DOCS = [(i, t, "en", "clash", 1) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", "clash", 1), (7, "other text", "en", "clash", 1), (None, TEXTS[2], "en", "clash", 1)]
ITEMS = [(i, prose(12), 5) for i in range(12)] + [(12, None, 5), (13, "", 5), (14, "nowhere zzzzzz", 5), (3, prose(4), 5), (15, TEXTS[0].upper(), 5), (16, prose(9000), 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, digest string, shard int").repartition(5)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string, rank int")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(k):
    rows = [(i, Counter(terms(t))) for i, t, *_ in DOCS if terms(t)]
    n_docs, n_terms = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    held: dict = {}
    for i, t, _ in ITEMS:
        held.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in held.items():
        scored = []
        for i, c in rows:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, sample", [(16_384, 16_384), (50, 30)])
def test_search_equals_scoring_everything(docs, items, monkeypatch, shard, sample):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "SAMPLE", sample)
    for k in (5, 50):
        got = sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, k).collect()], key=str)
        assert got == ranked(k)


def test_search_in_several_item_sets_and_over_empty_tables(docs, items, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_TERMS", 100)
    got = sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, 3).collect()], key=str)
    assert got == ranked(3)
    assert lexical.search(docs.where("1 = 0"), items).count() == 0
    assert lexical.search(docs, items.where("1 = 0")).count() == 0


def test_blocks_hold_each_posting_once_and_bounds_are_maxima(docs, items):
    asked = lexical.item_terms(items, "item_id").collect()
    names = sorted({r.term for r in asked})
    held: dict = {}
    for r in asked:
        held.setdefault(r.item_id, []).append(names.index(r.term))
    own = lexical.Items(list(held), names, [np.array(sorted(v)) for v in held.values()])
    found = lexical.vectors(docs.coalesce(1).orderBy(F.asc_nulls_last("doc_id"), "text"), names).cache()
    weights = lexical.weigh(found, names)
    rows = lexical.index(found, own, weights, np.arange(len(names)), 4).collect()
    shard = {}
    for r in found.orderBy(F.asc_nulls_last("doc_id"), "place").collect():
        shard.setdefault(r.shard, []).append({t: int(weights.part(np.array([k]), np.array([r.n]))[0]) for t, k in zip(r.terms, r.tfs)})
    postings = Counter((r.shard, r.term, d) for r in rows for d in r.docs)
    assert set(postings.values()) == {1}
    assert set(postings) == {(s, t, d) for s, ds in shard.items() for d, own in enumerate(ds) for t in own}
    for r in rows:
        assert len(r.docs) <= 4
        for t, most in zip(r.coords, r.maxima):
            assert most == max(shard[r.shard][d].get(t, 0) for d in r.docs)


def copies(rows):
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    low = lambda i: -1 if i is None else i
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=low)
        kept = sorted(ids, key=low)[-1:]
        for n, i in enumerate(sorted(ids, key=low)):
            out.append((i, keep, len(ids), n == len(ids) - 1 and i == kept[0], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(result):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in result.collect()], key=str)


def test_exact_copies_equal_plain_grouping(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    assert as_rows(exactcopies.exact_copies(spark, path)) == copies(DOCS)
    docs.where("1 = 0").write.parquet(str(tmp_path / "none.parquet"))
    assert exactcopies.exact_copies(spark, str(tmp_path / "none.parquet")).count() == 0


def test_a_weak_digest_changes_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    weak = lambda t: F.unhex(F.hex(F.pmod(F.crc32(t), F.lit(5))))
    found = exactcopies.Deduplicator(spark, path, digest=weak, files_per_trigger=2).advance()
    assert spark.read.parquet(f"{found.folder}/mixed/*").select("digest").distinct().count() == 5
    assert as_rows(found.result()) == copies(DOCS)


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    rows = DOCS[:120]
    path, folder = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    for n, part in enumerate((rows[:60], rows[60:100], rows[20:70] + rows[100:])):
        spark.createDataFrame(part, "doc_id long, text string, lang string, digest string, shard int").coalesce(2).write.mode("append").parquet(path)
        found = exactcopies.Deduplicator(spark, path, folder, files_per_trigger=1).advance()
        seen = [*rows[:60], *rows[60:100], *rows[20:70], *rows[100:]][:(60, 100, 170)[n]]
        assert as_rows(found.result()) == copies(seen)
    assert found.advance() is found and as_rows(found.result()) == copies(seen)


def variants(rows, least_length=6, least=5):
    counts: Counter = Counter()
    for i, t, *_ in rows:
        for word in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}

    def close(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = {w: [v for v in words if close(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("symbols, size", [(6, 256), (2, 3)])
def test_variants_equal_all_pairs(spark, symbols, size):
    base = ["abcdef", "bcdefgh", "ÀÉñándé", "ÿ×÷ßàé", "zzzzzzzz", "abcabcabcabc"]
    made = {w: 200 for w in base}
    for w in base:
        for n in range(25):
            at = random.randrange(len(w))
            other = random.choice([w[:at] + w[at + 1:], w[:at] + random.choice("abzé") + w[at + 1:], w[:at] + random.choice("abzé") + w[at:]])
            made[other] = made.get(other, 0) + random.choice([5, 6, 30, 41])
            other = other[:1] + random.choice("xy") + other[1:]
            made[other] = made.get(other, 0) + 5
    words = [w.upper() if random.random() < 0.2 and w.isascii() else w for w, n in made.items() for _ in range(n)]
    random.shuffle(words)
    rows = [(i, " ".join(words[i::30]), 1, "c") for i in range(30)] + [(None, "abcdef ABCDEF", 1, "c"), (3, None, 1, "c"), (4, "", 1, "c"), (4, "q" * 4000, 1, "c"), (5, "abcdef abcdex", 1, "c"), (5, "abcdef abcdex", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(docs, symbols=symbols, size=size).collect()}
    assert got == variants(rows)
    assert any(f and variants(rows)[f][0] for f, *_ in got.values())
    assert spelling.variant_groups(docs.where("1 = 0")).count() == 0


def test_neighbourhoods_are_whole():
    words = ["abcdef", "ab", "a", "ÿéabc"]
    symbols = {w: spelling._symbols([w], spelling.SYMBOLS)[0].astype(int).tolist() for w in words}

    def key(s):
        return int(spelling._mixed((np.array([s], np.uint64).reshape(1, -1) * spelling._powers(len(s))[:len(s)]).sum(axis=1), len(s))[0])

    for at, keys in spelling.neighbourhoods(words):
        for i, row in zip(at, keys):
            s = symbols[words[i]]
            plain = {key(s)}
            for k in range(len(s) + 1):
                for c in range(1, spelling.SYMBOLS + 1):
                    plain.add(key(s[:k] + [c] + s[k:]))
                    if k < len(s):
                        plain.add(key(s[:k] + [c] + s[k + 1:]))
                if k < len(s):
                    plain.add(key(s[:k] + s[k + 1:]))
            assert set(row.tolist()) == plain
