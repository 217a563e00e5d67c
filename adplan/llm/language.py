"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Families of closely related languages; a language of no family is one of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance"}
#: Documents per language that the machines are fitted on, at most.
SAMPLE = 600
#: Buckets of the hashed character n-grams.
WIDTH = 2048

_FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def vector(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams of the folded text; all of the text counts."""
    b = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8)
    upper = np.zeros(len(b), bool)
    upper[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0x9F)  # Latin-1 capitals
    b = np.where(upper, b + np.uint8(32), b).astype(np.uint32)
    out = np.zeros(WIDTH, np.float64)
    code = b
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * np.uint32(257) + b[n - 1:]
        if len(code):
            hashed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761) >> np.uint32(21)
            spaces = b[:len(code)] == 32
            for k in range(1, n):
                spaces &= b[k:len(code) + k] == 32
            out += np.bincount(hashed[~spaces], minlength=WIDTH)
    total = out.sum()
    return np.sqrt(out / total).astype(np.float32) if total else out.astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """A linear machine: positive side is the first of two names."""

    names: tuple[str, str]
    weights: np.ndarray
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit_machine(x: np.ndarray, positive: np.ndarray, names: tuple[str, str], rounds: int = 60, reg: float = 1e-4) -> Machine:
    """Hinge loss by averaged stochastic subgradients, both sides weighted alike."""
    rng, y = np.random.default_rng(7), np.where(positive, 1.0, -1.0)
    cost = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(y)
    data = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, mean, t = np.zeros(data.shape[1]), np.zeros(data.shape[1]), 0
    for r in range(rounds):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 32):
            t += 1
            part = order[i:i + 32]
            wrong = part[y[part] * (data[part] @ w) < 1]
            rate = 1 / (reg * (t + 1000))
            w *= 1 - rate * reg
            if len(wrong):
                w += rate * reg * 100 * (cost[wrong] * y[wrong]) @ data[wrong] / len(part)
            if r >= rounds // 2:
                mean += w
    mean /= max(1, t - t * (rounds // 2) // rounds)
    scale = np.abs(data @ mean).mean() or 1.0
    mean = mean * (3 / scale)  # margins of a few units, so that the score below means something
    return Machine(names, mean[:-1], float(mean[-1]))


def fit_pairs(x: np.ndarray, labels: np.ndarray) -> list[Machine]:
    """One machine for each pair of labels."""
    out = []
    for a, b in combinations(sorted(set(labels)), 2):
        rows = (labels == a) | (labels == b)
        out.append(fit_machine(x[rows], labels[rows] == a, (a, b)))
    return out


def vote(machines: list[Machine], names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The name with most won duels for each row, ties by total probability; and its mean probability."""
    if len(names) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    at = {n: k for k, n in enumerate(names)}
    wins, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for m in machines:
        p = 1 / (1 + np.exp(-np.clip(m.margins(x), -30, 30)))
        for name, q in ((m.names[0], p), (m.names[1], 1 - p)):
            total[:, at[name]] += q
            wins[:, at[name]] += q > 0.5
    best = np.argmax(wins + total / (len(names) * 2), axis=1)
    return best, total[np.arange(len(x)), best] / (len(names) - 1)


@dataclass(frozen=True)
class Model:
    """Families with their languages, machines between families, machines within each."""

    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        family, sure = vote(self.between, names, x)
        langs, score = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                own, p = vote(self.within[name], self.families[name], x[rows])
                langs[rows] = np.array(self.families[name], object)[own]
                score[rows] = sure[rows] * p
        return list(langs), score


def fit(docs: DataFrame, per_language: int = SAMPLE, families: dict[str, str] | None = None) -> Model:
    """Fits on at most per_language documents of each language: those with the smallest hashes of doc_id.

    docs has doc_id, text, lang; rows without a lang or without a letter in the text teach nothing.
    """
    families = FAMILIES if families is None else families
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language)
    # At most per_language ids of each language, so this side may be broadcast.
    sample = known.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(vectors, f"doc_id {kind}, lang string, x binary").orderBy("doc_id", "lang").collect()
    labels = np.array([r.lang for r in rows], object)
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(len(rows), WIDTH)
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(labels)):
        groups.setdefault(families.get(lang, lang), []).append(lang)
    of = np.array([families.get(lang, lang) for lang in labels], object)
    within = {name: fit_pairs(x[of == name], labels[of == name]) if len(langs) > 1 else [] for name, langs in groups.items()}
    return Model(groups, fit_pairs(x, of) if len(groups) > 1 else [], within)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but text, and lang_pred, score (0 to 1).

    Only the text decides. A null text, or one without a letter, is `und` with score 0, and so is
    every text if the model has learned no language. Repeated rows and extra columns stay;
    columns called lang_pred or score are replaced. An empty table gives no rows.
    """
    kept = docs.drop("lang_pred", "score")
    others = [f.name for f in kept.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column("text").to_pylist()
                rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t) and model.families]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if rows:
                    got, sure = model.predict(np.array([vector(texts[i]) for i in rows]))
                    for i, g, s in zip(rows, got, sure, strict=True):
                        lang[i], score[i] = g, float(s)
                yield pa.RecordBatch.from_pydict({n: part.column(n) for n in others} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return kept.mapInArrow(run, kept.select(*others).schema.add("lang_pred", "string").add("score", "double"))
