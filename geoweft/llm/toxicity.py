"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first four and five letters, hashed to 32 bits; a text
has a term or not. Score = sigmoid(bias + sum of weights + sum over pairs of dot products of factors), so
that two terms together can count for more, or less, than each alone.

Learned from a bounded sample of labelled rows: at most per_class of each class, smallest hash of the id
first, outside the held-out fold. Only terms of that sample that its classes tell apart are kept, at most
most_terms, so the model has a fixed greatest size whatever the input.

Defined cases: rows are scored whatever their doc_id, repeated rows each; terms with equal chi-square rank by hash; null and empty texts have no terms and get the score of the bias alone; several labels of a
document count as toxic if one is; labels without a document or without a value teach nothing; with no
label of one of the classes every score is 0. Texts are read whole; repeated words count once.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Memo, by_parts, fold, free_name, give_back, kept

WORD = re.compile(r"\w+").findall


h = xxhash.xxh32_intdigest


def hashed(token: str) -> np.ndarray:
    """Terms of what stands between two spaces."""
    terms = [t for w in WORD(token) for t in (w, w[:4] + "*", w[:5] + "**")]
    return np.unique(np.array([h(t) for t in terms], np.uint32))


def term_set(text: str | None) -> np.ndarray:
    known = kept("terms", lambda: Memo(hashed, limit=120_000))
    some = [known[w] for w in set((text or "").lower().split())]
    return np.unique(np.concatenate(some)) if some else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    bias: float
    weight: np.ndarray
    factor: np.ndarray  # term x k

    def lookup(self) -> Memo:
        place = {int(t): i for i, t in enumerate(self.terms)}.get
        heads = Memo(lambda head: [place(h(head[:4] + "*")), place(h(head + "**"))], limit=50_000)

        def known(token: str) -> tuple[int, ...]:
            return tuple({i for w in WORD(token) for i in (place(h(w)), *heads[w[:5]]) if i is not None})

        return Memo(known, limit=150_000)

    def score(self, at: np.ndarray) -> float:
        f = self.factor[at]
        z = self.bias + self.weight[at].sum() + 0.5 * float((f.sum(0) ** 2 - (f**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def select(texts: list[np.ndarray], y: np.ndarray, most: int, least: int, least_chi: float) -> np.ndarray:
    """The terms whose presence the classes tell apart most, by chi-square, among all texts or among those that hold one of
    the best terms of the first kind: a term that only matters beside another shows there alone."""
    first, chi = _told_apart(texts, y, least, least_chi)
    best = np.argsort(-chi, kind="stable")[: min(most, int((chi > 0).sum()))]
    found, strong = first[best], np.sort(first[best[:50]])
    beside = [i for i, t in enumerate(texts) if len(np.intersect1d(t, strong, assume_unique=True))]
    if 0 < y[beside].sum() < len(beside):
        second, chi = _told_apart([texts[i] for i in beside], y[beside], least, least_chi)
        found = np.concatenate([found, second[np.argsort(-chi, kind="stable")[: int((chi > 0).sum())]]])
    return np.sort(found[np.sort(np.unique(found, return_index=True)[1])][:most])


def _told_apart(texts: list[np.ndarray], y: np.ndarray, least: int, least_chi: float) -> tuple[np.ndarray, np.ndarray]:
    """All terms and their chi-square, 0 where there are too few or it is too small."""
    every = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    terms, n = np.unique(every, return_counts=True)
    toxic = np.concatenate([t for t, v in zip(texts, y) if v] or [np.zeros(0, np.uint32)])
    n1 = np.bincount(np.searchsorted(terms, toxic), minlength=len(terms))
    total, pos = len(texts), int(y.sum())
    expect = n * (pos / total)
    chi = (n1 - expect) ** 2 / np.maximum(expect * (1 - n / total) * (1 - pos / total), 1e-9)
    chi[(n < least) | (chi < least_chi)] = 0
    return terms, chi


def train(texts: list[np.ndarray], y: np.ndarray, k: int = 8, most_terms: int = 20_000, least: int = 4, least_chi: float = 15.0, epochs: int = 30, least_steps: int = 1500, rate: float = 0.02, decay: float = 2e-4, seed: int = 11) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint32), -40.0, np.zeros(0, np.float32), np.zeros((0, k), np.float32))
    terms = select(texts, y, most_terms, least, least_chi)
    found = []
    for t in texts:
        at = np.searchsorted(terms, t)
        at[at == len(terms)] = 0
        found.append(at[terms[at] == t] if len(terms) else at[:0])
    r = np.random.default_rng(seed)
    w, v, b = np.zeros(len(terms), np.float32), r.normal(0, 0.01, (len(terms), k)).astype(np.float32), np.zeros(1, np.float32)
    ms = [np.zeros_like(a) for a in (w, v, b) for _ in range(2)]
    # classes weigh as they are found; 128 texts a step
    step = 0
    for _ in range(max(epochs, least_steps * 128 // len(y))):
        order = r.permutation(len(y))
        for s in range(0, len(y), 128):
            rows = order[s : s + 128]
            size = np.array([len(found[i]) for i in rows])
            at = np.concatenate([found[i] for i in rows]) if size.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(rows)), size)
            f = v[at]
            total = np.zeros((len(rows), k), np.float32)
            np.add.at(total, row, f)
            z = b[0] + np.bincount(row, w[at], len(rows)) + 0.5 * ((total**2).sum(1) - np.bincount(row, (f**2).sum(1), len(rows)))
            g = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - y[rows]).astype(np.float32) / len(rows)
            gw = np.bincount(at, g[row], len(terms)).astype(np.float32) + decay * w
            gv = np.zeros_like(v)
            np.add.at(gv, at, g[row][:, None] * (total[row] - f))
            gv += decay * v
            step += 1
            for p, grad, m in ((w, gw, 0), (v, gv, 2), (b, np.array([g.sum()], np.float32), 4)):
                ms[m] *= 0.9
                ms[m] += 0.1 * grad
                ms[m + 1] *= 0.99
                ms[m + 1] += 0.01 * grad**2
                p -= rate * (ms[m] / (1 - 0.9**step)) / (np.sqrt(ms[m + 1] / (1 - 0.99**step)) + 1e-6)
    return Model(terms, float(b[0]), w, v)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = 3000) -> Model:
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return train([], np.zeros(0))
    share = F.when(F.col("toxic") == 1, min(1.0, 2 * per_class / sizes[1])).otherwise(min(1.0, 2 * per_class / sizes[0]))
    drawn = known.withColumn("draw", F.xxhash64("doc_id")).where(F.pmod("draw", F.lit(1_000_000)) < share * 1_000_000)
    each = [drawn.where(F.col("toxic") == c).orderBy("draw", "doc_id").limit(per_class) for c in (0, 1)]
    some = each[0].unionByName(each[1]).select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))

    terms = by_parts(lambda texts: [term_set(t).tobytes() for t in texts], "binary", pa.binary())
    # the sample has 2 * per_class rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "__toxic", terms(F.col("text")).alias("terms")).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    found = rows.column("terms").to_pylist()
    model = train([np.frombuffer(found[i], np.uint32) for i in order], rows.column("__toxic").to_numpy()[order].astype(np.int64))
    del rows, found
    give_back()
    return model


def score(text: Column, model: Model) -> Column:
    name = f"terms of {uuid.uuid4().hex}"

    def scores(texts: list[str | None]) -> list[float]:
        at, out = kept(name, model.lookup), []
        for t in texts:
            found: set[int] = set()
            found.update(*map(at.__getitem__, set((t or "").lower().split())))
            out.append(model.score(np.array(sorted(found), np.int64)))
        return out

    return by_parts(scores, "double", pa.float64())(text)


def rate(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, least: float = 0.7) -> DataFrame:
    model = fit(docs, labels, folds, held_out)
    return (
        docs.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), score(F.col("text"), model).alias("score"))
        .withColumn("predicted", (F.col("score") >= least).cast("int"))
    )


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score is below `least`."""
    model = fit(docs, labels)
    name = free_name("__toxicity", docs.columns)
    return docs.withColumn(name, score(F.col("text"), model)).where(F.col(name) < least).drop(name)
