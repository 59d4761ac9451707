"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. One binary n-gram classifier per bit (logistic regression over
hashed byte n-grams of the lower-cased text) predicts it; decoding adds up the logistic losses against
each codeword, every bit weighted by how well its classifier separates, and takes the nearest codeword.
Up to seven languages get the exhaustive code, more get a random code chosen for its smallest distance.

Defined cases: a text that is null or has no letter is `und` with score 0; ties go to the language that
sorts first; with nothing to learn from all texts are `und`; with one language all others get it; repeated rows and
rows with a null doc_id are predicted like others, an empty table gives no rows, other columns are not read.
Texts are read whole; n-grams are those of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoweft.llm.common import by_parts, fold, free_name, give_back

DIM = 2048
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray:
    """Root-scaled, length-normalised counts of hashed byte 1-, 2- and 3-grams."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = a[:-1] * 256 + a[1:]
    three = two[:-1] * np.uint32(256) + a[2:]
    counts = np.bincount(a, minlength=DIM)
    for grams, salt in ((two, np.uint32(2654435761)), (three, np.uint32(2246822519))):
        counts += np.bincount(256 + (grams * salt >> np.uint32(12)) % np.uint32(DIM - 256), minlength=DIM)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int, tries: int = 64, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1; no two rows equal, no column constant, no two columns equal or opposite."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        first = np.ones((1, bits), np.int8)
        rest = [[1 if (b >> k) & 1 else -1 for b in range(bits)] for k in range(n - 1)]
        return np.concatenate([first, np.array(rest, np.int8)])
    r, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, 0
    while best is None or tries > 0:
        tries -= 1
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:  # the first row is all ones, so no column can be another's opposite
            c = np.append(np.int8(1), r.choice(np.array([-1, 1], np.int8), n - 1))
            if (c < 0).any():
                columns[c.tobytes()] = c
        code = np.stack(list(columns.values()), 1)
        agree = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(agree, -bits)
        near = (bits - int(agree.max())) // 2
        if near > most:
            best, most = code, near
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weight: np.ndarray  # n-gram x bit
    bias: np.ndarray
    trust: np.ndarray  # by bit, adds up to the number of bits

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language: the softmax of the negative weighted losses."""
        f = x @ self.weight + self.bias
        loss = np.stack([(np.logaddexp(0, -f * c) * self.trust).sum(1) for c in self.code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    share = 1 / np.bincount(y, minlength=len(languages)).clip(1)
    row = (share[y] / share[y].sum())[:, None].astype(np.float32)  # languages count alike
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        g = -target * row / (1 + np.exp(target * (x @ w + b)))
        for p, grad, k in ((w, x.T @ g + decay * w, 0), (b, g.sum(0), 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * grad**2
            p -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.99**t)) + 1e-8)
    right = (((x @ w + b) * target > 0) * row).sum(0).clip(0.501, 0.999)
    trust = np.log(right / (1 - right))
    return Model(languages, code, w, b, (trust / max(trust.mean() if len(trust) else 1.0, 1e-9)).astype(np.float32))


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = 500, most_texts: int = 20_000) -> Model:
    """Learns every language from at most per_language of its texts, those with the smallest hash of their id, outside
    the held-out fold; with so many languages that this comes to more than most_texts, from most_texts / languages of each
    (one at least). A text is 8 KB to the driver, so most_texts bounds what travels to 160 MB. Only lang and text of those
    rows are read."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), folds) != held_out)
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], codewords(0), np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    per_language = max(1, min(per_language, most_texts // len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    often = {lang: min(1.0, (2 * per_language + 20) / n) for lang, n in sizes.items()}  # languages of about as many rows as are learned from are read whole
    share = F.coalesce(F.create_map(*[F.lit(x) for lang, q in often.items() if q < 1 for x in (lang, q)])[F.col("lang")], F.lit(1.0)) if min(often.values()) < 1 else F.lit(1.0)

    grams = by_parts(lambda texts: [gram_counts(t) for t in texts], "array<float>", pa.list_(pa.float32()))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = (
        known.where(draw < share * 1_000_000).select("lang", "text", "doc_id", F.row_number().over(order).alias("place"))
        .where(F.col("place") <= per_language).select("lang", grams("text").alias("x"))
    )
    rows = some.toArrow()
    spoken = np.array(rows.column("lang").to_pylist(), object)
    languages = sorted(set(spoken))
    if not languages:
        return Model([], codewords(0), np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32), np.zeros(0, np.float32))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, DIM)  # the only copy in this process
    model = train(x, np.searchsorted(languages, spoken), languages)
    del rows, x
    give_back()
    return model


def predict(text: Column, model: Model, margin: float = 0.1) -> Column:
    """struct<lang_pred, score, ambiguous, second>; ambiguous where the two nearest codewords are
    closer than `margin` in probability."""

    def decoded(texts: list[str | None]) -> list[dict]:
        out: list[dict] = [{"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": False, "second": None}] * len(texts)
        at = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if model.languages else []
        if not at:
            return out
        p = model.decode(np.stack([gram_counts(texts[i]) for i in at]))
        near = np.argsort(-p, axis=1, kind="stable")
        for i, q, o in zip(at, p, near):
            next_ = q[o[1]] if len(o) > 1 else 0.0
            out[i] = {"lang_pred": model.languages[o[0]], "score": float(min(1.0, q[o[0]])), "ambiguous": bool(q[o[0]] - next_ < margin), "second": model.languages[o[1]] if len(o) > 1 else None}
        return out

    kind = pa.struct({"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_(), "second": pa.string()})
    return by_parts(decoded, "lang_pred string, score double, ambiguous boolean, second string", kind)(text)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    model = fit(docs, folds, held_out)
    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known and more likely than all others together."""
    p = predict(F.col("text"), fit(docs))
    name = free_name("__language", docs.columns)
    return docs.withColumn(name, p).where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") > least)).drop(name)
