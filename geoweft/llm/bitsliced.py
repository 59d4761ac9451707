"""Exact top-k by inner product with a bit-sliced index.

Vectors are quantised to integers. A block of rows stores, for every attribute, one bitmap for each bit of its
value above the block's smallest. A query's score is a sum of attributes times constants: each constant is
recoded into signed digits, and every digit adds an attribute's slices, shifted, to the score's slices; a negative
digit adds the complement. All bitmaps of one weight are added at once with carry-save adders (and, or, xor).
Only the upper slices of attributes are added first, which gives a lower bound of each score and a common width of
what is missing. The k-th largest bound is found from the most significant slice downward; rows whose bound is
within the width of it are the boundary rows, and those are resolved with exact integer products.

Rows are dealt into blocks once and stay there: a block is indexed and all queries stream past it. Each block leaves k
rows a query, and the best k of those are the result. What a task holds is its block, whatever the number of queries.

Defined cases: vectors that are null or hold null or non-finite components take no part; null ids take no part; a query
meets only vectors of its own length (those of length 0 score 0) and never a row with its own id; repeated rows count
each; ties go to the smaller id; fewer than k others give all of them. Vectors with a component of 2 ** 21 or more in
size are scored by whole numbers of any length beside the index; a score that no long can hold is given as the nearest
long, and such scores rank by their first 40 bits or so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _add(bitmaps: list[np.ndarray], words: int) -> list[np.ndarray]:
    """Bitmaps by weight (stacks of them) to one bitmap a weight: the sum of all, bit by bit."""
    out, carry = [], np.zeros((0, words), np.uint64)
    level = 0
    while level < len(bitmaps) or len(carry):
        x = np.concatenate([carry, bitmaps[level]]) if level < len(bitmaps) else carry
        up = []
        while len(x) > 2:
            n = len(x) // 3
            a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
            ab = a ^ b
            up.append((a & b) | (ab & c))
            x = np.concatenate([ab ^ c, x[3 * n :]])
        if len(x) == 2:
            up.append((x[0] & x[1])[None])
            out.append(x[0] ^ x[1])
        else:
            out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        carry = np.concatenate(up) if up else np.zeros((0, words), np.uint64)
        level += 1
    return out


def signed_digits(v: int) -> list[tuple[int, int]]:
    """(power of two, +1 or -1), no two powers neighbours."""
    out, k = [], 0
    while v:
        if v & 1:
            d = 2 - (v & 3)
            out.append((k, d))
            v -= d
        v >>= 1
        k += 1
    return out


class Index:
    """Bit slices of a block of integer vectors."""

    def __init__(self, x: np.ndarray, upper: int = 8):
        self.x, self.n = x, len(x)
        self.low = x.min(0)
        y = (x - self.low).astype(np.uint64)
        bits = max(1, int(y.max()).bit_length())
        self.skip = max(0, bits - upper)
        self.bits = bits - self.skip
        self.words = -(-self.n // 64)
        self.pad = np.zeros(self.words * 64, bool)
        self.pad[: self.n] = True
        self.all = np.packbits(self.pad, bitorder="little").view(np.uint64)
        wide = np.zeros((x.shape[1], self.words * 64), np.uint64)
        wide[:, : self.n] = (y >> np.uint64(self.skip)).T
        self.slices = np.stack([np.packbits((wide >> np.uint64(b)) & np.uint64(1) == 1, axis=1, bitorder="little").view(np.uint64) for b in range(self.bits)], 1)

    def top(self, q: np.ndarray, k: int, barred: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best of those not barred: all of the true ones, perhaps some more."""
        allowed = self.all.copy()
        for i in barred:
            allowed[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        free = self.n - len(barred)
        if free <= k:
            return np.setdiff1d(np.arange(self.n), barred)
        pick: dict[int, list[np.ndarray]] = {}
        for d, v in enumerate(q.tolist()):
            for power, sign in signed_digits(v):
                s = self.slices[d] if sign > 0 else ~self.slices[d]
                for b in range(self.bits):
                    pick.setdefault(power + b, []).append(s[b])
        slack = sum(1 << power for v in q.tolist() for power, _ in signed_digits(v)) * ((1 << self.skip) - 1) >> self.skip
        if not pick:
            slices = [np.zeros(self.words, np.uint64)]
        else:
            empty = np.zeros((0, self.words), np.uint64)
            slices = _add([np.stack(pick[w]) if w in pick else empty for w in range(max(pick) + 1)], self.words)
        # the k-th largest lower bound, most significant slice first
        sure, open_, kth = 0, allowed, 0
        for w in range(len(slices) - 1, -1, -1):
            ones = open_ & slices[w]
            n = int(np.bitwise_count(ones).sum())
            kth <<= 1
            if sure + n >= k:
                open_, kth = ones, kth | 1
            else:
                sure, open_ = sure + n, open_ & ~slices[w]
        # rows whose bound is at least kth - slack - 1
        least = max(0, kth - slack - 1)
        above, equal = np.zeros(self.words, np.uint64), allowed
        for w in range(len(slices) - 1, -1, -1):
            if least >> w & 1:
                equal = equal & slices[w]
            else:
                above |= equal & slices[w]
                equal = equal & ~slices[w]
        found = np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.n]
        return np.flatnonzero(found)


#: Components from here on are scored beside the index.
WIDE = 2.0**21


def finite(vectors: DataFrame) -> DataFrame:
    """id, v: array<double>, of the rows that take part."""
    v = F.transform("vector", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False))).select("id", v.alias("v"))


def whole(x: list[float], scale: int) -> list[int]:
    """floor(scale * x), whatever its size."""
    return [int(c) * scale if abs(c) >= 2.0**52 else math.floor(c * scale) for c in x]


def near(s: int) -> float:
    """Ordered as s is, for whole numbers that no double can hold: the number of bits and the first of them."""
    bits = abs(s).bit_length()
    return (bits + (abs(s) >> max(0, bits - 53)) / 2**53) * (1 if s >= 0 else -1)


class Block:
    """Rows that queries stream past: ids and vectors, indexed in parts; those with wide components apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int, most: int):
        self.scale = scale
        narrow = (np.abs(x) < WIDE).all(1)
        self.wide = [(i, whole(v, scale)) for i, v in zip(ids[~narrow].tolist(), x[~narrow].tolist())]
        ids, x = ids[narrow], x[narrow]
        order = np.argsort(ids, kind="stable")
        ids, y = ids[order], np.floor(scale * x[order]).astype(np.int64)
        self.parts = [(ids[k : k + most], Index(y[k : k + most]) if y.shape[1] else None, y[k : k + most]) for k in range(0, len(ids), most)]

    def best(self, q_id: int, v: list[float], k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows with another id."""
        q = whole(v, self.scale)
        narrow = all(abs(c) < WIDE for c in v)
        found = [(sum(a * b for a, b in zip(w, q)), i) for i, w in self.wide if i != q_id]
        for ids, index, y in self.parts:
            own = np.arange(np.searchsorted(ids, q_id), np.searchsorted(ids, q_id, "right"))
            if index is None or not narrow:
                at = np.setdiff1d(np.arange(len(ids)), own)
            else:
                at = index.top(np.array(q, np.int64), k, own)
            if narrow and max(map(abs, q), default=0) < 1 << 20 and (not y.size or int(np.abs(y[at]).max(initial=0)) < 1 << 20):
                score = (y[at] @ np.array(q, np.int64).reshape(-1)).tolist()
            else:
                score = [sum(a * b for a, b in zip(r, q)) for r in y[at].tolist()]
            found += zip(score, ids[at].tolist())
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, per_block: int = 32_768) -> DataFrame:
    """query_id, rank, id, score; both frames have id and v as finite() gives them."""
    salts = max(1, -(-vectors.count() // per_block))
    rows = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(salts)).cast("int").alias("salt"), F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), "v")
    asked = queries.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), "v")
    low, high = -(2**63), 2**63 - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("dim", "salt", "side")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for start, end in zip(cuts, cuts[1:]):
                dim, salt, side = key[start].tolist() if end > start else (0, 0, 0)
                if end == start:
                    continue
                if (dim, salt) != now:
                    now, held, block = (dim, salt), [], None
                ids, v = b.column("id").slice(start, end - start).to_numpy(), b.column("v").slice(start, end - start).flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((end - start, 0))
                if side == 0:
                    held.append((ids.copy(), v.copy()))
                    continue
                if block is None and held:
                    block = Block(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]), scale, per_block)
                    held = []
                if block is None:
                    continue
                out = [(q_id, i, min(max(s, low), high), near(s)) for q_id, q in zip(ids.tolist(), v.tolist()) for s, i in block.best(q_id, q, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score", "near"])

    dealt = rows.unionByName(asked).repartition("dim", "salt").sortWithinPartitions("dim", "salt", "side", "id")
    found = dealt.mapInArrow(search, "query_id long, id long, score long, near double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.when(F.col("score").isin(low, high), F.col("near"))), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by `every`."""
    v = finite(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return top_k(v, v.where(F.pmod("id", F.lit(every)) == 0), k, **sizes).withColumnRenamed("id", "vec_id")


SQL = """
with v as (
  select vec_id, [cast(floor(1024e0 * cast(x as double)) as hugeint) for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select vec_id as query_id, e as f from v where vec_id % 100 = 0),
scored as (
  select query_id, vec_id, cast(coalesce(list_sum([e[i] * f[i] for i in range(1, len(e) + 1)]), 0) as bigint) as score
  from q join v on vec_id <> query_id and len(e) = len(f)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 10
"""
