"""Removes every byte that a string of `length` bytes covers which also starts anywhere else in the corpus.

1. Every window of `length` bytes belongs to one anchor: the gram of `gram` bytes in it with the smallest hash,
   leftmost first. Equal windows have equal anchors at equal places, so only windows whose anchors are equal can
   be. Anchors are grouped by hash; those that occur once are done. Only they are shuffled, not the text.
2. For the others the bytes that their windows span are taken from the text and grouped by anchor. Equal spans
   repeat whole. Where spans of an anchor differ, they go, many anchors at a time, into a run-length index: the
   Burrows-Wheeler transform of the spans, run-compressed, with the suffix array sampled at both ends of runs.
3. Matching statistics are streamed from it: the common prefix with the suffix before and after changes by one
   from position to position except at run ends, so it is measured at the samples and carried along between.
   A start whose statistic reaches `length` occurs twice.
4. Anchors with more rows than an index may hold are never brought together. Their spans are grouped by the span
   itself: what repeats whole is marked as it streams by. Of each different span the windows are counted by a
   128-bit digest, combined before they are shuffled; a start whose window is counted twice occurs twice.
5. The covered bytes of all starts are joined to the documents by text, and cut.

Texts that occur more than once are one text up to here and are removed whole if they hold a window. Matches
never cross documents; overlaps and matches within one document count. Defined cases: null text counts as empty;
texts shorter than `length` lose nothing; texts of any length are read whole, in segments that overlap.
A null doc_id stays null; repeated rows are copies of each other and get the same result each; an empty table gives no rows;
other columns are not read. Texts are told apart by two 64-bit hashes, windows of frequent anchors by a 128-bit one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import by_parts, parts_of
from geoweft.llm.ngram_join import mixed
from geoweft.tables import materialize

BITS = 23
_P = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _power(base: np.uint64, n: int) -> np.ndarray:
    return _powers(base, max(1 << 12, 1 << n.bit_length()))[:n]


def grams(a: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` bytes."""
    s = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * _power(_P, len(a)), out=s[1:])
    n = len(a) - gram + 1
    return mixed((s[gram:] - s[:n]) * _power(_P_INVERSE, n))


def anchors(data: bytes, length: int, gram: int) -> np.ndarray:
    """Columns hash (as signed), place of the anchor, first and last start of the windows it stands for."""
    out = []
    size = (1 << BITS) - length
    for at in range(0, max(0, len(data) - length + 1), size):
        a = np.frombuffer(data, np.uint8)[at : at + size + length - 1]
        h, w = grams(a, gram), length - gram + 1
        packed = (h >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(h), dtype=np.uint64)
        full = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
        full[: len(h)] = packed
        blocks = full.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(a) - length + 1
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], n) - 1
        p = place[first]
        out.append(np.stack([h[p].view(np.int64), p + at, first + at, last + at], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


class RunLengthIndex:
    """Of spans joined by separators: suffix array by doubling, then only what the runs of its transform need."""

    def __init__(self, spans: list[bytes]):
        self.begin = np.cumsum([0] + [len(s) + 1 for s in spans])[:-1]
        text = np.zeros(int(sum(len(s) + 1 for s in spans)), np.int64)
        joined = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8)
        text[:] = joined
        text += 1
        text[self.begin + np.array([len(s) for s in spans])] = 0
        self.text = text
        order = self._suffixes()
        before = np.where(order > 0, text[order - 1], -1)  # the transform
        head = np.concatenate([[True], before[1:] != before[:-1]])
        tail = np.append(head[1:], True)
        self.runs = int(head.sum())
        i, j = np.flatnonzero(head), np.flatnonzero(tail)
        self.heads, self.tails = order[i], order[j]  # samples at both ends of each run
        self.up = self._common(np.where(i > 0, order[i - 1], -1), self.heads)
        self.down = self._common(self.tails, np.where(j + 1 < len(order), order[np.minimum(j + 1, len(order) - 1)], -1))

    def _suffixes(self) -> np.ndarray:
        text, n = self.text, len(self.text)
        key = np.zeros(n, np.int64)
        for k in range(7):
            key <<= 9
            key[: n - k] |= text[k:]
        step = 7
        while True:
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            if rank[order[-1]] == n - 1 or step >= n:
                return order
            key = rank * np.int64(n + 1)
            key[: n - step] += rank[step:] + 1
            step *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b; 0 where one is missing."""
        out = np.zeros(len(a), np.int64)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        n, width = len(self.text), 16
        padded = np.concatenate([self.text, np.full(width, -2)]).astype(np.int16)
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        while len(at):
            x, y = a[at] + out[at], b[at] + out[at]
            differ = view[np.minimum(x, n)] != view[np.minimum(y, n)]
            differ |= ((x[:, None] + np.arange(width)) >= n) | ((y[:, None] + np.arange(width)) >= n)
            some = differ.any(1)
            out[at] += np.where(some, differ.argmax(1), width)
            at = at[~some]
        return out

    def statistics(self) -> np.ndarray:
        """For every position the longest string from it that also starts elsewhere."""
        n = len(self.text)
        found = np.zeros(n, np.int64)
        for places, common in ((self.heads, self.up), (self.tails, self.down)):
            line = np.full(n, -1, np.int64)
            line[places] = common + places
            found = np.maximum(found, np.maximum.accumulate(line) - np.arange(n))
        return found


#: What repeats whole (kind 0), or a window to be counted: the first start of its span, its place there, its digest (kind 1).
MARK = "kind int, k1 long, start int, stop int, w1 long, w2 long"
#: Parts of one repeated window's starts.
SALTS = 16


def windows_of(span: bytes, length: int) -> np.ndarray:
    """Two columns: the digest of every window."""
    n = len(span) - length + 1
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(span[i : i + length]) for i in range(n)]), "<i8").reshape(n, 2)


def runs(places: pd.Series) -> pd.Series:
    """First and last of each run of neighbouring places."""
    out = []
    for x in places:
        x = np.sort(x)
        cut = np.flatnonzero(np.diff(x) > 1)
        out.append([{"start": int(a), "stop": int(b)} for a, b in zip(x[np.append(0, cut + 1)], x[np.append(cut, len(x) - 1)])])
    return pd.Series(out)


def repeated(texts: DataFrame, length: int, gram: int, at_once: int = 3_000_000) -> DataFrame:
    """k1, start, stop of covered bytes, for a table of texts with k1 and n, their hash and length."""
    if not gram <= length <= 4096:
        raise ValueError("length must be from gram to 4096")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 400):
            found = [anchors(t.encode("utf-8", "surrogatepass"), length, gram) for t in b.column("text").to_pylist()]
            x = np.concatenate(found)
            # first start, distance of the anchor from it and number of further starts in one value: rows are what is shuffled
            packed = x[:, 2] << 24 | (x[:, 1] - x[:, 2]) << 12 | (x[:, 3] - x[:, 2])
            k1 = np.repeat(b.column("k1").to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x[:, 0], k1, packed)], ["h", "k1", "windows"])

    every = texts.where(F.col("n") >= length).select("k1", "text").mapInArrow(find, "h long, k1 long, windows long")
    # both uses below read this one exchange: what either one's joins would filter is filtered here, or the two would differ
    every = every.where(F.col("h").isNotNull() & F.col("k1").isNotNull()).repartition("h")
    whole = F.struct("k1", "windows")
    hot = F.count(F.lit(1)) > at_once // (2 * length)
    shared = every.groupBy("h").agg(F.min(whole).alias("x"), F.max(whole).alias("y"), hot.alias("hot")).where("x <> y").select("h", "hot")
    wanted = every.join(shared, "h").groupBy("k1").agg(F.collect_set(F.struct("h", "windows", "hot")).alias("anchors"))
    known = texts.select("k1", "text").groupBy("k1").agg(F.first("text").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"p": pa.int64(), "hot": pa.bool_(), "h": pa.int64(), "lead": pa.int32(), "span": pa.binary(), "k1": pa.int64(), "first": pa.int32()}

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], list(kinds))

        for b in parts_of(batches, 400):
            out: list[tuple] = []
            for k1, text, places in zip(*[b.column(c).to_pylist() for c in ("k1", "text", "anchors")]):
                data = text.encode("utf-8", "surrogatepass")
                for r in places:
                    first, lead, more = r["windows"] >> 24, r["windows"] >> 12 & 4095, r["windows"] & 4095
                    span, p = data[first : first + more + length], r["h"]
                    if r["hot"]:
                        p = xxhash.xxh64_intdigest(span, seed=(p + lead) % 2**64) - 2**63
                    out.append((p, r["hot"], r["h"], lead, span, k1, first))
                    if len(out) > 10_000:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    spans = wanted.join(known, "k1").select("k1", "text", "anchors").mapInArrow(take, "p long, hot boolean, h long, lead int, span binary, k1 long, first int")

    def covered(spans: list[bytes], owners: list[list[tuple]]) -> list[tuple]:
        index, out = RunLengthIndex(spans), []
        hit = index.statistics() >= length
        for begin, span, own in zip(index.begin, spans, owners):
            n = len(span) - length + 1
            starts = np.flatnonzero(hit[begin : begin + n]) if len(own) == 1 else np.arange(n)
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                a, b = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
                out += [(k1, f + int(x), f + int(y) + length) for k1, f in own for x, y in zip(a, b)]
        return out

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts_, owners, size, done = [], [], 0, []
        counted: list[tuple] = []
        alike = one = None
        group: list[tuple[bytes, list[tuple]]] = []
        now = last = None

        def marked(done: list[tuple], counted: list[tuple]) -> pd.DataFrame:
            x = np.array(done, np.int64).reshape(-1, 3)
            n = [len(w) for _, _, w in counted]
            m = np.repeat(np.array([c[:2] for c in counted], np.int64).reshape(-1, 2), n, axis=0)
            w = np.concatenate([np.zeros((len(x), 2), np.int64), *[w for _, _, w in counted]])
            place = np.concatenate([x[:, 2], *[np.arange(k) for k in n]])
            return pd.DataFrame({"kind": np.repeat([0, 1], [len(x), len(m)]), "k1": np.append(x[:, 0], m[:, 0]), "start": np.append(x[:, 1], m[:, 1]), "stop": place, "w1": w[:, 0], "w2": w[:, 1]})

        def close() -> None:
            nonlocal size
            if len(group) == 1:
                span, own = group[0]
                if len(own) > 1:
                    done.extend((k1, f, f + len(span)) for k1, f in own)
            else:
                for span, own in group:
                    texts_.append(span)
                    owners.append(own)
                    size += len(span) + 1

        for b in batches:
            for often, h, lead, span, k1, first in zip(b["hot"], b["h"], b["lead"], b["span"], b["k1"], b["first"]):
                if len(done) > 20_000 or len(counted) > 500:
                    yield marked(done, counted)
                    done, counted = [], []
                if often:
                    if (h, lead, span) != alike:
                        alike, one = (h, lead, span), (k1, first, first + len(span))
                        counted.append((k1, first, windows_of(span, length)))
                    else:
                        if one:
                            done.append(one)
                            one = None
                        done.append((k1, first, first + len(span)))
                    continue
                if h != now:
                    close()
                    group, now, last = [], h, None
                    if size > at_once:
                        done.extend(covered(texts_, owners))
                        texts_, owners, size = [], [], 0
                if (lead, span) != last:
                    last = (lead, span)
                    group.append((span, []))
                group[-1][1].append((k1, first))
        close()
        if texts_:
            done.extend(covered(texts_, owners))
        if done or counted:
            yield marked(done, counted)

    found = materialize(spans.repartition("p").sortWithinPartitions("p", "h", "lead", "span").mapInPandas(mark, MARK), "marked")
    windows = found.where("kind = 1").withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)))
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    twice = twice.select("w1", "w2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    # at most `length` places a span
    hits = windows.join(twice, ["w1", "w2", "salt"], "left_semi").groupBy("k1", "start").agg(F.collect_list("stop").alias("places"))
    hits = hits.select("k1", "start", F.explode(F.pandas_udf(runs, "array<struct<start: int, stop: int>>")("places")).alias("r")).select("k1", (F.col("start") + F.col("r.start")).alias("start"), (F.col("start") + F.col("r.stop") + length).alias("stop"))
    return found.where("kind = 0").select("k1", "start", "stop").unionByName(hits)


def apart(rows: DataFrame) -> DataFrame:
    """rows with k1, a 64-bit number of the text: its hash, or a second hash where another text has the same first one."""
    both = rows.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("second"), "text"))
    clash = both.groupBy("k1").agg(F.min("k2").alias("x"), F.max("k2").alias("y")).where("x <> y").select("k1", F.lit(True).alias("other"))
    if not clash.limit(1).count():  # of 2 ** 32 texts about one pair is expected, of 2 ** 36 some hundred
        return both.drop("k2")
    return both.join(F.broadcast(clash), "k1", "left").withColumn("k1", F.when(F.col("other"), F.col("k2")).otherwise(F.col("k1"))).drop("k2", "other")


def dedup(docs: DataFrame, length: int = 200, gram: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce("text", F.lit(""))
    rows = apart(docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("n")))
    again = rows.groupBy("k1").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # a text that occurs twice stands in for all its copies in the search and is then removed whole
    spans = repeated(rows, length, gram).groupBy("k1").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            data = r["text"].encode("utf-8", "surrogatepass")
            runs = sorted((s["start"], s["stop"]) for s in r["spans"] or [])
            if (r["times"] or 1) > 1 and len(data) >= length:
                runs = [(0, len(data))]
            merged: list[list[int]] = []
            for a, b in runs:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            kept, at = [], 0
            for a, b in merged:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append({"n_removed": sum(b - a for a, b in merged), "n_spans": len(merged), "kept_sha256": hashlib.sha256(b"".join(kept)).hexdigest()})
        return out

    cut_ = by_parts(cut, "n_removed long, n_spans long, kept_sha256 string", pa.struct({"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}))

    joined = rows.join(spans, "k1", "left").join(again, "k1", "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_bytes"), cut_(F.struct("text", "spans", "times")).alias("c")).select("doc_id", "n_bytes", "c.*")
