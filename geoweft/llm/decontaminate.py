"""Benchmark decontamination: words of documents that lie in a window of consecutive benchmark words.

1. Items are normalised to words (A-Z lower-cased, runs of digits, letters and everything beyond ASCII). Their words are
   dealt into blocks, long items in pieces that overlap by a window less one word, so that no window is lost. The cost of
   a block (its bytes and 16 a word) is measured before anything is broadcast; while one is over `at_once` there are more blocks.
2. A block is broadcast. A worker numbers its words and keeps a hash set of its windows. Texts become word numbers, many
   at a time; windows whose rolling hash is in the set are compared number by number, so no result hangs on a hash.
3. One block, the usual case, is one pass without a shuffle. With more, every block is a pass that returns only the texts
   that it hits, by SHA-256; hits of all passes are merged by text and joined to the documents, as they follow from the text alone.

An item of fewer words than a window is one window. Spans reach from the first to the last byte of words hit next to each other.

Defined cases: null texts and texts without words have no words and no hits, and stay as they are; items that are null or
without words have no window; items with a null item_id mark words but are in no list; items that share an item_id count as
one; rows alike get the same result each; a null doc_id stays null; empty tables give no rows, or no hits; texts of any
length are read whole, a megabyte at a time. Other columns of documents pass through, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import by_parts, free_name, kept
from geoweft.tables import materialize

#: Bytes that stay in words, A-Z as a-z; every other one is a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
CHUNK = 1 << 20
FOUND = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"
FOUND_ARROW = pa.struct({"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))})


def words_of(text: Column) -> Column:
    """The same words in DataFrame functions."""
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def chunks(plain: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of some CHUNK bytes each, cut at blanks only."""
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + CHUNK)
        end = len(plain) if end < 0 else end
        yield start, plain[start:end]
        start = end


class Windows:
    """The windows of some items: pieces are (item_id, words joined by blanks)."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], words: int):
        numbers: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in pieces if i is not None})
        item_no = {i: k for k, i in enumerate(self.items)}
        ids, starts, owners, at = [np.zeros(0, np.int32)], {}, {}, 0
        for item, text in pieces:
            own = [numbers.setdefault(w, len(numbers) + 1) for w in text.split()]
            ids.append(np.array(own, np.int32))
            long = min(len(own), words)
            starts.setdefault(long, []).append(np.arange(at, at + len(own) - long + 1))
            owners.setdefault(long, []).append(np.full(len(own) - long + 1, item_no.get(item, -1), np.int32))
            at += len(own)
        self.get, self.ids = numbers.get, np.concatenate(ids)
        seed = 0
        while not self._hashed({n: (np.concatenate(x), np.concatenate(owners[n])) for n, x in starts.items()}, words, seed):
            seed += 1

    def _hashed(self, windows: dict[int, tuple[np.ndarray, np.ndarray]], words: int, seed: int) -> bool:
        """Fills the set; False if two different windows share a hash under this seed."""
        self.odd = np.random.default_rng(seed).integers(1, 1 << 63, words, np.uint64) | np.uint64(1)
        self.by_length = {}
        for long, (place, owner) in windows.items():
            order = np.argsort(key := self.hashes(self.ids, long)[place], kind="stable")
            key, place, owner = key[order], place[order], owner[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            stands = place[first][np.cumsum(new) - 1]
            if any((self.ids[place + k] != self.ids[stands + k]).any() for k in range(long)):
                return False
            shift = np.uint64(64 - min(24, max(10, int(len(first) * 8).bit_length())))
            bits = np.zeros(1 << (64 - int(shift)), bool)
            bits[key[first] >> shift] = True
            self.by_length[long] = key[first], place[first], np.append(first, len(key)), owner, bits, shift
        return True

    def hashes(self, ids: np.ndarray, long: int) -> np.ndarray:
        n = max(0, len(ids) - long + 1)
        out = np.zeros(n, np.uint64)
        wide = ids.astype(np.uint64)
        for k in range(long):
            out += wide[k : k + n] * self.odd[k]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def numbers(self, text: bytes) -> np.ndarray:
        """A number a word; 0 where no item has it."""
        plain = text.translate(PLAIN)
        parts = [np.fromiter(map(self.get, w := c.split(), repeat(0)), np.int32, len(w)) for _, c in chunks(plain)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Whether each word is hit; item numbers by text. ends: where each text ends."""
        edge, own = np.zeros(len(ids) + 1, np.int32), {}
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for long, (key, place, owned, owner, bits, shift) in self.by_length.items():
            n = len(ids) - long + 1
            if n <= 0 or not len(at := np.flatnonzero(unknown[long:] == unknown[:n])):
                continue
            h = self.hashes(ids, long)[at]
            near = bits[h >> shift]
            at, h = at[near], h[near]
            found = np.minimum(np.searchsorted(key, h), len(key) - 1)
            same = key[found] == h
            for k in range(long):
                same &= ids[at + k] == self.ids[place[found] + k]
            at, found = at[same], found[same]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + long, -1)
            for text, window in np.unique(np.stack([np.searchsorted(ends, at, "right"), found], 1), axis=0).tolist():
                own.setdefault(text, set()).update(owner[owned[window] : owned[window + 1]].tolist())
        return np.cumsum(edge[:-1]) > 0, own

    def spans(self, text: bytes, hit: np.ndarray) -> list[dict]:
        """Byte ranges of words hit next to each other."""
        out, place, last = [], 0, -2
        for start, c in chunks(text.translate(PLAIN)):
            for m in WORD.finditer(c):
                if hit[place]:
                    if last == place - 1:
                        out[-1]["end"] = start + m.end()
                    else:
                        out.append({"start": start + m.start(), "end": start + m.end()})
                    last = place
                place += 1
        return out

    def scan(self, texts: list[bytes | None]) -> list[dict]:
        """FOUND of every text, looked up together: a 0 between texts keeps windows apart."""
        numbers = [self.numbers(t or b"") for t in texts]
        ends = np.cumsum([len(x) + 1 for x in numbers])
        apart = np.zeros(1, np.int32)
        hit, own = self.hits(np.concatenate([y for x in numbers for y in (x, apart)] or [apart]), ends)
        out = []
        for k, (text, x) in enumerate(zip(texts, numbers)):
            mine = hit[ends[k] - len(x) - 1 : ends[k] - 1] if k in own else None
            items = sorted(self.items[i] for i in own.get(k, ()) if i >= 0)
            out.append({"n_words": len(x), "n_hit": int(mine.sum()) if k in own else 0, "items": items, "spans": self.spans(text, mine) if k in own else []})
        return out


def blocks_of(benchmark: DataFrame, words: int, at_once: int) -> DataFrame:
    """block, item, piece: different pieces of at most 4,096 words and their overlap, in blocks that cost `at_once` at most
    (or hold a single piece)."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    step = 4096
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - words, F.lit(0)), F.lit(step))
    piece = item.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, step + words - 1))).alias("w"))
    piece = materialize(piece.select("item", F.array_join("w", " ").alias("piece"), F.size("w").alias("n")).distinct(), "benchmark")
    cost = F.sum(F.octet_length("piece") + 16 * F.col("n"))
    total = piece.agg(cost).first()[0] or 0
    blocks = 1 + total // at_once
    while True:
        dealt = piece.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)))
        size = dealt.groupBy("block").agg(cost.alias("cost"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).agg(F.max("cost")).first()[0] or 0
        if size <= at_once:
            return dealt
        blocks *= 2


def _scanner(spark, block: DataFrame, words: int):
    """texts -> FOUND over the windows of one broadcast block."""
    sent, name = spark.sparkContext.broadcast([(r.item, r.piece.encode()) for r in block.collect()]), f"windows-{uuid.uuid4().hex}"

    def scan(texts: list[str | None]) -> list[dict]:
        windows = kept(name, lambda: Windows(sent.value, words))
        return windows.scan([t.encode() if t is not None else None for t in texts])

    return scan


def hits(docs: DataFrame, benchmark: DataFrame, words: int = 10, at_once: int = 32 << 20, found: str | None = None) -> DataFrame:
    """docs with a struct column `found` (free name if None: the last one of the result): n_words, n_hit, items (ids as strings,
    sorted) and spans (bytes, end not included)."""
    spark, found = docs.sparkSession, found or free_name("found", docs.columns)
    dealt = blocks_of(benchmark, words, at_once)
    blocks = [r[0] for r in dealt.select("block").distinct().collect()]
    if len(blocks) < 2:
        return docs.withColumn(found, by_parts(_scanner(spark, dealt, words), FOUND, FOUND_ARROW)(F.col("text")))
    digest, parts = F.sha2("text", 256), None
    for b in blocks:
        run = by_parts(_scanner(spark, dealt.where(F.col("block") == b), words), FOUND, FOUND_ARROW)
        part = docs.select(F.col("text").alias("t")).select(F.sha2("t", 256).alias("digest"), run(F.col("t")).alias("f")).where("f.n_hit > 0").groupBy("digest").agg(F.any_value("f").alias("f"))
        part = materialize(part, f"hits-{b}")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"), F.flatten(F.collect_list("f.spans")).alias("all"), F.max("f.n_words").alias("n_words"))
    # a document without hits has its words counted where it is
    key, text = free_name("key", [*docs.columns, found]), F.coalesce("text", F.lit(""))
    joined = docs.withColumn(key, digest).join(merged.select(F.col("digest").alias(key), F.struct("n_words", "items", "all").alias(found)), key, "left")
    whole = by_parts(_united, FOUND, FOUND_ARROW)(F.struct(text.alias("text"), F.col(f"`{found}`.items").alias("items"), F.col(f"`{found}`.all").alias("all")))
    return joined.withColumn(found, whole).drop(key)


def _united(rows: list[dict]) -> list[dict]:
    """FOUND from the spans of all blocks: words are hit where any of them reaches."""
    out = []
    for r in rows:
        plain = r["text"].encode().translate(PLAIN)
        if not r["all"]:
            out.append({"n_words": sum(len(c.split()) for _, c in chunks(plain)), "n_hit": 0, "items": [], "spans": []})
            continue
        edge = np.zeros(len(plain) + 1, np.int32)
        for s in r["all"]:
            edge[s["start"]] += 1
            edge[s["end"]] -= 1
        inside, n, n_hit, spans, last = np.cumsum(edge) > 0, 0, 0, [], -2
        for start, c in chunks(plain):
            for m in WORD.finditer(c):
                if inside[start + m.start()]:
                    n_hit += 1
                    if last == n - 1:
                        spans[-1]["end"] = start + m.end()
                    else:
                        spans.append({"start": start + m.start(), "end": start + m.end()})
                    last = n
                n += 1
        out.append({"n_words": n, "n_hit": n_hit, "items": r["items"], "spans": spans})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", least: int = 1, words: int = 10, at_once: int = 32 << 20) -> DataFrame:
    """docs without the spans that benchmark windows cover, or (remove="documents") without the documents of `least` hit words
    or more. With spans, documents of fewer stay whole too."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    found = free_name("found", docs.columns)
    marked = hits(docs, benchmark, words, at_once, found)
    enough = F.col(f"`{found}`.n_hit") >= least
    if remove == "documents":
        return marked.where(~enough).drop(found)

    def cut(rows: list[dict]) -> list[str | None]:
        out = []
        for r in rows:
            text, at, left = r["text"], 0, []
            if r["spans"]:
                raw = text.encode()
                for s in r["spans"]:
                    left.append(raw[at : s["start"]])
                    at = s["end"]
                text = b"".join([*left, raw[at:]]).decode()
            out.append(text)
        return out

    done = by_parts(cut, "string", pa.string())(F.struct("text", F.when(enough, F.col(f"`{found}`.spans")).alias("spans")))
    return marked.withColumn("text", done).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, words: int = 10, at_once: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    f = hits(docs.select("doc_id", "text"), benchmark, words, at_once, "found")
    return f.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


#: The same for the default window; documents have distinct ids there.
SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1), lambda p: array_to_string(w[p : p + least(len(w), 10) - 1], ' '))) as win
  from iw where len(w) > 0),
runs as (
  select doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda p: array_to_string(w[p : p + n - 1], ' '))) as win, unnest(generate_series(1, len(w) - n + 1)) as pos
  from dw, (select distinct n from windows) l where len(w) >= n),
found as (select r.doc_id, r.pos, r.n, x.item_id from runs r join windows x on x.n = r.n and x.win = r.win),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(pos, pos + n - 1)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from found where item_id is not null) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(i.n, 0) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from dw d left join hit h using (doc_id) left join items i using (doc_id)
"""
