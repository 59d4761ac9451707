"""Best-fit packing of token sequences by hierarchical residual packing.

Documents are tokenised, ended by one id and cut only where they are longer than a sequence. Every partition
packs its pieces best-fit, longest first, block by block; bins with almost no residual leave at once, underfull
ones stay as items of the next block. What is underfull at the end of a partition goes up a tree: the open bins
of several partitions meet as items of another best-fit round, until one group is left or a round joins
nothing more. A group never holds more than `group` open bins, and rows hold no ids, only their lengths.

Words are encoded once and remembered while they keep coming: the vocabulary's pre-tokeniser never joins across white space.

Defined cases: null text counts as empty, an empty text is the end id alone; an added token's text within a text is that
token, as the library has it; repeated rows are packed each by itself; a null doc_id stays null and its pieces are packed
like others; ties in length are broken by (doc_id, piece), nulls last; an empty table gives no rows; other columns are not
read. Texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import kept, parts_of
from geoweft.tables import materialize

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBER = "struct<doc_id: long, piece: int, start: long, length: int, ids_crc32: long, offset: int>"
BIN = f"open boolean, fill int, members array<{MEMBER}>"
#: The same to Arrow.
PIECE_A = pa.schema({"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()})
BIN_A = pa.schema({"open": pa.bool_(), "fill": pa.int32(), "members": pa.list_(pa.struct([*PIECE_A, pa.field("offset", pa.int32())]))})


class Remembered(dict):
    """A dict that forgets what hasn't been asked for lately: of two halves the older one goes when the newer is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit // 2, {}

    def missing(self, keys: set) -> set:
        """Which of the keys aren't known; all others are here afterwards."""
        new = keys.difference(self)
        if self.older and new:
            again = new.intersection(self.older)
            self.update(zip(again, map(self.older.__getitem__, again)))
            new -= again
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
            again = keys.intersection(self.older)
            self.update(zip(again, map(self.older.__getitem__, again)))
        return new


class WordEncoder:
    """Ids of whole texts from ids of words. Marks at the end of a word are a match of their own, and letters are
    lower-cased, so both are seen to in the whole text before it is cut into words: forms of a word are one then. New
    all-letter words are encoded as one text and cut again where the vocabulary marks the end of a word."""

    LONGEST = 64  # characters of a word that is remembered
    MARKS = re.compile(r"""[.,!?;:%$#&*_/\\()\[\]{}"+=~^@`-](?<=[^\W_].)[.,!?;:%$#&*_/\\()\[\]{}"+=~^@`-]*(?!\S)""")

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.special = lambda text: any(map(text.lower().__contains__, added))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Remembered(limit)
        self.odd = re.compile("[\x1c-\x1f]").search  # white space to Python alone

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(some):  # another vocabulary marks no ends
                self.known.update((w, self._one(w)) for w in some)
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(some, cut):
                self.known[w] = data[at : 4 * end]
                at = 4 * end

    def _words(self, text: str) -> list[str]:
        if self.odd(text):
            return [text]
        if self.special(text):  # an added token is matched as it stands, so nothing is taken from its word
            return text.split()
        return self.MARKS.sub(r" \g<0>", text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")).split()  # A-Z alone

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = list(map(self._words, texts))
        every = set().union(*words)
        # long words, and whole texts where white space isn't what it seems, are encoded but not remembered
        long = {w for w in every if len(w) > self.LONGEST}
        every -= long
        new = self.known.missing(every)
        plain = [w for w in new if w.isalpha()]
        self._letters(plain)
        if len(plain) < len(new):
            self.known.update((w, self._one(w)) for w in new if not w.isalpha())
        if not long:
            return [b"".join(map(self.known.__getitem__, row)) for row in words]
        once = {w: self._one(w) for w in long}
        return [b"".join(once[w] if w in once else self.known[w] for w in row) for row in words]


def encoder(path: str, remembered: int) -> WordEncoder:
    return kept(f"{remembered} words of {path}", lambda: WordEncoder(path, remembered))


def _cut(batches: Iterable[pa.RecordBatch], path: str, size: int, end: int, remembered: int) -> Iterator[tuple]:
    """doc_id, piece, start, length, ids_crc32 of batches of doc_id and text."""
    last = np.array([end], "<u4").tobytes()
    for b in parts_of(batches, 500):
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder(path, remembered).encode([t or "" for t in b.column("text").to_pylist()])):
            ids += last
            for p, a in enumerate(range(0, len(ids), 4 * size)):
                one = ids[a : a + 4 * size]
                yield doc_id, p, a // 4, len(one) // 4, zlib.crc32(one)


def pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1, remembered: int = 400_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_cut([b], path, size, end, remembered))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, PIECE_A.types)], schema=PIECE_A)

    return _texts(docs).mapInArrow(cut, PIECE)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: the longest first, each into the open bin it fills most."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= n
        free[r].append(b)
        mask |= 1 << r
    return bins


def _joined(items: list[tuple[int, list[tuple]]], capacity: int) -> list[tuple[int, list[tuple]]]:
    """Items and bins alike: (fill, members as (doc_id, piece, start, length, ids_crc32))."""
    items.sort(key=lambda x: (-x[0], [(m[0] is None, m[0] or 0, m[1]) for m in x[1][:1]]))
    return [(sum(items[i][0] for i in b), [m for i in b for m in items[i][1]]) for b in best_fit([f for f, _ in items], capacity)]


def _frame(bins: list[tuple[int, list[tuple]]], open_: bool) -> pd.DataFrame:
    rows = []
    for fill, members in bins:
        at, out = 0, []
        for doc_id, piece, start, length, crc in members:
            out.append({"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "offset": at})
            at += length
        rows.append((open_, fill, out))
    return pd.DataFrame(rows, columns=["open", "fill", "members"])


def _members(rows) -> list[tuple]:
    return [(m["doc_id"], m["piece"], m["start"], m["length"], m["ids_crc32"]) for m in rows]


def _packed(parts: Iterable[tuple], capacity: int, slack: int, block: int) -> Iterator[pd.DataFrame]:
    """Bins of one partition's pieces, block by block: full ones at once, underfull ones as items of the next block."""
    held: list[tuple[int, list[tuple]]] = []
    new = 0
    for part in parts:
        held.append((part[3], [part]))
        new += 1
        if new == block:
            held, new = _joined(held, capacity), 0
            done = [x for x in held if capacity - x[0] <= slack]
            held = [x for x in held if capacity - x[0] > slack]
            if len(held) > block:  # too long to be joined with anything here
                held.sort(key=lambda x: x[0])
                yield _frame(held[block:], True)
                held = held[:block]
            yield _frame(done, False)
    held = _joined(held, capacity)
    yield _frame([x for x in held if capacity - x[0] <= slack], False)
    yield _frame([x for x in held if capacity - x[0] > slack], True)


def _frames(frames: Iterable[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    for f in frames:
        for k in range(0, len(f), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(f[c].iloc[k : k + 2000].tolist(), t) for c, t in zip(BIN_A.names, BIN_A.types)], schema=BIN_A)


def pack(parts: DataFrame, capacity: int = 4096, slack: int = 4, block: int = 20_000, group: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, start, length, ids_crc32."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        rows = (row for b in parts_of(batches, 2000) for row in zip(*[b.column(c).to_pylist() for c in names]))
        return _frames(_packed(rows, capacity, slack, block))

    return _treed(parts.mapInArrow(local, BIN), capacity, slack, group)


def _treed(bins: DataFrame, capacity: int, slack: int, group: int) -> DataFrame:
    def meet(rows: pa.Table) -> pa.Table:
        bins = _joined([(f, _members(m)) for f, m in zip(rows.column("fill").to_pylist(), rows.column("members").to_pylist())], capacity)
        both = [_frame([x for x in bins if (capacity - x[0] > slack) == open_], open_) for open_ in (False, True)]
        return pa.Table.from_batches(_frames(both), BIN_A)

    def written(bins: DataFrame, turn: int) -> DataFrame:
        """Bins get their number once, when they are written."""
        return materialize(bins.withColumn("sequence_id", F.monotonically_increasing_id() * 64 + turn), "bins")

    made = written(bins, 0)
    done, open_, before = [made.where(~F.col("open"))], made.where("open"), None
    for turn in range(1, 41):
        n = open_.count()
        groups = -(-n // group)
        if not n or before is not None and (before[1] == 1 or n > 0.98 * before[0] and groups == before[1]):
            break
        first = F.col("members")[0]
        to = F.pmod(F.xxhash64(first["doc_id"], first["piece"], "fill"), F.lit(groups))
        met = written(open_.groupBy(to.alias("g")).applyInArrow(meet, BIN), turn)
        done.append(met.where(~F.col("open")))
        open_, before = met.where("open"), (n, groups)
    every = open_
    for d in done:
        every = every.unionByName(d)
    out = every.select("sequence_id", F.explode("members").alias("m"))
    return out.select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32", "sequence_id", F.col("m.offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end: int = 1, slack: int = 4, block: int = 20_000, group: int = 20_000, remembered: int = 400_000) -> DataFrame:
    """Texts are encoded, cut and packed within their partition in one pass of one worker, which remembers the ids of up to
    `remembered` words."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frames(_packed(_cut(batches, path, size, end, remembered), size, slack, block))

    return _treed(_texts(docs).mapInArrow(local, BIN), size, slack, group)
