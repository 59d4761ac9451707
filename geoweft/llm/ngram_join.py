"""N-gram Jaccard join: which documents share at least `least` of the union of their word-shingle sets.

The document by shingle incidence matrix is multiplied with its transpose in blocks, but only where the product
can matter:

1. Documents with equal sets are one row of the matrix from here on (the row's key is a digest of the set).
2. All shingles get one global order, rare before frequent: a count sketch of fixed size, summed over all
   documents, ranks them by what their slot holds above the middle slot; ties by hash. Any total order is exact, a
   good one keeps frequent shingles out.
3. A pair at or above the bound shares a shingle among the first |A| - ceil(least |A|) + 1 of both. Only those
   entries are shuffled, by shingle. Within a column the sizes and positions bound the overlap that is still
   possible. Columns with up to `wide` rows count all pairs of fitting sizes; the counts are added up over all blocks of
   columns, and pairs below the overlap that their sizes ask for are discarded. In wider columns each row meets a pivot
   and its neighbour in size.
4. Blocks of the product: the rows to be held against each other are gathered as a block (its rows' whole sets,
   once each) and the rows asked about; a block is inverted to postings, the overlaps of an asked row with all rows of
   the block are accumulated over its shingles, and counts below the bound are discarded. Links leave, pairs don't.
5. Rows of wide columns whose components still differ are asked about once for each other component: one row
   against the blocks that hold that component. So no component is lost and no group makes all pairs.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. With fewer than `size` words the
whole sequence is the one shingle. Defined cases: null texts and texts without words have an empty set and no
link; equal texts link, whatever their ids; a null doc_id is a document that links by its text, names no component
(component_id is null where no id can be reached) and ranks last; rows with a repeated doc_id are one document each,
and share its number; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Memo, forgetting, free_name, kept, parts_of
from geoweft.operators.components import components
from geoweft.tables import materialize

#: Slots of the count sketch, and of each block of it that travels.
SLOTS, BLOCK = 1 << 22, 1 << 16
NAMES = ["shingle", "a", "b", "n", "m", "place", "hits"]
#: Fewest and most slots of the filter that says which rows are worth fetching; between them it has 10 for each.
FILTER = 1 << 20, 1 << 27


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = kept("ngram words", lambda: Memo(xxhash.xxh64_intdigest, limit=100_000))
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for k in range(min(size, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique(mixed(h))


def digest(s: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh128_intdigest(s.tobytes())
    return both >> 65, (both & (1 << 63) - 1)


def key_of(s: np.ndarray, renamed: dict[tuple[int, int], int]) -> int:
    """The key of a set; of sets whose first 63 bits are the same, all but one have another."""
    both = digest(s)
    return renamed.get(both, both[0]) if renamed else both[0]


def clashes(sets: DataFrame, most: int = 100_000) -> dict[tuple[int, int], int]:
    """New keys, -2 and below, by (key, check): where different sets share a key, all but the first get one. Of n sets some
    n^2 / 2^64 do, so what travels is tiny; more than `most` mean that keys aren't what they should be."""
    shared = sets.groupBy("key").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("key")
    found = sets.select("key", "check").join(shared, "key", "left_semi").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise RuntimeError(f"more than {most} different sets share keys")
    known, out = set(), {}
    for key, check in sorted(tuple(r) for r in found):
        if key in known:
            out[key, check] = -2 - len(out)
        known.add(key)
    return out


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """Rows of doc_id, hash of the text, n, key, check (kind 0) and blocks of the sketch (kind 1: block, counts)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, one, held, waiting, id_kind = np.zeros(SLOTS, np.uint32), np.uint32(1), [], 0, None

        def add() -> None:
            for h in held:  # in place: a count of all slots anew would take several times the sketch
                np.add.at(sketch, (h % np.uint64(SLOTS)).astype(np.int64), one)

        def rows(kind: int, many: int, **columns) -> pa.RecordBatch:
            kinds = {"kind": pa.int32(), "doc_id": id_kind, "hash": pa.int64(), "n": pa.int32(), "key": pa.int64(), "check": pa.int64(), "block": pa.int32(), "counts": pa.binary()}
            columns["kind"] = [kind] * many
            return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(k, [None] * many), pa.Array) else pa.array(c, t) for k, t in kinds.items()], list(kinds))

        for b in parts_of(batches):
            id_kind = b.column("doc_id").type
            ns, keys, checks = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, size)
                key, check = digest(s) if len(s) else (-1, -1)
                ns.append(len(s)), keys.append(key), checks.append(check)
                held.append(s)
                waiting += len(s)
                if waiting > 1_000_000:
                    add()
                    held, waiting = [], 0
            yield rows(0, len(ns), doc_id=b.column("doc_id"), hash=b.column("hash"), n=ns, key=keys, check=checks)
        if waiting:
            add()
        if sketch.any():
            packed = [zstandard.compress(sketch[k : k + BLOCK].astype("<u8").tobytes(), 1) for k in range(0, SLOTS, BLOCK)]
            yield rows(1, len(packed), block=list(range(len(packed))), counts=packed)

    there = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    return there.mapInArrow(forgetting(scan), f"kind int, doc_id {id_type}, hash long, n int, key long, check long, block int, counts binary")


def frequency(profile: DataFrame) -> np.ndarray:
    """One byte a slot: the logarithm of its count above that of the middle slot, which is what single shingles leave
    everywhere. Summed in two steps, so that no task gets more than the square root of the number of partitions; what
    arrives here has a fixed size."""
    parts = profile.where("kind = 1").select("block", "counts", F.spark_partition_id().alias("part"))
    groups = max(1, isqrt(profile.rdd.getNumPartitions()))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for c in rows["counts"]:
            total += np.frombuffer(zstandard.decompress(c), "<u8")
        return pd.DataFrame({"block": [rows["block"].iat[0]], "counts": [zstandard.compress(total.tobytes(), 1)], "part": [0]})

    first = parts.groupBy("block", (F.col("part") % groups).alias("g")).applyInPandas(add, "block int, counts binary, part int")
    total = np.zeros(SLOTS, np.float32)
    for r in first.groupBy("block").applyInPandas(add, "block int, counts binary, part int").toLocalIterator():
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zstandard.decompress(r["counts"]), "<u8")
    middle, level = np.median(total), np.zeros(SLOTS, np.uint8)
    for k in range(0, SLOTS, BLOCK):  # block by block, as the driver's memory is small
        above = np.maximum(total[k : k + BLOCK] - middle, 0)
        level[k : k + BLOCK] = np.minimum(255, np.round(8 * np.log2(1 + above / (2 * np.sqrt(middle + 1)))))
    return level


def fewest(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefixes(docs: DataFrame, level: np.ndarray, size: int, percent: int, renamed: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """shingle, key, n, place: the entries of each set that a link must share one of."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out: list[tuple] = []
        held = 0
        for b in parts_of(batches):
            for text in b.column("text").to_pylist():
                s = shingles(text, size)
                if not len(s):
                    continue
                key = key_of(s, renamed)
                if key in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(key)
                n = len(s) + (-percent * len(s) // 100) + 1
                order = np.lexsort((s, level[(s % np.uint64(SLOTS)).astype(np.int64)]))[:n]
                out.append((s[order].view(np.int64), key, len(s)))
                held += n
                if held > 100_000:
                    yield flat(out)
                    out, held = [], 0
        if out:
            yield flat(out)

    def flat(out: list[tuple]) -> pa.RecordBatch:
        sizes = [len(h) for h, _, _ in out]
        columns = {
            "shingle": np.concatenate([h for h, _, _ in out]), "key": np.repeat(np.array([k for _, k, _ in out], np.int64), sizes),
            "n": np.repeat(np.array([n for _, _, n in out], np.int32), sizes), "place": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
        }
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    return docs.select("text").mapInArrow(forgetting(scan), "shingle long, key long, n int, place int")


def _possible(n, p, m, q, percent: int):
    """Sizes and places at this shared shingle still allow the overlap that a link needs."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (100 * small >= percent * large) & (1 + np.minimum(n - p - 1, m - q - 1) >= fewest(n, m, percent))


def _columns(batches: Iterator[pd.DataFrame], keep: int = 0) -> Iterator[pd.DataFrame]:
    """Sorted rows, each key once a shingle, with those of the last, perhaps unfinished, shingle held back.
    With keep, a column of over 100,000 rows leaves in parts that all begin with its first `keep` rows."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        h, key = b["shingle"].to_numpy(), b["key"].to_numpy()
        b = b[np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])]
        cut = int(np.searchsorted(b["shingle"].to_numpy(), b["shingle"].iat[-1]))
        if cut:
            yield b.iloc[:cut]
        rest = b.iloc[cut:]
        if keep and len(rest) > 100_000:
            yield rest
            rest = rest.iloc[:keep]
    if rest is not None and len(rest):
        yield rest


def products(entries: DataFrame, percent: int, wide: int) -> DataFrame:
    """shingle, a, b, n, m, place, hits: counts of pairs (shingle 0; a is the smaller set, ties by key; n and m are their
    sizes, hits the narrow columns that they share in this row, place 1 if one of them allows a link), and the entries (key as a,
    b 0) of wide columns. Pairs of wide columns have no hits."""
    schema = "shingle long, a long, b long, n int, m int, place int, hits int"

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set = set()
        out: list[list[np.ndarray]] = []

        def put(*columns) -> None:
            size = len(columns[1])
            out.append([np.full(size, c, np.int64) if np.isscalar(c) else c for c in columns])

        def flush() -> pd.DataFrame:
            done = pd.DataFrame({k: np.concatenate(c) for k, c in zip(NAMES, zip(*out))})
            out.clear()
            return done

        for b in _columns(batches, keep=wide + 1):
            if sum(len(c[0]) for c in out) > 20_000:
                yield flush()
            h = b["shingle"].to_numpy()
            alone = np.concatenate([[True], h[1:] != h[:-1]]) & np.concatenate([h[1:] != h[:-1], [True]])
            h, key, n, p = (b[c].to_numpy()[~alone] for c in ("shingle", "key", "n", "place"))
            if not len(h):
                continue
            n, p = n.astype(np.int64), p.astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            width = np.diff(np.append(start, len(h)))
            row, whole = np.arange(len(h)) - np.repeat(start, width), np.repeat(width, width)
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for gap in range(1, int(min(wide, width.max()))):
                i = np.flatnonzero((whole <= wide) & (row + gap < whole))
                i = i[100 * n[i] >= percent * n[i + gap]]
                x.append(i), y.append(i + gap)
            i, j = np.concatenate(x), np.concatenate(y)
            put(0, key[i], key[j], n[i], n[j], _possible(n[i], p[i], n[j], p[j], percent).astype(np.int64), 1)
            near = np.flatnonzero((whole > wide) & (row + 1 < whole))
            x, y, columns = [near], [near + 1], []
            for s, w in zip(start[width > wide], width[width > wide]):
                at, i = s, s + 1
                while i < s + w:  # a new pivot where a row is too large for the last one
                    end = s + int(np.searchsorted(n[s : s + w], 100 * n[at] // percent, "right"))
                    x.append(np.full(max(0, end - i), at)), y.append(np.arange(i, max(i, end)))
                    at, i = max(i, end), max(i, end) + 1
                columns.append((h[s : s + w], key[s : s + w], n[s : s + w], p[s : s + w]))
            i, j = np.concatenate(x), np.concatenate(y)
            ok = _possible(n[i], p[i], n[j], p[j], percent)
            i, j = i[ok], j[ok]
            new = [q for q in set(zip(key[i].tolist(), key[j].tolist(), n[i].tolist(), n[j].tolist())) if q not in made]
            if len(made) > 200_000:
                made.clear()
            made.update(new)
            if new:
                put(0, *np.array(new, np.int64).T, 1, 0)
            for hs, ks, ns, ps in columns:
                put(hs, ks, 0, ns, 0, ps, 0)
        if out:
            yield flush()

    dealt = entries.repartition("shingle").sortWithinPartitions("shingle", "n", "key")
    return dealt.mapInPandas(forgetting(multiply), schema)


def counted(made: DataFrame, percent: int) -> DataFrame:
    """cell, key: the pairs of products() whose accumulated hits still allow a link. What two sets share is in both of their
    prefixes or in the rest of the one whose prefix ends first; of shared wide columns there are no more than either has."""
    pairs = made.where("shingle = 0 and b <> 0").groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("place").alias("place"), F.first("n").alias("n"), F.first("m").alias("m")).where("place = 1")
    broad = materialize(made.where("b = 0").select("shingle", "a").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("broad")), "broad")
    for end in ("a", "b"):
        pairs = pairs.join(broad.select(F.col("a").alias(end), F.col("broad").alias(f"broad_{end}")), end, "left")
    both = F.least(F.coalesce("broad_a", F.lit(0)), F.coalesce("broad_b", F.lit(0)))
    rest = F.greatest(F.expr(f"({percent} * n + 99) div 100 - 1"), F.expr(f"({percent} * m + 99) div 100 - 1"))
    asked = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    return pairs.where(F.col("hits") + both + rest >= asked).select(F.col("a").alias("cell"), F.col("b").alias("key"))


def crossing(columns: DataFrame, percent: int, block: int = 5000) -> DataFrame:
    """key, component, cell: rows of wide columns to be held against another component (cell), the larger one of a pair
    of rows that may link; columns has shingle, key, n, place, component and its number of rows, `held`.
    Of such a pair one row at least is outside the column's largest component: those rows (side 0) meet all (side 1), in
    blocks of about `block` rows by `block` rows."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: set = set()
        for b in _blocks(batches):
            new: set = set()
            for _, g in b.groupby(["shingle", "x", "y"]):
                c, key, n, p, held = (g[x].to_numpy() for x in ("component", "key", "n", "place", "held"))
                n, p = n.astype(np.int64), p.astype(np.int64)
                every = np.flatnonzero(g["side"].to_numpy() == 1)
                for i in np.flatnonzero(g["side"].to_numpy() == 0).tolist():
                    j = every[c[every] != c[i]]
                    j = j[_possible(n[i], p[i], n[j], p[j], percent)]
                    if not len(j):
                        continue
                    into = (held[j] > held[i]) | ((held[j] == held[i]) & (c[j] < c[i]))
                    new.update((int(key[i]), int(c[i]), t) for t in np.unique(c[j[into]]).tolist())
                    new.update((k, t, int(c[i])) for k, t in zip(key[j[~into]].tolist(), c[j[~into]].tolist()))
            new -= made
            if len(made) > 300_000:
                made.clear()
            made |= new
            if new:
                yield pd.DataFrame(np.array(list(new), np.int64), columns=["key", "component", "cell"])

    sizes = columns.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed_ = sizes.groupBy("shingle").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("top")).where("top.rows < rows")
    mixed_ = mixed_.select("shingle", F.col("top.component").alias("main"), F.ceil((F.col("rows") - F.col("top.rows")) / block).alias("outer"), F.ceil(F.col("rows") / block).alias("whole"))
    rows, salt, zero = columns.join(mixed_, "shingle"), F.xxhash64("key"), F.lit(0).cast("long")
    kept_ = ["shingle", "key", "n", "place", "component", "held"]
    outside = rows.where("component <> main").select(*kept_, F.lit(0).alias("side"), F.pmod(salt, "outer").alias("x"), F.explode(F.sequence(zero, F.col("whole") - 1)).alias("y"))
    every = rows.select(*kept_, F.lit(1).alias("side"), F.explode(F.sequence(zero, F.col("outer") - 1)).alias("x"), F.pmod(salt, "whole").alias("y"))
    dealt = outside.unionByName(every).repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
    return dealt.mapInPandas(forgetting(multiply), "key long, component long, cell long").distinct()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows, with those of the last, perhaps unfinished, block held back."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        same = (b[["shingle", "x", "y"]] == b[["shingle", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
        cut = int(same.argmax())
        if cut:
            yield b.iloc[:cut]
        rest = b.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def slot_bits(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The filter of a table's doc_ids, one bit for each slot of their hashes, and its slots: at least 10 a row, 16 MB at most."""
    slots = min(FILTER[1], max(FILTER[0], 1 << (10 * rows.count()).bit_length()))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(slots // 8, np.uint8)
        for b in batches:
            at = b["slot"].to_numpy()
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    bits = np.zeros(slots // 8, np.uint8)
    some = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot")).distinct().coalesce(8)
    for r in some.mapInPandas(gather, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r["bits"], np.uint8)
    return bits, slots


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def fetched(docs: DataFrame, keys: DataFrame, firsts: DataFrame, size: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """key, set: the whole sets of the wanted keys. Only one document of each is shingled again: a filter by doc_id leaves
    out most others, and what it lets through too much joins nothing."""
    wanted = keys.distinct()
    bits, slots = slot_bits(wanted.join(firsts, "key"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in parts_of([b.filter(pa.array(in_filter(shared.value, b.column("slot").to_numpy())))]):
                found = [s for s in (shingles(t, size) for t in some.column("text").to_pylist()) if len(s)]
                yield pa.RecordBatch.from_pydict({"key": pa.array([key_of(s, renamed) for s in found], pa.int64()), "set": pa.array([s.tobytes() for s in found], pa.binary())})

    there = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"), "text")
    return there.mapInArrow(forgetting(shingled), "key long, set binary").groupBy("key").agg(F.first("set").alias("set")).join(wanted, "key", "left_semi")


def linked(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cell, key: rows asked about (side 1) that link with a row of the block (side 0) of the same cell and part. The product
    of a block: its rows' postings by shingle, overlaps accumulated over the shingles of each row asked about."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, post = None, [], None
        for b in batches:
            out = []
            for cell, part, side, key, data in zip(b["cell"].tolist(), b["part"].tolist(), b["side"].tolist(), b["key"].tolist(), b["set"]):
                if (cell, part) != now:
                    now, rows, post = (cell, part), [], None
                s = np.frombuffer(data, np.uint64)
                if side == 0:
                    rows.append(s)
                    continue
                if not rows:
                    continue
                if post is None:
                    m = np.array([len(r) for r in rows])
                    every, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), m)
                    order = np.argsort(every, kind="stable") if len(rows) > 1 else np.arange(len(every))
                    post = every[order], owner[order]
                low, high = np.searchsorted(post[0], s, "left"), np.searchsorted(post[0], s, "right")
                width = high - low
                at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
                overlap = np.bincount(post[1][at], minlength=len(rows))
                if (100 * overlap >= percent * (len(s) + m - overlap)).any():
                    out.append((cell, key))
            yield pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["cell", "key"])

    dealt = blocks.join(sets, "key").repartition("cell", "part").sortWithinPartitions("cell", "part", "side")
    return dealt.mapInPandas(forgetting(multiply), "cell long, key long")


def dealt(rows: DataFrame, asked: DataFrame, per_block: int, per_lane: int) -> DataFrame:
    """cell, part, side, key: the rows of a cell (cell, key, n) in blocks of about `per_block` entries, each met by those asked
    about (cell, key) in lanes of about `per_lane` rows, so that no task gets a cell of any size whole."""
    zero, salt = F.lit(0).cast("long"), F.xxhash64("key")
    parts = rows.groupBy("cell").agg(F.ceil(F.sum("n") / per_block).alias("blocks")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_lane).alias("lanes")), "cell")
    block = rows.join(parts, "cell").select("cell", F.explode(F.transform(F.sequence(zero, F.col("lanes") - 1), lambda k: F.pmod(salt, "blocks") * F.col("lanes") + k)).alias("part"), F.lit(0).alias("side"), "key")
    lane = asked.join(parts, "cell").select("cell", F.explode(F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: k * F.col("lanes") + F.pmod(salt, "lanes"))).alias("part"), F.lit(1).alias("side"), "key")
    return block.unionByName(lane)


def classes(docs: DataFrame, size: int = 5, percent: int = 75, wide: int = 4, per_block: int = 1_000_000, per_lane: int = 4000) -> DataFrame:
    """doc_id, hash (of the text), n, key, class: a row for each document; documents of one class are linked, class is null
    for those without words."""
    profile = materialize(profiles(docs, size), "profiles")
    level = frequency(profile)
    sets = profile.where("kind = 0").select("doc_id", "hash", "n", "key", "check")
    if renamed := clashes(sets.where("n > 0")):
        names = docs.sparkSession.createDataFrame([(*both, to) for both, to in renamed.items()], "key long, check long, to long")
        sets = sets.join(F.broadcast(names), ["key", "check"], "left").select("doc_id", "hash", "n", F.coalesce("to", "key").alias("key"))
    firsts = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))

    def held(rows: DataFrame, asked: DataFrame) -> DataFrame:
        blocks = materialize(dealt(rows.join(firsts.select("key", "n"), "key"), asked, per_block, per_lane), "blocks")
        return linked(blocks, fetched(docs, blocks.select("key"), firsts, size, renamed), percent)

    made = materialize(products(prefixes(docs, level, size, percent, renamed), percent, wide), "products")
    pairs = materialize(counted(made, percent), "pairs")
    first = materialize(held(pairs.select("cell", F.col("cell").alias("key")).distinct(), pairs), "links")
    class_of = materialize(components(first, "cell", "key"), "classes")
    sizes = class_of.groupBy("component").agg(F.count(F.lit(1)).alias("held"))
    known = class_of.join(sizes, "component").select(F.col("node").alias("key"), "component", "held")
    columns = made.where("b = 0").select("shingle", F.col("a").alias("key"), "n", "place").distinct()
    named = columns.join(known, "key", "left").withColumn("component", F.coalesce("component", "key")).withColumn("held", F.coalesce("held", F.lit(1).cast("long")))
    asked = materialize(crossing(named, percent), "asked")
    if asked.limit(1).count():
        cells = asked.select("cell").distinct().join(class_of, F.col("cell") == F.col("component"), "left").select("cell", F.coalesce("node", "cell").alias("key"))
        late = held(cells, asked).distinct().join(asked, ["cell", "key"]).select(F.col("cell").alias("a"), F.col("component").alias("b"))
        merged = components(materialize(late, "links")).select(F.col("node").alias("component"), F.col("component").alias("merged"))
        alone = asked.select(F.col("component").alias("node")).unionByName(asked.select(F.col("cell").alias("node"))).distinct()
        every = class_of.unionByName(alone.join(class_of, "node", "left_anti").select("node", F.col("node").alias("component")))
        class_of = every.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    whole = sets.join(class_of.select(F.col("node").alias("key"), "component"), "key", "left")
    return whole.select("doc_id", "hash", "n", "key", F.when(F.col("n") > 0, F.coalesce("component", "key")).alias("class"))


def join(docs: DataFrame, size: int = 5, percent: int = 75, wide: int = 4, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    whole = materialize(classes(docs, size, percent, wide, **sizes), "classes")
    least = whole.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    named = whole.join(least, "class", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest doc_id (nulls last), of two texts under it that
    of the smaller hash, of rows alike in both any one. Rows without words are linked with nothing and all stay. Columns may have any names."""
    rows = materialize(classes(docs, size, percent).select("doc_id", "hash", "n", "class"), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    best = rows.where("n > 0").groupBy("class").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class", "r")
    # of a class of one nothing goes; of the others all rows go but one, and what is left of rows alike is decided on few
    ranked = rows.join(best, "class").select("doc_id", "hash", rank.eqNullSafe(F.col("r")).alias("best"))
    id_, hash_, best_, rows_, text_, hit_ = (free_name(f"__{c}", docs.columns) for c in ("id", "hash", "best", "rows", "text", "hit"))
    marks = materialize(ranked.groupBy(F.col("doc_id").alias(id_), F.col("hash").alias(hash_)).agg(F.bool_or("best").alias(best_), F.count(F.lit(1)).alias(rows_)), "marks")
    own = [f"`{c}`" for c in docs.columns]
    gone = marks.where(~(F.col(best_) & (F.col(rows_) == 1)))
    bits, slots = slot_bits(gone.select(F.col(id_).alias("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def hit(slots_: pa.Array) -> pa.Array:
        return pa.array(in_filter(shared.value, slots_.to_numpy()))

    # rows whose slot nothing that goes has stay where they are, and only the others are joined
    marked = docs.withColumn(text_, F.xxhash64("text")).withColumn(hit_, hit(F.pmod(F.xxhash64("doc_id"), F.lit(slots))))
    some = marked.where(F.col(hit_))
    same = some["doc_id"].eqNullSafe(F.col(id_)) & (F.col(text_) == F.col(hash_))
    stay = marked.where(~F.col(hit_)).select(*own).unionByName(some.join(gone, same, "left_anti").select(*own))
    alike = marks.where(F.col(best_) & (F.col(rows_) > 1))
    if not alike.limit(1).count():
        return stay
    return stay.unionByName(some.join(alike, same).dropDuplicates([id_, hash_]).select(*own))
