"""How far the sources of each language are apart in their words, and which words make them so.

1. Every text becomes an exact sparse vector (term, count) in the task that reads it, and vectors are added to their group's sums at
   once, as a summarizer does: `sum` (occurrences) and `non_zero` (documents) by language, source and term. A task holds at most
   `at_once` sums and hands them on when it has more, so what is shuffled are sums and no vectors, and no group's size matters.
2. Sums meet by language and term. A language's vocabulary are its terms in at least `min_df` documents, of these the `vocab_size`
   most frequent; its default, the greatest integer, leaves none out. The vocabulary is a table and never on the driver.
3. p = 1 + floor(10^9 (count + 1) / (N + V)) for each group and term, in decimals and long integers only.
4. Pairs of sources are evaluated sparsely. Over terms that neither source has, f is one number; over terms that one has, it hangs on
   that one's count alone; only terms that both have are visited by pair. Entries are dealt by language, block of terms and pair of
   tiles of sources, so a task has a bounded part of any language, adds up in a matrix of two tiles, and returns one row a pair.

Defined cases: null text, lang and source are empty, and rows alike count each; a language without vocabulary has value 0 in all its
pairs; ties go by item in UTF-8 order; a language of one source has no pairs; an empty table gives no rows; doc_id and other columns
aren't read, whatever their names. Texts of any length are read whole: those over 16 MB in several passes, each over a share of the terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoweft.tables import materialize

#: Bytes that stay in terms, A-Z as a-z; every other one is a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LARGEST, LONG_TEXT, CHUNK = 2**31 - 1, 16 << 20, 1 << 20
SCALE = 1_000_000_000


def vectors(text: bytes) -> Iterator[dict[bytes, int]]:
    """Counts by term; of a very long text in several parts, no two of which share a term."""
    plain = text.translate(PLAIN)
    parts = 1 + len(plain) // LONG_TEXT
    if parts == 1:
        yield Counter(plain.split())
        return
    for part in range(parts):
        found, start = Counter(), 0
        while start < len(plain):
            end = plain.find(b" ", start + CHUNK)
            end = len(plain) if end < 0 else end
            found.update(w for w in plain[start:end].split() if hash(w) % parts == part)
            start = end
        yield found


def sums(docs: DataFrame, at_once: int = 200_000) -> DataFrame:
    """lang, source, term, sum, non_zero, perhaps in several rows; a row of the empty term stands for each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("sum", pa.int64()), ("non_zero", pa.int64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        held = seen = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in groups.items():
                items = list(terms.items())
                for k in range(0, len(items) + 1, 50_000):
                    part = items[k : k + 50_000]
                    term, total, docs_ = [t for t, _ in part], [x[0] for _, x in part], [x[1] for _, x in part]
                    if k == 0:
                        term, total, docs_ = [b"", *term], [0, *total], [0, *docs_]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), pa.array([source] * len(term), pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(docs_, pa.int64())], schema=schema)
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                mine, raw = groups[lang.as_py(), source.as_py()], text.as_py().encode()
                for vector in vectors(raw):
                    before = len(mine)
                    for term, n in vector.items():
                        if (have := mine.get(term)) is None:
                            mine[term] = [n, 1]
                        else:
                            have[0] += n
                            have[1] += 1
                    held += len(mine) - before
                seen += len(raw)
                if held + len(groups) >= at_once or seen >= 8 * LONG_TEXT:
                    yield from handed_on()
                    mine, held, seen = None, 0, 0
        yield from handed_on()

    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(summed, "lang string, source string, term string, sum bigint, non_zero bigint")


def counted(docs: DataFrame, min_df: int = 3, vocab_size: int = LARGEST) -> DataFrame:
    """lang, source, term, n, total (the language's), first (in one row a term) of the vocabulary; the empty term as in sums()."""
    by = W.partitionBy("lang", "term")
    met = sums(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("sum").alias("n"), F.sum("non_zero").alias("docs"))
    met = met.withColumns({"df": F.sum("docs").over(by), "total": F.sum("n").over(by), "first": F.min("source").over(by) == F.col("source")})
    met = met.where((F.col("term") == "") | (F.col("df") >= min_df)).drop("docs", "df")
    if vocab_size < LARGEST:
        there = met.where("first and term != ''").withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("total"), "term"))).where(F.col("place") <= vocab_size)
        met = met.where("term = ''").unionByName(met.join(there.select("lang", "term"), ["lang", "term"], "left_semi"))
    return materialize(met, "terms")


def p_of(n: Column, words: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (words + terms)) without rounding."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, F.greatest(words + terms, F.lit(1)).cast("decimal(20,0)"))


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(lang: str, block: int, one_tile: bool, rows: pa.Table, at_once: int = 1 << 20) -> pa.Table:
    """lang, source, item, value: what one block of terms adds to every pair that one tile, or two different ones, have."""
    source = rows["source"].combine_chunks().dictionary_encode()
    names, no = source.dictionary, source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tile, p, p0, v, is_group = (rows[c].to_numpy() for c in ("tile", "p", "p0", "terms", "is_group"))
    n = len(names)
    alone, tiles = np.ones(n, np.int64), np.zeros(n, np.int64)
    alone[no], tiles[no] = p0, tile
    total = np.zeros((n, n), np.int64)
    both = _f(alone[:, None], alone[None, :])
    if block == 0:
        total += v.max() * both
    entry = np.flatnonzero(~is_group)
    if len(entry):
        no, p, term = no[entry], p[entry], rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)[entry]
        # terms that one source has, whatever the other: each different count once
        mine, times = np.unique(np.stack([no, p], 1), axis=0, return_counts=True)
        step = max(1, at_once // n)
        for k in range(0, len(mine), step):
            (a, x), m = mine[k : k + step].T, times[k : k + step, None]
            np.add.at(total, a, m * (_f(x[:, None], alone[None, :]) - both[a]))
            np.add.at(total.T, a, m * (_f(alone[None, :], x[:, None]) - both.T[a]))
        # terms that both have
        order = np.argsort(term, kind="stable")
        no, p, term = no[order], p[order], term[order]
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        size = np.diff(np.append(start, len(term)))
        first, width = np.repeat(start, size), np.repeat(size, size)
        ends, k = np.cumsum(width), 0
        while k < len(term):
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + at_once, "right")))
            w = width[k:upto]
            i = np.repeat(np.arange(k, upto), w)
            j = np.repeat(first[k:upto], w) + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            a, b = no[i], no[j]
            np.add.at(total, (a, b), _f(p[i], p[j]) - _f(p[i], alone[b]) - _f(alone[a], p[j]) + both[a, b])
            k = upto
    a, b = np.nonzero(~np.eye(n, dtype=bool) if one_tile else tiles[:, None] != tiles[None, :])
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(total[a, b], pa.int64())})


def pair_values(entries: DataFrame, groups: DataFrame, tile: int = 256, block: int = 200_000) -> DataFrame:
    """lang, source, item, value of all pairs of sources of a language; entries: lang, source, term, p; groups: lang, source, p0,
    terms, sources, entries (the last three of the language)."""
    tiles, blocks = F.ceil(F.col("sources") / tile), F.greatest(F.ceil(F.col("entries") / block), F.lit(1))
    known = groups.select("lang", "source", "p0", "terms", tiles.alias("tiles"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), tiles).alias("tile"))
    own = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit("").alias("term"), F.lit(0).cast("long").alias("p"), F.lit(True).alias("is_group"))
    rest = entries.join(known, ["lang", "source"]).withColumns({"block": F.pmod(F.xxhash64("term"), "blocks"), "is_group": F.lit(False)})
    names = ["lang", "source", "tile", "block", "term", "p", "p0", "terms", "is_group"]
    rows = own.select("tiles", *names).unionByName(rest.select("tiles", *names))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "other")

    def added(key: tuple, t: pa.Table) -> pa.Table:
        lang, at, low, high = (x.as_py() for x in key)
        return _pairs(lang, at, low == high, t)

    parts = rows.groupBy("lang", "block", "low", "high").applyInArrow(added, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def audit(docs: DataFrame, min_df: int = 3, vocab_size: int = LARGEST, most_terms: int = 200) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank."""
    found = counted(docs, min_df, vocab_size)
    real = F.col("term") != ""
    by_source = found.groupBy("lang", "source").agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("words"), F.count(F.when(real, 1)).alias("entries"),
        F.count(F.when(real & F.col("first"), 1)).alias("terms"), F.sum(F.when(real & F.col("first"), F.col("total")).otherwise(0)).alias("all_words"))
    by_source = materialize(by_source, "groups")
    by_lang = by_source.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("all_words").alias("all_words"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("sources"))
    groups = by_source.select("lang", "source", "words").join(by_lang, "lang").withColumn("p0", p_of(F.lit(0).cast("long"), F.col("words"), F.col("terms")))
    entries = found.where(real).join(groups.select("lang", "source", "words", "terms", "all_words"), ["lang", "source"])
    entries = entries.select("lang", "source", "term", p_of(F.col("n"), F.col("words"), F.col("terms")).alias("p"), p_of(F.col("total"), F.col("all_words"), F.col("terms")).alias("q"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= most_terms)
    pairs = pair_values(entries.drop("q"), groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(terms)


SQL = r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct doc) >= 3),
langs as (select lang, count(*) as v, sum(n) as words from kept group by lang),
c as (select lang, source, term, count(*) as n from w join kept k using (lang, term) group by lang, source, term),
g as (select d.lang, d.source, coalesce(l.v, 0) as v, coalesce(s.words, 0) as words
  from (select distinct lang, source from d) d left join langs l using (lang) left join (select lang, source, sum(n) as words from c group by lang, source) s using (lang, source)),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.words + g.v) as p, 1 + (1000000000::hugeint * (k.n + 1)) // (l.words + l.v) as q
  from g join kept k on k.lang = g.lang join langs l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(coalesce((x.p - y.p) * (x.p - y.p) // y.p, 0)) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
    left join dense x on x.lang = a.lang and x.source = a.source left join dense y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from dense where n > 0 and p > q)
select lang, source, 'pair' as part, item, cast(value as bigint) as value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
union all
select lang, source, 'term', item, cast(value as bigint), rank from (select *, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200
"""
