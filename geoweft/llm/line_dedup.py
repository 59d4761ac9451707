"""Substring dedup by unit: lines (or paragraphs) that repeat anywhere in the corpus stay only once.

A unit is normalised (lower case, runs of white space as one space, none at either end) and digested with
MD5. Digests are grouped globally; of each the occurrence with the smallest (doc_id, text hash, place) is
kept and all others are removed from their texts. Units of under `least` normalised characters are never
removed: so short a line repeats by chance. Offsets are those of the original text, in characters.

Units are cut, normalised and digested by DataFrame functions and written once; both uses read that table. Digests
are counted with map-side sums, so that a line that a third of all rows hold is one row a task. Occurrences of
digests that occur twice or more are found by two joins: the most frequent digests, no more than `most_hot` of them
whatever the input, are broadcast, so that their occurrences stay where they are; a digest left for the shuffled
join has no more than a `most_hot`-th of all units.

Passages: a run of neighbouring units that all occur elsewhere too, first occurrences included, with `passage` words
or more; too short units neither end a run nor count. Its ends often lie inside lines that aren't alike, hence a
bound below the length looked for.

Defined cases: null text stays null with no units; null doc_id ranks last; rows alike in doc_id and text
count as one document and get the same result each (their units count once); a text may lose all it has and is then
empty; an empty table gives no rows; other columns pass through, whatever their names; a caller's own __removed or
__passages stays, and the two made here, which come last, then have another line before their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import by_parts, free_name
from geoweft.tables import materialize

WHITE = r"[ \t\r\n\f\x0B]"
CUTS = {"line": re.compile("\n"), "paragraph": re.compile(rf"\n[ \t]*\n{WHITE}*")}


def spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Start and end of each unit; the cut belongs to the unit before it."""
    start = 0
    for cut in CUTS[unit].finditer(text):
        yield start, cut.end()
        start = cut.end()
    yield start, len(text)


SPACE = re.compile(WHITE + "+")


def normal(piece: str) -> str:
    return SPACE.sub(" ", piece).strip(" ").lower()


def pieces(text: Column, unit: str) -> Column:
    """The same units as text, perhaps without their cuts."""
    return F.split(text, CUTS[unit].pattern, -1)


def units(docs: DataFrame, unit: str = "line", least: int = 24) -> DataFrame:
    """doc_id, key, place, words, digest of every unit; the digest is null for units too short to be removed."""
    there = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(pieces(F.col("text"), unit)).alias("place", "piece"))
    plain = there.select("doc_id", "key", "place", F.lower(F.trim(F.regexp_replace("piece", WHITE + "+", " "))).alias("unit"))
    return plain.select("doc_id", "key", "place", F.size(F.split("unit", " ")).alias("words"), F.when(F.length("unit") >= least, F.unhex(F.md5("unit"))).alias("digest"))


def rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "place")


def repeated_units(docs: DataFrame, unit: str = "line", least: int = 24, most_hot: int = 50_000) -> DataFrame:
    """doc_id, key, places (place, words, gone) of the units that occur elsewhere too, by document; gone: to be removed."""
    found = materialize(units(docs, unit, least).where("digest is not null"), "units")
    counted = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank()).alias("first")).where(F.col("n") > 1)
    repeated = materialize(counted, "repeated")
    often = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1000, often // most_hot)  # so many digests at most have more than a most_hot-th
    sides = [repeated.where(hot).hint("broadcast"), repeated.where(~hot)]
    both = [found.join(side.select("digest", "first"), "digest") for side in sides]
    mark = F.struct("place", "words", (~rank().eqNullSafe(F.col("first"))).alias("gone"))
    return both[0].unionByName(both[1]).select("doc_id", "key", mark.alias("mark")).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("mark")).alias("places"))


def dedup(docs: DataFrame, unit: str = "line", least: int = 24, passage: int = 25, most_hot: int = 50_000) -> DataFrame:
    """All columns of docs with `text` cut, `__removed`: the original [start, end) of each run cut out, and `__passages`: that
    of each repeated passage, kept or not."""

    def cut(rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            t, found = row["text"], row["places"]
            if t is None or not found:
                out.append({"text": t, "removed": [], "passages": []})
                continue
            marks = {m["place"]: m for m in found}
            kept, runs, passages = [], [], []
            open_, words = None, 0

            def close() -> None:
                if open_ and words >= passage:
                    passages.append(open_)

            for place, (a, b) in enumerate(spans(t, unit)):
                mark = marks.get(place)
                if mark is None or not mark["gone"]:
                    kept.append(t[a:b])
                elif runs and runs[-1]["end"] == a:
                    runs[-1]["end"] = b
                else:
                    runs.append({"start": a, "end": b})
                if mark is not None:
                    open_ = {"start": open_["start"] if open_ else a, "end": b}
                    words += mark["words"]
                elif len(normal(t[a:b])) >= least:
                    close()
                    open_, words = None, 0
            close()
            out.append({"text": "".join(kept), "removed": runs, "passages": passages})
        return out

    places = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))
    cut_ = by_parts(cut, "text string, removed array<struct<start: int, end: int>>, passages array<struct<start: int, end: int>>", pa.struct({"text": pa.string(), "removed": places, "passages": places}))

    id_, key_, places_, cut_to = (free_name(f"__{c}", docs.columns) for c in ("id", "key", "places", "cut"))
    gone = repeated_units(docs, unit, least, most_hot).select(F.col("doc_id").alias(id_), F.col("key").alias(key_), F.col("places").alias(places_))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key_)), "left")
    done = joined.withColumn(cut_to, cut_(F.struct(F.col("text"), F.col(places_).alias("places"))))
    own = [F.col(f"{cut_to}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*own, F.col(f"{cut_to}.removed").alias(free_name("__removed", docs.columns)), F.col(f"{cut_to}.passages").alias(free_name("__passages", docs.columns)))


def summary(docs: DataFrame, unit: str = "line", least: int = 24, passage: int = 25) -> DataFrame:
    """doc_id, n_chars, n_removed (characters), n_spans, spans as text, kept_sha256, and n_passage_chars: characters in
    passages that occur elsewhere too, first occurrences included."""
    cut = dedup(docs.select("doc_id", "text"), unit, least, passage)
    width = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]))
    kept = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", (F.length(kept) + width("__removed")).cast("long").alias("n_chars"), width("__removed").alias("n_removed"), F.size("__removed").cast("long").alias("n_spans"),
        F.array_join(F.transform("__removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("spans"), F.sha2(kept, 256).alias("kept_sha256"),
        width("__passages").alias("n_passage_chars"),
    )


#: The same over the default unit, length and words; documents have distinct ids there.
SQL = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as place
  from documents where text is not null),
sized as (
  select doc_id, place, len(line) + case when place < max(place) over (partition by doc_id) then 1 else 0 end as n, line,
         lower(trim(regexp_replace(line, '[ \t\r\n\f\v]+', ' ', 'g'))) as norm
  from lines),
placed as (
  select *, coalesce(sum(n) over (partition by doc_id order by place rows between unbounded preceding and 1 preceding), 0) as at_char,
         row_number() over (partition by norm order by doc_id, place) as nth, count(*) over (partition by norm) as times
  from sized),
marked as (select *, (length(norm) >= 24 and nth > 1) as gone, (length(norm) >= 24 and times > 1) as again, (length(norm) >= 24 and times = 1) as own from placed),
grouped as (select *, place - row_number() over (partition by doc_id, gone order by place) as island, sum(case when own then 1 else 0 end) over (partition by doc_id order by place) as stretch from marked),
runs as (
  select doc_id, min(at_char) as a, max(at_char + n) as b from grouped where gone group by doc_id, island),
cut as (
  select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans,
         string_agg(cast(cast(a as bigint) as varchar) || '-' || cast(cast(b as bigint) as varchar), ',' order by a) as spans
  from runs group by doc_id),
passages as (
  select doc_id, max(at_char + n) - min(at_char) as n from grouped where again group by doc_id, stretch having sum(len(string_split(norm, ' '))) >= 25),
passed as (select doc_id, cast(sum(n) as bigint) as n from passages group by doc_id),
last as (select doc_id, max(place) as final from marked group by doc_id),
kept as (
  select doc_id, string_agg(line || case when place < final then chr(10) else '' end, '' order by place) as text
  from marked join last using (doc_id) where not gone group by doc_id)
select d.doc_id, cast(coalesce(length(d.text), 0) as bigint) as n_chars, coalesce(c.n_removed, 0) as n_removed,
       coalesce(c.n_spans, 0) as n_spans, coalesce(c.spans, '') as spans, sha256(coalesce(k.text, '')) as kept_sha256, coalesce(p.n, 0) as n_passage_chars
from documents d left join cut c using (doc_id) left join kept k using (doc_id) left join passed p using (doc_id)
"""
