"""How the sources of a language differ in their words, in exact arithmetic.

Texts become lower-cased terms. ``CountVectorizer`` is fitted per language with a minimum of documents and the largest integer as
its vocabulary size, and turns documents into exact sparse vectors; what it is fitted on are lists that stand for the documents of
a task, in which a term reaches the minimum if and only if it does in the documents; sums of these by source are kept as rows (language, source,
term, count). A language with more distinct terms than ``section_terms`` is fitted in as many sections of its terms, so that no
vocabulary that the driver or a broadcast holds exceeds that bound; sections add up to the whole language.

With counts, a term's smoothed share is p = 1 + floor(10^9 (count + 1) / (N + V)) in a source and q in another source or in the
language, and what sets them apart is f = floor((p - q)^2 / q). Sums over all terms of a language for all pairs of its sources are
taken sparsely. Terms that neither source has give one number; terms that one of them has follow from how many terms it has with
each count; only terms that both have are met, in cells of bounded blocks of terms and sources, as sums by pair.

Null text, language and source count as ''. A source without terms, and a language without kept terms (value 0), have their rows.
Repeated rows are documents. Very long texts are counted whole. Equal values are ordered by the item's bytes. Other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import quoted, stored
from creditloom.session import fresh_path

#: Upper-case ASCII letters in lower case, other letters and all bytes above ASCII as they are, the rest as spaces.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Sources of a block, entries of a cell, and pairs of entries that a cell looks at once.
SOURCES, ENTRIES, AT_ONCE = 64, 50_000, 1_000_000
#: Terms that a task counts before it passes its lists on.
HELD = 400_000
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    least_documents: int = 3
    top: int = 200
    #: Distinct terms, rare ones included, that one fit may have about.
    section_terms: int = 700_000
    #: Fits that run at the same time.
    at_once: int = 2


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of every text, from the bytes of the batch as a whole."""
    whole = [(x or "").encode() for x in texts.to_pylist()]
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    # A space after each text keeps terms from running into the next one.
    letters = np.frombuffer(b" ".join([*whole, b""]).translate(_LETTERS), np.uint8)
    inside = letters != 32
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    values = pa.Array.from_buffers(
        pa.utf8(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters[inside].tobytes())]
    )
    borders = np.concatenate(([0], np.cumsum(lengths + 1)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, borders).astype(np.int32)), values)


def _by_folder(df: DataFrame, name: str) -> DataFrame:
    """Rows of (lang, section, ..., terms), stored in a folder for each language and section, which ``folder`` names."""
    path, spark = fresh_path(df.sparkSession, name), df.sparkSession
    # A folder's name is the language in letters and digits.
    folder = F.concat(F.lit("l"), F.hex(F.encode("lang", "utf-8")), F.lit("s"), F.col("section"))
    df.withColumn("folder", folder).write.partitionBy("folder").parquet(path)
    kinds = ", ".join(f"{n} {k}" for n, k in df.dtypes)
    return spark.read.schema(f"{kinds}, folder string").parquet(path)


def _chosen(docs: DataFrame, *cols: str) -> DataFrame:
    """The given columns as text; null is ''."""
    return docs.select(*(F.coalesce(quoted(c).cast("string"), F.lit("")).alias(f"c{k}") for k, c in enumerate(cols)))


def sections_of(terms: pa.StringArray, sections: int) -> np.ndarray:
    """The section of each term: a polynomial of its bytes, for a batch as a whole."""
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    if not len(data):
        return np.zeros(len(terms), np.int64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.zeros(len(terms), np.uint64)
    sums[sizes > 0] = np.add.reduceat(data * powers[place], ends[:-1][sizes > 0])
    return ((sums ^ (sums >> np.uint64(31))) % np.uint64(sections)).astype(np.int64)


def dealt(terms: pa.ListArray, sections: int) -> tuple[np.ndarray, pa.ListArray]:
    """Each row's terms in sections: rows 0 to ``sections`` - 1 of the result are the first row's."""
    sizes = np.diff(terms.offsets.to_numpy())
    key = np.repeat(np.arange(len(terms)) * sections, sizes) + sections_of(terms.flatten(), sections)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=len(terms) * sections)))).astype(np.int32)
    moved = terms.flatten().take(pa.array(np.argsort(key, kind="stable")))
    return np.arange(len(terms) * sections) // sections, pa.ListArray.from_arrays(pa.array(offsets), moved)


def condensed(docs: DataFrame, audit: Audit, text_col: str, lang_col: str) -> DataFrame:
    """lang, section (0), level, terms: few documents that keep or drop the same terms as all documents do; stored.

    Of the texts that a task has counted, level k lists the terms in at least k of them, up to the minimum of documents. A term is
    in that minimum of all texts if and only if it is in as many of these lists.
    """
    least = audit.least_documents

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def lists() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                for level in range(1, least + 1):
                    terms = [t for t, n in found.items() if n >= level]
                    columns = [[lang], [0], [level], [terms]]
                    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                    arrays[3] = arrays[3].cast(pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "section", "level", "terms"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(text.as_py().encode().translate(_LETTERS).split())
                counts.setdefault(lang, Counter()).update(words)
                if sum(map(len, counts.values())) > HELD:
                    yield from lists()
                    counts.clear()
        yield from lists()

    made = _chosen(docs, lang_col, text_col).mapInArrow(condense, "lang string, section int, level int, terms array<string>")
    return stored(made, "condensed")


def with_terms(docs: DataFrame, sections: dict[str, int], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, section, source, terms, folder of every document; a language of several sections has a row for each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                langs, terms = batch.column(0).to_pylist(), terms_of(batch.column(2))
                for n in sorted({sections[x] for x in langs}):
                    rows = np.flatnonzero([sections[x] == n for x in langs])
                    own = terms.take(pa.array(rows))
                    # A language of one section has its terms as they are.
                    at, own = (np.arange(len(rows)), own) if n == 1 else dealt(own, n)
                    columns = [c.take(pa.array(rows[at])) for c in batch.columns[:2]]
                    yield pa.RecordBatch.from_arrays(
                        [columns[0], pa.array(np.arange(len(at)) % n, pa.int32()), columns[1], own],
                        ["lang", "section", "source", "terms"],
                    )

    made = _chosen(docs, lang_col, source_col, text_col).mapInArrow(split, "lang string, section int, source string, terms array<string>")
    return _by_folder(made, "terms")


def _of_section(lists: DataFrame, section: int, sections: int) -> DataFrame:
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = dealt(batch.column(0), sections)[1]
                at = pa.array(np.arange(section, len(found), sections))
                yield pa.RecordBatch.from_arrays([found.take(at)], ["terms"])

    return lists if sections == 1 else lists.mapInArrow(own, "terms array<string>")


def section_counts(lists: DataFrame, table: DataFrame, audit: Audit) -> DataFrame:
    """source, at, term, n, every (n over all sources), head (once a term) of a language's or section's kept terms; stored.

    ``lists`` has the terms of the condensed documents, ``table`` the source and terms of all.
    """
    spark = table.sparkSession
    # A term no text can have, in enough documents to be kept: a fit without any term would fail.
    none = spark.range(audit.least_documents).select(F.array(F.lit(" ")).alias("terms"))
    counter = CountVectorizer(
        inputCol="terms", outputCol="vector", minDF=float(audit.least_documents), vocabSize=2**31 - 1
    )
    model = counter.fit(lists.unionByName(none))
    path = fresh_path(spark, "vocabulary")
    model.write().save(path)
    words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("at", "term"))
    vector = F.unwrap_udt("vector")
    entry = F.explode(F.arrays_zip(vector["indices"].alias("at"), vector["values"].alias("n"))).alias("e")
    entries = model.transform(table).select("source", entry).select("source", "e.at", F.col("e.n").cast("long").alias("n"))
    # One exchange by term serves its name and its sum over all sources.
    summed = entries.groupBy("source", "at").agg(F.sum("n").alias("n")).repartition("at")
    term = Window.partitionBy("at")
    every, head = F.sum("n").over(term).alias("every"), (F.min("source").over(term) == F.col("source")).alias("head")
    return stored(summed.join(words, "at").select("source", "at", "term", "n", every, head), "section-counts")


def group_counts(docs: DataFrame, audit: Audit, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """lang, source of every group; and lang, source, at, term, n, every, head: how often a source and its language have each kept term."""
    lists = condensed(docs, audit, text_col, lang_col)
    known = lists.where("level = 1").select("lang", F.explode_outer("terms").alias("term"))
    # A row for each language; the driver fits them one by one, a few at a time.
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("term").alias("n")).collect()}
    sections = {lang: max(1, -(-n // audit.section_terms)) for lang, n in sorted(sizes.items())}
    terms = with_terms(docs, sections, text_col, lang_col, source_col)

    def fit(lang: str, section: int) -> DataFrame:
        folder = f"l{lang.encode().hex().upper()}s{section}"
        table = terms.where(F.col("folder") == folder).select("source", "terms")
        own = _of_section(lists.where(F.col("lang") == lang).select("terms"), section, sections[lang])
        # Numbers of terms are a section's own; with the section they are the language's.
        at = (F.col("at") + (section << 32)).alias("at")
        return section_counts(own, table, audit).select(F.lit(lang).alias("lang"), "source", at, "term", "n", "every", "head")

    with ThreadPoolExecutor(audit.at_once) as pool:
        parts = list(pool.map(lambda w: fit(*w), [(lang, k) for lang, n in sections.items() for k in range(n)]))
    return terms.where("section = 0").select("lang", "source").distinct(), reduce(DataFrame.unionByName, parts)


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), without rounding."""
    return F.expr(f"1 + {UNIT} * cast({n} + 1 as decimal(20,0)) div ({total} + {kept})").cast("long")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def source_groups(every: DataFrame, counts: DataFrame) -> DataFrame:
    """gid, lang, source, total, whole, kept, none (the share of a term it lacks), block, blocks, parts of every group; stored.

    ``total`` is the group's number of occurrences, ``whole`` the language's, ``kept`` the language's number of terms.
    """
    sums = (F.sum("n").alias("total"), F.count("*").alias("terms"), F.count_if("head").alias("heads"))
    own = every.join(counts.groupBy("lang", "source").agg(*sums), ["lang", "source"], "left").fillna(0)
    own = stored(own, "source-totals")
    languages = own.groupBy("lang").agg(
        F.sum("total").alias("whole"),
        F.sum("heads").alias("kept"),
        F.ceil(F.count("*") / SOURCES).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.sum("terms") / ENTRIES), F.lit(1)).cast("int").alias("parts"),
    )
    met = own.drop("terms", "heads").join(languages, "lang")
    none = F.when(F.col("kept") > 0, share("0L", "total", "kept")).otherwise(F.lit(1))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    return stored(met.select(F.monotonically_increasing_id().alias("gid"), "*", none.alias("none"), block.alias("block")), "groups")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a block of sources, once for each block of the language that it meets; columns low and high name the two."""
    met = rows.withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"low": F.least("block", "_met"), "high": F.greatest("block", "_met")}).drop("_met", "blocks")


def _sums(left: np.ndarray, right: np.ndarray, value: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values by pair of numbers of groups, as gids."""
    out = np.zeros(len(groups) ** 2, np.int64)
    np.add.at(out, left * len(groups) + right, value)
    seen = np.unique(left * len(groups) + right)
    return groups[seen // len(groups)], groups[seen % len(groups)], out[seen]


PAIRS = "gid long, other long, value long"


def base_values(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """The value of every pair of sources as if they had no term in common."""
    # How many terms a group has with each share; one row without terms makes sure that each group is there.
    spread = entries.groupBy("gid", "p").agg(F.count("*").alias("terms"))
    own = groups.select("gid", "lang", "block", "blocks", "kept", "none")
    rows = own.join(spread, "gid").unionByName(own.withColumns({"p": F.col("none"), "terms": F.lit(0).cast("long")}))

    def base(table: pa.Table) -> pa.Table:
        gid, block = table["gid"].to_numpy(), table["block"].to_numpy()
        p, terms, none, kept = (table[c].to_numpy() for c in ("p", "terms", "none", "kept"))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        first = np.unique(gid, return_index=True)[1]
        found: list[tuple] = []
        for g in first:
            others = first[(block[first] != block[g]) | (low == high)]
            others = others[gid[others] != gid[g]]
            if not len(others):
                continue
            lacked = _apart(none[g], none[others])
            mine = np.flatnonzero(gid == gid[g])
            value = kept[g] * lacked if kept[g] else np.zeros(len(others), np.int64)
            for k in mine[terms[mine] > 0]:
                value = value + terms[k] * (_apart(p[k], none[others]) - lacked)
            place = np.searchsorted(gid[others], gid) if len(others) else None
            place = np.minimum(place, len(others) - 1)
            theirs = np.flatnonzero((gid[others][place] == gid) & (terms > 0))
            np.add.at(value, place[theirs], terms[theirs] * (_apart(none[g], p[theirs]) - lacked[place[theirs]]))
            found.append((np.full(len(others), gid[g]), gid[others], value))
        return _pairs(found)

    return _dealt(rows).groupBy("lang", "low", "high").applyInArrow(base, PAIRS)


def _pairs(found: list[tuple]) -> pa.Table:
    joined = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else ((), (), ()))]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("gid", "other", "value"), joined)})


def common_values(entries: DataFrame) -> DataFrame:
    """What the terms that both sources of a pair have add to the base value, as sums by cell."""
    def common(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        term = table["at"].to_numpy()
        order = np.argsort(term, kind="stable")
        term = term[order]
        gid, block, p, none = (table[c].to_numpy()[order] for c in ("gid", "block", "p", "none"))
        groups, local = np.unique(gid, return_inverse=True)
        start = np.searchsorted(term, term, "left")
        size = np.searchsorted(term, term, "right") - start
        steps = np.concatenate(([0], np.cumsum(size)))
        found = []
        at = 0
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(steps, steps[at] + AT_ONCE, "right")) - 1)
            n = size[at:end]
            i = np.repeat(np.arange(at, end), n)
            j = np.repeat(start[at:end], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            right = (i != j) & ((block[i] != block[j]) | (low == high))
            i, j = i[right], j[right]
            value = _apart(p[i], p[j]) - _apart(p[i], none[j]) - _apart(none[i], p[j]) + _apart(none[i], none[j])
            if len(i):
                found.append(_sums(local[i], local[j], value, groups))
            at = end
        return _pairs(found)

    part = F.pmod(F.xxhash64("at"), F.col("parts")).cast("int").alias("part")
    cells = _dealt(entries.select("lang", part, "at", "gid", "block", "blocks", "p", "none"))
    return cells.groupBy("lang", "part", "low", "high").applyInArrow(common, PAIRS)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def source_divergence(
    docs: DataFrame, audit: Audit = Audit(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows against each other source, and the leading ``term`` rows."""
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    every, counts = group_counts(docs, audit, text_col, lang_col, source_col)
    groups = source_groups(every, counts)
    entries = counts.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))

    both = base_values(groups, entries).unionByName(common_values(entries))
    valued = both.groupBy("gid", "other").agg(F.sum("value").alias("value"))
    items = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    names = groups.select("gid", "lang", "source")
    pairs = _ranked(valued.join(items, "other").join(names, "gid"), "pair")

    above = entries.withColumn("q", share("every", "whole", "kept")).where("p > q")
    told = above.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    leading = _ranked(told, "term").where(F.col("rank") <= audit.top)
    return pairs.unionByName(leading)
