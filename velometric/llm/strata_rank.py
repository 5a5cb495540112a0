"""Ranked lexical search over a length-stratified index.

A document's normaliser m is a whole number made of its length, so documents fall into strata of equal m, and within one a
term's contribution depends on its frequency tf alone: it is computed once for every (stratum, term, tf). The index is laid
out by range of m, hot strata split by a hash; a task reads its range in m order and holds INDEX postings at a time, sorted by
term, stratum and tf. The last tf of a (term, stratum) gives its largest impact, and an item's sum of these bounds every
score in the stratum. Strata are visited in falling order of that bound, in steps that double, until a bound is below the
item's 50th best score in the task; only equal or higher bounds can still change the ranking. Tasks return their best rows of
each item, and a window over those ranks them.

Documents are read once per block of items: of each only its length and its frequencies of the block's terms are written, so
the driver and the tasks hold BLOCK_TERMS (item, term) pairs at most, on average, however many items there are.

Defined results: a null text has no terms and is never found; an item without a term that a document holds has no rows; rows
with equal item ids are one item with the terms of all, null being an id like any other; equal scores rank by document id,
null last; repeated document rows are documents of their own; very long texts count whole; an empty table on either side
gives an empty one; other columns of any name are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from velometric.llm.common import packed, slices, text_bytes, written

TOP = 50
#: (item, term) pairs of a block of items, on average, and postings that a task indexes at once.
BLOCK_TERMS = 200_000
INDEX = 1 << 22
#: Strata of an item's first step.
FIRST = 4

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: capitals to small letters, what is no part of a term to a space. Bytes over 127 stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(TABLE).split()


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of every item."""
    text = F.translate(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), CAPITALS, CAPITALS.lower())
    found = F.explode(F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)))
    return packed(items.select(item_col, text_col)).select(F.col(f"row.`{item_col}`").alias("item"), found.alias("term")).distinct()


def frequencies(vocabulary: dict[bytes, int]):
    """(id, text) batches to (id, n, terms, tfs): a document's length and its frequencies of the given terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = vocabulary.get
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                sizes, lengths, terms, tfs = [], [], [], []
                for text in part:
                    words = terms_of(text.as_buffer().to_pybytes())
                    known = [(place(t), n) for t, n in Counter(words).items() if t in vocabulary]
                    sizes.append(len(words))
                    lengths.append(len(known))
                    terms += [t for t, _ in known]
                    tfs += [n for _, n in known]
                offsets = pa.array(np.cumsum([0, *lengths]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                    ],
                    names=["id", "n", "terms", "tfs"],
                )
                at += len(part)

    return count


def normaliser(n: Column, documents: int, length: int) -> Column:
    """100 - 50 + (50 n N) div L; the product is taken in decimals, so it cannot overflow."""
    product = F.lit(50).cast("decimal(3,0)") * n.cast("decimal(15,0)") * F.lit(documents).cast("decimal(18,0)")
    return F.floor(F.lit(50) + F.call_function("div", product, F.lit(max(1, length)).cast("decimal(20,0)"))).cast("long")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Stratified:
    """An index of documents that come in ascending order of m."""

    def __init__(self, m: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        values, stratum = np.unique(m, return_inverse=True)
        self.strata = len(values)
        doc = np.repeat(np.arange(len(m)), counts)
        cell = terms.astype(np.int64) * self.strata + stratum[doc]
        order = np.lexsort((tfs, cell))
        self.doc, cell, tf = doc[order], cell[order], tfs[order].astype(np.int64)
        # Postings of one (term, stratum, tf) lie together and share an impact.
        first = np.ones(len(cell), dtype=bool)
        first[1:] = (cell[1:] != cell[:-1]) | (tf[1:] != tf[:-1])
        group = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        once = impact(tf[heads], values[cell[heads] % self.strata])
        self.impact = once[group]
        begins = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.cells = cell[begins]
        self.begin, self.end = begins, np.r_[begins[1:], len(cell)] if len(cell) else begins
        self.most = self.impact[self.end - 1]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An item's bound in every stratum, and its cells: place, stratum and weight."""
        low = np.searchsorted(self.cells, terms * self.strata)
        high = np.searchsorted(self.cells, (terms + 1) * self.strata)
        place, weight = ranges(low, high), np.repeat(weights, high - low)
        stratum = self.cells[place] % self.strata
        # Sums of whole numbers below 2^53, which doubles hold exactly.
        bound = np.bincount(stratum, weights=weight * self.most[place], minlength=self.strata).astype(np.int64)
        return bound, place, stratum, weight

    def scores(self, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of what the given cells hold."""
        at = ranges(self.begin[place], self.end[place])
        part = np.repeat(weight, self.end[place] - self.begin[place]) * self.impact[at]
        docs, back = np.unique(self.doc[at], return_inverse=True)
        return docs, np.bincount(back, weights=part, minlength=len(docs)).astype(np.int64)


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [low, high), one range after the other."""
    size = high - low
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())


class Best:
    """The best rows of one item so far: (score, id, whether the id is null), best first."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a score must reach to enter; 1 while there is room."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def offer(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        enough = score >= self.least()
        score = np.concatenate([self.score, score[enough]])
        ids, null = np.concatenate([self.id, ids[enough]]), np.concatenate([self.null, null[enough]])
        if len(score) > self.top:
            tall = score >= np.partition(score, len(score) - self.top)[len(score) - self.top]
            score, ids, null = score[tall], ids[tall], null[tall]
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def visit(index: Stratified, ids: np.ndarray, null: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Offers an item's documents in falling order of stratum bounds; returns the number of strata visited."""
    bound, place, stratum, weight = index.bounds(terms, weights)
    order = np.argsort(-bound, kind="stable")
    turn = np.empty(index.strata, dtype=np.int64)
    turn[order] = np.arange(index.strata)
    by_turn = np.argsort(turn[stratum], kind="stable")
    place, weight, turns = place[by_turn], weight[by_turn], turn[stratum][by_turn]
    at, step = 0, FIRST
    while at < index.strata and bound[order[at]] >= best.least():
        # Of this step's strata, those whose bound can still matter.
        end = min(at + step, index.strata)
        end = at + int(np.searchsorted(-bound[order[at:end]], -best.least(), "right"))
        low, high = np.searchsorted(turns, [at, end])
        docs, score = index.scores(place[low:high], weight[low:high])
        best.offer(score, ids[docs], null[docs])
        at, step = end, step * 2
    return at


def search_function(items: list[tuple[np.ndarray, np.ndarray]], top: int, most: int = INDEX):
    """Rows (id, m, terms, tfs) sorted by m to the task's best rows (at, id, score) of every item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        held: list[pa.RecordBatch] = []
        postings = 0

        def indexed() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            null = np.asarray(rows.column("id").is_null())
            ids = np.asarray(rows.column("id").fill_null(0))
            lists = [rows.column(c).chunk(0) for c in ("terms", "tfs")]
            counts = np.diff(np.asarray(lists[0].offsets))
            index = Stratified(np.asarray(rows.column("m")), counts, *(np.asarray(x.flatten()) for x in lists))
            for (terms, weights), found in zip(items, best, strict=True):
                visit(index, ids, null, terms, weights, found)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                postings += len(batch.column("terms").flatten())
            if postings >= most:
                indexed()
                held.clear()
                postings = 0
        if held:
            indexed()
        at = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        ids, null, score = (np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for b in best)]) for c in ("id", "null", "score"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())],
            names=["at", "id", "score"],
        )

    return search


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search_block(docs: DataFrame, pairs: list[tuple[object, str]], item_field: StructField, top: int) -> DataFrame:
    """(item, id, score): the best rows that tasks found for the items of one block, given as (item, term) pairs."""
    spark = docs.sparkSession
    names = list(dict.fromkeys(item for item, _ in pairs))
    vocabulary = {t.encode(): i for i, t in enumerate(dict.fromkeys(term for _, term in pairs))}
    counted = docs.mapInArrow(frequencies(vocabulary), "id bigint, n bigint, terms array<int>, tfs array<int>")
    counted = written(counted, "strata-terms")
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    # One row per term of the block, counted on the map side.
    holding = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect())
    place = {item: i for i, item in enumerate(names)}
    entries: list[list[tuple[int, int]]] = [[] for _ in names]
    for item, term in pairs:
        i = vocabulary[term.encode()]
        if i in holding and (w := weight(totals["documents"], holding[i])):
            entries[place[item]].append((i, w))
    arrays = [(np.array([t for t, _ in sorted(e)], np.int64), np.array([w for _, w in sorted(e)], np.int64)) for e in entries]
    strata = counted.where(F.size("terms") > 0)
    strata = strata.select("id", normaliser(F.col("n"), totals["documents"], totals["length"]).alias("m"), "terms", "tfs")
    # Ranges of m; the hash splits a stratum that holds very many documents.
    laid = strata.repartitionByRange("m", F.xxhash64("id", "terms")).sortWithinPartitions("m")
    found = laid.mapInArrow(search_function(arrays, top), "at int, id bigint, score bigint")
    schema = StructType([StructField("at", IntegerType()), StructField("item", item_field.dataType)])
    named = spark.createDataFrame(list(enumerate(names)), schema)
    return written(found.join(named, "at").select("item", "id", "score"), "strata-found")


def search(
    docs: DataFrame,
    items: DataFrame,
    item_col: str = "item_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    item_text_col: str = "text",
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, id, score): each item's `top` documents of highest score above 0, equal scores by ascending id."""
    rows = packed(docs.select(id_col, text_col)).select(
        F.col(f"row.`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text")
    )
    asked = written(item_terms(items, item_col, item_text_col), "strata-items")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    field = asked.schema["item"]
    found = None
    for block in range(blocks):
        pairs = [(r["item"], r["term"]) for r in asked.where(F.col("block") == block).collect()]
        part = search_block(rows, pairs, field, top)
        found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.select("item", F.row_number().over(best).alias("rank"), "id", "score").where(F.col("rank") <= top)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `search`."""
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
