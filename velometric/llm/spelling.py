"""Spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts.

A word's letter counts are a vector, and one inserted or deleted letter changes it by a squared distance of 1, one replaced
letter by 2. The squared distances of a block of words are the lengths' squares less twice a NumPy product of the count
matrices; pairs at most 2 apart, of equal or adjacent length, are verified letter by letter.

Comparing all words of two adjacent lengths would grow with the square of the vocabulary. One edit leaves the first or the
last h letters alone, h being half of the shorter length; so a block holds the words of two adjacent lengths that agree on a
first or on a last half, hashed to about BLOCK words, and nothing is lost. A pair agreeing on both counts in the block of the
first half alone, so every pair is found once. A block that outgrows TILE (an ending that very many words have) is dealt to
tiles, and every pair of its tiles is a unit of its own.

Words are counted per batch in Python, then by Spark with map-side combination. A word's near pairs are never gathered: the
number of them and the largest are aggregates. Forms lead to words at least FACTOR times as frequent, so following them ends,
by pointer jumping, after at most log2(log5 of the largest count) rounds, five for any 64-bit count.

Defined results: a null text has no words; a null id is empty text in the hashed string; ties between near words go to the
smallest in code-point order; equal rows count each; very long words are blocked like any other, in smaller blocks; an empty
table gives an empty one; other columns of any name are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velometric.llm.common import decoded_texts, packed, slices, text_bytes, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
#: One in so many runs loses a letter.
EVERY = 199
#: Words of a block on average, words of a tile at most on average, and cells of a matrix handled at once.
BLOCK = 256
TILE = 2048
CELLS = 1 << 21
#: Words a task holds before it passes their counts on.
HELD = 200_000


# Words


def altered(prefix: str, run: str, every: int = EVERY) -> str:
    """`run`, less one letter where the checksum of document and run says so."""
    h = zlib.crc32((prefix + run).encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) batches to (word, n), words counted over as many texts as fit."""
    held: Counter[str] = Counter()

    def passed_on() -> pa.RecordBatch:
        out = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["word", "n"])

    for batch in batches:
        ids, at = batch.column(0).to_pylist(), 0
        for part in slices(batch.column(1)):
            for id_text, text in zip(ids[at:], decoded_texts(part), strict=False):
                prefix = f"{'' if id_text is None else id_text}:"
                # UTF-8 bytes know ASCII capitals only; so does the upper half of the pattern's range not change.
                low = text.lower() if text.isascii() else text.encode().lower().decode()
                for run, n in Counter(RUN.findall(low)).items():
                    if len(run) >= LEAST_LENGTH:
                        word = altered(prefix, run)
                        if len(word) >= LEAST_LENGTH:
                            held[word] += n
                if len(held) >= HELD:
                    yield passed_on()
            at += len(part)
    yield passed_on()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of LEAST_LENGTH letters or more that occur at least `least` times in all."""
    rows = packed(docs.select(id_col, text_col)).select(
        F.col(f"row.`{id_col}`").cast("string").alias("id"), text_bytes(text_col).alias("text")
    )
    counts = rows.mapInArrow(word_counts, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# Near pairs


def blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each word in its blocks (length, part, bucket): with its own length as `short`, with the length below as longer word."""
    sized = words.select("word", F.length("word").alias("size"))
    counts = sized.groupBy("size").agg(F.count("*").alias("many"))
    # One row per word length; the join is left to measured sizes.
    sized = sized.join(counts, "size")
    roles = F.explode(F.array(F.struct(F.col("size").alias("length")), F.struct((F.col("size") - 1).alias("length"))))
    rows = sized.select("word", "size", "many", roles.alias("role")).select("word", "size", "many", "role.length")
    half = F.floor(F.col("length") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.substring(F.col("word"), F.lit(1), half).alias("piece")),
        F.struct(F.lit(1).alias("part"), F.substring(F.col("word"), -half, half).alias("piece")),
    )
    rows = rows.where(F.col("length") >= LEAST_LENGTH).select("word", "size", "length", F.explode(parts).alias("of"))
    # The number of buckets depends on the shorter length alone, as both lengths must agree on it.
    short = counts.select(F.col("size").alias("length"), F.ceil(F.col("many") / block).alias("buckets"))
    rows = rows.select("word", "length", (F.col("size") == F.col("length")).alias("short"), "of.part", "of.piece")
    rows = rows.join(short, "length")
    return rows.select(
        "length", "part", F.pmod(F.xxhash64("piece"), F.col("buckets")).alias("bucket"), "word", "short"
    )


def units(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows of `blocks` dealt to units (length, part, bucket, a, b); a block of up to `tile` words is the unit (0, 0).

    In a larger one each word has a tile by its hash and goes to a unit with every tile; `tile` says which it is from.
    """
    by = ["length", "part", "bucket"]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("many")).where(F.col("many") > tile)
    sizes = sizes.select(*by, F.ceil(F.col("many") / tile).cast("int").alias("tiles"))
    joined = rows.join(sizes, by, "left")
    own = F.coalesce(F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"), F.lit(0))
    joined = joined.select("*", own.alias("tile"))
    dealt = joined.select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0)))).alias("other"))
    return dealt.select(
        *by, F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "word", "short", "tile"
    )


def letter_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, one row each, and their letters' places in a common alphabet."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return points, np.where(points < 128, points - 97, points - 192 + 26).astype(np.int64)


def letter_counts(places: np.ndarray) -> np.ndarray:
    """A row of 90 letter counts for each word. Single precision is exact where squared lengths stay below 2^24."""
    count, length = places.shape
    flat = (np.arange(count)[:, None] * 90 + places).ravel()
    kind = np.float32 if length < 4000 else np.float64
    return np.bincount(flat, minlength=count * 90).reshape(count, 90).astype(kind)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of `long` are those of `short` with one more letter: what agrees from both ends covers the shorter."""
    first = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    last = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return first + last >= short.shape[1]


def near_in_unit(words: np.ndarray, short: np.ndarray, tile: np.ndarray, part: int, two: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the unit's near words, each pair once; with `two`, those across its two tiles."""
    low, high = np.flatnonzero(short), np.flatnonzero(~short)
    if not len(low):
        return
    sides = {True: letter_matrix(words[low].tolist())}
    if len(high):
        sides[False] = letter_matrix(words[high].tolist())
    length = sides[True][0].shape[1]
    half = length // 2
    left = letter_counts(sides[True][1])
    left_square = np.einsum("ij,ij->i", left, left)
    for same, others in ((True, low), (False, high)):
        if not len(others):
            continue
        points = sides[same][0]
        right = left if same else letter_counts(sides[same][1])
        right_square = left_square if same else np.einsum("ij,ij->i", right, right)
        step = max(1, CELLS // len(others))
        for begin in range(0, len(low), step):
            end = min(begin + step, len(low))
            apart = left_square[begin:end, None] + right_square[None, :] - 2 * (left[begin:end] @ right.T)
            i, j = np.nonzero(apart == (2 if same else 1))
            i += begin
            if same:
                i, j = i[i < j], j[i < j]
            if two:
                across = tile[low[i]] != tile[others[j]]
                i, j = i[across], j[across]
            # Letters are compared for as many pairs at once as the cell limit allows.
            pairs = max(1, CELLS // (length + 1))
            for at in range(0, len(i), pairs):
                p, q = i[at : at + pairs], j[at : at + pairs]
                a, b = sides[True][0][p], points[q]
                near = one_replaced(a, b) if same else one_inserted(a, b)
                begins = (a[:, :half] == b[:, :half]).all(axis=1)
                # The block of the last half leaves out what the block of the first half has found.
                near &= begins if part == 0 else ~begins & (a[:, length - half :] == b[:, b.shape[1] - half :]).all(axis=1)
                yield low[p[near]], others[q[near]]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit to near pairs (v, w); what is held is one unit of at most about two tiles."""
    held: list[pa.RecordBatch] = []
    unit = None

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        words = rows.column("word").to_numpy()
        short, tile = rows.column("short").to_numpy(), rows.column("tile").to_numpy()
        for v, w in near_in_unit(words, short, tile, unit[1], unit[3] != unit[4]):
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(words[v], pa.string()), pa.array(words[w], pa.string())], names=["v", "w"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "part", "bucket", "a", "b")]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for column in ids:
            changed[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for begin, end in zip(starts, starts[1:], strict=False):
            now = tuple(int(c[begin]) for c in ids)
            if unit is not None and now != unit:
                yield from done()
                held.clear()
            unit = now
            held.append(batch.slice(begin, end - begin))
    if held:
        yield from done()


def near_pairs(words: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(v, w): every unordered pair of distinct words one edit apart, once."""
    by = ["length", "part", "bucket", "a", "b"]
    dealt = units(blocks(words, block), tile)
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "v string, w string")


# Forms


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word; the form is the most frequent near word if `factor` times as frequent."""
    both = pairs.unionAll(pairs.select(F.col("w").alias("v"), F.col("v").alias("w")))
    counted = both.join(words.select(F.col("word").alias("w"), "n"), "w")
    # Least of (-n, word): the largest count, then the smallest word; combined on the map side, so a hub is no hot key.
    best = counted.groupBy(F.col("v").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("w").alias("near"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    large = -F.col("best.less") >= factor * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) for words that have a form, by pointer jumping; each round is a written table."""
    table = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = table.join(up, "root", "left")
        if joined.where("next IS NOT NULL").isEmpty():
            return table
        table = written(joined.select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT, block: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """One row per word: `word`, `n`, `n_near`, `form`, `form_n` and `root`, the end of the chain of forms."""
    words = written(vocabulary(docs, id_col, text_col, least), "spelling-words")
    pairs = written(near_pairs(words, block, tile), "spelling-pairs")
    found = written(forms(words, pairs), "spelling-forms")
    ends = roots(found)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
