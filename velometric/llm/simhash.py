"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint from the XXH64 of its word shingles. Fingerprints, not texts, are compared: equal ones
are first made one by aggregation. The distinct ones are compared exactly in tiles, with numpy exclusive-or and bit counts.
Within a tile they are sorted by population count, and tiles whose population counts differ by more than the radius are
never paired, since the count of differing bits is at least that difference.

All pairs of tiles over a whole corpus would grow with its square. So tiles are laid within buckets: cut 64 bits into m
blocks; two fingerprints at most r bits apart agree in m - r of them at least, so it is enough to compare those that agree
on some m - r blocks. Nothing is lost, for any m > r; `block_plan` raises m with the number of fingerprints. A bucket of
over TILE fingerprints is laid out along its population counts and cut into tiles; each pair of tiles within the radius is a
unit of its own, so that a hot bucket becomes many tasks of bounded size.

A unit returns a spanning forest of its links, never all pairs. Classes come from contracting the links: each node joins the
least-hashed of itself and its neighbours, links are renamed, until none is left; links shrink by a constant share each
round. Every round is a written table in the shared scratch folder.

Defined results: a null text has no words; a text without words has fingerprint zero and links like any other; a class is
named after its smallest non-null id; equal rows are in one class and all returned; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velometric.llm.common import packed, slices, text_bytes, written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a tile, and shingles or comparisons handled at once.
TILE = 4096
CHUNK = 1 << 16
#: Mean number of comparisons per fingerprint above which one more block must agree.
MOST_COMPARED = 8192
#: The same where only partners are looked for: a comparison costs less than moving a fingerprint to one more bucket.
PARTNERS_COMPARED = 1 << 17
MOST_MASKS = 64
#: Nearest partners that are taken of each fingerprint.
NEAREST = 4
#: An odd factor whose product with a fingerprint draws its place.
MIX = np.uint64(0x9E3779B97F4A7C15)


# Fingerprints


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 when over half of the shingles' hashes have it. `bytes.lower` and `split` know ASCII only."""
    words = data.lower().split()
    if not words:
        return 0
    text = memoryview(b" ".join(words))
    starts = list(itertools.accumulate([len(w) + 1 for w in words], initial=0))
    count = max(1, len(words) - shingle + 1)
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, count, CHUNK):
        end = min(begin + CHUNK, count)
        hashes = np.array(
            [digest(text[a : b - 1], SEED) for a, b in zip(starts[begin:end], starts[begin + span : end + span], strict=True)],
            dtype="<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as signed 64-bit hashes in ascending order; those of `fingerprint`."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    text = memoryview(b" ".join(words))
    starts = list(itertools.accumulate([len(w) + 1 for w in words], initial=0))
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = (digest(text[a : b - 1], SEED) for a, b in zip(starts, starts[span:], strict=False))
    return np.unique(np.fromiter(hashes, dtype=np.uint64).view(np.int64))


def fingerprint_function(shingle: int = SHINGLE):
    """Arrow function: texts (binary) to fingerprints, as signed 64-bit integers of the same bits."""

    @F.arrow_udf("bigint")
    def fingerprints(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            values = np.array([fingerprint(x.as_buffer().to_pybytes(), shingle) for x in array], dtype=np.uint64)
            yield pa.array(values.view(np.int64))

    return fingerprints


# Links


def block_plan(count: int, radius: int, most: int = MOST_COMPARED) -> list[int]:
    """Bit masks, one for each choice of blocks that must agree; any pair within the radius agrees on one of them."""
    for agree in range(1, 8):
        m = radius + agree
        edges = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
        masks = [sum(c) for c in itertools.combinations(blocks, agree)]
        if len(masks) * count / 2 ** (64 * agree // m) <= most:
            break
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def bucketed(prints: DataFrame, masks: list[int], carried: Sequence[str] = ()) -> DataFrame:
    """(mask, masked) buckets of distinct fingerprints, with their population count and the columns `carried`."""
    values = F.array(*[F.lit(m).cast("long") for m in masks])
    rows = prints.select("fp", *carried, F.bit_count("fp").alias("ones"), F.posexplode(values).alias("mask", "bits"))
    return rows.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp", "ones", *carried)


def tile_table(buckets: DataFrame, tile: int) -> DataFrame:
    """Buckets of over `tile` fingerprints: (mask, key, ones) with `before`, `n` and the bucket's `layout`.

    Counts are combined on the map side; a bucket has at most 65 population counts, so its layout is a short array.
    """
    counts = buckets.groupBy("mask", "key", "ones").agg(F.count("*").alias("n"))
    each = counts.groupBy("mask", "key").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("ones", "n"))).alias("entries")
    )
    large = each.where(F.col("total") > tile)
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<ones:int,before:bigint,n:bigint>>").alias("out")
    )

    def step(state: Column, e: Column) -> Column:
        row = F.struct(e["ones"].cast("int").alias("ones"), state["at"].alias("before"), e["n"].alias("n"))
        return F.struct((state["at"] + e["n"]).alias("at"), F.concat(state["out"], F.array(row)).alias("out"))

    return large.select("mask", "key", "total", F.aggregate("entries", start, step, lambda s: s["out"]).alias("layout"))


def units(buckets: DataFrame, tiles: DataFrame, tile: int, radius: int, carried: Sequence[str] = ()) -> DataFrame:
    """Rows dealt to units (mask, key, a, b) with `side`. A small bucket is the unit (0, 0).

    In a large one a fingerprint's place along the population counts gives its tile; the tile goes to a unit with every
    tile, itself included, that has a population count within the radius of one of its own.
    """
    joined = buckets.join(tiles, ["mask", "key"], "left")
    of = lambda n: F.element_at(F.filter("layout", lambda e: e["ones"] == n), 1)
    place = of(F.col("ones"))["before"] + F.pmod(F.xxhash64("fp"), of(F.col("ones"))["n"])
    joined = joined.select("*", F.floor(place / tile).cast("int").alias("tile"))
    # Population counts that have a row in this tile, and from them the places that its partners may have.
    low, high = F.col("tile").cast("long") * tile, (F.col("tile").cast("long") + 1) * tile
    inside = F.filter("layout", lambda e: (e["before"] < high) & (e["before"] + e["n"] > low))
    joined = joined.select(
        "mask", "key", "fp", "ones", *carried, "tile", "layout",
        (F.array_min(F.transform(inside, lambda e: e["ones"])) - radius).alias("least"),
        (F.array_max(F.transform(inside, lambda e: e["ones"])) + radius).alias("most"),
    )
    near = F.filter("layout", lambda e: (e["ones"] >= F.col("least")) & (e["ones"] <= F.col("most")))
    first = F.floor(F.array_min(F.transform(near, lambda e: e["before"])) / tile).cast("int")
    last = F.floor((F.array_max(F.transform(near, lambda e: e["before"] + e["n"])) - 1) / tile).cast("int")
    others = F.when(F.col("tile").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last))
    tiled = F.coalesce("tile", F.lit(0)).alias("tile")
    dealt = joined.select("mask", "key", "fp", "ones", *carried, tiled, F.explode(others).alias("other"))
    return dealt.select(
        "mask", "key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "fp", "ones",
        (F.col("tile") > F.col("other")).alias("side"), *carried,
    )


def forest(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    """Spanning links (node, least node of its class) of pairs of indices below `count`: hooking and pointer jumping."""
    label = np.arange(count)
    while len(left):
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(up := label[label], label):
            label = up
        left, right = label[left], label[right]
        apart = left != right
        left, right = left[apart], right[apart]
    nodes = np.flatnonzero(label != np.arange(count))
    return np.stack([nodes, label[nodes]], axis=1)


def links_of(fps: np.ndarray, ones: np.ndarray, side: np.ndarray, two: bool, radius: int) -> np.ndarray:
    """Spanning links among one unit's fingerprints; with `two`, of the pairs across its sides."""
    order = np.argsort(ones, kind="stable")
    fps, ones, side = fps[order].view(np.uint64), ones[order], side[order]
    rows = np.flatnonzero(~side) if two else np.arange(len(fps))
    others = np.flatnonzero(side) if two else rows
    other_fps, other_ones = fps[others], ones[others]
    found = [np.zeros((0, 2), np.int64)]
    step = max(1, CHUNK * 8 // max(1, len(others)))
    for begin in range(0, len(rows), step):
        block = rows[begin : begin + step]
        # Of the sorted population counts, only a stretch lies within the radius of this block's.
        low = np.searchsorted(other_ones, ones[block[0]] - radius, "left") if two else begin
        high = np.searchsorted(other_ones, ones[block[-1]] + radius, "right")
        apart = np.bitwise_count(fps[block][:, None] ^ other_fps[None, low:high])
        i, j = np.nonzero(apart <= radius)
        a, b = block[i], others[low + j]
        keep = a != b
        if keep.any():
            found.append(forest(a[keep], b[keep], len(fps)))
    pairs = np.concatenate(found)
    return fps.view(np.int64)[forest(pairs[:, 0], pairs[:, 1], len(fps))]


def partners_of(fps: np.ndarray, n: np.ndarray, side: np.ndarray, two: bool, radius: int, share: float) -> np.ndarray:
    """Rows (v, w, bits apart, place of w): for each fingerprint of a unit its NEAREST within the radius and the first.

    Partners have an `n` of at least `share` of the other's. First is the least `place`, an order drawn from the bits, so that
    a family of copies meets at few fingerprints; ties of the nearest go to it, too. With `two`, partners are on the other side.
    """
    place = (fps.view(np.uint64) * MIX).view(np.int64)
    order = np.argsort(place, kind="stable")
    fps, n, place, side = fps[order].view(np.uint64), n[order], place[order], side[order]
    sides = [(np.flatnonzero(~side), np.flatnonzero(side))] if two else [(np.arange(len(fps)),) * 2]
    sides += [(b, a) for a, b in sides if two]
    found = [np.zeros((0, 4), np.int64)]
    for rows, others in sides:
        step = max(1, CHUNK * 2 // max(1, len(others)))
        for begin in range(0, len(rows) if len(others) else 0, step):
            block = rows[begin : begin + step]
            apart = np.bitwise_count(fps[block][:, None] ^ fps[others][None, :])
            if not two:
                apart[np.arange(len(block)), block] = 65
            i, j = np.nonzero(apart <= radius)
            a, b = n[block[i]], n[others[j]]
            unlike = np.minimum(a, b) < share * np.maximum(a, b) - 1e-9
            apart[i[unlike], j[unlike]] = 65
            every = np.arange(len(block))
            for turn in range(NEAREST + 1):
                j = apart.argmin(axis=1) if turn else (apart <= radius).argmax(axis=1)
                i = np.flatnonzero(apart[every, j] <= radius)
                if not len(i):
                    break
                at = others[j[i]]
                columns = (fps[block[i]].view(np.int64), fps[at].view(np.int64), apart[i, j[i]].astype(np.int64), place[at])
                found.append(np.stack(columns, axis=1))
                if turn:
                    apart[i, j[i]] = 65
    return np.concatenate(found)


def unit_function(take: Callable[..., np.ndarray], columns: list[str], names: list[str]):
    """Reads rows sorted by unit and hands each unit's `columns` and whether it has two sides to `take`, which gives rows `names`.

    What is held is one unit of at most about two tiles.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        unit = None

        def done() -> list[np.ndarray]:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            return [take(*whole, unit[2] != unit[3])] if len(whole[0]) > 1 else []

        def packed_rows(found: list[np.ndarray]) -> pa.RecordBatch:
            table = np.concatenate(found) if found else np.zeros((0, len(names)), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(len(names))], names=names)

        for batch in batches:
            ids = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "key", "a", "b")]
            data = [batch.column(n).to_numpy(zero_copy_only=False) for n in columns]
            if not len(ids[0]):
                continue
            changed = np.zeros(len(ids[0]), dtype=bool)
            for column in ids:
                changed[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(changed).tolist(), len(ids[0])]
            found: list[np.ndarray] = []
            for begin, end in itertools.pairwise(starts):
                now = tuple(int(c[begin]) for c in ids)
                if unit is not None and now != unit:
                    found += done()
                    held.clear()
                unit = now
                held.append([d[begin:end] for d in data])
            yield packed_rows(found)
        if held:
            yield packed_rows(done())

    return compare


def compare_function(radius: int):
    """Each unit's spanning links."""
    return unit_function(lambda *unit: links_of(*unit, radius), ["fp", "ones", "side"], ["v", "w"])


def in_units(prints: DataFrame, masks: list[int], radius: int, tile: int, carried: Sequence[str] = ()) -> DataFrame:
    """The distinct fingerprints `fp` dealt to units and sorted by them."""
    buckets = bucketed(prints, masks, carried)
    tiles = written(tile_table(buckets, tile), "simhash-tiles")
    by = ["mask", "key", "a", "b"]
    return units(buckets, tiles, tile, radius, carried).repartition(*by).sortWithinPartitions(*by)


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(v, w): links among the distinct fingerprints `fp` that span every class within `radius` bits."""
    ordered = in_units(prints, block_plan(prints.count(), radius), radius, tile)
    return ordered.mapInArrow(compare_function(radius), "v bigint, w bigint").distinct()


def partners(prints: DataFrame, sure: int, radius: int, share: float, tile: int = TILE) -> DataFrame:
    """(v, w): each of the distinct fingerprints `fp` with its NEAREST and its first partner within `radius` bits.

    Partners agree on the blocks of some mask, and the `n` of one is at least `share` of the other's. Within `sure` bits all
    agree so, and most of those a little further apart; with fewer fingerprints the masks make up to `radius` sure.
    """
    count = prints.count()
    plans = [block_plan(count, r, PARTNERS_COMPARED) for r in range(radius, sure - 1, -1)]
    masks = next((plan for plan in plans if len(plan) <= MOST_MASKS), plans[-1])
    take = unit_function(lambda *unit: partners_of(*unit, radius, share), ["fp", "n", "side"], ["v", "w", "apart", "place"])
    ordered = in_units(prints, masks, radius, tile, ["n"])
    found = ordered.mapInArrow(take, "v bigint, w bigint, apart bigint, place bigint")
    # At most NEAREST + 1 rows a mask.
    best = found.groupBy("v").agg(
        F.slice(F.array_sort(F.collect_set(F.struct("apart", "place", "w"))), 1, NEAREST).alias("nearest"),
        F.min(F.struct("place", "w")).alias("first"),
    )
    return best.select("v", F.explode(F.array_union(F.array("first.w"), F.col("nearest.w"))).alias("w"))


# Classes


def contracted(edges: DataFrame) -> list[DataFrame]:
    """Tables (v, r), one a round: each node and the one that stands for it in the next round's graph."""
    rounds: list[DataFrame] = []
    edges = written(edges.where("v <> w"), "simhash-links")
    while not edges.isEmpty():
        seed = len(rounds)
        both = edges.select("v", "w").unionAll(edges.select(F.col("w").alias("v"), F.col("v").alias("w")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        # A minimum combines on the map side, so a node with very many links is no hot key here.
        best = both.groupBy("v").agg(F.least(F.min(rank("w")), F.first(rank("v"))).alias("best"))
        chosen = written(best.select("v", F.col("best.node").alias("r")), "simhash-round")
        rounds.append(chosen)
        # Both sides are plain scans below their exchanges: adaptive execution can split a hot node.
        named = edges.join(chosen.withColumnRenamed("r", "a"), "v").select("a", "w")
        named = named.join(chosen.select(F.col("v").alias("w"), F.col("r").alias("b")), "w").where("a <> b")
        edges = written(
            named.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("w")).distinct(), "simhash-links"
        )
    return rounds


def roots(edges: DataFrame) -> DataFrame:
    """(fp, root) for every node of `edges`."""
    rounds = contracted(edges)
    if not rounds:
        return edges.select(F.col("v").alias("fp"), F.col("w").alias("root")).where(F.lit(False))
    table = rounds[-1].select("v", F.col("r").alias("root"))
    for chosen in reversed(rounds[:-1]):
        up = table.select(F.col("v").alias("r"), "root")
        joined = chosen.join(up, "r", "left").select("v", F.coalesce("root", "r").alias("root"))
        table = written(joined, "simhash-roots")
    return table.select(F.col("v").alias("fp"), "root")


def classes(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, component, root): for distinct fingerprints with their least `id`, the least id of the class.

    Ids may be null or repeat over classes, so a class is known by its `root`, one of its fingerprints.
    """
    root = written(roots(links(prints.select("fp"), radius, tile)), "simhash-classes")
    named = prints.join(root, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    least = written(named.groupBy("root").agg(F.min("id").alias("component")), "simhash-least")
    return named.join(least, "root").select("fp", "component", "root")


def marked(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """`row`, its key and its fingerprint."""
    fp = fingerprint_function(shingle)(text_bytes(text_col)).alias("fp")
    return packed(docs, keep_key=True).select("row", "key", F.col(f"row.`{id_col}`").alias("id"), fp)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: `id`, its row `key`, `fp`, `component`, the least id of its class, and the class's `root`.

    Texts are read once; ids and fingerprints are written, then classes joined to them. Both sides of that join are
    scans, so a fingerprint that a third of all rows share is split.
    """
    rows = written(marked(docs, id_col, text_col, shingle).select("id", "key", "fp"), "simhash-prints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    found = written(classes(prints, radius, tile), "simhash-components")
    return rows.join(found, "fp").select("id", "key", "fp", "component", "root")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """The rows of `docs` less all but one of each class: the one with the least id, nulls last, ties by row key.

    Of rows equal in everything one stays. Rows travel once, to meet the keys of those that stay.
    """
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, shingle, radius, tile))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` that come first in their class; `found` has the `id`, `key` and class `root` of every row."""
    order = F.struct(F.col("id").isNull().alias("null_id"), F.col("id").alias("id"), F.col("key").alias("key"))
    stay = found.groupBy("root").agg(F.min(order).alias("best"))
    keys = written(stay.select(F.col("best.key.low").alias("low"), F.col("best.key.high").alias("high")), "simhash-kept")
    rows = packed(docs, keep_key=True).select("row", F.col("key.low").alias("low"), F.col("key.high").alias("high"))
    once = Window.partitionBy("low", "high").orderBy(F.lit(1))
    kept = rows.join(keys, ["low", "high"], "left_semi").select("row", F.row_number().over(once).alias("n"))
    return kept.where("n = 1").select("row.*")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `near_duplicates`."""
    bits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select(F.col("id").alias("doc_id"), bits.alias("fingerprint"), F.col("component").alias("component_id"))
