"""Near-duplicates of a Jaccard similarity: candidates by SimHash, confirmed on whole sets, then an exact check for the rest.

A document is the set of its word shingles, and equal sets are one node from the start. Every set has a SimHash fingerprint.
The fingerprints are searched in tiles within buckets of agreeing blocks (`simhash.partners`): each is paired with the nearest
and the first within NEAR bits, all pairs within SEARCH bits being met for certain and most of the others. Sets of equal
fingerprints meet at one of them. Pairs are confirmed on their sets and joined to classes; on sf0.1 that finds 47 of 48
joins. The rest is what fingerprints alone cannot tell, and an exact check follows for it.

Sets of similarity s or more share one of the first n - ceil(s n) + 1 hashes of
either in any one order of all hashes, their prefixes. The order is rarest first: frequencies come from a sketch, one counter
for each of WIDTH classes of hashes, added up over all documents. It only ever overstates, and no order loses a pair; it
keeps what very many texts share (passages, licences) out of the prefixes of texts that are otherwise different, so such a
passage makes no bucket.

Nodes that share a prefix hash form a bucket; most hashes have one node, and those are passed over as rows stream by. Of the
buckets that hold several classes each node is confirmed against one node (the bucket's least, in the order of the round) if the
maps below allow it, which joins families of copies at one comparison a node. Buckets that still hold several classes are
compared whole, of those with the same nodes one: their SimHash fingerprints in tiles, with exclusive-or and bit counts, sizes
and classes told apart. The radius lies over five standard deviations above what
similar sets of at least SURE shingles differ by; smaller sets are not held to it. Then maps of MAP bits, one for each hash, bound
what two sets can share: a bit that one has alone is a hash less. The bound is strict, so it loses nothing, and of the pairs
of a family of copies it leaves those next to the similarity. A family just below the similarity has very many such pairs, so no
row is made of a pair: a tile returns the groups of nodes that its pairs connect, a row a node. Groups that overlap are put
together where their sets are not too large for a task, sets travel once a group, and all pairs of a group that pass the same
bounds are confirmed where the sets are, of which spanning links are returned.

The pairs of the search and of the stars, a few a node, are confirmed one by one: members stream past their centre, of which one
set is held at a time, and a centre with very many members is dealt to several tasks.

Every step is a written table, removed when its successor is there.

Defined results: a null text has no words, and texts without words are one class; ids may be null or repeat, classes are
known by a root and rows by a key over all their columns; equal rows are in one class; a class is named by no tie; very long
texts count whole; an empty table gives an empty one; the caller's columns travel in one struct, so any name may be used.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velometric.llm.common import Scratch, packed, slices, text_bytes
from velometric.llm.simhash import SEED, TILE, first_of_each, forest, partners, roots, shingle_hashes

#: Counters of the frequency sketch, and how many travel in one row.
WIDTH = 1 << 20
STRIPE = 1 << 12
#: Rows of a bucket, or members of a centre, that one task should get at most, on average.
SHARE = 1 << 14
#: Bits within which the search by fingerprints meets all pairs, and within which it takes those it meets.
SEARCH = 8
NEAR = 14
#: Rounds in which a node is compared with one other of its buckets only.
STARS = 1
RADIUS = 24
SURE = 64
CELLS = 1 << 20
#: Bits of the map of a set that goes along into tiles.
MAP = 2048
#: Rows of small units that are compared in one go.
TOGETHER = 512
#: Hashes of the sets of a group that a task holds; a larger group is cut into tiles of that size.
VOLUME = 1 << 21


# Sets and prefixes


def voted(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set: the bits that over half of its hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        block = hashes[begin : begin + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def bit_map(hashes: np.ndarray) -> bytes:
    """MAP bits, of which each hash sets one. A bit that one set has and another lacks is a hash that they do not share."""
    bits = np.zeros(MAP, dtype=bool)
    bits[(hashes >> 40) & (MAP - 1)] = True
    return np.packbits(bits).tobytes()


def named(hashes: np.ndarray) -> int:
    """The node of a set, equal for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def set_function(shingle: int, width: int):
    """(id, low, high, text) batches to (id, low, high, node, n, fp, map), and at the end the task's sketch as stripes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width, dtype=np.int64)
        kind = None
        for batch in batches:
            kind, at = batch.column(0).type, 0
            for part in slices(batch.column(3)):
                nodes, sizes, prints, maps = [], [], [], []
                for x in part:
                    hashes = shingle_hashes(x.as_buffer().to_pybytes(), shingle)
                    np.add.at(sketch, hashes & (width - 1), 1)
                    nodes.append(named(hashes))
                    sizes.append(len(hashes))
                    prints.append(voted(hashes))
                    maps.append(bit_map(hashes))
                own = [batch.column(i).slice(at, len(part)) for i in range(3)]
                values = [pa.array(v, pa.int64()) for v in (nodes, sizes, prints)] + [pa.array(maps, pa.binary())]
                none = [pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(own + values + none, names=NAMES)
                at += len(part)
        if kind is not None:
            stripes = np.arange(width // STRIPE)
            for some in np.array_split(stripes, max(1, len(stripes) // 64)):
                none = [pa.nulls(len(some), kind), *[pa.nulls(len(some), pa.int64())] * 5, pa.nulls(len(some), pa.binary())]
                counts = pa.array([sketch[s * STRIPE : (s + 1) * STRIPE] for s in some], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), counts], names=NAMES)

    return sets


NAMES = ["id", "low", "high", "node", "n", "fp", "map", "stripe", "counts"]


def added_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each stripe that comes by; a task holds the stripes dealt to it, all WIDTH counters at most."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for stripe, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.asarray(counts.values)
            held[stripe] = held[stripe] + values if stripe in held else values
    rows = [pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(rows, names=["stripe", "counts"])


def frequency_sketch(rows: DataFrame, width: int) -> np.ndarray:
    """The counters over all documents: WIDTH numbers, whatever the input."""
    stripes = rows.where("stripe IS NOT NULL").select("stripe", "counts").repartition("stripe")
    sketch = np.zeros(width, dtype=np.int64)
    for row in stripes.mapInArrow(added_stripes, "stripe int, counts array<bigint>").toLocalIterator():
        sketch[row["stripe"] * STRIPE : (row["stripe"] + 1) * STRIPE] = row["counts"]
    return sketch


def prefix_of(hashes: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest hashes of a set, one of which any set as similar has in its own prefix. An empty set has the prefix 0."""
    if not len(hashes):
        return np.zeros(1, np.int64)
    # A hair is taken off, so that rounding never shortens a prefix.
    least = int(np.ceil(similarity * len(hashes) - 1e-9))
    counts = sketch[hashes & (len(sketch) - 1)]
    return hashes[np.lexsort((hashes, counts))[: len(hashes) - least + 1]]


def prefix_function(shingle: int, similarity: float, sketch: np.ndarray):
    """Texts (binary) to (node, prefix)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0)):
                sets = [shingle_hashes(x.as_buffer().to_pybytes(), shingle) for x in part]
                found = [prefix_of(hashes, sketch, similarity) for hashes in sets]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
                )
                yield pa.RecordBatch.from_arrays([pa.array([named(h) for h in sets], pa.int64()), lists], names=["node", "prefix"])

    return prefixes


# Search by fingerprints


def print_pairs(nodes: DataFrame, similarity: float, tile: int, scratch: Scratch) -> DataFrame:
    """(v, w): nodes whose fingerprints are partners, or equal, and whose sizes allow the similarity.

    `nodes` has (node, n, fp), each node once. Of the nodes of one fingerprint the least stands for it.
    """
    least = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("many"))
    prints = scratch.keep(least.select("fp", "least.node", "least.n", "many"), "prints")
    found = partners(prints.select("fp", "n"), SEARCH, NEAR, similarity, tile)
    ends = found.select(F.least("v", "w").alias("v_fp"), F.greatest("v", "w").alias("w_fp")).distinct()
    ends = ends.join(prints.select(F.col("fp").alias("v_fp"), F.col("node").alias("v"), F.col("n").alias("n_v")), "v_fp")
    ends = ends.join(prints.select(F.col("fp").alias("w_fp"), F.col("node").alias("w"), F.col("n").alias("n_w")), "w_fp")
    several = prints.where("many > 1").select("fp", F.col("node").alias("v"), F.col("n").alias("n_v"))
    equal = nodes.join(several, "fp").where("node <> v").select("v", F.col("node").alias("w"), "n_v", F.col("n").alias("n_w"))
    both = ends.select("v", "w", "n_v", "n_w").unionAll(equal)
    fits = F.least("n_v", "n_w") >= F.lit(similarity) * F.greatest("n_v", "n_w") - 1e-9
    return both.where(fits).select("v", "w")


# Buckets


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, salts, node) sorted by h, less those whose h no other row has; a split bucket passes whole."""
    last = None

    def passed(rows: pa.RecordBatch, following: int | None) -> pa.RecordBatch:
        h = rows.column(0).to_numpy()
        again = np.zeros(len(h) + 1, dtype=bool)
        again[1:-1] = h[1:] == h[:-1]
        again[0] = before is not None and h[0] == before
        again[-1] = following is not None and h[-1] == following
        keep = again[1:] | again[:-1] | (rows.column(1).to_numpy() > 1)
        return rows.filter(pa.array(keep))

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            yield passed(last, batch.column(0)[0].as_py())
            before = last.column(0)[-1].as_py()
        last = batch
    if last is not None:
        yield passed(last, None)


def buckets(prefixes: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(h, node) of the prefix hashes that several nodes have."""
    # Where the sketch says that a hash may be very frequent, its rows are dealt to several tasks.
    limit = SHARE + int(np.median(sketch))
    hot = {int(i): int(-(-sketch[i] // limit)) for i in np.flatnonzero(sketch > limit)}
    rows = prefixes.select(F.explode("prefix").alias("h"), "node")
    salts = F.lit(1)
    if hot:
        pairs = [F.lit(x) for item in hot.items() for x in item]
        salts = F.coalesce(F.element_at(F.create_map(*pairs), F.col("h").bitwiseAND(len(sketch) - 1).cast("int")), F.lit(1))
    rows = rows.select("h", salts.alias("salts"), "node")
    dealt = rows.repartition("h", F.pmod(F.xxhash64("node"), F.col("salts"))).sortWithinPartitions("h")
    return dealt.mapInArrow(shared_rows, "h bigint, salts int, node bigint").select("h", "node")


def star_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """(v, w): each node w of the buckets with the one node v that stands for most of them; classes differ.

    A bucket is stood for by its least node in an order drawn from `seed`, a map-side minimum.
    """
    order = F.struct(F.xxhash64(F.lit(seed), "node").alias("at"), F.col("node").alias("v"), F.col("root").alias("v_root"))
    centre = rows.groupBy("h").agg(F.min(order).alias("centre")).select("h", "centre.v", "centre.v_root")
    met = rows.join(centre, "h").where("root <> v_root").groupBy("node", "v").agg(F.count("*").alias("shared"))
    best = met.groupBy("node").agg(F.max(F.struct("shared", "v")).alias("best"))
    return best.select("best.v", F.col("node").alias("w"))


def map_rows(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint64).reshape(len(array), -1)


def can_share(n: np.ndarray, maps: np.ndarray, others: np.ndarray, other_maps: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes and maps can have the similarity: each bit that one has alone is a hash less to share."""
    most = np.minimum(n - own_bits(maps, other_maps), others - own_bits(other_maps, maps))
    return (1 + similarity) * most >= similarity * (n + others) - 1e-9


def possible(pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The (v, w) of `pairs` that sizes and maps allow; one row of two maps each."""

    @F.arrow_udf("boolean")
    def allowed(n: pa.Array, maps: pa.Array, others: pa.Array, other_maps: pa.Array) -> pa.Array:
        if not len(n):
            return pa.array([], pa.bool_())
        return pa.array(can_share(np.asarray(n), map_rows(maps), np.asarray(others), map_rows(other_maps), similarity))

    left = sizes.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("map").alias("map_v"))
    right = sizes.select(F.col("node").alias("w"), F.col("n").alias("n_w"), F.col("map").alias("map_w"))
    rows = pairs.join(left, "v").join(right, "w")
    return rows.where(allowed("n_v", "map_v", "n_w", "map_w")).select("v", "w")


def once_each(rows: DataFrame) -> DataFrame:
    """The rows (h, node, root) of one bucket of those with the same nodes: the others have the same pairs."""
    low, high = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node"))
    known = rows.groupBy("h").agg(F.count("*").alias("many"), low.alias("low"), high.alias("high"))
    first = known.groupBy("many", "low", "high").agg(F.min("h").alias("h"))
    return rows.join(first.select("h"), "h", "left_semi")


def dealt_to_tiles(rows: DataFrame, tile: int, weight: Column | None = None) -> DataFrame:
    """Rows (h, node, root) dealt to units (h, a, b): a bucket of over `tile` nodes, or `weight`, to the pairs of its tiles."""
    many = F.count("*") if weight is None else F.sum(weight)
    sizes = rows.groupBy("h").agg(many.alias("many")).where(F.col("many") > tile)
    sizes = sizes.select("h", F.ceil(F.col("many") / tile).cast("int").alias("tiles"))
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.lit(0))
    joined = rows.join(sizes, "h", "left").select("*", own.alias("tile"))
    dealt = joined.select("*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0)))).alias("other"))
    return dealt.select("h", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "node", "root", "tile")


def near_prints(columns: dict[str, np.ndarray], similarity: float, radius: int) -> Iterator[np.ndarray]:
    """Pairs of rows of one unit but different classes whose sizes, fingerprints and maps allow the similarity.

    `unit` tells units apart and `two` those that are pairs of two tiles, of which only pairs across are wanted.
    """
    order = np.argsort(columns["n"], kind="stable")
    n, fp, root, tile, unit, two = (columns[c][order] for c in ("n", "fp", "root", "tile", "unit", "two"))
    fp, maps = fp.view(np.uint64), np.frombuffer(b"".join(columns["map"][order]), np.uint64).reshape(len(n), -1)
    step = max(1, CELLS // max(1, len(n)))
    for begin in range(0, len(n), step):
        end = min(begin + step, len(n))
        # Sizes ascend: of the rows from this block on, those at most 1 / similarity as large.
        high = int(np.searchsorted(n, n[end - 1] / similarity + 1e-9, "right"))
        left, right = slice(begin, end), slice(begin, high)
        fits = (unit[left, None] == unit[None, right]) & (root[left, None] != root[None, right])
        fits &= np.arange(begin, end)[:, None] < np.arange(begin, high)[None, :]
        i, j = np.nonzero(fits)
        i, j = i + begin, j + begin
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) | (n[i] < SURE)
        near &= (n[i] >= similarity * n[j] - 1e-9) & (~two[i] | (tile[i] != tile[j]))
        i, j = i[near], j[near]
        for at in range(0, len(i), CELLS // 64):
            p, q = i[at : at + CELLS // 64], j[at : at + CELLS // 64]
            near = can_share(n[p], maps[p], n[q], maps[q], similarity)
            if near.any():
                yield np.stack([order[p[near]], order[q[near]]], axis=1)


def own_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)


def groups_of(columns: dict[str, np.ndarray], similarity: float, radius: int) -> Iterator[np.ndarray]:
    """Rows (group, v, w, root): the nodes w that candidate pairs connect, with the least of them and their own class.

    Groups of the same nodes have the same name. A unit gives a row for each of its nodes at most, however many pairs it has.
    """
    node, root = columns["node"], columns["root"]
    found = [np.zeros((0, 2), np.int64)]
    found += [forest(pairs[:, 0], pairs[:, 1], len(node)) for pairs in near_prints(columns, similarity, radius)]
    pairs = np.concatenate(found)
    spanning = forest(pairs[:, 0], pairs[:, 1], len(node))
    if not len(spanning):
        return
    label = np.arange(len(node))
    label[spanning[:, 0]] = spanning[:, 1]
    rows = np.unique(spanning)
    rows = rows[np.lexsort((node[rows], label[rows]))]
    cuts = np.flatnonzero(np.diff(label[rows])) + 1
    out = []
    for members in np.split(rows, cuts):
        own = node[members]
        name, least = np.full(len(own), named(own)), np.full(len(own), own[0])
        out.append(np.stack([name, least, own, root[members]], axis=1))
    yield np.concatenate(out)


def links_among(columns: dict[str, np.ndarray], similarity: float, radius: int) -> Iterator[np.ndarray]:
    """Spanning links (v, w) of the pairs whose sets have the similarity; pairs that links connect already are passed over."""
    node, sets = columns["node"], columns["hashes"]
    up = list(range(len(node)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for pairs in near_prints(columns, similarity, radius):
        found = []
        for p, q in pairs.tolist():
            if (a := top(p)) != (b := top(q)) and alike(sets[p], sets[q], similarity):
                up[a] = b
                found.append((p, q))
        if found:
            yield np.sort(node[np.array(found)], axis=1)


def tile_function(take: Callable[[dict[str, np.ndarray]], Iterator[np.ndarray]], data: list[str], names: list[str]):
    """Hands rows sorted by unit to `take`, which gives rows `names`; what is held is one unit of about two tiles, or several
    small ones. `data` are columns to hand over beside those of `near_prints`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        units = rows = 0
        unit = None
        carried = ["node", "n", "fp", "map", "root", "tile", "unit", "two", *data]

        def done() -> Iterator[pa.RecordBatch]:
            columns = {c: np.concatenate([h[c] for h in held]) for c in carried}
            for found in take(columns):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(len(names))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            changed = np.zeros(batch.num_rows, dtype=bool)
            for c in ("h", "a", "b"):
                changed[1:] |= columns[c][1:] != columns[c][:-1]
            first = tuple(int(columns[c][0]) for c in ("h", "a", "b"))
            changed[0] = unit is not None and first != unit
            columns["unit"] = units + np.cumsum(changed)
            columns["two"] = columns["a"] != columns["b"]
            units = int(columns["unit"][-1])
            unit = tuple(int(columns[c][-1]) for c in ("h", "a", "b"))
            # Cut at ends of units, where enough rows have come together.
            begin = 0
            for cut in [*np.flatnonzero(changed).tolist(), batch.num_rows]:
                if cut < batch.num_rows and rows + cut - begin < TOGETHER:
                    continue
                if cut > begin:
                    held.append({c: columns[c][begin:cut] for c in carried})
                    rows += cut - begin
                if cut < batch.num_rows:
                    yield from done()
                    held.clear()
                    rows = 0
                begin = cut
        if held:
            yield from done()

    return compare


def tile_groups(rows: DataFrame, sizes: DataFrame, similarity: float, radius: int, tile: int) -> DataFrame:
    """(group, v, w, root): groups of nodes that pairs of different classes within a bucket connect which may be similar.

    Maps join last, so they are moved once.
    """
    by = ["h", "a", "b"]
    dealt = dealt_to_tiles(rows, tile).join(sizes, "node").repartition(*by).sortWithinPartitions(*by)
    take = tile_function(lambda unit: groups_of(unit, similarity, radius), [], ["group", "v", "w", "root"])
    return dealt.mapInArrow(take, "group bigint, v bigint, w bigint, root bigint").distinct()


def put_together(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(h, node, root, n): the nodes of overlapping groups under one h, or of each group where those have too large sets."""
    part = roots(groups.where("v <> w").select("v", "w").distinct()).select(F.col("fp").alias("w"), F.col("root").alias("part"))
    rows = groups.join(part, "w").join(sizes.select(F.col("node").alias("w"), "n"), "w")
    volumes = part.join(sizes.select(F.col("node").alias("w"), "n"), "w").groupBy("part").agg(F.sum("n").alias("volume"))
    h = F.when(F.col("volume") <= VOLUME, F.col("part")).otherwise(F.col("group"))
    return rows.join(volumes, "part").select(h.alias("h"), F.col("w").alias("node"), "root", "n").distinct()


def group_links(rows: DataFrame, sizes: DataFrame, sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(v, w): links of this Jaccard similarity that span the classes within each h of `rows` (h, node, root, n)."""
    by = ["h", "a", "b"]
    dealt = dealt_to_tiles(rows, VOLUME, F.col("n")).join(sizes, "node").join(sets, "node")
    take = tile_function(lambda unit: links_among(unit, similarity, radius), ["hashes"], ["v", "w"])
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(take, "v bigint, w bigint").distinct()


# Confirmation


def hash_function(shingle: int):
    """Arrow function: texts (binary) to their shingles' hashes."""

    @F.arrow_udf("array<bigint>")
    def hashes(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in (part for whole in arrays for part in slices(whole)):
            yield pa.array([shingle_hashes(x.as_buffer().to_pybytes(), shingle) for x in array], pa.list_(pa.int64()))

    return hashes.asNondeterministic()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, hashes in ascending order, have at least this Jaccard similarity."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    shared = int((a[at] == b).sum()) if len(a) else 0
    return (1 + similarity) * shared >= similarity * (len(a) + len(b)) - 1e-9


def overlap_function(similarity: float):
    """Rows (v, salt, w, hashes) sorted by centre, its own set (w null) first, to the links (v, w)."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.int64)
        for batch in batches:
            v, w = [], []
            lists = batch.column("hashes")
            for i, (own, other) in enumerate(zip(batch.column("v").to_pylist(), batch.column("w").to_pylist(), strict=True)):
                hashes = np.asarray(lists[i].values)
                if other is None:
                    centre = hashes
                    continue
                if alike(centre, hashes, similarity):
                    v.append(own)
                    w.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(w, pa.int64())], names=["v", "w"])

    return overlap


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (v, w) of `pairs` with at least this Jaccard similarity; `sets` has each node's hashes in ascending order."""
    many = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("salts"))
    members = pairs.join(many, "v").select("v", "w", F.pmod(F.xxhash64("w"), F.col("salts")).cast("int").alias("salt"))
    members = members.join(sets.withColumnRenamed("node", "w"), "w").select("v", "salt", "w", "hashes")
    centres = many.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    centres = centres.join(sets.withColumnRenamed("node", "v"), "v")
    centres = centres.select("v", "salt", F.lit(None).cast("long").alias("w"), "hashes")
    rows = members.unionAll(centres).repartition("v", "salt").sortWithinPartitions("v", "salt", F.asc_nulls_first("w"))
    return rows.mapInArrow(overlap_function(similarity), "v bigint, w bigint")


class Confirmer:
    """Confirms candidates, reading the texts of nodes it has not met before."""

    def __init__(self, docs: DataFrame, rows: DataFrame, text_col: str, shingle: int, similarity: float, scratch: Scratch) -> None:
        self.texts = packed(docs, keep_key=True).select(
            F.col("key.low").alias("low"), F.col("key.high").alias("high"), text_bytes(text_col).alias("text")
        )
        self.rows, self.shingle, self.similarity, self.scratch = rows, shingle, similarity, scratch
        self.sets: DataFrame | None = None

    def read(self, nodes: DataFrame) -> DataFrame:
        """The sets of these nodes and of all before."""
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        # One row's text for each node; equal rows have equal texts, so one of them is enough.
        wanted = self.rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("low", "high")).alias("key"))
        wanted = self.scratch.keep(wanted.select("node", "key.low", "key.high"), "wanted")
        found = self.texts.join(wanted, ["low", "high"]).groupBy("node").agg(F.first("text").alias("text"))
        new = self.scratch.keep(found.select("node", hash_function(self.shingle)("text").alias("hashes")), "hashes")
        self.sets = new if self.sets is None else self.sets.unionAll(new)
        self.scratch.drop(wanted)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = self.scratch.keep(pairs, "pairs")
        sets = self.read(pairs.select(F.explode(F.array("v", "w")).alias("node")).distinct())
        links = self.scratch.keep(confirmed(pairs, sets, self.similarity), "confirmed")
        self.scratch.drop(pairs)
        return links

    def links_of_groups(self, groups: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
        groups = self.scratch.keep(groups, "groups")
        rows = self.scratch.keep(put_together(groups, sizes), "together")
        sets = self.read(rows.select("node").distinct())
        links = self.scratch.keep(group_links(rows, sizes, sets, self.similarity, radius), "confirmed")
        self.scratch.drop(groups, rows)
        return links


# Classes


def similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    width: int = WIDTH,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: `id`, its row `key` and the `root` of its class under Jaccard similarity of word shingles.

    Classes are the connected parts of all pairs of that similarity or more.
    """
    scratch = Scratch(docs.sparkSession)
    source = packed(docs, keep_key=True).select(
        F.col(f"row.`{id_col}`").alias("id"), "key.low", "key.high", text_bytes(text_col).alias("text")
    )
    id_type = source.schema["id"].dataType.simpleString()
    marked = source.mapInArrow(
        set_function(shingle, width),
        f"id {id_type}, low bigint, high bigint, node bigint, n bigint, fp bigint, map binary, stripe int, counts array<bigint>",
    )
    marked = scratch.keep(marked, "sets")
    sketch = frequency_sketch(marked, width)
    rows = marked.where("stripe IS NULL").select("id", "low", "high", "node", "n", "fp", "map")
    confirm = Confirmer(docs, rows, text_col, shingle, similarity, scratch)

    def sizes_of(nodes: DataFrame) -> DataFrame:
        own = rows.join(nodes, "node", "left_semi").select("node", "n", "fp", "map")
        return scratch.keep(own.dropDuplicates(["node"]), "sizes")

    # SimHash: pairs by fingerprints, over all nodes.
    nodes = scratch.keep(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    pairs = scratch.keep(print_pairs(nodes, similarity, tile, scratch), "near")
    sizes = sizes_of(pairs.select(F.explode(F.array("v", "w")).alias("node")).distinct())
    links = confirm.links(possible(pairs, sizes, similarity))
    scratch.drop(nodes, pairs, sizes)
    table = scratch.keep(roots(links), "classes")

    # The exact check: pairs that share a rare shingle and are in different classes still.
    prefixes = source.select("text").mapInArrow(prefix_function(shingle, similarity, sketch), "node bigint, prefix array<bigint>")
    now = scratch.keep(buckets(prefixes.groupBy("node").agg(F.first("prefix").alias("prefix")), sketch), "buckets")
    sizes = None
    for step in range(STARS + 1):
        # Buckets that hold several classes still, and all their nodes; classes only grow, so the others are done with.
        both = now.select("h", "node").join(table.select(F.col("fp").alias("node"), "root"), "node", "left")
        both = scratch.keep(both.select("h", "node", F.coalesce("root", "node").alias("root")), "named")
        split = both.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        before, now = now, scratch.keep(both.join(split.select("h"), "h", "left_semi"), "split")
        scratch.drop(both, before)
        if now.isEmpty():
            break
        if sizes is None:
            sizes = sizes_of(now.select("node").distinct())
        if step < STARS:
            found = confirm.links(possible(star_pairs(now, step), sizes, similarity))
        else:
            before, now = now, scratch.keep(once_each(now), "once")
            scratch.drop(before)
            found = confirm.links_of_groups(tile_groups(now, sizes, similarity, radius, tile), sizes, radius)
        links = links.unionAll(found)
        table = scratch.keep(roots(links), "classes")
    classes = table.withColumnRenamed("fp", "node")
    out = rows.join(classes, "node", "left").select(
        "id", F.struct("low", "high").alias("key"), F.coalesce("root", "node").alias("root")
    )
    out = scratch.keep(out, "roots")
    scratch.drop_others(out)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` less all but one of each class: the one with the least id, nulls last, ties by row key."""
    return first_of_each(docs, similar(docs, id_col, text_col, shingle, similarity))
