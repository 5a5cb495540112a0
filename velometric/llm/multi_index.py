"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own k centroids, so k * k cells come from 2 k centroids.
For a query, the pairs of centroids are traversed by summed distance with a heap until the cells seen hold a given share of
the index; their entries are reranked by exact distance.

Equal vectors are one entry that holds their smallest ids (one more than asked for, so no result can need another), which
keeps a vector that a third of all rows share from meeting itself. Entries lie in blocks by their first centroid, blocks over
BLOCK entries are split, and queries are sent to the blocks they visit with the list of second centroids; a unit is at
most BLOCK entries by QUERIES queries, compared with one matrix product. Only each unit's nearest leave it.

The centroids are fitted on at most SAMPLE distinct vectors, those with the smallest hashes; every vector is indexed. The
k * k cell counts (k at most CENTROIDS) go to the driver and with the centroids to the tasks.

Defined results: rows with a null id, and vectors null, empty, zero or holding null or non-finite numbers take no part; a
vector's neighbours are those of its own length, each length having an index of its own (the driver sees the lengths); equal
rows count once; ties go to the smaller id; an empty table gives an empty one; further columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velometric.llm.common import written

SAMPLE = 20_000
CENTROIDS = 128
ROUNDS = 12
BLOCK = 8192
QUERIES = 2048
VISIT = 0.4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, equal rows once."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    return rows.where(finite & F.exists("vec", lambda x: x != 0)).distinct()


def entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: `entry` (their least id), `vec` and `ids`, the k + 1 least. The rank limit prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    least = rows.select("vec", "id", rank.alias("rank")).where(F.col("rank") <= k + 1)
    return least.groupBy("vec").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids"))


def fit(points: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced sample points; an empty centroid stays where it was."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        label = nearest(points, centroids)
        for c in np.unique(label):
            centroids[c] = points[label == c].mean(axis=0)
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)[None]
    return np.maximum(out, 0)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(points, centroids).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in order of first[i] + second[j] until they hold `enough` entries.

    The multi-sequence algorithm: pairs of ranks wait in a heap; taking (a, b) lets in (a + 1, b) and (a, b + 1) once
    both of the pairs before them are out.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(float(first[by_first[0]] + second[by_second[0]]), 0, 0)]
    out, held = [], 0
    done = np.zeros(len(first), dtype=np.int64)  # how many of each row's columns are out
    while heap and held < enough:
        _, a, b = heapq.heappop(heap)
        i, j = int(by_first[a]), int(by_second[b])
        done[a] = b + 1
        if sizes[i, j]:
            out.append((i, j))
            held += int(sizes[i, j])
        if b + 1 < len(second) and (a == 0 or done[a - 1] > b + 1):
            heapq.heappush(heap, (float(first[i] + second[by_second[b + 1]]), a, b + 1))
        if a + 1 < len(first) and done[a + 1] == b:
            heapq.heappush(heap, (float(first[by_first[a + 1]] + second[j]), a + 1, b))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    visit: float = VISIT,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    centroids: int = CENTROIDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of `vectors` to each row of `queries`, which are rows of it.

    `visit` is the share of the index's entries that a query's cells must hold before the traversal stops; the share
    sets recall, not the table's size.
    """
    every = written(entries(usable(vectors, id_col, vector_col), k), "ann-entries")
    asked = usable(queries, id_col, vector_col)
    lengths = [r["n"] for r in every.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    found = []
    for n in lengths:
        sides = (every, asked) if len(lengths) == 1 else (every.where(F.size("vec") == n), asked.where(F.size("vec") == n))
        found.append(search_entries(*sides, k, visit, sample, centroids))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionAll, found)


def search_entries(table: DataFrame, asked: DataFrame, k: int, visit: float, sample: int, centroids: int) -> DataFrame:
    """`search` among entries of one length, for the rows (id, vec) of `asked`."""
    drawn = table.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("vec").toPandas()["vec"]
    points = np.stack(drawn.to_numpy())
    middle = points.mean(axis=0)
    half = points.shape[1] // 2
    count = table.count()
    centroids = min(centroids, len(points))
    books = fit(points[:, :half], centroids), fit(points[:, half:], centroids)

    @F.arrow_udf("struct<i:int,j:int>")
    def cell(column: pa.Array) -> pa.Array:
        x = matrix(column)
        i, j = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
        return pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], names=["i", "j"])

    index = written(table.select("entry", "vec", "ids", cell("vec").alias("cell")).select("entry", "vec", "ids", "cell.i", "cell.j"), "ann-index")
    sizes = np.zeros((centroids, centroids), dtype=np.int64)
    for row in index.groupBy("i", "j").agg(F.count("*").alias("n")).collect():
        sizes[row["i"], row["j"]] = row["n"]
    enough = max(int(np.ceil(visit * count)), k + 1)
    splits = np.maximum(1, -(-sizes.sum(axis=1) // BLOCK))

    @F.arrow_udf("array<struct<i:int,js:array<int>>>")
    def visits(column: pa.Array) -> pa.Array:
        x = matrix(column)
        first, second = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
        out = []
        for a, b in zip(first, second, strict=True):
            lists: dict[int, list[int]] = {}
            for i, j in traverse(a, b, sizes, enough):
                lists.setdefault(i, []).append(j)
            out.append([{"i": i, "js": js} for i, js in lists.items()])
        return pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("js", pa.list_(pa.int32()))])))

    points_asked = written(
        asked.join(index.select("vec", "entry"), "vec").select(F.col("id").alias("query_id"), "entry"), "ann-queries"
    )
    heads = points_asked.select("entry").distinct().join(index.select("entry", "vec"), "entry")
    groups = max(1, -(-heads.count() // QUERIES))
    parts = F.array(*[F.lit(int(s)) for s in splits])
    spread = lambda n: F.pmod(F.xxhash64("entry"), n).cast("int")
    asks = heads.select("entry", "vec", F.explode(visits("vec")).alias("visit")).select(
        F.col("entry").alias("q"), F.col("vec").alias("point"), "visit.i", "visit.js", spread(F.lit(groups)).alias("group"),
        F.explode(F.sequence(F.lit(0), F.get(parts, F.col("visit.i")) - 1)).alias("part"),
    )
    held = index.select(
        "entry", "vec", "ids", "i", "j", spread(F.get(parts, F.col("i"))).alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    width = k + 1

    def rerank(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        if near.empty or far.empty:
            kinds = {"q": "int64", "entry": "int64", "ids": "object", "score": "float64"}
            return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in kinds.items()})
        q, x = np.stack(near["point"].to_numpy()), np.stack(far["vec"].to_numpy())
        allowed = np.zeros((len(q), centroids), dtype=bool)
        for row, js in enumerate(near["js"]):
            allowed[row, np.asarray(js)] = True
        near_middle, far_middle = q - middle, x - middle
        apart = np.where(allowed[:, far["j"].to_numpy()], distances(near_middle, far_middle), np.inf)
        last = min(width, len(x)) - 1
        edge = np.partition(apart, last, axis=1)[:, last]
        # A margin over the last place keeps every tie for the exact distance: twice what the products can be off, which
        # grows with the vectors' length and their distance from the middle.
        off = np.finfo(float).eps * (q.shape[1] + 4) * ((near_middle**2).sum(1) + (far_middle**2).sum(1).max())
        row, col = np.nonzero((apart <= (edge * (1 + 1e-9) + 8 * off)[:, None]) & np.isfinite(apart))
        score = np.sqrt(((q[row] - x[col]) ** 2).sum(axis=1))
        entry = far["entry"].to_numpy()[col]
        out = pd.DataFrame({"q": near["q"].to_numpy()[row], "entry": entry, "ids": far["ids"].to_numpy()[col], "score": score})
        return out.sort_values(["q", "score", "entry"]).groupby("q", sort=False).head(width)

    keys = ["i", "part", "group"]
    near = asks.groupBy(*keys).cogroup(held.groupBy(*keys))
    found = near.applyInPandas(rerank, "q bigint, entry bigint, ids array<bigint>, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "entry"))
    best = found.select("*", rank.alias("place")).where(F.col("place") <= width)
    lists = best.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("lists"))
    each = F.flatten(F.transform("lists", lambda e: F.transform(e["ids"], lambda v: F.struct(e["score"].alias("score"), v.alias("id")))))
    top = written(lists.select(F.col("q").alias("entry"), F.slice(F.array_sort(each), 1, width).alias("top")), "ann-top")
    own = points_asked.join(top, "entry").select("query_id", F.expr("slice(filter(top, t -> t.id <> query_id), 1, %d)" % k).alias("top"))
    rows = own.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def every_hundredth(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The contract's query set."""
    return vectors.where(F.col(f"`{id_col}`") % 100 == 0)
