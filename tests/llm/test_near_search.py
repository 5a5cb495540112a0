"""The search by SimHash fingerprints that proposes the pipeline's near-duplicates."""

import numpy as np
import pyarrow as pa
import pytest

from velometric.llm import similar_sets, simhash
from velometric.llm.common import Scratch


def near_texts():
    """Families of texts of which each has a few words changed."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(60):
        base = [f"t{k}w{i}" for i in range(int(rng.integers(90, 300)))]
        texts.append(" ".join(base))
        for changes in (1, 2, 3):
            words = list(base)
            for at in rng.integers(0, len(words), changes):
                words[at] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("tile", [16, 4096])
def test_search_by_fingerprints_finds_the_joins(spark, tile):
    """Fingerprints alone propose at least 0.9 of the links that join the classes of all similar pairs."""
    sets = {}
    for text in near_texts():
        hashes = simhash.shingle_hashes(text.encode(), 5)
        sets[similar_sets.named(hashes)] = hashes
    rows = [(node, len(h), similar_sets.voted(h)) for node, h in sets.items()]
    nodes = spark.createDataFrame(rows, "node long, n long, fp long")
    proposed = similar_sets.print_pairs(nodes, 0.8, tile, Scratch(spark)).collect()

    def joins(pairs):
        at = {node: i for i, node in enumerate(sets)}
        ends = np.array([(at[v], at[w]) for v, w in pairs], dtype=np.int64).reshape(-1, 2)
        return len(simhash.forest(ends[:, 0], ends[:, 1], len(sets)))

    def similar(v, w):
        shared = len(np.intersect1d(sets[v], sets[w]))
        return 1.8 * shared >= 0.8 * (len(sets[v]) + len(sets[w]))

    keys = list(sets)
    want = joins([(v, w) for i, v in enumerate(keys) for w in keys[:i] if similar(v, w)])
    assert want > 100
    assert joins([(r["v"], r["w"]) for r in proposed if similar(r["v"], r["w"])]) >= 0.9 * want


@pytest.mark.parametrize("tile", [16, 4096])
def test_partners_against_all_pairs(spark, tile):
    """Every fingerprint is given its nearest, as far as `n` allows, and none beyond the radius."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(1, 12, 400)]
    fps = np.unique(np.concatenate([fps, fps[rng.integers(0, 40, 400)] ^ np.array(flips)]))
    n = rng.integers(80, 120, len(fps))
    table = pa.table({"fp": fps.view(np.int64), "n": n}).to_pandas()
    found = simhash.partners(spark.createDataFrame(table), 8, 14, 0.8, tile=tile).collect()
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int)
    apart[np.minimum(n[:, None], n[None, :]) < 0.8 * np.maximum(n[:, None], n[None, :])] = 65
    np.fill_diagonal(apart, 65)
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    got = {i: set() for i in range(len(fps))}
    for r in found:
        got[at[r["v"]]].add(int(apart[at[r["v"]], at[r["w"]]]))
    for i, distances in got.items():
        assert all(d <= 14 for d in distances)
        least = apart[i].min()
        assert (min(distances) == least) if least <= 14 else not distances
