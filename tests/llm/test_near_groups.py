"""Pairs just below the similarity of the pipeline's near-duplicates, which grow with the square of their family."""

import numpy as np
import pytest
from test_pipeline import similar_classes

from velometric.llm import similar_sets, simhash


def family(many, seed):
    """Texts of which most pairs are a little less similar than 0.8."""
    rng = np.random.default_rng(seed)
    base = [f"f{seed}w{i}" for i in range(255)]
    texts = []
    for _ in range(many):
        words = list(base)
        for at in rng.choice(len(words) // 6, 3, replace=False):
            words[6 * at + 3] = f"new{rng.integers(1 << 40)}"
        texts.append(" ".join(words))
    return texts


def tables(spark, texts):
    """(h, node, root) of one bucket, (node, n, fp, map) and (node, hashes)."""
    sets = [simhash.shingle_hashes(t.encode(), 5) for t in texts]
    nodes = [similar_sets.named(h) for h in sets]
    rows = spark.createDataFrame([(1, v, v) for v in nodes], "h long, node long, root long")
    sizes = [(v, len(h), similar_sets.voted(h), bytearray(similar_sets.bit_map(h))) for v, h in zip(nodes, sets, strict=True)]
    sizes = spark.createDataFrame(sizes, "node long, n long, fp long, map binary")
    hashes = [(v, h.tolist()) for v, h in zip(nodes, sets, strict=True)]
    return nodes, rows, sizes, spark.createDataFrame(hashes, "node long, hashes array<long>")


def test_candidates_of_a_family_grow_with_its_nodes(spark):
    """A tile returns a row a node, not a row a pair."""
    for many in (60, 120):
        nodes, rows, sizes, _ = tables(spark, family(many, 1))
        found = similar_sets.tile_groups(rows, sizes, 0.8, 24, 4096).collect()
        assert many / 2 < len(found) <= many
        assert {r["w"] for r in found} <= set(nodes)


@pytest.mark.parametrize(("tile", "volume"), [(4096, 1 << 21), (16, 1 << 21), (16, 5000), (4096, 5000)])
def test_groups_give_the_links_of_all_pairs(spark, monkeypatch, tile, volume):
    """Whether groups are put together, kept apart or cut into tiles, their links make the classes of all pairs."""
    monkeypatch.setattr(similar_sets, "VOLUME", volume)
    texts = [t for seed in (2, 3) for t in family(60, seed)]
    nodes, rows, sizes, sets = tables(spark, texts)
    groups = similar_sets.tile_groups(rows, sizes, 0.8, 24, tile)
    together = similar_sets.put_together(groups, sizes)
    links = similar_sets.group_links(together, sizes, sets, 0.8, 24).collect()
    at = {v: i for i, v in enumerate(nodes)}
    ends = np.array([(at[r["v"]], at[r["w"]]) for r in links])
    found = np.arange(len(nodes))
    forest = simhash.forest(ends[:, 0], ends[:, 1], len(nodes))
    found[forest[:, 0]] = forest[:, 1]
    want = similar_classes(texts)
    assert 1 < len(set(want)) < len(texts)
    assert len(set(zip(found.tolist(), want, strict=True))) == len(set(want)) == len(set(found.tolist()))


def test_buckets_of_the_same_nodes_count_once(spark):
    rows = [(h, v, v) for h, members in enumerate([(1, 2, 3), (3, 2, 1), (1, 2), (1, 2), (4, 5)]) for v in members]
    kept = similar_sets.once_each(spark.createDataFrame(rows, "h long, node long, root long")).collect()
    assert sorted((r["h"], r["node"]) for r in kept) == [(0, 1), (0, 2), (0, 3), (2, 1), (2, 2), (4, 4), (4, 5)]


@pytest.mark.parametrize("volume", [1 << 21, 5000])
def test_classes_of_families(spark, monkeypatch, volume):
    monkeypatch.setattr(similar_sets, "VOLUME", volume)
    texts = [t for seed in (4, 5) for t in family(80, seed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["id"]: r["root"] for r in similar_sets.similar(docs).collect()}
    want = similar_classes(texts)
    pairs = {(found[i], want[i]) for i in range(len(texts))}
    assert 1 < len(set(want)) < len(texts)
    assert len(pairs) == len(set(want)) == len(set(found.values()))
