"""Every operator against its plain version, over the given table and over odd rows."""

import hashlib
import math
import os
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from velometric.llm import (
    factor_machine,
    html_cut,
    mixing,
    multi_index,
    quality_rules,
    queries,
    rank_bpe,
    secret_scan,
    sharding,
    simhash,
    token_counts,
)

FOLDER = f"{os.environ.get('TESTDATA_ROOT', '/root/testdata')}/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module", params=["given", "odd", "none"])
def docs(request, given, odd_docs, no_docs):
    return {"given": given, "odd": odd_docs, "none": no_docs}[request.param]


def by_row(docs):
    return [r.asDict() for r in docs.collect()]


def multiset(rows):
    return Counter(tuple(r) for r in rows)


# Secrets


def test_secrets(docs):
    got = secret_scan.digest(secret_scan.scan_secrets(docs)).collect()
    want = Counter()
    for r in by_row(docs):
        counts, sha, _ = brute.secrets(r["text"])
        want[(r["doc_id"], *counts, sha)] += 1
    assert multiset([r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] for r in got) == want


def test_secret_base_spans_stay(odd_docs):
    texts = {r["doc_id"]: r["text"] for r in by_row(odd_docs)}
    for r in secret_scan.digest(secret_scan.scan_secrets(odd_docs.where("doc_id is not null"))).collect():
        base = {f"{brute.KINDS[k][0]}:{a}:{b}" for a, k, b in brute.secrets(texts[r["doc_id"]])[2]}
        assert base <= set(filter(None, r["spans"].split(",")))


def test_secret_ownership(spark):
    copied, own = "Abc123def456Ghi789", "Zyx987wvu654Tsr321"
    rows = [(i, f"password={copied}", "en", f"s{i % 6}") for i in range(60)]
    rows += [(100 + i, f"see password={own} here", lang, "s0") for i, lang in enumerate(["en", "fr"])]
    rows += [(200, "opaque Q9w8e7r6t5y4u3i2o1p0aSdFgH only here", "en", "s1"), (201, "plain words only", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan_secrets(docs)).collect()}
    assert (got[3]["n_live"], got[3]["n_copied"], got[3]["max_owners"]) == (0, 1, 6)
    assert (got[100]["n_live"], got[100]["max_owners"], got[100]["max_repos"]) == (1, 1, 2)
    assert got[200]["spans"] == "opaque:7:33" and got[200]["n_assign"] == 0
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(docs).collect()}
    assert masked[3] == f"password={copied}" and masked[100] == "see <secret> here"
    assert masked[200] == "opaque <secret> only here" and masked[201] == "plain words only"


def test_masking_keeps_rows(docs):
    out = secret_scan.mask_secrets(docs)
    assert out.columns == docs.columns
    clean = lambda rows: Counter(r["doc_id"] for r in rows)
    assert clean(out.collect()) == clean(docs.collect())


# Quality


def test_quality(docs):
    got = quality_rules.digest(quality_rules.quality_report(docs)).collect()
    want = Counter()
    for r in by_row(docs):
        c = brute.quality_counts(r["text"])
        want[(r["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert multiset(list(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_keeps_clean_and_drops_junk(spark):
    """Labelled texts of the larger table that pass the base rules: the adaptive fences tell them apart."""
    folder = FOLDER.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_report(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.995 and np.mean(kept[0]) < 0.05


def test_sketches_merge_exactly(spark):
    values = [0, 1, 7, 1023, 1024, 1025, 99_999, 1 << 40]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(pd_col("v")).alias("b"))
    for r in got.collect():
        shift = max(0, r["v"].bit_length() - 10)
        assert r["b"] == r["v"] >> shift << shift


def pd_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_fences_follow_the_group(spark):
    """Two sources of one language: the same text is within one's habit and outside the other's."""
    plain = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(80))
    loud = " ".join(f"WORD{chr(65 + i % 26)}{i}" for i in range(80))
    rows = [(i, plain, "en", "calm") for i in range(400)] + [(1000 + i, loud, "en", "loud") for i in range(400)]
    rows += [(1, loud, "en", "calm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_filter(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"calm": 400, "loud": 400}


def habits(share, kind):
    """Texts with about this many words in a hundred that are symbols, repeats, repeated lines, capitals, or long words."""
    rng = np.random.default_rng(share)
    texts = []
    for i in range(300):
        words = [f"{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26 % 26)}x{i}q{j}"[:9] for j, x in enumerate(rng.integers(0, 676, 100))]
        n = max(1, int(rng.normal(share, share / 8)))
        lines = [words[k : k + 5] for k in range(0, 100, 5)]
        if kind == "symbols":
            lines += [["#"] * n]
        elif kind == "repeats":
            lines += [lines[0]] and [words[:3] + [f"s{i}z{k}"] for k in range(n)]
        elif kind == "lines":
            lines += [["same", f"line{i}"]] * n
        elif kind == "capitals":
            lines = [[w.upper() if 5 * a + b < n else w for b, w in enumerate(line)] for a, line in enumerate(lines)]
        else:
            lines = [[w + "e" * share + "i" * (i % 2) * (a == 0) for w in line] for a, line in enumerate(lines)]
        texts.append("\n".join(map(" ".join, lines)))
    return texts


@pytest.mark.parametrize(
    "kind, rule", [("symbols", "symbol_share"), ("repeats", "repeat_share"), ("lines", "dup_line_share"), ("capitals", "upper_share"), ("length", "word_length")]
)
def test_every_fence_adapts(spark, kind, rule):
    """What is a habit of one source is junk in another, for every rule; most texts stay in both."""
    few, many = habits(3, kind), habits(24, kind)
    rows = [(i, t, "en", "few") for i, t in enumerate(few)] + [(1000 + i, t, "en", "many") for i, t in enumerate(many)]
    rows += [(5000 + i, t, "en", "few") for i, t in enumerate(many[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_report(docs).collect()}
    limits = {r["source"]: r[f"upper_{rule}"] for r in quality_rules.fences(quality_rules.measured(docs, "text", "lang", "source")).collect()}
    assert limits["few"] < limits["many"]
    assert not any(got[5000 + i]["kept"] for i in range(10)) and not any(got[5000 + i]["base_failed"] for i in range(10))
    assert np.mean([got[i]["kept"] for i in range(300)]) > 0.95
    assert np.mean([got[1000 + i]["kept"] for i in range(300)]) > 0.95


# SimHash


def test_simhash(docs):
    got = simhash.digest(simhash.near_duplicates(docs, tile=16)).collect()
    prints = [(r["doc_id"], brute.fingerprint(r["text"])) for r in by_row(docs)]
    named = brute.components(sorted({p for p in prints if p[0] is not None}))
    want = Counter()
    for d, f in prints:
        home = d if d is not None else next((x for x, g in prints if x is not None and (g ^ f).bit_count() <= 4), None)
        want[(d, f"{f:016x}", named.get(home))] += 1
    assert multiset(got) == want


@pytest.mark.parametrize("tile", [8, 64, 4096])
def test_simhash_links_are_exact(spark, tile):
    """Random fingerprints, chains of near ones, and one large ball, against all pairs."""
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 400)}
    for x in list(prints)[:60]:
        for _ in range(4):
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    ball = int(rng.integers(0, 1 << 63))
    prints |= {ball ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    rows = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x), i) for i, x in enumerate(rows)], "fp long, id long")
    got = {r["fp"]: r["component"] for r in simhash.classes(table, tile=tile).collect()}
    want = brute.components([(i, x) for i, x in enumerate(rows)])
    assert got == {signed(x): want[i] for i, x in enumerate(rows)}


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12])
def test_block_plan_loses_no_pair(count):
    masks = simhash.block_plan(count, 4)
    rng = np.random.default_rng(1)
    for _ in range(300):
        flips = rng.choice(64, 4, replace=False)
        apart = sum(1 << int(b) for b in flips)
        assert any(apart & (m % (1 << 64)) == 0 for m in masks)


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = by_row(kept)
    prints = {r["doc_id"]: brute.fingerprint(r["text"]) for r in by_row(docs)}
    classes = {simhash_class for simhash_class in named_classes(docs)}
    assert len(rows) == len(classes)
    assert len({prints[r["doc_id"]] for r in rows}) == len(rows)


def test_keep_one_tells_classes_apart(spark):
    """Ids that are null or repeat on different texts name no class."""
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (7, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = multiset(simhash.keep_one(docs).collect())
    assert kept == Counter([(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5])])


def named_classes(docs):
    return {r["component"] for r in simhash.near_duplicates(docs).select("component").collect()}


# Nearest neighbours


def table_of(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = frame.collect()
    return frame, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_nearest_recall(spark, scale):
    frame, ids, vectors = table_of(spark, FOLDER.replace("sf0.001", scale))
    got = defaultdict(list)
    for r in multi_index.search(frame, multi_index.every_hundredth(frame)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute.nearest(ids, vectors)
    assert got.keys() == want.keys()
    found = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert found >= 0.9
    for q, hits in got.items():
        assert hits == sorted(hits) and len(hits) == 10
        for score, i in hits:
            assert score == pytest.approx(math.dist(vectors[ids.index(q)], vectors[ids.index(i)]), rel=1e-12)


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)]
    same = rng.normal(size=6).tolist()
    rows += [(100 * i, same) for i in range(1, 4)] + [(1001 + i, same) for i in range(40)]
    rows += [(5000, None), (5100, []), (5200, [0.0] * 6), (5300, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5400, [float("nan")] * 6)]
    rows += [(5500, [float("inf")] * 6), (5600, [1.0, 2.0]), (None, same), (100, same)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(frame, multi_index.every_hundredth(frame), visit=1.0).collect()
    good = {i: v for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    want = brute.nearest(list(good), np.array(list(good.values())))
    assert {r["query_id"] for r in got} == set(want) == {100, 200, 300}
    for q, hits in want.items():
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in own] == [i for _, i in hits]


def test_nearest_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    got = multi_index.search(few, multi_index.every_hundredth(few)).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert multi_index.search(few.limit(0), few).count() == 0


def test_nearest_within_each_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 3).tolist()) for i in range(0, 400, 4)] + [(9999, rng.normal(size=9).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in multi_index.search(frame, multi_index.every_hundredth(frame), visit=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = {}
    for n in (2, 3, 4):
        own = [(i, v) for i, v in rows if len(v) == n]
        want |= brute.nearest([i for i, _ in own], np.array([v for _, v in own]))
    assert got == {q: [i for _, i in hits] for q, hits in want.items()} and len(got) == 4


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_nearest_far_from_the_origin(spark, spread):
    """Neither a common offset nor long vectors lose a neighbour to the rounding of the products."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 16)) * spread + 1e6
    points[300:] = points[:300] + rng.normal(size=(300, 16)) * 1e-3
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = multi_index.search(frame, multi_index.every_hundredth(frame), visit=1.0).collect()
    want = brute.nearest(list(range(600)), points)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == {
        (q, rank): i for q, hits in want.items() for rank, (_, i) in enumerate(hits, 1)
    }


def test_traversal_order():
    """Cells come in order of summed distance, each once."""
    rng = np.random.default_rng(3)
    first, second = rng.random(9), rng.random(7)
    cells = multi_index.traverse(first, second, np.ones((9, 7), int), 63)
    sums = [first[i] + second[j] for i, j in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)


# Encoding


def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_bpe(docs):
    tokenizer, want = library(), Counter()
    for r in by_row(docs):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[(r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert multiset(rank_bpe.digest(rank_bpe.round_trip(docs, VOCABULARY)).collect()) == want


def test_bpe_letters():
    """All letters of the first planes, words of random letters, and both ways of merging."""
    tokenizer, bpe = library(), rank_bpe.WordBpe(VOCABULARY)
    rng = np.random.default_rng(4)
    known = [c for c in map(chr, range(0xD800)) if unicodedata.category(c) != "Cn"]
    texts = ["".join(known[a : a + 64]) for a in range(0, len(known), 64)]
    texts += ["".join(rng.choice(list("abcdefghinorst'"), 300)) for _ in range(50)]
    differ = [t for t in texts if tokenizer.encode(t, add_special_tokens=False).ids != list(memoryview(bpe.encode(t)).cast("I"))]
    assert not differ
    for t in texts[-50:]:
        parts = bpe.parts(t.replace("'", ""))
        assert bpe.merge_short(list(parts)) == bpe.merge_long(list(parts))


def test_bpe_code_points():
    """Every code point of the first four planes inside a word, between digits and alone, assigned or not."""
    tokenizer, bpe = library(), rank_bpe.WordBpe(VOCABULARY)
    texts = [f"ab{c}cd 1{c}2 {c}!" for c in map(chr, range(0x40000)) if not "\ud800" <= c <= "\udfff"]
    got = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, got, strict=True) if e.ids != list(memoryview(bpe.encode(t)).cast("I"))] == []


def test_bpe_normal_form_beside_newer_code_points():
    tokenizer, bpe = library(), rank_bpe.WordBpe(VOCABULARY)
    texts = ["E\u0301te\u0301 \u1c89\u03a3 don't", "\ua7cb\u0301<|endoftext|>\u208f \u3000 x", "\U0003fc3b", "\u0558" * 300]
    for t in texts:
        assert list(memoryview(bpe.encode(t)).cast("I")) == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_counts(docs):
    tokenizer, want = library(), Counter()
    for r in by_row(docs):
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)] += 1
    assert multiset(token_counts.count_tokens(docs, VOCABULARY).collect()) == want


def test_pieces():
    for text in ("", "a b", "a" * 50 + " b c", " " * 40, "ab " * 30):
        cut = list(token_counts.pieces(text, 10))
        assert "".join(cut) == text
        assert all(len(p) <= 10 or " " not in p[:-1] for p in cut)


# Mixing and sharding


def test_mixing(docs):
    got = mixing.mix(docs).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for r in by_row(docs):
        sizes[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    want = brute.targets(dict(sizes)) if sizes else {}
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in by_row(docs))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["size"] == len(brute.WORD.findall(r["text"] or ""))
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.1 * target + 3 * largest[source]


def test_mixed_rows(odd_docs):
    once = sorted(map(str, mixing.mixed(odd_docs).collect()))
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert once == sorted(map(str, mixing.mixed(odd_docs.repartition(7)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 0}, {"a": 5}, {"a": 1, "b": 1, None: 100}, {"a": 10, "b": 1000, "c": 3, "d": 0, None: 7}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(brute.targets(sizes))


def test_size_class_grows(spark):
    rows = spark.range(5000).select("id", mixing.size_class(pd_col("id")).alias("c")).orderBy("id").collect()
    classes = [r["c"] for r in rows]
    assert classes == sorted(classes) and classes[:16] == list(range(16))


def test_sharding(docs):
    got = sharding.digest(sharding.assign_shards(docs, 8)).collect()
    want = Counter()
    for r in by_row(docs):
        data = (r["text"] or "").encode()
        want[(r["doc_id"], len(data) + 1, zlib.crc32(data))] += 1
    assert multiset((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert (r["law"], r["grown_shard"]) == ("bytes", None) and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_grains_grow_with_the_rows():
    assert sharding.grains_of(0, 1024) == sharding.grains_of(10**9, 1024) == sharding.GRAINS
    for rows in (10**11, 10**12, 10**13):
        grains = sharding.grains_of(rows, 1024)
        assert rows / (grains * 1024) <= sharding.ROWS < 2 * rows / (grains * 1024)


@pytest.mark.parametrize("rows", [1, 3000])
def test_slots_with_many_grains(spark, monkeypatch, rows):
    """More grains than least: slots stay gapless and sizes near equal, a third of the rows being one text."""
    monkeypatch.setattr(sharding, "GRAINS", 16)
    monkeypatch.setattr(sharding, "ROWS", 1)
    assert sharding.grains_of(rows, 64) == (64 if rows > 1 else 16)
    text = F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    docs = spark.range(rows).select((F.col("id") % 7).alias("doc_id"), text.alias("text"))
    slots, sizes = defaultdict(list), Counter()
    for r in sharding.assign_shards(docs, 8, ranges=64).collect():
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sum(map(len, slots.values())) == rows
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows > 8:
        assert len(sizes) == 8 and max(sizes.values()) < 1.2 * min(sizes.values())


def test_shards_are_even(spark):
    """One text that a third of the rows hold is subdivided; its shards stay near the mean."""
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(docs, 8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.02 * sum(sizes) / 8 and min(sizes) > 0.98 * sum(sizes) / 8


def test_range_of(spark):
    cuts = sorted(int(x) for x in np.random.default_rng(6).integers(0, 1000, 90))
    cuts = sorted(set(cuts))
    rows = spark.range(1001).select("id", sharding.range_of(pd_col("id"), cuts).alias("r")).collect()
    assert all(r["r"] == sum(c <= r["id"] for c in cuts) for r in rows)


# Classifier


def test_factor_machine_held_out(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    machine = factor_machine.train(docs, labels)
    again = factor_machine.train(docs.repartition(5), labels)
    assert np.array_equal(machine.vectors, again.vectors)
    rows = factor_machine.score_quality(docs, machine).join(labels, "doc_id").where("held_out").collect()
    score, truth = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    ranks = pd.Series(score).rank().to_numpy()
    good = truth == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95
    assert np.mean(score[good] >= 0.7) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_factor_machine_identity():
    """The linear-time score is the sum over all pairs."""
    rng = np.random.default_rng(7)
    machine = factor_machine.Machine(0.1, rng.normal(0, 0.1, factor_machine.SIZE), rng.normal(0, 0.1, (factor_machine.SIZE, 3)))
    index, value = factor_machine.features(b"some words and some More words, 12 of them")
    z = 0.1 + sum(machine.weights[i] * x for i, x in zip(index, value, strict=True))
    for a in range(len(index)):
        for b in range(a):
            z += machine.vectors[index[a]] @ machine.vectors[index[b]] * value[a] * value[b]
    assert machine.score(index, value) == pytest.approx(1 / (1 + np.exp(-z)))


def test_factor_machine_odd_rows(docs, spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (9, 1), (9, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = factor_machine.score_quality(docs, factor_machine.train(docs, known)).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in by_row(docs))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


# Pages


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>First</a><li><a href=/b>Second</a></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is very good and costs little, really very little for what it is.</div>
<div class="cookie-notice"><p>We use cookies to make this page work. Please accept them all, every single one.</p></div>
<article><header><h2>A &amp; B</h2></header><p><b>First   paragraph of
 the story, with <a href=x>a link</a> in it.<br><p>Short.</p><ul><li>one</li><li>two items</li></ul>
<aside>Related: other things to read</aside><blockquote>Quoted &eacute;</blockquote></article>
<section id="comments"><h3>Comments</h3><p>I agree with all of this, it is a very good story indeed.</p></section>
<form><label>Your mail</label><input name=q><button>Send</button></form>
<div class=sidebar><p>Popular stories of this week are listed here for you to read.</p></div>
<footer>&copy; someone &middot; All rights reserved by the owners of this page.</footer></body></html>"""


def test_page():
    assert html_cut.main_text(PAGE) == "A & B\nFirst paragraph of the story, with a link in it.\nShort.\none\ntwo items\nQuoted é"


@pytest.mark.parametrize("html", ["", " ", "<", "<p", "</p></div>", "<![", "<!DOCTYPE [", "<p>a<p>b", "&#0;&bogus;", "<script>x", "<a" * 500])
def test_broken_pages(html):
    assert isinstance(html_cut.main_text(html), str)


@pytest.mark.parametrize("odd", ["<![foo]>", "<![foo[ x ]]>", "<![>", "<![ ]>", "<![1]>", "<![endif]>", "<!-->", "<!foo>"])
def test_text_after_odd_declarations(odd):
    page = f"<article><p>The first paragraph of the story.</p>{odd}<p>The second one, which is kept.</p></article>"
    assert html_cut.main_text(page).startswith("The first paragraph of the story.\n")
    assert html_cut.main_text(page).endswith("The second one, which is kept.")


STORY = (
    "<article><h1>A title of the story</h1><p>The first paragraph of the story, which is long enough to be read as one.</p>"
    "<p>The second paragraph of the story with <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in it.</p></article>"
)
MENU = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>"
NOTE = "<p>Some words on another matter that nobody asked for, and which go on for a while, as such words will do.</p>"


@pytest.mark.parametrize(
    "before, after",
    [
        ("<body class='has-sidebar'>", "</body>"),
        ("<body class='sidebar ads'>", "</body>"),
        ("<body><div class='page no-sidebar'>", "</div></body>"),
        ("<body><div class='sidebar-left'><div>", "</div></div></body>"),
        ("<body><form id='page'>", "</form></body>"),
        ("<body><div id='with-header'><main>", "</main></div></body>"),
    ],
)
def test_layout_names_around_an_article(before, after):
    page = f"{before}{MENU}{STORY}<div class='sidebar'><div><div>{NOTE}</div></div></div>{after}"
    want = "A title of the story\nThe first paragraph of the story, which is long enough to be read as one.\n"
    assert html_cut.main_text(page) == want + "The second paragraph of the story with x=2 in it."


@pytest.mark.parametrize("around", ["<aside>", "<div hidden>", "<div class='comments'>", "<div role='navigation'>", "<footer>"])
def test_article_below_firm_evidence(around):
    page = f"<body>{STORY}{around}<article>{NOTE}</article></body>"
    assert "another matter" not in html_cut.main_text(page) and "second paragraph" in html_cut.main_text(page)


RUNNING = "<p>The river rose for three days before the town moved its market to the hill, as old letters tell.</p>"


@pytest.mark.parametrize(
    "open_, close",
    [
        ('<form id="aspnetForm"><div>', "</div></form>"),
        ('<div class="elementor-widget-container">', "</div>"),
        ('<div class="search-results-page">', "</div>"),
        ('<div class="banner-free">', "</div>"),
        ('<article><section id="related-work">', "</section></article>"),
        ('<article><section class="search-methods">', "</section></article>"),
        ('<article><div class="social-science">', "</div></article>"),
    ],
)
def test_frames_and_names_of_several_parts(open_, close):
    html = f"<body><nav><a href=/>Home</a></nav>{open_}{RUNNING}{RUNNING}{close}<footer>All rights reserved</footer></body>"
    assert html_cut.main_text(html) == "\n".join([RUNNING[3:-4]] * 2)


@pytest.mark.parametrize(
    "name", ["site-header", "cookie-banner", "comment-list", "sidebar-left", "article-comments", "social-share", "ad-slot"]
)
def test_names_with_plain_parts_go(name):
    html = f"<body><article>{RUNNING}{RUNNING}</article><div class={name}>{RUNNING}</div></body>"
    assert html_cut.main_text(html) == "\n".join([RUNNING[3:-4]] * 2)


def test_a_form_beside_the_article_goes():
    html = f"<body><article>{RUNNING}</article><form><p>Sign up for our letter and get it each week by mail.</p></form></body>"
    assert html_cut.main_text(html) == RUNNING[3:-4]


def test_pages_of_the_table(spark):
    """In the given pages the article's blocks, and only they, are the text."""
    import re

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for r in html_cut.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", article)
        texts = [" ".join(html_cut.re.sub(r"<[a-z/][^>]*>", " ", b).split()) for b in blocks]
        import html

        assert r["text"].replace(" ", "") == "\n".join(html.unescape(t) for t in texts if t).replace(" ", "")
        assert r["n_chars"] == len(r["text"])


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, PAGE), (2, "u", PAGE), (2, "u", PAGE), (3, None, "<p>" + "word " * 200_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_cut.extract_pages(frame).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    assert html_cut.extract_pages(frame.limit(0)).count() == 0


def test_cut_is_minimal():
    """Against every labelling of small graphs."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        source, sink = rng.integers(0, 20, n).tolist(), rng.integers(0, 20, n).tolist()
        edges = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, n, (2 * n, 3)) if a != b]

        def cost(keep, source=source, sink=sink, edges=edges):
            own = sum(t if k else s for k, s, t in zip(keep, source, sink, strict=True))
            return own + sum(c for a, b, c in edges if keep[a] != keep[b])

        every = [[bool(m >> i & 1) for i in range(n)] for m in range(1 << n)]
        assert cost(html_cut.content_side(source, sink, edges)) == min(map(cost, every))


# Registration


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("bad", ["<!--", "<!-- x>", "<![CDATA[ y>", "<![if z>", "<q", "</b", "</section>"])
def test_broken_markup_takes_time_with_its_length(bad):
    def seconds(n):
        began = time.process_time()
        html_cut.main_text("<div><p>Start.</p>" + bad * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(80_000) < 12 * seconds(20_000) + 0.2
    assert html_cut.main_text("<article><p>" + "Some words of text, " * 20 + "end.</p><!-- open").startswith("Some words")
