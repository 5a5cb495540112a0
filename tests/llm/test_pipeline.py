"""The pipeline against plain versions of its stages, and each stage on odd rows."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from velometric.llm import similar_sets
from velometric.llm.oracle import ORACLE

FOLDER = f"{os.environ.get('TESTDATA_ROOT', '/root/testdata')}/sf0.001"


def sql(name: str, documents: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", documents)
    return con.execute(ORACLE[name]).df()


def live(value: str) -> bool:
    return bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value)) and len(set(value)) >= 8


def masked(documents: pd.DataFrame) -> pd.DataFrame:
    spans = {i: brute.secrets(t)[2] for i, t in zip(documents["doc_id"], documents["text"], strict=True)}
    owners = defaultdict(set)
    values = {}
    for i, text, source in documents[["doc_id", "text", "source"]].itertuples(index=False):
        for a, k, b in spans[i]:
            pattern, group = brute.KINDS[k][1], brute.KINDS[k][2]
            values[i, a, k] = pattern.match(text[a:b]).group(group)
            owners[values[i, a, k]].add(source)
    out = []
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        at, new = 0, []
        for a, k, b in spans[i]:
            value = values[i, a, k]
            if live(value) and len(owners[value]) <= 3:
                if a >= at:
                    new += [text[at:a], "<secret>"]
                at = max(at, b)
        out.append("".join(new) + text[at:])
    return documents.assign(text=out)


def test_pipeline(spark):
    docs = duckdb.sql(f"select * from '{FOLDER}/documents.parquet'").df()
    kept = sql("op2_quality", docs).query("kept")["doc_id"]
    docs = docs[docs["doc_id"].isin(kept)]
    docs = docs.sort_values("doc_id").reset_index(drop=True)
    docs = masked(docs.iloc[sorted(set(similar_classes(docs["text"])))].reset_index(drop=True))
    copies = sql("op6_mixing", docs).set_index("doc_id")["copies"]
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, dtype="<u4").tobytes()
        row = (i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        want[row] += int(copies[i])
    want = Counter({k: n for k, n in want.items() if n})
    rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) > 50 and Counter(map(tuple, rows)) == want


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_classes(texts):
    """Place -> least place of its class, by all pairs of five-word Jaccard similarity 0.8 or more."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(texts))]


def near_copies():
    """Texts with a shared passage, and copies of them with some words changed, from similar to not similar."""
    rng = np.random.default_rng(3)
    passage = [f"common{i}" for i in range(40)]
    texts = []
    for k in range(25):
        base = [f"t{k}w{i}" for i in range(int(rng.integers(20, 200)))] + passage
        for changes in (0, 1, 2, 3, 4, 6, 9):
            words = list(base)
            for at in rng.integers(0, len(words), changes):
                words[at] = f"new{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("kind", ["given", "planted"])
def test_near_duplicates_by_all_pairs(spark, kind):
    if kind == "given":
        rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet' order by doc_id").fetchall()
    else:
        rows = list(enumerate(near_copies()))
    classes = similar_classes([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {rows[place][0] for place in set(classes)}
    assert len(kept) < len(rows)


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_on_odd_rows(spark, odd_docs, no_docs, place, kind):
    docs = odd_docs if kind == "odd" else no_docs
    out = corpus_pipeline.STAGES[place][1](spark, docs, "")
    rows = out.collect()
    if place < len(corpus_pipeline.STAGES) - 1:
        assert out.schema.simpleString() == docs.schema.simpleString()
    assert bool(rows) == (kind == "odd")


def test_shared_passage_costs_nothing(spark):
    """One passage in thousands of otherwise different texts makes next to no buckets, however many they are."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"common{i}" for i in range(40))
    for count in (1000, 4000):
        rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) + " " + passage) for i in range(count)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        source = docs.selectExpr("doc_id id", "doc_id low", "doc_id high", "cast(text as binary) text")
        schema = "id long, low long, high long, node long, n long, fp long, map binary, stripe int, counts array<long>"
        sketch = similar_sets.frequency_sketch(source.mapInArrow(similar_sets.set_function(5, 1 << 20), schema), 1 << 20)
        prefixes = source.select("text").mapInArrow(similar_sets.prefix_function(5, 0.8, sketch), "node long, prefix array<long>")
        assert sketch.sum() == count * 96
        assert similar_sets.buckets(prefixes, sketch).count() < count / 20


@pytest.mark.parametrize("share, tile", [(1 << 14, 4096), (8, 16)])
def test_families_of_copies(spark, monkeypatch, share, tile):
    """Chains, families of near copies and pairs just below the similarity, with buckets and centres split and whole."""
    monkeypatch.setattr(similar_sets, "SHARE", share)
    rng = np.random.default_rng(9)
    texts = near_copies()
    base = [f"hub{i}" for i in range(200)]
    for _ in range(150):
        words = list(base)
        for at in rng.integers(0, 200, int(rng.integers(1, 8))):
            words[at] = f"own{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    for _ in range(30):
        # A chain: each text changes a word of the one before.
        base = list(base)
        base[int(rng.integers(0, 200))] = f"link{rng.integers(1 << 30)}"
        texts.append(" ".join(base))
    texts += ["a b c d e f", "a b c d e g", "short", "Short", "", None, "short one"] + texts[:3]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["id"]: r["root"] for r in similar_sets.similar(docs, tile=tile).collect()}
    want = similar_classes(texts)
    pairs = {(found[i], want[i]) for i in range(len(texts))}
    assert len(pairs) == len(set(want)) == len(set(found.values()))


def test_sketch_only_orders(spark):
    """However small the sketch is, no pair is lost."""
    rows = list(enumerate(near_copies()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["id"]: r["root"] for r in similar_sets.similar(docs, width=similar_sets.STRIPE).collect()}
    want = similar_classes([t for _, t in rows])
    assert len({(found[i], want[i]) for i, _ in rows}) == len(set(want)) == len(set(found.values()))
