"""Ranked search, spelling variants and byte-level BPE against plain versions, over the given table and over odd rows."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from velometric.llm import byte_bpe, oracle, spelling, strata_rank

FOLDER = f"{os.environ.get('TESTDATA_ROOT', '/root/testdata')}/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["given", "odd", "none"])
def docs(request, spark, odd_docs, no_docs):
    return {"given": spark.read.parquet(f"{FOLDER}/documents.parquet"), "odd": odd_docs, "none": no_docs}[request.param]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs, items, top=50):
    terms = [Counter(TERM.findall(low(t))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    count, length = sum(n > 0 for n in sizes), sum(sizes)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall(low(text)))
    holding = Counter(t for c in terms for t in c)
    out = []
    for item, words in asked.items():
        found = []
        for (doc, _), c, n in zip(docs, terms, sizes, strict=True):
            m = 50 + 50 * n * count // max(1, length)
            score = 0
            for t in words & c.keys():
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * holding[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, i + 1, doc, -score) for i, (score, _, _, doc) in enumerate(found[:top])]
    return Counter(out)


def test_ranking(spark, docs):
    asked = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    odd = [(900, "one WORD3 of7 line with words"), (900, "cat password"), (901, None), (902, "..."), (None, "the mat é x12"), (903, "x" * 3000)]
    items = spark.createDataFrame(asked + odd, "item_id long, text string")
    got = Counter(map(tuple, strata_rank.digest(strata_rank.search(docs, items)).collect()))
    assert got == ranking([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], asked + odd)


@pytest.mark.parametrize("block_terms, index", [(30, 1 << 22), (10**6, 200)])
def test_ranking_in_blocks(spark, monkeypatch, block_terms, index):
    """Several blocks of items, and several indexes a task, give the same ranking; ties go to the smaller id."""
    monkeypatch.setattr(strata_rank.search_function, "__defaults__", (index,))
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 60)))) for i in rng.permutation(600)]
    docs += [(1000 + i, "a b c d") for i in range(300)]
    items = [(i, " ".join(rng.choice(list("abcdefghz"), 5))) for i in range(40)]
    tables = [spark.createDataFrame(rows, f"{name} long, text string").repartition(3) for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = Counter(map(tuple, strata_rank.digest(strata_rank.search(*tables, block_terms=block_terms)).collect()))
    assert got == ranking(docs, items)


def test_strata_are_skipped():
    """Of documents of very different lengths only the strata whose bound can reach the top are visited."""
    m = np.arange(50, 1050)
    index = strata_rank.Stratified(m, np.ones(1000, int), np.zeros(1000, int), np.ones(1000, int))
    best = strata_rank.Best(10)
    visited = strata_rank.visit(index, np.arange(1000), np.zeros(1000, bool), np.array([0]), np.array([3]), best)
    assert visited < 40 and best.id.tolist() == list(range(10))
    assert best.score.tolist() == [3 * (10**9 // (1000 + 20 * x)) for x in range(50, 60)]


def test_ranking_sql_and_columns(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    want = Counter(con.execute(oracle.ORACLE["op11_strata_rank"]).fetchall())
    docs, items = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "benchmark"))
    assert Counter(map(tuple, strata_rank.digest(strata_rank.search(docs, items)).collect())) == want


# Spelling variants


def variants(docs, least=5):
    counts = Counter()
    for doc, text in docs:
        for run, n in Counter(map(low, re.findall(r"[A-Za-zÀ-ÿ]+", text or ""))).items():
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run if h % 199 else run[:at] + run[at + 1 :]] += n
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (a, b), group in cut.items():
        for w in group:
            near[w] |= group - {w}
            if a + b in words:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def given_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_spelling(docs):
    rows = spelling.spelling_variants(docs)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = rows.collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == variants(given_rows(docs))


@pytest.mark.parametrize("block, tile", [(4, 8), (64, 16), (100_000, 40), (100_000, 1 << 20)])
def test_spelling_blocks_and_tiles(spark, block, tile):
    """Words close to each other, shared endings, letters past ASCII and very long words, whatever the blocks."""
    rng = np.random.default_rng(6)
    letters = list("abcéÿ×")
    words = ["".join(rng.choice(letters, rng.integers(6, 9))) for _ in range(300)]
    words += ["".join(rng.choice(letters, 4)) + "ending" for _ in range(150)]
    words += ["z" * 5000, "z" * 5001, "z" * 4000 + "y" + "z" * 1000, "zy" * 2500, "Zy" * 2500 + "a"]
    rows = [(i, " ".join([w] * int(rng.choice([5, 8, 60, 400])))) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.spelling_variants(docs, block=block, tile=tile).collect()
    want = variants(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert sum(r["form"] is not None for r in got) > 20


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}" if i < 20 else None) for i in range(21)]
    found = spark.createDataFrame(chain, "word string, form string")
    assert {tuple(r) for r in spelling.roots(found).collect()} == {(w, "w20") for w, f in chain if f}


# Byte-level BPE


def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs):
    encoding, want = library(), Counter()
    for doc, text in given_rows(docs):
        ids = encoding.encode_ordinary(text or "")
        listed, decoded = " ".join(map(str, ids)), encoding.decode_bytes(ids)
        want[doc, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.digest(byte_bpe.round_trip(docs, RANKS, PATTERN)).collect())) == want


def test_byte_bpe_code_points():
    """Every code point beside letters, digits, symbols and white space, where texts are cut and where not."""
    encoding, bpe = library(), byte_bpe.ByteBpe(RANKS, PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Assigned ranges densely, the rest of the planes sparsely.
    points = [c for c in points if c < 0x3000 or c % 17 == 0]
    for begin in range(0, len(points), 2000):
        texts = [f"ab{c}cd 1{c}2 {c}!  {c}a{c}{c} \n{c}" for c in map(chr, points[begin : begin + 2000])]
        assert bpe.encode(texts).to_pylist() == encoding.encode_ordinary_batch(texts, num_threads=1)


def test_byte_bpe_spans_and_split_characters(spark):
    encoding, bpe = library(), byte_bpe.ByteBpe(RANKS, PATTERN)
    text = "Héllo 😀 wörld  \n\t x" + "𝒳" * 5 + " end"
    spans = bpe.spans(text)
    assert [i for i, _, _ in spans] == encoding.encode_ordinary(text)
    for i, begin, end in spans:
        assert encoding.decode_single_token_bytes(i) in text[begin:end].encode()
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: [tuple(t) for t in r["tokens"]] for r in byte_bpe.token_spans(docs, RANKS, PATTERN).collect()}
    assert rows == {1: spans, 2: []}
    # Ids cut inside a character: the bytes stay, their text has a replacement mark; null ids stay null.
    ids = encoding.encode_ordinary("😀")
    cut = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "at long, ids array<int>").coalesce(1)
    cut = cut.select("at", byte_bpe.decode_function(RANKS)("ids").alias("data"))
    found = {r["at"]: (r["data"], r["shown"]) for r in cut.select("at", "data", byte_bpe.decoded_text("data").alias("shown")).collect()}
    first = encoding.decode_bytes(ids[:1])
    want = {1: ("😀".encode(), "😀"), 2: (first, first.decode("utf-8", "replace")), 3: (b"", ""), 4: (None, None)}
    assert {k: (None if d is None else bytes(d), s) for k, (d, s) in found.items()} == want


def test_merge_pairs_follow_ranks():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4, b"bc": 5, b"abab": 6, b"ca": 9, b"bca": 8}
    assert byte_bpe.merge_pair(b"abc", ranks) == (b"ab", b"c")
    assert byte_bpe.merge_pair(b"abab", ranks) == (b"ab", b"ab")
    assert byte_bpe.merge_pair(b"bca", ranks) == (b"bc", b"a")
