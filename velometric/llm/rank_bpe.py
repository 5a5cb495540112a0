"""BPE encoding and decoding with a contiguous rank array per word.

A word starts as one part per byte. Two short lists lie side by side: the parts (their boundaries are the list's
positions) and the merge rank of each adjacent pair. The least rank is found by scanning, its boundary is deleted, and
the two neighbouring ranks are refreshed, until no pair has a rank. Short words stay in a cache line, so the scan beats a
heap; words over LONG_WORD bytes use a heap over a linked list, which merges in the same order and is not quadratic.

The vocabulary file gives merges, special tokens and the word pattern; the normal form is NFC, white space to one space,
lower case. Word results are memoised per worker in a table of bounded size that is emptied when full.

Defined results: a null text is empty and has no tokens; ids are packed as little-endian unsigned 32-bit integers; equal
rows each get their row; an empty table gives an empty one; other columns are not read, whatever their names. A text with a
code point that Python's Unicode tables have not assigned is brought to normal form and cut into words by the tokenizers
library itself, as its tables may be newer; its words are merged like any others.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers
from tokenizers.normalizers import NFC

from velometric.llm.common import packed, slices, text_bytes

LONG_WORD = 256
CODE_POINTS = 0x110000
CACHE_WORDS = 150_000
NO_RANK = 1 << 30


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for place, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + place)
    return [letters[b] for b in range(256)]


def unassigned(first: int = 0, last: int = CODE_POINTS) -> str:
    """Class members, as a pattern has them, of the code points that Python's Unicode tables do not know."""
    known = itertools.groupby(range(first, last), key=lambda c: unicodedata.category(chr(c)) == "Cn")
    runs = [list(run) for odd, run in known if odd]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


class WordBpe:
    """Encodes and decodes with one vocabulary file; `vocabulary` is its path."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.pieces = {i: piece for piece, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: piece for piece, i in self.special.items()}
        pattern = next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.word = regex.compile(pattern, regex.V0)
        # Ranges above the first plane are tried one by one, so texts without any such code point are told apart first.
        self.maybe_newer = re.compile(f"[{unassigned(last=0x10000)}\\U00010000-\\U0010ffff]")
        self.newer = re.compile(f"[{unassigned()}]")
        self.library_form = normalizers.Sequence([NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.library_words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # Rank of a pair of ids, packed in one integer, and what the pair of each rank becomes.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(ids[left] << 32 | ids[right], rank)
            self.merged.append(ids[left + right])
        letters = byte_letters()
        self.inner = [ids.get(x) for x in letters]
        self.last = [ids.get(x + suffix) for x in letters]
        self.form = NFC()
        self.cache: dict[str, bytes] = {}

    def parts(self, word: str) -> list[int]:
        data = word.encode()
        first = [*(self.inner[b] for b in data[:-1]), self.last[data[-1]]]
        return [x for x in first if x is not None]

    def merge_short(self, parts: list[int]) -> list[int]:
        """Merges in place; `ranks[i]` is the rank of parts i and i + 1, the least is taken leftmost."""
        known, merged = self.ranks.get, self.merged
        ranks = [known(a << 32 | b, NO_RANK) for a, b in itertools.pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            new = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = known(parts[i - 1] << 32 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = known(new << 32 | parts[i + 1], NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges from a heap of (rank, place, left, right); entries whose parts changed are passed over."""
        count = len(parts)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i < 0 or after[i] >= count:
                return
            rank = self.ranks.get(parts[i] << 32 | parts[after[i]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[after[i]]))

        for i in range(count - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else count
            if j >= count or parts[j] != right:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] < count:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in parts if x >= 0]

    def word_ids(self, word: str) -> bytes:
        parts = self.parts(word)
        merged = self.merge_short(parts) if len(parts) <= LONG_WORD else self.merge_long(parts)
        packed_ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(word) <= LONG_WORD:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = packed_ids
        return packed_ids

    def words(self, text: str) -> list[str]:
        if not text.isascii() and self.maybe_newer.search(text) and self.newer.search(text):
            return [w for w, _ in self.library_words.pre_tokenize_str(self.library_form.normalize_str(text))]
        # The library's NFC, as its Unicode tables may be older than Python's; most texts are in that form already.
        if not unicodedata.is_normalized("NFC", text):
            text = self.form.normalize_str(text)
        # Lower case is taken letter by letter, so a sigma at a word's end is like any other.
        text = text.replace("Σ", "σ").lower()
        return self.word.findall(text)

    def plain_ids(self, text: str) -> bytes:
        known, make = self.cache.get, self.word_ids
        return b"".join([known(w) or make(w) for w in self.words(text)])

    def encode(self, text: str) -> bytes:
        """Packed ids; special strings in the text become their token."""
        out, at = [], 0
        for hit in self.cut.finditer(text):
            out.append(self.plain_ids(text[at : hit.start()]))
            out.append(self.special[hit.group()].to_bytes(4, "little"))
            at = hit.end()
        out.append(self.plain_ids(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Pieces joined by one space, as the library does for a file without a decoder."""
        pieces = self.pieces
        return " ".join([pieces[i] for i in memoryview(ids).cast("I") if i in pieces])


_LOADED: dict[str, WordBpe] = {}


def loaded(vocabulary: str) -> WordBpe:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = WordBpe(vocabulary)
    return _LOADED[vocabulary]


def encode_function(vocabulary: str):
    """Arrow function: texts (binary) to packed ids."""

    @F.arrow_udf("binary")
    def encode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(vocabulary)
        for array in (part for whole in arrays for part in slices(whole)):
            texts = (x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in array)
            yield pa.array([bpe.encode(t) for t in texts], pa.binary())

    return encode


def decode_function(vocabulary: str):
    """Arrow function: packed ids to texts; null ids give null."""

    @F.arrow_udf("string")
    def decode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(vocabulary)
        for array in (part for whole in arrays for part in slices(whole)):
            ids = (x.as_buffer().to_pybytes() if x.is_valid else None for x in array)
            yield pa.array([None if x is None else bpe.decode(x) for x in ids], pa.string())

    return decode


def encode_rows(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """`row` and its packed `ids`."""
    return packed(docs).select("row", encode_function(vocabulary)(text_bytes(text_col)).alias("ids"))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, `n_tokens`, packed `ids` and the text `decoded` from those ids."""
    rows = encode_rows(docs.select(id_col, text_col), vocabulary, text_col)
    return rows.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        decode_function(vocabulary)("ids").alias("decoded"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `round_trip`."""
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
