"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file is turned into the library's form: every byte stands for one printable character, so that a token is a string
of such characters, and a token's merge is the pair that the ranks below its own leave of its bytes. Texts are cut where
white space follows anything else; no match of the pattern lies across such a place, nor does one look across it, so a piece
encodes alike anywhere. The library encodes each distinct piece of a batch once, batched by bytes; results are kept in a
table of bounded size, so a long text is never one huge encoding. A piece without white space stays whole.

Decoding reverses the byte table: ids take their bytes from one Arrow array, whose data buffer then is the decoded text. A
character whose bytes lie in several tokens is whole again once they are joined; `decoded_text` replaces what is no UTF-8 when
ids are cut inside a character. `spans` gives each token's first and past-the-last character; tokens that share a character
overlap in it.

Defined results: a null text is empty and has no tokens; unknown ids raise, null ids decode to null; special strings are
ordinary text; very long texts give the same ids as any; ties cannot arise, as ranks are unique; equal rows each get their row;
an empty table gives an empty one; other columns of any name take no part, as ids come back under the names given here.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velometric.llm.common import WordTable, decoded_texts, packed, slices, text_bytes
from velometric.llm.rank_bpe import byte_letters

#: White space as the pattern's \s has it; Python's has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Characters in one call of the library.
CALL = 1 << 20


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts that merges of ranks below the token's own leave of it; None if they leave others."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def rank_table(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def shown(token: bytes, letters: list[str]) -> str:
    """A token as characters, one for each byte."""
    return "".join([letters[b] for b in token])


class ByteBpe:
    """Encodes with a rank file; `pattern` splits texts before the merges."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, letters = rank_table(rank_file), byte_letters()
        pairs = (merge_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1)
        merges = [(shown(a, letters), shown(b, letters)) for a, b in filter(None, pairs)]
        # A piece that is a token itself is taken whole, as rank files have it.
        model = models.BPE({shown(t, letters): r for t, r in ranks.items()}, merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False),
            ]
        )
        self.ids = WordTable(lambda words: [np.array(e.ids, "<i4").tobytes() for e in self.encodings(words)])
        self.marked = WordTable(
            lambda words: [(np.array(e.ids, "<i4"), np.array(e.offsets, "<i4").reshape(-1, 2)) for e in self.encodings(words, True)]
        )

    def encodings(self, words: list[str], spans: bool = False) -> Iterator:
        """The library's encodings of `words`, called with about CALL characters at a time."""
        encode = self.tokenizer.encode_batch if spans else self.tokenizer.encode_batch_fast
        at = np.cumsum([0, *map(len, words)]) // CALL
        for begin, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(at[1:])) + 1).tolist(), len(words)]):
            yield from encode(words[begin:end], add_special_tokens=False)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Each text's ids."""
        cut = [PIECES.findall(text) for text in texts]
        taken = iter(self.ids.take(list(itertools.chain.from_iterable(cut))))
        rows = [b"".join(itertools.islice(taken, len(words))) for words in cut]
        offsets = np.cumsum([0, *map(len, rows)]) // 4
        values = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, past the last character) of each token."""
        words, at, out = PIECES.findall(text), 0, []
        for word, (ids, offsets) in zip(words, self.marked.take(words), strict=True):
            out += zip(ids.tolist(), *(offsets + at).T.tolist(), strict=True) if len(ids) else []
            at += len(word)
        return out


class ByteTable:
    """The way back: characters to bytes, ids to the bytes of their characters."""

    def __init__(self, rank_file: str) -> None:
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        vocabulary = {shown(token, letters): i for token, i in rank_table(rank_file).items()}
        tokens: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
        for text, i in vocabulary.items():
            tokens[i] = bytes([byte_of[c] for c in text])
        self.tokens = pa.array(tokens, pa.binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Each list's bytes."""
        starts = np.asarray(ids.offsets, dtype=np.int64)
        taken = self.tokens.take(ids.values.slice(starts[0], starts[-1] - starts[0]))
        if taken.null_count:
            raise ValueError("an id without a token")
        where = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1) if len(taken) else np.zeros(1, "<i4")
        offsets = pa.array(where[starts - starts[0]], pa.int32())
        data = taken.buffers()[2] or pa.py_buffer(b"")
        out = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets.buffers()[1], data])
        return out if not ids.null_count else pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.binary()))


@functools.cache
def encoder(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


@functools.cache
def decoder(rank_file: str) -> ByteTable:
    return ByteTable(rank_file)


def encode_function(rank_file: str, pattern: str):
    """Arrow function: texts (binary) to ids."""

    @F.arrow_udf("array<int>")
    def encode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoder(rank_file, pattern)
        for array in (part for whole in arrays for part in slices(whole)):
            yield bpe.encode(decoded_texts(array))

    return encode


def spans_function(rank_file: str, pattern: str):
    """Arrow function: texts (binary) to their tokens with character offsets."""
    kind = pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<id:int,begin:int,end:int>>")
    def spans(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = encoder(rank_file, pattern)
        for array in arrays:
            yield pa.array([[dict(zip(("id", "begin", "end"), s, strict=True)) for s in bpe.spans(t)] for t in decoded_texts(array)], kind)

    return spans


def decode_function(rank_file: str):
    """Arrow function: ids to bytes."""

    @F.arrow_udf("binary")
    def decode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = decoder(rank_file)
        for array in (part for whole in arrays for part in slices(whole, 1 << 19)):
            yield table.decode(array)

    return decode


def decoded_text(column: str) -> Column:
    """Decoded bytes as text, with U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def token_spans(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and `tokens`, each with its id and its characters [begin, end)."""
    rows = packed(docs.select(id_col, text_col))
    return rows.select(
        F.col(f"row.`{id_col}`").alias(id_col), spans_function(rank_file, pattern)(text_bytes(text_col)).alias("tokens")
    )


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, `n_tokens`, `ids` and the bytes `decoded` from those ids."""
    rows = packed(docs.select(id_col, text_col))
    rows = rows.select(
        F.col(f"row.`{id_col}`").alias(id_col), encode_function(rank_file, pattern)(text_bytes(text_col)).alias("ids")
    )
    return rows.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        decode_function(rank_file)("ids").alias("decoded"),
    )


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `round_trip`."""
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
