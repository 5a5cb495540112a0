"""Token counts: batch encoding in an Arrow function that returns lengths only.

Within a task, texts are cut into pieces of at most PIECE characters at white space, where no token of the vocabulary
can lie across, and the pieces are taken in batches of about BATCH_BYTES bytes, so a very long text neither makes one
huge encoding nor shares a batch with thousands of others. Of a batch the library encodes each distinct word (what lies
between ASCII white space) once; its length is kept for later batches in a table that is emptied when full. Only the numbers
leave Python.

Defined results: a null text is empty and has no tokens; very long texts count whole, a word without white space is never cut;
no order matters, so ties do not arise; equal rows each get their row; other columns of any name are packed away; an empty
table gives an empty one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from velometric.llm.common import WordTable, decoded_texts, packed, slices, text_bytes

PIECE = 32_768
BATCH_BYTES = 1 << 20
LIMIT = 2048
_SPACE = re.compile(r"[ \t\n\v\f\r]")


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """`text` in pieces cut after ASCII white space; a longer run without any stays whole."""
    begin = 0
    while len(text) - begin > most:
        cut = max(text.rfind(c, begin, begin + most) for c in " \t\n\v\f\r")
        if cut < begin:
            found = _SPACE.search(text, begin + most)
            if not found:
                break
            cut = found.start()
        yield text[begin : cut + 1]
        begin = cut + 1
    yield text[begin:]


def batches(texts: Iterator[tuple[int, str]], most: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(row, piece) in lists of about `most` bytes."""
    held, size = [], 0
    for row, text in texts:
        held.append((row, text))
        size += len(text.encode()) if not text.isascii() else len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def length_function(tokenizer_path: str):
    """An Arrow function from texts (binary) to token counts. The tokenizer is loaded once per worker."""

    @F.arrow_udf(LongType())
    def lengths(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def measured(words: list[bytes]) -> list[int]:
            return [len(e) for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

        table = WordTable(measured)
        for array in (part for whole in arrays for part in slices(whole)):
            counts = np.zeros(len(array), dtype=np.int64)
            cut = ((row, piece) for row, text in enumerate(decoded_texts(array)) for piece in pieces(text))
            for batch in batches(cut):
                words = [piece.encode().split() for _, piece in batch]
                taken = np.array([0, *table.take(list(itertools.chain.from_iterable(words)))], dtype=np.int64).cumsum()
                ends = np.cumsum([0, *map(len, words)])
                np.add.at(counts, [row for row, _ in batch], np.diff(taken[ends]))
            yield pa.array(counts)

    return lengths


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per input row: id, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (more tokens than `limit`)."""
    body = text_bytes(text_col)
    rows = packed(docs).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        F.octet_length(body).cast("long").alias("n_bytes"),
        length_function(tokenizer_path)(body).alias("n_tokens"),
    )
    return rows.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
