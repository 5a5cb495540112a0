"""Quality rules whose cutoffs come from the corpus: quantile sketches per language and source.

Features are counted once per text in an Arrow function. A sketch is a histogram over log-linear buckets (values below
1024 exactly, above it to ten bits, so within 0.2 %); sketches merge by adding counts, in any order, to the same result.
A fence lies SPREADS upper spreads above the group's median, the spread being the third quartile less the median, so it widens
where a source's own habit is wide and junk in the upper quarter does not move it; word length has a lower fence likewise. A
spread is at least a bucket's width. Repetition (lines, words) is absent from most texts of any group and common in some clean
ones, so its fences come from the texts that have any, with an eighth of their median as least spread.

A group's fence is averaged with its language's, and that with the corpus's, weighing as its number of texts against PRIOR, so
small groups lean on large ones without a switch. Fences are a table of one row per group, joined to the features by language
and source.

Defined results: a null text has no words and fails the base rules; null languages and sources form groups of their own;
equal rows are judged alike and all returned; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from velometric.llm.common import WHITE, packed, text_bytes, written

SYMBOLS = "#*$%&|<>"
#: Features. Shares are per mille, word length in hundredths.
RULES = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "word_length"]
SPREADS = 12
#: Features whose quantiles are those of the texts that have any.
REPETITION = {"dup_line_share", "repeat_share"}
#: Features that can also be too small.
TWO_SIDED = {"word_length"}
#: Texts that the fence of the wider group weighs.
PRIOR = 10
MIN_WORDS = 50

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
_TYPE = StructType([StructField(c, LongType()) for c in _COUNTS])
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_WHITE = WHITE.encode()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def counts_of(data: bytes) -> tuple[int, ...]:
    words = data.split()
    text = data.decode("utf-8", "replace")
    lines = [line for line in data.split(b"\n") if line.strip(_WHITE)]
    upper = len(data) - len(data.translate(None, _UPPER))
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + len(data) - len(data.translate(None, _LOWER)),
    )


@F.arrow_udf(_TYPE)
def text_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [counts_of(x.as_buffer().to_pybytes()) for x in batch]
        columns = zip(*rows, strict=True) if rows else [[]] * len(_COUNTS)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COUNTS)


# Called so, Spark neither pushes a filter on the counts below the projection nor copies the call into it: texts are counted
# once a pass. The counts themselves depend on the text alone.
text_counts = text_counts.asNondeterministic()


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("long")


def shares(counts: DataFrame) -> DataFrame:
    """The rules' features beside the counts."""
    return counts.select(
        "*",
        _share("n_symbols", "word_chars").alias("symbol_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
        _share("n_upper", "n_letters").alias("upper_share"),
        F.when(F.col("n_words") > 0, F.floor(100 * F.col("word_chars") / F.col("n_words")))
        .otherwise(0).cast("long").alias("word_length"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The least value of the bucket: exact below 1024, ten leading bits above."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 10, F.lit(0)))
    return (F.floor(value / step) * step).cast("long")


def sketches(features: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable sketches: (groups, rule, bucket) -> texts; summing them merges. Repetition leaves out texts without any."""
    long = features.select(
        *groups,
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in RULES])
        ).alias("entry"),
    )
    voting = ~F.col("entry.rule").isin(sorted(REPETITION)) | (F.col("entry.bucket") > 0)
    return long.where(voting).groupBy(*groups, "entry.rule", "entry.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and rule: texts and quartiles, each the least bucket that reaches the rank."""
    by = [*groups, "rule"]
    entries = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    each = sketch.groupBy(*by).agg(entries.alias("entries"), F.sum("n").alias("total"))

    def at(share: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))

        def step(state: Column, entry: Column) -> Column:
            seen = state["seen"] + entry["n"]
            hit = F.when(state["value"].isNull() & (seen >= share * F.col("total")), entry["bucket"])
            return F.struct(seen.alias("seen"), F.coalesce(state["value"], hit).alias("value"))

        return F.aggregate("entries", start, step, lambda state: state["value"])

    return each.select(*by, "total", at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))


def level_fences(table: DataFrame) -> DataFrame:
    """A level's own fences from its quartiles."""
    least = F.when(F.col("rule").isin(sorted(REPETITION)), F.greatest(F.lit(1), F.floor(F.col("q50") / 8))).otherwise(1)
    return table.withColumns(
        {
            "upper": F.col("q50") + SPREADS * F.greatest(F.col("q75") - F.col("q50"), least),
            "lower": F.col("q50") - SPREADS * F.greatest(F.col("q50") - F.col("q25"), least),
        }
    )


def fences(features: DataFrame) -> DataFrame:
    """One row per (lang, source): `upper_<rule>` and, where two-sided, `lower_<rule>`.

    Base-failed texts do not vote. The group's sketches merge into the language's and those into the corpus's, so the
    corpus is counted once.
    """
    groups = ["lang", "source"]
    fine = sketches(features.where(~base_failed()), groups)
    levels = [groups, ["lang"], []]
    tables = []
    for level in levels:
        merged = fine if level == groups else fine.groupBy(*level, "rule", "bucket").agg(F.sum("n").alias("n"))
        tables.append(level_fences(quantiles(merged, level)))
    own, language, corpus = tables
    keys = features.select(*groups).distinct().withColumn("rule", F.explode(F.array(*[F.lit(r) for r in RULES])))

    def same(left: str, right: str, columns: list[str]) -> Column:
        out = F.lit(True)
        for c in columns:
            out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return out

    picked = (
        keys.alias("k")
        .join(own.alias("a"), same("k", "a", [*groups, "rule"]), "left")
        .join(language.alias("b"), same("k", "b", ["lang", "rule"]), "left")
        .join(corpus.alias("c"), same("k", "c", ["rule"]), "left")
    )

    def blended(side: str) -> Column:
        wide = F.col(f"c.{side}")
        for level in ("b", "a"):
            total, own = F.col(f"{level}.total"), F.col(f"{level}.{side}")
            wide = F.coalesce(F.call_function("div", total * own + PRIOR * wide, total + PRIOR), wide)
        return wide.alias(side)

    long = picked.select("k.lang", "k.source", "k.rule", blended("upper"), blended("lower"))
    at = lambda rule, side: F.max(F.when(F.col("rule") == rule, F.col(side)))
    return long.groupBy(*groups).agg(
        *[at(r, "upper").alias(f"upper_{r}") for r in RULES], *[at(r, "lower").alias(f"lower_{r}") for r in TWO_SIDED]
    )


def within() -> Column:
    """The method's verdict; a fence nobody voted for does not judge."""
    ok = F.lit(True)
    for rule in RULES:
        ok = ok & F.coalesce(F.col(rule) <= F.col(f"upper_{rule}"), F.lit(True))
        if rule in TWO_SIDED:
            ok = ok & F.coalesce(F.col(rule) >= F.col(f"lower_{rule}"), F.lit(True))
    return ok


def measured(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """`row`, `lang`, `source`, the counts and the features."""
    rows = packed(docs).select(
        "row",
        F.col(f"row.`{lang_col}`").cast("string").alias("lang"),
        F.col(f"row.`{source_col}`").cast("string").alias("source"),
        text_counts(text_bytes(text_col)).alias("counts"),
    )
    return shares(rows.select("row", "lang", "source", "counts.*"))


def judged(features: DataFrame) -> DataFrame:
    """Features with `base_failed` and `kept`.

    The fences are written first, so Spark knows their size: small, they are broadcast; large, both sides are shuffled
    and adaptive execution splits a hot source.
    """
    limits = written(fences(features), "quality-fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    failed = base_failed()
    return features.join(limits, same, "left").select(
        "*", failed.alias("base_failed"), (~failed & within()).alias("kept")
    )


def quality_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per input row: id, the counts, the features, `base_failed` and `kept`. Texts are read once."""
    features = measured(docs, text_col, lang_col, source_col).select(
        F.col(f"row.`{id_col}`").alias(id_col), "lang", "source", *_COUNTS, *RULES
    )
    return judged(written(features, "quality-features"))


def quality_filter(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The rows of `docs` that the rules keep, unchanged."""
    return judged(measured(docs, text_col, lang_col, source_col)).where("kept").select("row.*")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `quality_report`."""
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
