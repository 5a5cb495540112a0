"""Secrets in texts, told apart by how many owners and repositories hold the same value.

Spans come from patterns, natively: `regexp_extract_all` gives the hits, `split` by the same pattern the gaps between
them, and a running sum over both gives positions in code points. Values are hashed; a hash is counted over the whole
corpus by distinct owners and repositories. A live-looking value held by few owners is a likely credential, one that
many owners hold is a copied example. Opaque tokens, which no pattern names, become spans only when they are
owner-specific.

Defined results: a null text is empty; a null owner or repository counts as one of its own; equal rows each get their
row; an empty table gives an empty one. Nothing is joined or grouped by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velometric.llm.common import packed, whole_text, written

#: Fixed values of the contract: kind, pattern, group holding the value, least characters of that group.
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Runs too long for a word; only those that hold letters and digits and belong to few owners become spans.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
KINDS = [*BASE_KINDS, OPAQUE]
#: Parts into which a value held by very many rows is split for its join.
SALTS = 16
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _hits(text: Column, kind: int) -> Column:
    return F.regexp_extract_all(text, F.lit(KINDS[kind][1]), F.lit(0))


def _spans(text: Column, hits: Column, kind: int) -> Column:
    """Hits long enough, with their place. Gaps and hits alternate, so one pass over the hits places them all."""
    _, pattern, group, least = KINDS[kind]
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.char_length).alias("gap"),
        hits.alias("hit"),
    )

    def step(state: Column, item: Column) -> Column:
        begin = state["at"] + item["gap"]
        end = begin + F.char_length(item["hit"])
        value = F.regexp_extract(item["hit"], pattern, group) if group else item["hit"]
        found = F.array(
            F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        )
        keep = F.char_length(value) >= least
        return F.struct(
            end.alias("at"),
            F.when(keep, F.concat(state["spans"], found)).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    placed = F.aggregate(steps, start, step, lambda state: state["spans"])
    return F.when(F.size(hits) > 0, placed).otherwise(F.array().cast(SPAN))


def _live(value: Column) -> Column:
    """Letters and digits, and at least eight different characters."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    text = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_spans(docs: DataFrame, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """`row` with `key` (equal rows share it), `owner`, `repo` and its `spans` (those of OPAQUE not inside others)."""
    marked = packed(docs, keep_key=True).select(
        "row",
        "key",
        whole_text(text_col).alias("body"),
        F.struct(F.col(f"row.`{owner_col}`").cast("string").alias("owner")).alias("owner"),
        F.struct(
            F.col(f"row.`{owner_col}`").cast("string").alias("owner"), F.col(f"row.`{repo_col}`").cast("string").alias("repo")
        ).alias("repo"),
    )
    hit = marked.select("*", *[_hits(F.col("body"), k).alias(f"hits{k}") for k in range(len(KINDS))])
    cut = hit.select(
        "row", "key", "owner", "repo",
        F.concat(*[_spans(F.col("body"), F.col(f"hits{k}"), k) for k in range(len(BASE_KINDS))]).alias("base"),
        _spans(F.col("body"), F.col(f"hits{len(BASE_KINDS)}"), len(BASE_KINDS)).alias("opaque"),
    )
    free = F.filter(
        "opaque",
        lambda o: _live(o["value"])
        & ~F.exists("base", lambda b: (o["start"] < b["end"]) & (b["start"] < o["end"])),
    )
    return cut.select(
        "row", "key", "owner", "repo", "base",
        F.concat("base", F.when(F.size("opaque") > 0, free).otherwise(F.array().cast(SPAN))).alias("spans"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """One row per value hash: distinct owners and repositories. Each step combines on the map side first."""
    each = found.select("owner", "repo", F.explode("spans").alias("span"))
    each = each.select("owner", "repo", F.sha2("span.value", 256).alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("copies"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("copies").alias("copies"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("copies").alias("n_copies")
    )


def judged_spans(found: DataFrame, carried: list[str], max_owners: int) -> DataFrame:
    """`found` one row per key, with `judged`: its spans and what the corpus says of their values.

    `found` holds `key`, `spans`, `owner`, `repo` and the columns `carried`; rows of one key are equal and counted in
    `copies`. The join with the hash counts is salted, so a value that a third of all rows hold goes to many tasks.
    """
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    counts = ownership(found).select("*", F.explode(salts).alias("salt"))
    each = found.select("key", *carried, F.posexplode_outer("spans").alias("pos", "span")).select(
        "key", *carried, "pos", "span",
        F.sha2("span.value", 256).alias("hash"),
        F.pmod(F.col("key.low"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    live = _live(F.col("span.value"))
    owned = F.col("n_owners") <= max_owners
    told = each.join(counts, ["hash", "salt"], "left").select(
        "key", *carried, "pos",
        F.when(
            F.col("span").isNotNull() & ((F.col("span.kind") < len(BASE_KINDS)) | owned),
            F.struct(
                F.col("span.start").alias("start"), F.col("span.kind").alias("kind"), F.col("span.end").alias("end"),
                "hash", "n_owners", "n_repos", "n_copies", (live & owned).alias("is_live"), (~owned).alias("is_copied"),
            ),
        ).alias("judged"),
    )
    # Equal rows repeat every span; the set holds each once, and the first span (or its absence) counts the rows.
    return told.groupBy("key").agg(
        *[F.first(c).alias(c) for c in carried],
        F.array_sort(F.collect_set("judged")).alias("judged"),
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "lang",
    max_owners: int = 3,
) -> DataFrame:
    """One row per input row: the id, counts by kind, the spans and what the corpus says of each value.

    `base` are the spans of the three named kinds; `judged` holds all spans with their hash, `n_owners`, `n_repos`
    (repositories are told apart within their owner), `n_copies`, `is_live` (live-looking and held by at most
    `max_owners` owners) and `is_copied`.
    """
    found = find_spans(docs, text_col, owner_col, repo_col).select(
        "key", "owner", "repo", "spans", F.col(f"row.`{id_col}`").alias("id"),
        *[_count("base", k).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE_KINDS))],
        _joined(F.col("base")).alias("base"),
    )
    counted = [f"n_{k[0]}" for k in BASE_KINDS]
    rows = judged_spans(found, ["id", *counted, "base"], max_owners)
    return rows.select(
        F.col("id").alias(id_col), *counted, "base", "judged",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from `scan_secrets`."""
    return rows.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        _joined(F.col("judged")).alias("spans"),
        F.size("judged").cast("long").alias("n_spans"),
        F.size(F.filter("judged", lambda s: s["is_live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: s["is_copied"])).cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.transform("judged", lambda s: s["n_owners"])), F.lit(0)).alias("max_owners"),
        F.coalesce(F.array_max(F.transform("judged", lambda s: s["n_repos"])), F.lit(0)).alias("max_repos"),
    )


def mask_secrets(
    docs: DataFrame,
    text_col: str = "text",
    length_col: str | None = "n_chars",
    owner_col: str = "source",
    repo_col: str = "lang",
    max_owners: int = 3,
    mask: str = "<secret>",
) -> DataFrame:
    """`docs` with every live span replaced by `mask`; copied examples and clean rows stay as they are.

    Patterns run twice over the texts: once to set the rows with a span aside, which alone are shuffled, and once to let
    the others pass from the scan. `length_col`, if present, follows the new text.
    """
    found = find_spans(docs, text_col, owner_col, repo_col)
    clean = found.where(F.size("spans") == 0).select("row.*")
    held = written(found.where(F.size("spans") > 0).select("key", "row", "owner", "repo", "spans"), "secret-rows")
    judged = judged_spans(held.select("key", "owner", "repo", "spans"), [], max_owners)
    held = held.select("key", "row", whole_text(text_col).alias("body")).join(judged.select("key", "judged"), "key")
    held = held.select("row", "body", F.filter("judged", lambda s: s["is_live"]).alias("live"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("body"), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(span["end"], state["at"]).alias("at"),
            F.when(span["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mask)))
            .otherwise(state["out"])
            .alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    held = held.select("*", F.aggregate("live", start, step).alias("done"))
    tail = F.substring(F.col("body"), F.col("done.at") + 1, F.char_length("body"))
    old = F.col(f"row.`{text_col}`")
    held = held.select("row", "live", F.when(F.size("live") > 0, F.concat("done.out", tail)).otherwise(old).alias("new"))
    changed = {text_col: F.col("new")}
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        changed[length_col] = F.when(F.size("live") > 0, F.char_length("new").cast(kind)).otherwise(
            F.col(f"row.`{length_col}`")
        )
    return clean.unionByName(held.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
