"""Equivalent SQL of the queries that SQL can express; the others are held against plain versions in the tests."""

from __future__ import annotations

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 1, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("opaque", "[A-Za-z0-9+/_-]{24,}", 0, 24),
]


def _secrets() -> str:
    def found(kind: int) -> str:
        name, pattern, group, least = KINDS[kind]
        value = f"regexp_extract(hits[i], '{pattern}', {group})" if group else "hits[i]"
        return f"""select * from (select doc_id, owner, lang, s as start, {kind} as k, '{name}' as kind,
          s + length(hits[i]) as stop, {value} as value from (
            select *, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::bigint as s from (
              select *, unnest(range(1, len(hits) + 1)) as i from (
                select *, regexp_extract_all(text, '{pattern}') as hits, string_split_regex(text, '{pattern}') as gaps from d)))
          ) where length(value) >= {least}"""

    live = "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 8"
    return f"""with d as (select doc_id, coalesce(text, '') as text, coalesce('s' || source, '') as owner, coalesce('l' || lang, '') as lang from documents),
    base as ({' union all '.join(found(k) for k in range(3))}),
    opaque as (select * from ({found(3)}) o where {live}
      and not exists (select 1 from base b where b.doc_id = o.doc_id and o.start < b.stop and b.start < o.stop)),
    candidates as (select *, {live} as live from (select * from base union all select * from opaque)),
    counted as (select value, count(distinct owner) as owners, count(distinct owner || chr(1) || lang) as repos from candidates group by value),
    judged as (select * from candidates join counted using (value) where k < 3 or owners <= 3),
    per_doc as (select doc_id, count(*) as n_spans, count(*) filter (where live and owners <= 3) as n_live,
      count(*) filter (where owners > 3) as n_copied, max(owners) as max_owners, max(repos) as max_repos,
      string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans from judged group by doc_id),
    per_base as (select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
      count(*) filter (where k = 2) as n_hex, string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) as spans
      from base group by doc_id)
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(b.spans, '')) as base_sha256, coalesce(p.spans, '') as spans, coalesce(n_spans, 0) as n_spans,
      coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(max_owners, 0) as max_owners,
      coalesce(max_repos, 0) as max_repos
    from d left join per_base b on d.doc_id = b.doc_id left join per_doc p on d.doc_id = p.doc_id"""


def _quality() -> str:
    rules = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "word_length"]
    stacked = " union all ".join(
        f"select lang, source, '{r}' as rule, case when {r} < 1024 then {r} else "
        f"(({r} // (1::bigint << (length(bin({r})) - 10)::integer)) * (1::bigint << (length(bin({r})) - 10)::integer)) end as bucket "
        f"from shares where not base_failed{f' and {r} > 0' if r in ('dup_line_share', 'repeat_share') else ''}"
        for r in rules
    )

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, rule" if keys else "rule"
        at = lambda q: f"min(bucket) filter (where seen >= {q} * total)"
        return f"""{name} as (select *, q50 + 12 * greatest(q75 - q50, least) as upper, q50 - 12 * greatest(q50 - q25, least) as lower from (
          select *, case when rule in ('dup_line_share', 'repeat_share') then greatest(1, q50 // 8) else 1 end as least from (
          select {by}, any_value(total)::bigint as total, {at('0.25')} as q25, {at('0.5')} as q50, {at('0.75')} as q75 from (
          select *, sum(n) over (partition by {by} order by bucket) as seen, sum(n) over (partition by {by}) as total from (
            select {by}, bucket, count(*) as n from stacked group by {by}, bucket)) group by {by})))"""

    def blended(side: str) -> str:
        language = f"coalesce((b.total * b.{side} + 10 * c.{side}) // (b.total + 10), c.{side})"
        return f"coalesce((a.total * a.{side} + 10 * {language}) // (a.total + 10), {language}) as {side}"

    fits = " and ".join(
        f"coalesce(bool_and({r} <= upper) filter (where rule = '{r}'), true)"
        + (f" and coalesce(bool_and({r} >= lower) filter (where rule = '{r}'), true)" if r == "word_length" else "")
        for r in rules
    )
    return rf"""with d as (select doc_id, coalesce(text, '') as text, lang, source from documents),
    w as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from (select doc_id, {WORDS} as words from d)),
    windows as (select * from (select doc_id, i, word || chr(32) || lead(word) over o || chr(32) || lead(word, 2) over o as win
      from w window o as (partition by doc_id order by i)) where win is not null),
    again as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from windows) where n > 1),
    covered as (select doc_id, count(distinct i + j) as n_repeat_words from again cross join (values (0), (1), (2)) o(j) group by doc_id),
    lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (
      select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
    counts as (select doc_id, lang, source, len({WORDS}) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
      coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
      length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters
      from d left join covered using (doc_id) left join lines using (doc_id)),
    shares as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
      case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbol_share,
      case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_line_share,
      case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeat_share,
      case when n_letters > 0 then 1000 * n_upper // n_letters else 0 end as upper_share,
      case when n_words > 0 then 100 * word_chars // n_words else 0 end as word_length from counts),
    stacked as ({stacked}),
    {quantiles('own', 'lang, source')}, {quantiles('language', 'lang')}, {quantiles('corpus', '')},
    keys as (select * from (select distinct lang, source from shares) cross join (select unnest({rules}) as rule)),
    fences as (select k.lang, k.source, k.rule, {blended('upper')}, {blended('lower')}
      from keys k left join own a on k.lang is not distinct from a.lang and k.source is not distinct from a.source and k.rule = a.rule
      left join language b on k.lang is not distinct from b.lang and k.rule = b.rule left join corpus c on k.rule = c.rule)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ({fits}) as kept
    from shares s join fences f on s.lang is not distinct from f.lang and s.source is not distinct from f.source
    group by doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""


def _mixing() -> str:
    return rf"""with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
      md5(coalesce(doc_id::varchar, '')) as hash from documents),
    c as (select *, greatest(length(bin(size)) - 4, 0) as low from s),
    d as (select *, low * 16 + size // (1::bigint << low::integer) as class from c),
    sizes as (select source, sum(size)::bigint as source_size from d group by source),
    weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sizes),
    caps as (select *, source_size * 3 as cap, source_size * 3 / weight as ratio from weighed),
    before as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
      coalesce(sum(cap) over o, 0) as cap_before, coalesce(sum(weight) over o, 0) as weight_before
      from caps window o as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
    levels as (select *, (total - cap_before)::double / (weights - weight_before)::double as level from before),
    targets as (select source, source_size, case when ratio < level then cap::double
      else max(case when not ratio < level then level end) over () * weight end as target from levels),
    rates as (select *, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate,
      ('0x' || substr(md5('offset:' || coalesce(source, '')), 1, 5))::bigint / 1048576.0::double as shift from targets),
    ranked as (select *, row_number() over (partition by source order by class, substr(hash, 1, 3), hash, doc_id::varchar, size) as rank from d)
    select doc_id, size, source_size, target, copies * size as taken, copies from (
      select doc_id, size, source_size, target,
        least(floor(rank * rate + shift) - floor((rank - 1) * rate + shift), 3)::bigint as copies
      from ranked r join rates t on r.source is not distinct from t.source)"""


def _strata_rank() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with docs as (select row_number() over () as r, doc_id, {terms} as terms from documents),
    stats as (select count(*) filter (len(terms) > 0) as documents, coalesce(sum(len(terms)), 0)::bigint as length from docs),
    held as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) group by r, term),
    asked as (select distinct item_id, unnest({terms}) as term from benchmark),
    weighed as (select term, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)::double))::bigint as w
      from (select term, count(*) as df from held where term in (select term from asked) group by term), stats),
    normed as (select r, doc_id, 100 - 50 + (50 * len(terms)::hugeint * documents) // greatest(length, 1) as m from docs, stats),
    scored as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
      from asked join weighed using (term) join held using (term) join normed using (r) group by item_id, r, doc_id),
    ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last)::integer as rank
      from scored where score > 0)
    select item_id, rank, doc_id, score from ranked where rank <= 50"""


ORACLE = {"op1_secrets": _secrets(), "op2_quality": _quality(), "op6_mixing": _mixing(), "op11_strata_rank": _strata_rank()}
