"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from heddle.llm.divergence import Audit
from heddle.llm.filter_audit import FILTERS, LEAST_DISTINCT, LEAST_WORDS, MOST_CAPITALS
from heddle.llm.quality import FIGURES, LEADING_BITS, Rules


def _quality_sql(rules: Rules) -> str:
    """The measures, sketches, thresholds and verdicts of op3, window by window."""
    word, figures = r"[^\x20\x09-\x0D]", {"symbols_per_mille": ("1000", "n_symbols", "n_words"), "dup_lines_per_mille": ("1000", "n_dup_lines", "n_lines"), "repeats_per_mille": ("1000", "n_repeat_words", "n_words"), "word_length_cent": ("100", "word_chars", "n_words")}
    figure = ", ".join(f"({k} * {a}) // greatest({b}, 1) as {name}" for name, (k, a, b) in figures.items())
    at = lambda q: f"min(bucket) filter (where below >= ceil(total * cast({q} as double)))"
    reach = lambda m: f"greatest({rules.spread} * (hi - lo), {m})"
    limits = ", ".join(f"max(case when figure = '{f}' then {'-1' if low is None else 'lo - ' + reach(low)} end) as {f}_low, max(case when figure = '{f}' then hi + {reach(high)} end) as {f}_high" for f, low, high in rules.margins)
    inside = " and ".join(f"{f} between {f}_low and {f}_high" for f in FIGURES)
    counters = " union all ".join(f"select lang, source, '{f}' as figure, {f} as v from f where not base_failed" for f in FIGURES)
    low = f"greatest(length(bin(v)) - {LEADING_BITS}, 0)"
    return f"""with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}+') as w from documents),
win as (select r, i, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
twice as (select r, i, lead(i) over (partition by r order by i) as j from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
rep as (select r, sum(least(5, coalesce(j - i, 5))) as n from twice group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from d),
m as (select d.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from d join l using (r) left join rep using (r)),
f as (select *, {figure}, n_words < {rules.least_words} or 100 * n_repeat_words > {rules.most_repeated_percent} * n_words as base_failed from m),
s as (select lang, source, figure, (v >> {low}) << {low} as bucket, count(*) as n from ({counters}) group by all),
k as (select *, sum(n) over (partition by lang, source, figure order by bucket) as below, sum(n) over (partition by lang, source, figure) as total from s),
q as (select lang, source, figure, {at(rules.lower_quantile)} as lo, {at(rules.upper_quantile)} as hi from k group by 1, 2, 3),
t as (select lang, source, {limits} from q group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({inside}, false) as kept
from f left join t on f.lang is not distinct from t.lang and f.source is not distinct from t.source"""


ORACLES: dict[str, str] = {"op3_adaptive_quality": _quality_sql(Rules())}


def _audit_sql() -> str:
    """The masks, orders and counts of op11."""
    letters = ", ".join(f"('{f}')" for f in FILTERS)
    word = r"[^\x20\x09-\x0D]+"
    others = lambda k: " and ".join(f"o{j}.f <> o{k}.f" for j in range(k))
    orders = "from l as o0 " + " ".join(f"join l as o{k} on {others(k)}" for k in range(1, len(FILTERS)))
    return rf"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
m as (select doc_id, part, case when len(w) < {LEAST_WORDS} then 'A' else '' end || case when 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) then 'B' else '' end
  || case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
  || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as fails from d),
b as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by 1),
c as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m left join b using (doc_id) group by all),
l(f) as (values {letters}),
o as (select {" || ".join(f"o{k}.f" for k in range(len(FILTERS)))} as filter_order {orders}),
s as (select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as before from o, (select unnest(range(1, {len(FILTERS) + 1})) as step)),
r as (select part, filter_order, step, f,
  coalesce(sum(n) filter (where translate(fails, before || f, '') = fails), 0) as kept,
  coalesce(sum(n) filter (where contains(fails, f) and translate(fails, before, '') = fails), 0) as removed,
  coalesce(sum(n) filter (where contains(fails, f) and translate(fails, before, '') <> fails), 0) as redundant,
  coalesce(sum(n) filter (where fails = f), 0) as unique_fails,
  coalesce(sum(good) filter (where contains(fails, f) and translate(fails, before, '') = fails), 0) as good_lost,
  coalesce(sum(toxic) filter (where contains(fails, f) and translate(fails, before, '') = fails), 0) as toxic_lost
  from c, s group by all)
select part, filter_order, cast(step as integer) as step, {", ".join(f"cast({x} as bigint) as {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  cast(sum(removed) over (partition by part, f) as bigint) as shapley from r"""


def _divergence_sql(how: Audit) -> str:
    """Op13 with a share for each group and kept term, zero counts too."""
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    share = lambda by: f"1 + (cast({how.scale} as hugeint) * (n + {how.smoothing})) // (sum(n) over (partition by {by}) + {how.smoothing} * count(*) over (partition by {by}))"
    return rf"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') as w from documents),
u as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term from u group by all having count(distinct r) >= {how.least_documents}),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from u semi join k using (lang, term) group by all),
z as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c on g.lang = c.lang and g.source = c.source and k.term = c.term),
p as (select *, {share("lang, source")} as p from z),
q as (select lang, term, {share("lang")} as q from (select lang, term, sum(n) as n from z group by all)),
f as (select x.lang, x.source, y.source as item, cast(sum(abs(x.p - y.p)) as bigint) as value from p as x join p as y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f.value, 0) as value from g as x join g as y on x.lang = y.lang and x.source <> y.source
  left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
terms as (select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from (from pairs union all from terms))
select * from ranked where part = 'pair' or rank <= {how.most_terms}"""


ORACLES |= {"op11_filter_audit": _audit_sql(), "op13_source_divergence": _divergence_sql(Audit())}
