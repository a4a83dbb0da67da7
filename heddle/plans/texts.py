"""Tokens, headlines, URLs, pages and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import identity, text, udfs, urls
from heddle.registry import query
from heddle.session import table

_FOLD = f"translate(replace(lower({{0}}), 'æ', 'ae'), '{text.MARKED}', '{text.PLAIN}')"


def _tok(x: str, stop: list[str] = text.LEGAL_WORDS, least: int = 2) -> str:
    cond = f"length(t) >= {least}" + (f" and t not in ({', '.join(repr(w) for w in stop)})" if stop else "")
    return f"list_filter(regexp_extract_all({_FOLD.format(f'''coalesce({x}, '')''')}, '[a-z0-9]+'), lambda t: {cond})"


@query("token_counts", f"select lang, sum(len({_tok('text', [])})) as tokens, count(*) as docs, sum(len(list_distinct({_tok('text')}))) as different from documents group by 1")
def token_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", text.search_tokens(F.col("text")).alias("w"))
    g = words.groupBy("lang").agg(F.sum(F.size("w")).alias("tokens"), F.count("*").alias("docs"), F.sum(F.size(F.array_except("w", F.array(*map(F.lit, text.LEGAL_WORDS))))).alias("different"))
    return g.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("tokens", "different")})


_TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("name_overlap_score", f"with p as (select page_id, {_tok(_TITLE)} as a, {_tok('''regexp_extract(html, '<h1>([^<]*)</h1>', 1)''')} as b from pages) select page_id, len(list_intersect(list_distinct(a), list_distinct(b))) as overlap, case when len(a) = 0 then 0.0 else round_even(len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a)), 6) end as ratio from p")
def name_overlap_score(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", F.array_distinct(text.tokens(F.col("title"))).alias("a"), F.array_distinct(text.tokens(F.col("h1"))).alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return p.select("page_id", both.cast("bigint").alias("overlap"), F.when(F.size("a") == 0, 0.0).otherwise(F.bround(both / F.size("a"), 6)).alias("ratio"))


def _pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, "<h1>([^<]*)</h1>", 1).alias("h1"))


@query("benchmark_ngram_match", f"with b as (select item_id, ' ' || array_to_string({_tok('text', [])}, ' ') || ' ' as n from benchmark), d as (select doc_id, ' ' || array_to_string({_tok('text', [])}, ' ') || ' ' as h from documents) select item_id, doc_id from b join d on contains(h, n)")
def benchmark_ngram_match(spark, sf_dir):
    """FLT16's core: benchmark passages that stand word for word in documents, found by their first five words, or their first
    where they have fewer. Only keys meet; texts are fetched for the pairs that they give."""
    split = lambda name, key: table(spark, sf_dir, name).select(key, text.search_tokens(F.col("text")).alias("w"))
    five = lambda w, i: F.array_join(F.slice(w, i, 5), " ")
    b = split("benchmark", "item_id").filter(F.size("w") > 0).withColumn("k", F.when(F.size("w") >= 5, five("w", 1)).otherwise(F.get("w", F.lit(0))))
    d = split("documents", "doc_id")
    windows = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: five("w", i))).otherwise(F.array().cast("array<string>"))
    # Single words are looked up only if a passage has no five of them.
    short = bool(b.filter(F.size("w") < 5).head(1))
    starts = d.select("doc_id", F.explode(F.array_distinct(F.concat("w", windows) if short else windows)).alias("k"))
    pairs = starts.join(b.select("item_id", "k"), "k").select("item_id", "doc_id").distinct()
    found = pairs.join(b.select("item_id", F.col("w").alias("needle")), "item_id").join(d.select("doc_id", F.col("w").alias("hay")), "doc_id")
    return found.filter(text.contiguous(F.col("hay"), F.col("needle"))).select("item_id", "doc_id")


@query("token_set_ops", f"with t as (select a.doc_id, list_distinct({_tok('a.text')}) as x, list_distinct({_tok('b.text')}) as y from documents a join documents b on b.doc_id = a.doc_id + 1 where a.n_chars < 3000 and b.n_chars < 3000) select doc_id, len(list_intersect(x, y)) as both, len(x) - len(list_intersect(x, y)) as only_left, len(list_distinct(list_concat(x, y))) as either, len(list_intersect(x, y)) > 0 as overlap from t".replace(" where a.n_chars < 3000 and b.n_chars < 3000", ""))
def token_set_ops(spark, sf_dir):
    """SET2-SET4 and SET7 over the words of neighbouring documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("x"))
    j = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    n = lambda c: F.size(c).cast("bigint")
    return j.select("doc_id", n(F.array_intersect("x", "y")).alias("both"), n(F.array_except("x", "y")).alias("only_left"), n(F.array_union("x", "y")).alias("either"), F.arrays_overlap("x", "y").alias("overlap"))


_P = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_part = lambda i, u="url": f"regexp_extract({u}, '{_P}', {i})"


@query("url_canonical", f"with p as (select page_id, lower({_part(1)}) as s, regexp_replace(lower({_part(2)}), ':(80|443)$', '') as h, regexp_replace({_part(3)}, '/+', '/', 'g') as p, list_sort(list_filter(string_split({_part(4)}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+') and not regexp_matches(regexp_extract(lower(x), '^([^=]*)', 1), '{urls.TRACKING}'))) as q from pages) select page_id, s || '://' || h || (case when p = '' then '/' else p end) || (case when len(q) = 0 then '' else '?' || array_to_string(q, '&') end) as url from p")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


_HOST = f"regexp_replace(regexp_replace(regexp_replace(lower({_part(2)}), '^[^@]*@', ''), ':[0-9]*$', ''), '^www\\.', '')"


@query("host_counts", f"select {_HOST} as host, count(*) as n from pages group by 1")
def host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("homepage_normalise", f"select page_id, lower({_part(1)}) || '://' || lower({_part(2)}) || {_part(3)} as homepage from pages")
def homepage_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.homepage(F.col("url")).alias("homepage"))


@query("page_extract", f"select page_id, {_TITLE} as title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h1, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) as links, regexp_extract(html, '<footer>(.*?)</footer>', 1) as footer, sha256(html) as content_sha256 from pages")
def page_extract(spark, sf_dir):
    h = F.col("html")
    return _pages(spark, sf_dir).select("page_id", "title", "h1", F.size(F.regexp_extract_all(h, F.lit('href="[^"]*"'), F.lit(0))).cast("bigint").alias("links"), F.regexp_extract(h, "<footer>(.*?)</footer>", 1).alias("footer"), F.sha2(h, 256).alias("content_sha256"))


@query("sequence_ratio")
def sequence_ratio(spark, sf_dir):
    """SCA10, of the title and the first heading of every page."""
    return _pages(spark, sf_dir).select("page_id", F.round(udfs.sequence_ratio(F.col("title"), F.col("h1")), 6).alias("ratio"))


@query("jsonld_walk", "select s_suppkey, 0 as place, 'Organization' as type, s_name as name, cast(null as varchar) as url from supplier union all select s_suppkey, 1, 'JobPosting', 't' || s_suppkey, null from supplier")
def jsonld_walk(spark, sf_dir):
    """SCA38, over graphs made of suppliers."""
    s = table(spark, sf_dir, "supplier")
    graph = F.format_string('{"@graph": [{"@type": "WebSite", "publisher": {"@type": ["Organization"], "name": "%s"}}, {"@type": "JobPosting", "title": "t%d"}]}', "s_name", "s_suppkey")
    return udfs.json_ld(s.select("s_suppkey", graph.alias("json")), "s_suppkey", "json", ["Organization", "JobPosting"])
