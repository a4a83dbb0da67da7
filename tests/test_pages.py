"""Parts of pages against what their markup says, references against the standard library, graphs of any shape, merged evidence."""

from __future__ import annotations

import json
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from heddle.functions import graphs, urls
from heddle.operators import pages

HTML = """<!DOCTYPE html><html><head><title> Fjord &amp; Kraft <b>x</b></title><meta name='description' content=' Strøm  til alle '><meta property="og:description" content="og">
<script type="application/ld+json">{"@context":"x","@graph":[{"@type":["Thing","Organization"],"name":"Fjord","sameAs":["https://x.com/fjord","https://www.linkedin.com/company/fjord/?a"],"dept":{"@type":"Store","name":"B"}}]}</script>
<script src="a.js"></script><style>p{color:red}</style></head><body><nav><a href=/om-oss>Om oss</a><a href='kontakt?x=1'>Ta kontakt</a></nav>
<header>Topp</header><article><h1>Velkommen</h1><p>Vi   selger <i>strøm</i>.<br>Alltid.<p>Ring &lt;oss&gt;<script>var t="</p>";</script><template>nei</template></article>
<div>Utenfor <a href="https://www.facebook.com/fjord?ref=x"><img src=b></a></div><div data-href="https://instagram.com/fjord/"></div><iframe src="https://www.facebook.com/plugins/page.php?href=https%3A%2F%2Fwww.facebook.com%2Fandre&amp;t=1"></iframe>
<span itemprop="telephone">22 33</span><!-- <a href="/no">no</a> --><footer>Fjord AS <address>Vei 1</address></footer>"""


def test_parts_of_a_page(spark):
    rows = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p>bare"), (5, "</div><div class='card x'><a class=l href=u>A</a><time datetime=2024></time></div><div class='card'>B<div>C</div></div><p>D")], "id int, html string")
    got = {r.id: r for r in pages.with_parts(rows, cards="div.card").collect()}
    r = got[1]
    assert (r.title, r.main_text, r.identity_text, r.scripts) == ("Fjord & Kraft x", "Velkommen Vi selger strøm . Alltid. Ring <oss>", "22 33 Fjord AS Vei 1 Vei 1", 1)
    assert [(m.name, m.content) for m in r.metas] == [("description", "Strøm  til alle"), ("og:description", "og")]
    assert [(x.href, x.label) for x in r.links] == [("/om-oss", "Om oss"), ("kontakt?x=1", "Ta kontakt"), ("https://www.facebook.com/fjord?ref=x", "")]
    assert r.embedded == ["https://instagram.com/fjord/", "https://www.facebook.com/plugins/page.php?href=https%3A%2F%2Fwww.facebook.com%2Fandre&t=1"]
    assert [json.loads(t)["@context"] for t in r.json_ld] == ["x"] and r.cards == []
    assert all((got[k].title, got[k].links, got[k].json_ld, got[k].scripts) == ("", [], [], 0) for k in (2, 3, 4)) and got[4].main_text == "bare"
    assert [[(e.tag, e.attributes, e.text) for e in c] for c in got[5].cards] == [[("div", {"class": "card x"}, "A"), ("a", {"class": "l", "href": "u"}, "A"), ("time", {"datetime": "2024"}, "")], [("div", {"class": "card"}, "B C"), ("div", {}, "C")]]
    nested = spark.createDataFrame([("<section class=a><p>1</p><b data-test-id=about-x>2<i>3</i></b><p>4</p></section><hr data-test-id=about-y><b>5</b>",)], "html string")
    cards = pages.with_parts(nested, cards="section.a,[data-test-id=about-]").head().cards
    assert [[(e.tag, e.text) for e in c] for c in cards] == [[("section", "1 2 3 4"), ("p", "1"), ("p", "4")], [("b", "2 3"), ("i", "3")], [("hr", "")]]


def test_profiles_and_priority_links(spark):
    r = pages.with_parts(spark.createDataFrame([("https://fjord.no/hjem", HTML)], "url string, html string")).select(
        pages.social_links(F.col("url"), F.col("links"), F.col("embedded")).alias("s"), pages.structured_links(F.col("json_ld"), graphs.nodes).alias("j"), pages.priority_links(F.col("url"), F.col("links")).alias("p"), pages.description(F.col("metas")).alias("d"), pages.extraction_state(F.col("main_text"), F.col("scripts")).alias("e")
    ).head()
    assert [tuple(x) for x in r.s] == [("facebook", "https://facebook.com/andre"), ("facebook", "https://facebook.com/fjord"), ("instagram", "https://instagram.com/fjord")]
    assert [tuple(x) for x in r.j] == [("linkedin", "https://linkedin.com/company/fjord"), ("x", "https://x.com/fjord")]
    assert (r.p, r.d, r.e) == (["https://fjord.no/om-oss", "https://fjord.no/kontakt"], "Strøm  til alle", "static_complete")


def test_priority_links_are_the_best_of_each_address(spark):
    links = [("/news", "x"), ("/a", "Press"), ("/a?x", "About us"), ("https://other.no/about", ""), ("/b#c", "team"), ("/", "about"), ("/people/", ""), ("mailto:about@x", "about"), ("HTTP://s.no/kontakt", "")]
    got = spark.createDataFrame([("http://s.no/", links)], "u string, l array<struct<href:string,label:string>>").select(pages.priority_links(F.col("u"), F.col("l"), 4).alias("x")).head().x
    assert got == ["http://s.no/a", "HTTP://s.no/kontakt", "http://s.no/b", "http://s.no/people/"]


def test_references_are_joined_as_by_the_library(spark):
    bases = ["http://a.no/b/c/d?q", "http://a.no", "http://a.no/", "https://a.no:80/b/c/", "http://a.no/b;p/c?x=/y#z"]
    refs = ["g", "./g", "g/", "/g", "//h.no/x", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "./../g", "./g/.", "g/./h", "g/../h", "https://x.no/a/../b", "mailto:a@b", " g "]
    rows = [(b, r, urljoin(b, r.strip())) for b in bases for r in refs]
    for r in spark.createDataFrame(rows, "b string, r string, want string").select("*", urls.joined(F.col("b"), F.col("r")).alias("got")).collect():
        want = r.want if "x.no" not in r.r else r.r
        assert r.got == want, (r.b, r.r)


def walk(x, out):
    out.append(x)
    for y in (x[k] for k in sorted(x)) if isinstance(x, dict) else x if isinstance(x, list) else []:
        walk(y, out)
    return out


def made(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([None, True, 3, 2.5, "s", "Organization"])
    if kind < 0.6:
        return [made(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {k: made(r, depth - 1) for k in r.sample(["@type", "name", "a", "b", "sub.dot", "@graph"], r.randint(0, 4))} | ({"@type": r.choice(["Organization", ["Store", "X"], "Y", 5])} if r.random() < 0.6 else {})


def test_graphs_are_walked_as_by_brute_force(spark):
    r = random.Random(7)
    things = [made(r, 6) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(things)] + [(-1, "{no"), (-2, None), (-3, "")], "i int, t string")
    every = rows.select("i", F.transform(graphs.values(F.col("t")), lambda x: F.to_json(x["value"])).alias("all"), F.transform(graphs.nodes(F.col("t"), graphs.ORGANISATIONS, 20), lambda x: F.to_json(x)).alias("org"), F.transform(graphs.graph(F.array("t")), lambda x: F.to_json(x)).alias("top"))
    plain = lambda texts: [json.loads(x) if x is not None else None for x in texts]
    for got in every.collect():
        if got.i < 0:
            assert (got.all, got.org, got.top) == ([], [], [])
            continue
        thing = things[got.i]
        found = walk(thing, [])
        assert plain(got.all) == found
        objects = [x for x in found if isinstance(x, dict) and set(map(str, x.get("@type") if isinstance(x.get("@type"), list) else [x.get("@type")])) & set(graphs.ORGANISATIONS)]
        assert plain(got.org) == objects[:20]
        top = thing["@graph"] if isinstance(thing, dict) and isinstance(thing.get("@graph"), list) else thing if isinstance(thing, list) else [thing]
        assert plain(got.top) == [x for x in top if isinstance(x, dict)]


FETCHED = "organisation_number string, requested_url string, final_url string, status_code int, content_type string, page_kind string, retrieved_at string, body string"


def test_fetched_pages_become_evidence(spark):
    html = lambda t, *links: f"<title>{t}</title><p>{'ord ' * 30}</p>" + "".join(f"<a href='{u}'>l</a>" for u in links)
    rows = [
        ("1", "http://f.no/", "https://f.no/", 200, "text/html", "homepage", "t1", html("Old")), ("1", "http://f.no/", "https://f.no/", 200, "text/html; x", "homepage", "t2", html("New", "https://x.com/f")),
        ("1", "https://f.no/om", "https://f.no/om", 200, "text/HTML", "priority", "t3", html("Om", "https://facebook.com/f")), ("1", "https://f.no/om", "https://f.no/om", 200, "text/HTML", "priority", "t4", html("Om", "https://facebook.com/f")),
        ("1", "https://f.no/x", "https://f.no/x", 500, "text/html", "priority", "t3", "z"), ("2", "http://g.no/", "http://g.no/", 404, "text/html", "homepage", "t1", "gone"), ("3", "http://h.no/", "http://h.no/", 200, "application/pdf", "homepage", "t1", "%PDF"),
        ("4", "http://i.no/om", "http://i.no/om", 200, "text/html", "priority", "t1", html("Om")), ("5", "http://j.no/", "http://j.no/", 200, None, "homepage", "t1", None),
    ]
    events = pages.page_events(spark.createDataFrame(rows, FETCHED))
    assert {(r.organisation_number, r.status, r.error) for r in events.filter("status <> 'available'").collect()} == {("1", "source_error", "HTTP 500"), ("2", "not_found", "HTTP 404"), ("3", "source_error", "Unsupported content type: application/pdf"), ("5", "source_error", "Unsupported content type: ")}
    got = {r.organisation_number: r for r in pages.merged(events).collect()}
    one = got["1"]
    assert (one.status, one.title, one.retrieved_at, one.source_url) == ("available", "New", "t2", "https://f.no/")
    assert [tuple(x) for x in one.social_links] == [("facebook", "https://facebook.com/f"), ("x", "https://x.com/f")]
    assert [p.url for p in one.pages] == ["https://f.no/", "https://f.no/om"] and [tuple(e) for e in one.crawl_errors] == [("https://f.no/x", "HTTP 500")]
    assert [(got[k].status, got[k].title, got[k].pages) for k in "2345"] == [("not_found", None, None), ("source_error", None, None), ("not_found", None, None), ("source_error", None, None)]
    assert got["4"].note == "No homepage crawl event was produced" and got["2"].note == "HTTP 404"
    profiles = spark.createDataFrame([("1", "f.no"), ("9", "k.no"), ("10", " "), ("11", None)], "organisation_number string, website string")
    assert [(r.organisation_number, r.requested_url, r.status) for r in pages.missing_seeds(profiles, events, "x").collect()] == [("9", "https://k.no", "source_error")]


@pytest.mark.parametrize("text", ["", "<", "<a", "<a href=", "<!--", "<script>x", "&#x110000;&amp", "<p " * 500, "<div>" * 3000 + "x"])
def test_broken_markup_is_read_as_far_as_it_goes(spark, text):
    assert pages.with_parts(spark.createDataFrame([(text,)], "html string")).count() == 1
