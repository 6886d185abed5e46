"""Components of generated pages on small fixtures, and the queries over them against their SQL."""

import duckdb
import pytest

from pagewarrant.operators import audit as A
from pagewarrant.operators import catalogs as K
from pagewarrant.operators import components as M
from pagewarrant.operators import contracts as C
from pagewarrant.plans import components as plans
from pagewarrant.sources import dom

SF = "/root/testdata/sf0.001"
BODY = """<body><div class="reviews-aggregate"><span class="reviews-stars-lg" style="--score: 4.5">★★★★★</span><div class="reviews-score">4.5 <span class="of-five">out of 5</span></div>
<div class="reviews-count">Based on 12 reviews on Google</div><a class="reviews-cta" href="u">Read all reviews on Google</a></div><p>rated 4.5 by 12 customers</p></body>"""


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _nodes(spark, *bodies):
    return dom.explode_dom(spark.createDataFrame(list(enumerate(bodies, 1)), "page_id long, html string"))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "supplier", "part", "orders", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = plans.QUERIES[name](spark, SF), con.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted(map(repr, rows))
    rows = key(tuple(r) for r in got.select(columns).collect())
    assert rows and rows == key(want.fetchall())


def test_balance(spark):
    bodies = ["<body><p>a<br/><svg><path/></svg></p></body>", "<body><p><b>x</p></b></body>", "<body></br></body>", "<body></em></body>", "<body><p/></body>", "<body><i>", "<body><!-- <p> --><script>'<p>'</script></body>", "", None, '<body><a title="<p>" x=1 X>y</a></body>']
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, html string")
    assert _rows(A.check_balance(df).where("rule_id = 'balance'").select("doc_id", "evidence")) == [(1, "misnested p in b"), (2, "void br"), (3, "unexpected em"), (4, "self_closed p"), (5, "unclosed i")]
    assert _rows(A.check_balance(df).where("rule_id = 'body_roots'").select("doc_id", "evidence")) == [(5, "1 0"), (7, "0 0")]
    assert _rows(A.check_duplicate_attributes(df).select("doc_id", "evidence")) == [(9, "x")]


def test_review_summary(spark):
    contract = lambda n, **v: spark.createDataFrame([(k, "aggregate", v.get("score", "4.5"), v.get("count", 12), "u") for k in range(1, n + 1)], "doc_id long, layout string, score string, count long, url string")
    nodes = _nodes(spark, BODY, BODY.replace("★★★★★", "★"), BODY + BODY, BODY.replace('class="reviews-count"', 'class="reviews-count" id="x"'), "<body></body>")
    got = {}
    for doc, rule, evidence in _rows(M.check_review_summary(nodes, contract(5))):
        got.setdefault(doc, set()).add(evidence or rule)
    assert 1 not in got and got[2] == {"review_stars"} and got[4] == {"reviews-count attribute"}
    assert {"reviews-aggregate number", "of-five number"} <= got[3] and len([e for e in got[5] if e.endswith("number")]) == 6
    assert [r[1] for r in _rows(M.check_review_summary(_nodes(spark, BODY), contract(1, score=None)))] == ["review_evidence"]
    assert _rows(M.check_review_summary(nodes.where("false"), contract(0))) == []


def test_texts_outside_components(spark):
    nodes = M.outside_components(_nodes(spark, BODY))
    seen = A.surfaces(nodes)
    assert "".join(r["text"] for r in seen.where("surface = 'visual'").collect()).strip() == "rated 4.5 by 12 customers"
    contract = lambda s, n: spark.createDataFrame([(1, s, n)], "doc_id long, score string, count long")
    assert _rows(M.check_ambient_reviews(seen, contract("4.5", 12))) == []
    assert _rows(M.check_ambient_reviews(seen, contract("4.6", None)).select("rule_id", "evidence")) == [("ambient_review_count", "12"), ("ambient_review_score", "4.5")]


def test_score_of_style(spark):
    styles = ["--score: 4.5", "a:b; --SCORE:4", "--score:1;--score:2", "--score: x", "--scores:1", "", None]
    df = spark.createDataFrame([(s,) for s in styles], "s string")
    assert [r[0] for r in df.select(M.score_of_style(df.s)).collect()] == [4.5, 4.0, None, None, None, None, None]


def test_service_cards(spark):
    card = lambda name, desc: f'<div class="service-card"><b class="service-card-name">{name}</b><p class="service-card-desc">{desc}</p></div>'
    good = card("Roof  work", "Ask us about roof work")
    nodes = _nodes(spark, good, good + good, "<p>none</p>", card(" ", "x"), "<p>none</p>")
    services = spark.createDataFrame([(1, ["Roof work"]), (2, ["Roof work"]), (3, ["Roof work"]), (4, ["Roof work"]), (5, None)], "doc_id long, services array<string>")
    assert _rows(M.check_service_cards(nodes, services).select("doc_id", "rule_id", "evidence")) == [(2, "service_names", ""), (3, "service_names", ""), (4, "service_card", "empty"), (4, "service_names", "")]


def test_catalogs_and_images(spark):
    sections = spark.createDataFrame([("bold -- strong", "nothing"), ("TRADE: plumber", 'hero_search_query: "pipes"'), ("Other", None)], "heading string, body string")
    assert _rows(K.trade_queries(sections)) == [("plumber", "pipes")]
    assert [tuple(r) for r in K.theme_defs(sections).collect()] == [("bold", None, None, "font_link")]
    claims = spark.createDataFrame([(1, "image", "/a.png?x=1&amp;y=2 "), (1, "text", "/a"), (2, "logo", "b.png"), (3, "image", None)], "doc_id long, kind string, value string")
    sites = spark.createDataFrame([(1, "https://h.example/p/"), (2, " ")], "doc_id long, base_url string")
    assert {tuple(r) for r in C.canonical_images(claims, sites).collect()} == {(1, "image", "https://h.example/a.png?x=1&y=2"), (1, "text", "/a"), (2, "logo", "b.png"), (3, "image", None)}


def test_review_cards_are_read_and_compared_whole(spark):
    card = lambda author="Ann", score="4.5", date="May", platform="Web", text="Good work", tail="": f"<div class=review-card><span class=review-stars-sm style='--score: {score}'>★★★★★</span><p class=review-text>{text}</p><div class=review-meta><span class=review-author>{author} <span class=review-date>{date}</span></span><span class=review-platform>{platform}</span></div>{tail}</div>"
    pages = [card() + card(date="June") + card(platform="Other"), card() + card(), card(tail="<p>more</p>") + card(score="x") + card().replace("<p class=review-text>", "<p class=review-text id=a>"), "<div class=review-card></div>"]
    nodes = dom.explode_dom(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    cards = M.review_cards(nodes)
    assert sorted((r["doc_id"], r["bad"]) for r in cards.where("bad is not null").collect()) == [(2, "review-card"), (2, "review-stars-sm"), (2, "review-text"), (3, "review-card")]
    reviews = spark.createDataFrame([(k, "ann", 4.5, "may", "web", "good  work") for k in (0, 1)], "doc_id long, author string, rating double, date string, platform string, text string")
    bad = A.check_review_cards(cards.where("bad is null"), reviews).collect()
    assert sorted(r["doc_id"] for r in bad) == [0, 0, 1]


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Join ")


def test_components_are_told_where_a_pages_rows_lie(spark):
    # each part of a component was a join of its own, and the plan outgrew the driver
    nested = "<div class=review-card><span class=review-stars-sm style='--score: 4'>★★★★★</span><p class=review-text>a<br>b</p><div class=review-meta><span class=review-author></span><!-- c --><span class=review-platform>P</span></div></div>"
    nodes = dom.explode_dom(spark.createDataFrame([(1, nested + "<p class='review-text review-date'>x</p>"), (2, f"<div class='review-card x'>{nested}</div>")], "page_id long, html string"))
    cards = M.review_cards(nodes)
    got = sorted(tuple(r) for r in cards.select("doc_id", "card", "author", "rating", "date", "platform", "text", "bad").collect())
    assert got == [(1, 0, None, 4.0, None, "p", "a b", "review-text"), (2, 0, None, 4.0, None, "p", "a b", "review-card"), (2, 1, None, 4.0, None, "p", "a b", "review-text")]
    assert _joins(cards) == 0
    contract = spark.createDataFrame([(1, "aggregate", "4.5", 12, "u")], "doc_id long, layout string, score string, count long, url string")
    found = M.check_review_summary(_nodes(spark, BODY.replace("12 reviews", "13 reviews") + "<strong class=reviews-summary-cta>x</strong>"), contract)
    assert _rows(found) == [(1, "review_count", "")] and _joins(found) == 1
    spec = spark.createDataFrame([(1, "reviews-count", "p", [], None, False), (1, "of-five", "span", [], [], True), (1, "none", "p", [], None, False)], "doc_id long, class string, tag string, attributes array<string>, children array<string>, text_beside boolean")
    shape = M.check_component(_nodes(spark, BODY + "<i class=reviews-count></i>"), spec, ["reviews-count", "of-five", "none"])
    assert [r[2] for r in _rows(shape)] == ["none number", "reviews-count element", "reviews-count element", "reviews-count number"] and _joins(shape) == 1


def test_reviews_are_matched_without_a_join(spark):
    kind = "doc_id long, author string, rating double, date string, platform string, text string"
    row = lambda author, rating=1.0, doc=1: (doc, author, rating, "d", "p", "t")
    cards = spark.createDataFrame([row("Ann"), row("ann"), row("ANN "), row("bo", None), row("cy", doc=2), row(None)], kind)
    lost = A.check_review_cards(cards, spark.createDataFrame([row("ann"), row("ann"), row("bo", None), row("cy", doc=3)], kind))
    assert sorted((r["doc_id"], str(r["evidence"])) for r in lost.collect()) == [(1, "None"), (1, "ann"), (1, "bo"), (2, "cy")]
    assert _joins(lost) == 0
