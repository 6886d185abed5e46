"""Runs of visible text, the catalog of a record, and what lies outside it."""

import pytest
from pyspark.sql import functions as F

from pagewarrant.operators import copy as V
from pagewarrant.sources import dom


def _nodes(spark, html):
    return dom.explode_dom(spark.createDataFrame([(1, html)], "page_id long, html string"))


@pytest.mark.parametrize(
    ("html", "runs"),
    [
        ("<p>Call <b>555</b> now</p>", {"Call 555 now"}),
        ("<p>Call<br>now</p>", {"Call", "now"}),
        ("a <i>b</i><div>c</div>d", {"a b", "d", "c"}),
        ("<p>x <span>y <a>z</a> w</span> v</p>", {"x y w v", "z"}),
        ("<label>Name <input placeholder=q></label>", {"Name"}),
        ("<p>see <label>Name <b>it</b></label> <img alt='Logo '> end</p>", {"see Name it Logo end", "Name it"}),
        ("<p>a<span hidden>no</span>b</p><!-- c --><script>d</script>", {"a b"}),
        ("<div>one<p>two</p>three <em>four</em></div>", {"one", "two", "three four"}),
        ("<input type=submit value='Send it'>", {"Send it"}),
    ],
)
def test_inline_runs(spark, html, runs):
    assert {r["text"] for r in V.inline_runs(_nodes(spark, html)).collect()} == runs


def test_layout_runs(spark):
    n = _nodes(spark, "<table><tr><td>a</td><td>b <i>c</i></td></tr></table><div class=row><span>x</span><span>y</span><a>z</a><p>w</p></div><div class='row service-card'><b>q</b></div>")
    assert {r["text"] for r in V.layout_runs(n, ["row"]).collect()} == {"a b c", "x y", "w"}
    assert {r["text"] for r in V.layout_runs(n, []).collect()} == {"a b c"}


def test_unowned_copy(spark):
    n = _nodes(spark, "<bdo>x</bdo><ol><li value=3>a</li></ol><ul><li>b</li></ul><meter></meter><input type=Range><div role='x slider'></div><p aria-level=2></p><p aria-level=' '></p><bdo hidden>y</bdo>")
    got = sorted((r["rule_id"], r["evidence"]) for r in V.check_unowned_copy(n).collect())
    assert got == [("numeric_control", "div"), ("numeric_control", "input"), ("numeric_control", "meter"), ("numeric_control", "p"), ("ordered_list", "li"), ("ordered_list", "ol"), ("reversed_copy", "bdo")]


def test_catalog_and_check(spark):
    schema = (
        "doc_id long, business_name string, trade string, city string, state string, phone string, hours string, service_radius string, services array<string>, service_promises array<string>, has_24_7 boolean, "
        "family_owned boolean, established_year int, reviews array<struct<author:string,rating:double,date:string,platform:string,text:string>>, review_mode string, reviews_url string, aggregate struct<score:double,count:bigint>"
    )
    rows = [
        (1, "acme pipes llc", "plumber", "Elm", "OH", "555-0100", "Mon 9-5, Tue 9-4", "25 miles.", ["Drain  Cleaning"], [" Free estimates "], True, True, 1999, [("Ann", 4.5, "May", "Web", "Good")], "cards", "https://r.test", (4.5, 12)),
        (2, "Bo", "roof repair", "Oak", "TX", None, None, None, None, None, None, None, None, None, "omit", None, None),
    ]
    catalog = V.copy_catalog(spark.createDataFrame(rows, schema), "doc_id")
    got = {k: {r["value"] for r in catalog.where(f"doc_id = {k}").collect()} for k in (1, 2)}
    one = {
        "Acme Pipes", "Plumber", "plumber", "Serving Elm, OH.", "Serving 25 miles.", "25-MILE RADIUS", "Mon 9-5", "Tue 9-4", "Ask us about Drain Cleaning", "Free estimates", "Call us 555-0100", "Call 555-0100 →", "Available 24/7",
        "Available 24/7 Call 555-0100", "family-owned.", "Established in 1999", "Customer Reviews", "Read All on Google", "Ann", "4.5", "★★★★★ 4.5 out of 5 Based on 12 reviews on Google", "Free Estimates", "24/7", "Acme Pipes — Elm, OH", "Hours",
    }
    assert one <= got[1] and not {"Call", "Customer Reviews", "Available 24/7", "24/7", ""} & got[2] and {"Roof Repair", "roof repair", "Bo", "Request Service"} <= got[2] and not any("null" in v for v in got[2])
    page = "<h1>Acme Pipes</h1><p>Call <b>555-0100</b></p><p><b>555-0100</b> Call</p><p>Best in town</p><img alt=Stock><label>Your  name</label>"
    bad = V.check_copy(V.fragments(_nodes(spark, page)), catalog)
    assert sorted(r["evidence"] for r in bad.collect()) == ["555-0100 Call", "Best in town", "Stock", "Stock Your name"]


def test_lists_find_what_strings_find(spark):
    html = "<table><tr class='wide'><td>A</td><td>b <b>c</b></td><td><button>D</button></td></tr></table><p>Call <b>5</b></p><p hidden>E</p><img alt=' F  g '>"
    pages = spark.createDataFrame([(1, html), (2, html), (3, html), (4, "")], "page_id long, html string")
    nodes = dom.explode_dom(pages).persist()
    lists = spark.createDataFrame([(1, ["A", "b  c"]), (1, ["D"]), (2, []), (2, None), (4, ["A"])], "doc_id long, catalog array<string>")
    strings = lists.select("doc_id", F.explode("catalog").alias("value"))
    for classes in ([], ["wide"]):
        want = sorted(V.check_copy(V.fragments(nodes, classes), strings).collect())
        checked = V.check_copy_lists(nodes, lists, classes)
        assert sorted(checked.collect()) == want and {r["doc_id"] for r in want} == {1, 2, 3} and "Call 5" in {r["evidence"] for r in want if r["doc_id"] == 1} and "A" not in {r["evidence"] for r in want if r["doc_id"] == 1}
    # no string of a catalog has a row of its own
    assert "Generate explode(catalog" not in checked._jdf.queryExecution().optimizedPlan().toString()
