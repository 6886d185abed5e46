from pyspark.sql import functions as F

from pagewarrant.operators import audit as A
from pagewarrant.operators import catalogs as K
from pagewarrant.operators import documents as D
from pagewarrant.operators import pages as P
from pagewarrant.sources import dom

BODY = """<body><!-- SECRET - marker --><div class="card Card big"><h3 class="name">Drains</h3><p class="text">Serving you since 1999, over 20 years.</p></div>
<div class="card"><h3 class="name">Roofs</h3></div><p>Call 212-555-0100 or 313-555-0199, x@y.zz, 12 Oak Street. We go 30 miles for many years.</p>
<a href="/ok" onclick="x()">Ok</a><a href="javascript:alert(1)">No</a><script>1</script><blockquote>Great. — Jane Doe</blockquote><p>{{NAME}} [CITY] [other]</p><form action="/send"></form><img src="/a.png"></body>"""


def setup(spark):
    nodes = dom.explode_dom(spark.createDataFrame([(1, BODY), (2, "<body><p>fine</p></body>")], "page_id long, html string"))
    return nodes, A.surfaces(nodes)


def rules(df):
    return sorted({(r["doc_id"], r["rule_id"], r["evidence"]) for r in df.collect()})


def contract(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, kind string, value string")


def test_structure(spark):
    nodes, _ = setup(spark)
    assert rules(A.check_forbidden(nodes)) == [(1, "executable_attribute", "href"), (1, "executable_attribute", "onclick"), (1, "forbidden_tag", "script")]
    assert rules(A.check_comments(nodes, ["secret-marker"])) == [(1, "comment_marker", "secret-marker")]
    cat = spark.createDataFrame([("card",), ("name",), ("text",), ("big",)], "class string")
    assert rules(A.check_class_catalog(nodes, cat, spark.createDataFrame([("big",)], "class string"))) == [(1, "class_forbidden", "big"), (1, "class_outside_catalog", "Card")]
    need = spark.createDataFrame([(1, "name", 2), (1, "card", 2), (2, "name", 1)], "doc_id long, class string, n int")
    assert {(r[0], r[2].split()[0]) for r in rules(A.check_class_counts(nodes, need))} == {(1, "card"), (2, "name")}
    seq = spark.createDataFrame([(1, "card", ["name", "text"])], "doc_id long, class string, children array<string>")
    assert len(A.check_child_sequence(nodes, seq).collect()) == 1
    assert rules(A.check_class_text(nodes, "name", spark.createDataFrame([(1, ["Drains", "Roofs"]), (2, ["x"])], "doc_id long, values array<string>"))) == [(2, "class_text", "name")]


def test_claims(spark):
    nodes, seen = setup(spark)
    c = contract(spark, [(1, "phone", "(212) 555-0100"), (1, "email", "x@Y.zz"), (1, "established", "1999"), (1, "years", "25"), (1, "radius", "50"), (1, "image", "/a.png"), (1, "action", "/ok"), (1, "form_action", "/else"), (2, "form_action", "/send")])
    assert rules(A.check_contacts(seen, c)) == [(1, "address_outside_source", "12 Oak Street."), (1, "phone_outside_source", "3135550199")]
    assert rules(A.check_tenure(seen, c)) == [(1, "generic_tenure", "for many years"), (1, "years_in_business", "20")]
    assert rules(A.check_locations(seen, c)) == [(1, "radius_outside_source", "30")]
    assert rules(A.check_images(P.images(nodes), c)) == []
    assert rules(A.check_actions(P.links(nodes), c)) == [(1, "action_outside_source", "javascript:alert(1)")]
    assert [r[:2] for r in rules(A.check_form(nodes, c))] == [(1, "form"), (2, "form")]
    assert rules(A.check_placeholders(seen, spark.createDataFrame([("[CITY]",)], "token string"))) == [(1, "placeholder", "[CITY]"), (1, "placeholder", "{{NAME}}")]
    assert {r[1] for r in rules(A.check_testimonials(nodes, seen))} == {"testimonial_tag", "attributed_prose"}
    assert rules(A.check_required_values(seen, spark.createDataFrame([(1, "212 555 0100"), (2, "absent")], "doc_id long, value string"))) == [(2, "required_value", "absent")]
    exact = spark.createDataFrame([(1, "serving you", "serving you since 1998"), (1, "call", "call 212-555-0100")], "doc_id long, trigger string, phrase string")
    assert rules(A.check_exact_claims(seen, exact)) == [(1, "exact_claim", "serving you")]
    assert rules(A.check_forbidden_phrases(seen, ["oak street", "silver"])) == [(1, "forbidden_phrase", "oak street")]


def test_reviews_are_a_multiset(spark):
    kind = "doc_id long, author string, rating double, date string, platform string, text string"
    cards = spark.createDataFrame([(1, "a", 5.0, "May", "Web", "t"), (1, "a", 5.0, "May", "Web", "t"), (1, "b", 4.0, "May", "Web", "u"), (1, "c", 4.0, "June", "Web", "v")], kind)
    sources = [(1, "a", 5.0, "may", "web", "t"), (1, "b", 4.0, "May", "Web", "u"), (1, "c", 4.0, "May", "Web", "v")]
    assert [r[2] for r in rules(A.check_review_cards(cards, spark.createDataFrame(sources, kind)))] == ["a", "c"]


def test_verdicts_and_attempts(spark):
    v = spark.createDataFrame([(1, "late", ""), (1, "early", ""), (3, "new", "")], "doc_id long, rule_id string, evidence string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r["doc_id"]: (r["admitted"], r["first_rule"], r["n_violations"]) for r in A.verdicts(docs, v, ["early", "late"]).collect()} == {1: (False, "early", 2), 2: (True, None, 0), 3: (False, "new", 1)}
    a = spark.createDataFrame([(1, 1, False, "x", "h1"), (1, 2, True, None, "h2"), (2, 1, True, None, "g1"), (3, 1, False, "y", "k"), (3, 3, True, None, "k3")], "doc_id long, attempt int, admitted boolean, first_rule string, html string")
    assert {r["doc_id"]: (r["attempt"], r["html"], r["previous_error"]) for r in A.pick_attempt(a).collect()} == {1: (2, "h2", "x"), 2: (1, "g1", None)}
    b = spark.createDataFrame([(1, "length", "<body></body>"), (2, "stop", " "), (3, None, "<body>x</body>"), (4, "stop", "<div>")], "doc_id long, finish_reason string, html string")
    assert rules(A.check_complete(b)) == [(1, "complete", "length"), (2, "complete", "empty")] and (4, "frame", "begin") in rules(A.check_frame(b))


def test_catalogs(spark):
    t = spark.createDataFrame([('<style>.a-b, .c:hover{display:flex} .d{text-transform:uppercase}</style><p class="x y">[CITY] [no]</p>',)], "text string")
    assert [r["class"] for r in K.class_vocab(t).collect()] == ["a-b", "c", "d", "x", "y"]
    assert {(r["selector"], r["role"]) for r in K.css_class_roles(t).collect()} == {(".a-b", "layout"), (".c:hover", "layout"), (".d", "transform")}
    tokens = K.bracket_tokens(t)
    assert [r["token"] for r in tokens.collect()] == ["[CITY]"]
    recs = spark.createDataFrame([(1, ["Fix [CITY]"]), (2, ["x"])], "id int, services array<string>")
    assert [(r["id"], r["token"]) for r in K.forbidden_tokens(tokens, recs, "id").collect()] == [(2, "[CITY]")]
    s = spark.createDataFrame([("Plumber ", "allowed_themes: civic, bogus, warm")], "heading string, body string")
    assert [(r["trade"], r["theme"]) for r in K.trade_themes(s, ["civic", "warm"]).orderBy("ord").collect()] == [("plumber", "civic"), ("plumber", "warm")]
    df = spark.createDataFrame([("We are Licensed and Licensed Pros today", ["licensed", "Licensed Pros"])], "t string, p array<string>")
    assert df.select(K.redact(F.col("t"), F.col("p"))).first()[0] == "We are and today"
    df = spark.createDataFrame([("x<!-- A -->1<!-- /A --><!-- B -->2<!-- /B -->", "aggregate")], "t string, m string")
    assert df.select(K.keep_branch(F.col("t"), F.col("m"))).first()[0] == "x2"


def test_documents(spark):
    q = spark.createDataFrame([(1, 0, "about", "u0", 2, True, "A"), (1, 1, "about", "u1", 1, True, "B"), (1, 2, "contact", "u2", 1, False, "C"), (1, 3, "blog", "u3", 1, True, "D"), (1, 4, "contact", "u4", 3, True, "E")], "doc_id long, pos int, page_type string, url string, priority int, fetchable boolean, label string")
    assert [r["url"] for r in D.enrichment_queue(q, ["about", "contact"]).collect()] == ["u1"]
    assert D.contact_page(q).first()["contact_url"] == "u2"
    assert D.remaining_pages(q, q.where("url = 'u1'")).first()["labels"] == "A, C, D"
    df = spark.createDataFrame([("bad", "#80ff00")], "a string, b string")
    assert tuple(df.select(D.first_color(F.col("a"), F.col("b")), D.darken(F.col("b"))).first()) == ("#80FF00", "#60BF00")
    one = contract(spark, [(1, "phone", " 5 "), (1, "phone", "6")])
    assert [(r["value"], r["ord"]) for r in D.contract_values(one, contract(spark, [(1, "phone", "5"), (1, "phone", "")])).orderBy("ord").collect()] == [("5", 1), ("6", 2)]
    ch = spark.createDataFrame([(1, 2, "contact", 0, "c2"), (1, 1, "contact", 0, "c1"), (1, 3, "about", 2, "a"), (1, 4, "faq", 0, "f")], "doc_id long, pos int, page_type string, n_items int, body string")
    r = D.merge_enrichment(spark.createDataFrame([(1,), (2,)], "doc_id long"), ch).orderBy("doc_id").collect()
    assert (r[0]["contact"], r[0]["sections"], r[1]["sections"]) == ("c1", ["a"], [])
