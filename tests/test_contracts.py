"""Contract operators on small fixtures, and registered queries against their SQL."""

import duckdb
import pytest

from pagewarrant.operators import audit as A
from pagewarrant.operators import contracts as C
from pagewarrant.operators import pages as P
from pagewarrant.plans import audits, registry
from pagewarrant.sources import dom

PAGE = """<body><nav><a href="tel:+1-555-200-3000">Call (555) 200-3000</a><a href="mailto:Me%40b.org?subject=x">Write</a><a href="tel:">none</a></nav>
<section id="our work"><h2>Our work</h2><p>Art school in Springfield</p></section><div class="ft-address">12 Main St., Town</div><p hidden class="promise">kept</p></body>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return dom.explode_dom(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).cache()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_contact_links(nodes):
    got = _rows(C.contact_links(P.links(nodes)).select("scheme", "destination", "context"))
    assert got == [("mailto", "Me@b.org", "Write Me@b.org"), ("tel", "+1-555-200-3000", "Call (555) 200-3000")]


def test_expected_contacts(spark, nodes):
    links, seen = P.links(nodes), A.surfaces(nodes)
    contract = lambda kind, value: spark.createDataFrame([(1, kind, value)], "doc_id long, kind string, value string")
    assert _rows(C.check_phone(seen, links, contract("phone", "555 200 3000"))) == []
    assert {r[1] for r in _rows(C.check_phone(seen, links, contract("phone", "555 200 3001")))} == {"unexpected_phone", "unexpected_phone_target"}
    assert {r[1] for r in _rows(C.check_phone(seen, links.where("false"), contract("phone", "555 200 3000")))} == {"missing_phone_target"}
    assert _rows(C.check_email(seen, links, contract("email", "me@B.org"))) == [] and len(_rows(C.check_email(seen, links, contract("email", None)))) == 1
    for value, bad in (("12 main st", []), ("12 Main St. Other", ["differs"]), (None, ["unverified"])):
        assert [r[2] for r in _rows(C.check_address(nodes, contract("address", value)))] == bad
    assert [r[2] for r in _rows(C.check_rendered(nodes, spark.createDataFrame([(1, "promise")], "doc_id long, class string")))] == ["promise"]


def test_grounding_of_targets_headings_and_names(spark, nodes):
    from pagewarrant.operators import forms

    claim = lambda *values: spark.createDataFrame([(1, 1, str(k), "x", v, None, 0) for k, v in enumerate(values)], "doc_id long, page_id long, path string, kind string, value string, value2 string, group_id int")
    got = C.ground_target(claim("#our%20work", "/p#our work", "#gone"), nodes.where("kind = 'el'").select("page_id", P.attr("id").alias("target_id")).where("target_id is not null"))
    assert [r["grounded"] for r in got.orderBy("path").collect()] == [True, True, False]
    assert [r["grounded"] for r in C.ground_heading(claim("our work", "springfield"), P.headings(nodes)).orderBy("path").collect()] == [True, False]
    assert [r["grounded"] for r in C.ground_identity(claim("The  Shop", "shop"), spark.createDataFrame([(1, "the shop")], "page_id long, identity string")).orderBy("path").collect()] == [True, False]
    assert forms is not None


def test_whole_words_and_exact_claims(spark):
    df = spark.createDataFrame([("We start at 24/7, A.R.T. here", "art"), ("We start", "art"), ("open 24/7", "24 7"), ("247", "24/7"), ("x", "")], "s string, p string")
    assert [r[0] for r in df.select(C.contains_tokens(df.s, df.p)).collect()] == [True, False, True, True, False]
    seen = spark.createDataFrame([(1, "Master Licensed, #7 and again Master Licensed, #7."), (2, "Master Licensed, #7, then Master Licensed."), (3, "none")], "doc_id long, text string")
    claims = spark.createDataFrame([(k, "Master Licensed", "Master Licensed, #7") for k in (1, 2, 3)], "doc_id long, trigger string, phrase string")
    assert [r["doc_id"] for r in A.check_exact_claims(seen, claims).collect()] == [2]
    docs = spark.createDataFrame([(1, "<!DOCTYPE html><html></html>"), (2, "<html></html>"), (3, "<!doctype html><p>")], "doc_id long, html string")
    assert _rows(A.check_document(docs).select("doc_id", "evidence")) == [(2, "begin"), (3, "end")]


@pytest.mark.parametrize("module", [registry, audits])
def test_queries_match_their_sql(spark, module):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "customer supplier part orders lineitem events documents pages conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in module.ORACLE_SQL.items():
        df = module.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        want = sorted(repr(r) for r in db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
        assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want, name
