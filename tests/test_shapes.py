"""Nested shapes, error by error."""

import json

from pagewarrant.operators import shapes as S


def test_rules():
    rows = {r[0]: r for r in S.shape_rules(S.SITE_SHAPE)}
    assert len(rows) == len(S.SITE_SHAPE) + 1 and rows[""][4] == ["site"] and set(rows["nav[]"][5]) == {"label", "url"} and rows["nav[].label"][6] == 3
    assert rows["pages_to_fetch[].priority"][3] == ["1", "3"] and rows["site.tagline"][2] and not rows["site.name"][2] and rows["brand.colors.raw[]"][1] == "text"


def test_errors(spark):
    good = {"site": {"name": "A", "tagline": None, "type": "news", "contact": {"addresses": ["x"]}}, "nav": [{"label": "a", "url": "/"}], "pages_to_fetch": [{"label": "a", "url": "/", "page_type": "faq", "priority": 3, "fetchable": True}], "homepage_blueprint": {"section_sequence": ["hero"]}}
    with_ = lambda **kw: json.dumps({**good, **kw})
    site = lambda **kw: with_(site={"name": "A", **kw})
    page = lambda **kw: with_(pages_to_fetch=[good["pages_to_fetch"][0], {**good["pages_to_fetch"][0], **kw}])
    cases = [
        (json.dumps(good), None), ("[1]", ("", "no_object")), ("{", ("", "no_object")), (None, ("", "no_object")), ('{"nav": []}', ("", "missing")), (with_(odd=1), ("", "unknown")), (site(tagline=3), ("site.tagline", "type")),
        (site(type="x"), ("site.type", "option")), (site(name=""), None), (site(contact={"addresses": ["x", 5]}), ("site.contact.addresses.1", "type")), (page(priority=4), ("pages_to_fetch.1.priority", "bounds")),
        (page(priority="2"), ("pages_to_fetch.1.priority", "type")), (page(more=1), ("pages_to_fetch.1", "unknown")), (page(fetchable=None), ("pages_to_fetch.1.fetchable", "type")), (with_(nav=[{"label": "a"}]), ("nav.0", "missing")), (with_(nav=[3]), ("nav.0", "type")),
        (with_(nav=[good["nav"][0]] * 201), ("nav", "length")), (site(tagline="x" * 20_001), ("site.tagline", "length")), (site(tagline="x" * 200_001), ("", "too_large")), (with_(homepage_blueprint={"section_sequence": ["hero", "odd"]}), ("homepage_blueprint.section_sequence.1", "option")),
        (with_(nav=[good["nav"][0]] * 11 + [{"label": 1, "url": "/"}], brand={"fonts": {"body": 7}}), ("brand.fonts.body", "type")), (with_(nav=[good["nav"][0]] * 11 + [{"label": 1, "url": 2}]), ("nav.11.label", "type")), (with_(cta=None), ("cta", "type")), (with_(nav=[{"label": "a", "url": "u" * 8_193}]), ("nav.0.url", "length")),
    ]
    cases[8] = (site(name=" \u00a0"), ("site.name", "blank"))
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, json string")
    got = {r["doc_id"]: (r["path"], r["rule_id"]) for r in S.first_errors(S.shape_errors(docs, "json")).collect()}
    assert {k: got.get(k) for k in range(len(cases))} == {k: want for k, (_, want) in enumerate(cases)}


def test_documents_are_walked_once(spark):
    docs = spark.createDataFrame([(1, '{"site": {"name": 3}, "nav": [{"label": " ", "odd": []}]}')], "doc_id long, json string")
    errors = S.shape_errors(docs, "json")
    levels = max(r[-1] for r in S.shape_rules(S.SITE_SHAPE)) + 1
    assert errors._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1 + levels  # the documents, and the rules of each level
    assert sorted((".".join(r["path"]), r["rule_id"]) for r in errors.collect()) == [("nav.000000", "missing"), ("nav.000000", "unknown"), ("nav.000000.label", "blank"), ("site.name", "type")]
