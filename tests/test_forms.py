from pyspark.sql import functions as F

from pagewarrant.operators import forms as Fm
from pagewarrant.operators import ground as G
from pagewarrant.sources import dom
from pagewarrant.streaming import pages as S

HTML = """<body><main><h1>T</h1><form id=f action="/a" method=POST><label>Name <input name=n></label><label for=m>Mail</label><input id=m><input type=hidden><button>Go</button></form>
<input form=f placeholder="Phone"><input form=zz title="Lost"><form id=g action="/b"><button formaction="/c" formmethod="bogus">X</button><button>Y</button></form>
<fieldset disabled><legend><button>L</button></legend><button>D</button></fieldset><a href="/z" inert>I</a><a id=k href="/k" aria-labelledby="n1 n2">K</a><span id=n1>One</span><span id=n2 aria-labelledby=n3>no</span><i id=n3>Two</i>
<b id=c1 aria-labelledby=c2>c</b><b id=c2 aria-labelledby=c1>d</b></main><section><article><p>red shoe</p><p>ten dollars</p></article></section></body>"""


def nodes(spark):
    return dom.explode_dom(spark.createDataFrame([(1, HTML)], "page_id long, html string"))


def test_forms(spark):
    n = nodes(spark)
    labels = {r["label"] for r in Fm.control_labels(n).collect()}
    assert labels == {"Name", "Mail", "Phone", "Lost"}
    assert sorted((r["label"], r["endpoint"]) for r in Fm.form_controls(n).collect()) == [("Mail", "/a"), ("Name", "/a"), ("Phone", "/a")]
    assert sorted((r["endpoint"], r["method"]) for r in Fm.form_submission(n).collect() if r["endpoint"]) == [("/a", "post")] and Fm.form_submission(n).count() == 2
    assert Fm.form_owner(n).where("invalid").count() == 1
    claims = spark.createDataFrame([(1, 1, "0", "name", None, 1), (1, 1, "1", "phone", None, 1)], "doc_id long, page_id long, path string, value string, value2 string, group_id int")
    assert G.ground_form_fields(claims, Fm.form_controls(n)).first()["endpoint"] == "/a"


def test_actions_names_and_scopes(spark):
    n = nodes(spark)
    names = {r["node_id"]: r["name"] for r in Fm.accessible_names(n).collect()}
    usable = {names[r["node_id"]] for r in Fm.available_actions(n).collect()}
    assert {"Go", "L", "X", "Y", "One Two"} == usable
    by_id = {r["fragment"]: names[r["scope_id"]] for r in Fm.target_scopes(n).collect()}
    assert by_id["c1"] == "" and by_id["n2"] == "Two"
    assert {r["tag"] for r in Fm.section_scopes(n).collect()} == {"main", "section", "article"}
    scoped = Fm.scope_texts(n, Fm.record_scopes(n))
    claims = spark.createDataFrame([(1, 1, "a", "red shoe", None, 1), (1, 1, "b", "ten dollars", None, 1)], "doc_id long, page_id long, path string, value string, value2 string, group_id int")
    assert G.ground_items(claims, scoped).first()["scope_id"] is not None


def test_micro_batch_and_rules(spark, tmp_path):
    claims = spark.createDataFrame([(1, 1, "a", "red shoe", None, 1), (2, 2, "b", "red", None, 1)], "doc_id long, page_id long, path string, value string, value2 string, group_id int")
    pages = spark.createDataFrame([(1, "u", HTML)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(S.ground_batch(claims, f"{tmp_path}/out"))
    stream.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["path"], r["grounded"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", True)]
    S.register_rule("short", lambda t: t.where("length(html) < 5").select(F.col("page_id").alias("doc_id"), F.lit("short").alias("rule_id"), F.col("html").alias("evidence")))
    assert S.run_rules(pages, ["short"]).count() == 0 and S.run_rules(pages.withColumn("html", F.lit("x"))).count() == 1
