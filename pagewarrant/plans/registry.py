"""Queries over orders, customers, parts and line items as evidence cards, manifests, catalogs, site documents and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalogs as K
from ..operators import contracts as C
from ..operators import documents as S
from ..operators import evidence as E
from ..operators import records as R
from ..operators import shapes as Z

AS_OF, DAYS = "2000-06-30", 90


def _table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cards(spark, sf_dir) -> DataFrame:
    """Orders as cards: dates as text, some malformed, some impossible."""
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    k, checked = F.col("o_orderkey"), F.date_add("o_orderdate", (F.col("o_custkey") % 40).cast("int"))
    return _table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("file"), k.alias("line"), F.concat(F.lit("C"), "o_custkey").alias("id"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 40).alias("tag"),
        F.when(k % 50 == 0, "2026-02-30").when(k % 50 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(day(F.col("o_orderdate"))).alias("source_date"),
        day(checked).alias("source_checked_at"), day(F.date_add(checked, (DAYS - k % 3 * 60).cast("int"))).alias("expires_at"), F.concat(F.lit("https://h.example/"), k).alias("source_url"),
        F.parse_json(F.concat(F.lit('{"note": "'), F.when(k % 4 == 0, "about 12 USD").when(k % 4 == 1, "from $5").otherwise("ten units"), F.lit('"'), F.when(k % 9 == 0, ', "list_price": 3').otherwise(""), F.lit("}"))).alias("numbers"),
    )


def card_fields(spark, sf_dir):
    """Missing and empty fields of orders written as JSON objects."""
    k = F.col("o_orderkey")
    fields = {f: F.lit("x") for f in E.SCALARS} | {"id": F.when(k % 7 != 0, F.col("o_custkey").cast("string")), "summary": F.when(k % 5 == 0, " ").otherwise("s"), "vendor": F.when(k % 11 != 3, "v")}
    row = F.struct(*[v.alias(f) for f, v in fields.items()], F.when(k % 6 != 5, F.named_struct(F.lit("n"), k)).alias("numbers"))
    objects = _table(spark, sf_dir, "orders").select(F.lit("orders").alias("file"), k.alias("line"), F.to_json(row).alias("text"))
    return E.check_required(E.cards_of(objects.withColumn("row", F.parse_json("text")))).select("line", "rule_id", "detail")


def duplicate_cards(spark, sf_dir):
    return E.check_duplicates(_cards(spark, sf_dir)).select("line", "rule_id", "detail")


def card_dates(spark, sf_dir):
    """Malformed dates of cards, and what is wrong with sound ones."""
    sound, errors = E.parse_dates(_cards(spark, sf_dir))
    return errors.select("line", "rule_id", "detail").unionByName(E.check_dates(sound, AS_OF, DAYS).select("line", "rule_id", F.lit("").alias("detail")))


def stale_cards(spark, sf_dir):
    return E.stale(E.parse_dates(_cards(spark, sf_dir))[0], AS_OF).select("line", "id", "expires_at", "source_url")


def card_stats(spark, sf_dir):
    return E.card_stats(E.parse_dates(_cards(spark, sf_dir))[0], AS_OF, DAYS)


def tag_gaps(spark, sf_dir):
    """Tags of cards, of parts as a router and of large parts as frames."""
    part = _table(spark, sf_dir, "part")
    return E.check_tags(_cards(spark, sf_dir), part.select(F.col("p_brand").alias("tag")), part.where("p_size > 48 and p_partkey % 3 = 0").select(F.col("p_brand").alias("tag")))


def _manifest(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("field"), F.col("c_mktsegment").alias("value"), F.when(k % 6 == 0, " ").when(k % 6 < 3, "curated").otherwise("derived").alias("source"), F.when(k % 4 == 0, F.array(F.lit("page"))).alias("verify_against"), k.alias("key")
    )


def manifest_errors(spark, sf_dir):
    return E.check_manifest(_manifest(spark, sf_dir))


def manifest_drift(spark, sf_dir):
    """Fields whose value drifted from their source, and the manifest after the upsert."""
    own = _manifest(spark, sf_dir)
    source = own.where("key % 5 < 2").select("field", F.when(F.col("key") % 5 == 0, F.lower("value")).otherwise(F.col("value")).alias("value"))
    source = source.unionByName(own.where("key % 100 = 7").select(F.concat("field", F.lit("-new")).alias("field"), "value"))
    after = E.upsert_fields(own.select("field", "value"), source).select("field", F.lit("after").alias("old"), F.col("value").alias("new"))
    return E.sync_fields(own.select("field", "value"), source).select("field", "old", "new").unionByName(after)


def channel_lists(spark, sf_dir):
    """Market segments as shipped channels against a list, and those of rich customers as targets."""
    c = _table(spark, sf_dir, "customer")
    names = lambda df, f: df.agg(F.to_json(F.sort_array(F.collect_set("c_mktsegment"))).alias("value")).select(F.lit(f).alias("field"), "value")
    return E.check_lists(names(c, "channels_shipped").unionByName(names(c.where("c_acctbal > 0"), "channels_target")), ["AUTOMOBILE"])


def evidence_bundles(spark, sf_dir):
    """Context texts of orders: sections by status, priority and brand, then their brand's parts."""
    o, p = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "part")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("angle"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 40).alias("tag"))
    section = lambda kind, key, ord_: o.select(key.alias("key")).distinct().select(F.lit(kind).alias("kind"), "key", F.lit(ord_).alias("ord"), F.concat(F.lit(kind + " "), "key").alias("body"))
    sections = section("channel", F.col("o_orderstatus"), 1).unionByName(section("angle", F.col("o_orderpriority"), 2))
    sections = sections.unionByName(o.select(F.lit("base").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("ord"), F.lit("base").alias("body")).distinct())
    cards = p.select(F.col("p_brand").alias("tag"), F.col("p_partkey").alias("line"), F.to_json(F.struct("p_name")).alias("json"))
    return E.bundles(requests, sections, cards)


def _pages_to_fetch(spark, sf_dir) -> DataFrame:
    """Line items as pages of an order's site."""
    at = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), at.alias("pos"), F.when(F.col("l_returnflag") == "A", "contact").when(F.col("l_returnflag") == "N", "about").otherwise("news").alias("page_type"),
        F.concat(F.lit("https://h.example/"), "l_partkey").alias("url"), F.concat(F.lit("p"), "l_partkey").alias("label"), (F.col("l_quantity").cast("int") % 4).alias("priority"), (F.col("l_linestatus") == "O").alias("fetchable"), F.col("l_discount").alias("discount"),
    )


def enrichment_queue(spark, sf_dir):
    return S.enrichment_queue(_pages_to_fetch(spark, sf_dir), ["contact", "about"]).select("doc_id", "page_type", "pos", "priority")


def remaining_pages(spark, sf_dir):
    p = _pages_to_fetch(spark, sf_dir)
    return S.remaining_pages(p, p.where("discount > 0.05"))


def site_documents(spark, sf_dir):
    """Orders with their contact page, their first contact chunk and the chunks that have items."""
    p = _pages_to_fetch(spark, sf_dir)
    chunks = p.select("doc_id", "pos", "page_type", F.col("priority").alias("n_items"), F.col("label").alias("body"))
    docs = S.merge_enrichment(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), chunks).join(S.contact_page(p), "doc_id", "left")
    return docs.select("doc_id", "contact", F.array_join("sections", ", ").alias("sections"), "contact_url")


def contract_values(spark, sf_dir):
    """First-seen distinct flags and statuses of an order's line items, line items before the order itself."""
    item = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("flag").alias("kind"), F.concat(F.lit(" "), "l_returnflag").alias("value"), F.col("l_linenumber").cast("long").alias("ord"))
    order = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("flag").alias("kind"), F.col("o_orderstatus").alias("value"))
    return S.contract_values(item, order)


def record_colors(spark, sf_dir):
    """First sound colour of a customer by preference, darkened; yearly cost and five years' saving of its platform; hero images."""
    k = F.col("c_custkey")
    color = F.concat(F.lit("#"), F.substring(F.md5(F.col("c_name").cast("binary")), 1, 6))
    first = S.first_color(F.when(k % 3 == 0, F.lit("blue")).otherwise(color), F.when(k % 5 == 0, F.lit("#12")), F.lit("#1d4ed8"))
    cost, saving = S.platform_cost(k % 50)
    images = F.when(k % 4 != 0, F.array(F.struct(F.when(k % 2 == 0, "hero").otherwise("logo").alias("context"))))
    return _table(spark, sf_dir, "customer").select("c_custkey", first.alias("color"), S.darken(first).alias("dark"), cost.alias("yearly"), saving.alias("saving"), S.needs_hero(images, F.when(k % 7 == 0, "a prompt")).alias("needs_hero"))


def token_catalogs(spark, sf_dir):
    """Bracket tokens of part texts that a supplier's own names do not hold."""
    part = _table(spark, sf_dir, "part").select(F.concat(F.lit("make ["), F.col("p_type"), F.lit("] of [x]")).alias("text"))
    own = _table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.concat(F.lit("fix [STANDARD] "), "s_name"), F.when(F.col("s_suppkey") % 2 == 0, "[PROMO]").otherwise("none")).alias("services"))
    return K.forbidden_tokens(K.bracket_tokens(part), own, "s_suppkey")


def branch_texts(spark, sf_dir):
    """Prompt texts with the branch that a part's size asks for, without its type's first word."""
    text = F.concat(F.lit("<!-- A -->cards "), "p_name", F.lit("<!-- /A --><!-- B -->sum of small things<!-- /B -->"), F.lit(" <!-- C -->no small  reviews<!-- /C -->"))
    mode = F.when(F.col("p_size") % 3 == 0, "cards").when(F.col("p_size") % 3 == 1, "aggregate").otherwise("omit")
    return _table(spark, sf_dir, "part").select("p_partkey", K.redact(K.keep_branch(text, mode), F.array(F.lit("small"), F.lit("small things"), F.lit("RING"))).alias("text"))


def trade_catalogs(spark, sf_dir):
    """Themes that sections named after parts allow."""
    part = _table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "), "p_partkey").alias("heading"), F.concat(F.lit("Text\n- allowed_themes: "), F.lower("p_type"), F.lit(", "), "p_name").alias("body"))
    return K.trade_themes(part, ["promo", "economy", "ring", "small", "large"])


def template_classes(spark, sf_dir):
    """Classes of templates made of parts, by page kind, and roles of their selectors."""
    kind = F.lower("p_type")
    text = F.concat(F.lit('<style>.page-'), kind, F.lit("{display:flex}.card-"), kind, F.lit(", .up{ text-transform: uppercase }</style><div class='page-"), kind, F.lit(" b"), F.col("p_size"), F.lit("'>"))
    templates = _table(spark, sf_dir, "part").select(text.alias("text"))
    kinds = K.page_class_sets(K.class_vocab(templates), ["page-promo"]).select(F.col("class").alias("name"), F.col("page_kind").alias("kind"))
    return kinds.unionByName(K.css_class_roles(templates).select(F.col("selector").alias("name"), F.col("role").alias("kind")))


def _records(spark, sf_dir) -> DataFrame:
    """Customers as business records, some with blanks and template defaults."""
    k, low = F.col("c_custkey"), F.lower("c_mktsegment")
    review = lambda r: F.struct(F.when(k % 6 == 0, " ").otherwise(low).alias("author"), F.lit("fine").alias("text"), F.lit("2020").alias("date"), F.when(k % 7 == 0, "example.com").otherwise("maps").alias("platform"), r.cast("double").alias("rating"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 11 == 0, " ").when(k % 13 == 0, "TODO name").otherwise(F.concat("c_name", F.lit(", Inc."))).alias("business_name"), low.alias("trade"), F.when(F.col("c_nationkey") != 3, "town").alias("city"), F.lit("IL").alias("state"),
        F.when(k % 17 == 0, "(replace)").otherwise("555 0100").alias("phone"), F.when(k % 9 == 0, "a@example.com").otherwise("a@b.org").alias("owner_email"),
        F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(" "), low, F.lit("  work")), F.when(k % 8 == 0, F.concat(F.upper(low), F.lit(" WORK"))).otherwise("other"), F.when(k % 12 == 5, F.repeat(F.lit("long "), 20)).otherwise("third"))).alias("services"),
        F.when(k % 5 != 4, F.array(review(F.lit(5)), review(k % 7), review(F.lit(3)))).alias("reviews"), (k % 7).cast("double").alias("score"), (k % 3).cast("int").alias("score_count"), (1890 + k % 150).cast("int").alias("founded"), F.lit(4).alias("given"),
        F.when(k % 4 == 0, F.array(F.lit("Free Estimates and 24/7 help"), F.lit("No surprise fees"))).alias("promises"), (k % 3 == 0).alias("family_owned"), (k % 2 == 0).alias("licensed_and_insured"),
    )


def record_checks(spark, sf_dir):
    """Blank required fields, and what is wrong with the services, of each customer record."""
    df = _records(spark, sf_dir)
    bad = R.normalize_services(df).where("services_error is not null").select(F.col("c_custkey").alias("doc_id"), F.lit("services").alias("rule_id"), F.col("services_error").alias("path"))
    return R.check_fields(df, "c_custkey").unionByName(bad)


def record_values(spark, sf_dir):
    """Scrubbed fields, usable reviews and their mode, tenure, display name, and claims that nothing verifies."""
    df = R.usable_reviews(R.scrub_placeholders(_records(spark, sf_dir)))
    both = R.unverified_claims(F.col("promises"), {c: F.col(c) for c in ("family_owned", "licensed_and_insured")})
    return df.select(
        "c_custkey", "phone", "owner_email", F.array_join("placeholder_warnings", ",").alias("warnings"), F.size("reviews").alias("n_reviews"), "dropped_reviews", R.review_mode(F.col("reviews"), R.review_aggregate(F.col("score"), F.col("score_count"))).alias("mode"),
        R.years_in_business(F.col("founded"), F.col("given"), F.lit(2026)).alias("years"), R.display_name(F.col("business_name")).alias("display"), F.array_join(both, "; ").alias("unverified"), F.array_join(R.verified_claims(both), "; ").alias("verified"),
    )


def token_usage(spark, sf_dir):
    """Line items as model calls: cached and uncached amounts by flag."""
    n = lambda c: F.col(c).cast("long")
    return R.usage_stats(_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.when(F.col("l_linenumber") != 3, n("l_quantity")).alias("cache_read"), n("l_suppkey").alias("cache_write"), n("l_partkey").alias("total")))


def edited_records(spark, sf_dir):
    k = F.col("c_custkey")
    base = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    edits = base.where(k % 3 == 0).select("c_custkey", F.when(k % 2 == 0, " ").when(k % 9 == 0, "new").alias("c_mktsegment"))
    return R.merge_edits(base, edits, "c_custkey")


def record_contracts(spark, sf_dir):
    """Form action, trust sentence, logo, hooks, names and themes of customers as records."""
    k, low = F.col("c_custkey"), F.lower("c_mktsegment")
    photo = lambda context, url: F.struct(F.when(k % 3 == 0, url).alias("url"), F.lit(" ").alias("src"), F.concat(F.lit("/p/"), k).alias("path"), context.alias("context"))
    photos = F.when(k % 5 != 0, F.array(photo(F.lit("hero"), F.lit("h")), photo(F.when(k % 2 == 0, "logo").otherwise("team"), F.lit("https://l.example/l.png"))))
    draft = F.concat(F.when(k % 4 == 0, C.URL_TOKEN).otherwise("text"), F.lit("\n##  Before sending\n"), F.lit(C.URL_TOKEN))
    hooks = C.outreach_hooks(k % 20, (k % 6).cast("double"), k % 9, k % 5 == 0, k % 3 == 0)
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", C.form_action(F.when(k % 2 == 0, F.concat(F.lit(" https://f.example/"), k)).otherwise(" ")).alias("action"), C.trust_trailer(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("trust"),
        C.record_logo(F.when(k % 7 == 0, "own.png").otherwise(" "), photos).alias("logo"), F.array_join(hooks, ",").alias("hooks"), C.draft_has_token(draft).alias("has_token"), C.safe_name(F.concat(F.lit("a/b/.."), "c_name", F.lit(" é.HTML"))).alias("file"),
        C.site_slug(F.concat(F.when(k % 2 == 0, "https://www.").otherwise(""), low, F.lit(".example.org/x?y"))).alias("slug"), C.site_theme(F.when(k % 4 == 0, "church").otherwise(low)).alias("theme"), C.body_theme(F.when(k % 3 == 0, "dark")).alias("body"),
    )


def record_claims(spark, sf_dir):
    """Exact claim phrases of customers with a license or a local number."""
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, k.cast("string")).otherwise(" ").alias("license"), F.when(k % 6 == 0, F.concat(F.lit("IBEW Local "), k)).alias("local"))
    return C.exact_claims(df, "c_custkey", "license", "local")


def event_errors(spark, sf_dir):
    """Event types as kinds of failures, classified."""
    kind = F.when(F.col("event_type") == "error", "json").when(F.col("event_type") == "click", "unavailable").when(F.col("event_type") == "view", "body").otherwise(F.col("event_type"))
    return C.classify_errors(_table(spark, sf_dir, "events").select(kind.alias("kind"))).groupBy("kind", "error_code", "retryable").agg(F.count("*").alias("n"))


def _site_json(spark, sf_dir) -> DataFrame:
    """Suppliers as site documents in JSON, with what each has to nations and parts of its number."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    nav = F.array(F.struct(name.alias("label"), F.concat(F.lit("/"), k).alias("url")), F.struct(F.lit(" ").alias("label"), F.lit("/x").alias("url")))
    items = F.array(F.struct(F.concat(F.lit("i"), k).alias("title"), F.when(k % 2 == 0, "/i").alias("url"), F.lit("d").alias("description")))
    sections = F.when(k % 3 != 0, F.array(F.struct(F.lit("h1").alias("headline"), items.alias("items")), F.struct(F.lit(None).cast("string").alias("headline"), items.alias("items"))))
    images = F.array(F.struct(F.concat(F.lit("u"), k % 4).alias("url"), F.lit("alt").alias("alt")), F.struct(F.lit("u1").alias("url"), F.lit("").alias("alt")))
    site = F.struct(F.when(k % 5 != 0, name).alias("name"), F.lit("tag").alias("tagline"))
    doc = F.struct(site.alias("site"), F.struct(F.when(k % 2 == 0, "u1").alias("logo_url")).alias("brand"), F.when(k % 7 != 0, nav).alias("nav"), sections.alias("sections"), images.alias("images"), F.when(k % 11 == 0, 1).alias("odd"))
    return _table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.when(k % 13 == 0, "no json").otherwise(F.to_json(doc)).alias("json"))


def site_claims(spark, sf_dir):
    """Claims of suppliers' site documents, one by one."""
    docs = _site_json(spark, sf_dir).select("doc_id", F.try_parse_json("json").alias("doc"))
    return C.flatten_claims(docs)


def site_shapes(spark, sf_dir):
    """The first error in shape of each supplier's site document, and the images that sound ones may show."""
    docs = _site_json(spark, sf_dir)
    bad = C.check_shape(docs, "json", ["nav", "sections", "site"], ["site", "brand", "nav", "sections", "images"])
    shown = C.contract_images(C.flatten_claims(docs.select("doc_id", F.try_parse_json("json").alias("doc")))).select("doc_id", F.col("value").alias("path"), F.when(F.col("is_logo"), "logo").otherwise("image").alias("rule_id"))
    return bad.unionByName(shown)


#: A customer's site document, as an expression that both engines read.
_CUSTOMER_SITE = """'{"site":{"name":"' || c_name || '","type":"' || CASE WHEN c_nationkey < 12 THEN 'news' ELSE lower(c_mktsegment) END || '","tagline":' || CASE WHEN c_acctbal < 0 THEN CAST(c_nationkey AS STRING) ELSE 'null' END
 || '},"brand":{"colors":{"raw":["#fff",' || CASE WHEN c_mktsegment = 'BUILDING' THEN '7' ELSE '"#000"' END || ']}},"nav":[{"label":"Home","url":"/"},{"label":"' || CASE WHEN c_nationkey = 5 THEN ' ' ELSE c_mktsegment END
 || '"' || CASE WHEN c_acctbal > 6000 THEN '' ELSE ',"url":"/m"' END || '}],"pages_to_fetch":[{"label":"A","url":"/a","page_type":"' || CASE WHEN c_acctbal > 3000 THEN 'faq' ELSE 'odd' END || '","priority":' || CAST(c_nationkey AS STRING) || ',"fetchable":true'
 || CASE WHEN c_nationkey = 3 THEN ',"more":1' ELSE '' END || '}]}'"""


def site_errors(spark, sf_dir):
    """Every error in the nested shape of customers' site documents."""
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_CUSTOMER_SITE).alias("json"))
    return Z.shape_errors(docs, "json").select("doc_id", F.array_join("path", ".").alias("path"), "rule_id")


def site_first_errors(spark, sf_dir):
    """The first of them by path."""
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_CUSTOMER_SITE).alias("json"))
    return Z.first_errors(Z.shape_errors(docs, "json"))


def service_claims(spark, sf_dir):
    """Part names as services and claims of a supplier's site, by two words of a name as service and place."""
    p = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), "p_name", "p_partkey")
    services = p.where("p_partkey % 3 = 0").select("doc_id", F.split("p_name", " ")[1].alias("value")).distinct()
    claims = p.select("doc_id", F.concat_ws(" ", F.lit("best"), "p_name").alias("value"))
    places = p.groupBy("doc_id").agg(F.min(F.split("p_name", " ")[0]).alias("location"))
    allowed = C.contract_service_location(services, claims.where(F.length("value") % 2 == 0), places)
    return C.check_service_location(claims.withColumnRenamed("value", "text"), services, places, allowed)


QUERIES = {
    f.__name__: f
    for f in (
        card_fields, duplicate_cards, card_dates, stale_cards, card_stats, tag_gaps, manifest_errors, manifest_drift, channel_lists, evidence_bundles, enrichment_queue, remaining_pages, site_documents, contract_values, record_colors,
        site_errors, site_first_errors, token_catalogs, branch_texts, trade_catalogs, template_classes, record_checks, record_values, token_usage, edited_records,
        record_contracts, record_claims, event_errors, site_claims, site_shapes, service_claims,
    )
}

_C = f"""c AS (SELECT o_orderkey AS line, 'C' || o_custkey AS id, 'Brand#' || (o_custkey % 40) AS tag,
  CASE o_orderkey % 50 WHEN 0 THEN '2026-02-30' WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS sd,
  o_orderdate::DATE + (o_custkey % 40)::INT AS checked, o_orderdate::DATE + (o_custkey % 40)::INT + ({DAYS} - o_orderkey % 3 * 60)::INT AS expires FROM orders),
g AS (SELECT *, sd::DATE AS source FROM c WHERE line % 50 > 1)"""
_P = """p AS (SELECT l_orderkey AS doc_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'contact' WHEN 'N' THEN 'about' ELSE 'news' END AS page_type,
  'https://h.example/' || l_partkey AS url, 'p' || l_partkey AS label, l_quantity::INT % 4 AS priority, l_linestatus = 'O' AS fetchable, l_discount AS discount FROM lineitem)"""
_SEG = "lower(c_mktsegment)"
_SITE_ERRORS = f"""WITH d AS (SELECT c_custkey AS doc_id, ({_CUSTOMER_SITE})::JSON AS j FROM customer),
n AS (SELECT doc_id, unnest(range(json_array_length(j, '$.nav')::BIGINT)) AS i, unnest(from_json(json_extract(j, '$.nav'), '["JSON"]')) AS v FROM d), p AS (SELECT doc_id, unnest(range(json_array_length(j, '$.pages_to_fetch')::BIGINT)) AS i, unnest(from_json(json_extract(j, '$.pages_to_fetch'), '["JSON"]')) AS v FROM d),
r AS (SELECT doc_id, unnest(range(json_array_length(j, '$.brand.colors.raw')::BIGINT)) AS i, unnest(from_json(json_extract(j, '$.brand.colors.raw'), '["JSON"]')) AS v FROM d),
e AS (SELECT doc_id, ['site', 'type'] AS path, 'option' AS rule_id FROM d WHERE j->>'$.site.type' NOT IN ({", ".join(f"'{x}'" for x in Z._SITE_TYPES.split())})
UNION ALL SELECT doc_id, ['site', 'tagline'], 'type' FROM d WHERE json_type(j, '$.site.tagline') NOT IN ('VARCHAR', 'NULL')
UNION ALL SELECT doc_id, ['brand', 'colors', 'raw', lpad(i::VARCHAR, 6, '0')], 'type' FROM r WHERE json_type(v) <> 'VARCHAR'
UNION ALL SELECT doc_id, ['nav', lpad(i::VARCHAR, 6, '0')], 'missing' FROM n WHERE NOT json_exists(v, '$.url') OR NOT json_exists(v, '$.label')
UNION ALL SELECT doc_id, ['nav', lpad(i::VARCHAR, 6, '0'), 'label'], 'blank' FROM n WHERE trim(v->>'$.label') = ''
UNION ALL SELECT doc_id, ['pages_to_fetch', lpad(i::VARCHAR, 6, '0'), 'page_type'], 'option' FROM p WHERE v->>'$.page_type' NOT IN ({", ".join(f"'{x}'" for x in Z._PAGE_TYPES.split())})
UNION ALL SELECT doc_id, ['pages_to_fetch', lpad(i::VARCHAR, 6, '0'), 'priority'], 'bounds' FROM p WHERE (v->>'$.priority')::INT NOT BETWEEN 1 AND 3
UNION ALL SELECT doc_id, ['pages_to_fetch', lpad(i::VARCHAR, 6, '0')], 'unknown' FROM p WHERE len(list_filter(json_keys(v), lambda k: k NOT IN ('label', 'url', 'page_type', 'priority', 'fetchable'))) > 0)"""
ORACLE_SQL = {
    "card_fields": """WITH o AS (SELECT o_orderkey AS line, list_filter(['id', 'numbers', 'vendor'], lambda f: (f = 'id' AND o_orderkey % 7 = 0) OR (f = 'vendor' AND o_orderkey % 11 = 3) OR (f = 'numbers' AND o_orderkey % 6 = 5)) AS m FROM orders)
SELECT line, CASE WHEN len(m) > 0 THEN 'missing_fields' ELSE 'empty_fields' END AS rule_id, CASE WHEN len(m) > 0 THEN array_to_string(m, ', ') ELSE 'summary' END AS detail FROM o WHERE len(m) > 0 OR line % 5 = 0""",
    "duplicate_cards": f"WITH {_C}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS n FROM c) SELECT line, 'duplicate_id' AS rule_id, id AS detail FROM n WHERE n > 1",
    "card_dates": f"""WITH {_C}, r AS (SELECT line, unnest([CASE WHEN expires <> checked + {DAYS} THEN 'expiry' END, CASE WHEN expires < checked THEN 'expires_before_check' END,
  CASE WHEN source > DATE '{AS_OF}' THEN 'future_source_date' END, CASE WHEN checked > DATE '{AS_OF}' THEN 'future_check' END]) AS rule_id FROM g)
SELECT line, rule_id, '' AS detail FROM r WHERE rule_id IS NOT NULL UNION ALL SELECT line, CASE WHEN line % 50 = 0 THEN 'not_a_date' ELSE 'not_iso' END, 'source_date' FROM c WHERE line % 50 < 2""",
    "stale_cards": f"WITH {_C} SELECT line, id, expires AS expires_at, 'https://h.example/' || line AS source_url FROM g WHERE expires < DATE '{AS_OF}'",
    "card_stats": f"""WITH {_C} SELECT count(*) AS cards, count(*) FILTER (line % 4 < 2 OR line % 9 = 0) AS price_cards, count(*) FILTER (expires < DATE '{AS_OF}') AS stale_cards,
  sum((source > DATE '{AS_OF}')::INT + (checked > DATE '{AS_OF}')::INT)::BIGINT AS future_cards, {DAYS} AS freshness_days FROM g""",
    "tag_gaps": f"""WITH {_C}, a AS (SELECT DISTINCT tag FROM c), r AS (SELECT DISTINCT p_brand AS tag FROM part), f AS (SELECT DISTINCT p_brand AS tag FROM part WHERE p_size > 48 AND p_partkey % 3 = 0),
g3 AS (SELECT 'not_in_router' AS rule_id, tag FROM a WHERE tag NOT IN (SELECT tag FROM r) UNION ALL SELECT 'router_without_evidence', tag FROM r WHERE tag NOT IN (SELECT tag FROM a) UNION ALL SELECT 'router_without_frame', tag FROM r WHERE tag NOT IN (SELECT tag FROM f))
SELECT rule_id, string_agg(tag, ', ' ORDER BY tag) AS detail FROM g3 GROUP BY 1""",
    "manifest_errors": "SELECT c_name AS path, CASE WHEN c_custkey % 6 = 0 THEN 'no_source' ELSE 'curated_without_check' END AS rule_id FROM customer WHERE c_custkey % 6 = 0 OR (c_custkey % 6 < 3 AND c_custkey % 4 <> 0)",
    "manifest_drift": """SELECT c_name AS field, c_mktsegment AS old, lower(c_mktsegment) AS new FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT c_name || '-new', NULL, c_mktsegment FROM customer WHERE c_custkey % 100 = 7 UNION ALL SELECT c_name || '-new', 'after', c_mktsegment FROM customer WHERE c_custkey % 100 = 7
UNION ALL SELECT c_name, 'after', CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END FROM customer""",
    "channel_lists": """WITH s AS (SELECT DISTINCT c_mktsegment AS m FROM customer), t AS (SELECT DISTINCT c_mktsegment AS m FROM customer WHERE c_acctbal > 0)
SELECT 'channels_differ' AS rule_id, string_agg(m, ', ' ORDER BY m) AS detail FROM s HAVING list_sort(list(m)) <> ['AUTOMOBILE'] UNION ALL SELECT 'shipped_and_target', string_agg(m, ', ' ORDER BY m) FROM (SELECT m FROM s INTERSECT SELECT m FROM t) HAVING count(*) > 0""",
    "evidence_bundles": """WITH c AS (SELECT p_brand, string_agg('{"p_name":"' || p_name || '"}', chr(10) || chr(10) ORDER BY p_partkey) AS t FROM part GROUP BY 1)
SELECT o_orderkey AS request_id, concat_ws(chr(10) || chr(10), 'base', 'channel ' || o_orderstatus, 'angle ' || o_orderpriority, c.t) AS text FROM orders LEFT JOIN c ON c.p_brand = 'Brand#' || (o_custkey % 40)""",
    "enrichment_queue": f"WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_type ORDER BY priority, pos) AS n FROM p WHERE fetchable AND priority <= 2 AND page_type <> 'news') SELECT doc_id, page_type, pos, priority FROM n WHERE n = 1",
    "remaining_pages": f"WITH {_P} SELECT doc_id, string_agg(label, ', ' ORDER BY pos, label) AS labels FROM p WHERE priority <= 2 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.url = p.url AND q.discount > 0.05) GROUP BY 1",
    "site_documents": f"""WITH {_P}, m AS (SELECT doc_id, arg_min(label, pos) FILTER (page_type = 'contact') AS contact, string_agg(label, ', ' ORDER BY pos, label) FILTER (page_type <> 'contact' AND priority > 0) AS sections, arg_min(url, pos) FILTER (page_type = 'contact') AS contact_url FROM p GROUP BY 1)
SELECT o_orderkey AS doc_id, contact, coalesce(sections, '') AS sections, contact_url FROM orders LEFT JOIN m ON m.doc_id = o_orderkey""",
    "contract_values": """WITH e AS (SELECT l_orderkey AS doc_id, l_returnflag AS value, l_linenumber::BIGINT AS place FROM lineitem UNION ALL SELECT o_orderkey, o_orderstatus, 4294967296 FROM orders),
f AS (SELECT doc_id, value, min(place) AS place FROM e GROUP BY 1, 2) SELECT doc_id, 'flag' AS kind, value, row_number() OVER (PARTITION BY doc_id ORDER BY place, value)::INT AS ord FROM f""",
    "record_colors": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '#1D4ED8' ELSE '#' || upper(substring(md5(c_name), 1, 6)) END AS color FROM customer),
d AS (SELECT c_custkey, color, [floor(('0x' || substring(color, 2, 2))::INT * 0.75)::INT, floor(('0x' || substring(color, 4, 2))::INT * 0.75)::INT, floor(('0x' || substring(color, 6, 2))::INT * 0.75)::INT] AS x FROM c)
SELECT c_custkey, color, printf('#%02X%02X%02X', x[1], x[2], x[3]) AS dark, c_custkey % 50 * 12 AS yearly, c_custkey % 50 * 60 - 75 AS saving, c_custkey % 7 = 0 OR c_custkey % 4 = 0 OR c_custkey % 2 = 1 AS needs_hero FROM d""",
    "token_catalogs": """WITH t AS (SELECT DISTINCT '[' || p_type || ']' AS token FROM part) SELECT s_suppkey, token FROM supplier, t WHERE token <> '[STANDARD]' AND NOT (token = '[PROMO]' AND s_suppkey % 2 = 0)""",
    "branch_texts": r"""WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'cards ' || p_name || ' ' WHEN 1 THEN 'sum of small things ' ELSE ' no small  reviews' END AS t FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bsmall things\b', '', 'g'), '(?i)\bsmall\b', '', 'g'), '(?i)\bring\b', '', 'g'), ' {2,}', ' ', 'g')) AS text FROM t""",
    "trade_catalogs": r"""WITH s AS (SELECT trim(lower(p_type) || ' ' || p_partkey) AS trade, regexp_extract_all(lower(p_type) || ', ' || p_name, '[a-z][a-z-]+') AS l FROM part), e AS (SELECT trade, unnest(l) AS theme, unnest(range(len(l)))::INT AS ord FROM s)
SELECT trade, ord, theme FROM e WHERE theme IN ('promo', 'economy', 'ring', 'small', 'large')""",
    "template_classes": """WITH k AS (SELECT DISTINCT lower(p_type) AS t FROM part), v AS (SELECT 'page-' || t AS name FROM k UNION SELECT 'card-' || t FROM k UNION SELECT 'up' UNION SELECT DISTINCT 'b' || p_size FROM part)
SELECT name, CASE WHEN name LIKE 'page-%' AND name <> 'page-promo' THEN 'interior' ELSE 'homepage' END AS kind FROM v UNION ALL SELECT '.page-' || t, 'layout' FROM k UNION ALL SELECT '.card-' || t, 'transform' FROM k UNION ALL SELECT '.up', 'transform'""",
    "record_checks": f"""SELECT c_custkey AS doc_id, 'required' AS rule_id, 'business_name' AS path FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey, 'required', 'city' FROM customer WHERE c_nationkey = 3
UNION ALL SELECT c_custkey, 'services', CASE WHEN c_custkey % 10 = 0 THEN 'empty' WHEN c_custkey % 12 = 5 THEN 'length' ELSE 'duplicate' END FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 12 = 5 OR c_custkey % 8 = 0""",
    "record_values": f"""WITH r AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 5 = 4 OR c_custkey % 6 = 0 OR c_custkey % 7 = 0 THEN 0 ELSE 2 + (c_custkey % 7 BETWEEN 1 AND 5)::INT END AS n FROM customer),
u AS (SELECT *, list_filter(['Upfront Flat-Rate', 'Surprise Fees', 'Free Estimates', 'Owner Answers', 'Licensed', 'Insured', 'Family Owned', 'Locally Owned', 'Not a Franchise', '24/7', '24 Hour Service', 'Around the Clock', 'Same Day', 'EPA Certified', 'EPA Section 608'],
  lambda c: NOT ((k % 4 = 0 AND c IN ('Surprise Fees', 'Free Estimates', '24/7', '24 Hour Service', 'Around the Clock')) OR (k % 2 = 0 AND c IN ('Licensed', 'Insured')) OR (k % 3 = 0 AND c = 'Family Owned'))) AS bad FROM r)
SELECT k AS c_custkey, CASE WHEN k % 17 <> 0 THEN '555 0100' END AS phone, CASE WHEN k % 9 <> 0 THEN 'a@b.org' END AS owner_email, CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'business_name' ELSE '' END AS warnings, n AS n_reviews, CASE WHEN k % 5 = 4 THEN 0 ELSE 3 - n END AS dropped_reviews,
  CASE WHEN n >= 3 THEN 'cards' WHEN k % 7 <= 5 AND k % 3 >= 1 THEN 'aggregate' ELSE 'omit' END AS mode, CASE WHEN 1890 + k % 150 BETWEEN 1900 AND 2025 THEN 2026 - 1890 - k % 150 ELSE 4 END::INT AS years,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN 'Todo Name' ELSE c_name END AS display, array_to_string(bad, '; ') AS unverified,
  array_to_string(list_filter(['Upfront Flat-Rate', 'Surprise Fees', 'Free Estimates', 'Owner Answers', 'Licensed', 'Insured', 'Family Owned', 'Locally Owned', 'Not a Franchise', '24/7', '24 Hour Service', 'Around the Clock', 'Same Day', 'EPA Certified', 'EPA Section 608'], lambda c: NOT list_contains(bad, c)), '; ') AS verified FROM u""",
    "token_usage": "SELECT l_returnflag AS model, sum(CASE WHEN l_linenumber <> 3 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS cache_read, sum(l_suppkey)::BIGINT AS cache_write, sum(greatest(l_partkey - CASE WHEN l_linenumber <> 3 THEN l_quantity::BIGINT ELSE 0 END - l_suppkey, 0))::BIGINT AS uncached FROM lineitem GROUP BY 1",
    "edited_records": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "record_contracts": r"""WITH c AS (SELECT *, c_custkey AS k, lower(c_mktsegment) AS seg FROM customer),
h AS (SELECT *, list_slice(list_filter([CASE WHEN k % 20 >= 10 THEN 'longevity' END, CASE WHEN k % 6 >= 4 AND k % 9 >= 5 THEN 'review_score' END, CASE WHEN k % 5 = 0 THEN '24/7' END, CASE WHEN k % 3 = 0 THEN 'family_owned' END], lambda x: x IS NOT NULL), 1, 2) AS h FROM c),
t AS (SELECT *, concat_ws(', ', CASE WHEN k % 2 = 0 THEN 'Licensed, insured' END, CASE WHEN k % 3 = 0 THEN 'family-owned' END, CASE WHEN k % 5 = 0 THEN 'locally owned' END) AS t FROM h)
SELECT c_custkey, CASE WHEN k % 2 = 0 THEN 'https://f.example/' || k ELSE '#' END AS action, CASE WHEN t <> '' THEN t || '.' ELSE '' END AS trust,
  CASE WHEN k % 7 = 0 THEN 'own.png' WHEN k % 5 <> 0 AND k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'https://l.example/l.png' ELSE '/p/' || k END END AS logo, CASE WHEN len(h) > 0 THEN array_to_string(h, ',') ELSE 'discoverability' END AS hooks, k % 4 = 0 AS has_token,
  regexp_replace(c_name, '[^A-Za-z0-9._-]+', '-', 'g') || '-.html' AS file, seg || '-example-org' AS slug, CASE WHEN k % 4 = 0 THEN 'civic' ELSE 'minimal' END AS theme, CASE WHEN k % 3 = 0 THEN 'theme-dark' ELSE 'theme-light' END AS body FROM t""",
    "record_claims": """WITH t AS (SELECT unnest(['Master Electrician', 'Master Licensed', 'Master-Licensed']) AS trigger)
SELECT c_custkey AS doc_id, trigger, trigger || CASE WHEN trigger = 'Master Electrician' THEN ' licensed' ELSE '' END || ', #' || c_custkey AS phrase FROM customer, t WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'IBEW', 'IBEW Local ' || c_custkey FROM customer WHERE c_custkey % 6 = 0""",
    "event_errors": """WITH e AS (SELECT CASE event_type WHEN 'error' THEN 'json' WHEN 'click' THEN 'unavailable' WHEN 'view' THEN 'body' ELSE event_type END AS kind FROM events)
SELECT kind, CASE kind WHEN 'json' THEN 'INPUT_INVALID' WHEN 'unavailable' THEN 'MODEL_RUNTIME_UNAVAILABLE' WHEN 'body' THEN 'MODEL_RESPONSE_INVALID' ELSE 'PROVIDER_INTERNAL_ERROR' END AS error_code, kind <> 'json' AS retryable, count(*) AS n FROM e GROUP BY 1""",
    "site_claims": """WITH s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier WHERE s_suppkey % 13 <> 0)
SELECT k AS doc_id, '$.site.name' AS path, 'text' AS kind, n AS value, NULL::VARCHAR AS value2 FROM s WHERE k % 5 <> 0 UNION ALL SELECT k, '$.site.tagline', 'text', 'tag', NULL FROM s UNION ALL SELECT k, '$.brand.logo_url', 'logo', 'u1', NULL FROM s WHERE k % 2 = 0
UNION ALL SELECT k, '$.nav[0].label', 'action', n, '/' || k FROM s WHERE k % 7 <> 0 UNION ALL SELECT k, '$.images[0].url', 'image', 'u' || (k % 4), 'alt' FROM s UNION ALL SELECT k, '$.images[1].url', 'image', 'u1', '' FROM s
UNION ALL SELECT k, '$.sections[0].headline', 'heading', 'h1', NULL FROM s WHERE k % 3 <> 0 UNION ALL SELECT k, '$.sections[' || i || '].items[0].title', 'text', 'i' || k, CASE WHEN k % 2 = 0 THEN '/i' END FROM s, range(2) r(i) WHERE k % 3 <> 0
UNION ALL SELECT k, '$.sections[' || i || '].items[0].description', 'text', 'd', NULL FROM s, range(2) r(i) WHERE k % 3 <> 0""",
    "site_shapes": """SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 13 = 0 THEN '' WHEN s_suppkey % 7 = 0 THEN 'nav' WHEN s_suppkey % 11 = 0 THEN 'odd' ELSE 'sections' END AS path,
  CASE WHEN s_suppkey % 13 = 0 THEN 'no_object' WHEN s_suppkey % 7 = 0 THEN 'missing' WHEN s_suppkey % 11 = 0 THEN 'unknown' ELSE 'missing' END AS rule_id FROM supplier WHERE s_suppkey % 13 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 OR s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'u1', CASE WHEN s_suppkey % 2 = 0 THEN 'logo' ELSE 'image' END FROM supplier WHERE s_suppkey % 13 <> 0 UNION ALL SELECT s_suppkey, 'u' || (s_suppkey % 4), 'image' FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 4 <> 1""",
    "site_errors": _SITE_ERRORS + " SELECT doc_id, array_to_string(path, '.') AS path, rule_id FROM e",
    "site_first_errors": _SITE_ERRORS
    + " SELECT doc_id, array_to_string(list_transform(path, lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), '.') AS path, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path, rule_id) AS k FROM e) WHERE k = 1",
    "service_claims": """WITH p AS (SELECT p_partkey % 50 AS doc_id, p_name, p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), l AS (SELECT doc_id, min(a) AS loc FROM p GROUP BY 1),
s AS (SELECT DISTINCT doc_id, b AS service FROM p WHERE p_partkey % 3 = 0), said AS (SELECT DISTINCT p.doc_id, 'best ' || p_name AS v FROM p JOIN l USING (doc_id) JOIN s USING (doc_id) WHERE contains(' best ' || p_name || ' ', ' ' || loc || ' ') AND contains(' best ' || p_name || ' ', ' ' || service || ' '))
SELECT doc_id, 'service_location' AS rule_id, v AS evidence FROM said WHERE length(v) % 2 = 1""",
}
