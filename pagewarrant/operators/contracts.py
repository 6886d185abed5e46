"""Contracts derived from records and site documents, and checks of pages against single expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import audit as A
from . import ground as G
from . import pages as P

# Theme of a kind of site, and the default.
SITE_THEMES = {
    "radio": "broadcast",
    "news": "broadcast",
    "restaurant": "warm",
    "retail": "warm",
    "church": "civic",
    "civic": "civic",
    "nonprofit": "editorial",
    "portfolio": "minimal",
    "services": "minimal",
    "local-business": "warm",
    "ecommerce": "brand-forward",
}
DEFAULT_THEME = "minimal"
URL_TOKEN = "[VERCEL_URL_PLACEHOLDER]"
# Kinds of failures, their codes, and whether they may be retried.
ERROR_CODES = {
    "body": ("MODEL_RESPONSE_INVALID", True),
    "html": ("MODEL_RESPONSE_INVALID", True),
    "configuration": ("MODEL_RESPONSE_INVALID", True),
    "response": ("MODEL_RESPONSE_INVALID", True),
    "unavailable": ("MODEL_RUNTIME_UNAVAILABLE", True),
    "json": ("INPUT_INVALID", False),
    "unicode": ("INPUT_INVALID", False),
    "value": ("INPUT_INVALID", False),
}
DEFAULT_ERROR = ("PROVIDER_INTERNAL_ERROR", True)
DEFAULT_ACCENT, DEFAULT_SECONDARY = "#1D4ED8", "#1F3A5F"
# Labels of actions that claim nothing, and the channel that some of them need.
NEUTRAL_LABELS = [
    "back", "call", "call us", "close", "close menu", "collapse", "contact", "contact us", "details", "email", "email us", "expand", "explore", "get in touch", "home", "learn more", "main content", "menu", "message", "more",
    "navigation", "next", "open", "open menu", "previous", "read more", "see more", "send", "show", "show more", "skip to main content", "submit", "text", "text us", "view", "view details", "visit our website", "visit website", "website",
]
LABEL_CHANNELS = {"call": "tel", "call us": "tel", "email": "mailto", "email us": "mailto", "text": "sms", "text us": "sms"}


def _filled(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def form_action(endpoint: Column) -> Column:
    return F.coalesce(_filled(endpoint), F.lit("#"))


def trust_trailer(licensed: Column, family: Column, local: Column) -> Column:
    """Verified parts in one sentence, else empty."""
    parts = F.concat_ws(", ", F.when(licensed, "Licensed, insured"), F.when(family, "family-owned"), F.when(local, "locally owned"))
    return F.when(parts != "", F.concat(parts, F.lit("."))).otherwise("")


def record_logo(logo_url: Column, photos: Column) -> Column:
    """A record's logo, else the first of url, src and path of its first logo photo that has one."""
    of = F.filter(F.coalesce(photos, F.array().cast("array<struct<url:string,src:string,path:string,context:string>>")), lambda p: p["context"] == "logo")
    each = F.filter(F.flatten(F.transform(of, lambda p: F.array(p["url"], p["src"], p["path"]))), lambda u: F.coalesce(F.trim(u), F.lit("")) != "")
    return F.coalesce(F.when(F.trim(logo_url) != "", logo_url), F.try_element_at(each, F.lit(1)))


def outreach_hooks(years: Column, score: Column, count: Column, has_24_7: Column, family: Column, most: int = 2) -> Column:
    """The strongest hooks by priority, at most two; discoverability only where nothing else holds."""
    rules = [("longevity", years >= 10), ("review_score", (score >= 4.0) & (count >= 5)), ("24/7", has_24_7), ("family_owned", family)]
    found = F.slice(F.array_compact(F.array(*[F.when(test, name) for name, test in rules])), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("discoverability")))


def draft_has_token(draft: Column, token: str = URL_TOKEN) -> Column:
    """Whether the text before the checklist holds the URL token."""
    return F.split(draft, r"##\s*Before sending")[0].contains(token)


def exact_claims(records: DataFrame, id_col: str, license_col: str, local_col: str) -> DataFrame:
    """Triggers and the whole phrases that they must start: doc_id, trigger, phrase."""
    number, local = _filled(F.col(license_col)), _filled(F.col(local_col))
    row = lambda trigger, phrase: F.struct(F.lit(trigger).alias("trigger"), phrase.alias("phrase"))
    rows = [F.when(number.isNotNull(), row(t, F.concat(F.lit(t + then + ", #"), number))) for t, then in (("Master Electrician", " licensed"), ("Master Licensed", ""), ("Master-Licensed", ""))]
    rows.append(F.when(local.isNotNull(), row("IBEW", local)))
    return records.select(F.col(id_col).alias("doc_id"), F.explode(F.array_compact(F.array(*rows))).alias("c")).select("doc_id", "c.*")


def safe_name(name: Column) -> Column:
    """A file name of safe characters that ends in .html."""
    base = F.element_at(F.split(name, "/"), -1)
    kept = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    kept = F.regexp_replace(F.coalesce(_filled(kept), F.lit("website-homepage")), r"(?i)\.html$", "")
    return F.concat(F.substring(kept, 1, 250), F.lit(".html"))


def site_slug(url: Column) -> Column:
    """A site's host with dashes."""
    host = F.regexp_extract(F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url)), "^[^:]+://([^/?#]*)", 1)
    return F.replace(F.replace(host, F.lit("www."), F.lit("")), F.lit("."), F.lit("-"))


def body_theme(color_mode: Column) -> Column:
    return F.when(color_mode == "dark", "theme-dark").otherwise("theme-light")


def site_theme(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SITE_THEMES.items() for x in kv]), kind), F.lit(DEFAULT_THEME))


def classify_errors(failures: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds ``error_code`` and ``retryable`` of each kind of failure."""
    known = F.create_map(*[F.lit(x) for k, (code, _) in ERROR_CODES.items() for x in (k, code)])
    again = F.create_map(*[F.lit(x) for k, (_, retry) in ERROR_CODES.items() for x in (k, retry)])
    return failures.withColumns({"error_code": F.coalesce(F.element_at(known, F.col(kind)), F.lit(DEFAULT_ERROR[0])), "retryable": F.coalesce(F.element_at(again, F.col(kind)), F.lit(DEFAULT_ERROR[1]))})


def neutral_labels(catalog: DataFrame, contract: DataFrame) -> DataFrame:
    """Neutral labels of a document's copy (doc_id, value) whose channel it has, in any spelling: doc_id, label, ord.

    ``contract`` has doc_id, kind, value; phones make ``tel``, e-mails ``mailto``, ``sms:`` actions ``sms``.
    """
    kind, value = F.col("kind"), F.lower(F.trim("value"))
    channels = contract.select("doc_id", F.when(kind == "phone", "tel").when(kind == "email", "mailto").when((kind == "action") & value.startswith("sms:"), "sms").alias("channel")).where("channel is not null").distinct()
    label = A.norm(F.col("value"))
    need = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_CHANNELS.items() for x in kv]), label)
    own = catalog.where(label.isin(NEUTRAL_LABELS)).select("doc_id", F.col("value").alias("label"), need.alias("channel")).distinct()
    free = own.where("channel is null").unionByName(own.join(channels, ["doc_id", "channel"], "left_semi").select(own.columns))
    return free.select("doc_id", "label", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lower("label"), "label")).alias("ord"))


def _dark(color: Column) -> Column:
    """Three quarters of each channel, halves to even."""
    part = lambda at: F.lpad(F.hex(F.bround(F.conv(F.substring(color, at, 2), 16, 10).cast("double") * 0.75).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(2), part(4), part(6))


def document_colors(brand: Column, palette: Column, trade_secondary: Column) -> Column:
    """Colours of a document: a struct of accent, accent_dark, secondary and error.

    ``brand`` is a variant: a colour, a list of them or an object of named ones; an empty one leaves the
    choice to ``palette`` (a struct of the three, or null for the defaults).  ``error`` names what is no six-digit colour, or
    ``brand`` where it holds no primary colour or is of another type; the colours are null then.
    """
    get = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(brand, p, "string"), F.lit("")) for p in paths])
    kind, json = F.coalesce(F.schema_of_variant(brand), F.lit("VOID")), F.to_json(brand)
    is_text, is_list, is_map = kind == "STRING", kind.startswith("ARRAY"), kind.startswith("OBJECT")
    # An empty list, object or text, false and zero count as none.
    given = (kind != "VOID") & ~F.coalesce(json.isin('""', "[]", "{}", "false", "0"), F.lit(True))
    accent = F.when(is_text, get("$")).when(is_list, get("$[0]")).when(is_map, get("$.accent", "$.primary"))
    dark = F.when(is_map, get("$.accent_dark", "$.dark"))
    second = F.when(is_list, get("$[1]")).when(is_map, get("$.secondary"))
    sound = lambda c: F.coalesce(c.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))
    spare = F.coalesce(F.nullif(trade_secondary, F.lit("")), F.lit(DEFAULT_SECONDARY))
    of = lambda a, d, s: F.struct(a.alias("accent"), d.alias("accent_dark"), s.alias("secondary"))
    branded = of(accent, F.coalesce(dark, F.when(sound(accent), _dark(accent))), F.coalesce(second, spare))
    chosen = F.when(given, branded).when(palette.isNotNull(), of(palette["accent"], palette["accent_dark"], F.coalesce(F.nullif(palette["secondary"], F.lit("")), spare)))
    chosen = chosen.otherwise(of(F.lit(DEFAULT_ACCENT), _dark(F.lit(DEFAULT_ACCENT)), F.lit(DEFAULT_SECONDARY)))
    error = F.when(given & accent.isNull(), "brand")
    for name in ("accent", "accent_dark", "secondary"):
        error = error.when(~sound(chosen[name]), name)
    return F.struct(*[F.when(error.isNull(), chosen[name]).alias(name) for name in ("accent", "accent_dark", "secondary")], error.alias("error"))


def contract_locations(records: DataFrame, id_col: str) -> DataFrame:
    """Places that a record's page may name: doc_id, kind (city, state, radius, address), value; blank ones are left out."""
    value = {"city": F.col("city"), "state": F.col("state"), "radius": F.col("service_radius"), "address": F.trim("address")}
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in value.items()])
    return records.select(F.col(id_col).alias("doc_id"), F.inline(rows)).where(F.trim("value") != "")


def record_images(records: DataFrame, id_col: str, logo: str = "logo", photos: str = "photos") -> DataFrame:
    """Image URLs that a record's page may show, first seen first: doc_id, value, is_logo, ord."""
    none = F.array().cast("array<struct<url:string,src:string,path:string>>")
    each = F.flatten(F.transform(F.coalesce(photos, none), lambda p: F.array(p["url"], p["src"], p["path"])))
    own = _filled(F.col(logo))
    kept = F.array_distinct(F.filter(F.transform(F.concat(F.array(own), each), lambda u: F.trim(u)), lambda u: u.isNotNull() & (u != "")))
    return records.select(F.col(id_col).alias("doc_id"), own.alias("_logo"), F.posexplode(kept).alias("ord", "value")).select("doc_id", "value", F.coalesce(F.col("value") == F.col("_logo"), F.lit(False)).alias("is_logo"), (F.col("ord") + 1).alias("ord"))


def canonical_images(claims: DataFrame, sites: DataFrame) -> DataFrame:
    """Claims with the URLs of images and logos resolved against their site's (doc_id, base_url); without one they stay.

    Distinct pairs are resolved once, character references are decoded first.
    """
    image = F.col("kind").isin("image", "logo")
    based = claims.join(sites.select("doc_id", "base_url"), "doc_id", "left").withColumn("_b", F.when(image & (F.trim("base_url") != ""), F.col("base_url")))
    pairs = based.where("_b is not null").select("_b", "value").distinct().withColumn("_r", P.url_join("_b", P.unescape("value")))
    return based.join(pairs, ["_b", "value"], "left").withColumn("value", F.coalesce("_r", "value")).select(claims.columns)


def oversized(records: DataFrame, text: str, most: int = 200_000) -> DataFrame:
    """Records whose prompt block is too long."""
    return records.where(F.length(text) > most)


# -- site documents

#: Claims of a site document: kind, arrays that hold them from the outside in, fields of value and second value.
CLAIMS = [
    ("text", (), "$.site.name", None), ("text", (), "$.site.tagline", None), ("email", (), "$.site.contact.email", None), ("phone", (), "$.site.contact.phone", None), ("logo", (), "$.brand.logo_url", None),
    ("action", ("$.nav",), "$.label", "$.url"), ("action", ("$.footer_links",), "$.label", "$.url"), ("social", ("$.social",), "$.platform", "$.url"), ("image", ("$.images",), "$.url", "$.alt"),
    ("heading", ("$.sections",), "$.headline", None), ("text", ("$.sections", "$.items"), "$.title", "$.url"), ("text", ("$.sections", "$.items"), "$.description", None),
    ("target", ("$.single_page_sections",), "$.anchor", None), ("heading", ("$.single_page_sections",), "$.content.headline", None),
]


def flatten_claims(docs: DataFrame, doc: str = "doc", claims=CLAIMS) -> DataFrame:
    """A row per claim of a document (a variant): doc_id, path, kind, value, value2."""
    out = None
    for kind, arrays, value, second in claims:
        df = docs.select("doc_id", F.col(doc).alias("v"), F.lit("$").alias("path"))
        for array in arrays:
            df = df.select("doc_id", "path", F.posexplode(F.try_variant_get("v", array, "array<variant>")).alias("i", "v")).withColumn("path", F.concat("path", F.lit(array[1:] + "["), "i", F.lit("]"))).drop("i")
        own = df.select(
            "doc_id", F.concat("path", F.lit(value[1:])).alias("path"), F.lit(kind).alias("kind"), F.try_variant_get("v", value, "string").alias("value"),
            (F.try_variant_get("v", second, "string") if second else F.lit(None).cast("string")).alias("value2"),
        ).where(F.trim("value") != "")
        out = own if out is None else out.unionByName(own)
    return out


def check_shape(docs: DataFrame, text: str, required: list[str], allowed: list[str], most_bytes: int = 200_000) -> DataFrame:
    """First error by path of each document's text: no object, too large, missing or unknown keys: doc_id, path, rule_id."""
    keys = F.json_object_keys(text)
    one = lambda rule, path: F.struct(path.alias("path"), F.lit(rule).alias("rule_id"))
    lists = F.concat(F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: one("missing", k)), F.transform(F.array_except(keys, F.array(*map(F.lit, allowed))), lambda k: one("unknown", k)))
    first = F.when(keys.isNull(), one("no_object", F.lit(""))).when(F.octet_length(text) > most_bytes, one("too_large", F.lit(""))).otherwise(F.array_min(lists))
    return docs.select("doc_id", first.alias("e")).where("e is not null").select("doc_id", "e.*")


def contract_images(claims: DataFrame) -> DataFrame:
    """Image URLs that a document may show and the one of its navigation: doc_id, value, is_logo."""
    own = claims.where(F.col("kind").isin("image", "logo")).select("doc_id", F.trim("value").alias("value"), (F.col("kind") == "logo").alias("is_logo"))
    return own.groupBy("doc_id", "value").agg(F.bool_or("is_logo").alias("is_logo"))


def contract_service_location(services: DataFrame, claims: DataFrame, locations: DataFrame) -> DataFrame:
    """Claims that hold the location and one of the services as whole phrases: doc_id, value.

    ``services`` and ``claims`` have doc_id, value; ``locations`` doc_id, location.
    """
    both = claims.join(locations, "doc_id").where(G.holds_phrase(G.norm(F.col("value")), G.norm(F.col("location"))))
    named = both.join(services.select("doc_id", F.col("value").alias("service")), "doc_id").where(G.holds_phrase(G.norm(F.col("value")), G.norm(F.col("service"))))
    return named.select("doc_id", "value").distinct()


def check_service_location(texts: DataFrame, services: DataFrame, locations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Assertions (doc_id, text) of a service at the location that are no claim of the source."""
    said = contract_service_location(services, texts.select("doc_id", F.col("text").alias("value")), locations).withColumn("n", G.norm(F.col("value")))
    own = allowed.select("doc_id", G.norm(F.col("value")).alias("n")).distinct()
    return A._violations(said.join(own, ["doc_id", "n"], "left_anti"), "service_location", F.col("value"), "doc_id")


# -- evidence and grounding


def contact_links(links: DataFrame) -> DataFrame:
    """``tel:`` and ``mailto:`` destinations, decoded, with the action's own text and the destination where that does not show it."""
    target = F.regexp_extract(F.trim("href"), r"^(?i)(tel|mailto):([^?#]*)", 2)
    out = links.select("page_id", "node_id", F.lower(F.regexp_extract(F.trim("href"), r"^(?i)(tel|mailto):", 1)).alias("scheme"), F.trim(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))).alias("destination"), "label").where("scheme <> '' and destination <> ''")
    shown = F.when(F.col("scheme") == "mailto", F.lower("label").contains(F.lower("destination"))).otherwise(X.phone_key(F.col("label")).contains(X.phone_key(F.col("destination"))))
    return out.withColumn("context", F.when(shown, F.col("label")).otherwise(F.trim(F.concat_ws(" ", "label", "destination"))))


def ground_target(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims whose decoded fragment is an element id (``page_id, target_id``) of the page."""
    fragment = F.trim(F.coalesce(F.try_url_decode(F.replace(F.regexp_extract("value", "#(.*)$", 1), F.lit("+"), F.lit("%2B"))), F.lit("")))
    return G._member(claims.withColumn("_t", F.when(fragment != "", fragment).otherwise(F.trim("value"))), targets.select("page_id", F.col("target_id").alias("_t")), ["_t"]).drop("_t")


def ground_heading(claims: DataFrame, headings: DataFrame) -> DataFrame:
    """Claims that a heading of the page states."""
    return G.ground_text(claims, headings.select("page_id", F.col("text").alias("segment")))


def ground_identity(claims: DataFrame, identity: DataFrame) -> DataFrame:
    """Claims of a name that the page's channels elected (``page_id, identity``)."""
    return G.ground_member(claims, identity, "identity", G.norm)


# -- single expected values


def contains_tokens(surface: Column, phrase: Column) -> Column:
    """Whether letters and digits of a phrase are a run of whole words of a text, however they are spaced."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(surface), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    own = A.compact(phrase)
    return (own != "") & F.rlike(padded, F.concat(F.lit(" "), F.regexp_replace(own, "(.)", "$1 ?"), F.lit(" ")))


def _expected(found: DataFrame, targets: DataFrame, contract: DataFrame, kind: str, needs_target: bool) -> DataFrame:
    """Values shown or linked (doc_id, value) against the one value expected of a document, null for none."""
    own = contract.where(F.col("kind") == kind).select("doc_id", F.col("value").alias("expected"))
    shown = own.join(found.distinct(), "doc_id").where(~F.col("value").eqNullSafe(F.col("expected")))
    linked = own.join(targets.distinct(), "doc_id").where(~F.col("value").eqNullSafe(F.col("expected")))
    out = A._violations(shown, f"unexpected_{kind}", F.col("value"), "doc_id").unionByName(A._violations(linked, f"unexpected_{kind}_target", F.col("value"), "doc_id"))
    if not needs_target:
        return out
    missing = own.where("expected is not null").join(targets.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.unionByName(A._violations(missing, f"missing_{kind}_target", F.col("expected"), "doc_id"))


def check_phone(exposed: DataFrame, links: DataFrame, contract: DataFrame) -> DataFrame:
    """Phones that are not the one expected, and documents that do not link to it."""
    found = exposed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(A.PHONE_LIKE), 0)).alias("raw")).select("doc_id", X.phone_key(F.col("raw")).alias("value"))
    targets = contact_links(links).where("scheme = 'tel'").select(F.col("page_id").alias("doc_id"), X.phone_key(F.col("destination")).alias("value"))
    return _expected(found, targets, contract.withColumn("value", F.when(F.col("kind") == "phone", X.phone_key(F.col("value"))).otherwise(F.col("value"))), "phone", True)


def check_email(exposed: DataFrame, links: DataFrame, contract: DataFrame) -> DataFrame:
    """E-mail addresses, shown or linked, that are not the one expected."""
    found = exposed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.EMAIL), 0)).alias("raw")).select("doc_id", F.lower("raw").alias("value"))
    targets = contact_links(links).where("scheme = 'mailto'").select(F.col("page_id").alias("doc_id"), X.email_key(F.col("destination")).alias("value"))
    return _expected(found, targets, contract.withColumn("value", F.when(F.col("kind") == "email", X.email_key(F.col("value"))).otherwise(F.col("value"))), "email", False)


def check_address(nodes: DataFrame, contract: DataFrame, cls: str = "ft-address") -> DataFrame:
    """Documents whose one footer address does not begin with the words of the expected one; null expects none."""
    have = A._field_text(nodes, cls).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    both = contract.where("kind = 'address'").join(have, "doc_id", "left")
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    begins = F.concat(words(F.col("text")), F.lit(" ")).startswith(F.concat(words(F.col("value")), F.lit(" ")))
    bad = F.when(F.col("value").isNull(), F.when(F.col("n") > 0, "unverified")).when(F.coalesce("n", F.lit(0)) != 1, "count").when(~F.coalesce(begins, F.lit(False)), "differs")
    return A._violations(both.withColumn("bad", bad).where("bad is not null"), "footer_address", F.col("bad"), "doc_id")


def check_rendered(nodes: DataFrame, required: DataFrame) -> DataFrame:
    """Elements of required classes (doc_id, class) that are suppressed."""
    own = P.suppressed(nodes).where("suppressed and kind = 'el'").select(F.col("page_id").alias("doc_id"), F.explode("classes").alias("class"))
    return A._violations(own.join(required, ["doc_id", "class"], "left_semi").distinct(), "hidden_content", F.col("class"), "doc_id")
