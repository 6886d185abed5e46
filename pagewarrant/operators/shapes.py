"""Shape of nested documents: a walk over variants, level by level, against a table of rules.

Each level joins the values that the one before found with the rules of their
pattern and explodes them into their errors and what they hold; errors found are
carried along, so that no level is walked again for the errors of the next.  A
value without a rule ends the walk there, so a document is walked as deep as the
rules go and no deeper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES, MOST_TEXT, MOST_URL, MOST_ITEMS = 200_000, 20_000, 8_192, 200
# The shape of a site document.  A line is a pattern and its kind; "!" marks a key that must be there, "?" a value that may be null.
_CONTACT = ["phone text?", "email text?", "address text?", "addresses array", "addresses[] text", "hours text?"]
_ITEM = ["title text?", "description text?", "url url?", "image_url url?", "tag text?", "date text?", "meta text?"]
_SITE_TYPES = "radio news local-business restaurant church civic nonprofit ecommerce portfolio services other"
_SECTION_TYPES = "hero news sports calendar promo-grid services menu testimonials team contact faq ad-block social misc"
_IMAGE_CONTEXTS = "logo hero promo ad show team content icon background"
_PAGE_TYPES = "contact about services single-service menu team faq gallery blog location other"
_HOME_SECTIONS = (
    "hero inline-form services-grid services-list services-featured-row team-grid team-list testimonial-block map-block hours-block cta-band gallery-grid news-feed stats-band partner-logos social-block about-text video-block"
)
_within = lambda prefix, lines: [f"{prefix}.{x}" for x in lines]
SITE_SHAPE = [
    "site! object", "site.name! text", "site.tagline text?", f"site.type enum {_SITE_TYPES}", "site.location text?", "site.contact object", *_within("site.contact", _CONTACT),
    "brand object", "brand.logo_url url?", "brand.colors object", "brand.colors.raw array", "brand.colors.raw[] text", *_within("brand.colors", [f"{c} text?" for c in ("background", "primary", "secondary", "text", "link", "nav_bg", "button_bg")]),
    "brand.color_mode enum light dark unknown", "brand.fonts object", "brand.fonts.display text?", "brand.fonts.body text?", "brand.style_notes array", "brand.style_notes[] text",
    "nav array", "nav[] object", "nav[].label! text", "nav[].url! url", "cta object", "cta.label text?", "cta.url url?",
    "sections array", "sections[] object", f"sections[].type! enum {_SECTION_TYPES}", "sections[].headline text?", "sections[].items array", "sections[].items[] object", *_within("sections[].items[]", _ITEM),
    "images array", "images[] object", "images[].url! url", "images[].alt text?", f"images[].context! enum {_IMAGE_CONTEXTS}", "image_generation_prompt text?",
    "social array", "social[] object", "social[].platform! text", "social[].url! url", "footer_links array", "footer_links[] object", "footer_links[].label! text", "footer_links[].url! url",
    "pages_to_fetch array", "pages_to_fetch[] object", "pages_to_fetch[].label! text", "pages_to_fetch[].url! url", f"pages_to_fetch[].page_type! enum {_PAGE_TYPES}", "pages_to_fetch[].priority! integer 1 3", "pages_to_fetch[].fetchable! boolean",
    "site_structure enum multi-page single-page mixed", "single_page_sections array", "single_page_sections[] object", "single_page_sections[].nav_label! text", "single_page_sections[].anchor url?", "single_page_sections[].page_type! text",
    "single_page_sections[].content object", *_within("single_page_sections[].content", ["headline text?", "body_text text?", "items array", "items[] object", *_within("items[]", _ITEM), "form_fields array", "form_fields[] text", "contact_info object", *_within("contact_info", _CONTACT)]),
    "conversion_profile object", "conversion_profile.urgency_type enum emergency planned both", "conversion_profile.primary_goal enum call form booking order inquiry", "conversion_profile.has_emergency_service boolean", "conversion_profile.phone text?",
    "conversion_profile.booking_platform text?", "conversion_profile.existing_ctas array", "conversion_profile.existing_ctas[] text", "conversion_profile.trust_signals object", "conversion_profile.trust_signals.review_summary text?",
    *[x for c in ("certifications", "awards", "social_proof_lines") for x in (f"conversion_profile.trust_signals.{c} array", f"conversion_profile.trust_signals.{c}[] text")],
    "homepage_blueprint object", "homepage_blueprint.hero_type enum hero-image hero-split hero-typography hero-video hero-carousel none", "homepage_blueprint.above_fold_form boolean", "homepage_blueprint.section_sequence array",
    f"homepage_blueprint.section_sequence[] enum {_HOME_SECTIONS}", "homepage_blueprint.footer_layout enum footer-1col footer-2col footer-3col footer-4col footer-stack", "homepage_blueprint.notes text?",
]
_KINDS = {"object": "OBJECT", "array": "ARRAY", "text": "STRING", "url": "STRING", "enum": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}
_FOUND = T.StructType().add("path", T.ArrayType(T.StringType())).add("rule_id", "string").add("v", T.VariantType()).add("pattern", "string")
_RULES = "pattern string, kind string, nullable boolean, options array<string>, required array<string>, keys array<string>, depth int"


def shape_rules(lines: list[str]) -> list[tuple]:
    """Rows of the rule table: pattern, kind, nullable, options (of an enumeration or the bounds of an integer), required and allowed keys, depth."""
    parts = [x.split(" ") for x in lines]
    names = [(p[0].rstrip("!"), p[0].endswith("!"), p[1].rstrip("?"), p[1].endswith("?"), p[2:]) for p in parts]
    under = lambda of: [(n, must) for n, must, *_ in names if n.rpartition(".")[0] == of and not n.endswith("[]")]
    key = lambda n: n.rpartition(".")[2]
    rows = [(n, kind, nullable, options, [key(x) for x, must in under(n) if must], [key(x) for x, _ in under(n)], n.count(".") + n.count("[]") + 1) for n, _, kind, nullable, options in names]
    return [("", "object", False, [], [key(x) for x, must in under("") if must], [key(x) for x, _ in under("")], 0), *rows]


def shape_errors(docs: DataFrame, text: str, lines: list[str] = SITE_SHAPE) -> DataFrame:
    """All errors of each document's JSON: doc_id, path, rule_id (no_object, too_large, type, option, bounds, blank, length, missing, unknown).

    ``path`` is an array of keys and zero-padded places.  Keys that no rule
    names are errors of the object that holds them, and so are missing ones.
    A document too large or no object at all has that error alone.
    """
    spark = docs.sparkSession
    rules = shape_rules(lines)
    table = F.broadcast(spark.createDataFrame(rules, _RULES))
    own = docs.select("doc_id", F.octet_length(text).alias("n"), F.try_parse_json(text).alias("v"))
    typed = own.withColumn("whole", F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "no_object").when(F.col("n") > MOST_BYTES, "too_large"))
    none = F.array().cast("array<string>")
    null = lambda kind: F.lit(None).cast(kind)
    # a row is an error found or, without a rule_id, a value to look at
    rows = typed.select("doc_id", none.alias("path"), F.col("whole").alias("rule_id"), F.when(F.col("whole").isNull(), F.col("v")).alias("v"), F.when(F.col("whole").isNull(), "").alias("pattern"))
    found = lambda path, rule, v, pattern: F.struct(path.alias("path"), rule.alias("rule_id"), v.alias("v"), pattern.alias("pattern"))
    error = lambda rule: found(F.col("path"), rule, null("variant"), null("string"))
    for depth in range(max(r[-1] for r in rules) + 1):
        known = rows.join(table.where(F.col("depth") == depth), "pattern", "left").where("rule_id is not null or kind is not null")
        known = known.withColumn("type", F.when(F.col("rule_id").isNull(), F.regexp_extract(F.coalesce(F.schema_of_variant("v"), F.lit("VOID")), "^[A-Z]+", 0)))
        fields = F.when((F.col("kind") == "object") & (F.col("type") == "OBJECT"), F.try_variant_get("v", "$", "map<string,variant>"))
        elements = F.when((F.col("kind") == "array") & (F.col("type") == "ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
        leaf = ~F.col("kind").isin("object", "array")
        known = known.withColumns({"fields": fields, "elements": elements, "string": F.when(leaf, F.try_variant_get("v", "$", "string"))})
        string, keys = F.col("string"), F.map_keys("fields")
        right = (F.col("type") == F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("kind"))) | (F.col("nullable") & (F.col("type") == "VOID"))
        number = F.try_variant_get("v", "$", "bigint")
        value_rule = (
            F.when(~right, "type")
            .when((F.col("kind") == "enum") & ~F.array_contains("options", string), "option")
            .when((F.col("kind") == "integer") & ~number.between(F.get("options", F.lit(0)).cast("long"), F.get("options", F.lit(1)).cast("long")), "bounds")
            .when(F.col("kind").isin("text", "url") & ~string.rlike(r"(?U)\S"), "blank")
            .when(F.length(string) > F.when(F.col("kind") == "url", MOST_URL).when(F.col("kind") == "text", MOST_TEXT), "length")
        )
        missing, unknown = F.when(F.size(F.array_except("required", keys)) > 0, "missing"), F.when(F.size(F.array_except(keys, "keys")) > 0, "unknown")
        items = F.when(F.size("elements") > MOST_ITEMS, "length")
        errors = F.transform(F.array_compact(F.array(value_rule, missing, unknown, items)), error)
        step = lambda x: F.concat("path", F.array(x))
        within = F.transform(F.map_entries("fields"), lambda e: found(step(e["key"]), null("string"), e["value"], F.when(F.col("pattern") == "", e["key"]).otherwise(F.concat_ws(".", "pattern", e["key"]))))
        members = F.transform("elements", lambda v, i: found(step(F.lpad(i.cast("string"), 6, "0")), null("string"), v, F.concat("pattern", F.lit("[]"))))
        empty = F.array().cast(T.ArrayType(_FOUND))
        own = F.concat(errors, F.coalesce(within, empty), F.coalesce(members, empty))
        rows = known.select("doc_id", F.explode(F.when(F.col("rule_id").isNotNull(), F.array(error(F.col("rule_id")))).otherwise(own)).alias("x")).select("doc_id", "x.*")
    return rows.where("rule_id is not null").select("doc_id", "path", "rule_id")


def first_errors(errors: DataFrame) -> DataFrame:
    """The first error of each document by path, then name: doc_id, path (joined by dots), rule_id."""
    first = errors.groupBy("doc_id").agg(F.min(F.struct("path", "rule_id")).alias("e"))
    return first.select("doc_id", F.array_join(F.transform("e.path", lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")), ".").alias("path"), "e.rule_id")
