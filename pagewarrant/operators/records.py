"""Business records: validation, normalisation, gated claims and design picks.

Rules are literals in the plan; every operator is a projection or an explode, so
none shuffles except where it compares records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

REQUIRED = ["business_name", "trade", "city", "state", "phone"]
# Marks of template defaults, and what they do to a field.
PLACEHOLDERS = ["example.com", "replace", "your_form_id", "(replace)", "todo"]
PLACEHOLDER_WARNS = ["business_name", "formspree_endpoint"]
PLACEHOLDER_NULLS = ["owner_email", "owner_first_name", "phone", "address"]
MAX_SERVICES, MAX_SERVICE_CHARS, MAX_ALL_CHARS = 12, 80, 600
# Claims that need evidence in a promise, or a field.
SERVICE_CLAIMS = {
    "Upfront Flat-Rate": ["flat-rate pricing", "upfront pricing"],
    "Surprise Fees": ["flat-rate pricing", "upfront pricing", "no surprise fees"],
    "Free Estimates": ["free estimates"],
    "Owner Answers": ["owner answers"],
}
FIELD_CLAIMS = {
    "licensed_and_insured": ["Licensed", "Insured"],
    "family_owned": ["Family Owned"],
    "locally_owned": ["Locally Owned", "Not a Franchise"],
    "has_24_7": ["24/7", "24 Hour Service", "Around the Clock"],
    "same_day_service": ["Same Day"],
    "epa_certified": ["EPA Certified", "EPA Section 608"],
}
PROMISE_EVIDENCE = {"has_24_7": ["24/7", "24 hour", "around the clock"], "same_day_service": ["same-day", "same day"]}
SECTION_ORDERS = ["default", "services-led", "reviews-led"]
HERO_SHAPES = {"broadcast": "fullbleed", "editorial": "split", "civic": "fullbleed", "warm": "fullbleed", "minimal": "gradient", "brand-forward": "fullbleed"}
TRADE_FORMS = {"plumber": ("Plumber", "plumber"), "hvac": ("HVAC Contractor", "HVAC contractor"), "electrician": ("Electrician", "electrician")}


def blank(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def is_placeholder(col: Column) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    out = F.lit(False)
    for mark in PLACEHOLDERS:
        out = out | low.contains(mark)
    return out


def check_fields(records: DataFrame, id_col: str, required=REQUIRED) -> DataFrame:
    """Violations of required fields: id, rule_id, path."""
    rows = F.array_compact(F.array(*[F.when(blank(F.col(c)), F.struct(F.lit("required").alias("rule_id"), F.lit(c).alias("path"))) for c in required]))
    return records.select(F.col(id_col).alias("doc_id"), F.explode(rows).alias("v")).select("doc_id", "v.*")


def normalize_services(records: DataFrame, col: str = "services") -> DataFrame:
    """Adds ``services`` with white space collapsed, and ``services_error`` (first of: empty, count, length, total, duplicate)."""
    clean = F.transform(F.col(col), lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))
    df = records.withColumn(col, clean)
    own = F.col(col)
    total = F.aggregate(own, F.lit(0), lambda n, s: n + F.length(s))
    error = (
        F.when(own.isNull() | (F.size(own) == 0) | F.exists(own, lambda s: s.isNull() | (s == "")), "empty")
        .when(F.size(own) > MAX_SERVICES, "count")
        .when(F.exists(own, lambda s: F.length(s) > MAX_SERVICE_CHARS), "length")
        .when(total > MAX_ALL_CHARS, "total")
        .when(F.size(F.array_distinct(F.transform(own, F.lower))) < F.size(own), "duplicate")
    )
    return df.withColumn("services_error", error)


def scrub_placeholders(records: DataFrame) -> DataFrame:
    """Template defaults become null in fields that may be left out; ``placeholder_warnings`` names those that may not."""
    warns = F.array_compact(F.array(*[F.when(is_placeholder(F.col(c)), c) for c in PLACEHOLDER_WARNS if c in records.columns]))
    return records.withColumns({c: F.when(~is_placeholder(F.col(c)), F.col(c)) for c in PLACEHOLDER_NULLS if c in records.columns} | {"placeholder_warnings": warns})


def usable_reviews(records: DataFrame, col: str = "reviews") -> DataFrame:
    """Keeps reviews with author, text, date, platform and a rating of 1 to 5; adds how many were dropped."""
    real = lambda c: ~blank(c) & ~is_placeholder(c)
    kept = F.filter(F.coalesce(F.col(col), F.array().cast(records.schema[col].dataType)), lambda r: real(r["author"]) & real(r["text"]) & real(r["date"]) & real(r["platform"]) & F.coalesce(r["rating"].between(1, 5), F.lit(False)))
    return records.withColumn("_n", F.coalesce(F.size(col), F.lit(0))).withColumn(col, kept).withColumn("dropped_reviews", F.greatest(F.col("_n"), F.lit(0)) - F.size(col)).drop("_n")


def review_aggregate(score: Column, count: Column) -> Column:
    """Struct of score (0 to 5) and count (1 or more), null where either is not usable."""
    return F.when(score.between(0, 5) & (count >= 1), F.struct(score.alias("score"), count.alias("count")))


def review_mode(reviews: Column, aggregate: Column) -> Column:
    return F.when(F.size(reviews) >= 3, "cards").when(aggregate.isNotNull(), "aggregate").otherwise("omit")


def years_in_business(established: Column, given: Column, year: Column) -> Column:
    """Years since a sound founding year, else the years given."""
    return F.coalesce(F.when(established.between(1900, year - 1), year - established), given)


def reviews_url(url: Column, *parts: Column) -> Column:
    """The URL given, else a map search for the parts."""
    query = F.trim(F.concat_ws(" ", *[F.coalesce(F.trim(p), F.lit("")) for p in parts]))
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.url_encode(query)))


def display_name(name: Column) -> Column:
    """A legal name without its company suffix, in title case; runs of letters start upper case."""
    bare = F.trim(F.regexp_replace(F.trim(name), r"(?i)\s*,?\s+(?:incorporated|inc|llc|l\.l\.c|co|company)\.?$", ""))
    runs = F.regexp_extract_all(bare, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    title = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")
    return F.coalesce(F.nullif(title, F.lit("")), F.trim(name))


def unverified_claims(promises: Column, fields: dict[str, Column]) -> Column:
    """Claims that neither a promise nor a field allows, in order."""
    low = F.transform(F.filter(F.coalesce(promises, F.array().cast("array<string>")), lambda p: ~blank(p)), F.lower)
    holds = lambda words: F.exists(low, lambda p: _any(p, words))
    out = [F.when(~holds(words), claim) for claim, words in SERVICE_CLAIMS.items()]
    for field, claims in FIELD_CLAIMS.items():
        ok = F.coalesce(fields.get(field, F.lit(False)), F.lit(False))
        if field in PROMISE_EVIDENCE:
            ok = ok | holds(PROMISE_EVIDENCE[field])
        out += [F.when(~ok, c) for c in claims]
    return F.array_distinct(F.array_compact(F.array(*out)))


def verified_claims(unverified: Column) -> Column:
    every = [*SERVICE_CLAIMS, *(c for cs in FIELD_CLAIMS.values() for c in cs)]
    return F.array_except(F.array(*map(F.lit, every)), unverified)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def pick(name: Column, options: list[str], start: int, default: str | None = None) -> Column:
    """One of a list by the name's digest; a blank name gets the default or the first."""
    chosen = F.element_at(F.array(*map(F.lit, options)), X.hash_bucket(name, start, len(options)) + 1)
    return F.when(blank(name), F.lit(default or options[0])).otherwise(chosen)


def pick_theme(name: Column, allowed: list[str], brand_colors: Column | None = None, override: Column | None = None) -> Column:
    """Brand colours, then an override that is a known theme, then the digest's bytes 0 to 8 over the trade's list."""
    out = pick(name, allowed, 0)
    if override is not None:
        out = F.when(override.isin(list(HERO_SHAPES)), override).otherwise(out)
    return out if brand_colors is None else F.when(brand_colors.isNotNull(), "brand-forward").otherwise(out)


def pick_section_order(name: Column) -> Column:
    return pick(name, SECTION_ORDERS, 16)


def pick_hero_shape(theme: Column, has_photo: Column) -> Column:
    shape = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HERO_SHAPES.items() for x in kv]), theme), F.lit("fullbleed"))
    return F.when(shape.isin("fullbleed", "split") & ~F.coalesce(has_photo, F.lit(False)), "gradient").otherwise(shape)


def usage_stats(results: DataFrame, model: str = "model") -> DataFrame:
    """Token sums by model; uncached tokens are what is left of the total, never below zero."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return results.groupBy(model).agg(F.sum(n("cache_read")).alias("cache_read"), F.sum(n("cache_write")).alias("cache_write"), F.sum(F.greatest(n("total") - n("cache_read") - n("cache_write"), F.lit(0))).alias("uncached"))


def merge_edits(base: DataFrame, edits: DataFrame, id_col: str) -> DataFrame:
    """Edited fields replace, blank ones delete, fields not in ``edits`` stay."""
    new = edits.select(F.col(id_col), *[F.col(c).alias(f"_e_{c}") for c in edits.columns if c != id_col])
    df = base.join(new, id_col, "left")
    cols = {c: F.when(F.col(f"_e_{c}").isNull(), F.col(c)).when(blank(F.col(f"_e_{c}").cast("string")), None).otherwise(F.col(f"_e_{c}")) for c in edits.columns if c != id_col and c in base.columns}
    return df.withColumns(cols).select(base.columns)
