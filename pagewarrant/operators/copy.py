"""Visible copy of generated pages against a closed catalog made from records.

What a page shows is told in fragments: each text, each attribute that is read
out, and the runs that texts make where nothing parts them on screen.  A run is an
island between the children that part it, as of each text's place.  Every
fragment must be a catalog string of its document, spaces aside: an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import contracts as K
from . import pages as P
from . import records as R
from .audit import _violations

# Elements that part text, that hold text of their own, that stand in a line, that lay children out in one; what may not be shown.
PARTING = (
    "a address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
HOLDING = [*PARTING, *"button caption img input label legend option output select svg textarea title".split()]
IN_LINE, LAID_OUT = ["img", "label", "output", "svg"], ["tr"]
SHOWN_ATTRIBUTES = (
    "alt abbr title placeholder label aria-label aria-description aria-valuetext aria-valuenow aria-valuemin aria-valuemax aria-roledescription aria-placeholder aria-braillelabel aria-brailleroledescription "
    "aria-keyshortcuts aria-colindextext aria-rowindextext"
).split()
NUMERIC_ATTRIBUTES = "aria-colcount aria-colindex aria-colspan aria-level aria-posinset aria-rowcount aria-rowindex aria-rowspan aria-setsize aria-valuenow aria-valuemin aria-valuemax".split()
NUMERIC_ROLES, NUMERIC_INPUTS, NUMERIC_TAGS = ["meter", "progressbar", "scrollbar", "slider", "spinbutton"], ["number", "range"], ["meter", "progress"]
INDEPENDENT = "a button img input li option output select summary svg textarea".split()
INDEPENDENT_CLASSES = ["benefit-card", "ft-address", "service-card"]
# Copy that every page may show.
FIXED_COPY = [
    "Request Service", "Not sure if we cover your area?", "Services", "Why Choose Us", "Your name", "Phone number", "Email (optional)", "What's going on?", "Send My Request", "Get My Estimate", "Schedule My Service",
    "Hours", "Service Area", "out of 5", "or", "Review our services and send a request.", "Use this form to request service.",
    "Review the services listed on this page.", "Contact", "Use the contact information on this page.", "Send a service request through this page.",
]
PHONE_LABELS, EMAIL_LABELS = ["Call", "Call us"], ["Email", "Email us"]
RECORD_FIELDS = "business_name display_name trade city state phone owner_email address hours service_radius".split()


def squeezed(text: Column) -> Column:
    """White space collapsed; case stays."""
    return X.trim_space(F.regexp_replace(text, r"(?U)\s+", " "))


def _is_exposed() -> Column:
    return ~F.col("suppressed") & ~F.coalesce(P._within(["script", "style", "template", "noscript"]), F.lit(False))


def _exposed(nodes: DataFrame) -> DataFrame:
    return P.suppressed(nodes).where(_is_exposed())


def _pieces(nodes: DataFrame) -> DataFrame:
    """Texts, and what stands in for images and buttons: page_id, at, ancestors, names (of the elements around), piece."""
    stand_in = F.when(F.col("tag") == "img", P.attr("alt")).when((F.col("tag") == "input") & F.lower(P.attr("type")).isin("button", "submit", "reset"), P.attr("value"))
    own = _exposed(nodes).where("kind <> 'comment'").withColumn("piece", squeezed(F.when(F.col("kind") == "text", F.col("text")).otherwise(stand_in)))
    return own.where("piece <> ''").select("page_id", F.col("node_id").alias("at"), "ancestors", F.slice("path", 1, F.size("ancestors")).alias("names"), "piece")


def _islands(inside: DataFrame, parting: DataFrame) -> DataFrame:
    """Texts of each owner joined between the children that part them: page_id, text.

    ``inside``: page_id, owner, child (of the owner, around the text), at, piece;
    ``parting``: page_id, owner, child.
    """
    line = Window.partitionBy("page_id", "owner").orderBy("child")
    rows = inside.withColumn("parts", F.lit(0)).unionByName(parting.select("page_id", "owner", "child", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("piece"), F.lit(1).alias("parts")))
    runs = rows.withColumn("run", F.sum("parts").over(line)).where("parts = 0")
    joined = runs.groupBy("page_id", "owner", "run").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return joined.select("page_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))


def inline_runs(nodes: DataFrame) -> DataFrame:
    """Texts that stand in one line: page_id, text.

    A text runs on in the nearest element that holds text, and, where that
    stands in a line itself, in the next one around it.
    """
    pieces = _pieces(nodes)
    holds = F.transform("names", lambda t: t.isin(HOLDING))
    wall = F.size("names") - F.array_position(F.reverse(F.transform("names", lambda t: t.isin(HOLDING) & ~t.isin(IN_LINE))), True)  # the innermost that runs end at
    walled = pieces.withColumn("wall", F.when(F.array_contains(F.transform("names", lambda t: t.isin(HOLDING) & ~t.isin(IN_LINE)), True), wall).otherwise(-1).cast("int")).withColumn("holds", holds)
    spots = F.filter(F.transform("ancestors", lambda a, i: F.when((i >= F.col("wall")) & F.get("holds", i), F.struct(a.alias("owner"), F.coalesce(F.get("ancestors", i + 1), F.col("at")).alias("child")))), lambda s: s.isNotNull())
    top = F.when(F.col("wall") < 0, F.array(F.struct(F.lit(-1).alias("owner"), F.coalesce(F.get("ancestors", F.lit(0)), F.col("at")).alias("child")))).otherwise(F.array().cast("array<struct<owner:int,child:int>>"))
    inside = walled.select("page_id", "at", "piece", F.explode(F.concat(spots, top)).alias("s")).select("page_id", "at", "piece", "s.owner", "s.child")
    parting = nodes.where(F.col("tag").isin(HOLDING) & ~F.col("tag").isin(IN_LINE)).select("page_id", F.coalesce("parent_id", F.lit(-1)).alias("owner"), F.col("node_id").alias("child"))
    return _islands(inside, parting)


def layout_runs(nodes: DataFrame, classes: list[str], independent: list[str] = INDEPENDENT_CLASSES) -> DataFrame:
    """Texts that a row of children makes, in table rows and elements of layout classes: page_id, text; list items, controls and components part it."""
    any_of = lambda names: F.arrays_overlap("classes", F.array(*map(F.lit, names))) if names else F.lit(False)
    own = _exposed(nodes).where("kind = 'el'")
    rows = own.where((F.col("tag").isin(LAID_OUT) | any_of(classes)) & ~any_of(independent)).select("page_id", F.col("node_id").alias("owner"))
    alone = own.where(F.col("tag").isin(INDEPENDENT) | (F.coalesce(P.attr("role"), F.lit("")) != "") | any_of(independent))
    around = F.concat("ancestors", F.array("node_id"))

    def steps(chain, names):
        every = F.transform(F.slice(chain, 1, F.size(chain) - 1), lambda a, i: F.struct(a.alias("owner"), F.get(chain, i + 1).alias("child"), F.get(names, i).alias("tag")))
        # without layout classes a name alone tells what may be a row, so that nothing else is dealt out
        return F.transform(every if classes else F.filter(every, lambda s: s["tag"].isin(LAID_OUT)), lambda s: s.dropFields("tag"))

    parting = alone.select("page_id", F.explode(steps(around, F.col("path"))).alias("s")).select("page_id", "s.*").distinct().join(rows, ["page_id", "owner"])
    inside = _pieces(nodes).select("page_id", "at", "piece", F.explode(steps(F.concat("ancestors", F.array("at")), F.col("names"))).alias("s")).select("page_id", "at", "piece", "s.*").join(rows, ["page_id", "owner"])
    return _islands(inside.join(parting, ["page_id", "owner", "child"], "left_anti"), parting)


def _fragments(nodes: DataFrame, layout_classes: list[str]) -> DataFrame:
    texts = _pieces(nodes).select("page_id", F.col("piece").alias("text"))
    kept = F.map_filter("attrs", lambda k, v: k.isin(SHOWN_ATTRIBUTES) & (F.trim(v) != ""))
    read = _exposed(nodes).where("kind = 'el'").select("page_id", F.explode(kept).alias("name", "text")).select("page_id", squeezed(F.col("text")).alias("text"))
    return texts.unionByName(read).unionByName(inline_runs(nodes)).unionByName(layout_runs(nodes, list(layout_classes))).where("text <> ''")


def fragments(nodes: DataFrame, layout_classes: list[str] = ()) -> DataFrame:
    """All that a page shows or has read out, once: page_id, text."""
    return _fragments(nodes, layout_classes).distinct()


def check_copy_lists(nodes: DataFrame, lists: DataFrame, layout_classes: list[str] = ()) -> DataFrame:
    """What ``check_copy`` finds in ``fragments``, from lists of catalog strings (``copy_lists``): a page's fragments and its lists meet in one row each."""
    shown = _fragments(nodes, layout_classes).groupBy("page_id").agg(F.collect_set("text").alias("shown"))
    allowed = lists.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.flatten(F.collect_list(F.transform("catalog", squeezed))).alias("allowed"))
    outside = F.array_except("shown", F.coalesce("allowed", F.array().cast("array<string>")))
    found = shown.join(allowed, "page_id", "left").select("page_id", F.explode(outside).alias("text"))
    return _violations(found, "copy_outside_catalog", F.col("text"))


def check_copy(shown: DataFrame, catalog: DataFrame) -> DataFrame:
    """Fragments (``fragments``) that no catalog string of the document (doc_id, value) is."""
    allowed = catalog.select(F.col("doc_id").cast("long").alias("page_id"), squeezed(F.col("value")).alias("text")).distinct()
    return _violations(shown.join(allowed, ["page_id", "text"], "left_anti"), "copy_outside_catalog", F.col("text"))


def check_unowned_copy(nodes: DataFrame) -> DataFrame:
    """Copy that the browser makes: reversed text, numbers of ordered lists, numeric controls."""
    own = _exposed(nodes).where("kind = 'el'")
    roles = F.split(F.lower(F.coalesce(P.attr("role"), F.lit(""))), r"\s+")
    numeric = F.col("tag").isin(NUMERIC_TAGS) | ((F.col("tag") == "input") & F.lower(F.coalesce(P.attr("type"), F.lit("text"))).isin(NUMERIC_INPUTS)) | F.arrays_overlap(roles, F.array(*map(F.lit, NUMERIC_ROLES)))
    numeric = numeric | (F.size(F.map_filter("attrs", lambda k, v: k.isin(NUMERIC_ATTRIBUTES) & (F.trim(v) != ""))) > 0)
    rule = F.when(F.col("tag") == "bdo", "reversed_copy").when((F.col("tag") == "ol") | ((F.col("tag") == "li") & F.map_contains_key("attrs", "value")), "ordered_list").when(numeric, "numeric_control")
    found = own.withColumn("rule", rule).where("rule is not null")
    return found.select(F.col("page_id").alias("doc_id"), F.col("rule").alias("rule_id"), F.col("tag").alias("evidence"))


def _when(test: Column, *values: Column | str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])).otherwise(F.array().cast("array<string>"))


def copy_catalog(records: DataFrame, id_col: str, year: Column | None = None) -> DataFrame:
    """Every string that a record's page may show: doc_id, value (``copy_lists``, one by one)."""
    return copy_lists(records, id_col, year).select("doc_id", F.explode("catalog").alias("value"))


def copy_lists(records: DataFrame, id_col: str, year: Column | None = None) -> DataFrame:
    """All strings that a record's page may show: doc_id, catalog (an array, each string once); fields that the records lack count as null.

    Reviews are those of ``records.usable_reviews``; ``review_mode`` and
    ``aggregate`` (score, count) decide what may be said of them, ``reviews_url`` whether they are linked.
    """
    kinds = {"services": "array<string>", "service_promises": "array<string>", "reviews": "array<struct<author:string,rating:double,date:string,platform:string,text:string>>", "aggregate": "struct<score:double,count:bigint>"}
    has = lambda c, kind="string": F.col(c) if c in records.columns else F.lit(None).cast(kind)
    flag = lambda c: F.coalesce(has(c, "boolean"), F.lit(False))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    some = lambda c: F.coalesce(has(c, kinds[c]), F.array().cast(kinds[c]))
    city, state, phone, hours, radius = (F.nullif(F.trim(has(c)), F.lit("")) for c in ("city", "state", "phone", "hours", "service_radius"))
    name = F.coalesce(F.nullif(F.trim(has("display_name")), F.lit("")), R.display_name(F.col("business_name")))
    year = F.lit(None).cast("string") if year is None else year.cast("string")
    trade = F.trim(has("trade"))
    forms = F.element_at(F.create_map(*[x for k, v in R.TRADE_FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.lower(trade))
    titled = F.array_join(F.transform(F.split(trade, r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    unverified = R.unverified_claims(has("service_promises", kinds["service_promises"]), {c: has(c, "boolean") for c in R.FIELD_CLAIMS})
    same_day = ~F.array_contains(unverified, "Same Day")
    badge = F.when(flag("has_24_7"), "Available 24/7").when(same_day, "Same-Day Service")
    miles = F.nullif(F.regexp_extract(radius, r"(?i)(?<!\d)(\d{1,4})\s*(?:-\s*)?(?:miles?|mi)\b", 1), F.lit(""))
    mode, score, count = has("review_mode"), has("aggregate", kinds["aggregate"])["score"].cast("string"), has("aggregate", kinds["aggregate"])["count"].cast("string")
    scored = [say(score, " out of 5"), say("Based on ", count, " Google Reviews"), say("Based on ", count, " reviews on Google")]
    called = [say(x, " ", phone) for x in PHONE_LABELS]
    parts = [
        F.array(*map(F.lit, FIXED_COPY)), F.array(*[F.trim(has(c)) for c in RECORD_FIELDS]), F.array(name), F.coalesce(forms, F.array(titled, trade)),
        F.array(say(name, " — ", city, ", ", state), say("© ", year, " ", F.col("business_name"), ". All rights reserved."), say("Serving ", city, ", ", state, "."), say("Serving the ", city, " area.")),
        F.array(say("Serving ", F.regexp_replace(radius, r"\.+$", ""), "."), say(miles, "-MILE RADIUS"), say(miles, "-mile service area centered on ", city, ", ", state)),
        F.coalesce(F.transform(F.split(hours, ","), lambda x: F.trim(x)), F.array().cast("array<string>")), some("services"), F.transform(some("services"), lambda s: F.concat(F.lit("Ask us about "), squeezed(s))),
        F.transform(some("service_promises"), lambda x: F.trim(x)), R.verified_claims(unverified),
        _when(phone.isNotNull(), *PHONE_LABELS, *called, say("Call ", phone, " →")), _when(~R.blank(has("owner_email")), *EMAIL_LABELS), _when(flag("has_24_7"), "24/7 Emergency Service Available"),
        _when(badge.isNotNull(), badge), _when(badge.isNotNull() & phone.isNotNull(), *[x for c in (phone, *called) for x in (say(badge, " ", c), say(c, " ", badge))]),
        F.array(K.trust_trailer(flag("licensed_and_insured"), flag("family_owned"), flag("locally_owned"))),
        F.array(say("Established in ", has("established_year", "int").cast("string")), say(has("years_in_business", "int").cast("string"), " years in business")),
        _when(mode != "omit", "Customer Reviews"), _when(~R.blank(has("reviews_url")), F.when(mode == "cards", "Read All on Google").otherwise("Read All Reviews on Google")),
        F.when(F.coalesce(mode == "cards", F.lit(False)), F.flatten(F.transform(some("reviews"), lambda r: F.array(r["author"], r["rating"].cast("string"), r["date"], r["platform"], r["text"])))).otherwise(F.array().cast("array<string>")),
        _when(score.isNotNull(), score, *scored, say("· ", scored[1]), *[say(star, scored[0], " ", c) for star in ("", "★★★★★ ") for c in scored[1:]]),
    ]
    return records.select(F.col(id_col).alias("doc_id"), F.filter(F.array_distinct(F.array_compact(F.concat(*parts))), lambda v: F.trim(v) != "").alias("catalog"))
