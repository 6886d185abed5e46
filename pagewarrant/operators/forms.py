"""Forms, controls and scopes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pages as P

CONTROLS = ["input", "select", "textarea", "button"]
# Inputs that hold no data, inputs that act, methods of forms.
NO_DATA = ["button", "hidden", "image", "reset", "submit"]
SUBMITS = ["submit", "image"]
METHODS = ["get", "post", "dialog"]


def _kind() -> Column:
    return F.lower(F.coalesce(P.attr("type"), F.when(F.col("tag") == "button", "submit").otherwise("text")))


def _inside(nodes: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """The innermost of the outer elements around each node: page_id, node_id, name."""
    up = nodes.select("page_id", "node_id", F.explode("ancestors").alias(name))
    return up.join(outer.select("page_id", F.col("node_id").alias(name)), ["page_id", name]).groupBy("page_id", "node_id").agg(F.max(name).alias(name))


def form_owner(nodes: DataFrame) -> DataFrame:
    """Controls with their form: page_id, node_id, tag, type, form_id, invalid (a form attribute that names no single form)."""
    forms = nodes.where("tag = 'form'")
    named = forms.where(P.attr("id").isNotNull()).groupBy("page_id", P.attr("id").alias("explicit")).agg(F.count("*").alias("n"), F.min("node_id").alias("named"))
    own = nodes.where(F.col("tag").isin(CONTROLS))
    each = own.select("page_id", "node_id", "tag", _kind().alias("type"), P.attr("form").alias("explicit"))
    each = each.join(named, ["page_id", "explicit"], "left").join(_inside(own, forms, "around"), ["page_id", "node_id"], "left")
    good = F.when(F.col("explicit").isNotNull(), F.when(F.col("n") == 1, F.col("named"))).otherwise(F.col("around"))
    return each.select("page_id", "node_id", "tag", "type", good.alias("form_id"), (F.col("explicit").isNotNull() & ~F.coalesce(F.col("n") == 1, F.lit(False))).alias("invalid"))


def control_labels(nodes: DataFrame) -> DataFrame:
    """Data controls with their label: aria-label, else the label around, else the label for it, else placeholder, else title."""
    own = nodes.where(F.col("tag").isin(CONTROLS) & ~_kind().isin(NO_DATA) & (F.col("tag") != "button"))
    labels = nodes.where("tag = 'label'")
    texts = P._inner_text(nodes, labels).select("page_id", F.col("node_id").alias("label"), F.col("text").alias("label_text"))
    around = _inside(own, labels, "label").join(texts, ["page_id", "label"]).select("page_id", "node_id", F.col("label_text").alias("around"))
    aimed = labels.where(P.attr("for").isNotNull()).select("page_id", P.attr("for").alias("id"), F.col("node_id").alias("label")).join(texts, ["page_id", "label"]).groupBy("page_id", "id").agg(F.min_by("label_text", "label").alias("aimed"))
    each = own.select("page_id", "node_id", *[P.attr(a).alias(a.replace("-", "_")) for a in ("id", "aria-label", "placeholder", "title")])
    each = each.join(around, ["page_id", "node_id"], "left").join(aimed, ["page_id", "id"], "left")
    pick = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("aria_label", "around", "aimed", "placeholder", "title")])
    return each.select("page_id", "node_id", pick.alias("label")).where("label is not null")


def submission(nodes: DataFrame) -> DataFrame:
    """Submit controls with destination and method in effect: overrides first, unknown methods are get."""
    forms = nodes.where("tag = 'form'").select("page_id", F.col("node_id").alias("form_id"), P.attr("action").alias("form_action"), P.attr("method").alias("form_method"))
    own = form_owner(nodes).where(F.col("type").isin(SUBMITS)).join(nodes.select("page_id", "node_id", P.attr("formaction").alias("over"), P.attr("formmethod").alias("over_method")), ["page_id", "node_id"])
    method = F.lower(F.coalesce("over_method", "form_method", F.lit("get")))
    return own.join(forms, ["page_id", "form_id"], "left").select("page_id", "node_id", "form_id", "invalid", F.coalesce("over", "form_action", F.lit("")).alias("endpoint"), F.when(method.isin(METHODS), method).otherwise("get").alias("method"))


def form_submission(nodes: DataFrame) -> DataFrame:
    """One endpoint and method per form, null where its submit controls differ: page_id, form_id, endpoint, method.

    A form without submit controls goes by its own attributes.
    """
    forms = nodes.where("tag = 'form'").select("page_id", F.col("node_id").alias("form_id"), F.coalesce(P.attr("action"), F.lit("")).alias("own"), F.lower(F.coalesce(P.attr("method"), F.lit("get"))).alias("own_method"))
    sets = submission(nodes).where("form_id is not null").groupBy("page_id", "form_id").agg(F.collect_set(F.struct("endpoint", "method")).alias("s"))
    both = forms.join(sets, ["page_id", "form_id"], "left")
    alone = F.struct(F.col("own").alias("endpoint"), F.when(F.col("own_method").isin(METHODS), F.col("own_method")).otherwise("get").alias("method"))
    one = F.when(F.col("s").isNull(), alone).when(F.size("s") == 1, F.col("s")[0])
    return both.select("page_id", "form_id", one["endpoint"].alias("endpoint"), one["method"].alias("method"))


def form_controls(nodes: DataFrame) -> DataFrame:
    """What ``ground.ground_form_fields`` asks for: page_id, form_id, label, ord, endpoint."""
    owned = form_owner(nodes).where("not invalid and form_id is not null").select("page_id", "node_id", "form_id")
    return control_labels(nodes).join(owned, ["page_id", "node_id"]).join(form_submission(nodes), ["page_id", "form_id"]).select("page_id", "form_id", "label", F.col("node_id").alias("ord"), "endpoint")


def available_actions(nodes: DataFrame) -> DataFrame:
    """Links and buttons that can be used: not inert, disabled or in a disabled fieldset (but for its first legend)."""
    off = P._flag(nodes, F.map_contains_key("attrs", "inert"), "inert")
    sets = off.where((F.col("tag") == "fieldset") & F.map_contains_key("attrs", "disabled"))
    legends = off.where("tag = 'legend'").join(sets.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"]).groupBy("page_id", "parent_id").agg(F.min("node_id").alias("legend"))
    actions = off.where((F.col("tag").isin("a", "button") | ((F.col("tag") == "input") & _kind().isin("button", "image", "reset", "submit"))) & ~F.col("inert") & ~((F.col("tag") != "a") & F.map_contains_key("attrs", "disabled")))
    shut = _inside(actions, sets, "parent_id").join(legends, ["page_id", "parent_id"], "left")
    shut = shut.join(actions.select("page_id", "node_id", "ancestors"), ["page_id", "node_id"]).where(~F.coalesce(F.array_contains("ancestors", F.col("legend")), F.lit(False)))
    return actions.join(shut.select("page_id", "node_id"), ["page_id", "node_id"], "left_anti").select("page_id", "node_id", "tag")


def section_scopes(nodes: DataFrame) -> DataFrame:
    """Content sections: articles and sections, and a main with exactly one h1: page_id, scope_id, tag."""
    heads = nodes.where("tag = 'h1'").select("page_id", F.explode("ancestors").alias("node_id")).groupBy("page_id", "node_id").agg(F.count("*").alias("n"))
    own = nodes.where(F.col("tag").isin("article", "section", "main")).join(heads, ["page_id", "node_id"], "left")
    return own.where((F.col("tag") != "main") | (F.col("n") == 1)).select("page_id", F.col("node_id").alias("scope_id"), "tag")


def target_scopes(nodes: DataFrame) -> DataFrame:
    """Elements that a fragment can name, each id once per page: page_id, scope_id, fragment."""
    own = nodes.where((F.col("kind") == "el") & (F.coalesce(P.attr("id"), F.lit("")) != ""))
    n = F.count("*").over(Window.partitionBy("page_id", P.attr("id")))
    return own.withColumn("n", n).where("n = 1").select("page_id", F.col("node_id").alias("scope_id"), P.attr("id").alias("fragment"))


def record_scopes(nodes: DataFrame, most: int = 200) -> DataFrame:
    """Record fragments: atomic elements, and containers that hold no other record; the first ``most`` of a page."""
    atomic, boxes = ["address", "blockquote", "details", "figure", "li", "p", "td", "th", "tr"], ["article", "details", "div", "dl", "figure", "section", "table", "ul", "ol", "menu"]
    own = P.suppressed(P.semantic(nodes)).where("not ignored and not suppressed and kind = 'el'")
    every = own.where(F.col("tag").isin(atomic + boxes))
    outer = every.select("page_id", F.explode("ancestors").alias("node_id")).distinct()
    leaves = every.join(outer, ["page_id", "node_id"], "left_anti").unionByName(every.where(F.col("tag").isin("article", "li", "tr", "figure"))).dropDuplicates(["page_id", "node_id"])
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))
    return leaves.withColumn("n", n).where(F.col("n") <= most).select("page_id", F.col("node_id").alias("scope_id"), "tag")


def scope_texts(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Segments inside scopes: page_id, scope_id, segment (``ground.ground_items`` asks for these)."""
    seg = P.segments(nodes)
    up = nodes.where("kind = 'el'").select("page_id", "node_id", F.explode(F.concat("ancestors", F.array("node_id"))).alias("scope_id"))
    return up.join(scopes.select("page_id", "scope_id"), ["page_id", "scope_id"]).join(seg.select("page_id", "node_id", "segment"), ["page_id", "node_id"]).select("page_id", "scope_id", "segment")


def accessible_names(nodes: DataFrame, depth: int = 8) -> DataFrame:
    """Names of elements: the texts that aria-labelledby names, else aria-label, else the content: page_id, node_id, name.

    A reference counts if its id is unique in the page; a chain is followed
    ``depth`` times at most, and a cycle gives an empty name.
    """
    ids = target_scopes(nodes).select("page_id", F.col("fragment").alias("ref"), F.col("scope_id").alias("target"))
    own = nodes.where("kind = 'el'").select("page_id", "node_id", P.attr("aria-labelledby").alias("by"), P.attr("aria-label").alias("label"))
    content = P.visible_text(nodes).select("page_id", "node_id", F.col("text").alias("content"))
    plain = own.join(content, ["page_id", "node_id"], "left").select("page_id", "node_id", "by", F.coalesce(F.nullif(F.trim("label"), F.lit("")), "content", F.lit("")).alias("name"))
    known = plain.select("page_id", F.col("node_id").alias("target"), F.col("by").alias("next"), F.col("name").alias("found"))
    refs = plain.where(F.trim(F.coalesce("by", F.lit(""))) != "").select("page_id", "node_id", F.posexplode(F.split(F.trim("by"), r"\s+")).alias("ord", "ref"))
    refs = refs.join(ids, ["page_id", "ref"]).withColumn("seen", F.array("node_id"))
    done = None
    for _ in range(depth):
        step = refs.join(known, ["page_id", "target"])
        cycle = F.array_contains("seen", F.col("target"))
        end = step.where(cycle | F.coalesce(F.trim("next"), F.lit("")).eqNullSafe("")).select("page_id", "node_id", "ord", F.when(cycle, "").otherwise(F.col("found")).alias("found"))
        done = end if done is None else done.unionByName(end)
        more = step.where(~cycle & (F.coalesce(F.trim("next"), F.lit("")) != "")).withColumn("ref", F.element_at(F.split(F.trim("next"), r"\s+"), 1)).withColumn("seen", F.concat("seen", F.array("target")))
        refs = more.select("page_id", "node_id", "ord", "ref", "seen").join(ids, ["page_id", "ref"])
    joined = done.groupBy("page_id", "node_id").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "found"))), lambda x: x["found"]), " ")).alias("referred"))
    return plain.join(joined, ["page_id", "node_id"], "left").select("page_id", "node_id", F.when(F.col("referred").isNotNull(), F.col("referred")).otherwise(F.col("name")).alias("name"))
