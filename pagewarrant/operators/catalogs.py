"""Dimension tables from Markdown sections and templates, and text redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tokens of a catalog at most; they become literals of the plan.
MOST_TOKENS = 10_000
# Properties that a theme sets.
THEME_PROPERTIES = ["--font-display", "--font-body", "--font-serif", "--card-radius"]


def trade_themes(sections: DataFrame, known: list[str]) -> DataFrame:
    """Themes that a trade's section allows, in order, known ones only: trade, ord, theme."""
    listed = F.regexp_extract("body", r"(?mi)^\W*allowed[_ ]themes\W*:?\s*(.+)$", 1)
    each = sections.select(F.lower(F.trim("heading")).alias("trade"), F.posexplode(F.regexp_extract_all(listed, F.lit("[a-z][a-z-]+"), 0)).alias("ord", "theme"))
    return each.where(F.col("theme").isin(known))


def trade_palettes(sections: DataFrame) -> DataFrame:
    """Pairs of accent and dark accent colours of a trade's section, in order: trade, ord, accent, dark."""
    hexes = F.regexp_extract_all("body", F.lit(r"(?i)accent:?\s*`?(#[0-9a-f]{6})`?.*?dark:?\s*`?(#[0-9a-f]{6})"), 1)
    darks = F.regexp_extract_all("body", F.lit(r"(?i)accent:?\s*`?(#[0-9a-f]{6})`?.*?dark:?\s*`?(#[0-9a-f]{6})"), 2)
    return sections.select(F.lower(F.trim("heading")).alias("trade"), F.posexplode(F.arrays_zip(hexes.alias("accent"), darks.alias("dark"))).alias("ord", "p")).select("trade", "ord", "p.accent", "p.dark")


def trade_queries(sections: DataFrame) -> DataFrame:
    """Image search of each trade's section: trade, query."""
    found = sections.select(F.trim(F.regexp_extract("heading", r"^\s*TRADE:\s*(.*)$", 1)).alias("trade"), F.trim(F.regexp_extract("body", r'(?m)^\s*hero_search_query:\s*"([^"\n]+)"', 1)).alias("query"))
    return found.where("trade <> '' and query <> ''")


def theme_defs(sections: DataFrame) -> DataFrame:
    """Font link and properties of each theme's section, or the first thing that it lacks: theme, font_link, props, error."""
    link = F.regexp_extract("body", '<link href="https://fonts[.]googleapis[.]com/[^"<>]+" rel="stylesheet">', 0)
    value = {name: F.trim(F.regexp_extract("body", rf"(?m)^{name}:([^\n]*);[ \t]*$", 1)) for name in THEME_PROPERTIES}
    error = F.when(link == "", "font_link")
    for name, v in value.items():
        error = error.when(v == "", name).when(v.rlike("[{}<>]"), F.lit("unsafe " + name))
    props = F.map_from_arrays(F.array(*map(F.lit, value)), F.array(*value.values()))
    own = sections.select(F.trim(F.regexp_extract("heading", r"^(.*?)\s+--", 1)).alias("theme"), link.alias("font_link"), props.alias("props"), error.alias("error")).where("theme <> ''")
    sound = F.col("error").isNull()
    return own.select("theme", F.when(sound, F.col("font_link")).alias("font_link"), F.when(sound, F.col("props")).alias("props"), "error")


def class_vocab(templates: DataFrame, col: str = "text") -> DataFrame:
    """Classes of attributes and of selectors, sorted: class."""
    attrs = templates.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?i)class\s*=\s*[\"']([^\"']*)[\"']"), 1)).alias("v")).select(F.explode(F.split(F.trim("v"), r"\s+")).alias("class"))
    css = templates.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), 1)).alias("css"))
    rules = css.select(F.explode(F.regexp_extract_all("css", F.lit(r"([^{}]+)\{"), 1)).alias("sel")).select(F.explode(F.regexp_extract_all("sel", F.lit(r"\.(-?[A-Za-z_][\w-]*)"), 1)).alias("class"))
    return attrs.union(rules).where("class <> ''").distinct().orderBy(F.lower("class"), "class")


def css_class_roles(templates: DataFrame, col: str = "text") -> DataFrame:
    """Selectors that compose layout or transform text: selector, role."""
    css = templates.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), 1)).alias("css"))
    both = css.select(F.explode(F.arrays_zip(F.regexp_extract_all("css", F.lit(r"([^{}]+)\{([^{}]*)\}"), 1).alias("sel"), F.regexp_extract_all("css", F.lit(r"([^{}]+)\{([^{}]*)\}"), 2).alias("body"))).alias("r"))
    roles = F.array_compact(F.array(F.when(F.col("r.body").rlike(r"(?i)\bdisplay\s*:\s*(?:inline-)?(?:flex|grid)\b"), "layout"), F.when(F.col("r.body").rlike(r"(?i)\btext-transform\s*:"), "transform")))
    return both.select(F.explode(F.split("r.sel", ",")).alias("selector"), roles.alias("roles")).select(F.trim("selector").alias("selector"), F.explode("roles").alias("role")).distinct()


def page_class_sets(vocab: DataFrame, shared: list[str]) -> DataFrame:
    """Interior classes (``page-`` without the shared ones) and the homepage's (the rest): class, page_kind."""
    interior = F.col("class").startswith("page-") & ~F.col("class").isin(shared)
    return vocab.select("class", F.when(interior, "interior").otherwise("homepage").alias("page_kind"))


def bracket_tokens(texts: DataFrame, col: str = "text") -> DataFrame:
    """Distinct square-bracket placeholders: token."""
    return texts.select(F.explode(F.regexp_extract_all(col, F.lit(r"\[[A-Z][^\[\]\n]*\]"), 0)).alias("token")).distinct()


def forbidden_tokens(tokens: DataFrame, records: DataFrame, id_col: str, names: str = "services") -> DataFrame:
    """Placeholders that a record's own names do not hold: id, token."""
    own = records.select(id_col, F.explode(names).alias("name")).select(id_col, F.explode(F.regexp_extract_all("name", F.lit(r"\[[^\[\]]+\]"), 0)).alias("token")).distinct()
    names_of = [r["token"] for r in tokens.select("token").distinct().limit(MOST_TOKENS + 1).collect()]
    if len(names_of) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} placeholder tokens: a catalog of a prompt has a few dozen")
    every = records.select(id_col, F.explode(F.array(*map(F.lit, sorted(names_of))).cast("array<string>")).alias("token"))
    return every.join(own, [id_col, "token"], "left_anti")


def keep_branch(text: Column, mode: Column) -> Column:
    """Text with only one of the branches marked ``<!-- A -->`` to ``<!-- /A -->`` (A cards, B aggregate, C omit)."""
    wanted = F.when(mode == "cards", "A").when(mode == "aggregate", "B").otherwise("C")
    out = text
    for name in "ABC":
        out = F.when(wanted == name, F.regexp_replace(out, rf"(?s)<!-- /?{name} -->", "")).otherwise(F.regexp_replace(out, rf"(?s)<!-- {name} -->.*?<!-- /{name} -->", ""))
    return out


def redact(text: Column, phrases: Column) -> Column:
    """Text without the phrases of an array, longest first, in any case."""
    order = F.transform(F.array_sort(F.transform(phrases, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])
    return F.trim(F.regexp_replace(F.aggregate(order, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?i)(?<!\w)\Q"), p, F.lit(r"\E(?!\w)")), "")), r" {2,}", " "))
