"""Phone numbers of texts and the roles (phone, fax ...) that own them.

A text with a fax in it becomes rows of numbers, roles and what lies between.
Rows belong to the group that began at the last break; a number is owned by the
role before or after it in its group, found as of its place in either
direction, if that role is meant for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import context as C

# Roles of numbers, marks between fields, abbreviations that end in a full stop, labels of an office.
ROLES, FAX = "fax facsimile phone telephone mobile cell call".split(), ["fax", "facsimile"]
BREAKS = "[.!?;|¦•·●▪‣∙◦○◆◇–—\ue000]"
LABEL = r"(?i)^[\sA-Z0-9_&'’(),./:#\-–—]*$"
ABBREVIATION, OFFICE = r"(?i)(?<![A-Z0-9])(dept|no)\.", r"(?i:\s*(?:[A-Z0-9][A-Z0-9_&'’./\-]*\s+)?office(?:\s+(?:line|number|phone))?\s*[:#\-–—])"
_ROLE = r"(?i:\b(?:" + "|".join(ROLES) + r")\b)"
_TOKEN = rf"(?s)\ue001[^\ue002]*\ue002|{_ROLE}|.(?:(?!\ue001|{_ROLE}).)*"
#: Closes the mark of a number that the text denies or qualifies.
_UNSTATED = "\ue007"


def _one_field(gap: Column, role_first: bool) -> Column:
    """Whether what lies between a role and a number is one label, so that its marks part nothing."""
    rest = F.regexp_replace(gap, ABBREVIATION + (f"(?!{OFFICE})" if role_first else ""), "$1 ")
    rest = F.regexp_replace(rest, r"[–—](?=[\s–—]*$)" if role_first else r"(?<=^[\s–—]{0,64})[–—]", " ")
    return gap.rlike(LABEL) & ~rest.rlike(BREAKS)


def number_roles(texts: DataFrame, keys: list[str], marked: str = "marked") -> DataFrame:
    """Numbers of marked texts (``keys`` name one text): keys, n (its place among the text's numbers), raw, is_callable.

    Where a group knows one role, its numbers have it.  Of several, a role is
    meant for the number after it, unless the one before is nearer; a number
    that no role is meant for is callable if no fax is in its group, one of
    roles at odds is not.
    """
    tokens = texts.select(*keys, F.posexplode(F.regexp_extract_all(marked, F.lit(_TOKEN), 0)).alias("_at", "token"))
    kind = F.when(F.col("token").startswith(C.OPEN), "number").when(F.lower("token").isin(ROLES), "role").otherwise("gap")
    line = Window.partitionBy(*keys).orderBy("_at")
    rows = tokens.withColumn("kind", kind).withColumn("size", F.length(F.regexp_replace("token", f"[{C.OPEN}{C.CLOSE}{_UNSTATED}]", "")))
    rows = rows.select("*", (F.sum("size").over(line) - F.col("size")).alias("start"), F.lag("kind").over(line).alias("left"), F.lead("kind").over(line).alias("right"))
    token, left, right = F.col("token"), F.col("left"), F.col("right")
    joined = ((left == "role") & (right == "number") & _one_field(token, True)) | ((left == "number") & (right == "role") & _one_field(token, False))
    parts = (F.col("kind") == "gap") & token.rlike(BREAKS) & ~F.coalesce(joined, F.lit(False))
    rows = rows.withColumn("group", F.sum(parts.cast("int")).over(line)).where("kind <> 'gap'").withColumn("end", F.col("start") + F.col("size"))

    group = [*keys, "group"]
    before = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*group).orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*group)
    role, number = F.when(F.col("kind") == "role", F.lower("token")), F.col("kind") == "number"
    rows = rows.select(
        "*", role.alias("role"), F.min(role).over(whole).alias("a"), F.max(role).over(whole).alias("z"), F.coalesce(F.max(role.isin(FAX)).over(whole), F.lit(False)).alias("fax_near"),
        F.last(F.when(number, F.col("end")), True).over(before).alias("number_before"), F.first(F.when(number, F.col("start")), True).over(after).alias("number_after"),
    )
    leads = F.col("number_before").isNull() | F.coalesce(F.col("number_after") - F.col("end") <= F.col("start") - F.col("number_before"), F.lit(False))
    owner = F.when(F.col("kind") == "role", F.struct(F.col("role").isin(FAX).alias("fax"), leads.alias("leads")))
    rows = rows.select("*", F.last(owner, True).over(before).alias("role_before"), F.first(owner, True).over(after).alias("role_after"))
    owners = F.array_compact(F.array(F.when(F.col("role_before.leads"), F.col("role_before.fax")), F.when(~F.col("role_after.leads"), F.col("role_after.fax"))))
    fax = F.when((F.col("a") == F.col("z")) | (F.size(owners) == 0), F.col("fax_near")).otherwise(F.array_contains(owners, True))
    raw = F.translate(F.regexp_replace("token", f"[{C.OPEN}{C.CLOSE}]", ""), C._SAFE, C._STOPS)
    return rows.where("kind = 'number'").select(*keys, F.row_number().over(line).alias("n"), raw.alias("raw"), (~fax).alias("is_callable"))


def stated_numbers(texts: DataFrame, id_col: str, text: str = "segment") -> DataFrame:
    """Numbers as written that a text states: neither denied nor qualified there, nor owned by a fax: id_col, raw.

    Only texts that mention a fax are laid out in rows; all others are judged where they are.
    """
    source = C.ascii_digits(F.col(text))
    found = F.regexp_extract_all(C.plain(source), F.lit(C.PHONE), 0)
    judged = texts.where(source.rlike("[0-9]{4}")).select(id_col, C.plain(source).alias("_k_text"), found.alias("_k_found"), C.occurrences(C.mark_matches(source, C.PHONE), invites=True).alias("_k_o")).where(F.size("_k_found") > 0)
    fax = F.col("_k_text").rlike(r"(?i)\b(?:" + "|".join(FAX) + r")\b")
    ok = lambda o: ~o["denied"] & ~o["qualified"]
    easy = judged.where(~fax).select(id_col, F.explode(F.filter("_k_o", ok)).alias("o")).select(id_col, F.col("o.raw").alias("raw"))
    between = F.zip_with("_k_found", "_k_o", lambda m, o: F.concat(F.lit(C.OPEN), F.translate(m, C._STOPS, C._SAFE), F.when(ok(o), F.lit("")).otherwise(F.lit(_UNSTATED)), F.lit(C.CLOSE)))
    hard = judged.where(fax).select(id_col, F.xxhash64("_k_text").alias("_k_key"), C.woven(F.split("_k_text", C.PHONE, -1), between).alias("marked"))
    once = hard.groupBy(id_col, "_k_key").agg(F.first("marked").alias("marked"))  # a text says once what it says twice
    numbers = number_roles(once, [id_col, "_k_key"]).where(F.col("is_callable") & ~F.col("raw").endswith(_UNSTATED))
    return easy.unionByName(numbers.select(id_col, "raw"))
