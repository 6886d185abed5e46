"""How document filters interact: what each removes at each place of every order.

Words are counted in a document-term matrix (``term_matrix.py``): row sums and
numbers of entries decide the two filters on words, the other flags are
expressions on the text.  Documents that fail the same filters are counted
together, so every order and step is read off at most ``2 ** n`` patterns of a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored
from .term_matrix import word_measures

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
_KEYS = ["_k_id", "_k_digest", "part", "capitals", "symbols", "short", "repeating"]


def _first_copies(counted: DataFrame) -> DataFrame:
    """Adds ``copy``: whether a row of a smaller id has the same digest.

    Copies are told by the least id of a digest, joined on digest and id, so
    that a large group of copies meets in no task.
    """
    first = counted.groupBy("_k_digest").agg(F.min("_k_id").alias("_k_id")).withColumn("_first", F.lit(True))
    return counted.join(first, ["_k_digest", "_k_id"], "left").withColumn("copy", F.col("_first").isNull() & F.col("_k_id").isNotNull()).drop("_first")


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, A, B, C, D, E, good, toxic, n``: how many documents fail each set of filters, by part and label.

    A: under 200 words; B: under 50 distinct words in 100; C: over 3 capitals
    A-Z in 100 characters; D: a symbol; E: a document with a smaller id has the same text.
    A null text is empty, a null part the empty string.  A row with a null id
    is no copy and has no copies; rows of one id and text are no copies of each
    other.  Several labels of one id: ``good`` or ``toxic`` if one says 1.
    Very long texts are read whole; empty tables give no rows; other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    own = docs.select(
        F.col(f"`{id_col}`").alias("_k_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_k_digest"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        (100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long")).alias("capitals"), text.rlike(SYMBOLS).alias("symbols"), text.alias("_k_text"),
    )
    measured = word_measures(own, "_k_text")
    short, repeating = F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")
    counted = stored(measured.withColumns({"short": short, "repeating": repeating}).groupBy(_KEYS).agg(F.count("*").alias("n")), "filter-flags")
    one = lambda c: F.coalesce(F.max(F.col(f"`{c}`") == 1), F.lit(False))
    known = labels.groupBy(F.col(f"`{id_col}`").alias("_k_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    flagged = _first_copies(counted).join(known, "_k_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    named = {"A": "short", "B": "repeating", "C": "capitals", "D": "symbols", "E": "copy"}
    return flagged.groupBy("part", *[F.col(c).alias(k) for k, c in named.items()], "good", "toxic").agg(F.sum("n").alias("n"))


def interactions(flagged: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step`` and counts, for each part, each order of filters and each step, zeros included.

    ``flagged`` has ``part, n, good, toxic`` and a boolean column for each
    filter letter (true: fails).  Counts of documents: ``kept`` after the step,
    ``removed`` in it, ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter only), ``good_lost`` and ``toxic_lost`` (removed in it
    with that label), ``shapley`` (its filter's removed, summed over all orders).
    """
    bit = {c: 1 << k for k, c in enumerate(filters)}
    shares = F.array(*[F.lit(factorial(len(filters)) // k) for k in range(1, len(filters) + 1)])
    pattern = sum((F.col(c).cast("int") * b for c, b in bit.items()), F.lit(0))
    if_ = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    cells = flagged.groupBy("part", pattern.alias("p")).agg(F.sum("n").alias("n"), if_("good").alias("good"), if_("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("p", "n", "good", "toxic")).alias("cells"))  # a cell for each set of filters
    orders = ["".join(x) for x in permutations(filters)]
    steps = [(o, k + 1, bit[c], sum(bit[x] for x in o[:k])) for o in orders for k, c in enumerate(o)]
    spelt = ",".join(f"named_struct('filter_order','{o}','step',{k},'own',{own},'before',{before})" for o, k, own, before in steps)
    each = parts.select("part", "cells", F.explode(F.expr(f"array({spelt})")).alias("s")).select("part", "cells", "s.*")

    def total(test, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda n, x: n + value(x))

    own, before = F.col("own"), F.col("before")
    fails = lambda x: x["p"].bitwiseAND(own) != 0
    gone = lambda x: x["p"].bitwiseAND(before) != 0
    here = lambda x: fails(x) & ~gone(x)
    return each.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~gone(x)).alias("kept"), total(here).alias("removed"), total(lambda x: fails(x) & gone(x)).alias("redundant"), total(lambda x: x["p"] == own).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # of the filters that a document fails each stands first in an equal share of all orders
        total(fails, lambda x: x["n"] * F.element_at(shares, F.bit_count(x["p"]).cast("int"))).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The interactions of the five filters of ``document_flags``."""
    return interactions(document_flags(docs, labels, **columns))
