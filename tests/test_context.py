"""What stands around occurrences, case by case."""

import pytest
from pyspark.sql import functions as F

from pagewarrant.functions import context as C
from pagewarrant.operators import numbers as N
from pagewarrant.operators import pages as P


def _judged(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, t string, p string").orderBy("k").select(f(F.col("t"), F.col("p"))).collect()]


def test_denied(spark):
    rows = {
        "we fix pipes": True, "we do not fix pipes": False, "we don’t fix pipes": False, "not only fix pipes": True, "no roofs, but we fix pipes": True, "we never paint; we fix pipes": True, "fix pipes: unavailable": False,
        "fix pipes, however, never on sundays": False, "fix pipes however never": True, "no. fix pipes": True, "we fix pipes not just drains": True, "do not fix pipes. do fix pipes": True, "fix pipesy": False, "": False,
        "not fix pipes nor fix pipes": False, "fix pipesfix pipes": False, "we fix pipes expired": False, "we fix pipes, yet no roofs": True, "cannot fix pipes? fix pipes": True,
    }
    assert dict(zip(rows, _judged(spark, [(t, "fix pipes") for t in rows], C.stated))) == rows


def test_asserted_and_assertive(spark):
    whole = {"fix pipes": True, "we offer fix pipes": True, "fix pipes.": True, "fix pipes?": False, "fix pipes daily": False, "not only fix pipes but drains": True, "not only fix pipes": False, "they fix pipes": False, "a. fix pipes. b": True, "call for fix pipes!": True, "fix pipes only": False, "if so. fix pipes": True}
    assert dict(zip(whole, _judged(spark, [(t, "fix pipes") for t in whole], C.asserted))) == whole
    said = {"fix pipes": True, "fix pipes if dry": False, "fix pipes? yes": False, "fix pipes at noon": False, "fix pipes as part of it": False, "call to fix pipes": False, "fix pipes to book": True, "not only fix pipes": True, "only fix pipes": False, "fix pipes; when dry": False, "fix pipes. when dry": True, "not only is it to fix pipes": True}
    assert dict(zip(said, _judged(spark, [(t, "fix pipes") for t in said], C.assertive))) == said


def test_odd_phrases(spark):
    rows = [("a.b*c \\E [x", "b*c"), ("a \\E b", "\\E"), ("a", ""), (None, "a"), ("a", None), ("a", "a")]
    assert _judged(spark, rows, C.stated) == [True, True, False, None, False, True]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Fax 555-111-2222", []), ("Phone 555-111-2222", ["555-111-2222"]), ("Phone: 555-111-2222, fax: 555-333-4444", ["555-111-2222"]), ("555-111-2222 phone / 555-333-4444 fax", ["555-111-2222"]),
        ("Fax — 555-333-4444; call 555-111-2222", ["555-111-2222"]), ("Fax No. 555-333-4444", []), ("facsimile dept. 555-333-4444 phone 555-111-2222", ["555-111-2222"]), ("Fax 555-333-4444. 555-111-2222", ["555-111-2222"]),
        ("Fax or phone 555-111-2222", ["555-111-2222"]), ("phone fax 555-333-4444", []), ("call 555-111-2222 ext. 9", ["555-111-2222 ext. 9"]), ("Do not call 555-111-2222", []), ("Never hesitate to call 555-111-2222", ["555-111-2222"]),
        ("٥٥٥-111-2222", ["555-111-2222"]), ("555-111-2222? fax", []), ("no number", []),
    ],
)
def test_numbers(spark, text, want):
    df = spark.createDataFrame([(1, text), (1, text)], "k long, segment string")
    assert sorted({r["raw"] for r in N.stated_numbers(df, "k").collect()}) == want


def test_line_groups_part_numbers_from_roles(spark):
    df = spark.createDataFrame([(1, "Fax 555-333-4444  555-111-2222"), (2, "Fax 555-333-4444 555-111-2222")], "k long, segment string")
    assert sorted((r["k"], r["raw"]) for r in N.stated_numbers(df, "k").collect()) == [(1, "555-111-2222")]


def test_field_labels(spark):
    rows = {"hours": True, "hours: 9 to 5": True, "office hours - 9": True, "hours 9": False, "our hours: 9": False, "address –": False, "location—elm": True}
    assert dict(zip(rows, _judged(spark, [(t, "") for t in rows], lambda t, p: C.opens_field(t)))) == rows
    got = _judged(spark, [("address: 1 elm", "1 elm"), ("address 1 elms", "1 elm"), ("the address: 1 elm", "1 elm")], lambda t, p: C.labelled(t, p, ["address"]))
    assert got == [True, False, False]


def test_addresses_in_a_row(spark):
    df = spark.createDataFrame([(1, "Mail a@x.test or B@x.test"), (2, "No mail to a@x.test. b@x.test"), (3, "a@x.test if b@y.test")], "k long, segment string")
    assert sorted((r["k"], r["email"]) for r in P.emails(df, "k").collect()) == [(1, "a@x.test"), (1, "b@x.test"), (2, "b@x.test")]
