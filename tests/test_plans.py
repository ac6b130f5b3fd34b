"""The query language: parsing, validation, compiled filters, views, search grammar."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sedgeline.functions import scalar as X
from sedgeline.functions import text as TX
from sedgeline.operators import search as S
from sedgeline.plans import dataset as D
from sedgeline.plans.predicates import compile_all, items_of, real, view_filter
from sedgeline.plans.spec import Aggregate, DatasetQuery, Filter, Group, Schema, SpecError, parse
from sedgeline.plans.views import View, guard, run

SCHEMA = Schema({"n": "number", "t": "text", "d": "date", "b": "checkbox", "l": "list"}, "k")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, 1.0, "Open", "2024-01-01", True, ["A", "b"]), (2, None, None, None, None, None), (3, 12.0, "", "2024-06-01", False, []), (4, 3.0, "closed%", "2024-03-01", True, ["c"])]
    d = spark.createDataFrame(data, "k long, n double, t string, d string, b boolean, l array<string>")
    return d.withColumn("d", F.to_date("d"))


def keys(rows, *filters, group=None):
    return [r["k"] for r in rows.where(compile_all([Filter(*f) for f in filters], group, SCHEMA)).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (("t", "equals", "OPEN"), [1]), (("t", "", ""), [2, 3]), (("t", "!=", "open"), [2, 3, 4]), (("n", "=", "12abc"), [3]), (("n", "not_equals", "1"), [2, 3, 4]),
        (("t", "contains", "e"), [1, 4]), (("t", "contains", "_pe"), [1]), (("t", "not_contains", "open"), [2, 3, 4]), (("t", "prefix", "CL"), [4]), (("t", "suffix", "%"), [1, 3, 4]),
        (("n", "gte", "3"), [3, 4]), (("d", "after", "2024-01-01"), [3, 4]), (("d", "on_or_before", "2024-03-01"), [1, 4]), (("b", "equals", "1"), [1, 4]), (("t", "in", "[open, closed%]"), [1, 4]),
        (("t", "not_in", "open"), [2, 3, 4]), (("l", "contains_any", "B,x"), [1]), (("l", "contains_none", "b"), [2, 3, 4]), (("t", "contains_none", "open"), [1, 2, 3, 4]), (("l", "contains_all", "a b"), [1]),
        (("n", "in", ""), []), (("n", "not_in", ""), [1, 2, 3, 4]), (("t", "likes", "open"), [1]), (("l", "is_empty", ""), [2, 3]), (("l", "is_not_empty", ""), [1, 4]), (("_key", "equals", "2"), []),
    ],
)
def test_filters(rows, f, expected):
    if f[0] == "_key":
        assert keys(rows, f) == [2]  # the pseudo-column is the key, compared as text
    else:
        assert keys(rows, f) == expected


def test_groups_and_errors(rows):
    g = Group("any", (Filter("n", "gt", "5"),), (Group("all", (Filter("t", "is", "open"), Filter("n", "lt", "2"))), Group()))
    assert keys(rows, group=g) == [1, 2, 3, 4]
    assert keys(rows, group=Group("any", g.filters, g.groups[:1])) == [1, 3]
    with pytest.raises(SpecError):
        keys(rows, ("missing", "equals", "1"))
    with pytest.raises(SpecError):
        compile_all([Filter("n", "gte", "1")], None, SCHEMA, strict=True)
    with pytest.raises(SpecError):
        D.query(rows, SCHEMA, DatasetQuery(aggregates=(Aggregate("median", "n"),)))


def test_query_page_and_total(rows):
    q = parse({"columns": ["t"], "sorts": [{"key": "n", "ascending": False}], "limit": 2, "offset": -1})
    assert [r["t"] for r in D.query(rows, SCHEMA, q).collect()] == ["", "closed%"]
    assert tuple(D.total(rows, SCHEMA, q).first()) == (4, 2, True)
    grouped = parse({"group_by": "b", "aggregates": [{"function": "average", "column": "n"}]})
    assert [tuple(r) for r in D.query(rows, SCHEMA, grouped).collect()] == [(None, None), (False, 12.0), (True, 2.0)]
    assert parse({"limit": 0}).page == (10, 0) and parse({"limit": 99999}).page == (1000, 0)


def test_literals():
    assert items_of("[a, 'b c']") == ["a", "b c"] and items_of("a b") == ["a", "b"] and items_of(" ") == []
    assert (real("12abc"), real(""), real("-1.5e2x")) == (12.0, 0.0, -150.0)


def test_inference(spark):
    d = spark.createDataFrame([("1", "1_000", "2024-01-02", "x", "", None), ("0", "", "2024-01-02 03:04:05", "1", "inf", None)], "a string, b string, c string, d string, e string, f string")
    assert {r["column"]: r["type"] for r in D.infer_types(d).collect()} == {"a": "checkbox", "b": "number", "c": "date", "d": "text", "e": "number", "f": "text"}


@pytest.mark.parametrize(("f", "value", "expected"), [
    (("p", "gt", "9"), "10", True), (("p", "gt", "9"), "abc", True), (("p", "after", "2024-01-01"), "2024-01-02 10:00", True), (("p", "equals", "1_000"), "1000.0", True),
    (("p", "contains", "%"), "a%b", True), (("p", "contains", "%"), "ab", False), (("p", "in", "x,y"), "[Y z]", True), (("p", "not_in", "x"), None, True), (("p", "contains_all", "a b"), "b,a", True), (("p", "odd", ""), None, True),
])
def test_view_filters(spark, f, value, expected):
    d = spark.createDataFrame([(value,)], "p string")
    assert d.where(view_filter(Filter(*f), F.col("p"))).count() == int(expected)


def test_view(spark):
    docs = spark.createDataFrame([("a/1.md", ["X"], "10", "open"), ("a/2.md", [], "5", None), ("b/3.md", ["x"], "7.5", "open")], "path string, tags array<string>, amount string, status string")
    links = spark.createDataFrame([("a/1.md", "a/2.md"), ("a/1.md", "b/3.md")], "src string, dst string")
    v = View("v", "tag:x", (Filter("status", "is", "Open"),), None, {"label": "{path}: {status}{none}"}, {"total": ("sum", "amount")}, ("path", "label", "total"))
    assert [tuple(r) for r in run(docs, v, links).collect()] == [("a/1.md", "a/1.md: open", 12.5), ("b/3.md", "b/3.md: open", None)]
    assert run(docs, View("w", "notebook:a/2.md,b/3.md")).count() == 2
    with pytest.raises(SpecError):
        guard(["internal", "restricted"], "internal")


def test_view_without_limit_has_all_rows(spark):
    docs = spark.range(2500).select(F.format_string("a/%05d.md", "id").alias("path"))
    assert [r["path"] for r in run(docs, View("v", "a/")).collect()] == [f"a/{i:05d}.md" for i in range(2500)]
    assert run(docs, View("v", "a/", limit=7)).count() == 7 and run(docs, View("v", "a/", limit=2000)).count() == 1000


def test_grammar():
    p = S.parse('tag:a -status:paid steuer "annual \\"report\\"" -draft /inv-[0-9]+/ -/void/ modified:last week')
    assert p.filters == [("tag", "a", False), ("status", "paid", True), ("modified", "last week", False)]
    assert [(t.value, t.phrase, t.negated) for t in p.terms] == [("steuer", False, False), ('annual "report"', True, False), ("draft", False, True)]
    assert p.regexes == [("inv-[0-9]+", False), ("void", True)] and p.structured and not S.parse("tax invoice").structured
    for bad in ("-", "- tax", '""', '"tax', "//", "/invoice", "/[/", "owner:x", "tag:", "modified:tomorrow", "https://x"):
        with pytest.raises(S.SearchError):
            S.parse(bad)
    now = dt.datetime(2026, 9, 6, 12)
    assert S.date_range("last month", now) == (now - dt.timedelta(days=30), now)
    assert S.date_range("2026-08-01..2026-08-31", now)[1] == dt.datetime(2026, 8, 31, 23, 59, 59, 999999)


def test_german_and_simhash(spark):
    one = spark.range(1)
    tokens = lambda t: one.select(TX.german_tokens(F.lit(t)).alias("x")).first()["x"]
    assert tokens("Die Rechnungen sind geprüft") == ["rechnung", "gepruft"]
    assert tokens("Rechnung rechnungen RECHNUNG") == ["rechn", "rechnung"]
    assert tokens("größere Überweisungen") == ["grosser", "uberweisung"]
    assert tokens("(Krankenversicherung), bezahlt!") == ["krankenversicher", "bezahlt"]
    expected = {"": 0, "The quick brown fox jumps over the lazy dog": 14607312263354641902, "  HELLO   hello\tWorld  ": 11831194018420276491, "Ärger über große Rechnungen 東京": 9166555590392097190}
    for t, h in expected.items():
        assert TX.simhash_of(t) % 2**64 == h
    got = spark.createDataFrame([(t,) for t in expected], "t string").select(TX.simhash("t").alias("h")).collect()
    assert [r["h"] % 2**64 for r in got] == list(expected.values())


def test_scalars(spark):
    d = spark.createDataFrame([("Vor-\nund Nachname", "Ver-\nsi-\nche-\nrung", "Baden-\nWürttemberg", "  a \t b\r\n\n\n\nc ")], "a string, b string, c string, d string")
    r = d.select(X.dehyphenate(F.col("a")), X.dehyphenate(F.col("b")), X.dehyphenate(F.col("c")), X.normalize_text(F.col("d"))).first()
    assert tuple(r) == ("Vor-\nund Nachname", "Versicherung", "Baden-\nWürttemberg", "a b\n\nc")
    r = spark.range(1).select(X.path_template("{x}/{date:%Y/%m}/{y}", {"x": F.lit("a/b"), "y": F.lit(" ")}, F.lit("2024-05-06").cast("date")), X.clock(F.lit(3_723_004).cast("long"), ","), X.slugify(F.lit("Ä b--C!"))).first()
    assert tuple(r) == ("a-b/2024/05/unknown", "01:02:03,004", "b-c")
