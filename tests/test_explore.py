import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import bitmaps as B
from coppice.operators import explore as E
from coppice.operators.export import cluster_lookup, with_metadata


def table(spark):
    rows = [(0, "de", "a"), (1, "fr", None), (2, "", "b"), (3, "de", "b")]
    return spark.createDataFrame(rows, "row_index long, category string, service string")


def test_lookup_includes_theme_metadata(spark):
    clusters = spark.createDataFrame([(7, "Network incidents", 3)], "cluster_id long, label string, size long")
    members = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "cluster_id long, row_index long")
    themes = spark.createDataFrame([(7, 2, "Router failures", 2)], "cluster_id long, theme_id long, label string, size long")
    theme_rows = spark.createDataFrame([(7, 2, 2), (7, 2, 3)], "cluster_id long, theme_id long, row_index long")
    lookup = cluster_lookup(clusters, members, themes, theme_rows)
    rows = spark.createDataFrame([(i,) for i in (0, 1, 2)], "row_index long")
    got = {r[0]: tuple(r)[1:] for r in with_metadata(rows, lookup).collect()}
    assert got[2] == ("C0007", "Network incidents", 3, "2", "Router failures", 2)
    assert got[1] == ("C0007", "Network incidents", 3, "", "", 0)
    assert got[0] == ("Unclustered", "Unclustered", 0, "", "", 0)


def test_filter_state():
    f, values = E.FacetFilter(), {"a", "b", "c"}
    assert f.selected_count("x", 3) == 3 and f.is_selected("x", "a")
    f.set_selected("x", "a", False, values)
    assert f.selected["x"] == {"b", "c"} and f.active_count == 1
    f.set_selected("x", "a", True, values)
    assert f.active_count == 0
    f.search_for("x", "b")
    assert f.selected["x"] == set() and f.search == {"x": "b"}
    f.select_all("x")
    f.select_none("y")
    assert not f.is_selected("y", "a")
    f.clear()
    assert f.active_count == 0 and not f.search


def test_filters_on_rows(spark):
    rows = table(spark)
    pick = lambda **kw: sorted(r.row_index for r in E.FacetFilter({k: set(v) for k, v in kw.items()}).apply(rows).collect())
    assert pick() == [0, 1, 2, 3]
    assert pick(category=["de"], service=["b"]) == [3]
    assert pick(service=[""]) == [1]
    assert pick(service=[]) == []
    assert pick(nowhere=[""]) == [0, 1, 2, 3] and pick(nowhere=["x"]) == []


def test_facets_details_and_summary(spark):
    rows = table(spark)
    values = E.facet_values(rows, rows.where("row_index < 3"), ["category", "service"])
    assert sorted(map(tuple, values.collect())) == [
        ("category", "", "(blank)"), ("category", "de", "de"), ("category", "fr", "fr"),
        ("service", "", "(blank)"), ("service", "a", "a"), ("service", "b", "b"),
    ]
    assert [r.value for r in E.facet_search(values, "DE").collect()] == ["de"]
    themed = spark.createDataFrame([(1, 1, i) for i in range(5)], "cluster_id long, theme_id long, row_index long")
    assert sorted(r.row_index for r in E.theme_details(themed, 3).collect()) == [0, 1, 2]
    members = spark.createDataFrame([(1, 0), (1, 3), (2, 1)], "cluster_id long, row_index long")
    counts = E.filtered_group_counts(members, rows, E.FacetFilter({"category": {"de"}})).collect()
    assert [tuple(r) for r in counts] == [(1, 2)]
    got = E.run_summary(rows, rows.where("category = 'de'"), rows.limit(0), members.limit(1), rows.where("row_index = 2"))
    assert tuple(got.first()) == (4, 2, 0, 1, 1)
    assert E.source_preview(rows, 2).collect()[1].service == ""


@pytest.mark.parametrize("chosen", [{}, {"category": ["de"]}, {"category": ["de", ""], "service": ["a", "c"]}, {"service": []}, {"nowhere": [""]}, {"nowhere": ["x"]}, {"category": ["xx"], "service": ["a"]}])
def test_bitmaps_count_what_filters_show(spark, chosen):
    """Rows at both ends of blocks and far apart; empty cells; columns that aren't there."""
    rng = random.Random(1)
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, 10**9, *rng.sample(range(2, 10**6), 200)]
    rows = [(i, rng.choice(["de", "fr", "", None]), rng.choice("abc"), i % 3) for i in sorted(set(ids))]
    df = spark.createDataFrame(rows, "row_index long, category string, service string, cluster_id long")
    filters, columns = E.FacetFilter({k: set(v) for k, v in chosen.items()}), ["category", "service"]
    bits = B.visible_bits(B.facet_bitmaps(df, columns), filters, columns)
    expected = {r.row_index: r.cluster_id for r in filters.apply(df).collect()}
    assert B.visible_count(bits).first().visible == len(expected)
    members = df.select("cluster_id", "row_index")
    assert {r.row_index for r in B.visible_members(members, bits).collect()} == set(expected)
    counted = {r.cluster_id: r.visible for r in B.visible_groups(members, bits).collect()}
    assert counted == {c: n for c in range(3) if (n := sum(x == c for x in expected.values()))}
    assert {r.cluster_id: r.visible for r in E.filtered_group_counts(members, df, filters).collect()} == counted


def test_summary_from_counts(spark):
    got = E.summary_of_run({"processed": 9, "ignored": 1, "clusters": 2, "clustered": 5}, spark.range(3).where(F.lit(True)))
    assert got.first().asDict() == {"processed": 9, "visible": 3, "ignored": 1, "clusters": 2, "unclustered": 4}
