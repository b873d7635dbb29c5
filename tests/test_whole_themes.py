"""Queries that show themes show all of them: twelve in a cluster that is larger than what ten themes are made of."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coppice.operators import clusters as C


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A cluster of twelve kinds of texts, one of one kind, and a text alone."""
    kind = F.col("id") % 12
    text = F.concat(F.lit("aaa bbb ccc ddd eee x"), kind, F.lit(" y"), kind, F.lit(" z"), kind)
    other = F.when(F.col("id") == 33, F.lit("nobody else")).otherwise(F.lit("fff ggg hhh"))
    docs = spark.range(34).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 30, text).otherwise(other).alias("text"),
        F.element_at(F.array(*[F.lit(x) for x in ("de", "fr", "en")]), (F.col("id") % 3 + 1).cast("int")).alias("lang"),
        F.concat(F.lit("src"), F.col("id") % 4).alias("source"),
    )
    path = str(tmp_path_factory.mktemp("themes"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def sorted_rows(df):
    return sorted(map(str, df[sorted(df.columns)].values.tolist()))


@pytest.mark.parametrize("name", ["export_rows", "result_tree", "theme_details", "themes", "visible_themes"])
def test_all_twelve_themes_as_in_sql(spark, tables, monkeypatch, name):
    import duckdb

    monkeypatch.setattr(C, "MOST_THEMED", 20)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    got, expected = entry.queries()[name](spark, tables).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted_rows(got) == sorted_rows(expected)
    shown = got["theme_code" if name == "export_rows" else "theme_id"].astype(str)
    kept = (1, 5, 7, 11) if name == "visible_themes" else range(1, 13)  # what the two filters show
    assert set(shown) - {"", "0"} == {str(k) for k in kept}
