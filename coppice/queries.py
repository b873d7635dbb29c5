"""The registered queries of the library and the SQL that gives the same rows.

The incident table is ``documents`` as it is: the whole text is the description,
language and source are dimensions.  Dates come from ``orders`` and missing
fields from an outer join with ``labels``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions import text as X
from coppice.operators import bitmaps as B
from coppice.operators import clusters as C
from coppice.operators import explore as E
from coppice.operators import features as T
from coppice.operators import postings as P
from coppice.operators import similarity as S
from coppice.operators import thresholds as H
from coppice.operators.components import connected_components
from coppice.operators.records import ROW, Mapping, build_records
from coppice.plans.analysis import Run, Settings, run_analysis
from coppice.session import save, scratch_root, ship, spread
from coppice.sources import tables as IO

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = Settings(minimum_cluster_size=2, similarity_percent=42, theme_similarity_percent=58)
ALL_THEMES = replace(SETTINGS, all_themes=True)
MAPPING = Mapping(0, 1, category=2, service=3)
FILTERS = {"category": ["de", "fr"]}
SOURCES = [f"src{i}" for i in range(0, 20, 2)]
THRESHOLDS = (42, 58, 70)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents"))
    number = F.concat(F.lit("INC"), F.col("doc_id").cast("string")).alias("number")
    return d.select(F.col("doc_id").alias(ROW), number, F.col("text").alias("description"), F.col("lang").alias("category"), F.col("source").alias("service"))


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_records(incidents(spark, sf_dir), MAPPING)[0]


def labelled_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose number is missing where they have no label."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    number = F.concat(F.lit("INC"), F.col("toxic").cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias(ROW), number.alias("number"), F.concat(F.lit("\t "), "text", F.lit(" ")).alias("description"), F.col("lang").alias("category"), F.col("source").alias("service")
    )


def analysis(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> Run:
    return run_analysis(incidents(spark, sf_dir), MAPPING, settings)


def term_rows(fn: Callable, name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = X.tokens(X.normalize_text(F.col("analysis_text")))
        return records_of(spark, sf_dir).select(ROW, F.explode(fn(words)).alias(name)).groupBy(ROW, name).agg(F.count("*").alias("n"))

    return query


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(spark, sf_dir).select(ROW, X.normalize_text(F.col("analysis_text")).alias("normalized"))


def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = build_records(labelled_incidents(spark, sf_dir), MAPPING)
    return found.select(ROW, "incident_number", "analysis_text", "category", "service")


def ignored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_records(labelled_incidents(spark, sf_dir), MAPPING)[1]


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date written in five ways; the last has a time and isn't a date."""
    o = spread(read(spark, sf_dir, "orders"))
    ways = ("yyyy-MM-dd", "d.M.yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm")
    cells = F.array(*[F.struct(F.lit(i).alias("way"), F.date_format("o_orderdate", w).alias("cell")) for i, w in enumerate(ways)])
    return o.select("o_orderkey", F.explode(cells).alias("x")).select("o_orderkey", "x.way", "x.cell", X.parse_date(F.col("x.cell")).alias("parsed"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.document_frequency(T.distinct_terms(records_of(spark, sf_dir)))


def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tf_idf(records_of(spark, sf_dir)).select(ROW, "term", "tf", "df", F.round(F.col("weight").cast("double"), 2).alias("weight"))


def term_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = records_of(spark, sf_dir)
    return T.sizes_of_sets(records, S.saved_sets(records))


def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edges_by_overlap(records_of(spark, sf_dir), SETTINGS.similarity_percent)


def similarity_edges_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with shorter prefixes: more pairs are compared in whole, fewer are met on lists."""
    sets = S.saved_sets(records_of(spark, sf_dir))
    return S.compared(S.candidates(sets, SETTINGS.similarity_percent, slack=4), sets, SETTINGS.similarity_percent)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges_by_overlap(records_of(spark, sf_dir), SETTINGS.similarity_percent)
    return connected_components(edges).select(F.col("node").alias(ROW), "component")


def threshold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at three thresholds from one edge list and its spanning forest."""
    records = save(records_of(spark, sf_dir).select(ROW, "analysis_text"), "records")
    edges = S.edges_by_overlap(records, min(THRESHOLDS))
    return H.groups_at(records, H.spanning_forest(H.with_percent(edges)), THRESHOLDS)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).clusters


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).members


def unclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).unclustered


def cluster_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir)
    return C.keywords(run.members, run.records, ("cluster_id",))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, ALL_THEMES).themes


def theme_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.theme_details(analysis(spark, sf_dir, ALL_THEMES).theme_rows)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, ALL_THEMES).export()


def result_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir, ALL_THEMES)
    return E.result_tree(run.clusters, run.themes, run.theme_rows)


def some_filter() -> E.FacetFilter:
    return E.FacetFilter({k: set(v) for k, v in FILTERS.items()})


def filtered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir)
    return E.filtered_group_counts(run.members, run.source, some_filter())


def two_filters() -> E.FacetFilter:
    return E.FacetFilter({k: set(v) for k, v in (FILTERS | {"service": SOURCES}).items()})


def shown_bits(rows: DataFrame) -> DataFrame:
    """Bitmaps of both facet columns, written once, and the rows that two active filters show."""
    columns = ["category", "service"]
    return B.visible_bits(save(B.facet_bitmaps(rows, columns), "facet-bitmaps"), two_filters(), columns)


def visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.visible_count(shown_bits(incidents(spark, sf_dir)))


def visible_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir)
    return B.visible_members(run.members, shown_bits(run.source))


def visible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir)
    return B.visible_groups(run.members, shown_bits(run.source))


def visible_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir, ALL_THEMES)
    return B.visible_groups(run.theme_rows, shown_bits(run.source), ("cluster_id", "theme_id"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = analysis(spark, sf_dir)
    return E.summary_of_run(run.counts, some_filter().apply(E.processed_rows(run.source, run.records)))


def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.facet_values(incidents(spark, sf_dir), records_of(spark, sf_dir), ["category", "service"])


def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.facet_search(facet_values(spark, sf_dir), "RC1").select("column", "value")


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return some_filter().apply(incidents(spark, sf_dir)).select(ROW, "category", "service")


def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.source_preview(incidents(spark, sf_dir))


def ignored_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ignored_reasons(ignored_rows(spark, sf_dir))


def orders_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cell = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return build_records(
        o.select(F.col("o_orderkey").alias(ROW), F.col("o_orderkey").cast("string").alias("number"), F.col("o_orderpriority").alias("d"), cell.alias("date")), Mapping(0, 1, date=2)
    )[0]


def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.date_range(orders_as_records(spark, sf_dir), "1995-01-01", "1995-12-31").select(ROW, "parsed_date")


def unparsed_date_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.unparsed_dates(orders_as_records(spark, sf_dir))


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.term_dictionary(records_of(spark, sf_dir))


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.inverted_index(records_of(spark, sf_dir))
    return found.select("term", "df", F.array_join(F.transform("rows", lambda r: r.cast("string")), ",").alias("rows"))


def grouped_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier shares five words with all others and three with a twelfth of them; a third has no category."""
    s, group = read(spark, sf_dir, "supplier"), F.expr("cast(s_suppkey % 12 as string)")
    text = F.concat(F.lit("aaa bbb ccc ddd eee x"), group, F.lit(" y"), group, F.lit(" z"), group)
    category = F.when(F.expr("s_suppkey % 3 = 0"), F.lit("  ")).otherwise(F.col("s_nationkey").cast("string"))
    return s.select(F.col("s_suppkey").alias(ROW), F.col("s_name").alias("number"), text.alias("description"), category.alias("category"), F.lit("").alias("service"))


def supplier_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_analysis(grouped_suppliers(spark, sf_dir), MAPPING, SETTINGS).themes


def supplier_theme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_analysis(grouped_suppliers(spark, sf_dir), MAPPING, SETTINGS).theme_rows


def blank_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_suppliers(spark, sf_dir)
    trimmed = rows.withColumn("category", X.trimmed(F.col("category")))
    return E.facet_values(trimmed, build_records(rows, MAPPING)[0], ["category", "service"])


def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with three more text columns, some of them blank."""
    p = read(spark, sf_dir, "part")
    brand = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit("\t"))).otherwise(F.lit(" \u00a0"))
    kind = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    cells = p.select(F.col("p_partkey").alias(ROW), F.col("p_partkey").cast("string").alias("n"), F.col("p_name").alias("d"), brand.alias("b"), kind.alias("k"))
    return build_records(cells, Mapping(0, 1).with_additional(3, 2, 3))[0].select(ROW, "analysis_text")


def short_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), F.concat_ws(" ", "p_name", "p_type").alias("analysis_text"))


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each vector, as text: term and weight in hundredths."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.round(F.round(e["value"].cast("double"), 2) * 100).cast("long").cast("string"))
    found = T.sparse_vectors(short_records(spark, sf_dir))
    return found.select(ROW, F.array_join(F.transform(F.array_sort(F.map_entries("terms")), entry), "|").alias("terms"))


def valid_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.valid_terms(T.repeating_terms(records_of(spark, sf_dir)))


def capped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of orders: priorities are on more records than the cap, customers' on few."""
    text = F.concat_ws(" ", "o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), text.alias("analysis_text"))
    return T.valid_terms(T.distinct_terms(records))


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.number_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name"))


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as CSV files, line breaks inside quotes, and imported again: numbered rows of strings."""
    path = f"{scratch_root(spark)}/coppice/csv-{uuid.uuid4().hex}"
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "lang", F.lit('"quoted", '), "text").alias("text"), "source")
    d.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").write.csv(path, header=True, escape='"')
    source = IO.import_csv(spark, path)
    return source.df.toDF(ROW, *source.headers)


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of a table, counted where it is."""
    return IO.counts_of(incidents(spark, sf_dir))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("o_totalprice") / F.pow(F.lit(10.0), F.col("o_orderkey") % 7)
    return spread(read(spark, sf_dir, "orders")).select("o_orderkey", X.duration_text(seconds).alias("duration"))


def selected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected after some clicks: two languages off and one on again, sources searched, one picked."""
    values = facet_values(spark, sf_dir)
    languages = [r[0] for r in values.where("column = 'category'").select("value").orderBy("value").collect()]
    chosen = E.FacetFilter()
    for value, on in ((languages[0], False), (languages[1], False), (languages[0], True)):
        chosen.set_selected("category", value, on, languages)
    chosen.search_for("service", "rc")
    chosen.set_selected("service", "src1", True, {"src0", "src1", "src2"})
    rows = values.select("column", "value", *[F.when(F.col("column") == c, F.col("value")).alias(c) for c in ("category", "service")])
    one = {c: E.FacetFilter({c: chosen.selected[c]}).condition([c]) for c in ("category", "service")}
    return rows.select("column", "value", F.when(F.col("column") == "category", one["category"]).otherwise(one["service"]).alias("selected"))


QUERIES: dict[str, Query] = {
    "supplier_themes": supplier_themes,
    "supplier_theme_rows": supplier_theme_rows,
    "blank_facets": blank_facets,
    "composed_texts": composed_texts,
    "sparse_vectors": sparse_vectors,
    "valid_terms": valid_terms,
    "capped_terms": capped_terms,
    "numbered_rows": numbered_rows,
    "csv_import": csv_import,
    "source_counts": source_counts,
    "durations": durations,
    "selected_values": selected_values,
    "records": valid_records,
    "ignored_rows": ignored_rows,
    "ignored_reasons": ignored_reasons,
    "parsed_dates": parsed_dates,
    "date_range_filter": date_range_filter,
    "unparsed_date_count": unparsed_date_count,
    "normalize_text": normalized,
    "tokens": term_rows(lambda w: w, "token"),
    "bigrams": term_rows(X.bigrams, "bigram"),
    "char_ngrams": term_rows(X.char_ngrams, "gram"),
    "term_dictionary": term_dictionary,
    "document_frequency": document_frequency,
    "tf_idf": tf_idf,
    "inverted_index": inverted_index,
    "term_set_sizes": term_set_sizes,
    "similarity_edges": similarity_edges,
    "similarity_edges_prefix": similarity_edges_prefix,
    "components": components,
    "threshold_groups": threshold_groups,
    "clusters": clusters,
    "cluster_members": cluster_members,
    "unclustered": unclustered,
    "cluster_keywords": cluster_keywords,
    "themes": themes,
    "theme_details": theme_details,
    "export_rows": exported,
    "result_tree": result_tree,
    "filtered_clusters": filtered_clusters,
    "visible_records": visible_records,
    "visible_members": visible_members,
    "visible_groups": visible_groups,
    "visible_themes": visible_themes,
    "facet_values": facet_values,
    "facet_search": facet_search,
    "facet_filter": facet_filter,
    "run_summary": run_summary,
    "source_preview": source_preview,
}
