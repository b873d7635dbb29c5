import json

import pytest

from coppice.operators.records import suggest_mapping
from coppice.plans import store
from coppice.plans.analysis import Settings, run_analysis
from coppice.sources import tables, xlsx

TEXTS = ["password reset failure sap portal"] * 3 + ["vpn connection timeout remote access"] * 3


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('Number,Summary,Category,Category\nA1,"two\nlines, ""quoted""",x,y\nA2,short\nA3,long,1,2,3\n', encoding="utf-8")
    got = tables.import_source(spark, str(path))
    assert got.headers == ["Number", "Summary", "Category", "Category"] and got.row_count == 3
    assert [tuple(r) for r in got.df.orderBy("row_index").collect()] == [
        (0, "A1", 'two\nlines, "quoted"', "x", "y"),
        (1, "A2", "short", "", ""),
        (2, "A3", "long", "1", "2"),
    ]
    assert [tuple(r) for r in got.extras.collect()] == [(2, ["3"])]


def test_cells_beyond_the_header_reach_the_workbook(spark, tmp_path):
    path, beyond = tmp_path / "t.csv", ["e1", 'e "2",', "e3", "e4", "e5", "e6", "two\nlines", "", "e9"]
    quoted = ",".join('"' + x.replace('"', '""') + '"' for x in beyond)
    path.write_text(f"Number,Summary\nA1,one text\nA2,two text,{quoted}\nA3\nA4,four,,\n", encoding="utf-8")
    source = tables.import_source(spark, str(path))
    assert {r.row_index: r.cells for r in source.extras.collect()} == {1: beyond, 3: ["", ""]}
    run = run_analysis(source.df, suggest_mapping(source.headers), headers=source.headers, extras=source.extras)
    store.save_run(str(tmp_path / "run"), run)
    for got in (run, store.load_run(spark, str(tmp_path / "run"))):
        assert store.export_workbook(got, str(tmp_path / "out.xlsx")) == 3
        rows = list(xlsx.sheet_rows((tmp_path / "out.xlsx").read_bytes(), "Sheet1"))
        assert rows[0][2:] == list(store.METADATA_HEADERS)
        assert rows[2] == ["A2", "two text", "Unclustered", "Unclustered", "0", "", "", "0", "two\nlines", "", "e9"]
        assert rows[1][:2] == ["A1", "one text"] and len(rows[1]) == 8 and rows[3][:2] == ["A4", "four"]
        store.export_table(got, str(tmp_path / "table"))
        table = spark.read.parquet(str(tmp_path / "table"))
        assert table.columns == ["Number", "Summary", *store.METADATA_HEADERS, store.FURTHER_CELLS]
        assert [json.loads(r[-1]) if r[-1] else r[-1] for r in table.collect()] == [None, ["two\nlines", "", "e9"], None]


def test_repeated_headers_are_numbered_in_tables():
    assert store.distinct_names(["a", "A", "", "a", "b", "a (2)"]) == ["a", "A (2)", "Column 3", "a (3)", "b", "a (2) (2)"]


def test_a_sheet_is_as_wide_as_its_cells(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write_workbook(path, ["", "", ""], [("", "Number", "Summary"), ("", "A", "one", "more"), ("", "", ""), ("", "B", "two")])
    got = tables.import_source(spark, path)
    assert got.headers == ["Number", "Summary", ""]
    assert [tuple(r) for r in got.df.orderBy("row_index").collect()] == [(0, "A", "one", "more"), (1, "", "", ""), (2, "B", "two", "")]
    xlsx.write_workbook(path, ["", ""], [])
    assert tables.import_source(spark, path).headers == []


def test_csv_of_other_bytes_fails(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("Number,Summary\nA1,für\n".encode())
    assert tables.import_source(spark, str(path)).df.first().c1 == "für"
    path.write_bytes("Number,Summary\nA1,good\nA2,für\n".encode("latin-1"))
    with pytest.raises(tables.UnreadableRecord):
        tables.import_source(spark, str(path))


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7)
    assert [r.id for r in tables.number_rows(df).orderBy("row_index").collect()] == list(range(1000))
    assert sorted(r.row_index for r in tables.number_rows(df).collect()) == list(range(1000))


def test_unsupported(spark):
    with pytest.raises(tables.UnsupportedSource):
        tables.import_source(spark, "a.txt")
    assert tables.is_excel("a/B.XLSM") and not tables.is_excel("a.csv")
    assert tables.default_export_path("/x/tickets.csv") == "/x/tickets_clustered.xlsx"
    assert tables.default_export_path(None) == "clustered_incidents.xlsx"


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write_workbook(path, ["Number", "Size", "Text"], [("A", 5, "x & <y>"), ("B", 2.5, None), ("", True, " s ")], "Data")
    assert tables.list_worksheets(spark, path) == ["Data"]
    got = tables.import_source(spark, path)
    assert got.headers == ["Number", "Size", "Text"] and got.worksheet == "Data"
    assert [tuple(r) for r in got.df.orderBy("row_index").collect()] == [(0, "A", "5", "x & <y>"), (1, "B", "2.5", ""), (2, "", "True", " s ")]
    with pytest.raises(xlsx.WorkbookError):
        list(xlsx.sheet_rows((tmp_path / "b.xlsx").read_bytes(), "none"))
    with pytest.raises(xlsx.WorkbookError):
        xlsx.open_book(b"no zip")


def test_run_save_load_and_export(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Number,Summary\n" + "".join(f"INC{i},{t}\n" for i, t in enumerate([*TEXTS, "alone here", ""])), encoding="utf-8")
    source = tables.import_source(spark, str(path))
    events = []
    run = run_analysis(source.df, suggest_mapping(source.headers), Settings(minimum_cluster_size=3), source.headers, events.append)
    assert [e.step for e in events] == sorted(e.step for e in events) and events[-1].step == 8
    assert run.counts == {"processed": 7, "ignored": 1, "clusters": 2, "clustered": 6}
    plan = run.export()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "HashJoin" in plan
    assert "Exchange hashpartitioning(row_index" not in plan
    assert "Exchange" not in run.unclustered._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    store.save_run(str(tmp_path / "run"), run)
    again = store.load_run(spark, str(tmp_path / "run"))
    assert again.counts == run.counts
    for got in (run, again):
        rows = got.export().orderBy("row_index").collect()
        assert len(rows) == 7 and rows[0].cluster_code == "C0001" and rows[6].cluster_label == "Unclustered"
    assert again.mapping == run.mapping and again.settings == run.settings and again.ignored.count() == 1
    assert store.export_workbook(again, str(tmp_path / "out.xlsx")) == 7
    back = tables.import_source(spark, str(tmp_path / "out.xlsx"))
    assert back.headers[-6:] == list(store.METADATA_HEADERS) and back.row_count == 7
    store.export_table(again, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 7
    assert run.nested_clusters().count() == 2
    store.save_mapping(str(tmp_path / "m.json"), run.mapping)
    assert store.load_mapping(str(tmp_path / "m.json")) == run.mapping
    with pytest.raises(ValueError, match="failed to read"):
        store.load_mapping(str(tmp_path / "none.json"))


def test_a_session_of_one_json_document(spark, tmp_path):
    import json

    group = {"id": 1, "label": "Password", "incident_row_indices": [0, 2]}
    run = {
        "source": {"source_path": "/x/t.csv", "worksheet_name": None, "headers": ["Number", "Summary"], "rows": [["A", "one"], ["", "two"], ["C"], ["D", "four", "more"]]},
        "mapping": {"incident_number": 0, "short_description": 1, "additional_text": [1], "assignment_group": None, "service": None, "category": None, "configuration_item": None, "date": None},
        "settings": {"minimum_cluster_size": 2, "similarity_threshold_percent": 42, "subgroup_similarity_threshold_percent": 58},
        "processed_incidents": [
            {"source_row_index": i, "incident_number": "A", "analysis_text": "one", "filter_values": {"assignment_group": None, "service": "s", "category": None, "configuration_item": None}, "parsed_date": "2024-02-03"}
            for i in (0, 2, 3)
        ],
        "ignored_rows": [{"source_row_index": 1, "missing_incident_number": True, "missing_short_description": False}],
        "clusters": [{**group, "subgroups": [{**group, "label": "Reset"}]}],
        "unclustered_row_indices": [3],
        "timings": {"import_ms": 0, "preprocessing_ms": 5, "clustering_ms": 7, "labeling_ms": 0, "export_ms": 0},
    }
    path = tmp_path / "session.json"
    path.write_text(json.dumps({"version": 1, "run": run}, indent=2), encoding="utf-8")
    got = store.load_json_run(spark, str(path))
    assert got.headers == ["Number", "Summary"] and got.mapping.additional_text == (1,) and got.settings.minimum_cluster_size == 2
    assert got.timings.clustering_ms == 7 and got.ignored.count() == 1 and got.unclustered.first()[0] == 3
    rows = got.export().orderBy("row_index").collect()
    assert [tuple(r) for r in rows] == [
        (0, "A", "one", "C0001", "Password", 2, "1", "Reset", 2),
        (2, "C", "", "C0001", "Password", 2, "1", "Reset", 2),
        (3, "D", "four", "Unclustered", "Unclustered", 0, "", "", 0),
    ]
    assert [tuple(r) for r in got.extras.collect()] == [(3, ["more"])]
    (tmp_path / "bad.json").write_text("{}", encoding="utf-8")
    with pytest.raises(ValueError, match="failed to read"):
        store.load_json_run(spark, str(tmp_path / "bad.json"))
