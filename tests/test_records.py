import pytest

from coppice.operators.records import Mapping, MappingError, build_records, suggest_mapping, validate_mapping


def test_suggests_common_columns():
    got = suggest_mapping(["INC Number", "INC Short Description", "Category", "Assignment Group"])
    assert (got.incident_number, got.short_description, got.category, got.assignment_group) == (0, 1, 2, 3)
    assert got.ready and got.required_status == "2 of 2" and got.mapped_count == 4 and got.filter_count == 2


def test_last_header_wins_and_priority_is_dropped():
    got = suggest_mapping(["Number", "Summary", "Priority", "Opened", "Short description", "CI"])
    assert got == Mapping(0, 4, configuration_item=5, date=3)
    assert not Mapping(incident_number=1).ready


def test_validation_order():
    with pytest.raises(MappingError, match="incident number"):
        validate_mapping(Mapping(), ["a"])
    with pytest.raises(MappingError, match="short description"):
        validate_mapping(Mapping(0), ["a"])
    with pytest.raises(MappingError, match="column index 9 "):
        validate_mapping(Mapping(0, 1, (9,), service=8), ["a", "b"])
    validate_mapping(Mapping(0, 1), ["a", "b"])


def test_additional_columns_are_sorted_and_unique():
    m = Mapping(0, 1).with_additional(5, 3).with_additional(3)
    assert m.additional_text == (3, 5) and m.without_additional(5).additional_text == (3,)
    assert Mapping.from_dict(m.to_dict()) == m


def test_ignores_rows_missing_required_fields(spark):
    rows = [
        (0, "INC001", "VPN is down", " why ", "\t", "2024-02-01"),
        (1, "", "Missing number", "", "net", ""),
        (2, "INC003", " ", None, None, None),
        (3, None, None, "x", "y", "z"),
        (4, "INC001", "again", "", "net", "31.12.2023"),
    ]
    df = spark.createDataFrame(rows, "row_index long, a string, b string, c string, d string, e string")
    records, ignored = build_records(df, Mapping(0, 1, (2, 3), service=3, date=4))
    got = {r.row_index: r for r in records.collect()}
    assert sorted(got) == [0, 4]
    assert got[0].analysis_text == "VPN is down why" and got[0].service is None and got[0].category is None
    assert got[4].analysis_text == "again net" and str(got[4].parsed_date) == "2023-12-31"
    assert sorted(map(tuple, ignored.collect())) == [(1, True, False), (2, False, True), (3, True, True)]
