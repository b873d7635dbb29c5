import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from coppice.functions.text import feature_terms
from coppice.operators import clusters as C
from coppice.operators import features as T
from coppice.operators import similarity as S
from coppice.operators import components as K
from coppice.operators import thresholds as H
from coppice.operators.components import connected_components
from coppice.plans.analysis import Settings, cluster_records
from coppice.session import save

FIVE_KINDS = ["password reset failure sap portal"] * 3 + ["vpn connection timeout remote access"] * 3


def records(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_index long, analysis_text string")


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("print", "mail", "net", "disk", "portal") for b in ("er", "box", "work", "s")]
    return [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(n)]


def brute_edges(spark, texts, percent, most=2000):
    rows = records(spark, texts).select("row_index", F.array_distinct(feature_terms(F.col("analysis_text"))).alias("t"))
    sets = {r.row_index: set(r.t) for r in rows.collect()}
    df = {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    sets = {i: {t for t in s if 2 <= df[t] <= most} for i, s in sets.items()}
    out = set()
    for i, j in combinations(sorted(sets), 2):
        shared, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if shared and 100 * shared // union >= percent:
            out.add((i, j, shared))
    return out


@pytest.mark.parametrize("percent", [0, 42, 58, 100])
@pytest.mark.parametrize("find", [S.edges_by_overlap, S.edges_by_counts])
def test_edges_equal_brute_force(spark, percent, find):
    texts = some_texts()
    got = {(r.src, r.dst, r.shared) for r in find(records(spark, texts), percent).collect()}
    assert got == brute_edges(spark, texts, percent)


def test_collapsed_edges_have_the_same_components(spark):
    rows = records(spark, some_texts() * 2)
    parts = [
        {tuple(r) for r in connected_components(S.linking_edges(rows, 42, strategy=s)).collect()}
        for s in ("overlap", "counts", "collapse")
    ]
    assert parts[0] and parts[0] == parts[1] == parts[2]


def test_frequent_terms_join_nothing(spark):
    rows = records(spark, ["printer"] * 5 + ["mailbox"] * 2)
    got = {(r.src, r.dst) for r in S.edges_by_counts(rows, 42, most_df=4).collect()}
    assert got == {(5, 6)}


@pytest.mark.parametrize("bits", [6, 9, 25])
def test_terms_of_one_record_are_left_out_before_the_shuffle(spark, monkeypatch, bits):
    """Small tables let more single terms through, never one fewer of the others."""
    monkeypatch.setattr(T, "SLOT_BITS", bits)
    monkeypatch.setattr(T, "CHUNK_SLOTS", 64)
    rows = records(spark, [*some_texts(40), *(f"alone{i:03d}x word" for i in range(30)), ""]).withColumn("k", F.col("row_index") % 2).repartition(3)
    for keys in ((), ("k",)):
        every = {tuple(r) for r in T.distinct_terms(rows, keys).collect()}
        kept = [tuple(r) for r in T.repeating_terms(rows, keys).collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= every
        df = {}
        for r in every:
            df[(*r[: len(keys)], r[-1])] = df.get((*r[: len(keys)], r[-1]), 0) + 1
        assert {r for r in every if df[(*r[: len(keys)], r[-1])] > 1} <= set(kept)
        assert bits < 25 or len(kept) == sum(n for n in df.values() if n > 1)
        valid = {tuple(r) for r in T.valid_terms(T.repeating_terms(rows, keys), keys).collect()}
        assert valid == {(*t, n) for t, n in df.items() if n > 1}


def test_features(spark):
    rows = records(spark, ["reset reset portal", "portal", ""])
    tf = {(r.row_index, r.term): r.tf for r in T.term_frequency(rows).collect()}
    assert tf[0, "reset"] == 2 and tf[0, "reset reset"] == 1
    weights = {(r.row_index, r.term): r.weight for r in T.tf_idf(rows).collect()}
    assert weights[1, "portal"] == pytest.approx(0.9162907, abs=1e-6)
    vectors = {r.row_index: r.terms for r in T.sparse_vectors(rows).collect()}
    assert vectors[2] == {} and set(vectors[1]) == {"portal", "char:port", "char:orta", "char:rtal"}
    sizes = {r.row_index: r.n for r in T.term_set_sizes(rows, S.kept_terms(rows)).collect()}
    assert sizes == {0: 4, 1: 4, 2: 0}
    ids = {r.term: r.term_id for r in T.term_dictionary(rows).collect()}
    assert ids["reset"] == 0 and ids["portal"] == 1 and sorted(ids.values()) == list(range(len(ids)))


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def labels_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_parts_are_contracted_before_the_rounds(spark, monkeypatch, caplog, kind):
    """What enters the rounds is at most one edge a node and partition, however many edges there are."""
    monkeypatch.setattr(K, "HELD_EDGES", 100)
    rng = random.Random(2)
    edges = [(rng.randrange(40) + 100 * k, rng.randrange(40) + 100 * k) for k in range(3) for _ in range(1500)] + [(400 + i, 399 + i) for i in range(1, 50)]
    edges = [(f"{a:04d}", f"{b:04d}") if kind == "string" else (a, b) for a, b in edges]
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}").repartition(3)
    sent = K.contracted(df).withColumn("part", F.spark_partition_id()).collect()
    assert len(sent) == len({(r.part, r.u) for r in sent}) <= 3 * 170 and all(r.v <= r.u for r in sent)
    with caplog.at_level("INFO", logger=K.__name__):
        assert {r.node: r.component for r in connected_components(df).collect()} == labels_of(edges)
    assert 2 <= sum("after round" in r.message for r in caplog.records) <= 12


def test_least_reachable_along_paths():
    """Long paths in every order of their nodes, the slow case of label spreading."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        for order in (np.arange(n), np.arange(n)[::-1], rng.permutation(n)):
            assert (K.least_reachable(order[:-1], order[1:], n) == 0).all()


def test_spanning_forest_connects_at_every_threshold(spark, monkeypatch):
    monkeypatch.setattr(H, "HELD_EDGES", 60)
    rng = random.Random(4)
    edges = list({(min(a, b), max(a, b)): (a, b, rng.choice([42, 50, 58, 58, 70, 99])) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(400))}.values())
    df = spark.createDataFrame([*edges, (500, 501, 42)], H.FOREST).repartition(4)
    forest = [tuple(r) for r in H.spanning_forest(df).collect()]
    nodes = {x for a, b, _ in edges if a != b for x in (a, b)} | {500, 501}
    assert len(forest) == len(nodes) - len(set(labels_of([(a, b) for a, b, _ in [*edges, (500, 501, 42)] if a != b]).values()))
    assert sum(p for *_, p in forest) == weight_by_kruskal([*edges, (500, 501, 42)])
    records = spark.range(0, 600).select(F.col("id").alias("row_index"))
    got = H.groups_at(records, spark.createDataFrame(forest, H.FOREST), (42, 58, 70, 100)).collect()
    assert len(got) == 4 * 600
    for t in (42, 58, 70, 100):
        expected = labels_of([(a, b) for a, b, p in [*edges, (500, 501, 42)] if p >= t])
        assert {r.row_index: r.component for r in got if r.threshold == t} == {i: expected.get(i, i) for i in range(600)}
    assert H.spanning_forest(df.limit(0)).count() == 0


def weight_by_kruskal(edges):
    parent, total = {}, 0

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, p in sorted(edges, key=lambda e: -e[2]):
        a, b = find(a), find(b)
        if a != b:
            parent[a], total = b, total + p
    return total


def test_similar_records_cluster(spark):
    found = cluster_records(records(spark, FIVE_KINDS), Settings(minimum_cluster_size=3))
    assert sorted(map(tuple, found["clusters"].select("cluster_id", "label", "size").collect())) == [
        (1, "Failure issues involving password and portal", 3),
        (2, "Access issues involving connection and remote", 3),
    ]
    assert sorted(map(tuple, found["themes"].select("cluster_id", "theme_id", "size").collect())) == [(1, 1, 3), (2, 1, 3)]
    assert found["members"].where("cluster_id = 1").count() == 3


def test_themes_are_recomputed_inside_a_cluster_and_cut_at_ten(spark):
    members = spark.createDataFrame([(1, i, 24) for i in range(24)], "cluster_id long, row_index long, size long")
    kinds = [f"common{k:02d}{'abcdefghijkl'[k] * 5}" for k in range(12)]
    rows = records(spark, [kinds[i // 2] for i in range(24)])
    got = C.theme_members(rows, members, 3, 90).groupBy("theme_id", "size").count().collect()
    assert sorted((r.theme_id, r["size"]) for r in got) == [(k, 2) for k in range(1, 11)]


def test_clusters_beyond_the_largest_themed_size_are_one_theme(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_THEMED", 5)
    members = spark.createDataFrame([(1, i, 6) for i in range(6)] + [(2, i, 5) for i in range(6, 11)] + [(3, i, 2) for i in (11, 12)], "cluster_id long, row_index long, size long")
    rows = records(spark, [f"kind{i // 2 % 3} word{i // 2 % 3}" for i in range(13)])
    got = sorted(tuple(r) for r in C.theme_members(rows, members, 2, 90).groupBy("cluster_id", "theme_id", "size").count().collect())
    assert [r for r in got if r[0] != 2] == [(1, 1, 6, 6), (3, 1, 2, 2)]
    assert sum(r[3] for r in got if r[0] == 2) == 5 and len([r for r in got if r[0] == 2]) > 1


def test_all_themes_of_clusters_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_THEMED", 5)
    members = spark.createDataFrame([(1, i, 30) for i in range(30)] + [(2, i, 24) for i in range(30, 54)] + [(3, 54, 2), (3, 55, 2)], "cluster_id long, row_index long, size long")
    kinds = [f"common{k:02d}{'abcdefghijklmno'[k] * 5}" for k in range(15)]
    rows = records(spark, [kinds[i // 2] for i in range(30)] + [kinds[0]] * 5 + [kinds[1 + i // 2] for i in range(19)] + [kinds[0], kinds[1]])
    got = sorted(tuple(r) for r in C.theme_members(rows, members.repartition(3), 3, 90, all_themes=True).groupBy("cluster_id", "theme_id", "size").count().collect())
    assert got == [(1, k, 2, 2) for k in range(1, 16)] + [(2, 1, 5, 5)] + [(2, k, 2, 2) for k in range(2, 11)] + [(2, 11, 1, 1)] + [(3, 1, 2, 2)]


def test_numbering_starts_anew_for_each_key_on_any_number_of_parts(spark):
    rng = random.Random(8)
    groups = [(k, c, rng.choice([1, 1, 2, 9])) for k, n in ((1, 900), (2, 1), (3, 40), (7, 900)) for c in rng.sample(range(5000), n)]
    got = C.numbered(spark.createDataFrame(groups, "k long, component long, size long").repartition(5), "number", ("k",)).collect()
    want = {}
    for k in (1, 2, 3, 7):
        ordered = sorted((-size, c) for key, c, size in groups if key == k)
        want |= {(k, c): i for i, (_, c) in enumerate(ordered, 1)}
    assert {(r.k, r.component): r.number for r in got} == want and len(got) == len(want)


def test_label_templates(spark):
    texts = ["", "printer", "printer printer mailbox"]
    rows = records(spark, texts)
    members = spark.createDataFrame([(i + 1, i) for i in range(3)], "cluster_id long, row_index long")
    groups = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "cluster_id long, size long")
    got = {r.cluster_id: r.label for r in C.labelled(groups, members, rows, ("cluster_id",)).collect()}
    assert got == {1: "Similar incidents in cluster 1", 2: "Printer", 3: "Printer related to mailbox"}


def test_numbering_by_size_then_component(spark):
    groups = spark.createDataFrame([(9, 2), (4, 5), (1, 2), (30, 1)], "component long, size long")
    got = {r.component: r.cluster_id for r in C.numbered(groups, "cluster_id").collect()}
    assert got == {4: 1, 1: 2, 9: 3, 30: 4}


def test_empty_input(spark):
    found = cluster_records(records(spark, []), Settings(minimum_cluster_size=1))
    assert all(df.count() == 0 for df in found.values())


@pytest.mark.parametrize("slack", [0, 1, 3, 100])
def test_small_parts_give_the_same_edges(monkeypatch, spark, slack):
    """Tasks that cut their lists, send what they added up early, and compare in many blocks."""
    for name in ("PART_ENTRIES", "MOST_MET", "BLOCK_IDS", "LEADER_PAIRS"):
        monkeypatch.setattr(S, name, 7)
    texts = [f"word{i % 3} word{i % 5} other{i % 2} thing{i % 7} item{i % 11}" for i in range(60)] + ["word1 thing1"] * 9 + ["", "x"]
    rows = records(spark, texts).repartition(3)
    sets = S.term_sets(rows)
    expected = brute_edges(spark, texts, 42)
    got = S.compared(S.candidates(sets, 42, slack), sets, 42).collect()
    assert {(r.src, r.dst, r.shared) for r in got} == expected and len(got) == len(expected) > 100


def test_rare_pairs_end_before_they_are_compared(spark):
    """Texts that share two rare words each: met on lists, but none of them is a candidate."""
    texts = [f"{'abcdefgh'[i % 8] * 9} " + " ".join(f"w{i:02d}{chr(97 + k) * 7}" for k in range(12)) for i in range(40)]
    sets = save(S.term_sets(records(spark, [t for t in texts for _ in (0, 1)])), "sets")
    found = {tuple(r) for r in S.candidates(sets, 42).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(40)} < {tuple(r) for r in S.candidates(sets, 1, 0).collect()}


def test_packed_sets_are_the_valid_terms_and_move_less_than_the_long_table(spark):
    from coppice.functions.packing import from_binary

    rng = random.Random(5)
    words = ["straße", "élève", "日本語学習", "a", "é", "x1", "ΣΊΣΥΦΟΣ", "wort", "wörter", "the", "und"] + [f"w{i}" for i in range(60)]
    texts = ["", "  ", "the und", "a", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(80)]]
    rows = records(spark, texts)
    want = {}
    for r in S.kept_terms(rows, most_df=30).collect():
        want.setdefault(r.row_index, set()).add(r.term)
    df = {r.term: r.df for r in T.document_frequency(T.distinct_terms(rows)).collect()}
    sets = S.term_sets(rows, most_df=30)
    got = sets.toArrow().to_pydict()
    n = __import__("numpy").array(got["n"])
    ids = iter(from_binary(__import__("pyarrow").array(got["ids"]), n).tolist())
    found = {row: [next(ids) for _ in range(k)] for row, k in zip(got["row_index"], n, strict=True)}
    assert {k: len(v) for k, v in want.items()} == {k: len(v) for k, v in found.items()}
    for row, mine in found.items():
        assert mine == sorted(set(mine)) and sorted(df[t] for t in want[row]) == [i >> 52 for i in mine]
    for a, b in combinations(want, 2):
        assert len(want[a] & want[b]) == len({*found[a]} & {*found[b]})
    assert "Generate" not in sets._jdf.queryExecution().executedPlan().toString()  # no row a term


def test_packed_sets_are_keyed_and_their_sizes_cover_every_record(spark):
    rows = records(spark, ["alpha beta"] * 3 + ["alpha gamma"] * 3 + [""]).withColumn("k", F.col("row_index") % 2)
    want = {r.row_index: r.n for r in T.term_set_sizes(rows, S.kept_terms(rows, ("k",))).collect()}
    assert {r.row_index: r.n for r in T.sizes_of_sets(rows, S.term_sets(rows, ("k",))).collect()} == want


@pytest.mark.parametrize("size", [1, 2])
def test_packed_numbers_come_back(size):
    import numpy as np

    from coppice.functions.packing import as_binary, from_binary, packed, unpacked

    rng = np.random.default_rng(size)
    n = rng.integers(0, 40, 50)
    ids = np.concatenate([np.sort(rng.choice(1 << 12, k, replace=False)) << 50 | np.arange(k) ** 9 % (1 << 50) for k in n])
    assert from_binary(as_binary(ids, n), n).tolist() == ids.tolist()
    assert from_binary(as_binary(ids[:0], n[:0]), n[:0]).tolist() == [] and unpacked(packed(ids)).tolist() == ids.tolist()


@pytest.mark.parametrize("block", [40, 1 << 22])
def test_sets_in_turns_are_the_same_and_a_turn_moves_its_share(spark, monkeypatch, block):
    from coppice.operators import termsets as P

    monkeypatch.setattr(P, "TURN_BYTES", 1)
    monkeypatch.setattr(P, "BLOCK_TERMS", block)
    rng = random.Random(9)
    texts = ["", "x", *(" ".join(f"w{rng.randint(0, 300)}" for _ in range(20)) for _ in range(60))]
    rows = save(records(spark, texts).repartition(3).withColumn("k", F.col("row_index") % 2), "records")
    for keys in ((), ("k",)):
        want = {tuple(r) for r in P.saved_term_sets(rows, keys, 2, 30).collect()}
        assert {tuple(r) for r in P.saved_term_sets(rows, keys, 2, 30, turns=3).collect()} == want and len(want) == 60
    ranges = P.hash_ranges(rows, P.text_bytes(rows))
    bytes_of = lambda *turn: P.sent_by_block(rows, (), 30, ranges, *turn).agg(F.sum(F.length("hashes") + F.length("places"))).first()[0]
    whole, shares = bytes_of(), [bytes_of(t, 3) for t in range(3)]
    assert max(shares) < 0.7 * whole


def test_turns_that_read_different_rows_fail(spark, monkeypatch):
    from coppice.operators import termsets as P

    monkeypatch.setattr(P, "TURN_BYTES", 1)
    parts = [P.valid_by_block(records(spark, ["alpha beta gamma delta"] * n).coalesce(1), (), 2, 30, 4, t, 2) for t, n in enumerate((5, 6))]
    with pytest.raises(Exception, match="saved table"):
        P.sets_by_block(parts[0].unionByName(parts[1])).collect()


@pytest.mark.parametrize("block", [30, 1 << 22])
def test_posting_lists_are_those_of_the_long_table_and_none_is_written(spark, monkeypatch, block):
    from coppice.operators import postings as P

    monkeypatch.setattr(P, "BLOCK_TERMS", block)
    rng = random.Random(7)
    words = ["straße", "élève", "日本語学習", "a", "é", "x1", "ΣΊΣΥΦΟΣ", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢", "char", "the", "und"] + [f"w{i}" for i in range(60)]
    texts = [None, "", "the und", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(80)], "lone\nterm"]
    at = [rng.randrange(-(1 << 62), 1 << 62) for _ in texts]
    for ids in (at, range(len(texts))):
        rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "row_index long, analysis_text string").repartition(3)
        want = {}
        for r in T.distinct_terms(rows).collect():
            want.setdefault(r.term, []).append(r.row_index)
        found = P.inverted_index(rows, 2, 30)
        got = found.collect()
        assert len(got) == len({r.term for r in got}) and all(r.df == len(r.rows) for r in got)
        assert {r.term: r.rows for r in got} == {t: sorted(x) for t, x in want.items() if 2 <= len(x) <= 30}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row a term and record
    assert P.inverted_index(rows.where("false")).count() == 0


def test_query_of_the_inverted_index_has_no_long_table(spark):
    import __spark_entry__ as entry

    found = entry.queries()["inverted_index"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
