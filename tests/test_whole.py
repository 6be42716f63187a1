"""Queries over whole tables, against brute force on small ones."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry_points

from lodestar.operators import retrieval

QUERIES = entry_points.queries()

def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    lines = [(k, n, (k * 7 + n) % 300, k % 5, "RAN"[(k + n) % 3], "FO"[k % 2]) for k in range(1, 200) for n in range(1, 1 + k % 4)]
    buyers = [(k, float(k)) for k in range(1000)]
    where = put(
        spark, tmp_path_factory.mktemp("graph"), supplier=([(k, f"s{k}") for k in range(5)], "s_suppkey long, s_name string"), customer=(buyers, "c_custkey long, c_acctbal double"),
        lineitem=(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"),
    )
    return where, lines


def test_all_line_items_are_links(spark, graph):
    where, lines = graph
    assert sum(r.n for r in QUERIES["edge_kind_counts"](spark, where).collect()) == len(lines)
    want = Counter((s, p % 5) for _, _, p, s, _, _ in lines if s != p % 5)
    assert {(r.a, r.b): r.n for r in QUERIES["pair_edges"](spark, where).collect()} == want


def test_all_customers_are_seeds(spark, graph):
    got = {(r.query_id, r.note): r.score for r in QUERIES["graph_seeds"](spark, graph[0]).collect()}
    assert got == {(k, k % 5): 980.0 + k for k in range(20)}


def test_all_orders_share_topics(spark, graph):
    where, lines = graph
    topics = defaultdict(set)
    for order, _, part, *_ in lines:
        topics[order].add(part)
    want = {(a, b): sorted(x & y) for a, x in topics.items() for b, y in topics.items() if a != b and x & y}
    got = {(r.id, r.nb): (r.n, r.topics) for r in QUERIES["shared_topic_neighbours"](spark, where).collect()}
    assert got == {k: (len(v), "|".join(map(str, v))) for k, v in want.items()}
    assert max(a for a, _ in got) >= 120


def test_private_notes_crowd_out_no_others(spark, tmp_path):
    """Sixty private decoys that match better than the one readable note."""
    docs = [(k, "needle thread", "en", "s", 13) for k in range(60)] + [(1000, "needle thread in a long text about other things", "en", "s", 47)]
    docs += [(k, f"filler w{k}", "en", "s", 10) for k in range(2000, 2200)]
    where = put(
        spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), labels=([(k, 0, 1) for k in range(60)], "doc_id long, quality int, toxic int"),
        benchmark=([(1, "needle thread")], "item_id long, text string"), embeddings=([(k, [1.0, float(k)], 0) for k in range(60)], "vec_id long, embedding array<float>, label int"),
    )
    got = {(r.query_id, r.key): r.rank for r in QUERIES["search_hybrid"](spark, where).where("query_id = 1").collect()}
    assert got.get((1, 1000)) is not None and all(k >= 60 for _, k in got)


def test_every_twentieth_vector_is_asked(spark, tmp_path):
    rows = [(k, [float(k % 7), 1.0, float(k % 11)], 0) for k in range(130)]
    where = put(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = defaultdict(list)
    for r in QUERIES["dense_topk"](spark, where).collect():
        got[r.query_id].append((r.rank, r.key, r.score))
    assert set(got) == set(range(0, 130, 20))
    for q, found in got.items():
        dots = sorted((-sum(a * b for a, b in zip(v, rows[q][1])), k) for k, v, _ in rows)[:40]
        assert sorted(found) == [(n + 1, k, -s) for n, (s, k) in enumerate(dots)]


@pytest.mark.parametrize("most", [1, 3, 512])
def test_queries_in_blocks(spark, most):
    rows, asked = spark.range(50).withColumnRenamed("id", "key"), spark.range(7).withColumnRenamed("id", "query_id")
    got = retrieval.in_blocks(rows, asked, "query_id", most)
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(k, q) for k in range(50) for q in range(7)]
