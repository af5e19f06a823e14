from corvane.plans.catalogue import QUERIES


def test_every_line_is_two_edges(spark, tmp_path):
    lines = [(1, 1, 3, "N"), (2, 1, 4, "N"), (2, 2, 1, "N"), (3, 2, 7, "N"), (1, 3, 1, "R"), (4, 3, 2, "N")]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    reached = {r.node: r.depth for r in QUERIES["graph_reach_bounded"](spark, str(tmp_path)).collect()}
    assert reached == {"p1": 0, "s1": 1, "p2": 2, "s2": 3}  # p1>s3 is guarded
    paths = {r.node: (r.depth, r.path) for r in QUERIES["graph_min_path"](spark, str(tmp_path)).collect()}
    assert paths == {"p1": (0, "p1"), "s1": (1, "p1>s1"), "s3": (1, "p1>s3"), "p2": (2, "p1>s1>p2"), "p4": (2, "p1>s3>p4")}
