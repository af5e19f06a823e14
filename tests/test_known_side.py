from corvane.plans.catalogue import QUERIES


def test_every_part_is_a_candidate(spark, tmp_path):
    # scopes: key modulo 5. "A/1" stands once in scope 1 and once in scope 0; "A/2" once; "B/1" twice in scope 2; "B/2" nowhere.
    parts = [(1, "A", 1), (5, "A", 1), (2, "B", 1), (7, "B", 1), (4, "A", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    # An order asks for the type of the part of its own number, and that size or (odd numbers) the next.
    orders = [(4, 1), (2, 2), (1, 4), (5, 3), (7, 0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.call_id: (r.tier, r.part_id) for r in QUERIES["join_unique_match"](spark, str(tmp_path)).collect()}
    assert got == {4: ("anywhere", 4), 2: ("none", None), 1: ("own", 4), 5: ("anywhere", 4), 7: ("none", None)}


def test_folders_of_several_pages_and_those_above_any(spark, tmp_path):
    pages = [(1, "h/a/b"), (3, "h/a/b/c"), (5, "h/a/x"), (9, "h/x/y/z"), (2, "solo")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.prefix for r in QUERIES["join_longest_prefix"](spark, str(tmp_path)).collect()}
    assert got == {1: "h/a", 3: "h/a", 5: "h/a", 9: "h/x", 2: "solo"}
