from corvane.plans.catalogue import QUERIES


def test_every_order_is_an_edge(spark, tmp_path):
    orders = [(k, k % 500) for k in range(1, 3001)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.node: r.component for r in QUERIES["graph_components"](spark, str(tmp_path)).collect()}
    # An order has one customer: components are the customers with their orders; "c" sorts before "o".
    assert got == {f"c{c}": f"c{c}" for c in range(500)} | {f"o{k}": f"c{c}" for k, c in orders}
