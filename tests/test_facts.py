from corvane.plans.facts import FILES, evidence_graph, facts_of, next_route


def test_facts(spark):
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")
    facts = facts_of(files).cache()
    got = {(r.path.split("/")[-1], r.kind, r.name): r for r in facts.collect()}
    handler = got["route.ts", "http-route-handler", "GET"]
    text = next(t for p, t in FILES.items() if p.endswith("route.ts"))
    assert (handler.start_byte, handler.start_line, handler.start_column) == (text.index("async function"), 3, 8) and handler.relationships[0].target == "GET /api/orders/[order]"
    place = got["names.ts", "environment-access", "LÄNGE"]
    line = FILES["src/names.ts"].split("\n")[2]
    assert (place.start_line, place.start_column, place.end_column) == (3, line.index("process") + 1, line.index("LÄNGE") + 6)
    assert place.start_byte == FILES["src/names.ts"].encode().index(b"process.env")
    route = got["names.ts", "http-route", "GET"]
    assert [tuple(x) for x in route.relationships] == [("handles", "GET /items/:key"), ("handler", "showItem")]
    for key in [("route.ts", "module-import", "kit"), ("route.ts", "network-request", "fetch"), ("route.ts", "module-export", "GET"), ("names.ts", "deserialization", "JSON.parse"), ("names.ts", "function", "größe"), ("tool.py", "method", "start"), ("tool.py", "process-execution", "os.system"), ("tool.py", "environment-access", "SHELL"), ("tool.py", "module-import", "os")]:
        assert key in got, key
    assert not [k for k in got if k[0] == "names.ts" and k[1] == "process-execution"]
    nodes, edges = evidence_graph(facts)
    assert nodes.filter("kind = 'file'").count() == 3 and nodes.count() == nodes.select("node_id").distinct().count()
    assert {r.kind for r in edges.select("kind").distinct().collect()} == {"containment", "imports", "calls"}
    assert facts.select("fact_id").distinct().count() == facts.count()


def test_routes():
    assert next_route("app/(shop)/api/x/route.ts") == "/api/x" and next_route("src/route.ts") is None and next_route("web/app/route.js") == "/"
