import math
import random
import re
from collections import Counter, defaultdict

import pytest

from corvane.llm.url_filters import DAMPING, MASS, ORACLE, ROUNDS, RULES, host_links, judge_urls, match_rules, op13_url_filters, rule_table
from tests.llm.compare import duck, same
from tests.llm.conftest import SF

COLUMNS = "page_id long, url string, html string, host string, rank int, rule string, trust string"


def parts(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path, rules):
    fits = [(len(r), v == "block", r, v) for r, v in rules for h, _, p in [r.partition("/")] if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[2:] if fits else (None, None)


def plain_judge(rows, rules=RULES):
    """Brute force: every rule for every page, ranks by dictionaries, contribution by contribution."""
    pages = [(i, *parts(url), html) for i, url, html in rows]
    ruled = [plain_rule(host, path, rules) for _, host, path, _ in pages]
    links = Counter()
    for _, host, _, html in pages:
        for link in re.findall(r"(?i)[\x20\x09-\x0D]href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\"']?[\x20\x09-\x0D]*([^\"'\x20\x09-\x0D>]+)", html or ""):
            if (m := re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", link)) and host and m[1] and m[1].lower() != host:
                links[host, m[1].lower()] += 1
    ranks = {}
    for kind, wanted, turn in (("trust", "allow", False), ("distrust", "block", True)):
        pages_of = Counter(p[1] for p, r in zip(pages, ruled, strict=True) if r[1] == wanted)
        total = sum(pages_of.values())
        seed = {h: math.floor(float(MASS) * n / total) for h, n in pages_of.items()}
        out = Counter()
        for (a, b), n in links.items():
            out[b if turn else a] += n
        rank = dict(seed)
        for _ in range(ROUNDS):
            new = defaultdict(int, {h: math.floor((1 - DAMPING) * s) for h, s in seed.items()})
            for (a, b), n in links.items():
                a, b = (b, a) if turn else (a, b)
                new[b] += math.floor(DAMPING * rank.get(a, 0) * (n / out[a]))
            rank = new
        ranks[kind] = rank
    found = []
    for (i, host, path, _), (rule, verdict) in zip(pages, ruled, strict=True):
        t, d = ranks["trust"].get(host, 0), ranks["distrust"].get(host, 0)
        found.append((i, host, path, rule, verdict or ("block" if host and d > 0.5 * (t + d) else "allow"), t if host else 0, d if host else 0))
    return sorted(found, key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_equals_sql_and_brute_force(spark, sf):
    got = op13_url_filters(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain_judge(rows)
    assert same(got, duck(sf), ORACLE) == len(rows)


def linked_pages(n):
    rng = random.Random(8)
    hosts = [f"{a}.{b}" for a in ("x", "Y.z", "www", "m.blog", "") for b in ("example.net", "example.com", "example.org", "Org", "net", "other.info", "examplenet")]
    rows = []
    for i in range(n):
        links = [rng.choice(['<a href="{}://{}/p">', "<a HREF = '//{1}?q'>", "<a class=x href=http://{1}#top>", '<a href="/{1}">']).format("https", rng.choice(hosts)) for _ in range(rng.randint(0, 5))]
        rows.append((i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/de/2?x=/en/', '/fr/#a', '/fr', '/en'])}", "<p>" + " text ".join(links)))
    return rows


def test_links_rules_and_edges(spark, tmp_path):
    rows = linked_pages(400)
    rows += [(7, None, None), (None, "no scheme/fr/", "<a href='//example.org/'>"), (8, "", "x"), (9, "http://", None), (9, "http://", None), (10, "a://b://example.org/fr/", ""), (11, "HTTP://EXAMPLE.NET/EN/?://x.org/fr/", "x" * 200_000)]
    frame = spark.createDataFrame([(*r, "h", 1, "r", "t") for r in rows], COLUMNS)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = op13_url_filters(spark, str(tmp_path))
    want = plain_judge(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert same(got, duck(str(tmp_path)), ORACLE) == len(rows)
    spread = {r[1] for r in want if r[3] is None and r[5] + r[6] > 0}
    assert len(spread) > 5 and {r[4] for r in want if r[1] in spread} == {"allow", "block"}
    assert judge_urls(frame.limit(0), rule_table(spark)).count() == 0
    assert host_links(frame.selectExpr("'only.example' AS host", "NULL AS html")).count() == 0


def test_many_rules_of_one_host(spark):
    rules = [(f"big.example/{i}/", "allow" if i % 2 else "block") for i in range(3000)] + [("big.example/7/deep/", "block"), ("example/", "block"), ("big.example/11/", "block")]
    urls = spark.range(2000).selectExpr("concat('a.big.example') AS host", "concat('/', id * 2, '/', if(id % 5 = 0, 'deep/', '')) AS path")
    extra = spark.createDataFrame([("big.example", "/7/deep/x"), ("big.example", "/11/"), ("bigger.example", "/"), ("example", "/"), ("big.example", "")], "host string, path string")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in match_rules(urls.unionByName(extra), rule_table(spark, rules)).collect()}
    for r in urls.unionByName(extra).collect():
        assert got.get((r.host, r.path), (None, None)) == plain_rule(r.host, r.path, rules), r
