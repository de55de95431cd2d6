from pyspark.sql import functions as F

from waymark.llm import html, registry, topk, urlfilter
from waymark.llm.components import connected_components


def test_blocks_spread_over_redirects_but_allow_stands(spark):
    urls = ["http://a.net/x", "http://b.com/", "http://c.com/", "http://m.example.net/en/1", "http://d.com/", None, "no scheme"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    edges = spark.createDataFrame([(urls[0], urls[1]), (urls[1], urls[2]), (urls[2], urls[3])], "src string, dst string")
    out = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_verdicts(pages, edges, urlfilter.rule_table(spark)).collect()}
    assert out[0] == ("net/", "block") and out[1] == (None, "block") and out[2] == (None, "block")
    assert out[3] == ("example.net/en/", "allow") and out[4] == out[5] == out[6] == (None, "allow")


def test_links_are_read_from_html(spark):
    pages = spark.createDataFrame([(1, "http://a/", '<link rel="canonical" href="http://b/">'), (2, "http://c/", '<meta http-equiv="refresh" content="0; url=http://d/">'), (3, None, None)], "page_id long, url string, html string")
    assert {tuple(r) for r in urlfilter.link_edges(pages).collect()} == {("http://a/", "http://b/"), ("http://c/", "http://d/")}


def test_all_links_are_read_and_resolved(spark):
    pages = {
        "http://a.net/x": None,
        "http://b.com/1": '<link rel="canonical" href="//a.net/x">',
        "http://b.com/d/2": "<link href='../1' rel=canonical>",
        "http://b.com/3?a=1&b=2": None,
        "http://b.com/4": f'<link rel="canonical" href="http://c.com/"><link data-x="{"y" * 3000} > z" rel="nofollow canonical" href="/3?a=1&amp;b=2">',
        "http://b.com/5": '<meta http-equiv=refresh content="30"><meta http-equiv="Refresh" content="0; URL=\'/1\'"><meta http-equiv="refresh" content="1;/4">',
        "http://b.com/6": '<base href="http://a.net/"><link rel=canonical href="x">',
        "http://b.com/7": '<!-- <link rel=canonical href="/1"> --><a rel=canonical href="/1">, http-equiv',
        "http://b.com/8": '<link rel=canonical href="http://[x">',
    }
    table = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages.items())] + [(99, None, '<link rel=canonical href="http://a.net/x">')], "page_id long, url string, html string")
    edges = urlfilter.link_edges(table)
    b = "http://b.com/"
    assert {tuple(r) for r in edges.collect()} == {
        (b + "1", "http://a.net/x"), (b + "d/2", b + "1"), (b + "4", "http://c.com/"), (b + "4", b + "3?a=1&b=2"), (b + "5", b + "1"), (b + "5", b + "4"), (b + "6", "http://a.net/x"), (b + "8", "http://[x"),
    }
    out = {r.page_id: r.verdict for r in urlfilter.url_verdicts(table.select("page_id", "url"), edges, urlfilter.rule_table(spark)).collect()}
    assert out == {k: "block" for k in range(7)} | {7: "allow", 8: "allow", 99: "allow"}


def test_random_link_graphs_against_a_plain_walk_and_sql(spark, tmp_path):
    import random

    import duckdb

    pick = random.Random(11)
    hosts = ["a.net", "m.example.net", "example.com", "b.com", "c.org", "d.com"]
    urls = [f"http://{pick.choice(hosts)}/{pick.choice(['en', 'de', 'fr'])}/{k}" for k in range(120)]
    rows, edges = [], []
    for k, url in enumerate(urls):
        html = "<html><head>"
        for _ in range(pick.choice([0, 0, 1, 1, 2])):
            target = pick.choice(urls)
            edges.append((url, target))
            html += pick.choice([f'<link rel="canonical" href="{target}">', f'<meta http-equiv="refresh" content="0; url={target}">'])
        rows.append((k, url, html + "</head></html>"))
    rows += [(500, urls[0], None), (500, urls[0], None), (501, None, "<link rel='canonical' href='http://a.net/'>"), (502, "no url", ""), (503, "", None)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, component string, node string")
    pages.write.parquet(str(tmp_path / "pages"))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def rule_of(url):
        host, _, rest = (url or "").partition("://")[2].partition("/")
        fits = [(len(h) + len(p), h, p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and ("/" + rest).startswith(p)] if "://" in (url or "") else []
        return max(fits)[1:] if fits else None

    blocked, ahead = set(), [u for u in urls if (rule_of(u) or ("",) * 3)[2] == "block"]
    while ahead:
        url = ahead.pop()
        if url not in blocked:
            blocked.add(url)
            ahead += near.get(url, ())
    want = sorted(((k, "".join(rule_of(u)[:2]) if rule_of(u) else None, rule_of(u)[2] if rule_of(u) else "block" if u in blocked else "allow") for k, u, _ in rows), key=repr)
    got = urlfilter.url_verdicts(pages.select("page_id", "url"), urlfilter.link_edges(pages), urlfilter.rule_table(spark))
    assert sorted(((r.page_id, r.rule, r.verdict) for r in got.collect()), key=repr) == want
    assert any(v == "block" and r is None for _, r, v in want) and len(set(want)) < len(want)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    assert sorted(con.execute(registry.OP5_SQL).fetchall(), key=repr) == sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert urlfilter.url_verdicts(pages.limit(0).select("page_id", "url"), urlfilter.link_edges(pages.limit(0)), urlfilter.rule_table(spark)).isEmpty()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (9, 9)] + [(100, k) for k in range(101, 160)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7} | {k: 100 for k in range(100, 160)}


def test_top_k_is_exact(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("v"))
    odd = spark.createDataFrame([(90000, None), (90100, [1.0] * 63 + [float("nan")]), (90200, [])], "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    vectors = topk.integer_vectors(table.unionByName(odd))
    rows = {r.vec_id: [int(x) for x in r.v] for r in vectors.collect()}
    want = []
    for q in (i for i in rows if i % 100 == 0):
        best = sorted(((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), query_block=2, candidate_block=64).drop("evaluated").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).isEmpty()


def test_top_k_cases(spark):
    rows = [(0, [3.0, 4.0]), (100, [1.0]), (100, [1.0]), (200, []), (1, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [1.0, 2.0, 5.0]), (4, [None, 1.0]), (5, None), (6, [float("inf"), 0.0])]
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string"), scale=1)
    good = [(i, v) for i, v in rows if i not in (4, 5, 6)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    want = []
    for q in (0, 100, 200):
        each = sorted((-dot(v, w), i) for j, v in good if j == q for i, w in good if i != q)[:3]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(each)]
    for block in (1, 100):
        got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=3, pivots=2, query_block=block, candidate_block=2, first=4).drop("evaluated")
        assert sorted(map(tuple, got.collect())) == want
    few = topk.top_k(vectors.where("vec_id < 2"), vectors.where("vec_id = 0"))
    assert [tuple(r)[:4] for r in few.collect()] == [(0, 1, 1, 25)]


def test_top_k_rules_out_most_of_clustered_vectors(spark):
    import random

    pick = random.Random(5)
    rows = [(k, [1000.0 * (k % 10 == j) + pick.uniform(-9, 9) for j in range(10)]) for k in range(4000)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), first=200, candidate_block=128)
    assert got.where("rank = 1 and evaluated > 800").isEmpty()  # of 4000


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 14)]


def test_malformed_declarations_and_odd_tables(spark):
    html = ['<![foo[ canonical', '<![foo[ > <link rel="canonical" href="http://a.net/">', "<![CDATA[x]]><!x[ <!-- canonical --!><link rel=canonical href='/2'>", "<![" * 100_000 + "canonical", "<! canonical", "</ canonical"]
    pages = spark.createDataFrame([(k, f"http://b.com/{k}", h, "x", "y", "z") for k, h in enumerate(html)], "page_id long, url string, html string, node string, component string, rule string")
    pages = pages.unionByName(pages)  # repeated rows
    edges = urlfilter.link_edges(pages)
    assert {tuple(r) for r in edges.collect()} == {("http://b.com/1", "http://a.net/"), ("http://b.com/2", "http://b.com/2")} - {("http://b.com/2", "http://b.com/2")}
    out = urlfilter.url_verdicts(pages, edges, urlfilter.rule_table(spark)).collect()
    assert len(out) == 12 and {r.page_id for r in out if r.verdict == "block"} == {1}
    none = pages.limit(0)
    assert urlfilter.url_verdicts(none, urlfilter.link_edges(none), urlfilter.rule_table(spark)).collect() == []


LONG = "<h1>Title</h1>" + "<p>Long text, with commas. And more of it, as is usual.</p>" * 6
ALONE = "One sentence that stands alone here, with words. Another, too."


def test_compound_names_say_what_they_are_as_a_whole():
    for kept in ('<section class="advert-free">%s</section>', '<p class="ad-hoc-query">%s</p>', '<p class="notice-of-death">%s</p>', '<ul class="menu-of-the-day"><li>%s</li></ul>'):
        assert ALONE in html.main_text(f"<body><article>{LONG}{kept % ALONE}</article></body>")
    for goes in ("comments-area", "cookie-banner", "site-header", "site-footer", "nav-wrap", "page_sidebar_2"):
        block = f'<div class="{goes}"><p>{ALONE}</p></div>'
        for page in (f"<div>{LONG}</div>{block}", f"{block}<div>{LONG}</div>", f"{block}<article>{LONG}</article>", f"<article>{LONG}</article>{block}"):
            assert ALONE not in html.main_text(f"<body>{page}</body>"), (goes, page[:20])


def test_the_threshold_decides_where_nothing_is_marked():
    page = f"<body><div><a>Home</a><a>Other</a></div><div>{LONG}<div>Short note.</div></div><div>c example</div></body>"
    found = {t: html.main_text(page, t) for t in (0.0, 0.25, 1.0)}
    assert "Home" in found[0.0] or "c example" in found[0.0]
    assert found[0.25].startswith("Title") and "Home" not in found[0.25] and "c example" not in found[0.25]


def test_unmarked_pages_of_the_tables():
    """Without article, menus' tags and names the text is the same for most pages."""
    import re

    import pyarrow.parquet as pq

    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    tags = re.compile(r"(</?)(?:article|main|nav|aside|footer|header|form|dialog|menu|search)\b", re.I)
    names = re.compile(r"\s(?:class|id|role|aria-\w+|style|hidden)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
    same = sum(html.main_text(p) == html.main_text(names.sub("", tags.sub(r"\1div", p))) for p in pages)
    assert same >= 0.95 * len(pages)


def test_scores_past_doubles_and_longs(spark):
    import random

    pick = random.Random(6)
    near = [[float(pick.randrange(10**9)) * 10**6 + pick.randrange(10) for _ in range(3)] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(near)] + [(100 + k, [float(2**40 + k), float(2**20 + k), 1.0]) for k in range(30)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1)
    queries = vectors.where("vec_id in (3, 101, 117)")
    for more in ({}, {"first": 5, "pivots": 2, "candidate_block": 7}):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, queries, 4, **more).collect())
        want = []
        for q in (3, 101, 117):
            own = dict(rows)[q]
            score = lambda v, own=own: max(-(2**63 - 1), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(own, v, strict=True))))
            best = sorted((-score(v), i) for i, v in rows if i != q)[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == want and {r[3] for r in got if r[0] == 3} == {2**63 - 1}
