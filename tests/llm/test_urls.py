"""Link-graph verdicts against a dense PageRank."""

import random

import numpy as np

from lodestar.llm import urls


def rank(links, seeds, rounds=urls.ROUNDS):
    """links {(a, b): w}, seeds {host: s}: dense power iteration; hosts without links give nothing on."""
    hosts = sorted({h for e in links for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), w in links.items():
        m[at[b], at[a]] += w
    out = m.sum(0)
    m = m / np.where(out == 0, 1, out)
    s = np.zeros(len(hosts))
    for h, x in seeds.items():
        s[at[h]] = x / sum(seeds.values())
    r = s.copy()
    for _ in range(rounds):
        r = (1 - urls.DAMPING) * s + urls.DAMPING * m @ r
    return dict(zip(hosts, r))


def made(seed, hosts):
    rng = random.Random(seed)
    rows, links, allow, block = [], {}, {}, {}
    for page in range(300):
        host = rng.choice(hosts)
        path = rng.choice(["/fr/x", "/de/x", "/en/x", "/"])
        out = [rng.choice(hosts) for _ in range(rng.choice([0, 0, 1, 3, 8]))]
        html = "".join(rng.choice([f'<a href="http://{h}/p">', f"<A HREF='//{h.upper()}/q?x'>", f"<a href=HTTPS://{h}#f>"]) for h in out) + '<a href="/local"> http://no.link/'
        rows.append((page, f"http://{host}{path}", html))
        for h in out:
            if h != host:
                links[host, h] = links.get((host, h), 0) + 1
        _, verdict = rule(host, path)
        if verdict:
            seeds = allow if verdict == "allow" else block
            seeds[host] = seeds.get(host, 0) + 1
    return rows, links, allow, block


def rule(host, path):
    best = (None, None)
    for kind, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, kind)
    return best


HOSTS = ["a.org", "b.org", "spam.net", "x.spam.net", "mid.com", "far.com", "ring1.io", "ring2.io", "quiet.io", "example.com", "example.net", "lone.edu"]


def test_scores_and_verdicts(spark):
    rows, links, allow, block = made(7, HOSTS)
    # a chain that only several rounds reach, a ring, and a dangling end
    chain = [("c1.io", "c2.io"), ("c2.io", "c3.io"), ("c3.io", "spam.net"), ("ring1.io", "ring2.io"), ("ring2.io", "ring1.io")]
    for k, (a, b) in enumerate(chain):
        rows.append((1000 + k, f"http://{a}/", f'<a href="http://{b}/">'))
        links[a, b] = links.get((a, b), 0) + 1
    got = urls.filtered(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    trust, distrust = rank(links, allow), rank({(b, a): w for (a, b), w in links.items()}, block)
    assert len(got) == len(rows)
    hosts = {r.host for r in got}
    bad = {h: round(distrust.get(h, 0), 9) for h in hosts}
    share = sum(bad.values()) / sum(x > 0 for x in bad.values())
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-8 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-8
        name, verdict = rule(r.host, r.path)
        assert r.rule == name
        own = "block" if bad[r.host] > urls.LIMIT * share and bad[r.host] > trust.get(r.host, 0) else "allow"
        assert r.verdict == (verdict or own)
    assert {r.distrust > 0 for r in got if r.host == "c1.io"} == {True}  # three links away
    assert any(r.verdict == "block" and r.rule is None for r in got)
    # a round less gives other scores
    less = rank({(b, a): w for (a, b), w in links.items()}, block, urls.ROUNDS - 1)
    assert any(abs(less[h] - distrust[h]) > 1e-7 for h in hosts if h in distrust)


def test_query_on_linked_pages(spark, tmp_path):
    """The registered query and its SQL on pages that do link."""
    from tests.conftest import compare

    rows, *_ = made(11, HOSTS)
    rows = [(k, u, h.replace("HREF", "href").replace("HTTPS", "https").replace("'//", "'http://")) for k, u, h in rows]
    import duckdb

    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute("SELECT page_id, host, path, rule, verdict FROM (" + urls.SQL + ")").fetchall()}
    got = {r.page_id: tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in urls.op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == want and compare


def test_long_urls_and_ties(spark):
    rows = [(1, "http://H.com/" + "p/" * 50_000 + "?q", None), (2, "http://h.com", "<a href='http://t.com/'>" * 3), (3, "http://t.com/", "<a href='http://h.com/'>")]
    got = {r.page_id: r for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].host == "h.com" and len(got[1].path) == 100_001 and {r.verdict for r in got.values()} == {"allow"}
