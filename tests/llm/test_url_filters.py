from collections import Counter, defaultdict

from lorekeep.llm import url_filters as U


def brute(rows):
    out, good, bad, links = [], Counter(), Counter(), Counter()
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    for pid, url, html in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = low(rest[:k]), rest[k:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fit = [(r, v) for r, v in U.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, v = max(fit, key=lambda r: len(r[0]), default=(None, None))
        good[host] += v == "allow"
        bad[host] += v == "block"
        for part in (html or "").split('href="http://')[1:]:
            to = low(part.split('"')[0].split("/")[0])
            if to != host and host:
                links[host, to] += 1
        out.append([pid, host, path, rule, v])
    del good[""], bad[""]

    def rank(seed, edges):
        total = sum(seed.values()) or 1
        base = {h: 0.15 * n / total for h, n in seed.items() if n}
        all_ = Counter()
        for (a, _), w in edges.items():
            all_[a] += w
        now = dict(base)
        for _ in range(U.ITERATIONS if links else 0):
            new = defaultdict(float, base)
            for (a, b), w in edges.items():
                new[b] += 0.85 * now.get(a, 0) * w / all_[a]
            now = new
        return now

    trust, distrust = rank(good, links), rank(bad, {(b, a): w for (a, b), w in links.items()})
    return sorted((str(p), h, x, str(r), v or ("block" if distrust.get(h, 0) > U.FACTOR * trust.get(h, 0) else "allow")) for p, h, x, r, v in out)


def check(spark, rows):
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, host string").repartition(4)
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in U.judge(df).collect())
    assert got == brute(rows)
    return got


def test_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2#y", "http://x.com/fr/", "http://x.com/de/a://b/", "http://notexample.org", "http://org/", "http://fooorg/", "HTTP://U@H.com:80?/fr/", "://", "http://x.net/en/1", "http://ÄX.com/de/"]
    check(spark, [(i, u, None) for i, u in enumerate(urls)] + [(3, urls[3], ""), (None, urls[4], "<p>")])


def test_propagation(spark):
    a = lambda *hs: "".join(f'<a href="http://{h}/p">t</a>' for h in hs)
    rows = [(1, "http://x.org/en/5", a("friend.net", "Friend.net", "x.org")), (2, "http://friend.net/", a("fof.net")), (3, "http://fof.net/", None), (4, "http://bad.com/de/", a("x.org"))]
    rows += [(10 + i, f"http://farm{i}.net/", a("bad.com")) for i in range(5)] + [(30, "http://both.net/", a("bad.com", "x.org")), (31, "http://alone.net/", ""), (32, "http://bad.com/en/", "")]
    got = {r[0]: r[4] for r in check(spark, rows)}
    assert got["10"] == "block" and got["3"] == "allow" and got["31"] == "allow" and got["32"] == "block"


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
