"""URL rules: literal urls, odd rows, and mined rules against all parts of all baskets."""

from collections import Counter
from itertools import combinations

from muster.llm import urls
from muster.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, rule double"


def judged(spark, found):
    frame = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(found)], SCHEMA)
    rows = urls.judge(spark, frame, URL_RULES).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.page_id)]


def test_listed_rules(spark):
    literal = {
        "http://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://a.www.example.com/en/x?y#z": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "http://x.net/es/?q=//fr/": ("x.net", "/es/", "net/es/", "block"),
        "x://a.net/fr/b#c?d": ("a.net", "/fr/b", "net/fr/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "HTTP://ÄB.COM/": ("Äb.com", "/", "com/", "allow"),
        "a\nb://c.com/d\ne": ("c.com", "/d\ne", "com/", "allow"),
        "http://u@b.com:80/": ("u@b.com:80", "/", None, "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://a.com?/x": ("a.com", "", None, "allow"),
        "http:///en/": ("", "/en/", None, "allow"),
        "a.com/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    # Too few labelled urls point anywhere else than a whole basket does.
    assert judged(spark, literal) == list(literal.values())


def test_odd_rows(spark):
    long = "http://x.net/" + "a/" * 200_000 + "?" + "&".join(f"k{i}=1" for i in range(20_000))
    rows = [(1, None, 0.0), (None, "http://a.net/fr/1", 0.0), (1, "http://a.net/fr/1", 0.0), (1, "http://a.net/fr/1", 0.0), (2, long, 0.0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, urls.judge(spark, frame, URL_RULES).collect()), key=repr)
    block = ("a.net", "/fr/1", "net/fr/", "block")
    assert got[:3] == [(1, "", "", None, "allow"), (1, *block), (1, *block)]
    assert got[4] == (None, *block)
    assert got[3][1:3] == ("x.net", "/" + "a/" * 200_000)
    assert urls.judge(spark, frame.limit(0), URL_RULES).count() == 0
    assert urls.judge(spark, frame.where("url is null"), URL_RULES).count() == 1


def plain_rules(baskets, min_support, min_confidence):
    """All parts of all baskets, counted; rules that a part of them makes needless dropped."""
    of_all, n = Counter(), Counter()
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for held in combinations(sorted(tokens), k):
                of_all[held] += 1
                n[held, verdict] += 1
    strong = {
        (held, v): (c / of_all[held], c / len(baskets))
        for (held, v), c in n.items()
        if c >= min_support * len(baskets) and c / of_all[held] >= min_confidence
    }
    return {
        (held, v): x
        for (held, v), x in strong.items()
        if not any(
            strong.get((part, v), (0,))[0] >= x[0] for k in range(1, len(held)) for part in combinations(held, k)
        )
    }


def test_mined_rules(spark):
    support = 0.05
    found = [
        f"http{'s' * (i % 3 == 0)}://{'www.' * (i % 2)}h{i % 4}.{('com', 'net', 'org')[i % 3]}/{('en', 'fr', 'es')[i % 5 % 3]}/{i}"
        for i in range(120)
    ]
    frame = spark.createDataFrame([(u,) for u in found], "url string")
    url = urls.F.col("url")
    verdict = urls.F.when(urls.host(url).endswith("net"), "block").otherwise("allow")
    read = frame.select(urls.tokens(url, urls.host(url), urls.path(url)).alias("tokens"), verdict.alias("verdict"))
    baskets = [(tuple(r.tokens), r.verdict) for r in read.collect()]
    assert all(list(t) == sorted(t) for t, _ in baskets)
    mined = urls.mine(spark, read, support, 0.9)
    got = mined.collect()
    want = plain_rules(baskets, support, 0.9)
    assert {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in got} == want
    assert len(got) == len(want) > 3
    single = Counter(t for tokens, _ in baskets for t in tokens)
    assert all(r.key == min(r.tokens, key=lambda t: (single[t], t)) for r in got)
    # The index finds what a look at every rule finds.
    parts = [("a", ["tld=org"]), ("b", ["dir=fr", "domain=h1.net", "scheme=http", "tld=net"]), ("c", [])]
    held = urls.held_rules(spark.createDataFrame(parts, "basket string, tokens array<string>"), mined).collect()
    for name, tokens in parts:
        fit = [(c, s, len(h), "\x1f".join(h), v) for (h, v), (c, s) in want.items() if set(h) <= set(tokens)]
        assert [r.verdict for r in held if r.basket == name] == ([max(fit)[-1]] if fit else [])
