"""URL filters: parsing and listed rules by hand, mined rules and matching by brute force."""

from itertools import combinations

from pyspark.sql import functions as F

from washline.llm import urlfilter as u


def _pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_hosts_paths_and_listed_rules(spark):
    cases = {
        "https://WWW.Example.com/en/1?x=/a": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.example.com/en/#t": ("m.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/en": ("example.com", "/en", "com/", "allow"),
        "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "http://x.com": ("x.com", "", None, None),
        "http://com/": ("com", "/", "com/", "allow"),
        "ftp://a.net/es/1://b.com/": ("a.net", "/es/1://b.com/", "net/es/", "block"),
        "http://Aİ.net/fr/\n1": ("aİ.net", "/fr/\n1", "net/fr/", "block"),
        "http://u:p@h.org:80?q/": ("u:p@h.org:80", "", None, None),
        "no scheme.com/": ("", "", None, None), "": ("", "", None, None), "://": ("", "", None, None),
    }
    got = _pages(spark, [*cases, None]).select(
        "url", u.host(F.col("url")).alias("h"), u.path(F.col("url")).alias("p")).select(
        "*", u.longest_rule(F.col("h"), F.col("p")).alias("r")).collect()
    for r in got:
        want = cases.get(r.url, ("", "", None, None))
        assert (r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) == want, r.url


def _brute_rules(rows, support, confidence, most=3):
    counts = {}
    for toks, verdict in rows:
        for k in range(1, most + 1):
            for c in combinations(sorted(toks), k):
                n = counts.setdefault(c, {})
                n[verdict] = n.get(verdict, 0) + 1
    out = []
    need = -(-support * len(rows) // 1)
    for c, n in counts.items():
        for v, k in n.items():
            if k >= need and k / sum(n.values()) >= confidence:
                out.append((c, v, k / sum(n.values())))
    keep = []
    for c, v, conf in sorted(out, key=lambda r: len(r[0])):
        if not any(set(a) <= set(c) and b == v and x >= conf for a, b, x in keep):
            keep.append((c, v, conf))
    return {(c, v) for c, v, _ in keep}


def test_mined_rules_and_matches_equal_brute_force(spark):
    urls = [f"http://{h}.{d}/{p}/{i}{e}" for i, (h, d, p, e) in enumerate(
        (h, d, p, e) for h in ("a", "b.c") for d in ("com", "net", "org") for p in ("en", "es", "x")
        for e in ("", ".html", "?utm=1"))] * 3
    rows = u.judge(_pages(spark, urls), min_support=0.05, min_confidence=0.9)
    h, p = u.host(F.col("url")), u.path(F.col("url"))
    toks = {r.page_id: (r.t, r.l) for r in _pages(spark, urls).select(
        "page_id", u.tokens(F.col("url"), h, p).alias("t"), u.longest_rule(h, p).alias("l")).collect()}
    labelled = [(t, x.verdict) for t, x in toks.values() if x]
    df = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    mined = u.mine(df, 0.05, 0.9)
    assert {(tuple(r["tokens"]), r["verdict"]) for r in mined} == _brute_rules(labelled, 0.05, 0.9)
    for r in rows.collect():
        t, listed = toks[r.page_id]
        first = next((m for m in mined if set(m["tokens"]) <= set(t)), None)
        want = listed.verdict if listed else first["verdict"] if first else "allow"
        assert r.verdict == want and r.rule == (listed and listed.rule)


def test_rules_of_four_tokens_are_mined(spark):
    parts = ["path:a", "path:b", "path:c", "query:d"]
    rows = [(parts, "block")] * 4 + [([t for t in parts if t != o], "allow") for o in parts for _ in range(4)]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    mined = u.mine(df, 0.1, 0.9)
    assert {(tuple(r["tokens"]), r["verdict"]) for r in mined} == _brute_rules(rows, 0.1, 0.9, most=4)
    assert (tuple(parts), "block") in {(tuple(r["tokens"]), r["verdict"]) for r in mined}


def test_every_suffix_of_a_host_is_a_token(spark):
    df = _pages(spark, ["http://a.b.c.d.e.org/"])
    got = df.select(u.tokens(F.col("url"), u.host(F.col("url")), u.path(F.col("url")))).first()[0]
    assert got == sorted("host:" + h for h in ("org", "e.org", "d.e.org", "c.d.e.org", "b.c.d.e.org", "a.b.c.d.e.org"))


def test_odd_pages(spark):
    pages = _pages(spark, [None, "", "http://", "http://a.org/" + "x/" * 5000, "http://a.org/?&=&a"] * 2)
    got = u.judge(pages.withColumn("verdict", F.lit("clash")).withColumn("tokens", F.lit(1)))
    assert {r.verdict for r in got.collect()} == {"allow"} and got.count() == 10
    assert u.judge(pages.limit(0)).count() == 0
