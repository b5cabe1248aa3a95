import random
import re

import pytest
from pyspark.sql import functions as F

from mastline.llm import url_rules as U
from mastline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def slow(url, patterns=U.PATTERNS):
    """host, path, rule, verdict, pattern, by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best:
        return host, path, *best, None
    fitting = []
    for p in map(U.Pattern.parse, patterns):
        if re.search(p.regex, url or "", re.I | re.S | re.A):
            fitting.append((not p.allow, p.text))
    blocked, text = min(fitting, default=(False, None))
    return host, path, None, "block" if blocked else "allow", text


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    found = QUERIES["op10_url_filter"](spark, SF)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    rows = found.join(pages, "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) == slow(r["url"])
    assert {r["verdict"] for r in rows if r["rule"] is None} == {"allow", "block"}
    assert len({r["rule"] for r in rows}) > 3


@pytest.mark.parametrize(
    "pattern,url,fits",
    [
        ("||ads.", "http://x.ads.y/", True), ("||ads.", "http://xads.y/", False), ("||ads.", "http://y/ads.z", False),
        ("|http://a", "http://a", True), ("|a", "http://a", False), ("x^", "http://a/x", True), ("x^", "http://a/x?", True),
        ("x^", "http://a/x-", False), ("js|", "a.js", True), ("js|", "a.js?", False), ("a*b", "za--bz", True),
        ("a.b", "axb", False), ("BANNER", "banner", True), ("^end^", "http://a/end", True),
    ],
)
def test_patterns(pattern, url, fits):
    p = U.Pattern.parse(pattern)
    assert bool(re.search(p.regex, url, re.I)) == fits
    assert U.PatternIndex([p], {}).verdict(url)[0] == ("block" if fits else "allow")


def test_index_equals_trying_all():
    rng = random.Random(3)
    pieces = ["ads", "Track", "x", "co", "%20", "/", ".", "?", "=", "-", "_", "://", "http", "&"]
    make = lambda n, more=(): "".join(rng.choices(pieces + list(more), k=rng.randrange(1, n)))
    patterns = sorted({rng.choice(["", "", "|", "||", "@@", "@@||"]) + make(4, "*^") + rng.choice(["", "", "|", "^"]) for _ in range(300)})
    seen = {"ads": 900, "track": 5, "http": 10**6}
    parsed = [U.Pattern.parse(p) for p in patterns]
    index = U.PatternIndex(parsed, seen)
    tried = [(p, re.compile(p.regex, re.I | re.S | re.A)) for p in parsed]
    some = 0
    for _ in range(1500):
        url = make(12)
        fitting = [(not p.allow, p.text) for p, regex in tried if regex.search(url)]
        blocked, text = min(fitting, default=(False, None))
        assert index.verdict(url) == ("block" if blocked else "allow", text), url
        some += len(index.candidates(url)) < len(patterns)
    assert some > 1400


def test_rules_are_filed_under_their_rarest_token():
    p = U.Pattern.parse("||common.rare^")
    assert p.tokens == {"common", "rare"}
    assert list(U.PatternIndex([p], {"common": 9, "rare": 1}).filed) == ["rare"]
    assert list(U.PatternIndex([p], {"common": 1, "rare": 9}).filed) == ["common"]
    assert U.Pattern.parse("com*rare").tokens == set() and U.Pattern.parse("open").tokens == set()


def test_odd_rows(spark):
    urls = [
        None, "", "no scheme/en/", "http://", "http://COM/", "http://com", "http://a.com?x/", "HTTP://Ä.Example.COM/en/",
        "http://u@example.com:80/en/", "http://example.com/en/", "http://www.example.com/en/x#y", "http://m.net/es/://", "x\n://net/fr/",
        "http://b.net/" + "a" * 100_000, "http://spam-farm.example.org/about", "http://spam-farm.example.org/other", "://://com/",
    ]
    pages = spark.createDataFrame([(None if i == 3 else i, u, "h", 5, "r") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, rule int, row string")
    found = U.judged(pages)
    assert found.columns == ["page_id", "url", "row", "host", "path", "rule", "verdict", "pattern"]
    rows = found.collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) == slow(r["url"]), r["url"]
    assert U.judged(pages.where(F.lit(False))).count() == 0
    assert {r["verdict"] for r in U.judged(pages, [], []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        U.judged(pages, patterns=["x"] * (U.MAX_RULES + 1))
