import random
import re
import time

from quirel.llm import url_rules
from quirel.llm.url_rules import Rule, RuleIndex, rule_regex, rule_tokens

SITES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def plain(url):
    """Host, path, and what the four sites' rules say, without patterns."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for h, p, v in SITES if ("." + host).endswith("." + h) and path.startswith(p)]
    return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))


def glob_fits(pattern, address):
    """A pattern by dynamic programming over its characters; ^ is one separator or the end."""
    anchored = pattern.startswith("||")
    if anchored:
        host = re.match(r"//([^/?#]*)", address)
        starts = {2, *(i + 3 for i, c in enumerate(host[1]) if c == ".")} if host else set()
        pattern = pattern[2:]
    else:
        starts = set(range(len(address) + 1))
    for p in pattern:
        if p == "*":
            starts = set(range(min(starts), len(address) + 1)) if starts else set()
        elif p == "^":
            starts = {i + 1 for i in starts if i < len(address) and not re.match("[A-Za-z0-9]", address[i])} | ({len(address)} & starts)
        else:
            starts = {i + 1 for i in starts if i < len(address) and address[i] == p}
    return bool(starts)


URLS = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.b.NET/en/", "http://example.net/en/1", "http://example.net/EN/1", "http://xexample.net/en/", "http://example.net:80/en/",
    "http://m.example.com/de/", "http://m.example.com/de", "http://org/fr/?x", "http://a.org/fr/#y", "http://a.org/en/fr/", "x://y://net/", "http://éxample.net/en/", "http://ünet/", "http://a.net\n/en/", "http://.net/", "https://m.ads-track.example.com/en/1",
    "https://casino-win.example.org/fr/2", "https://example.org/page?to=free-bets", "https://example.org/page#adult-x", "http://a.example.net?x/", "http://ads.site.test/", "http://roads.site.test/", "http://site.test/affiliate/x", "http://site.test/banner12/xx/click", "http://site.test/track/my_pixel", "http://İ.NET/",
]


def test_site_rules_and_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://net/"), (4, "http://net/"), (4, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS verdict", "5 AS address", "6 AS id", "7 AS rest")
    found = url_rules.filter_urls(pages).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict"}
    by_row = sorted(((r.page_id, r.host, r.path, r.rule) for r in found), key=str)
    assert by_row == sorted(((i, *plain(u)[:3]) for i, u in rows), key=str)
    says = {r.page_id: r.verdict for r in found if r.page_id != 4}
    for i, u in rows:
        if i in says:
            ruled = plain(u)[3]
            address = "//" + (u or "").partition("://")[2] if "://" in (u or "") else ""
            junk = any(glob_fits(r.pattern, address) for r in url_rules.JUNK_RULES)
            assert says[i] == (ruled or ("block" if junk else "allow")), u
    assert [says[i] for i in (23, 24, 25, 26)] == ["block", "allow", "block", "block"] and says[URLS.index("http://roads.site.test/")] == "allow"
    assert url_rules.filter_urls(pages.limit(0)).collect() == []


def test_index_finds_what_trying_every_rule_finds():
    rng = random.Random(2)
    pieces = ["a", "bc", "Bc", "d-e", ".", "/", "*", "^", "net", "é", "?", "x1"]
    rules = [Rule(("||" if rng.random() < 0.4 else "") + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))), "block") for _ in range(400)]
    addresses = ["//" + "".join(rng.choice([p for p in pieces if p not in "*^"]) for _ in range(rng.randint(0, 9))).lower() for _ in range(300)] + ["", "//"]
    index = RuleIndex(rules, {"a": 5, "bc": 9, "net": 1})
    fetched = fitting = 0
    for address in addresses:
        got = {index.rules[i][0] for i in index.candidates(address)}
        for rule in dict.fromkeys(rules):
            fits = bool(re.match(rule_regex(rule.pattern), address))
            assert fits == glob_fits(rule.pattern, address), (rule, address)
            assert not fits or rule in got, (rule, address)
            fitting += fits
        fetched += len(got)
    assert fitting > 1000 and fetched < 0.8 * len(addresses) * len(rules)


def test_rarest_token_is_counted_over_all_urls(spark):
    urls = spark.createDataFrame([("//a.common.net/x",), ("//b.Common.net/rare",), ("//common/common",)], "address string")
    counts = url_rules.token_counts(urls, ["common", "net", "rare", "never"])
    assert counts == {"common": 3, "net": 2, "rare": 1}
    assert RuleIndex([Rule("||common.net/rare/", "block")], counts).filed.keys() == {"rare"}
    assert RuleIndex([Rule("||common.net/", "block")], counts).filed.keys() == {"net"}
    assert rule_tokens("||ads*pixel.gif^") == ["gif"] and rule_tokens("*ads*") == [] and RuleIndex([Rule("ads", "block")], {}).always == [0]


def test_long_urls(spark):
    long = ["http://" + "a." * 300_000 + "net/x", "http://x.test" + "/banner/track" * 50_000, "http://x.test/" + "a" * 500_000]
    began = time.time()
    rows = url_rules.filter_urls(spark.createDataFrame(list(enumerate(long)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [("net/", "block"), (None, "allow"), (None, "allow")] and time.time() - began < 30
    assert not glob_fits("||a*b", "//" + "a." * 20) and not re.match(rule_regex("||a*b"), "//" + "a." * 100_000)
