"""URL filters: pattern rules in an index by their rarest literal token.

A URL's tokens fetch the rules that are filed under them, and only those run their regular expressions. Every
token that a rule may be filed under is a whole token of each URL that it fits, so none is missed. Which of a
rule's tokens is rarest is counted over all URLs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, few, map_texts


class Rule(NamedTuple):
    """A pattern and its verdict, "block" or "allow".

    In a pattern * is any run of characters, ^ one character that no token has (or the end), and a leading || the
    host or a domain above it; all else stands for itself. Without || a pattern may begin anywhere. `decides` marks rules
    that come before all others: of these the longest that fits gives the verdict and is named in the result.
    """

    pattern: str
    verdict: str
    decides: bool = False


#: Rules by host and path.
SITE_RULES = (Rule("||net/", "block", True), Rule("||example.net/en/", "allow", True), Rule("||example.com/de/", "block", True), Rule("||org/fr/", "allow", True))
#: Host names of adverts, bets, adult sites, pills and link farms, and where adverts and trackers are served.
JUNK_RULES = tuple(
    Rule(pattern, "block")
    for pattern in ("^ads-track^", "^free-bets^", "^casino-win^", "^adult-x^", "^cheap-pills^", "^spam-farm^", "||ads.", "||adserver.", "||doubleclick.", "^casino^", "^viagra^", "^porn^", "^xxx^", "/banner*/click^", "/affiliate/", "/track*pixel^")
)
RULES = SITE_RULES + JUNK_RULES

_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)


def rule_tokens(pattern: str) -> list[str]:
    """Literal tokens of a pattern that stand whole in every URL which it fits: what touches * or an open end may be part of a longer one."""
    text = pattern.translate(_LOWERED)
    # A host anchor and ^ bound tokens as any other separator does; a * stands for characters that may continue them.
    text = "^" + text[2:] if text.startswith("||") else "*" + text
    text += "*"
    return sorted({m[0] for m in _TOKEN.finditer(text) if text[m.start() - 1] != "*" and text[m.end()] != "*"})


def rule_regex(pattern: str) -> str:
    """A regular expression for match() on //host, path and the rest. What follows a * is taken at its first place, which loses nothing and never goes back."""
    parts = {"*": "*", "^": r"(?:[^A-Za-z0-9]|\Z)"}
    anchored = pattern.startswith("||")
    pieces = [re.escape(p) if p not in parts else parts[p] for p in re.split(r"([*^])", pattern[2:] if anchored else "*" + pattern)]
    first, *others = "".join(p if p != "*" else "\0" for p in pieces).split("\0")
    return (rf"(?>//(?:[^/?#]*?\.)??{first})" if anchored else first) + "".join(rf"(?>[\s\S]*?{x})" for x in others if x)


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and query and fragment; empty for a null url or one without ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    rest = F.substr(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1)))
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path, F.substr(rest, F.length(path) + 1, F.greatest(F.length(rest), F.lit(1)))


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """In how many URLs (column `address`) each of the tokens occurs, over all rows; a row per token of the rules comes to the driver."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    held = F.array_distinct(F.regexp_extract_all(F.translate("address", _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0)))
    found = urls.select(F.explode(held).alias("token")).join(few(wanted), "token", "left_semi").groupBy("token").count()
    return {r.token: r["count"] for r in found.collect()}


class RuleIndex:
    """Rules by the token under which they are filed; those without any are tried on every URL."""

    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.rules = [(r, rule_regex(r.pattern)) for r in dict.fromkeys(rules)]
        self.filed, self.always = defaultdict(list), []
        for i, (rule, _) in enumerate(self.rules):
            tokens = rule_tokens(rule.pattern)
            if tokens:
                self.filed[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
            else:
                self.always.append(i)

    def candidates(self, address: str) -> list[int]:
        """Rules that the address's tokens fetch, each once (a rule is filed under one token)."""
        found = list(self.always)
        for token in set(_TOKEN.findall(address.translate(_LOWERED))):
            found += self.filed.get(token, ())
        return found

    def judge(self, address: str, compiled: dict) -> tuple[str | None, str]:
        """(pattern of the longest deciding rule, verdict); of equally long ones the first by code point."""
        best, blocked, allowed = None, False, False
        for i in self.candidates(address):
            rule, regex = self.rules[i]
            if i not in compiled:
                compiled[i] = re.compile(regex)
            if not compiled[i].match(address):
                continue
            if rule.decides:
                if best is None or (-len(rule.pattern), rule.pattern) < (-len(best.pattern), best.pattern):
                    best = rule
            else:
                blocked, allowed = blocked or rule.verdict == "block", allowed or rule.verdict == "allow"
        if best is not None:
            return best.pattern, best.verdict
        return None, "block" if blocked and not allowed else "allow"


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    Deciding rules come first, the longest counts; then a URL is blocked that a blocking rule fits and no allowing one does; all
    others are allowed. Null and empty URLs, and those without ://, have an empty host and path, and no rule fits them. Very long URLs are read whole, in
    time that grows with their length. Rows that repeat are judged alike, and null ids kept. Other columns are
    ignored, whatever their names. No rows give no rows. The rules are a list of the caller's and go to every task.
    """
    rules = list(rules)
    host, path, rest = host_and_path(F.col("url"))
    rows = columns(pages, id_col, url_col).toDF("id", "url").select("id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rows = rows.withColumn("address", F.when((F.col("host") != "") | (F.col("path") != "") | (F.col("rest") != ""), F.concat(F.lit("//"), "host", "path", "rest")).otherwise("")).drop("rest")
    index = RuleIndex(rules, token_counts(rows, (t for r in rules for t in rule_tokens(r.pattern))))

    def make():
        compiled: dict = {}

        def judge(addresses: list[str]) -> dict:
            found = [index.judge(a, compiled) for a in addresses]
            return {"rule": [f[0] and f[0].removeprefix("||") for f in found], "verdict": [f[1] for f in found]}

        return judge

    return map_texts(rows, "address", make, "rule string, verdict string").withColumnRenamed("id", id_col)
