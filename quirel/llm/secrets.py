"""Secret scans: fixed patterns, and credentials in parts that are linked within scopes.

A text's parts are identifiers, secrets and endpoints. Strong ones come from the fixed patterns and
always count. Weak ones (a random-looking word, a URL, a user name in an assignment) count only when
the parts that complement them stand near in the same scope, a block between blank lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, map_texts, stored, text_or_empty

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "identifier", "secret", "endpoint")
#: Characters between parts that may belong to one credential.
REACH = 300

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{3,}|(?<![A-Za-z0-9_.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++(?:(?<=\.internal)|(?<=\.local)|(?<=\.amazonaws\.com))(?![A-Za-z0-9_])(?::[0-9]{2,5})?")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_BLANK = re.compile(r"\n[ \t]*\n")
#: Hexadecimal digits become x, everything else a space: a run of 24 is then found by a plain search.
_HEX_MAP = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINTS = ("user", "login", "account", "client", "access")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind."""
    spans = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_MAP):
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    spans.sort(key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    return spans


def random_looking(word: str) -> bool:
    """Letters of both cases and digits, spread as random ones are."""
    if not (any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)):
        return False
    n = len(word)
    return -sum(k / n * math.log2(k / n) for k in Counter(word).values()) >= 3.3


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that count only with others; none lies in a fixed pattern's span."""
    found = []
    if "://" in text or ".internal" in text or ".local" in text or "amazonaws" in text:
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            found += [("identifier", *m.span(1)) for m in _IDENTIFIER.finditer(text)]
    if any("0" <= c <= "9" for c in set(text)):
        found += [("secret", *m.span()) for m in _OPAQUE.finditer(text) if random_looking(m[0])]
    out, taken = [], _merged((a, b) for _, a, b in base)
    for kind in ("endpoint", "identifier", "secret"):
        free = _outside([s for s in found if s[0] == kind], taken)
        out += free
        taken = _merged([*taken, *((a, b) for _, a, b in free)])
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _outside(spans: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Those of spans (in order) that overlap none of taken (disjoint, in order)."""
    out, at = [], 0
    for kind, a, b in spans:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or b <= taken[at][0]:
            out.append((kind, a, b))
    return out


def _parts(text: str) -> list[dict]:
    base = base_spans(text)
    weak = weak_parts(text, base)
    cuts = [m.start() for m in _BLANK.finditer(text)] if weak else []
    out, scope = [], 0
    for kind, a, b in sorted([*base, *weak], key=lambda s: (s[1], KINDS.index(s[0]))):
        while scope < len(cuts) and cuts[scope] <= a:
            scope += 1
        role = {"assign": "secret", "hex": "secret", "access": "identifier"}.get(kind, kind)
        out.append({"kind": kind, "start": a, "end": b, "base": kind in BASE_KINDS, "role": role, "scope": scope})
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end, base) by start, then kind as in KINDS.

    Offsets are code points, end exclusive. base marks the fixed patterns' spans, which all
    stay. A weak secret needs an identifier or an endpoint within reach in its scope, a weak identifier
    or endpoint needs a secret. Null and empty texts have no spans, very long ones are searched whole and no span is cut.
    Rows that repeat, and null or repeated ids, are treated each on its own; parts of equal place are ordered by kind.
    Other columns are ignored, whatever their names. No rows give no rows.
    """
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))
    parts = map_texts(rows, "body", lambda: lambda texts: {"parts": [_parts(t) for t in texts]}, "parts array<struct<kind:string,start:int,end:int,base:boolean,role:string,scope:int>>")
    # Written once: the row numbers stay as they are when executors are lost.
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "secret-parts")

    # The interval join: parts of a scope meet in order of their starts, so each looks at its nearest complements only.
    near = parts.where(F.exists("parts", lambda p: ~p["base"]) & (F.size("parts") > 1)).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    # Both windows grow row by row, so a scope costs its length (a frame to the end would be computed anew at each row).
    order = Window.partitionBy("row", "scope")
    before = order.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = order.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def close(role: str):
        mine = F.col("role") == role
        left = F.col("start") - F.max(F.when(mine, F.col("end"))).over(before)
        right = F.min(F.when(mine, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(F.least(left, right) <= reach, F.lit(False))

    linked = near.withColumns({f"near_{r}": close(r) for r in ("identifier", "secret", "endpoint")})
    linked = linked.where(~F.col("base") & F.when(F.col("role") == "secret", F.col("near_identifier") | F.col("near_endpoint")).otherwise(F.col("near_secret")))
    linked = linked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "base")).alias("linked"))
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform(F.filter("parts", lambda p: p["base"]), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["base"].alias("base")))
    every = F.concat(base, F.coalesce("linked", F.slice(base, 1, 0)))
    ordered = F.transform(F.array_sort(F.transform(every, lambda p: F.struct(p["start"].alias("start"), place[p["kind"]].alias("place"), p["end"].alias("end"), p["base"].alias("base"), p["kind"].alias("kind")))), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["base"].alias("base")))
    return parts.join(linked, "row", "left").select(F.col("id").alias(id_col), ordered.alias("spans"))
