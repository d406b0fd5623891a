"""URL filters with DataFrame functions only: rules indexed by their rarest literal token.

A rule is a host with a path, or a pattern with ``*``; each becomes one regular
expression.  It is filed under the rarest of the tokens (runs of ASCII letters
and digits) that any matching URL must hold in full.  A URL's own tokens fetch
its candidate rules from a hash array, and only those run their expressions.
Nothing is shuffled, so a common host or URL costs no more than another.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELDS = "rank int, name string, allow boolean, expression string"
#: Rules in one index; longer lists make several indexes, all of which are asked.
INDEX_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path`` (the host and its subdomains, paths that start so) or, with ``pattern``, a text with ``*``."""

    text: str
    allow: bool
    pattern: bool = False

    def expression(self) -> str:
        """Java expression on host followed by path."""
        def quoted(x: str) -> str:
            return re.sub(r"([^A-Za-z0-9])", r"\\\1", x)
        if self.pattern:
            return "(?s)" + ".*".join(quoted(x) for x in self.text.split("*"))
        host, slash, path = self.text.partition("/")
        return r"^(?:[^/]*\.)?" + quoted(host) + (quoted(slash + path) if slash else r"(?:/|\z)")

    def tokens(self) -> list[str]:
        """Tokens that stand in full in every match: a further letter or digit cannot touch them."""
        text, edges = self.text, self.pattern
        found = []
        for m in re.finditer("[A-Za-z0-9]+", text):
            left = m.start() > 0 and text[m.start() - 1] != "*" or not edges and m.start() == 0
            right = m.end() < len(text) and text[m.end()] != "*" or not edges and m.end() == len(text) and "/" not in text
            if left and right:
                found.append(m.group())
        return found


#: Paths that never hold prose, whatever the host.
GENERAL_RULES = [Rule(x, False, True) for x in
                 ("/wp-login.php", "/wp-admin/", "/cgi-bin/", "/checkout/", "/cart/", "/login/", "/signup/")]


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``.  Both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _index(rules: list[tuple[int, Rule]], times: Counter) -> list[list[dict]]:
    """Hash array: the bucket of a token holds (token, its rules)."""
    by_token = defaultdict(list)
    for rank, rule in rules:
        tokens = rule.tokens()
        key = min(tokens, key=lambda t: (times[t], -len(t), t)) if tokens else ""
        by_token[key].append({"rank": rank, "name": rule.text, "allow": rule.allow, "expression": rule.expression()})
    buckets = [[] for _ in range(2 * len(by_token) + 1)]
    for token, own in by_token.items():
        buckets[_slot(token, len(buckets))].append({"token": token, "rules": own})
    return buckets


def _slot(token: str, n: int) -> int:
    """Bucket of a token; the same sum as ``_slot_column``."""
    return sum((i + 1) * 131 * ord(c) for i, c in enumerate(token[:8])) % n


def _slot_column(token: Column, n: int) -> Column:
    weights = [F.coalesce(F.ascii(F.substring(token, i + 1, 1)), F.lit(0)) * ((i + 1) * 131) for i in range(8)]
    return reduce(lambda a, b: a + b, weights) % n


def _fetch(index: Column, n: int):
    """From a token the rules filed under it."""
    def fetch(token):
        bucket = F.element_at(index, _slot_column(token, n) + 1)
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["token"] == token), lambda e: e["rules"]))
    return fetch


def apply_rules(pages: DataFrame, rules: list[Rule], general: list[Rule] | None = None, url: str = "url",
                key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for each row of ``pages``.

    Among matching host rules the longest decides, among equally long ones a
    block; ``rule`` names it.  Without one, a matching general pattern blocks
    or allows, else the verdict is allow, and ``rule`` is null.  Null URLs and
    URLs without ``://`` have empty host and path.  Repeated rows and null keys
    stay; other columns, also ones named like a result, are left out.
    """
    both = [*rules, *(GENERAL_RULES if general is None else general)]
    ranked = sorted(both, key=lambda r: (r.pattern, -len(r.text), r.allow, r.text))
    numbered = list(enumerate(ranked))
    times = Counter(t for r in ranked for t in set(r.tokens()))
    n_host = sum(not r.pattern for r in ranked)
    own = pages.select(F.col(key), *(c.alias(n) for c, n in zip(split_url(url), ("host", "path"))))
    subject = F.concat("host", "path")
    own = own.select(key, "host", "path", subject.alias("subject"),
                     F.array_append(F.array_distinct(F.regexp_extract_all(subject, F.lit("([A-Za-z0-9]+)"), F.lit(1))),
                                    F.lit("")).alias("tokens"))
    found = []
    for lo in range(0, len(numbered), INDEX_RULES):
        buckets = _index(numbered[lo:lo + INDEX_RULES], times)
        index = F.from_json(F.lit(json.dumps(buckets)),
                            f"array<array<struct<token: string, rules: array<struct<{_FIELDS.replace(' ', ': ').replace(',:', ',')}>>>>>")

        candidates = F.flatten(F.transform("tokens", _fetch(index, len(buckets))))
        found.append(F.filter(candidates, lambda r: F.regexp_like(F.col("subject"), r["expression"])))
    best = F.array_min(F.concat(*found)) if found else F.lit(None).cast(f"struct<{_FIELDS.replace(' ', ':').replace(',:', ', ')}>")
    hit = own.select(key, "host", "path", best.alias("hit"))
    return hit.select(key, "host", "path", F.when(F.col("hit.rank") < n_host, F.col("hit.name")).alias("rule"),
                      F.when(F.coalesce(F.col("hit.allow"), F.lit(True)), "allow").otherwise("block").alias("verdict"))
