"""URL filters: pattern rules behind an index of their rarest literal tokens.

Every rule is a regular expression over ``host + path`` together with the literal
tokens (runs of a-z and 0-9) that any matching URL must hold; a pattern rule's tokens are
derived from the parsed expression (``literal_tokens``), so that none can be wrong. A rule
is filed under the one of its tokens that occurs least often in the URLs at hand; the tokens
of a URL fetch its candidate rules, and only those candidates run their regular expression.
A rule without a literal token is filed under no token and runs on every URL.

Host rules such as ``example.net/en/`` decide first: the longest one that fits wins.
Where none fits, pattern rules decide: an allowing pattern beats a blocking one, and a
URL that no pattern matches is allowed.

Defined results: a null URL and a URL without ``://`` have an empty host and path and
fit no host rule; repeated rows give repeated results; an empty table gives an empty
table; columns other than the two that are named are not read.

The rules are configuration: at most ``MAX_RULES`` are accepted, which bounds what is
sent to the executors and the token counts that come back.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import ascii_lower, map_batches

MAX_RULES = 100_000
TOKEN = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


@dataclass(frozen=True)
class Rule:
    """One rule. ``tokens`` are literals that every match holds; ``rank`` orders rules that match together."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = ()
    host_rule: bool = False
    rank: tuple = field(default=())


def host_rule(rule: str, action: str) -> Rule:
    """``host/path``: fits the host and all its subdomains where the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    # a path's last token may go on in the URL, so only tokens that end inside the rule are literal
    inner = [m.group() for m in TOKEN.finditer(f"{host}{slash}{path}") if m.end() < len(rule)]
    return Rule(rule, action, pattern, tuple(dict.fromkeys(inner)), True, (len(rule), rule))


def _shape(parsed) -> list[str | None]:
    """What an expression matches one after another: a character, "" for an edge (no letter or digit), None for anything else."""
    out: list[str | None] = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            c = chr(value).lower()
            out.append(c if TOKEN.fullmatch(c) else "" if chr(value).isascii() else None)
        elif name == "AT":
            out.append("" if str(value) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING") else None)
        elif name == "IN" and all(str(k) == "LITERAL" and chr(v).isascii() and not chr(v).isalnum() for k, v in value):
            out.append("")
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            out += _shape(value[3])
        elif name == "BRANCH" and all(_shape(x) and set(_shape(x)) == {""} for x in value[1]):
            out.append("")
        elif name == "MAX_REPEAT" and value[0] > 0 and set(_shape(value[2])) == {""}:
            out.append("")
        elif name == "MAX_REPEAT" and out[-1:] == [""] and _shape(value[2])[-1:] == [""]:
            out.append("")  # left out or not, an edge comes last
        else:
            out.append(None)
    return out


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The tokens that every URL matched by ``pattern`` holds whole: literal runs with an edge on both sides."""
    from re import _parser

    found, run, open_ = [], "", False
    for c in [*_shape(_parser.parse(pattern)), None]:
        if c:
            run += c
            continue
        if run and open_ and c == "":
            found.append(run)
        run, open_ = "", c == ""
    return tuple(dict.fromkeys(found))


def pattern_rule(name: str, action: str, pattern: str) -> Rule:
    return Rule(name, action, pattern, literal_tokens(pattern), False, (action == "allow", name))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return ascii_lower(host.group()), _PATH.match(url, host.end()).group()


def url_tokens(host: str, path: str) -> set[str]:
    """The tokens that fetch candidates: of the host and of the path, letter case ignored."""
    return set(TOKEN.findall(f"{host}{path}".casefold()))


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            filed = (rule, re.compile(rule.pattern))
            if rule.tokens:
                self.by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(filed)
            else:
                self.always.append(filed)

    def matches(self, host: str, path: str) -> list[Rule]:
        """The rules whose regular expression matches, among those that the URL's tokens fetch."""
        if not host and not path:
            return []
        target, found = host + path, []
        for token in url_tokens(host, path):
            found += [r for r, p in self.by_token.get(token, ()) if (p.match if r.host_rule else p.search)(target)]
        return found + [r for r, p in self.always if (p.match if r.host_rule else p.search)(target)]

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """The winning host rule or None, the verdict, and the pattern that gave it or None."""
        matched = self.matches(host, path)
        hosts = [r for r in matched if r.host_rule]
        if hosts:
            best = max(hosts, key=lambda r: r.rank)
            return best.name, best.action, None
        if matched:
            best = max(matched, key=lambda r: r.rank)
            return None, best.action, best.name
        return None, "allow", None


def token_counts(urls: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs; the result is bounded by the rules."""
    wanted = frozenset(tokens)

    def rows(batches: Iterator[dict]):
        for b in batches:
            n = Counter(t for u in b["url"].to_pylist() if u for t in url_tokens(*split_url(u)) & wanted)
            yield {"token": list(n), "n": list(n.values())}

    out = map_batches(urls.select(F.col(url_col).cast("string").alias("url")), rows, "token string, n long")
    return {r["token"]: r["n"] for r in out.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def filter_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: id, host, path, rule (a host rule or null), verdict, pattern (a pattern rule or null)."""
    index = RuleIndex(rules, token_counts(df, url_col, {t for r in rules for t in r.tokens}))

    def rows(batches: Iterator[dict]):
        for b in batches:
            places = [split_url(u) for u in b["url"].to_pylist()]
            judged = [index.judge(*p) for p in places]
            yield {id_col: b[id_col], "host": [p[0] for p in places], "path": [p[1] for p in places], "rule": [j[0] for j in judged], "verdict": [j[1] for j in judged], "pattern": [j[2] for j in judged]}

    kept = df.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("url"))
    return map_batches(kept, rows, f"{id_col} long, host string, path string, rule string, verdict string, pattern string")


#: The host rules of the pages query.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Example pattern rules (name, action, regular expression over host + path), invented for the pages query.
PATTERN_RULES = [
    ("spam farm", "block", r"(?:^|[.\-])spam-farm(?:[.\-]|$)"),
    ("cheap pills", "block", r"(?:^|[.\-])cheap-pills(?:[.\-]|$)"),
    ("casino host", "block", r"^(?:[^/]*[.\-])?casino[.\-]"),
    ("adult host", "block", r"^(?:[^/]*[.\-])?(?:xxx)[.\-]"),
    ("archive file", "block", r"/[^/]*\.(?:exe)$"),
    ("robots file", "allow", r"/robots\.txt$"),
]


def default_rules() -> list[Rule]:
    return [host_rule(r, a) for r, a in HOST_RULES] + [pattern_rule(*p) for p in PATTERN_RULES]
