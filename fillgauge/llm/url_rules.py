"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + "#" + path``, matched from the start;
neither part of a URL can hold that sign. Its literal tokens, the runs of ASCII
letters and digits that every match has as whole tokens, are read off the
expression's parse tree. A first pass counts how many URLs hold each literal token
of the rules; each rule is then filed under its rarest one. A URL looks its own
tokens up in that index and runs only the expressions it finds there, so a URL costs
its tokens, not the number of rules. Rules without a literal token are run on every
URL.

Site rules (a host with all its subdomains, and the start of a path) win over
pattern rules; among site rules the longest wins, then the first by name; among
pattern rules the first by name. What no rule fits is allowed.

Nothing is shuffled but the token counts, at most one row per token and task.
The rules are a parameter, so the index a task holds is as large as its caller's
list. Results in special cases: a null URL, or one without ``://``, has an empty
host and path and is allowed; repeated rows and null ids stay; other columns are
not carried.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from re import _constants as codes
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgauge.llm import common

TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@dataclass(frozen=True)
class Part:
    """What is known of a piece of an expression that is not one sign.

    Whether it can match nothing, whether a match can begin and end with a token's
    sign, and the tokens that stand whole within every match.
    """

    empty: bool = True
    begins: bool = True
    ends: bool = True
    tokens: frozenset[str] = frozenset()


#: A place that no token's sign can be next to.
EDGE = Part(False, False, False)


def _class_has_alnum(items: list) -> bool:
    if items[0][0] is codes.NEGATE:
        return True
    for kind, value in items:
        if kind is codes.LITERAL and chr(value) in ALNUM:
            return True
        if kind is codes.RANGE and any(value[0] <= ord(c) <= value[1] for c in ALNUM):
            return True
        if kind is codes.CATEGORY and value is not codes.CATEGORY_SPACE:
            return True
    return False


def _pieces(tree, any_case: bool) -> list[str | Part]:
    """The expression as single signs and parts, in order."""
    out: list[str | Part] = []
    for kind, value in tree:
        if kind is codes.LITERAL:
            # letters in either case also match some that are not ASCII
            out.append(Part(False) if any_case and chr(value).isalpha() else chr(value))
        elif kind in (codes.NOT_LITERAL, codes.ANY):
            out.append(Part(False))
        elif kind is codes.IN:
            has = any_case or _class_has_alnum(value)
            out.append(Part(False, has, has))
        elif kind in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            least, _, inner = value
            whole = _whole(_pieces(inner, any_case))
            out.append(Part(whole.empty or not least, whole.begins, whole.ends, whole.tokens if least else frozenset()))
        elif kind is codes.SUBPATTERN and not value[1] and not value[2]:
            out += _pieces(value[3], any_case)
        elif kind is codes.ATOMIC_GROUP:
            out += _pieces(value, any_case)
        elif kind is codes.BRANCH:
            ways = [_whole(_pieces(w, any_case)) for w in value[1]]
            out.append(Part(any(w.empty for w in ways), any(w.begins for w in ways), any(w.ends for w in ways), frozenset.intersection(*(w.tokens for w in ways))))
        elif kind is codes.AT and value is not codes.AT_NON_BOUNDARY:
            out.append(EDGE)
        elif kind not in (codes.ASSERT, codes.ASSERT_NOT):
            out.append(Part())
    return out


def _closed(pieces: list[str | Part], outer: bool, side: str) -> bool:
    """Whether the first of ``pieces`` that matches anything cannot lengthen a token next to it."""
    for p in pieces:
        if isinstance(p, str):
            return p not in ALNUM
        if getattr(p, side):
            return False
        if not p.empty:
            return True
    return outer


def _tokens(pieces: list[str | Part], from_start: bool) -> frozenset[str]:
    found, at = set(), 0
    while at < len(pieces):
        if isinstance(pieces[at], Part):
            found |= frozenset() if pieces[at].empty else pieces[at].tokens
            at += 1
            continue
        end = at
        while end < len(pieces) and isinstance(pieces[end], str) and pieces[end] in ALNUM:
            end += 1
        if end > at and _closed(pieces[:at][::-1], from_start, "ends") and _closed(pieces[end:], False, "begins"):
            found.add("".join(pieces[at:end]).translate(LOWER))
        at = max(end, at + 1)
    return frozenset(found)


def _whole(pieces: list[str | Part]) -> Part:
    empty = all(isinstance(p, Part) and p.empty for p in pieces)
    return Part(empty, not _closed(pieces, True, "begins"), not _closed(pieces[::-1], True, "ends"), _tokens(pieces, False))


def literals_of(pattern: str) -> frozenset[str]:
    """The tokens of every text that the expression matches from its start."""
    tree = parser.parse(pattern)
    flags = tree.state.flags
    return _tokens(_pieces(tree, bool(flags & re.IGNORECASE) and not flags & re.ASCII), True)


@dataclass(frozen=True)
class Rule:
    """An expression over ``host#path``, and the verdict on URLs that it fits."""

    name: str
    pattern: str
    verdict: str
    site: bool = False

    @cached_property
    def literals(self) -> frozenset[str]:
        return literals_of(self.pattern)


def key_of(host: str, path: str) -> str:
    """What expressions are matched against."""
    return f"{host}#{path}"


def site_rule(name: str, verdict: str) -> Rule:
    """``example.net/en/``: the host and all its subdomains, where the path starts like the rule's."""
    host, slash, path = name.partition("/")
    return Rule(name, r"(?:[^#]*\.)?" + re.escape(host.translate(LOWER)) + "#" + re.escape(slash + path), verdict, True)


def host_words(name: str, verdict: str, *words: str) -> Rule:
    """A pattern rule: the words in this order, joined by hyphens, within one label of the host."""
    return Rule(name, r"(?:[^#]*[.\-])?" + "-".join(map(re.escape, words)) + r"(?:[.\-][^#]*)?#", verdict)


#: Hosts that name what they push.
PATTERNS = (
    host_words("adult", "block", "adult"),
    host_words("ads", "block", "ads", "track"),
    host_words("bets", "block", "free", "bets"),
    host_words("casino", "block", "casino"),
    host_words("pills", "block", "cheap", "pills"),
    host_words("spam", "block", "spam", "farm"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[?#]", rest)
    rest = rest[: end.start()] if end else rest
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def url_tokens(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(host)) | set(TOKEN.findall(path.translate(LOWER)))


def rarest(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """The rules by the least frequent of their literal tokens; under the empty token those without."""
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.literals, key=lambda t: (counts.get(t, 0), t), default="")].append(rule)
    return dict(index)


def _count(batches: Iterator[pa.RecordBatch], literals: frozenset[str]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for url in batch.column("url").to_pylist():
            seen.update(literals & url_tokens(*split_url(url)))
    yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


JUDGED = pa.schema([
    ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
    ("pattern_rule", pa.string()), ("verdict", pa.string()),
])


def _judge(batches: Iterator[pa.RecordBatch], index: dict[str, list[Rule]]) -> Iterator[pa.RecordBatch]:
    compiled = {t: [(r, re.compile(r.pattern)) for r in rules] for t, rules in index.items()}
    always = compiled.pop("", [])
    for batch in batches:
        rows = []
        for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist()):
            host, path = split_url(url)
            key = key_of(host, path)
            candidates = [c for t in url_tokens(host, path) if t in compiled for c in compiled[t]]
            fits = [r for r, pattern in (*always, *candidates) if pattern.match(key)]
            site = min((r for r in fits if r.site), key=lambda r: (-len(r.name), r.name), default=None)
            other = min((r for r in fits if not r.site), key=lambda r: r.name, default=None)
            first = site or other
            rows.append((page, host, path, site and site.name, other and other.name, first.verdict if first else "allow"))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), JUDGED)] if rows else [pa.array([], f.type) for f in JUDGED], schema=JUDGED)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, pattern_rule, verdict`` of every row."""
    common.prepare(pages.sparkSession)
    urls = pages.select(common.column(id_col).cast("long").alias("page_id"), common.column(url_col).alias("url"))
    literals = frozenset().union(*(r.literals for r in rules))
    counted = urls.select("url").mapInArrow(lambda b: _count(b, literals), "token string, n long")
    # at most one row for each token of the rules
    counts = {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    index = rarest(rules, counts)
    return urls.mapInArrow(
        lambda b: _judge(b, index), "page_id long, host string, path string, rule string, pattern_rule string, verdict string"
    )


ORACLE = r"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_replace(coalesce(rest, ''), '[?#](.|\n)*$', '') AS rest FROM split),
parts AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '/(.|\n)*$') AS path FROM cut),
rules(rule, host, path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT r, arg_max(s.rule, length(s.rule)) AS rule, arg_max(s.verdict, length(s.rule)) AS verdict
  FROM parts p JOIN rules s ON (p.host = s.host OR ends_with(p.host, '.' || s.host)) AND starts_with(p.path, s.path)
  GROUP BY r),
patterns(name, words) AS (VALUES
  ('ads', 'ads-track'), ('adult', 'adult'), ('bets', 'free-bets'), ('casino', 'casino'), ('pills', 'cheap-pills'), ('spam', 'spam-farm')),
named AS (
  SELECT r, min(name) AS name FROM parts JOIN patterns ON regexp_matches(host, '(^|[.\-])' || words || '($|[.\-])') GROUP BY r)
SELECT page_id, p.host, p.path, f.rule, n.name AS pattern_rule,
  CASE WHEN f.verdict IS NOT NULL THEN f.verdict WHEN n.name IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN fits f ON f.r = p.r LEFT JOIN named n ON n.r = p.r
"""
