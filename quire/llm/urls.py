"""URL filtering by pattern rules indexed under their rarest literal token.

A rule is a regular expression over the lower-cased ``host + path``. The literal
tokens (maximal ``[a-z0-9]`` runs) that every URL it matches must have as whole
tokens are derived from the expression itself (``required_tokens``). Token
frequencies are counted over all URLs; each rule is filed under its rarest
token, and a URL runs only the expressions filed under tokens it holds. Rules
without a certain token are kept apart and run on every URL.

Host rules (``HostRule``) fit a host and its subdomains when the path starts
with the rule's path; they use the same index, under the rarest label of their
host. The longest fitting host rule decides; otherwise the pattern rules do: a
URL is blocked when one of them matches.

Rules up to ``MAX_RULE_BYTES`` are sent with the tasks (``RuleIndex``). A longer
list is a table: each URL's tokens are joined with the rules' tokens, so only
the rules a URL fetches reach it, and the verdicts are the same.

Defined cases: a null URL or one without ``://`` has empty host and path and is
allowed; an empty table gives an empty result; repeated rows are judged alike;
ids are returned as they are; the page text is never read.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.session import cut_lineage

MAX_RULE_BYTES = 8 << 20
TOKEN = re.compile(r"[a-z0-9]+")
TOKEN_CODES = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> tuple[str, ...]:
        return tuple(TOKEN.findall(self.host))


@dataclass(frozen=True)
class PatternRule:
    name: str
    regex: str

    @property
    def tokens(self) -> tuple[str, ...]:
        """Whole tokens present in every URL that ``regex`` matches."""
        return required_tokens(self.regex)


#: The host rules of the production list.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

#: Production pattern rules: gambling, adult, pharmacy and advertising pages.
PATTERN_RULES = (
    PatternRule("casino-label", r"(^|[.-])casino[.-]"),
    PatternRule("poker-label", r"(^|[.-])poker[.-]"),
    PatternRule("bet-win", r"(^|[.-])bet-win[.-]"),
    PatternRule("xxx-label", r"(^|[.-])xxx[.-]"),
    PatternRule("porn-label", r"(^|[.-])porn[.-]"),
    PatternRule("adult-cam", r"(^|[.-])adult-cams?[.-]"),
    PatternRule("pills", r"(^|[.-])(cheap|buy)-pills[.-]"),
    PatternRule("ads-host", r"^ads[.]"),
    PatternRule("tracker-path", r"^[^/]*/(.*/)?track/click(/|$)"),
)


@dataclass(frozen=True)
class _Edges:
    """What a piece of an expression matches at its ends.

    ``opens``, ``closes``: whatever it matches, if not empty, begins or ends with
    a character outside tokens (or stands at the text's end). ``empty``: it may
    match nothing. ``token``: the literal character, if it is one of a token.
    """

    opens: bool = False
    closes: bool = False
    empty: bool = False
    token: str = ""


def _in_class(members: list) -> bool:
    """Can a character class match a character of a token? Unsure counts as yes."""
    if members[0][0] is op.NEGATE:
        held: set[int] = set()
        for kind, value in members[1:]:
            held |= {value} if kind is op.LITERAL else set(range(value[0], value[1] + 1)) if kind is op.RANGE else set()
        return not held >= TOKEN_CODES
    for kind, value in members:
        if kind is op.LITERAL:
            if value in TOKEN_CODES:
                return True
        elif kind is op.RANGE:
            if any(value[0] <= c <= value[1] for c in TOKEN_CODES):
                return True
        elif (kind, value) != (op.CATEGORY, op.CATEGORY_SPACE):
            return True
    return False


def _joined(parts: list[_Edges]) -> _Edges:
    """A sequence as one piece."""
    empty = all(p.empty for p in parts)

    def certain(order: list[_Edges], side: str) -> bool:
        for p in order:
            if not getattr(p, side):
                return False
            if not p.empty:
                return True
        return True

    return _Edges(certain(parts, "opens"), certain(parts[::-1], "closes"), empty)


def _pieces(items: parser.SubPattern) -> list[_Edges]:
    """The pieces of a sequence; groups that are always there are laid open."""
    out: list[_Edges] = []
    for kind, value in items:
        if kind is op.LITERAL:
            code = value in TOKEN_CODES
            out.append(_Edges(not code, not code, False, chr(value) if code else ""))
        elif kind is op.IN:
            outside = not _in_class(value)
            out.append(_Edges(outside, outside))
        elif kind is op.AT and value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END_STRING):
            out.append(_Edges(True, True))
        elif kind is op.AT and value is op.AT_END:
            out.append(_Edges(True, True))  # a newline may follow, which is outside tokens as well
        elif kind is op.SUBPATTERN and not value[1] and not value[2]:
            out += _pieces(value[3])
        elif kind is op.BRANCH:
            ways = [_joined(_pieces(way)) for way in value[1]]
            out.append(_Edges(all(w.opens for w in ways), all(w.closes for w in ways), any(w.empty for w in ways)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            once = _joined(_pieces(value[2]))
            out.append(_Edges(once.opens, once.closes, once.empty or value[0] == 0))
        elif kind is op.NOT_LITERAL or kind is op.ANY:
            out.append(_Edges())
        else:
            out.append(_Edges(empty=True))  # look-arounds, back references and the like: nothing is certain
    return out


@functools.cache
def required_tokens(regex: str) -> tuple[str, ...]:
    """The whole tokens that every text matched by ``regex`` must have.

    A run of literal token characters counts when what stands before and after
    it surely ends it: characters outside tokens or an end of the text. What is
    unsure is left out, so a rule is never filed under a token it can do without.
    """
    parsed = parser.parse(regex)
    if parsed.state.flags & (re.IGNORECASE | re.MULTILINE | re.LOCALE):
        return ()
    pieces, found, at = _pieces(parsed), [], 0

    def ends(order: list[_Edges], side: str) -> bool:
        for p in order:
            if not getattr(p, side):
                return False
            if not p.empty:
                return True
        return False  # the expression begins or stops in the middle of a text

    while at < len(pieces):
        stop = at
        while stop < len(pieces) and pieces[stop].token:
            stop += 1
        if stop > at and ends(pieces[:at][::-1], "closes") and ends(pieces[stop:], "opens"):
            found.append("".join(p.token for p in pieces[at:stop]))
        at = max(stop, at + 1)
    return tuple(dict.fromkeys(found))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; only A-Z of the host are lower-cased."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    stop = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return ascii_lower(host), path


def ascii_lower(s: str) -> str:
    """Lower-cases A-Z only."""
    return s.lower() if s.isascii() else s.encode("utf-8").lower().decode("utf-8")


def tokens_of(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(host + ascii_lower(path)))


def rarest(tokens: tuple[str, ...], frequency: dict[str, int]) -> str | None:
    return min(tokens, key=lambda t: (frequency.get(t, 0), t), default=None)


def longest_fit(rules: Iterator[HostRule], host: str, path: str) -> HostRule | None:
    """The longest rule that fits a host and path."""
    fits = (r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
    return max(fits, key=lambda r: (len(r.name), r.name), default=None)


class RuleIndex:
    """Rules filed under one token each."""

    def __init__(self, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...], frequency: dict[str, int]):
        self.hosts: dict[str | None, list[HostRule]] = defaultdict(list)
        self.patterns: dict[str | None, list[tuple[str, re.Pattern]]] = defaultdict(list)
        for rule in hosts:
            self.hosts[rarest(rule.tokens, frequency)].append(rule)
        for rule in patterns:
            self.patterns[rarest(rule.tokens, frequency)].append((rule.name, re.compile(rule.regex)))

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None]:
        """(host rule, verdict, pattern rule)."""
        tokens = {None, *tokens_of(host, path)}
        best = longest_fit((r for token in tokens & self.hosts.keys() for r in self.hosts[token]), host, path)
        if best:
            return best.name, best.verdict, None
        text = host + ascii_lower(path)
        hits = [name for token in tokens & self.patterns.keys() for name, regex in self.patterns[token] if regex.search(text)]
        return None, "block" if hits else "allow", min(hits, default=None)


def url_tokens(pages: DataFrame, *kept: str) -> DataFrame:
    """token of every page, each once a page, beside the columns ``kept``; only A-Z are lower-cased."""
    lower = F.translate("url", ascii_uppercase, ascii_lowercase)
    return pages.select(*kept, F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))


def token_frequency(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``; at most one row per token is gathered."""
    wanted = pages.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    return {r[0]: r[1] for r in url_tokens(pages).join(F.broadcast(wanted), "token").groupBy("token").count().collect()}


RESULT = "host string, path string, rule string, verdict string, pattern string"


def _answers(told: list[tuple]) -> list[pa.Array]:
    return [pa.array(column, pa.string()) for column in (zip(*told, strict=True) if told else [[]] * 5)]


def filter_urls(pages: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES, most: int = MAX_RULE_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every page."""
    size = sum(len(r.name) + len(r.verdict) for r in hosts) + sum(len(r.regex) + len(r.name) for r in patterns)
    if size > most:
        return filter_by_table(pages, hosts, patterns)
    urls = pages.select("page_id", "url")
    tokens = {t for r in (*hosts, *patterns) for t in r.tokens}
    frequency = token_frequency(urls, tokens) if tokens else {}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(hosts, patterns, frequency)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            told = [(*p, *index.judge(*p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *_answers(told)], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    id_type = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(judge, f"page_id {id_type}, {RESULT}")


def _blocks(rules: list) -> Iterator[list]:
    """Runs of rules of at most ``MAX_RULE_BYTES``."""
    block, size = [], 0
    for rule in rules:
        own = len(rule.name) + len(getattr(rule, "regex", ""))
        if block and size + own > MAX_RULE_BYTES:
            yield block
            block, size = [], 0
        block.append(rule)
        size += own
    if block:
        yield block


def _running(rules: list):
    """Runs every rule of a block on every URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(tuple(r for r in rules if isinstance(r, HostRule)), tuple(r for r in rules if isinstance(r, PatternRule)), {})
        for batch in batches:
            hits = []
            for rid, url in zip(batch.column("rid").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                best = longest_fit(iter(index.hosts[None]), host, path)
                if best:
                    hits.append((rid, "host", best.verdict, best.name))
                text = host + ascii_lower(path)
                hits += [(rid, "pattern", "block", name) for name, regex in index.patterns[None] if regex.search(text)]
            columns = list(zip(*hits, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=["rid", "kind", "means", "name"])

    return run


def filter_by_table(pages: DataFrame, hosts: tuple[HostRule, ...], patterns: tuple[PatternRule, ...]) -> DataFrame:
    """``filter_urls`` with the rules as a table joined on their rarest token.

    Each row's distinct tokens are joined with the tokens under which rules are
    filed; a row and one rule it fetches are judged together, and a row's
    findings are reduced by maximum and minimum. A token that very many URLs hold
    has rules only if they name no rarer one; adaptive execution splits it.
    Rules without a token must run on every row and are sent in blocks of at
    most ``MAX_RULE_BYTES``.
    """
    free = [r for r in patterns if not r.tokens]
    hosts_free = [r for r in hosts if not r.tokens]
    patterns, hosts = tuple(r for r in patterns if r.tokens), tuple(r for r in hosts if r.tokens)
    spark = pages.sparkSession
    rows = cut_lineage(pages.select("page_id", "url").withColumn("rid", F.monotonically_increasing_id()))
    every = [("host", r.verdict, r.host, r.path, r.name, list(r.tokens)) for r in hosts] + [("pattern", "block", r.regex, "", r.name, list(r.tokens)) for r in patterns]
    # the list is the caller's own; only its rows with tokens become a table
    rules = spark.createDataFrame(every, "kind string, means string, body string, prefix string, name string, tokens array<string>").withColumn("rule_id", F.monotonically_increasing_id())
    counted = url_tokens(rows).groupBy("token").agg(F.count("*").alias("n"))
    filed = (
        rules.select("rule_id", F.explode_outer("tokens").alias("token"))
        .join(counted, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.when(F.col("token").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("least"))
    )
    index = cut_lineage(rules.drop("tokens").join(filed, "rule_id").select("kind", "means", "body", "prefix", "name", F.col("least.token").alias("token")))
    # tokens travel with the row's number alone; only rows that fetch a rule bring their URL
    met = url_tokens(rows, "rid").join(index, "token").select("rid", "kind", "means", "body", "prefix", "name")
    fetched = met.join(rows.select("rid", "url"), "rid")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = functools.lru_cache(maxsize=4096)(re.compile)
        for batch in batches:
            keep = []
            for url, kind, means, body, prefix in zip(*[batch.column(c).to_pylist() for c in ("url", "kind", "means", "body", "prefix")], strict=True):
                host, path = split_url(url)
                if kind == "host":
                    keep.append(longest_fit(iter([HostRule(means, body, prefix)]), host, path) is not None)
                else:
                    keep.append(compiled(body).search(host + ascii_lower(path)) is not None)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["rid", "kind", "means", "name"])

    found = "rid long, kind string, means string, name string"
    hits = fetched.mapInArrow(fits, found)
    for block in _blocks([*hosts_free, *free]):
        hits = hits.union(rows.select("rid", "url").mapInArrow(_running(block), found))
    best = hits.groupBy("rid").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("name").alias("size"), "name", "means"))).alias("host_rule"),
        F.min(F.when(F.col("kind") == "pattern", F.col("name"))).alias("pattern"),
    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = list(zip(*[split_url(u) for u in batch.column("url").to_pylist()], strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("rid"), *[pa.array(t, pa.string()) for t in told]], names=["page_id", "rid", "host", "path"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    named = rows.mapInArrow(parts, f"page_id {id_type}, rid long, host string, path string").join(best, "rid", "left")
    by_host = F.col("host_rule").isNotNull()
    return named.select(
        "page_id", "host", "path", F.col("host_rule.name").alias("rule"),
        F.when(by_host, F.col("host_rule.means")).when(F.col("pattern").isNotNull(), "block").otherwise("allow").alias("verdict"),
        F.when(~by_host, F.col("pattern")).alias("pattern"),
    )
