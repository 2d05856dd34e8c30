"""URL filters: many pattern rules, few of them run on any one URL.

Each rule is a regular expression. Its parse tree says which literals are whole tokens
(runs of a-z and 0-9) of every URL that it matches; alternatives are spelled out, and
whatever isn't known to end a token doesn't. A rule is filed, for each alternative, under
the rarest of its tokens, by the tokens' frequency over the URLs at hand. A URL's
tokens fetch the candidate rules, and only those expressions run. Rules of which some
alternative has no token run on every URL, so they should be few.

The rules are a parameter; they go to the tasks as one dictionary, in which a URL looks
up its own tokens, however many rules there are.

Defined cases: a null URL, or one without ``://``, has an empty host and path; it
has no rule and is allowed unless a pattern matches the text itself. Repeated
rows are judged one by one, null ids included. An empty table gives an empty result.
Columns named host, path, rule, pattern or verdict are replaced, all others kept.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host and path rules: the longest that fits decides.
HOST_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The pattern rules used where no host rule fits: advertising, tracking, sessions, and endless lists.
PATTERNS = (
    r"[/.?&_-]ads?[/.?&=_-]",
    r"[/.?&_-]banners?[/.?&=_-]",
    r"[/.?&_-]track(er|ing)?[/.?&=_-]",
    r"[?&](sessionid|phpsessid|jsessionid)=",
    r"[?&]utm_[a-z]+=",
    r"/(login|signin|register)([/?#]|$)",
    r"/(cart|checkout)([/?#]|$)",
    r"[?&]ref=[a-z]",
    r"[?&]page=[0-9]+",
    r"/wp-admin/",
    r"[?&]replytocom=",
    r"/(calendar|archive)/[0-9]{4}/",
)
_TOKEN = re.compile(r"[a-z0-9]+")
_TOKEN_CHARS = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"))
#: Alternatives that are spelled out; what has more of them says nothing about tokens.
ALTERNATIVES = 64
#: Characters of the rules' tokens up to which they are sent to every task.
BROADCAST_BYTES = 4 << 20
#: Items of a spelled-out alternative beside literal characters: some characters of which none
#: is of a token, the border of a token or of the text, and anything or nothing.
BREAK, EDGE, ANY = "break", "edge", "any"


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    #: For each alternative the tokens that a URL which it matches has.
    needs: tuple[tuple[str, ...], ...]


def _in_class(items: list, c: int, fold: bool) -> bool:
    """Whether a character is in a class; what isn't understood has every character."""
    forms = {c, ord(chr(c).upper())} if fold else {c}
    inside = negated = False
    for op, value in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            inside |= value in forms
        elif op is sre.RANGE:
            inside |= any(value[0] <= x <= value[1] for x in forms)
        elif value in (sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD):
            pass
        elif value is sre.CATEGORY_DIGIT:
            inside |= chr(c).isdigit()
        elif value is sre.CATEGORY_WORD:
            inside = True
        else:
            return True
    return inside != negated


def _spelled(tree, fold: bool) -> list[tuple]:
    """The alternatives of a parse tree as sequences of characters and the three items."""
    parts: list[list[tuple]] = []
    for op, value in tree:
        if op is sre.LITERAL:
            char = chr(value).lower() if fold else chr(value)
            parts.append([(char,) if ord(char[0]) in _TOKEN_CHARS and len(char) == 1 else (BREAK,)])
        elif op is sre.IN:
            parts.append([(ANY,) if any(_in_class(value, c, fold) for c in _TOKEN_CHARS) else (BREAK,)])
        elif op is sre.AT:
            parts.append([()] if value is sre.AT_NON_BOUNDARY else [(EDGE,)])
        elif op in (sre.ASSERT, sre.ASSERT_NOT):
            parts.append([()])
        elif op is sre.SUBPATTERN:
            _, add, remove, inner = value
            parts.append(_spelled(inner, (fold or bool(add & re.IGNORECASE)) and not remove & re.IGNORECASE))
        elif op is sre.ATOMIC_GROUP:
            parts.append(_spelled(value, fold))
        elif op is sre.BRANCH:
            parts.append([x for branch in value[1] for x in _spelled(branch, fold)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _spelled(inner, fold)
            breaks = all(x and set(x) == {BREAK} for x in one)
            if breaks:
                parts.append([(BREAK,)] if least else [(), (BREAK,)])
            elif least == most == 1:
                parts.append(one)
            elif (least, most) == (0, 1):
                parts.append([(), *one])
            else:  # the first and the last of several, and anything between them
                parts.append([x + (ANY,) + y for x in one for y in one] if least > 1 else [(ANY,)])
        else:
            parts.append([(ANY,)])
        if len(parts[-1]) > ALTERNATIVES:
            parts[-1] = [(ANY,)]
    out: list[tuple] = [()]
    for part in parts:
        out = [a + b for a, b in product(out, part if len(out) * len(part) <= ALTERNATIVES else [(ANY,)])]
    return out


def _whole_tokens(sequence: tuple) -> tuple[str, ...]:
    """Runs of literal characters between breaks and edges."""
    found, run, opened = [], "", False
    for item in (*sequence, ANY):
        if len(item) == 1:
            run += item
            continue
        if run and opened and item != ANY:
            found.append(run)
        run, opened = "", item != ANY
    return tuple(dict.fromkeys(found))


def required_tokens(pattern: str) -> PatternRule:
    """The tokens that a URL needs for each alternative of ``pattern``; none at all where
    some alternative needs none."""
    tree = sre_parser.parse(pattern)
    needs = [_whole_tokens(x) for x in _spelled(tree, bool(tree.state.flags & re.IGNORECASE))]
    return PatternRule(pattern, tuple(dict.fromkeys(needs)) if all(needs) else ())


def host_of(url: str = "url") -> Column:
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1)


def host_rule(rules=HOST_RULES) -> Column:
    """The longest rule that fits host and path, as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: str = "url") -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(F.col(url), F.lit(""))), "[^a-z0-9]+"))


def rule_index(urls: DataFrame, patterns=PATTERNS, url: str = "url") -> tuple[dict[str, list[str]], list[str]]:
    """Token to patterns, each filed under the rarest token of each of its alternatives; and
    the patterns without one. Token frequencies are counted over all URLs, for the
    rules' own tokens only, so the result is as small as the rule list."""
    rules = [required_tokens(p) for p in patterns]
    wanted = sorted({t for r in rules for need in r.needs for t in need})
    counts: dict[str, int] = {}
    if wanted:
        table = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        table = F.broadcast(table) if sum(map(len, wanted)) < BROADCAST_BYTES else table
        counts = {r[0]: r[1] for r in urls.select(F.explode(url_tokens(url)).alias("t")).groupBy("t").count().join(table, "t").collect()}
    index: dict[str, list[str]] = {}
    rest = []
    for r in rules:
        if not r.needs:
            rest.append(r.pattern)
        for t in sorted({min(need, key=lambda t: (counts.get(t, 0), t)) for need in r.needs}):
            index.setdefault(t, []).append(r.pattern)
    return index, rest


def matched_pattern(index: dict[str, list[str]], rest: list[str], url: Column) -> Column:
    """The first pattern, in text order, that matches the lower-cased URL, or null."""
    distinct = {p for ps in [*index.values(), rest] for p in ps}

    @F.arrow_udf("string")
    def match(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = {p: re.compile(p) for p in distinct}
        for batch in urls:
            out = []
            for u in batch.to_pylist():
                found = None
                if u is not None:
                    text = u.lower()
                    candidates = {p for t in set(_TOKEN.findall(text)) if t in index for p in index[t]}.union(rest)
                    found = min((p for p in candidates if run[p].search(text)), default=None)
                out.append(found)
            yield pa.array(out, pa.string())

    return match(url)


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS, url: str = "url") -> DataFrame:
    """Adds host, path, pattern (or null), rule (host rule or null) and verdict, in place of any
    columns of these names; others may have any name. Rows stay where they are: no shuffle beside the small
    count of rule tokens."""
    index, rest = rule_index(pages, patterns, url)
    made = ("host", "path", "pattern", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made]
    d = pages.select(F.struct(*(pages[c] for c in kept)).alias("page") if kept else F.lit(None).alias("page"), F.coalesce(pages[url], F.lit("")).alias("url"))
    d = d.withColumns({"host": host_of("url"), "path": path_of("url")}).withColumn("fit", host_rule(host_rules))
    d = d.withColumn("pattern", matched_pattern(index, rest, F.when(F.col("fit").isNull(), F.col("url"))))
    method = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    d = d.withColumns({"rule": F.col("fit.rule"), "verdict": F.coalesce(F.col("fit.verdict"), method)})
    return d.select(*(F.col("page")[c].alias(c) for c in kept), *made)
