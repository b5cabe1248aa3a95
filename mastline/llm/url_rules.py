"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A host rule names a host and the start of a path; it fits the host and all below it, and of
those that fit the longest decides. Where none fits, pattern rules decide:

    text      occurs in the URL; ``*`` stands for anything
    ^         one character that is no letter, digit, ``_``, ``-``, ``.`` or ``%``, or the end
    |         at the start or end of a pattern: the start or end of the URL
    ||        at the start: the start of the host or of a part of it
    @@        before a pattern: allow, and stronger than any block

A token is a run of two or more letters, digits or ``%``. A token of a pattern must be a
token of every URL that it matches, unless it touches ``*`` or an open end. Each rule is
filed under that of its tokens which is rarest in the URLs; a URL's tokens fetch the rules
filed under them, and only these run their regular expression. Rules without such a token
are tried on every URL.
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000  # pattern rules held by a task; more are refused
_TOKEN = "[0-9A-Za-z%]{2,}"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the registered query applies.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
PATTERNS = (
    "||casino-win.", "||cheap-pills.", "||spam-farm.", "||ads-track.", "utm_source=feed^",
    "/banner/*/ads^", "^tracker.js|", "|ftp://", "*popunder*", "@@||spam-farm.example.org/about^",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; or empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _ALPHABET.upper(), _ALPHABET), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; or empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Iterable[HostRule] = HOST_RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls; of equal ones the first."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    text = verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Pattern:
    """A parsed pattern rule."""

    text: str
    allow: bool
    regex: str
    tokens: frozenset[str]

    @classmethod
    def parse(cls, text: str) -> "Pattern":
        body = text.removeprefix("@@")
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        inner = body[len(start) :]
        end = "|" if inner.endswith("|") else ""
        inner = inner[: len(inner) - len(end)]
        parts = {"*": ".*", "^": r"(?:[^0-9A-Za-z_\-.%]|$)"}
        regex = "".join(parts.get(c) or re.escape(c) for c in inner)
        head = {"": "", "|": "^", "||": r"^[^:/?#]*://(?:[^/?#]*\.)?"}[start]
        found = set()
        for m in re.finditer(_TOKEN, inner):
            before = inner[m.start() - 1] if m.start() else start and "|"
            after = inner[m.end()] if m.end() < len(inner) else end
            if before and after and "*" not in before + after:
                found.add(m[0].lower())
        return cls(text, text.startswith("@@"), head + regex + ("$" if end else ""), frozenset(found))


class PatternIndex:
    """Patterns filed under their rarest token. ``seen``: how often URLs have each token."""

    def __init__(self, patterns: Iterable[Pattern], seen: dict[str, int]):
        self.filed: dict[str, list[tuple[bool, re.Pattern, str]]] = {}
        for p in patterns:
            token = min(p.tokens, key=lambda t: (seen.get(t, 0), t), default="")
            entry = (p.allow, re.compile(p.regex, re.IGNORECASE | re.DOTALL | re.ASCII), p.text)
            self.filed.setdefault(token, []).append(entry)

    def candidates(self, url: str) -> list[tuple[bool, re.Pattern, str]]:
        tokens = {t.lower() for t in re.findall(_TOKEN, url)}
        return [e for t in ("", *sorted(tokens)) for e in self.filed.get(t, ())]

    def verdict(self, url: str | None) -> tuple[str, str | None]:
        """The verdict and its pattern: the first by name of those allowing, else blocking."""
        fitting = [(not a, t) for a, r, t in self.candidates(url or "") if r.search(url or "")]
        blocked, text = min(fitting, default=(False, None))
        return ("block" if blocked else "allow"), text


def token_counts(urls: DataFrame, tokens: Iterable[str], url_column: str = "url") -> dict[str, int]:
    """How many times the URLs have each of ``tokens``; one row a token comes back."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    found = urls.select(
        F.explode(F.regexp_extract_all(F.col(url_column), F.lit(_TOKEN), F.lit(0))).alias("token")
    ).select(F.translate("token", _ALPHABET.upper(), _ALPHABET).alias("token"))
    # the rules' tokens, MAX_RULES times a few
    rows = found.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def _searched(shared):
    def search(batches):
        index = shared.value
        for batch in batches:
            rules, verdicts, patterns = batch.column("rule").to_pylist(), [], []
            for url, rule, ruled in zip(
                batch.column("url").to_pylist(), rules, batch.column("verdict").to_pylist(), strict=True
            ):
                verdict, pattern = (ruled, None) if rule else index.verdict(url)
                verdicts.append(verdict)
                patterns.append(pattern)
            kept = [batch.column(c) for c in ("row", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(verdicts, pa.string()), pa.array(patterns, pa.string())],
                names=["row", "host", "path", "rule", "verdict", "pattern"],
            )

    return search


def judged(
    pages: DataFrame,
    host_rules: Iterable[HostRule] = HOST_RULES,
    patterns: Iterable[str] = PATTERNS,
    url_column: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and pattern of every URL.

    ``rule``: the host rule that decides, else null; ``pattern``: the pattern that decides,
    else null; with neither the verdict is allow. A null URL has an empty host and path, as
    one without ``://``, and matches patterns as an empty text does. Every row is kept;
    columns of ``pages`` with one of the new names are replaced.
    """
    parsed = [Pattern.parse(p) for p in patterns]
    if len(parsed) > MAX_RULES:
        raise ValueError(f"{len(parsed)} patterns; {MAX_RULES} at most")
    seen = token_counts(pages, (t for p in parsed for t in p.tokens), url_column)
    shared = pages.sparkSession.sparkContext.broadcast(PatternIndex(parsed, seen))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    urls = pages.select(F.struct(*(pages[c] for c in kept)).alias("row"), pages[url_column].alias("url"))
    split = urls.select("row", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("verdict"))
    schema = ruled.select("row", "host", "path", "rule", "verdict", F.col("rule").alias("pattern")).schema
    found = ruled.mapInArrow(_searched(shared), schema)
    return found.select("row.*", "host", "path", "rule", "verdict", "pattern")
