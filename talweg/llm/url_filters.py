"""URL filters: pattern rules indexed by their rarest literal token.

Each rule has a regular expression and the literal tokens that any URL it matches must
contain. The corpus says how many URLs hold each of those tokens; a rule is filed under
its rarest one, and a URL's own tokens fetch the few rules whose expressions are run.
The rule list is given by the caller, as rules or as a table of at most ``MOST_RULES``
rows, so the index is as large as that list.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed; only A-Z are lower-cased, and ``\\b``, ``\\w`` and ``\\d`` in a pattern know
ASCII alone, so a letter beyond it ends a word; a very long URL is judged whole; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"
MOST_RULES = 200_000  # of a table; they are sent to every task
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """name; verdict block or allow; pattern over ``host + path + rest``; weight: of the rules that match, the heaviest decides, then the first."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    is_host: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host, its subdomains, and paths that start with the path."""
    host, _, path = rule.partition("/")
    pattern = rf"\A(?:[^\n/]*\.)?{re.escape(host)}\n/{re.escape(path)}"
    return Rule(rule, verdict, pattern, tuple(re.findall(TOKEN, host)), len(rule), True)


def pattern_rule(verdict: str, name: str, pattern: str, literals: str) -> Rule:
    """A regular expression over the lower-cased URL after ``://``; literals: text whose whole tokens every match contains."""
    return Rule(name, verdict, pattern, tuple(re.findall(TOKEN, literals)), 0, False)


def rules_from(table: DataFrame) -> list[Rule]:
    """Rules of a table (verdict, rule, pattern, literals).

    Without a pattern, rule is a ``host/path``; with one, it names the expression, and
    literals holds text whose whole tokens every match contains (null: none, and the rule
    is run on every URL). Repeated rows are one rule, and rules are in the order of their columns.
    """
    rows = table.select("verdict", "rule", "pattern", "literals").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if bad := [r for r in rows if r.verdict not in ("block", "allow") or r.rule is None]:
        raise ValueError(f"not a rule: {bad[0]}")
    rows.sort(key=lambda r: tuple((x is not None, x or "") for x in r))
    return [host_rule(r.verdict, r.rule) if r.pattern is None else pattern_rule(r.verdict, r.rule, r.pattern, r.literals or "") for r in rows]


# The rules of the contract: fixed values.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# The method's own rules: words of gambling, adult, drug, pirate and link-farm pages. Fixed values.
WORDS = (
    "casino", "poker", "betting", "roulette", "jackpot", "slots", "lottery", "bingo", "porn", "xxx", "escort", "camgirls", "viagra", "cialis", "pills",
    "steroids", "warez", "keygen", "torrent", "nulled", "payday", "spam", "doorway", "linkfarm", "backlinks", "replica",
)
LURES = ("best", "buy", "cheap", "free", "online", "top", "win")
# Pages that are none whatever their words: logins and forms.
TRAPS = (("admin login", r"/wp/login\b", "wp login"), ("admin page", r"/wp-admin/", "wp admin"), ("script call", r"/[a-z]+\.php\?[^#]*\b(?:exec|eval)=", "php"))


def word_rules(words: tuple[str, ...] = WORDS, lures: tuple[str, ...] = LURES) -> list[tuple[str, str, str, str]]:
    """(verdict, name, pattern, literals): each word as a part of a host, as a path's segment, as a query's value, and beside each lure."""
    out = []
    for w in words:
        out += [(f"{w} host", rf"^[^/?#]*\b{w}\b", w), (f"{w} page", rf"/{w}\b", w), (f"{w} query", rf"[?&][a-z]+={w}\b", w)]
        out += [(f"{x} {w}", rf"\b(?:{x}[-_/+]{w}|{w}[-_/+]{x})\b", f"{x} {w}") for x in lures]
    return [("block", *r) for r in (*out, *TRAPS)]


PATTERNS = word_rules()


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS]


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, Rule, re.Pattern]]] = {}
        self.always: list[tuple[int, Rule, re.Pattern]] = []
        for k, r in enumerate(rules):
            entry = (k, r, re.compile(r.pattern, re.ASCII))
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def judge(self, host: str, path: str, rest: str) -> tuple[str | None, str | None, int]:
        """(host rule that decides, verdict or None, regular expressions run)."""
        if not host and not path:
            return None, None, 0
        url, best, run = f"{host}\n{path}", None, 0
        low = f"{host}{path}{rest}".translate(LOWER)
        found = {e[0]: e for t in set(re.findall(TOKEN, low)) for e in self.by_token.get(t, ())}
        for k, rule, pattern in (*found.values(), *self.always):
            run += 1
            if pattern.search(url if rule.is_host else low) and (best is None or (rule.weight, -k) > (best[1].weight, -best[0])):
                best = (k, rule)
        return (None, None, run) if best is None else (best[1].name if best[1].is_host else None, best[1].verdict, run)


_URL = re.compile(r"\A.*?://([^/?#]*)([^?#]*)(.*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str, str]:
    """(host, path, rest) of a URL; empty ones if it has no ``://``."""
    m = _URL.match(url or "")
    return (m[1].translate(LOWER), m[2], m[3]) if m else ("", "", "")


def url_parts(pages: DataFrame) -> DataFrame:
    """pages (.., url) with host, path and rest, as split_url gives them, in the JVM."""
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract("_after", "^[^/?#]*", 0)
    tail = F.substr(F.col("_after"), F.char_length("_host") + 1)
    cut_up = pages.withColumn("_after", after).withColumn("_host", host).withColumn("_tail", tail).withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0))
    low = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return cut_up.withColumn("host", low).withColumn("rest", F.substr(F.col("_tail"), F.char_length("path") + 1)).drop("_after", "_host", "_tail")


def token_frequency(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """URLs that hold each of the rules' tokens; the driver gets a count for each of those."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    low = F.translate(F.col(url).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TOKEN})")))).alias("t"))
    asked = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string"))  # the rules' tokens
    return {r.t: r.n for r in tokens.join(asked, "t").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and n_run (expressions run) of every page."""
    rules = default_rules() if rules is None else rules
    index = pages.sparkSession.sparkContext.broadcast((rules, token_frequency(pages, rules, url)))

    def run(batches):
        made = None
        for b in batches:
            made = made or RuleIndex(*index.value)
            got = [made.judge(*p) for p in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] or otherwise for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], [id_col, "host", "path", "rule", "verdict", "n_run"]
            )

    parts = url_parts(pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url).cast("string").alias("url")))
    return parts.select(id_col, "host", "path", "rest").mapInArrow(run, f"{id_col} long, host string, path string, rule string, verdict string, n_run long")


def _oracle() -> str:
    """DuckDB SQL for judge() with the default rules."""
    fits = []
    for _, rule in HOST_RULES:
        host, _, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    order = sorted(range(len(HOST_RULES)), key=lambda k: -len(HOST_RULES[k][1]))
    verdicts = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in HOST_RULES)
    blocked = " OR ".join(f"regexp_matches(low, '{p}')" for _, _, p, _ in PATTERNS)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS after FROM pages
), h AS (
  SELECT page_id, regexp_extract(after, '^[^/?#]*') AS raw, translate(after, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, after FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(after, length(raw) + 1), '^[^?#]*') AS path, low FROM h
), r AS (
  SELECT *, CASE {" ".join(fits[k] for k in order)} END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


ORACLE = _oracle()
