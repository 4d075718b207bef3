"""URL filters: host, path and pattern rules, looked up by their rarest literal token.

Every rule has literal tokens (runs of letters and digits that a URL it fits must hold as tokens of its own). Each
rule is filed under the one of them that the fewest URLs of the table hold, or under each of its alternatives where a
URL must hold just one of several; a URL fetches the rules filed under its tokens, and only those are tried. Trying a rule costs a comparison for host and path rules and a regular expression
for pattern rules. URLs don't move; the only shuffle counts how many URLs hold each of the rules' tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.shared import bound_batches, fresh

#: Rules sent to the executors at once; more are applied in turns of this size.
TURN = 100_000
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class SiteRule:
    """Fits host and its subdomains where the URL's path starts with path; the longest name (host + path) wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        # the path's last token may go on in the URL
        inner = _TOKEN.findall(self.path.lower() if self.path.endswith("/") else self.path.lower().rpartition("/")[0] + "/")
        return _TOKEN.findall(self.host) + inner


@dataclass(frozen=True)
class PatternRule:
    """Fits where the regular expression is found in the lower-cased URL; literals are tokens that any such URL holds.

    Any such URL holds one of either, too, where that isn't empty. Without both the rule is tried on every URL.
    """

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    either: tuple[str, ...] = ()

    @property
    def tokens(self) -> list[str]:
        return list(self.literals)


#: The method's own rules for URLs that no site rule fits: list, tracking and script pages. The first by name wins.
PATTERN_RULES = [
    PatternRule("ads", r"[/.]ads?[/.]", (), "block", ("ad", "ads")),
    PatternRule("login", r"/login(/|\?|$)", ("login",), "block"),
    PatternRule("page-number", r"[?&]page=[0-9]+", ("page",), "block"),
    PatternRule("search", r"/search[/?]", ("search",), "block"),
    PatternRule("session", r"[?&](sid|session|phpsessid)=", (), "block", ("sid", "session", "phpsessid")),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; as many rows as the rules have tokens come to the driver."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    held = urls.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    wanted = F.broadcast(wanted) if len(tokens) <= TURN else wanted
    return {r.token: r.n for r in held.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def index(rules: list, counts: dict[str, int]) -> dict[str, list]:
    """The rules by their rarest token, the first in alphabetical order of those as rare; '' holds those without.

    A rule without tokens but with alternatives is held by each of them.
    """
    out: dict[str, list] = {}
    for r in rules:
        either = () if r.tokens else getattr(r, "either", ())
        for t in either or [min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")]:
            out.setdefault(t, []).append(r)
    return out


def judge_urls(spark: SparkSession, pages: DataFrame, sites: list[SiteRule], patterns: list[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the winning site rule's name, else null), pattern (the winning pattern rule's name
    where no site rule fits, else null) and verdict (the rule's, else the pattern's, else default).

    pages(url, ...): a null url or one without :// has an empty host and path and fits no site rule; pattern rules see
    the whole lower-cased url. Rows are kept as they are, repeated ones too; columns with the new names are replaced, any
    other name stays. A pattern rule's literals must follow from its pattern, as only URLs that hold them are tried.
    """
    bound_batches(spark)
    found = [("rule", sites[i : i + TURN]) for i in range(0, len(sites), TURN)] + [("pattern", patterns[i : i + TURN]) for i in range(0, len(patterns), TURN)]
    counts = token_counts(pages.select("url"), {t for _, rules in found for r in rules for t in r.tokens}) if found else {}
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    none = F.lit(None).cast("struct<name string, verdict string>")
    column = {kind: fresh([*out.columns, "rule", "pattern", "verdict"], f"winning_{kind}") for kind in ("rule", "pattern")}
    out = out.withColumns({c: none for c in column.values()})

    def turn(kind: str, rules: list) -> Column:
        sent = spark.sparkContext.broadcast(index(rules, counts))  # TURN rules at most

        def run(series: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            by_token = sent.value
            tried = {r.name: re.compile(r.pattern) for rs in by_token.values() for r in rs if isinstance(r, PatternRule)}
            always = by_token.get("", [])
            for urls, hosts, paths, was in series:
                names, verdicts = [], []
                for url, host, path, best in zip(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist(), was.to_pylist(), strict=True):
                    low = (url or "").lower()
                    name, verdict = (best["name"], best["verdict"]) if best else (None, None)
                    for r in [*always, *(r for t in set(_TOKEN.findall(low)) for r in by_token.get(t, ()))]:
                        if isinstance(r, SiteRule):
                            fits = (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (name is None or (len(r.name), r.name) > (len(name), name))
                        else:
                            fits = tried[r.name].search(low) is not None and (name is None or r.name < name)
                        if fits:
                            name, verdict = r.name, r.verdict
                    names.append(name)
                    verdicts.append(verdict)
                mask = pa.array([n is None for n in names], pa.bool_())
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["name", "verdict"], mask=mask)

        return F.arrow_udf(run, "name string, verdict string")(F.col("url").cast("string"), "host", "path", column[kind])

    for kind, rules in found:
        out = out.withColumn(column[kind], turn(kind, rules))
    site, pattern = F.col(column["rule"]), F.col(column["pattern"])
    verdict = F.coalesce(site["verdict"], pattern["verdict"], F.lit(default))
    return out.withColumns({"rule": site["name"], "pattern": F.when(site.isNull(), pattern["name"]), "verdict": verdict}).drop(*column.values())
