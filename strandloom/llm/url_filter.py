"""URL filter: host and path rules, and a weighted vocabulary counted by an Aho-Corasick automaton.

Rules name a host and a path prefix; the longest that fits decides. Other URLs are judged by vocabulary terms that
stand alone in host or path, that is, with no ASCII letter or digit on either side: one strict term, or soft terms
whose weights (each distinct term counts once) reach the limit, block the URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms with weight STRICT block alone; soft ones add up.
STRICT = 100
SOFT_LIMIT = 2
MAX_TERMS = 1_000_000
VOCABULARY = {
    **dict.fromkeys(("porn", "porno", "xxx", "hentai", "xvideos", "camgirls", "escorts", "onlinecasino", "warez", "malware"), STRICT),
    **dict.fromkeys(("adult", "sex", "nude", "erotic", "casino", "poker", "betting", "slots", "viagra", "pills", "crack", "torrent", "keygen", "hookup", "dating"), 1),
}


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query; fixed values.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a URL; both empty for null or where there is no `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)  # after the first ://
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, nulls where none fits; of rules as long, the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, "allow" if rule.allow else "block").otherwise(verdict)
    return name, verdict


class TermCounter:
    """Finds the distinct vocabulary terms that stand alone in a text."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        self.weights = {term.lower(): weight for term, weight in vocabulary.items()}
        for term in self.weights:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def found(self, text: str) -> set[str]:
        if not self.weights:
            return set()
        text, inside = text.lower(), set()
        for end, term in self.automaton.iter(text):
            start = end - len(term) + 1
            before, after = text[start - 1 : start] if start else "", text[end + 1 : end + 2]
            if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
                inside.add(term)
        return inside

    def judge(self, text: str, soft_limit: int) -> tuple[list[str], list[str], bool]:
        """Strict terms, soft terms, and whether they block."""
        terms = sorted(self.found(text))
        strict = [t for t in terms if self.weights[t] >= STRICT]
        soft = [t for t in terms if self.weights[t] < STRICT]
        return strict, soft, bool(strict) or sum(self.weights[t] for t in soft) >= soft_limit


def read_vocabulary(terms: DataFrame) -> dict[str, int]:
    """Weights by term of a table (term, weight)."""
    lowered = terms.select(F.lower("term").alias("term"), F.col("weight").cast("int").alias("weight")).filter("term <> '' and weight is not null")
    found = lowered.groupBy("term").agg(F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return {r["term"]: r["weight"] for r in found}


def filter_urls(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES,
    vocabulary: dict[str, int] | DataFrame | None = None, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """id_col, host, path, rule, verdict and the strict and soft terms found, for every row.

    A null URL or one without `://` has empty host and path, fits no rule, holds no term and is allowed. Query
    and fragment are not judged. Repeated rows are judged one by one, URLs of any length whole; no rows give
    none. Other columns are not carried. Rules and vocabulary are parameters held by the driver; a vocabulary may also
    be a table (term, weight) of at most MAX_TERMS rows, of which the greatest weight of a term counts and nulls do not.
    """
    counter_of = read_vocabulary(vocabulary) if isinstance(vocabulary, DataFrame) else dict(VOCABULARY if vocabulary is None else vocabulary)
    host, path = host_and_path(F.col(url_col))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    words = T.ArrayType(T.StringType())
    schema = T.StructType([*parts.schema, T.StructField("strict_terms", words), T.StructField("soft_terms", words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(counter_of)
        for batch in batches:
            hosts, paths, ruled = (batch.column(i).to_pylist() for i in (1, 2, 4))
            judged = [counter.judge(h + p, soft_limit) for h, p in zip(hosts, paths)]
            verdicts = [v or ("block" if bad else "allow") for v, (_, _, bad) in zip(ruled, judged)]
            columns = [*batch.columns[:4], pa.array(verdicts, pa.string())]
            columns += [pa.array([j[i] for j in judged], pa.list_(pa.string())) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return parts.mapInArrow(run, schema)


def oracle_sql() -> str:
    """The registered query in DuckDB SQL."""
    alone = "regexp_matches(lower(host || path), '(^|[^a-z0-9]){}($|[^a-z0-9])')"
    hit = lambda terms: " + ".join(f"CAST({alone.format(t)} AS INT)" for t in terms)
    strict = [t for t, w in VOCABULARY.items() if w >= STRICT]
    soft = [t for t, w in VOCABULARY.items() if w < STRICT]
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    order = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in order)
    said = " ".join(f"WHEN rule = '{r.name}' THEN '{'allow' if r.allow else 'block'}'" for r in order)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE {said} WHEN {hit(strict)} >= 1 OR {hit(soft)} >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       CAST({hit(strict)} AS BIGINT) AS n_strict, CAST({hit(soft)} AS BIGINT) AS n_soft
FROM ruled"""
