"""Quality rules whose cutoffs bound the share of good documents that they reject.

Each rule rejects a document whose signal exceeds a cutoff. Labelled documents choose the cutoffs: within a
stratum, cutoffs are tried from the most lenient on, and one is taken while the exact (Clopper-Pearson) upper
bound on its false rejection rate stays at or under the allowed rate; the first that fails ends the sequence, so
the grid costs no correction. The error probability is divided among the strata in proportion to their labels, and
among a stratum's rules (weighted Bonferroni), and the allowed rate by the number of rules, so all statements hold at once: with probability 1 - error, no
stratum loses more than max_false_rejection of its good documents to the rules together. A stratum with too few
labels to show this has no rules. The base check on length and repetition is fixed and needs no labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UNKNOWN_STRATUM = "und"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Signal of each rule, and its cutoffs from lenient to strict; fixed before any label is seen.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_char": tuple(round(0.50 - 0.02 * i, 2) for i in range(25)),
    "repeat_share": tuple(round(0.50 - 0.02 * i, 2) for i in range(25)),
    "dup_lines_per_word": tuple(round(0.10 - 0.004 * i, 3) for i in range(25)),
    "long_words": tuple(float(30 - i) for i in range(23)),
    "short_words": tuple(round(1 / (1.5 + 0.1 * i), 4) for i in range(25)),
}
STEPS = max(map(len, RULES.values()))
#: As many labels go to the documents' tasks; of more, documents are measured first and meet their labels by their ids alone.
BROADCAST_LABELS = 1_000_000


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII spaces
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line not in seen:
            seen.add(line)
        elif line.split():
            dup_lines += 1
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pair = _renumber(word[:-1] * len(numbers) + word[1:])
    window = pair[:-1] * len(numbers) + word[2:]
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _renumber(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def signals(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> dict[str, float]:
    """The rules' signals from the counts; higher is worse."""
    words, chars = max(n_words, 1), max(word_chars, 1)
    return {
        "symbols_per_char": n_symbols / chars,
        "repeat_share": n_repeat_words / words,
        "dup_lines_per_word": n_dup_lines / words,
        "long_words": word_chars / words,
        "short_words": words / chars,
    }


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Clopper-Pearson: the highest rate at which `rejected` or fewer of n have probability `error` or more."""
    if rejected >= n:
        return 1.0
    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _binomial_cdf(rejected, n, mid) > error else (low, mid)
    return high


def _binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), its terms summed from the k-th down until they no longer count: some square root of n of them where p is k / n or more."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0  # in units of the k-th term
    for top in range(k, -1, -4096):
        i = np.arange(top, max(top - 4096, 0), -1, dtype=float)  # a term over the one above it
        terms = term * np.concatenate(([1.0], np.cumprod(i * (1 - p) / ((n - i + 1) * p))))
        last = top - 4096 < 0
        total += terms.sum() if last else terms[:-1].sum()
        term = terms[-1]
        if term < 1e-18 * total:
            break
    return float(min(1.0, math.exp(first) * total))


@dataclass
class QualityModel:
    """Cutoff of each stratum and rule; a rule without one is off there. Labelled strata without any are in `unproven`."""

    cutoffs: dict[str, dict[str, float]] = field(default_factory=dict)
    unproven: list[str] = field(default_factory=list)

    def verdict(self, stratum: str | None, counts: tuple[int, int, int, int, int]) -> tuple[bool, bool]:
        """(base_failed, kept)"""
        if base_fails(counts[0], counts[4]):
            return True, False
        rules = self.cutoffs.get(stratum if stratum is not None else UNKNOWN_STRATUM)
        if not rules:
            return False, True
        found = signals(*counts)
        return False, all(found[name] <= cutoff for name, cutoff in rules.items())


def count_signals(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and the five counts of every document, without a shuffle."""
    source = documents.select(F.col(id_col), F.col(text_col), F.col(stratum_col).cast("string"))
    schema = T.StructType(
        [T.StructField("id", source.schema[0].dataType), T.StructField("stratum", T.StringType())] + [T.StructField(n, T.LongType()) for n in COUNTS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def fit(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    label_col: str = "quality", max_false_rejection: float = 0.02, error: float = 0.05, joint: bool = False,
) -> QualityModel:
    """Chooses cutoffs from all documents labelled 1 that pass the base check; with `joint`, see choose().

    Counts of rejected good documents for every stratum, rule and cutoff are one aggregation over all labelled
    documents; only that table, strata times a fixed number of columns, reaches the driver. A document with
    several labels counts as good only if all say so. Null ids match no label; a null stratum is one of its own.
    The bounds take labelled documents for independent draws. Exact copies among them are not: labels should be of
    documents of which copies were removed, or bounds are as sure as for fewer documents.
    """
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).groupBy("id").agg(F.min("label").alias("label")).filter("label = 1")
    if good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        documents = documents.select(*dict.fromkeys((id_col, text_col, stratum_col))).join(F.broadcast(good.select(F.col("id").alias("_good"))), F.col(id_col) == F.col("_good"), "left_semi")
    counted = count_signals(documents, id_col=id_col, text_col=text_col, stratum_col=stratum_col)
    held = counted.join(good, "id", "left_semi").filter(
        (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    signal = {
        "symbols_per_char": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": words / chars,
    }
    over = [F.sum((signal[name] > cut).cast("long")).alias(f"{name}:{i}") for name, cuts in RULES.items() for i, cut in enumerate(cuts)]
    if joint:
        over += [F.sum(F.greatest(*[signal[name] > cuts[min(i, len(cuts) - 1)] for name, cuts in RULES.items()]).cast("long")).alias(f"joint:{i}") for i in range(STEPS)]
    table = held.groupBy(F.coalesce("stratum", F.lit(UNKNOWN_STRATUM)).alias("stratum")).agg(F.count("*").alias("n"), *over).collect()
    counts = {r["stratum"]: (r["n"], {name: [r[f"{name}:{i}"] for i in range(len(cuts))] for name, cuts in RULES.items()}) for r in table}
    return choose(counts, max_false_rejection, error, {r["stratum"]: [r[f"joint:{i}"] for i in range(STEPS)] for r in table} if joint else None)


def choose(counts: dict[str, tuple[int, dict[str, list[int]]]], max_false_rejection: float, error: float, joint: dict[str, list[int]] | None = None) -> QualityModel:
    """Cutoffs from, per stratum, the number of good documents and of those that each cutoff rejects.

    `joint` has those that all rules together reject, each at its i-th cutoff. A stratum with too few labels for
    rules one by one, even if none were rejected, then tries these nested sets in turn: one sequence at the whole
    allowed rate and the stratum's whole share of the error. Which way a stratum goes depends on its number of
    labels alone, so the statements still hold at once.
    """
    model = QualityModel()
    labels = sum(n for n, _ in counts.values())
    for stratum, (n, rejected) in counts.items():
        share = error * n / (labels * len(RULES)) if labels else 0.0
        if joint is not None and upper_bound(0, n, share) > max_false_rejection / len(RULES):
            for i, k in enumerate(joint[stratum]):
                if upper_bound(k, n, share * len(RULES)) > max_false_rejection:
                    break
                model.cutoffs[stratum] = {name: cuts[min(i, len(cuts) - 1)] for name, cuts in RULES.items()}
            continue
        for name, cuts in RULES.items():
            for cut, k in zip(cuts, rejected[name]):
                if upper_bound(k, n, share) > max_false_rejection / len(RULES):
                    break
                model.cutoffs.setdefault(stratum, {})[name] = cut
    model.unproven = sorted(counts.keys() - model.cutoffs.keys())
    return model


def judge(documents: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id_col, the five counts, base_failed and kept of every row.

    A null or empty text has counts of 0 and fails the base check. Repeated rows are judged one by one, texts of
    any length whole; no rows give none. Other columns are not carried.
    """
    source = documents.select(F.col(id_col), F.col(text_col), F.col(stratum_col).cast("string"))
    schema = T.StructType(
        [T.StructField(id_col, source.schema[0].dataType)] + [T.StructField(n, T.LongType()) for n in COUNTS]
        + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure(x) for x in batch.column(1).to_pylist()]
            verdicts = [model.verdict(s, c) for s, c in zip(batch.column(2).to_pylist(), counts)]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
            columns += [pa.array([v[i] for v in verdicts], pa.bool_()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def keep(documents: DataFrame, model: QualityModel, *, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows that judge() keeps, with all their columns."""
    text_at, stratum_at = documents.columns.index(text_col), documents.columns.index(stratum_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(text_at).to_pylist(), batch.column(stratum_at).to_pylist())
            yield batch.filter(pa.array([model.verdict(None if s is None else str(s), measure(t))[1] for t, s in pairs], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def oracle_sql(max_false_rejection: float = 0.02, error: float = 0.05) -> str:
    """The registered query in DuckDB SQL. An upper bound is at most p exactly when the binomial sum at p is at most the error."""
    signal = {
        "symbols_per_char": "n_symbols / chars", "repeat_share": "n_repeat_words / words", "dup_lines_per_word": "n_dup_lines / words",
        "long_words": "word_chars / words", "short_words": "words / chars",
    }
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{name}' AS rule, CAST({x} AS DOUBLE) AS signal FROM passing" for name, x in signal.items())
    cuts = ", ".join(f"('{name}', {i}, CAST({cut!r} AS DOUBLE))" for name, cuts in RULES.items() for i, cut in enumerate(cuts))
    nested = ", ".join(f"('{name}', {i}, CAST({cuts[min(i, len(cuts) - 1)]!r} AS DOUBLE))" for name, cuts in RULES.items() for i in range(STEPS))
    one, whole = (f"CAST({x!r} AS DOUBLE)" for x in (max_false_rejection / len(RULES), max_false_rejection))
    share = f"{error!r} * n / ((SELECT count(DISTINCT doc_id) FROM held) * {len(RULES)})"

    def binomial(p: str) -> str:  # of k or fewer among n
        term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))"
        return f"list_sum(list_transform(range(CAST(k + 1 AS BIGINT)), lambda i: {term}))"

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '{UNKNOWN_STRATUM}') AS stratum, row_number() OVER () AS row FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT row, i, (w[i], w[i + 1], w[i + 2]) AS three FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, three) AS times FROM windows) WHERE times > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
lines AS (SELECT row, line, count(*) AS times FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs) GROUP BY ALL),
dup AS (SELECT row, CAST(sum(times - 1) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
counts AS (
  SELECT s.row, doc_id, stratum, len(w) AS n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN dup ON dup.row = s.row LEFT JOIN covered ON covered.row = s.row
), base AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, greatest(n_words, 1) AS words, greatest(word_chars, 1) AS chars FROM counts
), passing AS (SELECT * FROM base WHERE NOT base_failed),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
signals AS ({long}),
held AS (SELECT * FROM signals WHERE doc_id IN (SELECT doc_id FROM good)),
cuts AS (SELECT * FROM (VALUES {cuts}) t(rule, step, cut)),
tested AS (
  SELECT stratum, h.rule, step, cut, count(DISTINCT doc_id) AS n, count(*) FILTER (signal > cut) AS k FROM held h JOIN cuts c ON c.rule = h.rule GROUP BY ALL
), judged AS (
  SELECT *, k >= n OR {binomial(one)} > {share} AS fails FROM tested WHERE pow(1 - {one}, n) <= {share}
), chosen_alone AS (
  SELECT stratum, rule, min(cut) AS cutoff FROM judged j
  WHERE NOT EXISTS (SELECT 1 FROM judged f WHERE f.stratum = j.stratum AND f.rule = j.rule AND f.fails AND f.step <= j.step) GROUP BY ALL
), nested AS (SELECT * FROM (VALUES {nested}) t(rule, step, cut)),
tested_together AS (
  SELECT stratum, step, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (signal > cut) AS k FROM held h JOIN nested c ON c.rule = h.rule GROUP BY ALL
), judged_together AS (
  SELECT *, k >= n OR {binomial(whole)} > {share} * {len(RULES)} AS fails FROM tested_together WHERE pow(1 - {one}, n) > {share}
), last_step AS (
  SELECT stratum, max(step) AS step FROM judged_together j
  WHERE NOT EXISTS (SELECT 1 FROM judged_together f WHERE f.stratum = j.stratum AND f.fails AND f.step <= j.step) GROUP BY stratum
), chosen AS (
  SELECT stratum, rule, cutoff FROM chosen_alone UNION ALL SELECT stratum, rule, cut AS cutoff FROM last_step JOIN nested USING (step)
), rejected AS (SELECT DISTINCT s.doc_id FROM signals s JOIN chosen c ON c.stratum = s.stratum AND c.rule = s.rule WHERE signal > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM base"""
