"""Quality rules with host-level verdicts (operator 4, DataFrame functions only).

Each document gets its own measures from array expressions inside one scan stage; nothing is
exploded. Rule failures are summed by host, the failure rate of each host is shrunk towards a beta
prior fitted to all hosts (moment estimator), and the host verdict is joined back on narrow rows. A host is condemned, with
all its documents, if its failure rate exceeds ``host_excess`` times the corpus's with a posterior probability
of 95 % (by the normal approximation of the posterior); other documents are judged by their own rules.

Defined results: null text counts as empty (no words, so it fails); documents without a host are
judged by their own measures only; repeated rows are judged one by one; an empty table gives an
empty result; other columns pass through, and a clash with a result name is replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, materialize, table

BROADCAST_HOSTS = 500_000  # verdicts that are broadcast, at most
HOT_DOCUMENTS = 10_000  # documents from which a host counts as large, at least, where there are more hosts than that
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 20  # symbols against characters in words
    max_dup_line_words: int = 10  # words a repeated line costs at least before it counts as failure
    host_excess: float = 2.0  # times the corpus's failure rate
    host_z: float = 1.645  # posterior deviations by which a condemned host's rate lies above that, at least


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice: sort windows with their places, keep equal neighbours."""

    def places(grams: Column) -> Column:
        hit = F.filter(
            grams,
            lambda g, k: F.coalesce(F.get(grams, k - F.lit(1))["g"] == g["g"], F.lit(False))
            | F.coalesce(F.get(grams, k + F.lit(1))["g"] == g["g"], F.lit(False)),
        )
        return F.transform(hit, lambda g: g["i"])

    grams = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(words, i), F.get(words, i + F.lit(1)), F.get(words, i + F.lit(2))).alias("g"),
                i.alias("i"),
            ),
        )
    )
    covered = let(
        let(grams, places),
        lambda at: F.size(
            F.array_distinct(F.concat(at, F.transform(at, lambda x: x + F.lit(1)), F.transform(at, lambda x: x + F.lit(2))))
        ),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(covered).cast("long")


def measures(text: Column) -> Column:
    """A struct of ``MEASURES`` for a non-null text."""
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.array_remove(F.split(text, SPACE_RUN, -1), ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.regexp_extract_all(text, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
            let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated(words).alias("n_repeat_words"),
        ),
    )


def measure_documents(docs: DataFrame, text: str = "text", rules: HostRules = HostRules()) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``rule_failed``."""
    base = docs.drop(*MEASURES, "base_failed", "rule_failed", "kept", "host_rate", "host_failed")
    measured = base.withColumn("__m", measures(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    measured = measured.select(*[F.col(f"`{c}`") for c in base.columns], *[F.col("__m")[m].alias(m) for m in MEASURES])
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    symbols = 100 * F.col("n_symbols") > rules.max_symbol_percent * F.col("word_chars")
    lines = F.col("n_dup_lines") * rules.max_dup_line_words > F.col("n_words")
    return measured.withColumn("base_failed", failed).withColumn("rule_failed", failed | symbols | lines)


def host_verdicts(measured: DataFrame, host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and verdict.

    The sums combine before the shuffle, so a host with a third of all rows costs one row per task.
    Only the five sums over hosts (a single row) reach the driver.
    """
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("__host"))
        .agg(F.count("*").alias("host_docs"), F.count_if("rule_failed").alias("host_failures"))
    )
    n, f = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    sums = hosts.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")
    ).first()
    alpha, beta = beta_prior(sums.k, sums.n or 0.0, sums.f or 0.0, sums.nn or 0.0, sums.ffn or 0.0)
    rate = (f + F.lit(alpha)) / (n + F.lit(alpha + beta))
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + F.lit(alpha + beta + 1)))
    above = F.col("host_rate") - F.lit(rules.host_excess * alpha / (alpha + beta)) > rules.host_z * deviation
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", above)


def beta_prior(k: int, n: float, f: float, nn: float, ffn: float) -> tuple[float, float]:
    """Beta parameters from sums over hosts: k hosts, n documents, f failures, sum n^2, sum f^2/n."""
    if n <= 0:
        return 0.5, 0.5
    mean = f / n
    noise = mean * (1 - mean)
    spread = n - nn / n - (k - 1)
    if k < 2 or noise <= 0 or spread <= 0:
        strength = 1.0
    else:
        rho = ((ffn - mean * mean * n) - noise * (k - 1)) / (noise * spread)
        strength = 1 / min(max(rho, 1e-4), 0.9999) - 1
    return mean * strength, (1 - mean) * strength


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """``docs`` with measures, host rate and ``kept``. Every text is measured once; the measured rows are written and read again."""
    measured = materialize(measure_documents(docs, text, rules), "host-measured")
    return join_verdicts(measured, host_verdicts(measured, host, rules), host)


def join_verdicts(measured: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """``measured`` with its hosts' verdicts, without a host's rows meeting in a task.

    Hosts are broadcast while they are few. Of more, the largest still are, by a size at which no more than BROADCAST_HOSTS
    are left, and only the rows of the other hosts are shuffled.
    """
    verdicts = materialize(verdicts.select("__host", "host_docs", "host_rate", "host_failed"), "host-verdicts")
    few, large = verdicts.count() <= BROADCAST_HOSTS, HOT_DOCUMENTS
    while not few and verdicts.where(F.col("host_docs") >= large).count() > BROADCAST_HOSTS:
        large *= 4
    known = verdicts if few else verdicts.where(F.col("host_docs") >= large)
    same = F.col(host) == F.col("__host")
    joined = measured.join(F.broadcast(known.drop("host_docs")), same, "left")
    if not few:
        other = joined.where(F.col("__host").isNull() & F.col(host).isNotNull()).select(*measured.columns)
        rest = verdicts.where(F.col("host_docs") < large).drop("host_docs")
        joined = joined.where(F.col("__host").isNotNull() | F.col(host).isNull()).unionByName(other.join(rest, same, "left"))
    return joined.drop("__host").withColumn("kept", ~F.col("rule_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False)))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    narrow = materialize(measure_documents(docs).drop("text"), "host-measures")
    judged = join_verdicts(narrow, host_verdicts(narrow), "source")
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))
