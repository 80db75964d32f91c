"""Quality rules with verdicts on whole hosts (DataFrame functions only).

Every text gets counts and two rules of its own (too few words, too many words in
repeated three-word windows) and two milder ones (symbols, repeated lines). The
share of failing documents of each host (``source``) is shrunk towards a beta prior
fitted to all hosts, so that a host with three documents is not judged on three
draws. A host whose shrunken share exceeds ``host_limit`` is rejected: there, a
document has to pass the milder rules too. A clean document always stays.

Edge cases: a null text has no words and fails the base rules; a null source is no
host and is never rejected; repeated rows are judged alike and all returned; an
empty table gives an empty result; further columns, whatever their names, are carried
inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hand_over, materialize, packed, scope

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.6
#: hosts are dealt over so many salts in the join that brings verdicts back
SALTS = 32


def quality_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row, source, q): the columns named in carry as a struct, and the counts of every text.

    Windows are compared by 64-bit hashes within one text.
    """
    kept = [packed(carry), F.col("source")]
    base = docs.select(*kept, F.coalesce("text", F.lit("")).alias("_t"))
    kept = ["row", "source"]
    step = base.select(
        *kept,
        (F.char_length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long").alias("_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("_sym"),
        F.filter(F.split("_t", r"\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.transform(
            F.filter(F.split("_t", SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)
        ).alias("_w"),
    )
    step = step.withColumn("_n", F.size("_w"))
    step = step.withColumn(
        "_h",
        F.slice(
            F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))),
            F.lit(1),
            F.greatest(F.col("_n") - 2, F.lit(0)),
        ),
    )
    step = step.withColumn("_s", F.sort_array("_h"))
    step = step.withColumn(
        "_d", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1))))
    )
    # positions of repeated windows: a short list of repeated hashes is searched,
    # a long one is found by sorting (hash, position)
    few = F.filter(
        F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)), lambda p: p.isNotNull()
    )
    step = step.withColumn(
        "_o",
        F.when(
            F.size("_d") > 16,
            F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    )
    many = F.sort_array(
        F.transform(
            F.filter(
                "_o",
                lambda s, i: ((i > 0) & (F.get("_o", i - 1)["h"] == s["h"]))
                | F.coalesce(F.get("_o", i + 1)["h"] == s["h"], F.lit(False)),
            ),
            lambda s: s["p"],
        )
    )
    step = step.withColumn(
        "_p", F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= 16, few).otherwise(many)
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1), p + 3) - p)),
        F.lit(0),
        lambda a, x: a + x,
    )
    return step.select(
        *kept,
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.col("_chars").alias("word_chars"),
            F.col("_sym").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
        ).alias("q"),
    )


def base_failed() -> Column:
    return (F.col("q.n_words") < MIN_WORDS) | (
        100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words")
    )


def rule_failed() -> Column:
    """Any rule, the milder ones included."""
    return (
        base_failed()
        | (100 * F.col("q.n_symbols") > MAX_SYMBOL_PERCENT * F.col("q.word_chars"))
        | (100 * F.col("q.n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("q.n_lines"))
    )


def host_verdicts(judged: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(source, n_docs, n_failed, rate, rejected) per host of judged(source, q).

    The prior is Beta(m k, (1 - m) k): m is the share of failing documents over all
    hosts, k follows from the spread of the hosts' own shares beyond what sampling
    explains (method of moments, weighted by documents).
    """
    hosts = (
        judged.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(rule_failed()).alias("n_failed"))
    )
    hosts = materialize(hosts, "hosts")
    total = hosts.agg(
        F.count(F.lit(1)).alias("h"),
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("f"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    ).first()
    n, h = float(total["n"] or 0), float(total["h"] or 0)
    m = min(max((total["f"] or 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
    # between-host variance: weighted sum of squares minus the binomial part
    between = (total["ff"] or 0.0) - n * m * m - (h - 1) * m * (1 - m)
    var = between / n if n else 0.0
    k = min(max(m * (1 - m) / var - 1, 1.0), 1e4) if var > 0 else 1e4 if h > 1 else 1.0
    rate = (F.col("n_failed") + F.lit(m * k)) / (F.col("n_docs") + F.lit(k))
    return hosts.select("source", "n_docs", "n_failed", rate.alias("rate"), (rate > host_limit).alias("rejected"))


def judge(docs: DataFrame, carry: list[str], host_limit: float = HOST_LIMIT) -> DataFrame:
    """(row, q, base_failed, host_rejected, kept) for every row of docs(text, source, ..)."""
    with scope():
        judged = hand_over(materialize(quality_counts(docs, carry), "quality"))
        hosts = host_verdicts(judged, host_limit).where("rejected").select(
            F.col("source").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
        )
        bad = hand_over(materialize(hosts, "rejected"))
    row_salt = F.pmod(F.xxhash64("q.word_chars", "q.n_words", "q.n_symbols"), F.lit(SALTS)).cast("int")
    out = judged.withColumn("_s", row_salt).join(
        bad, (F.col("source") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left"
    )
    rejected = F.col("_host").isNotNull()
    return out.select(
        "row",
        "q",
        base_failed().alias("base_failed"),
        rejected.alias("host_rejected"),
        (~base_failed() & ~(rejected & rule_failed())).alias("kept"),
    )


def filter_quality(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    return judge(docs, docs.columns, host_limit).where("kept").select("row.*")
