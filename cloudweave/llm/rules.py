"""Quality rules of documents, made stricter for hosts whose documents fail them.

All of it is DataFrame operations. Each document's counts are found within its row. Rule failures are then summed by
host, the hosts' rates are shrunk by a beta prior fitted to all hosts by moments, and each document takes its host's
verdict: the higher the host's shrunk rate is against the mean of all hosts, the lower are the limits for its documents.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import table, written

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
INTERNAL = ("_words", "_lines", "_hashes", "_grams", "_twice", "_at", "_same", "_sure", "_n_lines", "_host", "_symbols", "_dups")
#: Hosts whose limits are broadcast at most; more are joined by a shuffle of the rows that hang on them.
BROADCAST_HOSTS = 100_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """Least words and largest percentages; the first two are the base rule, which holds in every host.

    Of symbols and repeated lines, a host without failures has the first limit of each pair, a host that fails twice as
    often as hosts do on the mean (or more) the second, and between them the limit falls in proportion to the rate. What
    fails, for the hosts' rates, is judged by the middle of each pair, which is the limit of a host at the mean.
    """

    least_words: int = 50
    repeat_words: int = 50
    symbols: tuple[int, int] = (15, 5)
    dup_lines: tuple[int, int] = (75, 25)
    #: Documents that the prior weighs as, at most and at least.
    most_prior: float = 1000.0
    least_prior: float = 2.0

    def without_hosts(self) -> Limits:
        """The same with the middle limits in every host."""
        return replace(self, symbols=(sum(self.symbols) / 2,) * 2, dup_lines=(sum(self.dup_lines) / 2,) * 2)


def _shifted(name: str, by: int) -> Column:
    return F.transform(name, lambda i: i + by)


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _n_lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_arrays = docs.withColumn("_words", F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).withColumn(
        "_lines", F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    )
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))
    # Most texts repeat no hash of a window and are done. Of the others the windows are sorted by hash, then place, and
    # those that share a hash are sorted once more by their words, which alone decide.
    with_hashes = with_arrays.withColumn("_hashes", F.when(n >= WINDOW, hashes))
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    with_grams = with_hashes.withColumn("_grams", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(placed)))
    twice = F.filter(F.sequence(F.lit(1), F.size("_grams") - 1), lambda k: F.get("_grams", k)["h"] == F.get("_grams", k - 1)["h"])
    with_twice = with_grams.withColumn("_twice", F.when(F.size("_grams") > 1, twice))
    at = F.array_union(F.transform("_twice", lambda k: F.get("_grams", k)["i"]), F.transform("_twice", lambda k: F.get("_grams", k - 1)["i"]))
    spelled = F.transform(at, lambda i: F.struct(F.concat_ws(" ", *(F.get("_words", i + k) for k in range(WINDOW))).alias("g"), i.alias("i")))
    with_at = with_twice.withColumn("_at", F.when(F.size("_twice") > 0, F.sort_array(spelled)))
    same = F.filter(F.sequence(F.lit(1), F.size("_at") - 1), lambda k: F.get("_at", k)["g"] == F.get("_at", k - 1)["g"])
    with_same = with_at.withColumn("_same", F.when(F.size("_at") > 1, same))
    sure = F.array_union(F.transform("_same", lambda k: F.get("_at", k)["i"]), F.transform("_same", lambda k: F.get("_at", k - 1)["i"]))
    with_sure = with_same.withColumn("_sure", F.when(F.size("_same") > 0, sure))
    covered = F.array_distinct(F.flatten(F.array(*(_shifted("_sure", k) for k in range(WINDOW)))))
    return with_sure.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_sure").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
    )


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_words * F.col("n_words"))


def soft_failed(symbols: Column, dup_lines: Column) -> Column:
    """Whether symbols or repeated lines are over limits given in thousandths of a percent, so all is whole numbers."""
    return (100_000 * F.col("n_symbols") > symbols * F.col("word_chars")) | (100_000 * F.col("n_dup_lines") > dup_lines * F.col("_n_lines"))


def _fixed(*percent: float) -> list[Column]:
    return [F.lit(round(1000 * p)).cast("long") for p in percent]


def host_limits(counted: DataFrame, host: str, limits: Limits) -> DataFrame:
    """_host, _symbols, _dups (thousandths of a percent) of each host of counted rows; one row of moments comes to the driver."""
    failed = base_failed(limits) | soft_failed(*_fixed(sum(limits.symbols) / 2, sum(limits.dup_lines) / 2))
    hosts = counted.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host")).agg(F.count("*").alias("n"), F.sum(failed.cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean, spread = m["mean"] or 0.0, m["spread"] or 0.0
    # What spread the rates would have by chance alone is not the hosts'.
    between = max(0.0, spread - mean * (1 - mean) * (m["noise"] or 0.0))
    weight = min(limits.most_prior, max(limits.least_prior, mean * (1 - mean) / between - 1)) if between > 0 else limits.most_prior
    shrunk = (F.col("k") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    against = F.least(shrunk / F.lit(2 * mean), F.lit(1.0)) if mean > 0 else F.lit(0.5)

    def between_(pair: tuple[float, float]) -> Column:
        return F.round(1000 * (F.lit(float(pair[0])) - F.lit(float(pair[0] - pair[1])) * against)).cast("long")

    return hosts.select("_host", between_(limits.symbols).alias("_symbols"), between_(limits.dup_lines).alias("_dups"))


def judged(docs: DataFrame, host: str = "source", limits: Limits = Limits(), drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without the columns to drop) with the counts, base_failed and kept.

    Null texts count as empty and fail the base rule; a null host is the empty host. Repeated rows are judged each, a
    null doc_id is kept and an empty table gives no rows. Columns of docs that have a result's name are replaced. The
    counted rows are written to the shared folder once, so texts are counted once. Rows that fail the base rule or every
    host's limits, or pass every host's, are judged as they are; only the others are joined to their host's limits.
    """
    clash = [c for c in docs.columns if c in (*FEATURES, "base_failed", "kept", *INTERNAL)]
    counted = written(counts(docs.drop(*clash)).drop(*drop), "counts")
    by_host = host_limits(counted, host, limits)
    by_host = F.broadcast(by_host) if by_host.count() <= BROADCAST_HOSTS else by_host
    based = counted.withColumn("base_failed", base_failed(limits))
    never = F.col("base_failed") | soft_failed(*_fixed(limits.symbols[0], limits.dup_lines[0]))
    always = ~soft_failed(*_fixed(limits.symbols[1], limits.dup_lines[1]))
    plain = based.where(never | always).withColumn("kept", ~never)
    open_ = based.where(~never & ~always).withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    settled = open_.join(by_host, "_host").withColumn("kept", ~soft_failed(F.col("_symbols"), F.col("_dups")))
    return plain.drop("_n_lines").unionByName(settled.drop("_host", "_symbols", "_dups", "_n_lines"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judged(docs, drop=("text",)).select("doc_id", *FEATURES, "base_failed", "kept")


COUNTS_SQL = r"""
d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counted AS (SELECT d.*, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, coalesce(source, '') AS host
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines AS middle FROM counted),
hosts AS (SELECT host, count(*) AS n, sum((base_failed OR middle)::BIGINT) AS k FROM failing GROUP BY host),
moments AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS spread, avg(1 / n) AS noise FROM hosts),
prior AS (SELECT mean, CASE WHEN spread - mean * (1 - mean) * noise > 0
    THEN least(1000, greatest(2, mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1)) ELSE 1000 END AS weight FROM moments),
shrunk AS (SELECT host, CASE WHEN mean > 0 THEN least((k + mean * weight) / (n + weight) / (2 * mean), 1) ELSE 0.5 END AS against FROM hosts, prior),
verdict AS (SELECT host, round(1000 * (15 - 10 * against))::BIGINT AS symbols, round(1000 * (75 - 50 * against))::BIGINT AS dups FROM shrunk),
judged AS (SELECT failing.*, NOT base_failed AND 100000 * n_symbols <= symbols * word_chars AND 100000 * n_dup_lines <= dups * n_lines AS kept
  FROM failing JOIN verdict USING (host))
"""

OP9_SQL = "WITH " + COUNTS_SQL.replace("{docs}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
