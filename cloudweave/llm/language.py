"""Language of pages by fusion of evidence: text, declared markup language, address suffix and host.

The text's likelihood is that of its letter trigrams under a model of each language. Pages are first labelled by text
alone; counts of declared languages, suffixes and hosts by those labels, all grouped aggregations over all pages, give
the other factors: a declaration's and a suffix's likelihood under each language, and a prior for each host that is
smoothed towards its domain's, which is smoothed towards that of all pages. A page's own label is taken out of all
counts by which it is judged, so that its text speaks once.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import fitting, map_arrow, table, written

#: Labelled texts of a language that the trigram model is fitted on at most, least crc32 of the id first, and languages
#: that it knows at most, those of the most documents.
SAMPLE, MOST_LANGUAGES = 400, 200
BUCKETS = 1 << 14
#: A text counts as this many trigrams at most (all are read): trigrams of one text are not independent evidence, and
#: with more weight no other evidence could ever speak against it.
MOST_TRIGRAMS = 40.0
#: Pages that a prior weighs as: of a domain for its hosts, of all pages for a domain; and added to each count.
HOST_WEIGHT, DOMAIN_WEIGHT, ADDED = 8.0, 8.0, 0.5
#: Second labels under a country's suffix that are registries' own, so the domain has three labels.
REGISTRY = {"ac", "co", "com", "edu", "gob", "gov", "gouv", "net", "or", "org"}
TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text's letters, lower case, words set apart by one blank."""
    words = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    h = (c[:-2] * 1_000_003 + c[1:-1]) * 1_000_003 + c[2:]
    return (h ^ (h >> 17)) & (BUCKETS - 1)


def fit(texts: list[str], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages, and log probabilities (languages, BUCKETS) of their trigrams."""
    names = sorted(set(languages))
    counts = np.full((len(names), BUCKETS), 0.05)
    for text, lang in zip(texts, languages, strict=True):
        counts[names.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def likelihoods(model: np.ndarray, text: str) -> list[float]:
    """Log likelihoods of a text, the best being 0; all 0 without letters."""
    t = trigrams(text)
    if not len(t) or not len(model):
        return [0.0] * len(model)
    s = model[:, t].sum(axis=1, dtype=np.float64) * min(1.0, MOST_TRIGRAMS / len(t))
    return [float(x) for x in s - s.max()]


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain (the last two labels; three if the second of a country's is a registry's) and suffix (the last label)
    of a URL; empty where it has none."""
    text = (url or "").strip()
    try:
        host = (urlsplit(text if "://" in text else f"//{text}").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in REGISTRY else 2
    return host, ".".join(labels[-n:]), labels[-1]


EVIDENCE = "page_id long, host string, domain string, suffix string, declared string, text_ll array<double>"
_EVIDENCE = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("text_ll", pa.list_(pa.float64()))])


def evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """What each row of pages (page_id, url, html) shows; texts are read whole."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # languages * BUCKETS, whatever the corpus

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            html = [h or "" for h in batch.column("html").to_pylist()]
            places = [address(u) for u in batch.column("url").to_pylist()]
            found = [DECLARED.search(h) for h in html]
            return {
                "page_id": batch.column("page_id"),
                "host": [p[0] for p in places],
                "domain": [p[1] for p in places],
                "suffix": [p[2] for p in places],
                "declared": [m[1].lower() if m else "" for m in found],
                "text_ll": [likelihoods(model, TAG.sub(" ", h)) for h in html],
            }

        return step

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), make, EVIDENCE, _EVIDENCE)


def _counts(by: Column, labelled: DataFrame, k: int, key: str) -> DataFrame:
    """For each value of a column, how many pages of each language, as an array."""
    return labelled.groupBy(by.alias(key)).agg(F.array(*(F.count_if(F.col("_label") == i) for i in range(k))).alias(f"{key}_n"))


def _others(counts: Column, k: int) -> list[Column]:
    """Counts of each language without the page's own label."""
    return [F.get(counts, F.lit(i)) - F.coalesce((F.col("_label") == i).cast("long"), F.lit(0)) for i in range(k)]


def _softened(counts: list[Column], prior: list[Column], weight: float) -> list[Column]:
    """(counts + weight * prior) / (sum + weight)."""
    total = sum(counts[1:], counts[0])
    return [(n + weight * p) / (total + weight) for n, p in zip(counts, prior, strict=True)]


def fuse(found: DataFrame, names: list[str]) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, suffix, host of each row of evidence.

    Ties go to the first language in order. Pages without any evidence take the prior of their host, domain or all. A
    declaration or suffix is as likely under a language as it is among the other pages of it, each value that occurs
    counted ADDED times more.
    """
    k = len(names)
    # The label by text: the first of the greatest likelihoods; pages whose text tells nothing have none.
    tells = F.array_min("text_ll") < 0
    labelled = found.withColumn("_label", F.when(tells, F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1))
    by = {c: _counts(F.col(c), labelled, k, c) for c in ("suffix", "declared")}
    values = {c: f.where(F.col(c) != "").count() for c, f in by.items()}
    sums = labelled.agg(*(F.count_if(F.col("_label") == i).alias(str(i)) for i in range(k))).first()
    total = F.array(*(F.lit(int(sums[str(i)])) for i in range(k)))
    hosts = _counts(F.struct("host", "domain"), labelled, k, "place")
    domains = hosts.groupBy("place.domain").agg(F.array(*(F.sum(F.get("place_n", F.lit(i))) for i in range(k))).alias("domain_n"))
    places = hosts.select("place.host", "place.domain", "place_n").join(domains, "domain").select("host", "place_n", "domain_n")
    # A host of many pages is one row of counts; the pages' side of the join may be split by Spark.
    joined = labelled.join(places, "host").join(by["suffix"], "suffix").join(by["declared"], "declared")
    joined = joined.withColumn("_total", F.array(*_others(total, k)))
    all_but = [F.get("_total", F.lit(i)) for i in range(k)]
    overall = _softened([n + ADDED for n in all_but], [F.lit(0.0)] * k, 0.0)
    joined = joined.withColumn("_overall", F.array(*overall))
    domain = _softened(_others(F.col("domain_n"), k), [F.get("_overall", F.lit(i)) for i in range(k)], DOMAIN_WEIGHT)
    joined = joined.withColumn("_domain", F.array(*domain))
    host = _softened(_others(F.col("place_n"), k), [F.get("_domain", F.lit(i)) for i in range(k)], HOST_WEIGHT)

    def likelihood(c: str) -> list[Column]:
        terms = [F.log((n + ADDED) / (t + ADDED * max(1, values[c]))) for n, t in zip(_others(F.col(f"{c}_n"), k), all_but, strict=True)]
        return [F.when(F.col(c) != "", x).otherwise(0.0) for x in terms]

    terms = zip(host, likelihood("suffix"), likelihood("declared"), strict=True)
    score = F.array(*(F.get("text_ll", F.lit(i)) + s + d + F.log(h) for i, (h, s, d) in enumerate(terms)))
    scored = joined.withColumn("_score", score).withColumn("_best", F.array_max("_score"))
    pick = F.array_position("_score", F.col("_best")).cast("int") - 1
    mass = F.aggregate(F.transform("_score", lambda s: F.exp(s - F.col("_best"))), F.lit(0.0), lambda a, x: a + x)
    of = F.lit(names)
    return scored.select("page_id", F.get(of, pick).alias("lang"), F.round(1 / mass, 6).alias("confidence"), F.get(of, F.col("_label")).alias("text_lang"), "declared", "suffix", "host")


def identify(pages: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """The language of each row of pages.

    Null URLs and texts count as empty; repeated rows are repeated; a null page_id is kept; an empty table gives no
    rows; other columns are not looked at. Without languages there is nothing to choose, and lang is null.
    """
    found = written(evidence(pages, model), "evidence")
    if not names:
        return found.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    return fuse(found, names)


def fit_table(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The trigram model from at most `sample` texts of each of MOST_LANGUAGES languages, within the bounds of fitting().

    Documents are counted by language; then one pass takes those whose crc32 is so small that about twice the sample
    has it, of which fitting() orders each language's.
    """
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    most = sizes.select("lang", (F.lit(2.0**32) * F.least(F.lit(1.0), (2 * sample + 100) / F.col("n"))).alias("_most"))
    order = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    near = named.withColumn("_order", order).join(F.broadcast(most), "lang").where("_order < _most").drop("_most")
    rows = fitting(near, "lang", "_order", sample).select("lang", "doc_id", "text").toPandas().sort_values(["lang", "doc_id", "text"])
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all pages."""
    names, model = fit_table(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), names, model)
