"""Quality classifier: hierarchical empirical Bayes over hosts and paths, with the evidence of a document classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from palimpsest.llm import quality
from palimpsest.llm.common import written
from palimpsest.llm.wrapper import host_of

#: Probability of good quality from which a document is kept; bounds of the prior strengths in documents; sums are exact in units of 1/SCALE.
KEEP, WEAKEST, STRONGEST, SCALE = 0.5, 2.0, 1000.0, 1_000_000


def logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(inside / (1 - inside))


def strength(sites: DataFrame, k: str, n: str) -> DataFrame:
    """One row (mu, s): mean and prior strength of a beta prior over the shares k/n of the sites, by moments.

    The weighted variance of the shares, less what binomial noise gives, is mu*(1-mu)/(s+1).
    One site, or no variance beyond noise, gives the strongest prior.
    """
    total = sites.agg(F.sum(k).alias("k"), F.sum(n).alias("n"), F.count("*").alias("m"))
    mean = total.select("m", F.col("n").alias("all"), (F.col("k") / F.col("n")).alias("mu"))
    spread = sites.crossJoin(F.broadcast(mean)).groupBy("mu", "m", "all").agg(F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - F.col("mu"), F.lit(2))).alias("ss"), F.sum(F.col(n) * F.col(n)).alias("nn"))
    mumu = F.col("mu") * (1 - F.col("mu"))
    between = (F.col("ss") - (F.col("m") - 1) * mumu) / F.nullif(F.col("all") - F.col("nn") / F.col("all"), F.lit(0.0))
    s = F.when(between > 0, mumu / between - 1).otherwise(F.lit(STRONGEST))
    return spread.select("mu", F.least(F.greatest(F.round(s, 6), F.lit(WEAKEST)), F.lit(STRONGEST)).alias("s"))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, n, good, host_mean, s): counts of each path, the posterior mean of its host, and the strength with which the host's mean counts for the path.

    ``evidence`` has host, path and units (the probability of good quality, or the label, in 1/SCALE).
    """
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum("units") / SCALE).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    over = F.broadcast(strength(hosts, "hgood", "hn"))
    means = hosts.crossJoin(over).select(F.col("host").alias("__host"), ((F.col("hgood") + F.col("s") * F.col("mu")) / (F.col("hn") + F.col("s"))).alias("host_mean"))
    within = F.broadcast(strength(paths, "good", "n").select("s"))
    return paths.join(means, F.col("host").eqNullSafe(F.col("__host"))).drop("__host").crossJoin(within)


def fold_of(doc_id: int) -> int:
    """The fold (0 or 1) of a document; the model that judges it was trained on the other one."""
    return xxh32_intdigest(str(doc_id)) & 1


def cross_scored(docs: DataFrame, labels: DataFrame):
    """An Arrow UDF from (doc_id, text) to the probability of good quality, by a model that was not trained on any document of that fold.

    The bounded sample of labelled documents is cut into two folds, and each trains one model. Rows without doc_id go to model 0.
    """
    sample = quality.labelled_sample(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast([quality.fitted([r for r in sample if fold_of(r[0]) != k]) for k in (0, 1)])

    @F.arrow_udf("double")
    def probability(ids: pa.Array, texts: pa.Array) -> pa.Array:
        folds = np.array([0 if i is None else fold_of(i) for i in ids.to_pylist()], int)
        out = np.zeros(len(folds))
        for k, model in enumerate(shared.value):
            if (mine := np.flatnonzero(folds == k)).size:
                out[mine] = model.probabilities(texts.take(pa.array(mine)))
        return pa.array(out)

    return probability.asNondeterministic()


def path_of(url: Column) -> Column:
    """The first part of the path of a URL; '' if it is null or has none."""
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def site_quality(docs: DataFrame, labels: DataFrame, host: str | Column | None = None, path: str | Column | None = None) -> DataFrame:
    """(doc_id, host, path, p_text, p_site, p_good, keep) for every row of docs.

    host and path say where a document is from. By default they are the host and the first part of
    the path of a column url, or, where docs has none, its source and lang.

    p_text is the calibrated document classifier's probability of good quality, from one of two
    models, the one that saw no document of this one's fold in training. p_site is the
    posterior mean of the path without this document: counts of good documents (the label where
    there is one, else p_text), shrunk toward the mean of the host, itself shrunk toward the
    global mean, with strengths estimated from the spread of hosts and of paths. p_good combines
    both: the log odds of the text, with the global mean as its prior, go with those of the site
    in its place. keep from KEEP on. So neither the text's nor the site's evidence of a document
    rests on its own label.

    A null host or path is a site of its own. A null, empty or blank text has p_text 0 and counts
    as such for its site. Rows with a null doc_id and repeated rows are scored and counted like
    others; labels that disagree count as 0. An empty table gives no rows. Other columns are not read.
    """
    url = F.col("url").cast("string") if "url" in docs.columns else None
    host = (F.col("source") if url is None else host_of(url)) if host is None else F.col(host) if isinstance(host, str) else host
    path = (F.col("lang") if url is None else path_of(url)) if path is None else F.col(path) if isinstance(path, str) else path
    text = F.col("text").cast("string")
    p = cross_scored(docs, labels)
    blank = text.isNull() | ~text.rlike(r"\S")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), p(F.col("doc_id").cast("long"), text).alias("p"), blank.alias("blank"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("label"))
    units = F.round(F.when(F.col("blank"), 0.0).otherwise(F.col("p")) * SCALE).cast("long")
    base = written(scored.select("doc_id", "host", "path", units.alias("text_units")), "scored")
    evidence = base.join(known, F.col("doc_id") == F.col("id"), "left").withColumn("units", F.coalesce(F.col("label").cast("long") * SCALE, F.col("text_units"))).drop("id", "label")
    sites = site_posteriors(evidence).withColumnsRenamed({"host": "__h", "path": "__p"})
    mu = F.broadcast(evidence.agg((F.sum("units") / SCALE / F.count("*")).alias("mu")))
    out = evidence.join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p"))).crossJoin(mu)
    p_site = (F.col("good") - F.col("units") / SCALE + F.col("s") * F.col("host_mean")) / (F.col("n") - 1 + F.col("s"))
    p_text = F.col("text_units") / SCALE
    out = out.select("doc_id", "host", "path", p_text.alias("p_text"), F.round(p_site, 6).alias("p_site"), "mu")
    odds = logit(F.col("p_text")) + logit(F.col("p_site")) - logit(F.col("mu"))
    return out.select("doc_id", "host", "path", "p_text", "p_site", F.round(1 / (1 + F.exp(-odds)), 6).alias("p_good"), (1 / (1 + F.exp(-odds)) >= KEEP).alias("keep"))
