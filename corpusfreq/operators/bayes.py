"""Naive Bayes over documents with a set of features, and its cross-validation.

A training table has one row per document: ``doc_id, label, features`` where
features is ``array<struct<feature,value>>``. Counts are plain tables; grouping
columns such as a fold number may lead every one of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions.arrays import let
from corpusfreq.functions.text import norms
from corpusfreq.operators.folds import FOLDS, leave_one_out, shuffled, split_folds
from corpusfreq.operators.freqs import merge as merge_freqs
from corpusfreq.operators.tokens import StopWords, _as_list
from corpusfreq.plans.skew import Lookup, lookup_join, lookup_joins
from corpusfreq.session import durable, stored

# Fixed value: the pseudo-count of every smoothed distribution in the classifier.
GAMMA = 0.5


@dataclass(frozen=True)
class BayesCounts:
    """``labels``: label, count. ``features``: label, feature, value, count."""

    labels: DataFrame
    features: DataFrame

    def values(self) -> DataFrame:
        """The observed values of every feature."""
        groups = [c for c in self.features.columns if c not in ("label", "count")]
        return self.features.where(F.col("count") > 0).select(*groups).distinct()

    def merge(self, other: BayesCounts) -> BayesCounts:
        return BayesCounts(
            merge_freqs(self.labels, other.labels), merge_freqs(self.features, other.features)
        )


def to_training(
    docs: DataFrame,
    label: str | Column = "label",
    doc: str = "doc_id",
    text: str = "text",
    stop: StopWords = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Document, label and its distinct tokens, each with the value true."""
    types = F.array_distinct(norms(F.col(text), stop=_as_list(stop)))
    if isinstance(stop, DataFrame):
        docs = _with_kept_types(docs, types, stop, text)
        types = F.col("__types")
    features = F.transform(
        types, lambda t: F.struct(t.alias("feature"), F.lit(True).alias("value"))
    )
    tag = F.col(label) if isinstance(label, str) else label
    return docs.select(doc, tag.alias("label"), *keep, features.alias("features"))


def _with_kept_types(docs: DataFrame, types: Column, stop: DataFrame, text: str) -> DataFrame:
    """Add ``__types``, the token types that are not in the stop table.

    A text's types depend on the text alone, so they are joined and regrouped by
    its digest: rows that share a document id keep their own types.
    """
    key = F.sha2(F.col(text), 256)
    words = stop.select(F.col(stop.columns[0]).alias("__s"))
    rows = docs.select(key.alias("__key"), F.explode_outer(types).alias("__w")).where(F.col("__w").isNotNull())
    left = rows.join(words, F.col("__w") == F.col("__s"), "left_anti")
    kept = left.groupBy("__key").agg(F.collect_set("__w").alias("__types"))
    none = F.array().cast("array<string>")
    joined = docs.withColumn("__text_key", key).join(kept, F.col("__text_key") == F.col("__key"), "left")
    return joined.withColumn("__types", F.coalesce("__types", none)).drop("__key", "__text_key")


def train(training: DataFrame, by: Sequence[str] = ()) -> BayesCounts:
    """Count labels and (label, feature, value); partial sums combine before the shuffle."""
    labels = training.groupBy(*by, "label").agg(F.count("*").alias("count"))
    rows = training.select(*by, "label", F.inline_outer("features"))
    rows = rows.where(F.col("feature").isNotNull())
    features = rows.groupBy(*by, "label", "feature", "value").agg(F.count("*").alias("count"))
    return BayesCounts(labels, features)


def label_distribution(counts: BayesCounts) -> DataFrame:
    """``label, p``: smoothed label probabilities."""
    labels = counts.labels
    n, bins = labels.agg(F.sum("count")).scalar(), labels.agg(F.count("*")).scalar()
    return labels.select("label", _smoothed(F.col("count"), n, bins).alias("p"))


def _smoothed(count: Column, total: Column, bins: Column) -> Column:
    return (count + F.lit(GAMMA)) / (total + F.lit(GAMMA) * bins)


def finish_training(counts: BayesCounts, compat: bool = False) -> DataFrame:
    """``label, feature, value, count, p``: smoothed P(value | label, feature).

    A document without the feature counts as the feature having a null value, so
    the denominator is the label's number of documents and the null value adds a
    bin when any document lacks the feature. ``compat`` uses the raw counts.
    """
    n_docs = counts.labels.agg(F.sum("count")).scalar()
    per_feature = counts.features.groupBy("feature").agg(
        F.count_distinct("value").alias("v"), F.sum("count").alias("c"), F.count("*").alias("rows")
    )
    sizes = Lookup(per_feature, "feature", "rows", {"v": "v", "c": "c"})
    if compat:
        per_pair = counts.features.groupBy("label", "feature").agg(
            F.sum("count").alias("n"), F.count("*").alias("rows")
        )
        pairs = Lookup(per_pair, ["label", "feature"], "rows", {"n": "n"})
        joined = lookup_joins(counts.features, [sizes, pairs])
        p = _smoothed(F.col("count"), F.col("n"), F.col("v"))
    else:
        joined = lookup_joins(counts.features, [sizes, Lookup(counts.labels, "label", "count", {"n": "count"})])
        missing = (F.col("c") < n_docs).cast("int")
        p = _smoothed(F.col("count"), F.col("n"), F.col("v") + missing)
    return joined.select("label", "feature", "value", "count", p.alias("p"))


def _with_labels(df: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``__labels``, the classes of the row's fold with their counts.

    One array of classes per fold, as long as the result's own array of scores.
    """
    entries = F.sort_array(F.collect_list(F.struct("label", "count")))
    known = labels.where(F.col("count") > 0)
    if not by:
        return df.withColumn("__labels", known.agg(entries).scalar())
    per_fold = known.groupBy(*by).agg(entries.alias("__labels"))
    # One row per fold, so at most as many rows as the experiment has folds.
    return df.join(F.broadcast(per_fold), list(by), "left")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _needed(
    counts: BayesCounts, rows: DataFrame, by: Sequence[str], compat: bool
) -> DataFrame:
    """What the model says about each (feature, value) that occurs in ``rows``.

    ``__seen`` lists the labels with their contribution, ``__bins`` is the size of
    the feature's value set (NULL if training never saw the feature).
    """
    seen = counts.features.where(F.col("count") > 0)
    by_value = seen.groupBy(*by, "feature", "value").agg(
        F.collect_list(F.struct("label", "count")).alias("__lv"), F.sum("count").alias("__c")
    )
    by_feature = by_value.groupBy(*by, "feature").agg(
        F.count("*").alias("__v"), F.sum("__c").alias("__c")
    )
    need = rows.where(F.col("feature").isNotNull()).groupBy(*by, "feature", "value").agg(
        F.count("*").alias("__rows")
    )
    table = need.join(by_feature, [*by, "feature"], "left").join(
        by_value.drop("__c"), [*by, "feature", "value"], "left"
    )
    none = F.array().cast("array<struct<label:string,count:bigint>>")
    if compat:
        by_label = seen.groupBy(*by, "feature", "label").agg(F.sum("count").alias("count"))
        pairs = by_label.groupBy(*by, "feature").agg(
            F.collect_list(F.struct("label", "count")).alias("__lf")
        )
        table = table.join(pairs, [*by, "feature"], "left")
        hits = lambda label: F.aggregate(
            F.filter(F.coalesce("__lv", none), lambda x: x["label"] == label),
            F.lit(0).cast("long"),
            lambda a, x: a + x["count"],
        )
        contribution = F.transform(
            F.coalesce("__lf", none),
            lambda f: F.struct(
                f["label"].alias("label"),
                F.ln(_smoothed(hits(f["label"]), f["count"], F.col("__v"))).alias("delta"),
            ),
        )
        bins = F.lit(None).cast("long")
    else:
        contribution = F.transform(
            F.coalesce("__lv", none),
            lambda x: F.struct(
                x["label"].alias("label"),
                (F.ln(x["count"] + F.lit(GAMMA)) - F.ln(F.lit(GAMMA))).alias("delta"),
            ),
        )
        table = _with_labels(table, counts.labels, by)
        documents = F.aggregate("__labels", F.lit(0).cast("long"), lambda a, e: a + e["count"])
        bins = F.col("__v") + (F.col("__c") < documents).cast("int")
    return table.select(
        *by, "feature", "value", "__rows", contribution.alias("__seen"), bins.alias("__bins")
    )


def posteriors(
    counts: BayesCounts,
    test: DataFrame,
    doc: str = "doc_id",
    by: Sequence[str] = (),
    compat: bool = False,
) -> DataFrame:
    """``doc_id, …, scores``: per document the labels with log score and posterior.

    Features never seen in training are ignored. A label's score is its log prior
    plus the log probability of each feature value. The part that only depends on
    the size of a feature's value set is counted per document, so only observed
    (label, feature) pairs are joined and labels × vocabulary never materialises.
    """
    # Read for the features that are asked for and by either part of the lookup.
    rows = stored(test.select(doc, *by, F.inline_outer("features")), "features")
    counts = BayesCounts(stored(counts.labels, "labels"), stored(counts.features, "counts"))
    table = stored(_needed(counts, rows, by, compat), "needed")
    known = lookup_join(
        rows, table, [*by, "feature", "value"], "__rows", {"__seen": "__seen", "__bins": "__bins"}
    )
    nothing = F.array().cast("array<struct<label:string,delta:double>>")
    parts = F.concat(
        F.transform(
            F.coalesce("__seen", nothing),
            lambda s: F.struct(
                s["label"].alias("label"),
                s["delta"].alias("delta"),
                F.lit(None).cast("long").alias("bins"),
            ),
        ),
        F.array(
            F.struct(
                F.lit(None).cast("string").alias("label"),
                F.lit(0.0).alias("delta"),
                F.col("__bins").cast("long").alias("bins"),
            )
        ),
    )
    summed = (
        known.select(doc, *by, F.inline(parts))
        .groupBy(doc, *by, "label", "bins")
        .agg(F.sum("delta").alias("delta"), F.count("*").alias("m"))
    )
    per_doc = summed.groupBy(doc, *by).agg(
        F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "delta"))).alias("__d"),
        F.collect_list(F.when(F.col("bins").isNotNull(), F.struct("bins", "m"))).alias("__b"),
    )

    def score(labels: Column) -> Column:
        total = F.aggregate(labels, F.lit(0).cast("long"), lambda a, e: a + e["count"])

        def one(e: Column) -> Column:
            prior = F.ln(_smoothed(e["count"], total, F.size(labels)))
            shared = _sum(
                F.transform(
                    "__b",
                    lambda b: b["m"]
                    * (F.ln(F.lit(GAMMA)) - F.ln(e["count"] + F.lit(GAMMA) * b["bins"])),
                )
            )
            own = _sum(
                F.transform(
                    F.filter("__d", lambda d: d["label"] == e["label"]), lambda d: d["delta"]
                )
            )
            return F.struct(e["label"].alias("label"), (prior + shared + own).alias("score"))

        return F.transform(labels, one)

    def normalise(scored: Column) -> Column:
        top = F.array_max(F.transform(scored, lambda s: s["score"]))

        def divide(mass: Column) -> Column:
            return F.transform(
                scored,
                lambda s: F.struct(
                    s["label"].alias("label"),
                    s["score"].alias("score"),
                    (F.exp(s["score"] - top) / mass).alias("p"),
                ),
            )

        return let(_sum(F.transform(scored, lambda s: F.exp(s["score"] - top))), divide)

    per_doc = _with_labels(per_doc, counts.labels, by)
    scored = score(F.col("__labels"))
    return per_doc.select(doc, *by, let(scored, normalise).alias("scores"))


def classify_proba(posterior: DataFrame) -> DataFrame:
    """One row per document and label: ``label, score, p``."""
    keys = [c for c in posterior.columns if c != "scores"]
    rows = posterior.select(*keys, F.inline_outer("scores"))
    return rows.where(F.col("label").isNotNull())


def classify(posterior: DataFrame, out: str = "predicted") -> DataFrame:
    """The label with the highest posterior, the smallest one on a tie."""
    keys = [c for c in posterior.columns if c != "scores"]
    best = F.array_min(
        F.transform("scores", lambda s: F.struct((-s["score"]).alias("s"), s["label"].alias("l")))
    )
    return posterior.select(*keys, best["l"].alias(out))


def cross_validated(
    training: DataFrame, doc: str = "doc_id", fold: str = "fold", compat: bool = False
) -> DataFrame:
    """Posteriors of every document from a model trained on all other folds.

    Each fold is counted once; a fold's training counts are the totals minus its own,
    and only for the features its documents hold. ``training`` is read several
    times: pass a stored table if it is costly.
    """
    own = train(training, [fold])
    own = BayesCounts(stored(own.labels, "labels"), stored(own.features, "counts"))
    classes = own.labels.agg(F.collect_set("label")).scalar()
    per_fold = own.labels.select(fold).distinct().withColumn("label", F.explode(classes))
    labels = leave_one_out(per_fold, own.labels, fold)
    wanted = own.features.select(fold, "feature").distinct()
    seen = own.features.select("label", "feature", "value").distinct()
    features = leave_one_out(
        wanted.join(seen, "feature").select(fold, "label", "feature", "value"), own.features, fold
    )
    counts = BayesCounts(labels, features.where(F.col("count") > 0))
    return posteriors(counts, training.select(doc, fold, "features"), doc, [fold], compat)


def fold_results(
    posterior: DataFrame, training: DataFrame, doc: str = "doc_id", fold: str = "fold"
) -> DataFrame:
    """Per document: true label, prediction and the posterior of the true label."""
    truth = training.select(F.col(doc).alias("__doc"), "label")
    joined = posterior.join(truth, F.col(doc) == F.col("__doc"))
    best = F.array_min(
        F.transform("scores", lambda s: F.struct((-s["score"]).alias("s"), s["label"].alias("l")))
    )
    own = F.filter("scores", lambda s: s["label"] == F.col("label"))
    return joined.select(
        doc,
        fold,
        "label",
        best["l"].alias("predicted"),
        F.coalesce(F.get(own, F.lit(0))["p"], F.lit(0.0)).alias("p_true"),
        F.get(own, F.lit(0))["score"].alias("score_true"),
    )


def evaluate(results: DataFrame, positive: str, fold: str = "fold") -> DataFrame:
    """Per fold: hits, n, accuracy, precision, recall, F1, squared error, perplexity."""
    said, is_one = F.col("predicted") == positive, F.col("label") == positive
    counted = results.groupBy(fold).agg(
        F.count_if(F.col("predicted") == F.col("label")).alias("hits"),
        F.count("*").alias("n"),
        F.count_if(said & is_one).alias("tp"),
        F.count_if(said & ~is_one).alias("fp"),
        F.count_if(~said & is_one).alias("fn"),
        F.avg(F.pow(1 - F.col("p_true"), 2)).alias("mse"),
        F.exp(-F.avg(F.ln(F.when(F.col("p_true") > 0, F.col("p_true"))))).alias("perplexity"),
    )
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counted.select(
        fold,
        "hits",
        "n",
        (F.col("hits") / F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "mse",
        "perplexity",
    )


def cross_validate(
    docs: DataFrame,
    label: str = "tag",
    positive: str = "SPAM",
    stop: StopWords = None,
    k: int = FOLDS,
    seed: int = 0,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The whole experiment: shuffle, split into k folds, tokenise, and for each fold
    train on the others and measure on it.

    Document ids are unique. Only the ids are put in order, and the labelled
    features are stored once for all passes.
    """
    places = split_folds(shuffled(docs.select(F.col(doc).alias("__id")), "__id", seed), k)
    folded = docs.join(places.select("__id", "fold"), F.col(doc) == F.col("__id")).drop("__id")
    training = durable(to_training(folded, label, doc, text, stop, keep=["fold"]))
    return evaluate(fold_results(cross_validated(training, doc), training, doc), positive)


def average_folds(evaluation: DataFrame, fold: str = "fold") -> DataFrame:
    """The measures averaged over the folds."""
    names = [c for c in evaluation.columns if c not in (fold, "hits", "n")]
    return evaluation.agg(
        F.sum("hits").alias("hits"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in names]
    )
