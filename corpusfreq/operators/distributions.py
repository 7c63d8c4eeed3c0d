"""Probability distributions as tables ``item, p`` with a rule for unseen items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions import scores
from corpusfreq.operators.freqs import count_of_counts, merge as merge_freqs
from corpusfreq.operators.smoothing import CONFIDENCE, sgt_table, unseen_mass
from corpusfreq.plans.ranking import running_total
from corpusfreq.plans.skew import lookup_join

# A draw uses 52 bits of a digest, the width of a double's mantissa.
DRAW_DIGITS = 13
DRAW_RANGE = float(1 << 52)

# An item's buckets are listed in pieces of this many.
SPAN_CHUNK = 100_000

# Probabilities become integers of this scale, so that the intervals of a running
# total neither overlap nor leave gaps.
WEIGHT_SCALE = float(1 << 60)


class DistributionException(ValueError):
    """The parameters do not define a distribution."""


@dataclass(frozen=True)
class Distribution:
    """``table`` has columns ``item, p``; any further column is kept as is."""

    table: DataFrame

    def unseen(self) -> Column:
        """Probability of an item that is not in the table."""
        return F.lit(0.0)

    def probability(self, query: DataFrame, item: str = "item", out: str = "p") -> DataFrame:
        """Score the items of a table; a frequent query item skews nothing."""
        found = lookup_join(query, self.table, {item: "item"}, None, {out: "p"})
        return found.withColumn(out, F.coalesce(F.col(out), self.unseen()))

    def log_probability(
        self, query: DataFrame, item: str = "item", out: str = "log_p", compat: bool = False
    ) -> DataFrame:
        """log2 of the probability, NULL where it is 0."""
        scored = self.probability(query, item, "__p")
        return scored.withColumn(out, scores.log_probability(F.col("__p"), compat)).drop("__p")

    def max_probability(self) -> DataFrame:
        """The most probable item, the smallest on a tie."""
        return self.table.select("item", "p").orderBy(F.desc("p"), F.asc("item")).limit(1)

    def samples(self) -> DataFrame:
        """The support."""
        return self.table.where(F.col("p") > 0).select("item")

    def size(self) -> DataFrame:
        return self.table.agg(F.count("*").alias("size"))

    def discount(self) -> DataFrame:
        """By how much counts are discounted on average."""
        return self.table.agg(F.lit(0.0).alias("discount"))

    def _weights(self) -> DataFrame:
        return self.table.select(
            "item", F.round(F.col("p") * F.lit(WEIGHT_SCALE)).cast("long").alias("weight")
        )

    def generate(self, draws: int, seed: int = 0) -> DataFrame:
        """``draw, item``: random items with the given probabilities.

        A draw depends on the seed and its number only, so a retried task repeats
        it. Items cover intervals of the running total of their weights; draws
        and intervals meet on equal-width buckets, as many as there are items.
        """
        weights = self._weights().where(F.col("weight") > 0)
        spark = weights.sparkSession
        ends = running_total(weights, ["item"], "weight", "hi")
        scale = ends.agg(F.struct(F.max("hi").alias("mass"), F.count("*").alias("buckets")))
        scale = scale.scalar()
        mass, buckets = F.col("__s")["mass"], F.col("__s")["buckets"]

        def bucket(x: Column) -> Column:
            return F.least(F.floor(x / mass * buckets).cast("long"), buckets - 1)

        low = F.col("hi") - F.col("weight")
        first, last = bucket(low).alias("first"), bucket(F.col("hi")).alias("last")
        spans = ends.withColumn("__s", scale).select("item", low.alias("lo"), "hi", first, last)
        # A probable item covers very many buckets: they are listed in pieces.
        begin = F.explode(F.sequence("first", "last", F.lit(SPAN_CHUNK).cast("long")))
        cut = spans.select("item", "lo", "hi", "last", begin.alias("begin")).repartition("item", "begin")
        end = F.least(F.col("last"), F.col("begin") + F.lit(SPAN_CHUNK - 1))
        intervals = cut.select("item", "lo", "hi", F.explode(F.sequence("begin", end)).alias("b"))
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
        u = F.conv(F.left(digest, F.lit(DRAW_DIGITS)), 16, 10).cast("long") / F.lit(DRAW_RANGE)
        drawn = spark.range(draws).withColumn("__s", scale)
        drawn = drawn.select(
            F.col("id").alias("draw"), F.floor(u * mass).cast("long").alias("x"), "__s"
        ).withColumn("db", bucket(F.col("x")))
        inside = (F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi"))
        return drawn.join(intervals, (F.col("db") == F.col("b")) & inside).select("draw", "item")


class UniformDist(Distribution):
    """Equal probability for every member; unseen items get the same value."""

    @staticmethod
    def of(rows: DataFrame, item: str = "item") -> UniformDist:
        members = rows.select(F.col(item).alias("item")).distinct()
        return UniformDist(members.withColumn("p", 1.0 / members.agg(F.count("*")).scalar()))

    def unseen(self) -> Column:
        return self.table.agg(F.max("p")).scalar()

    def insert(self, rows: DataFrame, item: str = "item") -> UniformDist:
        return UniformDist.of(
            self.table.select("item").unionByName(rows.select(F.col(item).alias("item")))
        )

    def merge(self, other: UniformDist) -> UniformDist:
        return self.insert(other.table)

    def _weights(self) -> DataFrame:
        return self.table.select("item", F.lit(1).cast("long").alias("weight"))


class MapDist(Distribution):
    """Normalised weights; 0 for unseen items."""

    @staticmethod
    def of(rows: DataFrame, item: str = "item", weight: str = "weight") -> MapDist:
        total = rows.agg(F.sum(weight)).scalar()
        return MapDist(
            rows.select(F.col(item).alias("item"), F.try_divide(weight, total).alias("p"))
        )

    def merge(self, other: MapDist) -> MapDist:
        """Add the probabilities and normalise again."""
        both = self.table.select("item", "p").unionByName(other.table.select("item", "p"))
        return MapDist.of(both.groupBy("item").agg(F.sum("p").alias("p")), weight="p")


@dataclass(frozen=True)
class MleDist(Distribution):
    """P(s) = C(s) / C(history of s); the history is an expression over ``item``."""

    freqs: DataFrame = None
    history: Column = None

    @staticmethod
    def of(freqs: DataFrame, history: Column) -> MleDist:
        keyed = freqs.withColumn("__h", history)
        totals = keyed.groupBy("__h").agg(
            F.sum("count").alias("__total"), F.count("*").alias("__n")
        )
        joined = lookup_join(keyed, totals, "__h", "__n", {"__total": "__total"})
        p = scores.mle(F.col("count"), F.col("__total"))
        return MleDist(joined.select("item", p.alias("p")), freqs, history)

    def merge(self, other: MleDist) -> MleDist:
        return MleDist.of(merge_freqs(self.freqs, other.freqs), self.history)


@dataclass(frozen=True)
class SgtDist(Distribution):
    """Simple Good-Turing over the items of a frequency table.

    An unseen item gets the whole unseen mass, or its share when the number of
    unseen bins is known.
    """

    freqs: DataFrame = None
    confidence: float = CONFIDENCE
    unseen_bins: int | None = None
    compat: bool = False

    @staticmethod
    def of(
        freqs: DataFrame,
        confidence: float = CONFIDENCE,
        unseen_bins: int | None = None,
        compat: bool = False,
    ) -> SgtDist:
        fitted = sgt_table(count_of_counts(freqs), confidence, compat)
        # Items seen once may be half of all items: n says how many share a count.
        scored = lookup_join(freqs.select("item", "count"), fitted, {"count": "r"}, "n", {"p": "p"})
        return SgtDist(scored, freqs, confidence, unseen_bins, compat)

    def unseen(self) -> Column:
        mass = unseen_mass(count_of_counts(self.freqs))
        return mass / self.unseen_bins if self.unseen_bins else mass

    def discount(self) -> DataFrame:
        fitted = sgt_table(count_of_counts(self.freqs), self.confidence, self.compat)
        once = fitted.agg(F.max(F.when(F.col("r") == 1, F.col("r_star")))).scalar()
        return self.freqs.agg((F.sum("count") * F.coalesce(once, F.lit(0.0))).alias("discount"))

    def merge(self, other: SgtDist) -> SgtDist:
        both = merge_freqs(self.freqs, other.freqs)
        return SgtDist.of(both, self.confidence, self.unseen_bins, self.compat)


@dataclass(frozen=True)
class LidstoneDist(Distribution):
    """(c + gamma) / (N + bins·gamma); the bins default to the observed items.

    Fewer bins than observed items are an error. With ``strict`` off the formula is taken
    as it is: the probabilities then add up to more than 1.
    """

    freqs: DataFrame = None
    gamma: float = 0.5
    bins: int | None = None
    strict: bool = True

    @staticmethod
    def of(freqs: DataFrame, gamma: float = 0.5, bins: int | None = None, strict: bool = True) -> LidstoneDist:
        if gamma < 0:
            raise DistributionException("gamma must not be negative")
        shell = LidstoneDist(freqs, freqs, gamma, bins, strict)
        p = shell._p(F.col("count"))
        return LidstoneDist(freqs.select("item", "count", p.alias("p")), freqs, gamma, bins, strict)

    def _p(self, count: Column) -> Column:
        observed = self.freqs.agg(F.count("*")).scalar()
        total = self.freqs.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
        if self.bins is None:
            return scores.lidstone(count, total, self.gamma, observed)
        p = scores.lidstone(count, total, self.gamma, F.lit(self.bins))
        if not self.strict:
            return p
        # Checked by the job itself: counting the items here would run one more.
        return F.when(
            observed > self.bins, F.raise_error(F.lit("fewer bins than observed items")).cast("double")
        ).otherwise(p)

    def unseen(self) -> Column:
        return self._p(F.lit(0))
