"""Expressions over arrays of numbers. Folds run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Halves away from zero; what rounds to zero keeps its sign, as SQL's round has it
    (Spark's round makes 0.0 of -1e-9)."""
    r = F.round(x, places)
    return F.when(r == 0, x * 0.0).otherwise(r)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit vector; zero vectors stay."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def project(v: Column, matrix: list[list[float]]) -> Column:
    """Linear projection by the rows of a small matrix."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in matrix])


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0; zeros if there are none.

    The sum runs token by token over whole vectors, so that the array is read once."""
    width = F.size(F.element_at(hidden, 1))
    zeros = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] != 0), lambda t: t["h"])
    sums = F.aggregate(kept, zeros, lambda a, h: F.zip_with(a, h, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) == 0, zeros).otherwise(F.transform(sums, lambda x: x / F.size(kept)))


def max_pool(hidden: Column, mask: Column) -> Column:
    """Greatest component over the unmasked tokens, from -1e9 on."""
    width = F.size(F.element_at(hidden, 1))
    least = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(-1e9))
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] != 0), lambda t: t["h"])
    return F.aggregate(kept, least, lambda a, h: F.zip_with(a, h, lambda x, y: F.greatest(x, y.cast("double"))))


def first_pool(hidden: Column) -> Column:
    """The first token's vector (also for no or unknown pooling)."""
    return F.transform(F.element_at(hidden, 1), lambda x: x.cast("double"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    return F.transform(shifted, lambda x: x / total(shifted))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x.cast("double")))


def argmax(v: Column) -> Column:
    """Place of the first greatest value, from 0; 0 for an empty array."""
    return F.greatest(F.coalesce(F.array_position(v, F.array_max(v)) - 1, F.lit(0)), F.lit(0)).cast("int")


def relevance(logits: Column) -> Column:
    """One logit: itself. Two: the second's softmax. More: the first. None: 0."""
    return (
        F.when(F.size(logits) == 1, F.element_at(logits, 1).cast("double"))
        .when(F.size(logits) == 2, 1.0 / (1.0 + F.exp((F.element_at(logits, 1) - F.element_at(logits, 2)).cast("double"))))
        .otherwise(F.coalesce(F.try_element_at(logits, F.lit(1)).cast("double"), F.lit(0.0)))
    )


def least_score(scores: Column) -> Column:
    return F.coalesce(F.array_min(scores), F.lit(0.0))


def greatest_score(scores: Column) -> Column:
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def repetition_penalty(logits: Column, generated: Column, penalty: float) -> Column:
    """Each time a token was generated, its logit is divided (if positive) or multiplied by the penalty."""
    def one(x, i):
        times = F.size(F.filter(generated, lambda t: t == i)).cast("double")
        return F.when(x > 0, x / F.pow(F.lit(float(penalty)), times)).otherwise(x * F.pow(F.lit(float(penalty)), times))

    return F.transform(logits, lambda x, i: one(x.cast("double"), i))


def top_k(probs: Column, k: int) -> Column:
    """Probabilities below the k-th greatest become 0, ties stay, the rest sum to 1."""
    if k <= 0:
        raise ValueError("k must be positive")
    least = F.element_at(F.sort_array(probs, asc=False), F.least(F.lit(k), F.size(probs)))
    kept = F.transform(probs, lambda p: F.when(p >= least, p).otherwise(0.0))
    return F.when(F.size(probs) <= k, probs).otherwise(_shares(kept))


def top_p(probs: Column, p: float) -> Column:
    """The fewest greatest probabilities that reach p (equal ones in order of place), sum 1."""
    ranked = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    fold = F.aggregate(
        ranked,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept")),
        lambda a, r: F.when(a["sum"] >= p, a).otherwise(F.struct((a["sum"] - r["n"]).alias("sum"), F.array_append(a["kept"], r["i"]).alias("kept"))),
    )
    kept = F.transform(probs, lambda x, i: F.when(F.array_contains(fold["kept"], i), x).otherwise(0.0))
    return _shares(kept)


def _shares(v: Column) -> Column:
    s = total(v)
    return F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v)


def sample(probs: Column, u: Column) -> Column:
    """Inverse of the cumulative distribution at u in [0, 1): the first place where the
    running sum exceeds u, else the last."""
    fold = F.aggregate(
        probs,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("at")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["i"] + 1).alias("i"), F.when((a["at"] < 0) & (u < a["sum"] + p), a["i"]).otherwise(a["at"]).alias("at")),
    )
    return F.when(fold["at"] >= 0, fold["at"]).otherwise(F.size(probs) - 1)


def sequence_score(log_prob: Column, tokens: Column) -> Column:
    """exp of the mean log-probability a token; 0 for no tokens."""
    return F.when(tokens > 0, F.exp(log_prob / tokens)).otherwise(0.0)


def resample(samples: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation at the new rate, for short arrays."""
    if from_rate == to_rate:
        return samples
    ratio = from_rate / to_rate
    count = F.floor(F.size(samples) / F.lit(ratio)).cast("int")

    def at(i):
        x = i * F.lit(ratio)
        k = F.floor(x).cast("int")
        share = x - k
        a, b = F.element_at(samples, k + 1).cast("double"), F.try_element_at(samples, k + 2).cast("double")
        return F.when(b.isNotNull(), a * (1 - share) + b * share).otherwise(a)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<double>"))
