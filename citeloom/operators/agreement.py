"""Agreement of raters: confusion and F1 by label, gates, Cohen's kappa, Krippendorff's alpha."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: the labels, in their reported order.
LABELS = ("Supports", "Contradicts", "Neutral", "Not relevant")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def label_scores(pairs: DataFrame, labels: tuple[str, ...] = LABELS, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, label, precision, recall, f1, support) for each of the labels, zeros where it doesn't occur; a row counts `weight` times.

    One aggregation, so that what makes the pairs is read once.
    """
    by = by or []
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    each = []
    for label in labels:
        gold, pred = (F.coalesce(F.col(c) == label, F.lit(False)) for c in ("gold", "pred"))
        each.append(F.struct(F.lit(label).alias("label"), *[F.coalesce(F.sum(F.when(on, n)), F.lit(0).cast("long")).alias(c) for c, on in (("support", gold), ("predicted", pred), ("tp", gold & pred))]))
    out = pairs.groupBy(*by).agg(F.array(*each).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")
    ratio = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    return out.select(*by, "label", ratio("predicted").alias("precision"), ratio("support").alias("recall"), f1.alias("f1"), "support")


def weighted_f1(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = F.sum("support")
    return scores.groupBy(*(by or [])).agg(F.when(n > 0, F.sum(F.col("f1") * F.col("support")) / n).otherwise(F.lit(0.0)).alias("weighted_f1"))


def gate(scores: DataFrame, threshold: float = 0.85, floor: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Weighted F1 of at least threshold, and no label that occurs below the floor."""
    floors = scores.groupBy(*(by or [])).agg(F.coalesce(F.bool_and((F.col("support") == 0) | (F.col("f1") >= floor)), F.lit(True)).alias("floors_met"), (F.sum(F.col("f1") * F.col("support")) / F.greatest(F.sum("support"), F.lit(1))).alias("weighted_f1"))
    return floors.select(*(by or []), "weighted_f1", "floors_met", ((F.col("weighted_f1") >= threshold) & F.col("floors_met")).alias("passed"))


def cohens_kappa(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, agreement, kappa) of (a, b); no pairs give 0, expected agreement of 1 gives 1."""
    by = by or []
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = rows.join(cols, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("e"))
    out = total.join(chance, by, "left") if by else total.crossJoin(chance)  # one row by one row
    n = F.coalesce("n", F.lit(0))
    po, pe = F.col("same") / F.col("n"), F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(n == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    return out.select(*by, n.alias("n"), F.coalesce(po, F.lit(0.0)).alias("agreement"), kappa.alias("kappa"))


def pairwise_agreement(ratings: DataFrame, unit: list[str]) -> DataFrame:
    """(a_rater, b_rater, n, agreement, kappa) of ratings (unit, rater, label); a rater's last label of a unit counts (ord)."""
    last = ratings.groupBy(*unit, "rater").agg(F.max_by("label", "ord").alias("label"))
    a, b = last.withColumnsRenamed({"rater": "a_rater", "label": "a"}), last.withColumnsRenamed({"rater": "b_rater", "label": "b"})
    return cohens_kappa(a.join(b, unit).filter("a_rater < b_rater"), ["a_rater", "b_rater"])


def check_ratings(ratings: DataFrame, labels: tuple[str, ...] = LABELS, complete: bool = True) -> None:
    """Raise ValueError for fewer than two coders, coders of unlike numbers of units (unless not complete), or a label that isn't known."""
    counts = ratings.groupBy("coder").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(*labels)).alias("odd"))
    got = counts.agg(F.count("*").alias("coders"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("odd").alias("odd")).first()
    if got["coders"] < 2:
        raise ValueError(f"{got['coders']} coders, at least 2 needed")
    if complete and got["least"] != got["most"]:
        raise ValueError(f"ragged ratings: {got['least']} to {got['most']} units a coder")
    if got["odd"]:
        raise ValueError(f"{got['odd']} labels that aren't among {labels}")


def krippendorff_alpha(ratings: DataFrame, drop_singletons: bool = False) -> DataFrame:
    """One row (n, alpha) of nominal ratings (unit, coder, label); null labels are missing (check_ratings raises for bad input).

    Units with one label count in the margins unless drop_singletons. Fewer than two
    labels, or no expected disagreement, give 1.
    """
    cells = ratings.filter("label is not null").groupBy("unit", "label").agg(F.count("*").cast("double").alias("n"))
    units = cells.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"))
    if drop_singletons:
        units = units.filter("m > 1")
        cells = cells.join(units.select("unit"), "unit", "left_semi")
    seen = units.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.when(F.col("m") > 1, (F.col("m") * F.col("m") - F.col("s")) / (F.col("m") - 1))), F.lit(0.0)).alias("d"))
    margins = cells.groupBy("label").agg(F.sum("n").alias("c")).agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)).alias("cc"))
    out = seen.crossJoin(margins)  # one row by one row
    expected = (F.col("n") * F.col("n") - F.col("cc")) / (F.col("n") * (F.col("n") - 1))
    return out.select(F.col("n").cast("long").alias("n"), F.when(F.col("n") < 2, 1.0).when(expected == 0, 1.0).otherwise(1 - F.col("d") / F.col("n") / expected).alias("alpha"))
