"""Reports that are kept up to date by parts.

A profile is one row for a part of a table: counts that add up, a sketch of the distinct ids
and one of the quantiles of each number. Profiles of parts merge, so after an append only the
new part is read, and the report comes from the profiles. Counts are exact; distinct ids have a
relative error of about 1.6 % (one standard deviation, at 12 bits), quantiles one of about 1.3 %
of the rank (at 99 % confidence, k = 200), however many parts are merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISTINCT_BITS = 12
QUANTILE_K = 200


def profile(
    rows: DataFrame, part: str, counts: Mapping[str, Column], distinct: Sequence[str], numbers: Mapping[str, Column],
    bits: int = DISTINCT_BITS, k: int = QUANTILE_K,
) -> DataFrame:
    """One row: the part's name, n_rows, the counts (sums of numbers or of true conditions),
    and the sketches distinct_<column> and quantiles_<number>. Nulls are in no sketch."""
    return rows.agg(
        F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()],
        *[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(f"distinct_{c}") for c in distinct],
        *[F.kll_sketch_agg_double(c.cast("double"), F.lit(k)).alias(f"quantiles_{n}") for n, c in numbers.items()],
    )


def merged(profiles: DataFrame) -> DataFrame:
    """One row for all parts, in the same columns but for the part."""

    def together(name: str) -> Column:
        if name.startswith("distinct_"):
            return F.hll_union_agg(name)
        return F.kll_merge_agg_double(name) if name.startswith("quantiles_") else F.sum(name)

    return profiles.agg(*[together(c).alias(c) for c in profiles.columns if c != "part"])


def report(profiles: DataFrame, ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """One row: all counts, n_<column> for distinct values, and <number>_p50 and the like."""
    whole, columns = merged(profiles), []
    for name in whole.columns:
        if name.startswith("distinct_"):
            columns.append(F.hll_sketch_estimate(name).alias("n_" + name.removeprefix("distinct_")))
        elif name.startswith("quantiles_"):
            number = name.removeprefix("quantiles_")
            some = F.kll_sketch_get_n_double(name) > 0
            columns += [
                F.when(some, F.kll_sketch_get_quantile_double(F.col(name), F.lit(float(r)))).alias(f"{number}_p{round(100 * r)}") for r in ranks
            ]
        else:
            columns.append(F.col(name))
    return whole.select(*columns)
