"""Association measures and filters of cells, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.cooc import col_totals, row_totals, smoothed_total
from wordloom.params import Params


def _pmi(p: Params) -> Column:
    seen = F.col("cooc").cast("double")
    smooth = F.ln(F.pow(F.col("c_total").cast("double"), F.lit(p.cds)))
    return F.ln(seen) - F.ln(F.col("w_total").cast("double")) - smooth + F.ln("cds_total")


def _npmi(p: Params) -> Column:
    width = -(F.ln(F.col("cooc").cast("double")) - F.ln("cds_total"))
    return F.try_divide(_pmi(p), width)


def pmi(p: Params) -> Column:
    """Null for an empty cell."""
    return F.when(F.col("cooc") > 0, _pmi(p))


def cpmi(p: Params) -> Column:
    """PMI cut at clip from below; clip for an empty cell."""
    return F.when(F.col("cooc") > 0, F.greatest(_pmi(p), F.lit(float(p.clip)))).otherwise(F.lit(float(p.clip)))


def npmi(p: Params) -> Column:
    """PMI over -ln(cooc / cds_total); -1 for an empty cell, null where the cell
    holds the whole smoothed total."""
    return F.when(F.col("cooc") > 0, _npmi(p)).otherwise(F.lit(-1.0))


def nnegpmi(p: Params) -> Column:
    """PMI where it is not negative, else NPMI; -1 for an empty cell."""
    return F.when(F.col("cooc") > 0, F.when(_pmi(p) >= 0, _pmi(p)).otherwise(_npmi(p))).otherwise(F.lit(-1.0))


MEASURES: dict[str, Callable[[Params], Column]] = {"pmi": pmi, "cpmi": cpmi, "npmi": npmi, "nnegpmi": nnegpmi}

FILTERS: dict[str, Callable[[Column, float], Column]] = {
    "all": lambda y, t: F.lit(True),
    "gt": lambda y, t: y > F.lit(float(t)),
    "leq": lambda y, t: y <= F.lit(float(t)),
}


def with_given_totals(pairs: DataFrame, rows: DataFrame, cols: DataFrame, p: Params) -> DataFrame:
    """pairs (w, c, cooc) with w_total, c_total and cds_total of the totals
    (w, total) and (c, total).

    The totals are small beside the cells; where they are small enough at run
    time the joins broadcast them.  The smoothed total is a single number.
    """
    total = smoothed_total(cols, p.cds)
    joined = pairs.join(rows.withColumnRenamed("total", "w_total"), "w").join(cols.withColumnRenamed("total", "c_total"), "c")
    return joined.withColumn("cds_total", total.scalar())


def with_totals(pairs: DataFrame, cells: DataFrame, p: Params) -> DataFrame:
    """The same with the totals of cells."""
    return with_given_totals(pairs, row_totals(cells), col_totals(cells), p)


def association(pairs: DataFrame, cells: DataFrame, p: Params, measure: str | None = None) -> DataFrame:
    """pairs with y, the association of the named measure."""
    return with_totals(pairs, cells, p).withColumn("y", MEASURES[measure or p.matrix](p))


def processed(scored: DataFrame, p: Params) -> DataFrame:
    """Cells that the process filter lets through."""
    return scored.where(FILTERS[p.process](F.col("y"), p.process_threshold))
