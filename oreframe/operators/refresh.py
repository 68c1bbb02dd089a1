"""Revaluations that follow prices: a quote that moves has only those studies computed again that depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import valuation as v
from .revaluation import FX


def by_mover(studies: DataFrame) -> DataFrame:
    """The index of studies with raw_legs: (study_id, movers, mover), a row for each quote that a study's value depends on. These are the supported metals of its legs, and the exchange rate if it reports or prices in Australian dollars.

    To be written in a folder for each mover, so that a refresh reads those of the quotes that moved. It holds keys only: a study's columns are stored once.
    """
    metals = F.array_distinct(F.filter(F.transform("raw_legs", lambda x: x["commodity"]), lambda m: m.isin(*v.SUPPORTED)))
    none = F.array().cast("array<string>")
    in_aud = (F.col("reporting_currency") == "AUD") | F.exists("raw_legs", lambda x: v.is_aud_unit(x["unit"]))
    rate = F.when(F.coalesce(in_aud, F.lit(False)), F.array(F.lit(FX))).otherwise(none)
    return studies.select("study_id", F.array_sort(F.concat(F.coalesce(metals, none), rate)).alias("movers")).withColumn("mover", F.explode("movers"))


def moved_quotes(old: DataFrame, new: DataFrame) -> list[str]:
    """Commodities with another price or price row in new than in old (one row each in both); at most the supported metals and the exchange rate."""
    value = lambda d, name: d.where(F.col("commodity").isin(*v.SUPPORTED, FX)).select("commodity", F.struct("price_usd", "price_id").alias(name))
    both = value(old, "a").join(value(new, "b"), "commodity", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return sorted(r.commodity for r in both.select("commodity").collect())


def of_moved(index: DataFrame, moved: list[str]) -> DataFrame:
    """The studies that moved quotes concern, each once: under the first of its quotes that moved. Reads these quotes' folders only, and shuffles nothing."""
    first = F.get(F.filter("movers", lambda m: m.isin(*moved)), F.lit(0))
    return index.where(F.col("mover").isin(*moved) & (F.col("mover") == first)).select("study_id")


def refreshed(stored: DataFrame, again: DataFrame, concerned: DataFrame) -> DataFrame:
    """stored, with again in place of the rows of concerned studies; those that can't be revalued any more go."""
    return stored.join(concerned.select("study_id"), "study_id", "left_anti").unionByName(again)
