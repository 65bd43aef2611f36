"""Declarative row validation with a reject side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row is valid if the check is true; null counts as a violation."""

    column: str
    check: Column
    message: str


def text_rule(column: str, low: int = 1, high: int | None = None, required: bool = True) -> Rule:
    size = F.length(column)
    check = size >= low if high is None else (size >= low) & (size <= high)
    span = f"{low}.." if high is None else f"{low}..{high}"
    return Rule(column, check if required else F.col(column).isNull() | check, f"{column} must have {span} characters")


def number_rule(column: str, low: float, required: bool = True) -> Rule:
    check = F.col(column) >= low
    return Rule(column, check if required else F.col(column).isNull() | check, f"{column} must be at least {low:g}")


def collection_rules() -> list[Rule]:
    return [
        text_rule("card_name", 3, 50), text_rule("card_type", 3, 50), text_rule("card_set", 3, 50), number_rule("quantity", 1),
        number_rule("magic_id", 1), text_rule("image_url", 3, 150),
    ]


def attention_rules() -> list[Rule]:
    return [
        text_rule("card_name", 3, 50, False), text_rule("extracted_text", 1, 100), text_rule("dirty_extracted_text", 1, 100),
        text_rule("name_image"), *[text_rule(c, 3, None, False) for c in ("type_image", "art_image", "flavor_image")],
        text_rule("possible_sets", 3, None, False),
    ]


def transaction_rules() -> list[Rule]:
    return [text_rule("name", 3, 50, False), number_rule("flavor_match_percent", 0), number_rule("art_match_percent", 0)]


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df plus violations, an array of messages."""
    found = [F.when(F.coalesce(r.check, F.lit(False)), F.lit(None)).otherwise(F.lit(r.message)) for r in rules]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations)."""
    v = violations(df, rules)
    return v.where(F.size("violations") == 0).drop("violations"), v.where(F.size("violations") > 0)
