"""The recognition plan: scans -> names -> printings -> verified sets -> collection or review rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialize, merged
from ..operators.fuzzy import confidence_policy, fuzzy_topk
from ..operators.routing import attention_rows, collection_rows, route, unmatched
from ..operators.verify import new_hashes, resolve_sets


@dataclass(frozen=True)
class Outcome:
    routed: DataFrame
    collection: DataFrame
    attention: DataFrame
    errors: DataFrame
    fresh: DataFrame | None


def recognise(
    scans: DataFrame, dictionary: DataFrame, printings: DataFrame, stored: DataFrame, remote: DataFrame, collection: DataFrame,
    strict_db: bool = False,
) -> Outcome:
    """scans (scan_id, text, hash, ..) through all steps; what was matched and resolved is written once.

    fresh are the remote hashes of matched names that are not stored yet, where both tables say
    whether a printing is foil and promo.
    """
    matches = confidence_policy(fuzzy_topk(scans.select("scan_id", "text"), dictionary)).select("scan_id", "name")
    matches = materialize(matches.join(merged(scans.select("scan_id", "hash")), "scan_id"))
    routed = materialize(route(resolve_sets(matches, printings, stored, remote, strict_db)))
    fresh = None
    if {"is_foil", "is_promo"} <= set(remote.columns) & set(stored.columns):
        fresh = new_hashes(remote.join(matches.select("name").distinct(), "name", "left_semi"), stored)
    return Outcome(
        routed, collection_rows(routed, collection, printings), attention_rows(routed, scans.drop("hash")), unmatched(scans, routed), fresh
    )


def log_only(outcome: Outcome) -> DataFrame:
    """What a run without writes reports: scan_id, name, sets as text."""
    return outcome.routed.select("scan_id", "name", F.array_join("sets", ",").alias("sets"))
