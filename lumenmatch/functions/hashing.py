"""Comparison of hexadecimal perceptual hashes, as native column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


@dataclass(frozen=True)
class Profile:
    """Least scores for a match."""

    two: float
    four: float
    string: float


# Stored hashes are held to more than freshly fetched ones.
STORED = Profile(0.92, 0.88, 0.92)
REMOTE = Profile(0.75, 0.70, 0.75)


def slot_score(a: Column, b: Column, n: int) -> Column:
    """Share of equal n-character slots, rounded to 2 places.

    Slot i compares the n characters that end at i, so slot 0 always matches and the last n
    characters are not compared; an odd length can give more than 1. Empty or null is null.
    """
    steps = F.sequence(F.lit(0), F.length(a) - 1, F.lit(n))
    same = lambda i: (i == 0) | (F.substring(a, i - n + 1, F.lit(n)) == F.substring(b, i - n + 1, F.lit(n)))
    hits = F.aggregate(steps, F.lit(0), lambda acc, i: acc + F.when(same(i), 1).otherwise(0))
    return F.when(F.length(a) > 0, F.round(hits / (F.length(a) / n), 2))


def numbered_pairs(text: Column) -> Column:
    """The bigrams of a text without blanks, each with its count so far, so that a multiset is a set of strings."""
    pairs = lambda x: F.sort_array(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2))))
    number = lambda p: F.transform(p, lambda g, i: F.concat(g, (i - F.array_position(p, g)).cast("string")))
    return F.when(F.length(text) > 1, let(let(text, pairs), number)).otherwise(F.array().cast("array<string>"))


def parts(text: Column) -> Column:
    """What a comparison needs of one hash: the text, and its numbered pairs. Made once a hash, before hashes meet."""
    whole = F.regexp_replace(text, r"\s+", "")
    return F.struct(text.alias("text"), whole.alias("whole"), numbered_pairs(whole).alias("pairs"))


def dice_of(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram multisets of two hashes (parts) without blanks, rounded to 2 places."""
    x, y = a["whole"], b["whole"]
    common = F.size(F.array_intersect(a["pairs"], b["pairs"]))
    score = F.when(x == y, 1.0).when((F.length(x) < 2) | (F.length(y) < 2), 0.0)
    return F.round(score.otherwise(2.0 * common / (F.length(x) + F.length(y) - 2)), 2)


def dice(a: Column, b: Column) -> Column:
    return dice_of(parts(a), parts(b))


def compare_parts(a: Column, b: Column) -> list[Column]:
    """The three scores of two hashes (parts), named two, four and string."""
    x, y = a["text"], b["text"]
    return [slot_score(x, y, 2).alias("two"), slot_score(x, y, 4).alias("four"), dice_of(a, b).alias("string")]


def compare(a: Column, b: Column) -> list[Column]:
    return compare_parts(parts(a), parts(b))


def reaches(a: Column, b: Column, profile: Profile) -> Column:
    """Whether the scores of two hashes (parts) reach the profile; the dearest is worked out only where the others do."""
    cheap = (slot_score(a["text"], b["text"], 2) >= profile.two) & (slot_score(a["text"], b["text"], 4) >= profile.four)
    return F.coalesce(F.when(cheap, dice_of(a, b) >= profile.string), F.lit(False))


def bands(text: Column, size: Column, profile: Profile) -> Column:
    """Pieces of a hash of which one must be equal in any that matches a hash of size characters: array<string>.

    A score of profile.two leaves at most so many 2-character slots that differ; with one piece
    more than that, one piece has none of them. The first slot always matches, so it is in no
    piece. Where more slots may differ than are compared, the only piece is empty.
    """
    slots = F.ceil(size / 2).cast("int") - 1
    differ = slots + 1 - F.ceil((F.lit(profile.two) - 0.005) * size / 2 - 1e-9).cast("int")
    n = F.when(differ >= slots, F.lit(1)).otherwise(differ + 1)
    first = lambda k: F.floor(k * slots / n).cast("int")
    piece = lambda k: F.substring(text, 2 * first(k) + 1, 2 * (first(k + 1) - first(k)))
    some = F.transform(F.sequence(F.lit(0), n - 1), piece)
    return F.when(size > 0, F.when(differ >= slots, F.array(F.lit(""))).otherwise(some))


def sign_hash(vector: Column, bits: int = 64) -> Column:
    """Hexadecimal hash of the signs of a vector, four per digit, first sign highest."""
    bit = lambda k: F.when(F.get(vector, k) > 0, F.lit(1)).otherwise(0)
    digit = lambda i: F.lower(F.hex((bit(i * 4) * 8 + bit(i * 4 + 1) * 4 + bit(i * 4 + 2) * 2 + bit(i * 4 + 3)).cast("long")))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bits // 4 - 1)), digit), "")
