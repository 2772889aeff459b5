"""Rules over titles and review texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words, their grouping and their order decide the results.
REVIEW_KEYWORDS = (
    "quality", "shipping", "fast", "slow", "good", "bad", "excellent",
    "terrible", "recommend", "worth", "price", "cheap", "expensive",
    "durable", "fragile", "easy", "difficult", "customer service",
)
CATEGORY_KEYWORDS = {
    "electronics": ("phone", "computer", "electronic", "tech", "digital", "wireless", "bluetooth"),
    "clothing": ("shirt", "dress", "pants", "shoes", "jacket", "fashion", "wear"),
    "home": ("furniture", "decoration", "kitchen", "bedroom", "living", "home"),
    "beauty": ("makeup", "skincare", "beauty", "cosmetic", "perfume", "hair"),
    "sports": ("fitness", "sport", "exercise", "gym", "outdoor", "athletic"),
    "automotive": ("car", "auto", "vehicle", "motor", "engine", "automotive"),
    "toys": ("toy", "game", "children", "kids", "play", "educational"),
    "jewelry": ("ring", "necklace", "bracelet", "jewelry", "gold", "silver"),
}
SEASON_KEYWORDS = {
    "halloween": ("halloween", "spooky", "costume", "pumpkin", "ghost", "witch"),
    "christmas": ("christmas", "holiday", "gift", "santa", "tree", "ornament"),
    "summer": ("summer", "beach", "swim", "vacation", "hot", "sunny"),
    "winter": ("winter", "cold", "snow", "warm", "coat", "heater"),
    "spring": ("spring", "flower", "garden", "fresh", "renewal"),
    "fall": ("fall", "autumn", "harvest", "leaves", "cozy"),
}
HAN = "\u4e00-\u9fff"
HAN_SHARE = 0.3
CYRILLIC = "а-яё"
SPANISH = "áéíóúñ"
FRENCH = "àâäéèêëïîôöùûüÿç"
# End of the fixed values.


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def language(text: Column, lowered: Column) -> Column:
    """Language from the script; classes are tested in a fixed order."""
    han = F.length(text) - F.length(F.regexp_replace(text, f"[{HAN}]", ""))
    return (
        F.when(han > F.length(text) * F.lit(HAN_SHARE), F.lit("zh"))
        .when(lowered.rlike(f"[{CYRILLIC}]"), F.lit("ru"))
        .when(lowered.rlike(f"[{SPANISH}]"), F.lit("es"))
        .when(lowered.rlike(f"[{FRENCH}]"), F.lit("fr"))
        .otherwise(F.lit("en"))
    )


def _words(words: Sequence[str]) -> Column:
    """The words as one constant array.

    Tests run over it as lambda functions: written out one by one they make a
    generated method of over 8,000 bytes, which the JVM never compiles.
    """
    return F.array(*map(F.lit, words)).cast("array<string>")


def present(lowered: Column, words: Sequence[str]) -> Column:
    """Those of ``words`` that occur anywhere in the text, in the given order."""
    return F.filter(_words(words), lambda word: lowered.contains(word))


def key_phrases(lowered: Column, words: Sequence[str] = REVIEW_KEYWORDS, most: int | None = None) -> Column:
    found = present(lowered, words)
    return found if most is None else F.slice(found, 1, most)


def season_tags(lowered: Column, seasons: Mapping[str, Sequence[str]] = SEASON_KEYWORDS) -> Column:
    """Seasons with at least one keyword in the text, in catalogue order."""
    marks = (
        F.when(F.exists(_words(words), lambda word: lowered.contains(word)), F.lit(season)).otherwise(F.lit(""))
        for season, words in seasons.items()
    )
    return F.array_remove(F.array(*marks), "")


def keyword_counts(lowered: Column, words: Sequence[str]) -> Column:
    """How many different words of the list occur in the text."""
    return F.when(lowered.isNotNull(), F.size(present(lowered, words)))
