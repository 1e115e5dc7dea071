"""What a query means and which names contradict it, by lexicons of the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, has_phrase, phrases, screen_inches


def intent(query: Column, devices: list[str], accessories: list[str], remedies: list[str]) -> Column:
    """Struct device, accessory, inches, pharmacy. A device beside an accessory is what the accessory is for; a dose makes a remedy of a word."""
    words = phrases(query)
    accessory = has_phrase(words, accessories)
    dose = fold(query).rlike(r"\b[0-9]+([.,][0-9]+)? ?(mg|mcg|ui)\b")
    return F.struct((has_phrase(words, devices) & ~accessory).alias("device"), accessory.alias("accessory"), screen_inches(fold(query)).alias("inches"), (has_phrase(words, remedies) | dose).alias("pharmacy"))


def conflict(meant: Column, name: Column, accessories: list[str], furniture: list[str], homonyms: dict[str, tuple[str, list[str]]] | None = None, query: Column | None = None) -> Column:
    """Why a name is not what was meant: accessory, furniture, made_for, inches, or the label of a homonym; null for no reason.

    homonyms: label -> (a word of the query, phrases of names of the other sense).
    """
    words = phrases(name)
    first = F.get(F.split(F.trim(words), " "), F.lit(0))
    starts = reduce_or([first.rlike("^" + a.replace("*", "[a-z0-9]*") + "$") for a in accessories if " " not in a])
    other = screen_inches(fold(name))
    rules = [
        F.when(meant["device"] & starts, F.lit("accessory")),
        F.when(meant["device"] & has_phrase(words, furniture), F.lit("furniture")),
        F.when(meant["device"] & has_phrase(words, ["para", "compatible con"]) & has_phrase(words, accessories), F.lit("made_for")),
        F.when(meant["inches"].isNotNull() & other.isNotNull() & (meant["inches"] != other), F.lit("inches")),
    ]
    for label, (word, senses) in (homonyms or {}).items():
        rules.append(F.when(has_phrase(phrases(query), [word]) & has_phrase(words, senses), F.lit(label)))
    return F.coalesce(*rules)


def reduce_or(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
