"""Layer 1 as expressions: what a field name alone says about the field."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscan.functions.dictionary import (
    FREE_TEXT_MIN_WORDS,
    FREE_TEXT_NAMES,
    name_dictionary,
)
from fieldscan.functions.taxonomy import DEFAULT_TAG, ENTITY_TAG
from fieldscan.functions.text import has_words

NAME_HIT = "struct<down:double,ord:int,entity_type:string,tag:string,score:double>"


def keyword_rows(dictionary=None) -> list[tuple[int, str, str, float, int, str, str]]:
    """Dictionary as rows (ord, entity_type, tag, score, kw_ord, keyword, words)."""
    return [
        (i, entity, ENTITY_TAG.get(entity, DEFAULT_TAG), score, k, keyword, keyword.replace("_", " "))
        for i, (entity, score, keywords) in enumerate(dictionary or name_dictionary())
        for k, keyword in enumerate(keywords)
    ]


def longest_keyword(dictionary=None) -> int:
    return max(len(r[6].split(" ")) for r in keyword_rows(dictionary))


def word_runs(words: Column, longest: int) -> Column:
    """Every run of up to ``longest`` neighbouring words of a name."""
    tokens = F.split(words, " ")

    def runs_from(i: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.size(tokens) - i + 1)),
            lambda n: F.array_join(F.slice(tokens, i, n), " "),
        )

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(tokens)), runs_from))


def keyword_lookup(dictionary=None) -> dict[str, list[dict]]:
    """Hits of each word run that is a keyword."""
    by_words = defaultdict(list)
    for o, entity, tag, score, _, _, kw in keyword_rows(dictionary):
        by_words[kw].append({"down": -score, "ord": o, "entity_type": entity, "tag": tag, "score": score})
    return by_words


def by_length(by_words: dict[str, list[dict]]) -> list[dict[str, list[dict]]]:
    """A map of few keywords for each length: Spark searches a map key by key."""
    return [{w: h for w, h in by_words.items() if len(w) == n} for n in range(max(map(len, by_words), default=0) + 1)]


def name_hits(words: Column, dictionary=None) -> Column:
    """Dictionary hits of a name's words, best score first, one per entity type.

    A single alternation decides whether any keyword occurs; only names that
    pass look their word runs up in the keyword map.
    """
    by_words = keyword_lookup(dictionary)
    # One literal, folded when the plan is made.
    lookup = F.from_json(F.lit(json.dumps(by_length(by_words))), f"array<map<string,array<{NAME_HIT}>>>")
    any_keyword = "(?:^| )(?:" + "|".join(by_words) + ")(?: |$)"
    nothing = F.array().cast(f"array<{NAME_HIT}>")
    found = F.flatten(
        F.transform(
            word_runs(words, longest_keyword(dictionary)),
            lambda run: F.coalesce(F.try_element_at(F.get(lookup, F.length(run)), run), nothing),
        )
    )
    return F.when(words.rlike(any_keyword), F.sort_array(F.array_distinct(found))).otherwise(nothing)


def free_text(words: Column, value: Column, hits: Column) -> Column:
    """Known free-text name; else never when the name hit; else six words or more."""
    names = "(?:^| )(?:" + "|".join(FREE_TEXT_NAMES) + ")(?: |$)"
    return (
        F.when(words.rlike(names), True)
        .when(F.size(hits) > 0, False)
        .otherwise(has_words(value, FREE_TEXT_MIN_WORDS))
    )
