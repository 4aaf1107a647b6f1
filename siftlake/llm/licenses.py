"""Licence scan with a positional index of rare words.

The index maps each licence word to its places in the templates. A text is searched for the
words that are rarest in the corpus; every hit votes for the template and the start that its places imply,
and a start counts once all of the template's key phrases stand where they should.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence notice as words. ``keys`` are (start, length) of phrases that must be there in full."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]

    @staticmethod
    def of(label: str, notice: str) -> Template:
        """Words in brackets form the key phrases; the others only raise the score."""
        words, keys, start = [], [], None
        for word in notice.replace("[", " [ ").replace("]", " ] ").split():
            if word == "[":
                start = len(words)
            elif word == "]":
                keys.append((start, len(words) - start))
            else:
                words.append(word)
        return Template(label, tuple(words), tuple(keys))


# Phrases whose places are counted, with their labels.
PHRASES = (
    Template.of("mit", "[under the mit license]"),
    Template.of("apache-2", "[apache license version 2]"),
    Template.of("cc-by-nc", "[cc by nc]"),
)
# Notices with words that may differ around their key phrases.
NOTICES = (
    Template.of("mit", "[permission is hereby granted] free of charge to any person obtaining a copy of this software"),
    Template.of("apache-2", "licensed under the [apache license] version [2 0]"),
    Template.of("gpl", "this work is licensed under the [gnu general public license] version 3"),
    Template.of("lgpl", "under the terms of the [gnu lesser general public license] version"),
    Template.of("agpl", "under the terms of the [gnu affero general public license] version"),
    Template.of("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    Template.of("mpl-2", "subject to the terms of the [mozilla public license] v [2 0]"),
    Template.of("cc-by-sa", "this work is licensed under [cc by sa] 4 0"),
    Template.of("isc", "[permission to use copy modify] and or [distribute this software] for any purpose"),
    Template.of("all-rights-reserved", "[all rights reserved]"),
)
# A template is looked up by so many of its rarest words.
RARE_WORDS = 2


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(value) for value in values))


def text_words(text: Column) -> Column:
    """Words of a text, with A-Z alone lower-cased; NULL has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def word_frequencies(docs: DataFrame, words: Sequence[str], text_column: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each of the given words stands, and the number of all documents.

    One pass over all texts; the result has one row per word of the templates.
    """
    found = docs.select(F.array_intersect(text_words(F.col(text_column)), _strings(words)).alias("found"))
    rows = found.select(F.explode(F.concat("found", F.array(F.lit(" ")))).alias("word")).groupBy("word").count().collect()
    counts = {row["word"]: row["count"] for row in rows}
    return {word: counts.get(word, 0) for word in words}, counts.get(" ", 0)


def _rare_places(template: Template, rank: dict[str, tuple]) -> list[int]:
    """The place of the rarest word in each key phrase, and of the template's rarest words up to RARE_WORDS."""
    inside = {at for start, length in template.keys for at in range(start, start + length)}
    places = [min(range(start, start + length), key=lambda at: rank[template.words[at]]) for start, length in template.keys]
    rest = sorted(inside - set(places), key=lambda at: rank[template.words[at]])
    return sorted(set(places) | set(rest[: max(0, RARE_WORDS - len(places))]))


def license_hits(
    docs: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words`` and ``hits``, an array of (template, start, score).

    ``template`` is the number in ``templates`` and ``start`` the word, from 0, at which it would begin (negative if
    the text begins within it). ``score`` is the share of the template's words, weighted by their
    inverse document frequency over the whole corpus, that stand in their places: 1 if all do.

    * Rare words are chosen by a count over all documents, so a frequent word is never looked up if
      a rarer one is part of the same phrase.
    * The postings of a template's rare words are intersected by relative position: a start needs the votes of all of them.
    * Then all words of the key phrases are compared. A phrase that stands in a text contains its
      rare words, so none is missed.

    Both passes are narrow, and nothing is shuffled but the word counts. Time is linear in a text's words and
    votes, but for the sort of the votes. NULL and empty texts have no words or hits, an empty table gives no rows, rows that
    repeat are each a row of the result, and other columns are ignored. Of templates that begin at one word all are hits.
    """
    words = sorted({word for template in templates for word in template.words})
    counts, total = word_frequencies(docs, words, text_column)
    rank = {word: (counts[word], word) for word in words}
    places = [_rare_places(template, rank) for template in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, (template, chosen) in enumerate(zip(templates, places)):
        for at in chosen:
            postings.setdefault(template.words[at], []).append((number, at))

    idf = {word: f"{_idf(counts[word], total):.17g}D" for word in words}
    rare = sorted(postings)
    source = docs.select(F.col(id_column).alias("doc_id"), text_words(F.col(text_column)).alias("words"))
    # Only texts that hold a rare word at all are looked at any further.
    source = source.withColumn("has_rare", F.arrays_overlap("words", _strings(rare)))
    index = "map(" + ", ".join(
        f"'{word}', array(" + ", ".join(f"struct({number} as template, {at} as at)" for number, at in postings[word]) + ")"
        for word in rare
    ) + ")"
    votes = (
        "flatten(filter(transform(words, (word, place) -> transform(index[word], "
        "p -> struct(p.template as template, place - p.at as start))), found -> found is not null))"
    )
    source = source.withColumn("index", F.expr(f"case when has_rare then {index} end"))
    source = source.withColumn("votes", F.expr(f"case when has_rare then sort_array({votes}) end")).drop("index")
    # Equal votes lie together, and a start gets no more votes than its template has rare words, so it has all of
    # them if the vote that many places on is the same.
    needed = "array(" + ", ".join(str(len(chosen)) for chosen in places) + ")"
    run = f"get(votes, i + get({needed}, v.template) - 1) = v"
    agreed = f"filter(transform(votes, (v, i) -> if({run} and not (get(votes, i - 1) <=> v), v, null)), v -> v is not null)"
    source = source.withColumn("starts", F.expr(agreed))
    verified = " ".join(f"when {number} then {_keys_sql(template)}" for number, template in enumerate(templates))
    scored = " ".join(f"when {number} then {_score_sql(template, idf)}" for number, template in enumerate(templates))
    hits = (
        f"transform(filter(starts, s -> case s.template {verified} end), "
        f"s -> struct(s.template as template, s.start as start, case s.template {scored} end as score))"
    )
    none = "cast(array() as array<struct<template:int,start:int,score:double>>)"
    return source.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(f"coalesce({hits}, {none})").alias("hits"))


def _idf(count: int, total: int) -> float:
    return log((total + 1) / (count + 1)) + 1e-3


def _word_sql(at: int) -> str:
    return f"(s.start + {at} >= 0 and get(words, s.start + {at})"


def _keys_sql(template: Template) -> str:
    inside = [at for start, length in template.keys for at in range(start, start + length)]
    return "(" + " and ".join(f"coalesce({_word_sql(at)} = '{template.words[at]}'), false)" for at in inside) + ")"


def _score_sql(template: Template, idf: dict[str, str]) -> str:
    total = " + ".join(idf[word] for word in template.words)
    found = " + ".join(
        f"if(coalesce({_word_sql(at)} = '{word}'), false), {idf[word]}, 0D)" for at, word in enumerate(template.words)
    )
    return f"({found}) / ({total})"


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: places and labels of the base phrases, all labels, and the best score."""
    base = len(PHRASES)
    labels = "array(" + ", ".join(f"'{template.label}'" for template in PHRASES + NOTICES) + ")"
    hits = license_hits(docs).withColumn("base", F.expr(f"filter(hits, h -> h.template < {base})"))
    joined = "array_join(array_sort(array_distinct(transform({hits}, h -> get({labels}, h.template)))), ',')"
    return hits.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(base, h -> h.start)) as long)").alias("first_word"),
        F.expr("cast(array_max(transform(base, h -> h.start)) as long)").alias("last_word"),
        F.expr(joined.format(hits="base", labels=labels)).alias("base_labels"),
        F.expr(joined.format(hits="hits", labels=labels)).alias("labels"),
        F.expr("least(1D, coalesce(array_max(transform(hits, h -> h.score)), 0D))").alias("score"),
    )
