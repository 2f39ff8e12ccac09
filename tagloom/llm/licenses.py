"""License scan as an exact set-similarity join of text blocks with notice templates.

A block is a window of 2w words that starts at a multiple of w; w is the template's length, rounded up to a power of two,
so every passage as long as the template lies whole in a block. A block meets a template that has at least PERCENT of its
distinct words inside. Words are ordered by document frequency, rarest first: a block that meets a template shares one of
the template's first n - a + 1 words (a words are needed), and one of its own first m - a + 1. Blocks without a template's
prefix word are never formed; the others meet templates by a hash join on prefix words, pass the length filter (m >= a)
and the positional filter (what both still have from the shared word on is enough), and are counted on their full sets.
Words outside the templates cannot count, so a block's set holds template words only. Nothing is capped.

The template list is a parameter of bounded size: it is sent to every task, and more than MAX_TEMPLATE_WORDS words are an
error. Native columns only; the driver reads one document frequency per template word.

Null and empty texts, and texts without words, have no labels and a score of 0. Rows that repeat an id are scanned each by
themselves; null ids stay. An empty table gives an empty result. Kept columns come in one struct, so none can clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

PERCENT = 90
LEAST_WIDTH = 8
MAX_TEMPLATE_WORDS = 20_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words, and the phrases found word by word.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]
# Wording of common notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("no-warranty", "The software is provided as is, without warranty of any kind, express or implied"),
]


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]  # distinct, rarest first once ordered
    width: int
    need: int


def words_in(text: Column) -> Column:
    """Lower-case words of a text in order; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BREAKS), lambda w: w != "")


def read_templates(templates: list[tuple[str, str]], percent: int) -> list[Template]:
    table_of = str.maketrans(CAPITALS, SMALL)
    out = []
    for label, text in templates:
        # Characters beyond ASCII belong to words.
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.translate(table_of)).split(" ")
        words = [w for w in words if w]
        distinct = tuple(dict.fromkeys(words))
        if distinct:
            width = max(LEAST_WIDTH, 1 << (len(words) - 1).bit_length())
            out.append(Template(label, distinct, width, -(-percent * len(distinct) // 100)))
    if sum(len(t.words) for t in out) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: split the list")
    return out


def _texts(words: list[str]) -> Column:
    return F.lit(words) if words else F.array().cast("array<string>")


def frequency_order(docs: DataFrame, text: str, templates: list[Template]) -> list[str]:
    """All words of the templates by document frequency, rarest first; ties by the word itself."""
    known = sorted({w for t in templates for w in t.words})
    seen = docs.select(F.explode(F.array_intersect(words_in(F.col(text)), _texts(known))).alias("word"))
    counts = {r["word"]: r["docs"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def in_order(templates: list[Template], order: list[str]) -> list[Template]:
    place = {w: n for n, w in enumerate(order)}
    return [t._replace(words=tuple(sorted(t.words, key=place.__getitem__))) for t in templates]


def _prefix(t: Template) -> tuple[str, ...]:
    return t.words[: len(t.words) - t.need + 1]


def _blocks(words: Column, found: Column, templates: list[Template], order: list[str], width: int) -> Column:
    """Blocks of one width that hold a prefix word: (width, block, words of templates, rarest first)."""
    some = [t for t in templates if t.width == width]
    prefix = sorted({w for t in some for w in _prefix(t)})
    mine = F.array_intersect(found, _texts(prefix))
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(mine, F.get(words, i)))
    cell = lambda i: F.floor(i / width).cast("int")
    numbers = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.greatest(cell(i) - 1, F.lit(0)), cell(i)))))
    ranked = _texts([w for w in order if any(w in t.words for t in some)])
    block = lambda b: F.struct(
        F.lit(width).alias("width"), b.alias("block"), F.array_intersect(ranked, F.slice(words, b * width + 1, F.lit(2 * width))).alias("words")
    )
    none = F.array().cast("array<struct<width:int,block:int,words:array<string>>>")
    least = min(t.need for t in some)
    return F.when(F.size(mine) == 0, none).otherwise(F.filter(F.transform(numbers, block), lambda b: F.size(b["words"]) >= least))


def phrase_places(words: Column, joined: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand, from word 0; `joined` are the words with single spaces, also around them."""
    here = lambda i: F.get(words, i) == phrase[0]
    for k in range(1, len(phrase)):
        here = lambda i, k=k, before=here: before(i) & (F.get(words, i + k) == phrase[k])
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(here(i), F.lit(False)))
    return F.when(F.contains(joined, F.lit(f" {' '.join(phrase)} ")), places).otherwise(F.array().cast("array<int>"))


def scanned(docs: DataFrame, templates: list[Template], order: list[str], text: str, keep: list[str]) -> DataFrame:
    """A written table: row_key, row (the kept columns), n_words, one array of places per phrase, and the blocks to compare."""
    parts = docs.select(F.struct(*keep).alias("row"), words_in(F.col(text)).alias("words"))
    prefix = sorted({w for t in templates for w in _prefix(t)})
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    parts = parts.select("row", "words", joined.alias("joined"), F.array_intersect("words", _texts(prefix)).alias("found"))
    words, found = F.col("words"), F.col("found")
    blocks = [_blocks(words, found, templates, order, width) for width in sorted({t.width for t in templates})]
    none = F.array().cast("array<struct<width:int,block:int,words:array<string>>>")
    rows = parts.select(
        F.monotonically_increasing_id().alias("row_key"), "row", F.size(words).cast("long").alias("n_words"),
        *(phrase_places(words, F.col("joined"), phrase).alias(f"at_{n}") for n, (_, phrase) in enumerate(PHRASES)),
        (F.when(F.size(found) > 0, F.concat(*blocks)).otherwise(none) if blocks else none).alias("blocks"),
    )
    return cut_lineage(rows, "license-blocks")


def matching_blocks(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(row_key, template, label, first_word, n_shared, containment): every block that meets a template."""
    spark = rows.sparkSession
    # Templates are a parameter of at most MAX_TEMPLATE_WORDS words.
    entries = [(n, t.label, t.width, list(t.words), t.need, i, w) for n, t in enumerate(templates) for i, w in enumerate(_prefix(t))]
    schema = "template int, label string, t_width int, t_words array<string>, need int, i int, t_word string"
    index = F.broadcast(spark.createDataFrame(entries, schema))
    blocks = rows.select("row_key", F.explode("blocks").alias("b")).select("row_key", "b.width", "b.block", F.col("b.words").alias("words"))
    # Every template of a width needs `least` words at least, so no shared prefix word lies further back.
    needs = {t.width: min(u.need for u in templates if u.width == t.width) for t in templates}
    least = F.coalesce(*(F.when(F.col("width") == w, F.lit(n)) for w, n in needs.items())) if needs else F.lit(1)
    probes = blocks.select("*", F.posexplode(F.slice("words", F.lit(1), F.size("words") - least + 1)).alias("j", "word"))
    left = F.least(F.size("t_words") - F.col("i"), F.size("words") - F.col("j"))
    met = probes.join(index, (F.col("word") == F.col("t_word")) & (F.col("width") == F.col("t_width")))
    met = met.filter((F.size("words") >= F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("words", "t_words"))
    counted = met.select("row_key", "template", "label", (F.col("block") * F.col("width")).cast("long").alias("first_word"), "need", shared.alias("n_shared"), F.size("t_words").alias("n"))
    return counted.filter("n_shared >= need").select("row_key", "template", "label", "first_word", "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")).distinct()


def find_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """row, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score of each row of docs."""
    known = read_templates(TEMPLATES if templates is None else templates, percent)
    order = frequency_order(docs, text, known)
    known = in_order(known, order)
    rows = scanned(docs, known, order, text, keep or ["doc_id"])
    best = matching_blocks(rows, known).groupBy("row_key").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
    places = F.concat(*(F.col(f"at_{n}") for n in range(len(PHRASES))))
    base = F.sort_array(F.filter(F.array(*(F.when(F.size(f"at_{n}") > 0, F.lit(label)) for n, (label, _) in enumerate(PHRASES))), lambda x: x.isNotNull()))
    flat = rows.select("row_key", "row", "n_words", places.alias("places"), base.alias("base_labels")).join(best, "row_key", "left")
    return flat.select(
        "row", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base_labels",
        F.sort_array(F.array_union("base_labels", F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{t.label}', {quote(t.words)}, {t.width}, {t.need})" for t in read_templates(TEMPLATES, PERCENT))
    phrases = ", ".join(f"('{label}', {quote(words)})" for label, words in PHRASES)
    return rf"""
    WITH w AS MATERIALIZED (
      SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{BREAKS}'), lambda x: x <> '') AS words FROM documents
    ), t(label, need_words, width, need) AS (VALUES {rows}), p(label, phrase) AS (VALUES {phrases}),
    b AS (
      SELECT k, width, list_distinct(words[i * width + 1:i * width + 2 * width]) AS block
      FROM (SELECT k, width, words, unnest(range((len(words) + width - 1) // width)) AS i FROM w, (SELECT DISTINCT width FROM t))
    ), met AS (
      SELECT k, label, max(len(list_intersect(block, need_words)) / len(need_words)) AS c
      FROM b JOIN t USING (width) WHERE len(list_intersect(block, need_words)) >= need GROUP BY k, label
    ), base AS (
      SELECT k, label, i FROM (SELECT k, words, label, phrase, unnest(range(len(words))) AS i FROM w, p) WHERE words[i + 1:i + len(phrase)] = phrase
    ), sums AS (SELECT k, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY k),
    both_ AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM (SELECT k, label, c FROM met UNION ALL SELECT k, label, 1.0 FROM base) GROUP BY k)
    SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(sums.labels, '') AS base_labels,
           coalesce(both_.labels, '') AS labels, coalesce(c, 0)::DOUBLE AS score
    FROM w LEFT JOIN sums USING (k) LEFT JOIN both_ USING (k)
    """


@query("op11_license_notices", _sql())
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
