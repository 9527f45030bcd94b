"""Licence notices by an exact set-similarity join of text blocks and templates.

Only DataFrame functions run here. A text's words are cut into blocks of ``2 * STRIDE`` words, one every ``STRIDE``
words. A template is a set of words with a containment threshold: a block matches if it holds at least
``need = ceil(threshold * size)`` of them. Words are ordered by how many documents hold them, rarest first (words of no
template never match and come last), and a pair is only looked at if it passes

* the prefix filter: the block holds one of the template's first ``size - need + 1`` words,
* the length filter: the block holds at least ``need`` words of the templates' vocabulary,
* the positional filter: from the word that met, enough words are left on both sides.

Every pair over the threshold passes all three. Templates that are phrases (threshold 1) are then checked for places
where their words stand consecutively.

Defined cases: only A-Z are lower-cased; null texts have no words and no matches; every input row gives one row, repeated rows repeated ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bound_to, lowered

STRIDE = 64
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # its words must stand consecutively

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(self.text.split())

    @property
    def need(self) -> int:
        size = len(set(self.words))
        return size if self.phrase else math.ceil(THRESHOLD * size)


PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
NOTICES = [
    Template("apache-2.0-notice", "licensed under the apache license version 2 0"),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-4.0-notice", "this work is licensed under cc by 4 0"),
    Template("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_order(docs: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words, those of the fewest documents first; as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.filter(words(F.col("text")), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _index(spark: SparkSession, templates: list[Template], order: dict[str, int]) -> tuple[DataFrame, set[str]]:
    """A row for every word of a template's prefix."""
    rows, prefixes = [], set()
    for number, t in enumerate(templates):
        ranked = sorted({order[w] for w in t.words})
        for i, rank in enumerate(ranked[: len(ranked) - t.need + 1]):
            rows.append((rank, number, i, t.need, ranked, list(t.words) if t.phrase else None))
        prefixes |= {w for w in t.words if order[w] in ranked[: len(ranked) - t.need + 1]}
    schema = "rank int, template int, i int, need int, ranks array<int>, phrase array<string>"
    return spark.createDataFrame(rows, schema), prefixes


def scan(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Matches of docs (doc_id, text): _row, doc_id, n_words, block, template, contained, places.

    Every row of ``docs`` appears at least once; without a match ``template`` is null. ``places`` are the word
    numbers where a phrase stands.
    """
    order = {w: k for k, w in enumerate(word_order(docs, templates))}
    index, prefixes = _index(docs.sparkSession, templates, order)
    vocabulary, met = sorted(order), sorted(prefixes)

    def blocks(w: Column) -> Column:
        hits = F.transform(F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(met)), lambda s: F.floor(s["i"] / STRIDE).cast("int"))
        near = bound_to(hits, lambda h: F.filter(F.array_distinct(F.concat(h, F.transform(h, lambda b: b - 1))), lambda b: b >= 0))
        return F.struct(F.size(w).cast("bigint").alias("n"), F.transform(near, lambda b: F.struct(b.alias("block"), F.slice(w, b * STRIDE + 1, 2 * STRIDE).alias("w"))).alias("blocks"))

    found = F.when(F.col("text").isNotNull(), bound_to(words(F.col("text")), blocks))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", found.alias("f"))
    rows = rows.select("_row", "doc_id", F.coalesce("f.n", F.lit(0)).alias("n_words"), F.explode_outer("f.blocks").alias("b"))
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    ranked = F.array_sort(F.array_distinct(F.transform(F.filter("b.w", lambda x: x.isin(vocabulary)), lambda x: F.element_at(ranks, x))))
    rows = rows.withColumn("own", ranked).select("*", F.posexplode_outer("own").alias("j", "rank"))
    left = lambda s, k: F.size(s) - F.col(k)
    # the index has a row for each word of the templates' prefixes
    joined = rows.join(F.broadcast(index), "rank", "left")
    passes = (F.size("own") >= F.col("need")) & (F.least(left("ranks", "i"), left("own", "j")) >= F.col("need"))
    shared = F.when(passes, F.size(F.array_intersect("own", "ranks")))
    joined = joined.withColumn("template", F.when(shared >= F.col("need"), F.col("template")))
    size = F.size("phrase")
    starts = F.filter(F.sequence(F.lit(0), F.lit(STRIDE - 1)), lambda q: F.slice("b.w", q + 1, size) == F.col("phrase"))
    places = F.when(F.col("template").isNotNull() & F.col("phrase").isNotNull(), F.transform(starts, lambda q: (F.col("b.block") * STRIDE + q).cast("bigint")))
    contained = F.when(F.col("template").isNotNull(), shared / F.size("ranks"))
    return joined.select("_row", "doc_id", "n_words", F.col("b.block").alias("block"), "template", contained.alias("contained"), places.alias("places"))


def licences(docs: DataFrame, phrases: list[Template] = PHRASES, notices: list[Template] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``.

    A phrase counts where its words stand consecutively, a notice where a block reaches its threshold; ``score`` is the largest
    containment that counts.
    """
    templates = phrases + notices
    rows = scan(docs, templates)
    is_phrase = F.col("template") < len(phrases)
    counts = F.when(is_phrase, F.size("places") > 0).otherwise(F.col("template").isNotNull())
    flag = lambda numbers: F.max(counts & F.col("template").isin(numbers))
    by_label: dict[str, list[int]] = {}
    for number, t in enumerate(templates):
        by_label.setdefault(t.label, []).append(number)
    base = sorted({t.label for t in phrases})
    every = sorted(by_label)
    found = rows.groupBy("_row", "doc_id", "n_words").agg(
        F.sum(F.when(is_phrase, F.size("places"))).alias("n_base"),
        F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        F.max(F.when(counts, F.col("contained"))).alias("score"),
        *[flag(by_label[x]).alias(f"has_{k}") for k, x in enumerate(every)],
    )
    joined = lambda names: F.concat_ws(",", *[F.when(F.col(f"has_{every.index(x)}"), F.lit(x)) for x in names])
    return found.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        joined(base).alias("base_labels"), joined(every).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
