"""License scans: phrases at word positions, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions.binding import let
from thermocline.llm.common import stored

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of public license notices and their labels.
TEMPLATES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0",
    "This library is free software under the GNU Lesser General Public License": "lgpl",
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This is free and unencumbered software released into the public domain": "unlicense",
}
CONTAINMENT = 0.8
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN), "")


def _words(template: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in template.lower()).split()


def _tokens(template: str) -> list[str]:
    return sorted(set(_words(template)))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(words: Column) -> Column:
    """(start, label) wherever a phrase's words stand consecutively; texts without a rare word of theirs are not searched."""
    empty = F.array().cast("array<struct<at:int,label:string>>")

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split()
        at = F.transform(words, lambda w, i: F.when(w == parts[0], i))
        here = F.filter(
            at, lambda i: i.isNotNull() & F.forall(F.array(*[F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts) if k]), lambda x: x)
        )
        return F.transform(here, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = F.concat(*[starts(p, label) for p, label in PHRASES.items()])
    return F.when(F.array_contains(words, "license") | F.array_contains(words, "cc"), found).otherwise(empty)


def _blocks(docs: DataFrame, vocabulary: list[str], least: int, run: int) -> DataFrame:
    """Windows of ``2 * run`` words, ``run`` apart, over whole texts, so that each run of ``run`` words lies in one, over line breaks too.

    ``p`` holds the template tokens of a window with their places; windows with fewer than ``least`` different ones are left out.
    """

    def window(words: Column, k: Column) -> Column:
        placed = F.transform(F.slice(words, k * run + 1, 2 * run), lambda w, i: F.struct(w.alias("token"), i.alias("at")))
        return F.filter(placed, lambda p: p["token"].isin(*vocabulary))

    def windows(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(words) / run).cast("int") - 2)
        return F.transform(F.sequence(F.lit(0), last), lambda k: window(words, k))

    held = F.filter(let(license_words(F.col("text")), windows), lambda p: F.size(F.array_distinct(p["token"])) >= least)
    return docs.select("_row", F.posexplode(held).alias("block", "p"))


def similar_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``_row``, ``label``, ``containment`` of every template that a block of text holds to that share, by an exact join.

    A block is any run of consecutive words of a text, twice as long as the template, wherever lines break; the share is that of
    the template's distinct words. Words outside all templates cannot match and are left out. The join is made on overlapping
    windows that hold all blocks: their tokens are ordered by the number of windows in the corpus, rarest first. With o the
    least overlap, a window must hold o template tokens (length filter), share a token of the first |t| - o + 1 of the template and
    |b| - o + 1 of its own (prefix filter), with enough tokens left after it on both sides (positional filter); the pairs that
    remain are verified, first in the window, then in its blocks. Templates are a parameter of some dozen rows.
    """
    spark = docs.sparkSession
    sets = [(k, label, _tokens(t), 2 * len(_words(t))) for k, (t, label) in enumerate(templates.items())]
    overlap = {k: max(1, math.ceil(containment * len(tokens) - 1e-9)) for k, _, tokens, _ in sets}
    vocabulary = sorted({t for _, _, tokens, _ in sets for t in tokens})
    least = min(overlap.values())
    blocks = stored(_blocks(docs, vocabulary, least, max(run for *_, run in sets)), "license-blocks")
    tokens_of = blocks.select(F.explode(F.array_distinct("p.token")).alias("token"))
    often = {row["token"]: row["n"] for row in tokens_of.groupBy("token").agg(F.count("*").alias("n")).collect()}  # template tokens only
    order = sorted(vocabulary, key=lambda t: (often.get(t, 0), t))
    rank = {t: k for k, t in enumerate(order)}
    prefixes, full = [], []
    for k, label, tokens, run in sets:
        arranged = sorted(tokens, key=rank.__getitem__)
        full.append((k, label, arranged, len(arranged), overlap[k], run))
        prefixes += [(k, t, at) for at, t in enumerate(arranged[: len(arranged) - overlap[k] + 1])]
    firsts = F.broadcast(spark.createDataFrame(prefixes, "template int, token string, t_at int"))
    whole = F.broadcast(spark.createDataFrame(full, "template int, label string, t array<string>, t_size int, least int, run int"))
    arranged = blocks.withColumn("b", F.array_intersect(_strings(order), F.col("p.token")))
    listed = arranged.select("_row", "p", "b", F.posexplode("b").alias("b_at", "token")).where(F.col("b_at") <= F.size("b") - least)
    candidates = (
        listed.join(firsts, "token").join(whole, "template")
        .where(F.size("b") >= F.col("least"))
        .where(F.col("b_at") <= F.size("b") - F.col("least"))
        .where(1 + F.least(F.col("t_size") - F.col("t_at"), F.size("b") - F.col("b_at")) - 1 >= F.col("least"))
    )

    def shared_from(start: Column) -> Column:
        """Template words in the block that starts at a token of the window."""
        ahead = F.filter("p", lambda p: (p["at"] >= start["at"]) & (p["at"] < start["at"] + F.col("run")))
        return F.size(F.array_intersect("t", F.transform(ahead, lambda p: p["token"])))

    in_window = candidates.where(F.size(F.array_intersect("b", "t")) >= F.col("least"))
    return (
        in_window.withColumn("_shared", F.array_max(F.transform("p", shared_from))).where(F.col("_shared") >= F.col("least"))
        .select("_row", "label", (F.col("_shared") / F.col("t_size")).alias("containment"))
        .distinct()
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is 1 where a phrase stands and else the highest containment of a template in a block, or 0. Null and empty texts have no
    words and empty labels. Repeats of a row (same ``doc_id`` and text) get the same result, one row each. An empty
    table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
    """
    row = F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", "text", row.alias("_row"))
    similar = similar_blocks(rows).groupBy("_row").agg(F.collect_set("label").alias("_similar"), F.max("containment").alias("_share"))
    scanned = rows.withColumn("_found", let(license_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _places(w).alias("places"))))
    base = scanned.select(
        "doc_id", "_row", F.col("_found.n").alias("n_words"), F.size("_found.places").cast("long").alias("n_base"),
        F.array_min(F.col("_found.places.at")).cast("long").alias("first_word"), F.array_max(F.col("_found.places.at")).cast("long").alias("last_word"),
        F.array_distinct(F.col("_found.places.label")).alias("_labels"),
    )
    every = F.array_union("_labels", F.coalesce("_similar", F.array().cast("array<string>")))
    return base.join(stored(similar, "license-hits"), "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("_labels"), ",").alias("base_labels"),
        F.array_join(F.sort_array(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
