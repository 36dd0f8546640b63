"""License scans by diagonal voting. SQL functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesieve.session import cut

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Opening passages of public license notices, and the labels of the method.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
#: Words of a gram; diagonals up to ``DRIFT`` apart and spans up to ``GAP`` words apart are one.
GRAM, DRIFT, GAP = 3, 3, 8
#: Share of the template's words that a verified span covers, and of its own words that match.
COVERED, DENSE = 0.7, 0.6

#: ``WORD`` with every separator by itself, which the regex engine looks up in one table.
_LISTED = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum() or chr(c).isupper()) + "]+"
#: The same for texts that are not lower-cased.
_COUNTED = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_array(text: Column) -> Column:
    """Words after A-Z are lower-cased; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(low, F.lit(_LISTED), F.lit(0))


def _reach(words: list[str], without: list[str]) -> int:
    """Words of a passage that grams free of the words ``without`` can cover."""
    grams = [range(at, at + GRAM) for at in range(len(words) - GRAM + 1) if not set(words[at : at + GRAM]) & set(without)]
    return len({at for gram in grams for at in gram})


def _may_hold(low: Column, templates) -> Column:
    """False only for lower-cased texts that hold neither a base phrase nor a verified span.

    A span covers ``COVERED`` of its template by grams. Some words are in every such set of
    grams, so all of them must occur; where there is none, one of a few words must.
    """
    test = low.contains("license")
    for _, passage in templates:
        words = re.findall(r"[a-z0-9]+", passage)
        longest = sorted(set(words), key=lambda w: (-len(w), w))
        enough = lambda without: _reach(words, without) < COVERED * len(words)
        needed = [w for w in longest if enough([w])]
        some = next(longest[:n] for n in range(len(longest) + 1) if enough(longest[:n]))
        hold = F.lit(True)
        for word in needed:
            hold = hold & low.contains(word)
        if not needed:
            hold = F.lit(False)
            for word in some:
                hold = hold | low.contains(word)
        test = test | hold
    return test


def _template_grams(spark, templates) -> DataFrame:
    rows = []
    for number, (label, passage) in enumerate(templates):
        words = re.findall(r"[a-z0-9]+", passage)
        rows += [(number, label, len(words), at, *words[at : at + GRAM]) for at in range(len(words) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, t_words int, t_pos int, w0 string, w1 string, w2 string")
    return grams.select(F.xxhash64("w0", "w1", "w2").alias("gram"), "template", "label", "t_words", "t_pos")


def _phrase_places(words: Column) -> Column:
    """Array of structs (pos, label) of the base phrases, only looked for where ``license`` occurs."""
    def at(i: Column, phrase: str) -> Column:
        parts = phrase.split()
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return test

    listed = F.transform(words, lambda w, i: i)
    starts = F.filter(listed, lambda i: F.array_contains(F.array(*[at(i, p) for p in PHRASES]), True))

    def named(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            out = F.when(at(i, phrase), name).otherwise(out)
        return F.struct(i.cast("long").alias("pos"), out.alias("label"))

    return F.when(F.array_contains(words, "license"), F.transform(starts, named))


def verified_spans(words: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, h, label, first, last, coverage) from ``words`` (doc_id, h, words).

    All grams of all texts join the template grams (a fixed list, so it is broadcast).
    Hits vote for (template, diagonal), diagonal being place minus template place;
    neighbouring diagonals merge into spans, and a span is verified by the template words
    that its hits cover and by how densely they stand.
    """
    table = _template_grams(words.sparkSession, templates)
    all_words = F.col("words")
    grams = F.transform(all_words, lambda w, i: F.xxhash64(w, F.get(all_words, i + 1), F.get(all_words, i + 2)))
    rolled = words.where(F.size("words") >= GRAM).select("doc_id", "h", F.posexplode(grams).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(table), "gram").select("doc_id", "h", "template", "label", "t_words", "t_pos", "pos").distinct()
    votes = hits.groupBy("doc_id", "h", "template", "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("seen")
    )
    order = Window.partitionBy("doc_id", "h", "template").orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT) | (F.col("first") - F.lag("last").over(order) > GAP + GRAM)
    votes = votes.withColumn("new", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    spans = votes.groupBy("doc_id", "h", "template", "label", "t_words", "span").agg(
        F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + GRAM - 1)))))
    spans = spans.withColumn("coverage", covered / F.col("t_words")).withColumn("density", covered / (F.col("last") - F.col("first") + 1))
    good = (F.col("coverage") >= COVERED) & (F.col("density") >= DENSE)
    return spans.where(good).select("doc_id", "h", "label", "first", "last", "coverage")


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    ``score`` is 1 with a base phrase, else the best coverage of a verified span, else 0.
    A null or empty text has no words and no labels. Repeated rows give equal results; a
    null id is allowed; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", "text", F.xxhash64(text).alias("h"))
    # most texts hold no license: they are only counted
    suspect = keyed.where(F.exists(F.array(F.lower(text)), lambda low: _may_hold(low, templates)))
    found = cut(
        verified_spans(suspect.select("doc_id", "h", word_array(F.col("text")).alias("words")), templates).groupBy("doc_id", "h")
        .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    )
    n_words = F.size(F.regexp_extract_all(text, F.lit(_COUNTED), F.lit(0))).cast("long")
    words = keyed.select("doc_id", "h", n_words.alias("n_words"), F.when(F.lower(text).contains("license"), word_array(F.col("text"))).alias("words"))
    rows = words.select("doc_id", "h", "n_words", _phrase_places(F.col("words")).alias("base"))
    joined = rows.alias("d").join(found.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.h = s.h"), "left")
    base = F.coalesce("base", F.array().cast("array<struct<pos:bigint,label:string>>"))
    labels = F.array_distinct(base["label"])
    n = F.size(base)
    return joined.select(
        "d.doc_id", "n_words", n.cast("long").alias("n_base"),
        F.when(n > 0, F.get(base, F.lit(0))["pos"]).alias("first_word"), F.when(n > 0, F.get(base, n - 1)["pos"]).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
