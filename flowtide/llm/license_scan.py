"""Licence scan: a trained paragraph classifier, with an unknown class and template comparison, JVM-side throughout.

A paragraph is a line, or a run of lines between blank lines (for wrapped notices; its number is its first line's). All
are scored. Its word 1- to 3-grams are hashed into a sparse vector, and a multinomial logistic regression
gives each family a probability. It is trained on the templates below, on all their windows of half the words or more
(so that cut and framed notices are seen), and on ``NEGATIVES`` paragraphs, out of some as many different texts, as the class ``unknown``.

A fifth of the training rows calibrates: a logistic curve maps the margin between the best family and ``unknown`` to
the probability that a paragraph holds a notice. A paragraph at ``KNOWN`` or more is compared with its family's
templates: the share of a template's words, in order of its 2-grams, that the paragraph holds confirms the prediction
from ``CONFIRM`` on. What is predicted but not confirmed is returned too, marked so.

Each word goes through the grams and hashes once for all texts: line by line. From the lines' sets follows an upper bound
of the score of each line and run (see ``LicenseModel.possible``). Only texts that hold a paragraph whose bound reaches ``KNOWN``
are scored whole; the others have no paragraph that could be found.

Of a run and its lines, the run is left out where a line is confirmed for its family, or is found and the run is not
confirmed either.

Defined results: null and empty texts have no paragraphs. Repeated rows are scanned each on its own. With an empty
corpus the model is trained on the templates alone and nothing is returned. Extra columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.llm.common import lower_words, small, stored

# Short notices of public licences, by family.
TEMPLATES = (
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
)
UNKNOWN, KNOWN, CONFIRM, FEATURES, NEGATIVES = "unknown", 0.5, 0.7, 1 << 14, 4000
#: Characters that are looked at beyond a line for the two words that follow it.
AHEAD = 64
#: Weights up to this one are bounded for all families at once.
STRONG = 0.05


def _pairs(tokens: Column) -> Column:
    """The distinct 2-grams."""
    each = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.array_join(F.slice(tokens, i, 2), " "))
    return F.array_distinct(F.when(F.size(tokens) > 1, each).otherwise(F.array().cast("array<string>")))


def paragraphs(docs: DataFrame, flagged: bool = False) -> DataFrame:
    """(rid, doc_id, paragraph, n_lines, content) of every non-empty line, and of every run of two or more of them.

    ``flagged``: of the rows where ``in_lines`` and ``in_runs`` hold.
    """
    flags = [F.col(x) if flagged else F.lit(True).alias(x) for x in ("in_lines", "in_runs")]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.split("text", "\n").alias("lines"), *flags)
    entry = lambda number, content: F.struct(number.cast("int").alias("paragraph"), F.size(F.split(content, "\n")).alias("n_lines"), content.alias("content"))
    lines = F.transform("lines", lambda x, i: entry(i, x))
    # Lines carry their numbers, so that a run knows its first one.
    runs = F.split(F.array_join(F.transform("lines", lambda x, i: F.when(F.trim(x, F.lit(" \t\r\f")) == "", "").otherwise(F.concat(i.cast("string"), F.lit(":"), x))), "\n"), "\n{2,}")
    runs = F.filter(F.transform(runs, lambda x: F.trim(x, F.lit("\n"))), lambda x: F.contains(x, F.lit("\n")))
    runs = F.transform(runs, lambda x: entry(F.regexp_extract(x, "^([0-9]+):", 1), F.regexp_replace(x, "(?m)^[0-9]+:", "")))
    each = rows.select("rid", "doc_id", "in_lines", "in_runs", F.inline(F.concat(lines, runs)))
    return each.filter((F.trim("content") != "") & F.when(F.col("n_lines") == 1, F.col("in_lines")).otherwise(F.col("in_runs"))).drop("in_lines", "in_runs")


def _lines_ahead(docs: DataFrame) -> DataFrame:
    """(rid, key, run, in_run, t, cross, loose) of every line: its words, and the grams that lead from it into its run's next words.

    ``key`` is the text's hash. ``loose``: the next words are not all known.
    """
    # Runs lie between blank lines. A piece may begin or end with blank lines, which have no words.
    pieces = F.posexplode(F.split("text", "\n[ \t\r\f]*+\n")).alias("run", "piece")
    runs = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("text").alias("key"), "text").select("rid", "key", pieces)
    runs = runs.select("rid", "key", "run", F.split("piece", "\n").alias("lines"))
    ahead = lambda i: F.substring(F.array_join(F.slice("lines", i + 2, F.lit(3)), " "), 1, AHEAD + 1)
    entry = F.inline(F.transform("lines", lambda x, i: F.struct(x.alias("content"), ahead(i).alias("ahead"), (F.size("lines") > i + 4).alias("more"))))
    lines = runs.select("rid", "key", "run", (F.size("lines") > 1).alias("in_run"), entry)
    lines = lines.select("rid", "key", "run", "in_run", lower_words(F.col("content")).alias("t"), lower_words(F.col("ahead")).alias("next"), (F.length("ahead") > AHEAD).alias("cut"), "more")
    last, first = lambda k: F.get("t", F.size("t") - k), lambda k: F.get("next", F.lit(k))
    # A gram with a missing word is null.
    cross = [F.concat(last(1), F.lit(" "), first(0)), F.concat(last(2), F.lit(" "), last(1), F.lit(" "), first(0)), F.concat(last(1), F.lit(" "), first(0), F.lit(" "), first(1))]
    loose = F.when(F.col("cut"), F.size("next") < 3).otherwise(F.col("more") & (F.size("next") < 2))
    return lines.select("rid", "key", "run", "in_run", "t", F.array_compact(F.array(*cross)).alias("cross"), loose.alias("loose"))


def _weights(values: np.ndarray) -> Column:
    """A constant array of ``values``, rounded up."""
    return F.split(F.lit(",".join(f"{v:g}" for v in np.ceil(values * 1e4) / 1e4)), ",").cast("array<double>")


def _total(indices: Column, weights: Column) -> Column:
    return F.aggregate(indices, F.lit(0.0), lambda a, i: a + F.get(weights, i))


def _notices(spark: SparkSession) -> DataFrame:
    """(family, notices): the 2-grams of each template. As many rows as there are families."""
    return spark.createDataFrame(list(TEMPLATES), "family string, content string").groupBy("family").agg(F.collect_list(_pairs(lower_words(F.col("content")))).alias("notices"))


def _similarity() -> Column:
    """The largest share of a notice that ``held`` holds."""
    return F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, F.col("held"))) / F.size(n)))


def _training(spark: SparkSession, lines: DataFrame, negatives: int) -> DataFrame:
    """(family, tokens): windows of the templates, and corpus paragraphs that no template confirms."""
    known = spark.createDataFrame(list(TEMPLATES), "family string, content string").select("family", lower_words(F.col("content")).alias("t"))
    size, half = F.size("t"), F.ceil(F.size("t") / 2).cast("int")
    windows = known.withColumn("n", F.explode(F.sequence(half, size))).withColumn("s", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)))
    positive = windows.select("family", F.slice("t", F.col("s"), F.col("n")).alias("t"))
    # The least hashes: a sample that doesn't depend on the order of rows, nor on how often one repeats.
    sample = stored(lines.select("content").distinct().orderBy(F.xxhash64("content")).limit(negatives).withColumn("number", F.monotonically_increasing_id()), "licence-sample")
    # Bound to a column first: inside the grams the text would be cut into words once per word.
    held = sample.withColumn("t", lower_words(F.col("content"))).withColumn("held", _pairs(F.col("t")))
    confirmed = held.crossJoin(F.broadcast(_notices(spark))).filter(_similarity() >= CONFIRM).select("number")
    sample = sample.join(confirmed, "number", "left_anti")
    # A word of a notice alone is no notice.
    short = known.select(F.explode("t").alias("w")).distinct().select(F.lit(UNKNOWN).alias("family"), F.array("w").alias("t"))
    return positive.union(sample.select(F.lit(UNKNOWN).alias("family"), lower_words(F.col("content")).alias("t"))).union(short)


def _sampled(docs: DataFrame, size: int) -> DataFrame:
    """About ``size`` different texts, by their hashes; all of them in a small corpus."""
    total = docs.count()
    share = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(total, 1)))
    return docs.filter(F.col("text").isNotNull() & share).select("text").distinct().select(F.lit(None).cast("long").alias("doc_id"), "text")


class LicenseModel:
    """``lines`` are the paragraphs of a sample of the corpus, of which ``negatives`` are taken."""

    def __init__(self, spark: SparkSession, lines: DataFrame, negatives: int = NEGATIVES):
        self.families = [*sorted({f for f, _ in TEMPLATES}), UNKNOWN]
        rows = _training(spark, lines, negatives)
        index = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(self.families) for x in (f, float(k))]), F.col("family"))
        rows = stored(rows.select(index.alias("label"), "t", (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("calibrates")), "licence-training")
        self.hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
        # The sample is bounded, so few tasks hold it; each step of the fit sends a whole gradient per task.
        spread = lambda df: self._spread(df).coalesce(1 + negatives // 10_000)
        weights = rows.filter("not calibrates").groupBy("label").agg((1 / F.count("*")).alias("weight"))
        fit = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-3, maxIter=40)
        self.model = fit.fit(spread(rows.filter("not calibrates").join(F.broadcast(weights), "label")))
        margins = self._margin(self.model.transform(spread(rows.filter("calibrates")))).select("margin", (F.col("label") != len(self.families) - 1).cast("double").alias("y"))
        self.curve = (8.0, 0.0)
        counts = {r.y: r["count"] for r in margins.groupBy("y").count().collect()}
        if len(counts) == 2:
            from pyspark.ml.feature import VectorAssembler
            line = LogisticRegression(labelCol="y", featuresCol="m", regParam=1e-3).fit(VectorAssembler(inputCols=["margin"], outputCol="m").transform(margins))
            self.curve = (float(line.coefficients[0]), float(line.intercept))

    def _spread(self, rows: DataFrame) -> DataFrame:
        """The 1- to 3-grams of ``t``, hashed into a sparse vector."""
        for n in (2, 3):
            rows = NGram(n=n, inputCol="t", outputCol=f"grams{n}").transform(rows)
        return self.hashing.transform(rows.withColumn("grams", F.concat("t", "grams2", "grams3")))

    def _margin(self, scored: DataFrame) -> DataFrame:
        last = len(self.families) - 1
        p = scored.withColumn("p", vector_to_array("probability"))
        best = F.array_max(F.slice("p", 1, last))
        return p.withColumn("margin", best - F.get("p", F.lit(last))).withColumn("best", F.array_position(F.slice("p", 1, last), best))

    def _least(self) -> float | None:
        """What the log odds of a family against ``unknown`` reach in any found paragraph; None if that has no bound."""
        a, b = self.curve
        margin = (math.log(KNOWN / (1 - KNOWN)) - b) / a if a > 0 else -1.0
        if margin <= -1:
            return None
        # Below even odds the margin is at most (odds - 1) / (1 + families * odds).
        return (0.0 if margin >= 0 else math.log((1 + margin) / (1 - margin * (len(self.families) - 1)))) - 1e-3

    def possible(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, in_lines, in_runs) of the rows of ``docs`` in whose texts lines or runs can be found, by upper bounds of their log odds.

        Of a line: the sum, over its features, of their largest weight for any family. Of a run: per family, the sum of the weights above zero
        of all its features (those of its lines, and of the grams across their ends), and the least sum of weights below zero of any of its lines.
        """
        weights, free = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        weights, free, least = weights[:-1] - weights[-1], free[:-1] - free[-1], self._least()
        if least is None or free.max() >= least:
            return docs.select("doc_id", "text", F.lit(True).alias("in_lines"), F.lit(True).alias("in_runs"))
        largest = weights.max(axis=0)
        indices = lambda name: F.unwrap_udt(name)["indices"]
        across = HashingTF(inputCol="cross", outputCol="crossing", numFeatures=FEATURES, binary=True)
        lines = across.transform(self._spread(_lines_ahead(docs.select("text").filter("text is not null"))))
        lines = lines.select("rid", "key", "run", "in_run", "loose", indices("features").alias("own"), indices("crossing").alias("crossing"))
        every = _weights(largest)
        above = lambda name: F.filter(name, lambda i: F.get(every, i) > 0).alias(name)
        lines = lines.select("rid", "key", "run", "in_run", "loose", _total(F.col("own"), _weights(np.minimum(largest, 0))).alias("below"), above("own"), above("crossing"))
        possible = F.col("below") + _total(F.col("own"), every) + float(free.max()) >= least
        # No filter before this: below it, it would repeat the sums.
        held = F.when(F.col("in_run"), F.struct("below", F.concat("own", "crossing").alias("above")))
        runs = lines.select("rid", "key", "run", possible.alias("possible"), (F.col("loose") & F.col("in_run")).alias("loose"), held.alias("held")).groupBy("rid", "key", "run").agg(
            F.max("possible").alias("possible"), F.max("loose").alias("loose"), F.min("held.below").alias("below"), F.array_distinct(F.flatten(F.collect_list("held.above"))).alias("above"))
        # The families differ in few features; the small weights of the others count for all families.
        strong = np.where(largest > STRONG, 1.0, 0.0)
        runs = runs.select("key", "possible", "loose", (F.col("below") + _total(F.col("above"), _weights(np.where(strong > 0, 0.0, np.maximum(largest, 0))))).alias("rest"),
                           F.filter("above", lambda i: F.get(_weights(strong), i) > 0).alias("strong"))
        families = [_total(F.col("strong"), _weights(strong * np.maximum(w, 0))) + float(c) for w, c in zip(weights, free, strict=True)]
        bound = F.greatest(*families) + F.col("rest")
        # Outside of runs there is no bound.
        texts = runs.select("key", "possible", (F.col("loose") | F.coalesce(bound >= least, F.lit(False))).alias("run")).groupBy("key").agg(F.max("possible").alias("in_lines"), F.max("run").alias("in_runs"))
        keys = small(texts.filter("in_lines or in_runs"), "licence-possible")
        return docs.select("doc_id", "text").join(keys, F.xxhash64("text") == F.col("key")).drop("key")

    def scan(self, lines: DataFrame) -> DataFrame:
        """doc_id, paragraph, family, probability, similarity, confirmed of the paragraphs that hold a notice."""
        found = lines.withColumn("t", lower_words(F.col("content")))
        scored = self._margin(self.model.transform(self._spread(found)))
        a, b = self.curve
        family = F.element_at(F.array(*[F.lit(f) for f in self.families[:-1]]), F.col("best").cast("int"))
        # A filter on what is exploded isn't pushed below, where it would score each paragraph again.
        judged = F.explode(F.array(F.struct(family.alias("family"), (1 / (1 + F.exp(-(F.col("margin") * a + b)))).alias("probability"))))
        known = scored.select("rid", "doc_id", "paragraph", "n_lines", "t", judged.alias("j")).filter(F.col("j.probability") >= KNOWN)
        known = known.select("rid", "doc_id", "paragraph", "n_lines", "j.*", _pairs(F.col("t")).alias("held"))
        known = known.join(F.broadcast(_notices(lines.sparkSession)), "family").withColumn("similarity", _similarity())
        known = stored(known.withColumn("confirmed", F.col("similarity") >= CONFIRM).drop("held", "notices"), "licence-scores")
        # A run tells nothing more where one of its lines is confirmed, or where it is not confirmed itself but a line is found.
        single = known.filter("n_lines = 1").select("rid", "family", F.col("paragraph").alias("line"), F.col("confirmed").alias("sure"))
        inside = known.filter("n_lines > 1").join(single, ["rid", "family"]).filter("line >= paragraph and line < paragraph + n_lines and (sure or not confirmed)")
        known = known.join(inside.select("rid", "family", "paragraph", "n_lines").distinct(), ["rid", "family", "paragraph", "n_lines"], "left_anti")
        return known.select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")


def scan(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """Notices in the paragraphs of ``docs`` (doc_id, text), by a model trained on the templates and this corpus."""
    model = LicenseModel(docs.sparkSession, paragraphs(_sampled(docs, negatives)), negatives)
    return model.scan(paragraphs(model.possible(docs), flagged=True))
