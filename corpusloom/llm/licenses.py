"""Licence scans: which paragraphs of a text state a licence, and of which family.

A paragraph is a line with a word. A multinomial logistic regression on hashed words and pairs of words (lengths
normalised) gives a family or `unknown`. It is trained on notices made from the licence names and phrases below, and on
paragraphs of the corpus that have none of the licences' own words, as the unknown class. How sure it must be is
calibrated on rows that the fit leaves out: beyond all but a share of 0.001 of the unknown ones. A predicted paragraph is then
compared with its family's templates: the share of a template's pairs of words that the paragraph has confirms it, or not.

All of it is DataFrame functions and Spark's own DataFrame-based feature transformers and classifier; no Python runs in tasks.

The fit takes a bounded sample: the made notices (some hundreds) and at most `background` paragraphs of the corpus.

Cases: a null or empty text has no paragraph and gives no row. Repeated rows give repeated findings; a null doc_id is kept.
A paragraph that states two licences gets the likelier. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashed, read_table, saved

FEATURES, BACKGROUND = 1 << 13, 2000
#: Share of a template's pairs of words that confirms a prediction.
CONFIRM = 0.6

# The names by which notices call each family.
NAMES = {
    "mit": ["MIT License", "the MIT license", "MIT"],
    "apache": ["Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "Apache 2.0 license"],
    "gpl": ["GNU General Public License, version 3", "the GNU General Public License version 2", "GPL-3.0", "GPLv2 or later", "GNU GPL v3"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPL-3.0", "the GNU Lesser General Public License"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "bsd": ["BSD 3-Clause License", "the BSD license", "BSD-2-Clause", "the new BSD license", "the simplified BSD license"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "the Mozilla Public License"],
    "isc": ["ISC License", "the ISC license"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "a Creative Commons Attribution license"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "public-domain": ["CC0 1.0 Universal", "the public domain", "the Unlicense", "CC0"],
    "proprietary": ["a proprietary license", "a commercial license agreement", "all rights reserved"],
}
# Sentences that belong to one family.
SENTENCES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind.", "You may not use this file except in compliance with the License."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "agpl": ["You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "cc-by": ["You are free to share and adapt the material as long as you give appropriate credit."],
    "cc-by-sa": ["If you remix the material, you must distribute your contributions under the same license as the original."],
    "cc-by-nc": ["You may not use the material for commercial purposes."],
    "public-domain": ["This work has been released into the public domain by its author.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": ["No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher. All rights reserved."],
}
# How notices begin.
FRAMES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is distributed under the terms of {}.", "The code is available under {}.", "License: {}", "SPDX-License-Identifier: {}", "See the file for details of {}.", "Content is published under {}, unless otherwise noted.", "This work is licensed under the {}.", "Released under the {}.", "Licensed under the {}."]
# Near misses.
OTHERS = ["She renewed her driving license in the spring.", "The committee granted a license to the new pub.", "Please read the terms before you begin.", "The public gave general support to the plan.", "A version of the story was published in May.", "The doctor was licensed to practise in two states.", "He kept the copyright page in his pocket.", "Students may copy the exercise for their own use.", "The commons were open to all common people."]


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots, plus and minus signs within a paragraph, without outer dots."""
    return F.filter(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.+\-]+"), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: w != "")


def notices() -> list[tuple[str, str]]:
    """(family, paragraph) rows: every frame with every name, every sentence, and each sentence's halves."""
    rows = [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in FRAMES]
    for family, sentences in SENTENCES.items():
        for s in sentences:
            w = s.split()
            rows += [(family, s)] * 4 + [(family, " ".join(w[: max(6, len(w) * 2 // 3)])), (family, " ".join(w[len(w) // 3 :]))]
    return rows + [("unknown", s) for s in OTHERS for _ in range(3)]


def templates() -> list[tuple[str, str]]:
    return [(family, s) for family, sentences in SENTENCES.items() for s in sentences] + [(family, n) for family, names in NAMES.items() for n in names if " " in n or "-" in n]


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number among the text's lines) and line, of every line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.where(F.col("line").rlike(r"[\p{L}\p{N}]"))


def _pairs(words: Column) -> Column:
    """Distinct pairs of neighbouring words; of a single word, itself."""
    some = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, some).otherwise(words))


@dataclass
class Scanner:
    model: PipelineModel
    families: list[str]
    sure: float

    def predict(self, lines: DataFrame) -> DataFrame:
        """lines(words, ...) with family (unknown below the calibrated probability) and probability."""
        names = F.array(*[F.lit(f) for f in self.families])
        out = self.model.transform(lines)
        out = out.withColumn("family", F.element_at(names, F.col("prediction").cast("int") + 1)).withColumn("probability", F.array_max(vector_to_array("probability")))
        out = out.withColumn("family", F.when((F.col("family") != "unknown") & (F.col("probability") < self.sure), "unknown").otherwise(F.col("family")))
        return out.drop("pairs", "f1", "f2", "both", "features", "rawPrediction", "prediction")


def fit(docs: DataFrame, background: int = BACKGROUND) -> Scanner:
    """Fits on the made notices and a sample of the corpus's paragraphs that share no word with the licences' vocabulary."""
    spark = docs.sparkSession
    rows = notices()
    families = sorted({f for f, _ in rows})
    telling = r"(?i)licen[sc]|copyright|\bcc0?\b|public domain|permission|rights reserved|warrant|redistribut|spdx"
    picked = docs.select("doc_id", "text").join(F.broadcast(least_hashed(docs.select("doc_id"), background, "doc_id")), "doc_id", "left_semi")
    other = paragraphs(picked).where(~F.col("line").rlike(telling)).orderBy(F.xxhash64("line", "doc_id"), "paragraph").limit(background)
    made = spark.createDataFrame(rows, "family string, line string").unionByName(other.select(F.lit("unknown").alias("family"), "line"))
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    made = saved(made.select(number.cast("double").alias("label"), words_of(F.col("line")).alias("words"), (F.pmod(F.xxhash64("line", F.lit("aside")), F.lit(5)) == 0).alias("aside")))
    steps = [NGram(n=2, inputCol="words", outputCol="pairs"), HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="f1"), HashingTF(numFeatures=FEATURES, binary=True, inputCol="pairs", outputCol="f2"), VectorAssembler(inputCols=["f1", "f2"], outputCol="both"), Normalizer(inputCol="both", outputCol="features")]
    model = Pipeline(stages=[*steps, LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.0, maxIter=60)]).fit(made.where("not aside"))
    scanner = Scanner(model, families, 0.0)
    doubt = scanner.predict(made.where("aside").where(F.col("label") == families.index("unknown"))).where("family <> 'unknown'")
    worst = doubt.agg(F.percentile("probability", 0.999)).first()[0]
    scanner.sure = max(0.5, min(0.95, (worst or 0.0) + 0.01))
    return scanner


def scan_licences(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, paragraph, line, family, probability, template, similarity and confirmed of every licence paragraph."""
    scanner = scanner or fit(docs)
    found = scanner.predict(paragraphs(docs).withColumn("words", words_of(F.col("line")))).where("family <> 'unknown'")
    known = docs.sparkSession.createDataFrame(templates(), "family string, template string")
    known = known.withColumn("parts", _pairs(words_of(F.col("template")))).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("template", "parts"))).alias("known"))
    own = _pairs(F.col("words"))
    found = found.withColumn("own", own).join(F.broadcast(known), "family", "left")  # one row a family
    alike = F.transform("known", lambda t: F.struct((F.size(F.array_intersect(t["parts"], F.col("own"))) / F.size(t["parts"])).alias("similarity"), F.size(t["parts"]).alias("parts"), t["template"].alias("template")))
    found = found.withColumn("best", F.array_max(alike))
    return found.select("doc_id", "paragraph", "line", "family", "probability", F.col("best.template").alias("template"), F.col("best.similarity").alias("similarity"), (F.col("best.similarity") >= CONFIRM).alias("confirmed"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
