"""License scan by diagonal voting of word k-grams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import text_of, written

#: The phrases whose every exact place counts, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Passages of well-known licenses and of the notices that name them, with their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
     "an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 2 of the license or at your option any later "
     "version", "gpl-2"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation either version 2 1 of the license or at your option "
     "any later version", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
     "compile sell or distribute this software", "unlicense"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software", "zlib"),
)

#: A word is a run of ASCII letters and digits and of other characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 3


def template_grams(templates, k: int = K) -> list[tuple]:
    """Every word k-gram of every template: tid, label, base, words of the template, tpos, gram."""
    rows = []
    for tid, (text, label, base) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {text}")
        rows += [(tid, label, base, len(words), p, " ".join(words[p : p + k])) for p in range(len(words) - k + 1)]
    return rows


def _hash(gram: Column) -> Column:
    return F.xxhash64(gram)


def known_grams(docs: DataFrame, grams: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """Written: a row for each of ``docs``, with doc_id, n_words and ``hits``, its (pos, gram) that some template has.

    One pass extracts the words of a text once. A word that begins no template gram costs one look in a set. ``row``
    numbers the rows.
    """
    # the Kelvin sign is the one character beyond ASCII that lower() makes a letter of ASCII
    words = F.regexp_extract_all(F.lower(F.replace(text_of(text_col), F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))
    firsts, texts = sorted({g[5].split(" ")[0] for g in grams}), sorted({g[5] for g in grams})

    def hits(words: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
        found = F.filter(at, lambda i: F.get(words, i).isin(firsts) & gram(i).isin(texts))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.transform(found, lambda i: F.struct(i.alias("pos"), gram(i).alias("gram"))).alias("hits"),
        )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.element_at(F.transform(F.array(words), hits), 1).alias("w"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "w.n_words", "w.hits")
    return written(rows, "license-grams")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base=BASE,
    templates=TEMPLATES,
    k: int = K,
    gap: int = 2,
    similarity: float = 0.8,
    least_votes: int = 4,
) -> DataFrame:
    """Find license phrases in every whole text, exact or slightly changed.

    All rolling ``k``-grams of a text's words that some template has are joined by hash, and then by the words, to
    template positions. The template list is a parameter, small by nature, and is broadcast. Each match votes for
    a diagonal: its word position less its template position. A diagonal with a vote for every
    k-gram of a base phrase is a place of that phrase. Neighbouring diagonals, up to ``gap`` apart, are
    merged, so that a few inserted or missing words don't split a match.

    A merged span is verified: of its votes, by word position, only those count that go on in the template, so that
    words in another order don't. It gives the template's label if the votes that count are ``least_votes`` or more
    and cover ``similarity`` of the template's words. Of verified spans that overlap in a text, only the ones with the
    largest share of votes give their labels: related licenses share most of their words. Base phrases give theirs by
    exact places only, whatever else is there.

    Null text counts as empty. Every row is read for itself: ids may be null or repeat. Other columns are not read.
    An empty table gives an empty result.

    Returns doc_id, n_words, n_base (places of base phrases), first_word, last_word (smallest and
    largest start, or null), base_labels, labels (both distinct, sorted, comma-joined) and score
    (1 for a base phrase, else the largest share of a template's k-grams that count in one verified span, or 0).
    """
    spark = docs.sparkSession
    grams = template_grams([(t, x, True) for t, x in base] + [(t, x, False) for t, x in templates], k)
    known = _table(spark, grams)
    rows = known_grams(docs, grams, k, id_col, text_col)
    votes = (
        rows.select("row", F.explode("hits").alias("h"))
        .select("row", "h.pos", F.col("h.gram").alias("found"))
        .withColumn("hash", _hash(F.col("found")))
        .join(F.broadcast(known), "hash")
        .where("found = gram")
        .withColumn("diagonal", F.expr("pos - tpos"))
    )
    marked = (
        votes.selectExpr(
            "*",
            f"coalesce(diagonal - lag(diagonal) over (partition by row, tid order by diagonal, tpos) > {gap}, true) as opens",
            f"count(*) over (partition by row, tid, diagonal) = size - {k - 1} as whole",
        )
        .withColumn("span", F.expr("sum(int(opens)) over (partition by row, tid order by diagonal, tpos)"))
        .selectExpr(
            "*", "tpos > coalesce(max(tpos) over (partition by row, tid, span order by pos, tpos rows between unbounded preceding and 1 preceding), -1) as counts"
        )
    )
    # votes that count ascend in the template: each adds the words that the one before it has not covered
    covered = marked.selectExpr(
        "*",
        f"case when counts then least({k}, coalesce(tpos - max(tpos) over (partition by row, tid, span order by pos, tpos "
        f"rows between unbounded preceding and 1 preceding), {k})) else 0 end as adds",
    )
    spans = covered.groupBy("row", "tid", "label", "base", "size", "span").agg(
        F.count_if("counts").alias("votes"),
        F.sum("adds").alias("words"),
        F.min("pos").alias("start"),
        (F.max("pos") + k).alias("stop"),
        F.count_if(F.col("whole") & (F.col("tpos") == 0)).alias("places"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last"),
    )
    share = F.col("votes") / (F.col("size") - (k - 1))
    good = (F.col("votes") >= least_votes) & (F.col("words") >= similarity * F.col("size"))
    by_base = spans.where("base and places > 0").select("row", "label", "places", "first", "last", F.lit(True).alias("base"), F.lit(1.0).alias("share"))
    verified = (
        spans.where(~F.col("base") & good)
        .select("row", "label", "start", "stop", share.alias("share"))
        .selectExpr("*", "start >= coalesce(max(stop) over (partition by row order by start, stop rows between unbounded preceding and 1 preceding), 0) as opens")
        .withColumn("place", F.expr("sum(int(opens)) over (partition by row order by start, stop)"))
        .selectExpr("*", "max(share) over (partition by row, place) as best")
        .where("share = best")
        .select("row", "label", "share")
    )
    by_row = (
        by_base.unionByName(verified, allowMissingColumns=True)
        .groupBy("row")
        .agg(
            F.sum("places").alias("n_base"),
            F.min("first").cast("long").alias("first_word"),
            F.max("last").cast("long").alias("last_word"),
            _labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            _labels(F.col("label")).alias("labels"),
            F.max("share").alias("score"),
        )
    )
    return rows.join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _labels(label: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(label)), ",")


def _table(spark: SparkSession, grams: list[tuple]) -> DataFrame:
    known = spark.createDataFrame(grams, "tid int, label string, base boolean, size int, tpos int, gram string")
    return known.withColumn("hash", _hash(F.col("gram")))
