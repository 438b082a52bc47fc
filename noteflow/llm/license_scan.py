"""License scan by diagonal voting.

All rolling pairs of words of a document are joined to the places of the same pairs in the
templates. A hit at word p of the document and word t of a template votes for the diagonal
p - t. A phrase template (base) is found where one diagonal has all its votes, so its words stand
consecutively. Of longer templates, diagonals with ``VOTES`` votes or more are kept;
neighbouring ones (shifted by ``SHIFT`` words or fewer, ``GAP`` words or fewer apart) are
merged, since an inserted or missing word only moves the diagonal. A span is verified when
it holds ``COVERAGE`` of the template's pairs and, on the text itself, what tells the license
from its likes (``TELLING``): a pair that only it has must be held, and a diagonal does not count
if the words after one of its pairs name another license. The join compares the words, not just
hashes.

All of it is DataFrame functions. The templates are fixed values, a few hundred pairs, so they
are broadcast; documents are never shuffled.

Defined results: a NULL text counts as empty. Rows equal in id and text have equal results;
rows stay one to one; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Phrases that name a license, and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Sentences by which licenses are granted, in words, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("are made available under the terms of the eclipse public license", "epl"),
    ("subject to the terms of the common development and distribution license", "cddl"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
)

# Short license identifiers, in words as they stand behind "SPDX-License-Identifier:", and their labels.
IDENTIFIERS = (
    ("mit", "mit"),
    ("apache 2 0", "apache"),
    ("gpl 2 0", "gpl"),
    ("gpl 3 0", "gpl"),
    ("lgpl 2 1", "lgpl"),
    ("lgpl 3 0", "lgpl"),
    ("agpl 3 0", "agpl"),
    ("bsd 2 clause", "bsd"),
    ("bsd 3 clause", "bsd"),
    ("isc", "isc"),
    ("mpl 2 0", "mpl"),
    ("epl 2 0", "epl"),
    ("cddl 1 0", "cddl"),
    ("zlib", "zlib"),
    ("cc0 1 0", "cc0"),
    ("cc by 4 0", "cc-by"),
    ("cc by nc 4 0", "cc-by-nc"),
    ("unlicense", "unlicense"),
)
_NAMED = "spdx license identifier"
TEMPLATES += tuple((f"{_NAMED} {own}", label) for own, label in IDENTIFIERS)

# What tells a sentence's license from others, by the sentence. Of the pairs one must be
# held, where a pattern is given before words that match it; words that match ``refused`` after a pair name
# another license. The sentences of BSD (Apache 1.1) and "you may not use this file" (CDDL) are shared word for word.
_OTHER_CC = r"(?:share ?alike|no ?deriv)"
TELLING = {
    TEMPLATES[0][0]: {"held": {"the mit": "", "mit license": ""}},
    TEMPLATES[1][0]: {"held": {"documentation files": ""}},
    TEMPLATES[2][0]: {"held": {"the apache": "", "apache license": ""}},
    TEMPLATES[3][0]: {"held": {"this file": "", "file except": ""}},
    TEMPLATES[4][0]: {"held": {"gnu general": ""}},
    TEMPLATES[5][0]: {"held": {"gnu general": ""}},
    TEMPLATES[6][0]: {
        "held": {"by nc": "", "nc 4": ""},
        "refused": {"cc by": r"^(?:nc )?(?:sa|nd)\b", "by nc": r"^(?:sa|nd)\b"},
    },
    TEMPLATES[7][0]: {
        "held": {"commons attribution": r"^non ?commercial\b", "attribution noncommercial": "", "noncommercial 4": ""},
        "refused": {"commons attribution": rf"^(?:non ?commercial )?{_OTHER_CC}", "attribution noncommercial": rf"^{_OTHER_CC}"},
    },
    TEMPLATES[8][0]: {
        "held": {"commons attribution": "", "attribution 4": ""},
        "refused": {"commons attribution": rf"^(?:non ?commercial\b|{_OTHER_CC})"},
    },
    TEMPLATES[10][0]: {"held": {"with or": "", "or without": ""}},
    TEMPLATES[11][0]: {"held": {"the mozilla": "", "mozilla public": ""}},
    TEMPLATES[12][0]: {"held": {"and unencumbered": "", "unencumbered software": ""}},
    TEMPLATES[13][0]: {"held": {"gnu affero": "", "affero general": ""}},
    TEMPLATES[14][0]: {"held": {"gnu lesser": "", "lesser general": ""}},
    TEMPLATES[15][0]: {"held": {"the eclipse": "", "eclipse public": ""}},
    TEMPLATES[16][0]: {"held": {"common development": "", "development and": ""}},
    TEMPLATES[17][0]: {"held": {"event will": "", "authors be": ""}},
    TEMPLATES[18][0]: {"held": {"has waived": "", "waived all": ""}},
}
# An identifier names its license only if all its words follow; "MIT-0" and the like are other licenses than "MIT".
for _own, _ in IDENTIFIERS:
    _first, _rest = _own.partition(" ")[::2]
    TELLING[f"{_NAMED} {_own}"] = {"held": {f"identifier {_first}": rf"^{_rest}\b" if _rest else ""}}
TELLING[f"{_NAMED} mit"]["refused"] = {"identifier mit": r"^(?:0|modern|feh|cmu|advertising|enna)\b"}
#: Second words of the pairs whose following words are looked at, and how many of these.
_LOOKED_AT = sorted(
    {pair.split()[1] for own in TELLING.values() for pair in [*own.get("refused", {}), *[p for p, c in own["held"].items() if c]]}
)
AFTER = 4

VOTES = 2
SHIFT, GAP = 5, 5
COVERAGE = 0.6

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case; ASCII letters, digits and all that is not ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def templates(spark: SparkSession) -> DataFrame:
    """``template, label, base, pairs, place, first, second, held, refused``: every pair of every template."""
    shape = "template int, label string, base boolean, pairs int, place int, first string, second string, held string, refused string"
    return spark.createDataFrame(_pairs(), shape)


def diagonals(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, template, label, base, pairs, diagonal, places, tells, refused``: who votes for which diagonal.

    ``tells``: one of the votes tells the license from others; ``refused``: the words after one name another.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    following = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("v")
    named = lambda v, i: F.when(v.isin(_LOOKED_AT), F.array_join(F.slice("w", i + 3, AFTER), " "))
    split = split.where(F.size("w") > 1).withColumn("v", following)
    split = split.withColumn("after", F.when(F.arrays_overlap("w", F.lit(_LOOKED_AT)), F.transform("v", named)))
    each = split.select("doc_id", "text_hash", "after", F.posexplode(F.arrays_zip("w", "v")).alias("at", "pair"))
    each = each.select("doc_id", "text_hash", "at", F.col("pair.w").alias("a"), F.col("pair.v").alias("b"), F.get("after", "at").alias("after"))
    each = each.withColumn("hash", F.xxhash64("a", "b"))
    known = templates(docs.sparkSession).withColumn("known", F.xxhash64("first", "second"))
    same = (each["hash"] == known["known"]) & (each["a"] == known["first"]) & (each["b"] == known["second"])
    hits = each.join(F.broadcast(known), same)
    matches = lambda pattern: F.coalesce(F.rlike(F.coalesce("after", F.lit("")), F.col(pattern)), F.lit(False))
    key = ["doc_id", "text_hash", "template", "label", "base", "pairs"]
    votes = hits.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal"))
    return votes.agg(
        F.sort_array(F.collect_set("place")).alias("places"),
        F.max(matches("held")).alias("tells"),
        F.max(matches("refused")).alias("refused"),
    )


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, template, label, base, first_word, last_word, coverage``: verified spans."""
    found = diagonals(docs)
    key = ["doc_id", "text_hash", "template", "label", "base"]
    whole = F.col("base") & (F.size("places") == F.col("pairs"))
    voted = found.where(whole | (~F.col("base") & (F.size("places") >= VOTES) & ~F.col("refused")))
    voted = voted.withColumn("begin", F.col("diagonal") + F.element_at("places", 1))
    voted = voted.withColumn("end", F.col("diagonal") + F.element_at("places", -1) + 1)
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("begin", "diagonal")
    apart = (F.col("begin") - F.lag("end").over(order) > GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SHIFT)
    # every place of a phrase is a span of its own
    voted = voted.withColumn("apart", (F.col("base") | F.coalesce(apart, F.lit(True))).cast("int"))
    voted = voted.withColumn("span", F.sum("apart").over(order))
    merged = voted.groupBy(*key, "pairs", "span").agg(
        F.min("begin").alias("first_word"),
        F.max("end").alias("last_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        F.max("tells").alias("tells"),
    )
    merged = merged.withColumn("coverage", F.col("held") / F.col("pairs")).where((F.col("coverage") >= COVERAGE) & F.col("tells"))
    return merged.select(*key, "first_word", "last_word", "coverage")


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: number of words, base places and labels, all labels, and the best coverage."""
    base = lambda c: F.when(F.col("base"), F.col(c))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    told = spans(docs).groupBy("doc_id", "text_hash").agg(
        F.count(base("label")).alias("n_base"),
        F.min(base("first_word")).cast("long").alias("first_word"),
        F.max(base("first_word")).cast("long").alias("last_word"),
        listed(base("label")).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    told = told.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    facts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = facts["doc_id"].eqNullSafe(told["found_id"]) & (facts["text_hash"] == told["found_hash"])
    return facts.join(told, same, "left").select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or granted in every whole text."""
    return scanned(common.table(spark, sf_dir, "documents"))


def _pairs() -> list[tuple]:
    """Every pair of every template: ``template, label, base, pairs, place, first, second, held, refused``."""
    rows = []
    for n, (text, label) in enumerate([*PHRASES, *TEMPLATES]):
        own = text.split()
        telling = TELLING.get(text)
        for at, (a, b) in enumerate(zip(own, own[1:])):
            held = telling["held"].get(f"{a} {b}") if telling else ""
            refused = telling.get("refused", {}).get(f"{a} {b}") if telling else None
            rows.append((n, label, n < len(PHRASES), len(own) - 1, at, a, b, held, refused))
    return rows


def _pair_rows() -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(quoted, row))})" for row in _pairs())


OP6_SQL = rf"""
WITH known(template, label, base, pairs, place, a, b, held, refused) AS (VALUES {_pair_rows()}
), split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), each AS (
  SELECT doc_id, p - 1 AS p0, w[p] AS a, w[p + 1] AS b, array_to_string(w[p + 2:p + {1 + AFTER}], ' ') AS after FROM (SELECT *, unnest(range(1, len(w))) AS p FROM split)
), diagonals AS (
  SELECT doc_id, template, label, base, pairs, p0 - place AS diagonal, list(DISTINCT place) AS places,
    max(coalesce(regexp_matches(coalesce(after, ''), held), false)) AS tells,
    max(coalesce(regexp_matches(coalesce(after, ''), refused), false)) AS refused
  FROM each JOIN known USING (a, b) GROUP BY doc_id, template, label, base, pairs, p0 - place
), based AS (
  SELECT doc_id, label, base, diagonal AS first_word, 1.0::DOUBLE AS coverage
  FROM diagonals WHERE base AND len(places) = pairs
), voted AS (
  SELECT *, diagonal + list_min(places) AS b, diagonal + list_max(places) + 1 AS e
  FROM diagonals WHERE NOT base AND len(places) >= {VOTES} AND NOT refused
), marked AS (
  SELECT *, CASE WHEN b - lag(e) OVER o <= {GAP} AND abs(diagonal - lag(diagonal) OVER o) <= {SHIFT} THEN 0 ELSE 1 END AS apart
  FROM voted WINDOW o AS (PARTITION BY doc_id, template ORDER BY b, diagonal)
), numbered AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY b, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked
), merged AS (
  SELECT doc_id, label, base, min(b) AS first_word, len(list_distinct(flatten(list(places)))) / pairs AS coverage,
    max(tells) AS tells
  FROM numbered GROUP BY doc_id, template, label, base, pairs, span
), spans AS (
  SELECT * FROM based
  UNION ALL SELECT doc_id, label, base, first_word, coverage FROM merged WHERE coverage >= {COVERAGE} AND tells
), told AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base,
         min(first_word) FILTER (base) AS first_word, max(first_word) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score
  FROM spans GROUP BY doc_id
)
SELECT s.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM split s LEFT JOIN told t ON s.doc_id = t.doc_id
"""
