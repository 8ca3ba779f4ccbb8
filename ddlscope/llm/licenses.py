"""License scan with a positional index of rare words, DataFrame functions only.

A template is a short run of words that licences or their notices contain; some
of its words, its key phrases, must be there.  The index holds postings (word,
template, offset) of the templates' words with the highest inverse document
frequency in the corpus scanned:

1. document frequencies of the templates' words are counted over all documents
   (map-side combined, one row per word of the templates);
2. of each template the two rarest key words are posted, with their offsets.  All
   key words must be there, so no place is missed by looking up the rarest ones;
3. a file looks up the words that are posted, an occurrence at position p of a
   word posted at offset o aligns the template to p - o, and the alignment stays
   if the second rarest word stands at its own place: the two postings are
   intersected by relative position;
4. the key phrases of a template are verified word by word at the alignment, and
   the weight of all its words that stand in place is added up.

A file's words stay in their row, so only the document frequencies are shuffled
and no file, host or frequent word meets others in one task; the work of a file is
in proportion to its length.  The posted words are a literal of the second pass:
as many as twice the templates, whatever the corpus.

Weights are integers, the bit length of (documents + 1) div (documents with the
word + 1), so shares are the same wherever they are added up.

Defined results: null and empty texts have no words, no places and the score 0;
texts are scanned whole, however long; rows that repeat a doc_id are scanned and
counted each; a null doc_id stays null; ties between rare words go to the earlier
offset; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ddlscope.llm import tables

#: Fixed value: what lies between words once A-Z are lower case; here A-Z count as letters, and words are lowered later.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: (label, words of a notice, its key phrases); the notices are those that the licences' own texts recommend or open with.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     ["general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license version 3", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license version 3", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["permission to use copy modify", "distribute this software for any purpose"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ["creative commons attribution sharealike"]),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[bool, ...]
    base: bool


def template(label: str, text: str, phrases: list[str], base: bool = False) -> Template:
    words, key = text.split(), [False] * len(text.split())
    for phrase in (p.split() for p in phrases):
        at = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
        key[at:at + len(phrase)] = [True] * len(phrase)
    return Template(label, tuple(words), tuple(key), base)


TEMPLATES = [template(label, phrase, [phrase], base=True) for phrase, label in BASE] + [template(*n) for n in NOTICES]


def lowered(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of a text in turn, letters as they are."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def _with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): a generator, so that the optimizer doesn't put the split into the functions applied to each word."""
    return docs.select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("words"))


def document_frequencies(docs: DataFrame, words: list[str]) -> DataFrame:
    """(word, n_docs): rows of ``docs`` that hold each of ``words``."""
    some = F.filter(F.col("words"), lambda w: F.lower(w).isin(*words))  # as many words as may be alike, cheaply
    held = _with_words(docs).select(F.explode(F.array_distinct(F.transform(some, lowered))).alias("word"))
    return held.filter(F.col("word").isin(*words)).groupBy("word").agg(F.count("*").alias("n_docs"))


def weights(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Weight of every word of the templates; what reaches the driver is a row for each of them."""
    words = sorted({w for t in templates for w in t.words})
    found = {r.word: r.n_docs for r in document_frequencies(docs, words).collect()}
    n = docs.count()
    return {w: ((n + 1) // (found.get(w, 0) + 1)).bit_length() for w in words}


def postings(templates: list[Template], weight: dict[str, int]) -> list[tuple[str, int, int, str, int]]:
    """(word, template, offset, second word, its offset): the rarest key words of each template."""
    out = []
    for i, t in enumerate(templates):
        rare = sorted((o for o, k in enumerate(t.key) if k), key=lambda o: (-weight[t.words[o]], o))[:2]
        out.append((t.words[rare[0]], i, rare[0], t.words[rare[-1]], rare[-1]))
    return out


def aligned(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, places): every verified place of every template.

    A place has the template's number, its label, whether it is a base phrase, the
    first word (before the text where only the end of a notice is there) and the
    share of the template's weight that stands in place.
    """
    templates = templates or TEMPLATES
    weight = weights(docs, templates)
    index = postings(templates, weight)
    posted = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(o).alias("offset"),
                                F.lit(w2).alias("second"), F.lit(o2).alias("second_offset")) for w, t, o, w2, o2 in index))
    known = F.array(*(F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(sum(weight[w] for w in t.words)).alias("total"),
        F.array(*(F.struct(F.lit(o).alias("offset"), F.lit(w).alias("word"), F.lit(weight[w]).alias("weight"), F.lit(k).alias("key"))
                  for o, (w, k) in enumerate(zip(t.words, t.key)))).alias("words")) for t in templates))
    lookups = sorted({p[0] for p in index})
    at = F.filter(F.transform("words", lambda w, i: F.struct(F.lower(w).alias("word"), i.alias("pos"))), lambda x: x["word"].isin(*lookups))
    rows = _with_words(docs).select("doc_id", "words", F.explode(F.array(at)).alias("found"))

    def word_at(i: Column) -> Column:
        return lowered(F.get("words", i))

    def alignments(x):
        word = word_at(x["pos"])
        here = F.filter(posted, lambda p: (p["word"] == word) & (word_at(x["pos"] - p["offset"] + p["second_offset"]) == p["second"]))
        return F.transform(here, lambda p: F.struct(p["template"].alias("template"), (x["pos"] - p["offset"]).alias("start")))

    def verified(x):
        t = F.get(known, x["template"])
        in_place = F.filter(t["words"], lambda w: F.coalesce(word_at(x["start"] + w["offset"]) == w["word"], F.lit(False)))
        n_key = F.size(F.filter(t["words"], lambda w: w["key"]))
        weighed = F.aggregate(in_place, F.lit(0), lambda a, w: a + w["weight"])
        return F.struct(x["template"].alias("template"), t["label"].alias("label"), t["base"].alias("base"), x["start"].alias("start"),
                        (weighed / t["total"]).alias("share"), (F.size(F.filter(in_place, lambda w: w["key"])) == n_key).alias("whole"))

    # files without a posted word, nearly all, skip the rest; a generator again, so that each step is taken once
    places = F.when(F.size("found") > 0, F.filter(F.transform(F.flatten(F.transform("found", alignments)), verified), lambda x: x["whole"]))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.array(places)).alias("places"))


def scanned(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    The score is the largest share of a notice's weight that stands in place with
    all its key phrases: 1 for a whole notice, 0 without any.
    """
    places = F.coalesce("places", F.array())
    base = F.filter(places, lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))

    def joined(some):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda x: x["label"]))), ",")

    shares = F.transform(F.filter(places, lambda x: ~x["base"]), lambda x: x["share"])
    return aligned(docs, templates).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(places).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(tables.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def oracle_sql(templates: list[Template] | None = None) -> str:
    """DuckDB SQL for the rows of ``scanned``: every word of every document met with every word of every template."""
    rows = ", ".join(f"({i}, '{t.label}', {t.base}, {o}, '{w}', {k})" for i, t in enumerate(templates or TEMPLATES)
                     for o, (w, k) in enumerate(zip(t.words, t.key)))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs
), t(template, label, base, o, word, key) AS (VALUES {rows}
), weight AS (
  SELECT t.word, length(bin(((SELECT count(*) FROM docs) + 1) // (count(DISTINCT w.r) + 1))) AS weight
  FROM (SELECT DISTINCT word FROM t) t LEFT JOIN w ON w.word = t.word GROUP BY t.word
), whole AS (
  SELECT template, sum(weight) AS total, count(*) FILTER (key) AS keys FROM t JOIN weight USING (word) GROUP BY template
), placed AS (
  SELECT w.r, t.template, t.label, t.base, w.pos - t.o AS start, sum(weight) AS got, count(*) FILTER (t.key) AS keys
  FROM w JOIN t ON t.word = w.word JOIN weight ON weight.word = w.word GROUP BY ALL
), found AS (
  SELECT p.*, p.got::BIGINT / whole.total::BIGINT AS share FROM placed p JOIN whole ON whole.template = p.template AND whole.keys = p.keys
)
SELECT docs.doc_id, len(any_value(docs.words)) AS n_words, count(*) FILTER (base) AS n_base,
       min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(share) FILTER (NOT base), 0.0)::DOUBLE AS score
FROM docs LEFT JOIN found ON found.r = docs.r
GROUP BY docs.r, docs.doc_id
"""


ORACLE_SQL = oracle_sql()
