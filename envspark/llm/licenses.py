"""Operator 2: licence scans through a positional rare-token index. DataFrame functions only.

Template notices are indexed as postings word -> (template, position). A word's IDF comes from its document frequency
over all documents; only words in at most ``COMMON`` of them are indexed (the rare words of key phrases always are).
Wherever an indexed word stands in a file, each of its postings proposes a place of the template (position in the file
less position in the template), however many licence words the file holds. There the file is compared with all words of
the template, common ones too. A place counts when the words that agree have ``COVERAGE`` of the template's IDF mass and every mandatory key
phrase (``MANDATORY``, or the one beside the notice) stands whole where the template has it. Base phrases are key
phrases of their own: the rarest word proposes, all words must agree.

All of it is done inside the file's row, so nothing but the document frequencies is shuffled.

``score``: the coverage of the best counted place, at least 0.5 with a base phrase, half the best coverage of a place
that does not count, 0 without any; here the coverage is the share of the indexed words only, as in ``ORACLE_SQL``, which
also knows the indexed words of the key phrases only and looks up the ``ANCHORS`` rarest words of a file. Rounded to 6 decimals.

Defined results: null and empty texts have no words, no labels ('' in both columns), null first and last word and score
0. Repeated rows and rows with equal doc_id are scanned each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, lower_az

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE, COMMON = 0.6, 0.125
ANCHORS = 12  # of ORACLE_SQL only
#: A place as a number: unit * SPAN + place + MARGIN (a place may lie before the text, by less than a template's length).
SHIFT, MARGIN = 32, 64
SPAN = 1 << SHIFT

# Base phrases with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Notices with their labels and the rare words of their key phrases (these are always indexed).
TEMPLATES = [
    ("mit-notice", "released under the mit license", ["mit license"]),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction",
     ["hereby granted"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
     "lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ["binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["without fee"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
     ["eclipse public license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]

# The whole key phrases, where the indexed rare words are only a part of them.
MANDATORY = {
    "mit-permission": ["hereby granted free of charge"],
    "apache-2.0": ["apache license version 2 0"],
    "gpl-3.0": ["gnu general public license version 3"],
    "bsd": ["source and binary forms"],
    "isc": ["without fee is hereby granted"],
}


def _first(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def _index() -> tuple[list[tuple], list[tuple], list[str]]:
    """Postings (word, unit, position, is_phrase), needs (template, phrase, position) and the phrases."""
    phrases = sorted({p for p, _ in BASE} | {k for _, _, keys in TEMPLATES for k in keys})
    postings = [(w, p, i, True) for p in phrases for i, w in enumerate(p.split())]
    needs = []
    for label, notice, keys in TEMPLATES:
        words = notice.split()
        postings += [(w, label, i, False) for i, w in enumerate(words)]
        for k in keys:
            needs.append((label, k, _first(words, k.split())))
    return postings, needs, phrases


POSTINGS, NEEDS, PHRASES = _index()
VOCABULARY = sorted({p[0] for p in POSTINGS})
PHRASE_WORDS = {p[0] for p in POSTINGS if p[3]}


def document_frequencies(words: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of rows of ``words`` (column words) and of those that hold each word of the vocabulary."""
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    held = words.select(F.explode(F.array_append(F.array_intersect("words", vocabulary), F.lit(""))).alias("word"))
    found = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a vocabulary's worth
    return found.pop("", 0), found


def _spots(n: int, df: dict[str, int], rare: list[str]) -> tuple[dict[str, list[int]], Column]:
    """Where a proposing word puts its units, coded word -> unit * SPAN - position, and the literal of all units' words.

    Units are the templates and after them the base phrases. A word is (word, idf of all words and of the indexed ones,
    each as a share of the unit, mandatory). Every indexed word of a template proposes, of a base phrase its rarest."""
    units = [(notice.split(), MANDATORY.get(label, keys), rare) for label, notice, keys in TEMPLATES]
    units += [(k.split(), [k], [min(k.split(), key=lambda w: df.get(w, 0))]) for k, _ in BASE]
    proposed, rows = {}, []
    for u, (words, keys, proposers) in enumerate(units):
        must = {i + j for k in map(str.split, keys) for i in [_first(words, k)] for j in range(len(k))}
        idf = [math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in words]
        known = [x if w in rare else 0.0 for w, x in zip(words, idf)]
        for i, w in enumerate(words):
            if w in proposers:
                proposed.setdefault(w, []).append(u * SPAN - i)
        rows.append(F.array(*(F.struct(F.lit(w).alias("word"), F.lit(i).alias("i"), F.lit(x / sum(idf)).alias("all"),
                                       F.lit(y / (sum(known) or 1.0)).alias("known"), F.lit(int(i in must)).alias("must"))
                              for i, (w, x, y) in enumerate(zip(words, idf, known)))))
    return proposed, F.array(*rows)


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: counts, places and labels of licence words (see the module's text)."""
    words = docs.select("doc_id", F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    n, df = document_frequencies(words)
    rare = [w for w in VOCABULARY if w in PHRASE_WORDS or df.get(w, 0) <= COMMON * n]
    proposed, units = _spots(n, df, rare)
    needed = [len({i for k in MANDATORY.get(label, keys) for i in range(_first(notice.split(), k.split()),
              _first(notice.split(), k.split()) + len(k.split()))}) for label, notice, keys in TEMPLATES]
    needed = F.array(*map(F.lit, needed + [len(k.split()) for k, _ in BASE]))
    names = F.array(*(F.lit(label) for label, *_ in TEMPLATES), *(F.lit(label) for _, label in BASE))

    # proposed places, one number each (unit * SPAN + place + MARGIN): distinct by hash, however long the file
    some = F.arrays_overlap("words", F.array(*map(F.lit, proposed)))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("bigint").alias("i"))),
                  lambda s: s.word.isin(list(proposed)))
    spots = F.create_map(*(c for w, x in proposed.items() for c in (F.lit(w), F.array(*(F.lit(v).cast("bigint") for v in x)))))
    places = F.array_distinct(F.flatten(F.transform(at, lambda s: F.transform(
        F.coalesce(F.element_at(spots, s.word), F.array().cast("array<bigint>")), lambda v: v + s.i + MARGIN))))
    met = words.select("doc_id", "words", F.when(some, places).alias("places"))  # files without any skip the positions

    def compared(code: Column) -> Column:
        """A place laid against all words of its unit."""
        unit, place = F.shiftright(code, SHIFT).cast("int"), (code.bitwiseAND(SPAN - 1) - MARGIN).cast("int")
        same = F.filter(F.get(units, unit), lambda s: F.get("words", place + s.i) == s.word)
        total = lambda m, f, zero: F.aggregate(m, F.lit(zero), lambda acc, s: acc + s[f])
        return F.get(F.transform(F.array(same), lambda m: F.struct(
            unit.alias("unit"), place.alias("place"), total(m, "known", 0.0).alias("known"),
            ((total(m, "must", 0) == F.get(needed, unit)) & ((unit >= len(TEMPLATES)) | (total(m, "all", 0.0) >= COVERAGE - 1e-12)))
            .alias("full"))), F.lit(0))

    met = met.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.transform("places", compared).alias("met"))
    full = F.filter("met", lambda m: m.full)
    met = met.select("doc_id", "n_words", full.alias("full"), F.filter(full, lambda m: m.unit >= len(TEMPLATES)).alias("base"),
                     F.array_max(F.transform(F.filter("met", lambda m: m.unit < len(TEMPLATES)),
                                             lambda m: F.when(m.full, m.known).otherwise(m.known / 2))).alias("best"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: F.get(names, m.unit)))), ","), F.lit(""))
    starts = F.transform("base", lambda m: m.place.cast("bigint"))
    n_base = F.greatest(F.coalesce(F.size("base"), F.lit(0)), F.lit(0)).cast("bigint")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(n_base > 0, 0.5).otherwise(0.0))
    return met.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("base").alias("base_labels"), joined("full").alias("labels"),
        F.least(F.lit(1.0), F.floor(score * 1e6 + 0.5) / 1e6).alias("score"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: The same result from word lists: phrases and templates are laid against every place where one of their words stands.
ORACLE_SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
posting(word, unit, p, phrase) AS (VALUES {_values(POSTINGS)}),
need(unit, skey, k) AS (VALUES {_values(NEEDS)}),
base(skey, label) AS (VALUES {_values(BASE)}),
tok AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM words),
lic AS (SELECT rid, word, i FROM tok WHERE word IN (SELECT word FROM posting)),
dfs AS (SELECT word, count(DISTINCT rid) AS df FROM lic GROUP BY word),
vocab AS (SELECT w.word, coalesce(df, 0) AS df, ln(((SELECT count(*) FROM words)::DOUBLE + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
          FROM (SELECT DISTINCT word FROM posting) w LEFT JOIN dfs USING (word)
          WHERE w.word IN (SELECT word FROM posting WHERE phrase) OR coalesce(df, 0) <= {COMMON} * (SELECT count(*) FROM words)),
idx AS (SELECT p.*, v.idf, sum(v.idf) OVER (PARTITION BY unit) AS mass, count(*) OVER (PARTITION BY unit) AS n_unit
        FROM posting p JOIN vocab v USING (word)),
anchor AS (SELECT rid, word FROM (SELECT DISTINCT rid, word FROM lic) JOIN vocab USING (word)
           QUALIFY row_number() OVER (PARTITION BY rid ORDER BY df, word) <= {ANCHORS}),
met AS (SELECT l.rid, x.unit, x.phrase, l.i - x.p AS place, count(*) AS n, max(n_unit) AS n_unit, sum(idf) / max(mass) AS coverage,
               bool_or(a.word IS NOT NULL) AS anchored
        FROM lic l JOIN idx x USING (word) LEFT JOIN anchor a ON a.rid = l.rid AND a.word = l.word GROUP BY ALL),
places AS (SELECT rid, unit AS skey, place AS start FROM met WHERE phrase AND n = n_unit),
wanted AS (SELECT rid, unit, place, coverage FROM met WHERE NOT phrase AND anchored),
good AS (SELECT w.rid, w.unit, w.place, w.coverage FROM wanted w WHERE coverage >= {COVERAGE} AND NOT EXISTS (
           SELECT 1 FROM need n WHERE n.unit = w.unit AND (w.rid, n.skey, w.place + n.k) NOT IN (SELECT (rid, skey, start) FROM places))),
facts AS (SELECT rid, start, label AS base, label, 0.5::DOUBLE AS score FROM places JOIN base USING (skey)
          UNION ALL SELECT rid, NULL, NULL, unit, coverage FROM good
          UNION ALL SELECT rid, NULL, NULL, NULL, coverage / 2 FROM wanted)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       least(1.0::DOUBLE, floor(coalesce(score, 0)::DOUBLE * 1e6 + 0.5) / 1e6) AS score
FROM words LEFT JOIN (
  SELECT rid, count(start) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word,
         array_to_string(list_sort(list(DISTINCT base) FILTER (base IS NOT NULL)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ',') AS labels, max(score) AS score
  FROM facts GROUP BY rid) USING (rid)
"""
