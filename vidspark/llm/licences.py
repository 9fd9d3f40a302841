"""Licence scan with a positional index of rare licence words, in DataFrame functions alone.

Words of the templates' mandatory phrases are counted by document in a first pass. Of each template the MIN_VOTES rarest of
them, those with the highest inverse document frequency in this table, are its index words, with the places where they
stand in it. A second pass keeps, for each text, where index words stand. Each of them is looked up; a posting at offset o
for a word at i votes for the template starting at i - o. Starts that all index words of the template vote for are compared
with the whole template there: the words of the mandatory phrases must all match, and MIN_SHARE of all words. A template that
passes has its mandatory words in place, its index words among them, so none is missed, whatever else a text or the table
holds; which words are rare decides only how much is compared. The index is as large as the template list.

Defined results: a null or empty text has no words, no label and score 0; repeated rows are scanned alike; columns other
than id and text are left out; texts are scanned whole, however long; an empty table gives no row. A text with a base phrase
and no verified template scores BASE_SCORE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import documents, lower_ascii, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_VOTES, MIN_SHARE, BASE_SCORE = 2, 0.7, 0.5

#: The phrases every scan reports, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, notice, mandatory phrases); wording of the public licences' own notices.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ["free of charge", "without restriction", "sublicense"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your option any "
     "later version", ["gnu general public license", "version 3"]),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license v 2 0"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the software", ["permission notice shall be included", "substantial portions of the software"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
     ["apache license version 2 0", "except in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license "
     "for the specific language governing permissions and limitations under the license",
     ["applicable law or agreed to in writing", "governing permissions and limitations"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
     "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
     ["in the hope that it will be useful", "gnu general public license"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
     "disclaimer", ["redistributions of source code must retain", "list of conditions"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation and or other materials provided with the distribution",
     ["redistributions in binary form must reproduce", "list of conditions"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission",
     ["endorse or promote products derived", "specific prior written permission"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software permission is granted to anyone to use this software for "
     "any purpose including commercial applications and to alter it and redistribute it freely",
     ["authors be held liable", "alter it and redistribute it freely"]),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all "
     "implied warranties of merchantability and fitness", ["author disclaims all warranties"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ["for any purpose with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["unencumbered software", "public domain"]),
    ("cc0-1.0", "licensed under cc0 1 0", ["cc0 1 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
]


def _template_rows() -> list[tuple[int, str, int, str, bool]]:
    """(template, label, place, word, mandatory)."""
    rows = []
    for t, (label, notice, phrases) in enumerate(TEMPLATES):
        words = notice.split()
        must = set()
        for phrase in phrases:
            wanted = phrase.split()
            at = next(k for k in range(len(words)) if words[k:k + len(wanted)] == wanted)
            must.update(range(at, at + len(wanted)))
        rows += [(t, label, k, w, k in must) for k, w in enumerate(words)]
    return rows


def mandatory_words() -> dict[int, list[str]]:
    """Distinct words of each template's mandatory phrases."""
    words: dict[int, set] = {}
    for t, _, _, w, must in _template_rows():
        if must:
            words.setdefault(t, set()).add(w)
    return {t: sorted(w) for t, w in words.items()}


def rarest(frequencies: dict[str, int]) -> dict[int, list[str]]:
    """Index words of each template by the documents that have a word; the first of equally rare words."""
    return {t: sorted(words, key=lambda w: (frequencies.get(w, 0), w))[:MIN_VOTES] for t, words in mandatory_words().items()}


def _array(values: list, kind: str) -> Column:
    return F.array(*values).cast(f"array<{kind}>")


def _base_at(i: Column) -> Column:
    """The label of a base phrase starting at word i, else null."""
    out = F.lit(None).cast("string")
    for phrase, label in BASE.items():
        here = F.lit(True)
        for k, word in enumerate(phrase.split()):
            here = here & F.coalesce(F.get("words", i + k) == word, F.lit(False))
        out = F.when(here, F.lit(label)).otherwise(out)
    return out


def _postings(index: dict[int, list[str]]) -> dict[str, list[int]]:
    """For each index word, template * 2^32 - place, where the places are the first of the word in a template's phrases."""
    postings: dict[str, list[int]] = {}
    done = set()
    for t, _, k, w, must in _template_rows():
        if must and w in index[t] and (t, w) not in done:
            done.add((t, w))
            postings.setdefault(w, []).append((t << 32) - k)
    return postings


def _votes(postings: dict[str, list[int]]) -> Column:
    """Template starts, as template * 2^32 + start, once for each index word that votes, from ``found`` (its places)."""
    rank = F.create_map(*[x for k, w in enumerate(postings) for x in (F.lit(w), F.lit(k))])
    lists = _array([_array([F.lit(p).cast("long") for p in ps], "bigint") for ps in postings.values()], "array<bigint>")
    return F.sort_array(F.flatten(F.transform("found", lambda i: F.transform(F.coalesce(  # words of base phrases have none
        F.get(lists, rank[F.get("words", i)]), _array([], "bigint")), lambda p: p + i))))


def document_frequencies(rows: DataFrame) -> dict[str, int]:
    """Documents that have a word, for the words of the mandatory phrases, from their ``words``."""
    wanted = sorted({w for words in mandatory_words().values() for w in words})
    each = rows.select(F.explode(F.array_intersect("words", _array([F.lit(w) for w in wanted], "string"))).alias("word"))
    return {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row a licence word


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, base: places and labels of base phrases, templates: label and share of verified templates)."""
    words = F.filter(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), lambda w: w != "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), words.alias("words"))
    index = rarest(document_frequencies(rows))
    postings = _postings(index)
    looked_up = sorted({*postings, *(phrase.split()[0] for phrase in BASE)})
    n = F.size("words")
    found = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_array([], "int")),
                     lambda i: F.get("words", i).isin(looked_up))
    rows = rows.withColumn("found", found).select(
        "doc_id", n.cast("long").alias("n_words"), "found",
        F.when(F.size("found") > 0, F.col("words")).otherwise(_array([], "string")).alias("words"))
    rows = materialize(rows, "licence-words")
    rows = rows.withColumn("votes", _votes(postings))
    vote = lambda j: F.get("votes", j)
    needed = _array([F.lit(len(index[t])) for t in range(len(TEMPLATES))], "int")
    # a start before the text is negative: the template is the next whole multiple of 2^32
    template = lambda c: F.floor((c + (1 << 31)) / F.lit(float(1 << 32))).cast("int")
    rows = rows.withColumn("starts", F.array_distinct(F.filter(
        "votes", lambda v, j: F.coalesce(vote(j + F.get(needed, template(v)) - 1) == v, F.lit(False)))))
    by_template: dict[int, list] = {}
    for t, _, _, w, m in _template_rows():
        by_template.setdefault(t, []).append(F.struct(F.lit(w).alias("word"), F.lit(m).alias("must")))
    bodies = F.array(*[F.array(*by_template[t]) for t in range(len(TEMPLATES))])
    labels = F.array(*[F.lit(t[0]) for t in TEMPLATES])

    def compared(c: Column) -> Column:
        t = template(c)
        start = (c - t.cast("long") * F.lit(1 << 32)).cast("int")
        body = F.get(bodies, t)
        at = F.transform(body, lambda x, k: F.struct(
            (F.when(start + k >= 0, F.coalesce(F.get("words", start + k) == x["word"], F.lit(False)))
             .otherwise(F.lit(False))).alias("same"), x["must"].alias("must")))
        return F.struct(F.get(labels, t).alias("label"),
                        F.forall(at, lambda x: x["same"] | ~x["must"]).alias("all"),
                        (F.size(F.filter(at, lambda x: x["same"])) / F.size(body)).alias("share"))

    rows = rows.withColumn("templates", F.filter(F.transform("starts", compared),
                                                 lambda x: x["all"] & (x["share"] >= MIN_SHARE)))
    base = F.filter(F.transform("found", lambda i: F.struct(i.cast("long").alias("at"), _base_at(i).alias("label"))),
                    lambda x: x["label"].isNotNull())
    return rows.withColumn("base", base).select("doc_id", "n_words", "base", "templates")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda name: F.transform(name, lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    place = F.transform("base", lambda x: x["at"])
    return scanned(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"), joined(label("base")).alias("base_labels"),
        joined(F.concat(label("base"), label("templates"))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce(
            F.array_max(F.transform("templates", lambda x: x["share"])), F.lit(0.0))).alias("score"))


def _sql() -> str:
    """Every place of a template's first mandatory word is a start; no index."""
    rows = ", ".join(f"({t}, '{label}', {k}, '{w}', {str(m).lower()})" for t, label, k, w, m in _template_rows())
    base = " UNION ALL ".join(
        f"SELECT a.doc_id, a.i, '{label}' AS label FROM words a " + " ".join(
            f"JOIN words w{k} ON w{k}.doc_id = a.doc_id AND w{k}.i = a.i + {k} AND w{k}.word = '{word}'"
            for k, word in enumerate(phrase.split())) for phrase, label in BASE.items())
    return rf"""
WITH listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM listed),
template(t, label, k, word, must) AS (VALUES {rows}),
opening AS (SELECT t, min(k) AS k, arg_min(word, k) AS word FROM template WHERE must GROUP BY t),
start AS (SELECT DISTINCT doc_id, t, i - k AS s FROM words JOIN opening USING (word)),
verified AS (
  SELECT start.doc_id, t, s, label, count(w.word) / count(*) AS share
  FROM start JOIN template USING (t)
  LEFT JOIN words w ON w.doc_id = start.doc_id AND w.i = s + k AND w.word = template.word
  GROUP BY start.doc_id, t, s, label
  HAVING bool_and(w.word IS NOT NULL OR NOT must) AND count(w.word) / count(*) >= {MIN_SHARE}),
base AS ({base}),
named AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM verified)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN {BASE_SCORE} ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM listed
LEFT JOIN (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY doc_id)
  USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels
           FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, max(share) AS share FROM verified GROUP BY doc_id) USING (doc_id)
"""


SQL = _sql()
