"""License scans: phrase places and an exact set-similarity join of text blocks with templates (native).

Blocks are windows of BLOCK words every BLOCK / 2 words, so any run of up to BLOCK / 2 + 1 words lies
whole in one. Templates of more words go by longer blocks: BLOCK doubled until such a run holds them.
A block meets a template when it holds at least THRESHOLD of the template's distinct words.

1. One pass over the texts finds the places of all words of templates and phrases (postings), by chunks of half a block,
   and writes them to the shared folder. All that follows reads the postings, no text. Words of no template cannot add to an
   overlap, so block sets keep template words only.
2. Template words are counted over all documents; their rank by ascending frequency, then the word, is
   the global order.
3. A template of size t that needs n common words is indexed by its t - n + 1 rarest words (prefix):
   a block without any of them shares at most n - 1.
4. Blocks meet the index by word. A meeting at position i of the template and j of the block is dropped if
   the block has fewer than n template words (length) or if 1 + min(t - i - 1, b - j - 1) < n (position);
   the first common word of a pair that qualifies always passes.
5. What is left is verified on whole sets. Phrases are runs of neighbouring postings.

Everything is a DataFrame expression. The index is broadcast: its size is that of the template
library, of MAX_TEMPLATE_WORDS words at most, beyond which `scan` raises.

Defined cases: null text is empty: no words, no labels (''), score 0; null ids stay; repeated rows give
equal rows; a very long text is a row with more blocks; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

BLOCK = 64
THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 5000
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence notices and whole texts; the label that a block which meets one gives its document.
TEMPLATES = {
    "notice-gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "notice-gpl-short": "this work is licensed under the gnu general public license version 3",
    "notice-apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "notice-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice-mit-short": "released under the mit license see the license file for details",
    "notice-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice-mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "notice-cc": "this work is licensed under a creative commons attribution 4 0 international license",
    "text-mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "text-isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
}
#: Characters of words in lower-cased text. All others below 0x80 are named one by one: a class of single characters is looked up
#: in a table, a class of ranges is tried range by range, at five times the time.
_INSIDE = string.digits + string.ascii_lowercase
_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in _INSIDE) + "]+"
#: A posting is a word's place shifted by _ID_BITS, plus the word's number.
_ID_BITS = 16


def lowered(text: Column) -> Column:
    """A-Z lower-cased, for matching ASCII words: the Kelvin sign, the one other character whose
    lower case is one ASCII letter, is first replaced by another letter that is not ASCII."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))


def _literal(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _number_of(spark: SparkSession, vocabulary: list[str]):
    """word column -> its number in the vocabulary, else null: one look-up by hash in a constant table of buckets."""
    size = 1 << max(4, (2 * len(vocabulary)).bit_length())
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")
    at = spark.range(1).select(F.transform(_literal(vocabulary, "array<string>"), bucket)).first()[0]
    buckets: list = [None] * size
    for i, (w, k) in enumerate(zip(vocabulary, at, strict=True)):
        buckets[k] = [*(buckets[k] or ()), {"w": w, "i": i}]
    known = _literal(buckets, "array<array<struct<w string, i int>>>")

    def number(word: Column) -> Column:
        here = F.get(known, bucket(word))
        return F.when(here.isNotNull(), F.get(F.filter(here, lambda e: e["w"] == word), F.lit(0))["i"])

    return number


def postings(docs: DataFrame, vocabulary: list[str], chunk: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, row (its own number), n_words, chunks: for each run of `chunk` words the postings of the vocabulary. The one pass over the texts."""
    number = _number_of(docs.sparkSession, vocabulary)
    words = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(lowered(F.col(text_col)), F.lit(_WORD), F.lit(0)).alias("words"))

    def places(k: Column) -> Column:
        one = lambda w, i: F.shiftleft((k * chunk + i).cast("long"), _ID_BITS).bitwiseOR(number(w).cast("long"))
        return F.filter(F.transform(F.slice("words", k * chunk + 1, chunk), one), lambda p: p.isNotNull())

    every = F.sequence(F.lit(0), F.expr(f"(greatest(size(words), 1) - 1) div {chunk}").cast("int"))
    return words.select(id_col, "row", F.size("words").cast("long").alias("n_words"), F.transform(every, places).alias("chunks"))


def _word_no(p: Column) -> Column:
    return p.bitwiseAND(F.lit((1 << _ID_BITS) - 1)).cast("int")


def _base(vocabulary: list[str], phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base: a phrase stands where its words' postings follow each other at neighbouring places."""
    no, every = {w: i for i, w in enumerate(vocabulary)}, F.flatten("chunks")

    def places(phrase: str) -> Column:
        ids = [no[w] for w in phrase.split()]

        def starts(p: Column, i: Column) -> Column:
            here = _word_no(p) == ids[0]
            for k, w in enumerate(ids[1:], 1):
                here &= F.get(every, i + k) == p + ((k << _ID_BITS) + w - ids[0])
            return F.coalesce(here, F.lit(False))

        return F.transform(F.filter(every, starts), lambda p: F.shiftright(p, _ID_BITS))

    found = {p: places(p) for p in phrases}
    hits = F.concat(*found.values())
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(phrases[p])) for p, c in found.items()]))))
    return {"n_base": F.size(hits).cast("long"), "first_word": F.array_min(hits), "last_word": F.array_max(hits), "base": labels}


def word_order(posted: DataFrame, vocabulary: list[str], of_templates: set[str]) -> list[str]:
    """The templates' words from rare to frequent over all documents. At most one row for each word of the vocabulary comes to the driver."""
    counted = posted.select(F.explode(F.flatten("chunks")).alias("p")).groupBy(_word_no(F.col("p")).alias("w")).count().collect()
    count = {vocabulary[r["w"]]: r["count"] for r in counted}
    return sorted(of_templates, key=lambda w: (count.get(w, 0), w))


def block_sizes(templates: dict[str, str], block: int = BLOCK) -> dict[str, int]:
    """The block that each template goes by."""
    out = {}
    for label, text in templates.items():
        out[label] = block
        while len(text.split()) > out[label] // 2 + 1:
            out[label] *= 2
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, matches). documents: id, row, n_words, n_base, first_word, last_word, base. matches: id, row, label,
    first word of the block, containment; one row per block and template that meet. `block` is even."""
    spark = docs.sparkSession
    sets = {label: set(text.split()) for label, text in templates.items()}
    of_templates = set().union(*sets.values())
    vocabulary = sorted(of_templates.union(*(p.split() for p in phrases)))
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates have over {MAX_TEMPLATE_WORDS} words")
    chunk = block // 2
    posted = materialise(postings(docs, vocabulary, chunk, id_col, text_col), "license-postings")
    order = word_order(posted, vocabulary, of_templates)
    rank = {w: i for i, w in enumerate(order)}
    ranks = _literal([rank.get(w) for w in vocabulary], "array<int>")
    documents = posted.select(id_col, "row", "n_words", *[c.alias(k) for k, c in _base(vocabulary, phrases).items()])
    # Ranks by chunk, each word once: what a block holds is the union of its chunks.
    ranked = posted.select(id_col, "row", "n_words", F.transform("chunks", lambda c: F.array_distinct(F.filter(F.transform(c, lambda p: F.get(ranks, _word_no(p))), lambda r: r.isNotNull()))).alias("chunks"))

    def meet(labels: list[str], size: int) -> DataFrame:
        index, rarest, least = [], set(), 1 << 30
        for label in labels:
            own = sorted(rank[w] for w in sets[label])
            need = math.ceil(threshold * len(own) - 1e-9)
            index += [{"label": label, "i": i, "rank": own[i], "t": len(own), "need": need, "ranks": own} for i in range(len(own) - need + 1)]
            rarest |= set(own[: len(own) - need + 1])
            least = min(least, need)
        indexed = spark.range(1).select(F.inline(_literal(index, "array<struct<label string, i int, rank int, t int, need int, ranks array<int>>>")))
        prefix, half = _literal(sorted(rarest), "array<int>"), size // 2
        hopeful = ranked.where(F.arrays_overlap(F.flatten("chunks"), prefix))
        block_at = lambda s: F.array_sort(F.array_distinct(F.flatten(F.slice("chunks", F.lit(1) + (s / chunk).cast("int"), size // chunk))))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n_words").cast("int") - half - 1), F.lit(half))
        cut = hopeful.select(id_col, "row", F.explode(F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), block_at(s).alias("b"))), lambda x: (F.size(x["b"]) >= least) & F.arrays_overlap(x["b"], prefix))).alias("x")).select(id_col, "row", "x.start", "x.b")
        met = cut.select(id_col, "row", "start", "b", F.posexplode("b").alias("j", "rank")).join(F.broadcast(indexed), "rank")
        b = F.size("b")
        met = met.where((b >= F.col("need")) & (1 + F.least(F.col("t") - F.col("i") - 1, b - F.col("j") - 1) >= F.col("need")))
        common = F.size(F.array_intersect("b", "ranks"))
        return met.where(common >= F.col("need")).select(id_col, "row", "label", "start", (common / F.col("t")).alias("containment")).distinct()

    sizes = block_sizes(templates, block)
    matches = reduce(DataFrame.unionByName, [meet([k for k, n in sizes.items() if n == size], size) for size in sorted(set(sizes.values()))])
    return documents, matches


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document row with its phrases, its labels and score: the largest containment that met a template, 1 where a phrase stands."""
    documents, matches = scan(docs, id_col=id_col, text_col=text_col, **options)
    found = matches.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("containment").alias("containment"))
    both = documents.join(found, "row", "left")
    added = F.coalesce("added", F.array().cast("array<string>"))
    return both.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", added)), ",").alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Brute force: every block against every template."""
    w = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    sizes = block_sizes(TEMPLATES)
    arrays = ", ".join(f"('{k}', {sizes[k]}, [{', '.join(repr(x) for x in sorted(set(t.split())))}])" for k, t in TEMPLATES.items())
    phrases = ", ".join(f"('{label}', [{', '.join(repr(x) for x in p.split())}])" for p, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {w}) AS ws FROM documents),
t(label, size, tw) AS (VALUES {arrays}), p(label, pw) AS (VALUES {phrases}),
h AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
hit AS (SELECT doc_id, label, i - 1 AS pos FROM h, p WHERE ws[i] = pw[1] AND ws[i : i + len(pw) - 1] = pw),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS bl FROM hit GROUP BY doc_id),
blocks AS (SELECT doc_id, size, list_distinct(ws[s + 1 : s + size]) AS b
           FROM (SELECT doc_id, ws, size, unnest(range(0, greatest(len(ws) - size // 2, 1), size // 2)) AS s FROM d, (SELECT DISTINCT size FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(b, tw)) AS c, len(tw) AS n FROM blocks JOIN t USING (size) WHERE list_has_any(b, tw)),
tm AS (SELECT doc_id, list(DISTINCT label) AS tl, max(c / n) AS s FROM m WHERE c >= ceil({THRESHOLD} * n - 1e-9) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(bl, []::VARCHAR[])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []::VARCHAR[]), coalesce(tl, []::VARCHAR[])))), ',') AS labels,
       greatest(coalesce(s, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN tm USING (doc_id)
"""


OP7_SQL = _oracle()
