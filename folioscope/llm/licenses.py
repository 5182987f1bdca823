"""License scan: an exact set-similarity join of text blocks with templates, in
DataFrame expressions only.

Texts become arrays of words. The templates' tokens are ordered by how often they
occur in the whole corpus, rarest first. A block (a window of ``block`` words, or of twice
the template's words if that is more, every half block) contains a template if at least
``threshold`` of the template's distinct tokens occur in it. Three filters leave few
blocks to verify, and lose none:

* prefix: a block with need = ceil(threshold * m) of m tokens holds one of the
  m - need + 1 rarest, and ``more`` + 1 of the m - need + 1 + more rarest;
* position: the prefix tokens that a block holds are walked in their order. After the
  k-th one, at place r of the order (both from 1), the block can hold k + m - r tokens at
  most, and past the prefix no more than it held there and what is left of the template;
  both must be need or more;
* length: it has at least need distinct words.

Phrases are templates with threshold 1 whose words must also stand consecutively,
so their prefix is their rarest token; each of its places is verified.

Everything about a document is found inside its row, so no group of documents
meets in one task. The number of occurrences of each template token is the only
thing that reaches the driver.

Defined results: null and empty texts have no words, no labels and score 0; very
long texts are scanned whole; repeated rows are scanned each; an empty table gives
no rows; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case

THRESHOLD = 0.8
BLOCK = 128
#: Prefix tokens beyond the first that a block has to hold.
MORE = 2
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Openings of public license texts and one whole text, as words.
TEMPLATES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at",
        "apache-2",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "bsd",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation",
        "gpl",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
        "from out of or in connection with the software or the use or other dealings in the software",
        "mit-full",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
)


def words_column(text: str) -> Column:
    folded = fold_case(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    return F.filter(F.split(folded, _BETWEEN, -1), lambda w: w != "")


def token_counts(docs: DataFrame, tokens: list[str], text: str = "text") -> dict[str, int]:
    """How often each of the tokens occurs; a row per token reaches the driver."""
    words = docs.select(F.explode(words_column(text)).alias("word")).filter(F.col("word").isin(tokens))
    found = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    return {t: found.get(t, 0) for t in tokens}


def _order(tokens: set[str], counts: dict[str, int]) -> list[str]:
    return sorted(tokens, key=lambda t: (counts[t], t))


def find_licenses(
    docs: DataFrame,
    text: str = "text",
    found: str = "found",
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """docs with one more column: n_words, places (label and first word of each
    phrase found, words from 0), blocks (label, first word and containment of each
    block that contains a template) and score: 1 if a phrase was found, else the
    largest containment of a block found, else 0."""
    spoken = [(p.split(), label) for p, label in phrases]
    sets = [(set(t.split()), label) for t, label in templates]
    halves = [max(block // 2, len(t.split())) for t, _ in templates]
    tokens = sorted({t for p, _ in spoken for t in p} | {t for s, _ in sets for t in s})
    counts = token_counts(docs, tokens, text)
    rarest = [_order(set(p), counts)[0] for p, _ in spoken]
    ordered = [(_order(s, counts), label) for s, label in sets]
    needs = [math.ceil(threshold * len(t) - 1e-9) for t, _ in ordered]
    prefixes = [t[: len(t) - need + 1 + min(MORE, need - 1)] for (t, _), need in zip(ordered, needs, strict=True)]
    wanted = sorted({*rarest, *(t for p in prefixes for t in p)})

    keep = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*keep).alias("row"), words_column(text).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
    packed = packed.select("row", "words", hits.alias("hits"))
    words, hit = F.col("words"), F.col("hits")

    def places(phrase: list[str], label: str, anchor: str) -> Column:
        offset = phrase.index(anchor)
        wanted_words = F.array(*[F.lit(w) for w in phrase])

        def stands(h: Column) -> Column:
            start = h["at"] - offset
            return (h["word"] == anchor) & (start >= 0) & (F.slice(words, F.greatest(start + 1, F.lit(1)), len(phrase)) == wanted_words)

        return F.transform(F.filter(hit, stands), lambda h: F.struct(F.lit(label).alias("label"), (h["at"] - offset).cast("long").alias("start")))

    def blocks(template: list[str], label: str, need: int, prefix: list[str], half: int) -> Column:
        m, first = len(template), len(prefix)
        own = F.array(*[F.lit(t) for t in template])
        at = F.filter(hit, lambda h: h["word"].isin(prefix))
        numbers = F.array_distinct(F.flatten(F.transform(at, lambda h: F.array(F.floor(h["at"] / half), F.floor(h["at"] / half) - 1))))

        def verified(b: Column) -> Column:
            inside = F.slice(words, (b * half + 1).cast("int"), 2 * half)
            share = F.when(F.size(F.array_distinct(inside)) >= need, F.size(F.array_intersect(own, inside)) / F.lit(float(m))).otherwise(0.0)
            return F.struct(F.lit(label).alias("label"), (b * half).cast("long").alias("start"), share.alias("share"))

        def walked(b: Column) -> Column:
            """Whether the walk through the prefix leaves need within reach."""
            held = F.filter(at, lambda h: F.floor(h["at"] / half).isin(b, b + 1))
            places = F.array_sort(F.array_distinct(F.transform(held, lambda h: F.array_position(own, h["word"]))))
            return (F.size(places) + (m - first) >= need) & F.forall(F.transform(places, lambda r, k: k + 1 + m - r), lambda most: most >= need)

        return F.transform(F.filter(numbers, lambda b: (b >= 0) & walked(b)), verified)

    some = F.size(hit) > 0
    none_places = F.array().cast("array<struct<label:string,start:bigint>>")
    none_blocks = F.array().cast("array<struct<label:string,start:bigint,share:double>>")
    found_places = F.flatten(F.array(none_places, *[places(p, label, a) for (p, label), a in zip(spoken, rarest, strict=True)]))
    tried = F.flatten(F.array(none_blocks, *[blocks(t, label, need, p, h) for (t, label), need, p, h in zip(ordered, needs, prefixes, halves, strict=True)]))
    packed = packed.select("row", "words", F.when(some, found_places).alias("places"), F.when(some, tried).alias("tried"))
    contained = F.coalesce(F.filter("tried", lambda b: b["share"] >= threshold), none_blocks)
    packed = packed.select("row", F.size("words").cast("long").alias("n_words"), F.coalesce("places", none_places).alias("places"), contained.alias("blocks"))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0)))
    result = F.struct("n_words", "places", "blocks", score.alias("score"))
    return packed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], result.alias(found))


def labels_of(*found: Column) -> Column:
    """The distinct labels of places or blocks, sorted and comma-joined."""
    names = F.concat(*[F.transform(f, lambda x: x["label"]) for f in found])
    return F.array_join(F.array_sort(F.array_distinct(names)), ",")
