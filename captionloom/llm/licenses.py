"""License scans: fixed phrases, and a positional index of rare licence words in notices.

The licence words (those of the notices' key phrases that are not everyday words) are counted over all files. A
file's own licence words are taken in the order of their inverse document frequency, highest first, and looked
up in the key phrases until every notice that shares one has been tried: its place in the file less its place in
the notice is an offset at which the notice may stand. There the postings of all words of the notice are intersected with
the file's by relative position, give or take ``GAP`` words, so that a few words may be missing or put in; the key
phrase must stand word by word. So a notice is found wherever its key phrase stands and ``COVER`` of its words stand
about it, whatever else the file holds. All of it is column functions; texts are read once and never exchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionloom.llm.common import BETWEEN, let, lower_ascii
from captionloom.session import materialize

#: The phrases every scan reports, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, notice as it stands in files, and the phrase that must be in it.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "copy modify merge publish distribute sublicense"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
]
#: Words too common to be looked up, in any of the languages.
EVERYDAY = set(
    "a above all and any are authors be by can charge code copy derived event form forms free from held in into is it mit "
    "modify must nc no notice of or person products related released rights sa software source subject terms the this to under "
    "use used will with without work you 0 1 2 3 4".split()
)
#: Words by which a word of a notice may be out of its place; share of the notice's words that must stand.
GAP = 4
COVER = 0.7


def _words(text: str) -> list[str]:
    return text.split(" ")


def _key_at(text: str, key: str) -> int:
    return len(f" {text} ".split(f" {key} ")[0].split())


#: The licence words that are looked up.
VOCABULARY = sorted({w for _, _, k in TEMPLATES for w in _words(k)} - EVERYDAY)


def _literal(rows: list) -> Column:
    return F.array(*rows)


def tokenized(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words`` and, of texts with a licence word, all ``words``: written, texts read once."""
    # Empty strings are left at the ends only, where the text does not begin or end with a word.
    every = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), BETWEEN), "")
    vocabulary = _literal([F.lit(w) for w in VOCABULARY])

    def cut(every: Column) -> Column:
        # Every base phrase has a word of the vocabulary, so texts without one hold nothing to find.
        kept = F.when(F.arrays_overlap(every, vocabulary), every)
        return F.struct(F.size(every).cast("long").alias("n_words"), kept.alias("words"))

    return materialize(docs.select("doc_id", let(every, cut).alias("seen")).select("doc_id", "seen.*"), "words")


def idf(rows: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each of the ``VOCABULARY``, over all files."""
    vocabulary = _literal([F.lit(w) for w in VOCABULARY])
    total = rows.count()
    seen = rows.filter("words IS NOT NULL").select(F.explode(F.array_intersect("words", vocabulary)).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in VOCABULARY}


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, places`` (start, label of each base phrase) and ``found`` (label, start, cover).

    Null text has no words.
    """
    rows = tokenized(docs.select("doc_id", "text"))
    weights = idf(rows)
    vocabulary = _literal([F.lit(w) for w in VOCABULARY])
    by_rarity = _literal([F.lit(w) for w in sorted(VOCABULARY, key=lambda w: (-weights[w], w))])
    # Where each licence word of a notice's key phrase stands in the notice, by the notice's number.
    postings = _literal(
        [
            F.create_map(*[c for w in dict.fromkeys(_words(key)) if w in weights for c in (F.lit(w), F.lit(_key_at(text, key) + _words(key).index(w)))])
            for _, text, key in TEMPLATES
        ]
    )
    texts = _literal([_literal([F.lit(w) for w in _words(t)]) for _, t, _ in TEMPLATES])
    keys = _literal([_literal([F.lit(w) for w in _words(k)]) for _, _, k in TEMPLATES])
    key_at = _literal([F.lit(_key_at(t, k)) for _, t, k in TEMPLATES])
    names = _literal([F.lit(label) for label, _, _ in TEMPLATES])

    words = F.col("words")
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_contains(vocabulary, s["w"])
    )

    def offsets(hits: Column) -> Column:
        """Of each notice that shares a licence word with the file, the offsets of the rarest such word."""

        def tried(own: Column) -> Column:
            chosen = F.transform(postings, lambda p, t: F.struct(t.alias("t"), F.get(F.filter(own, lambda w: F.map_contains_key(p, w)), 0).alias("w")))
            at = lambda c: F.transform(
                F.filter(hits, lambda s: s["w"] == c["w"]), lambda s: F.struct(c["t"].alias("t"), (s["i"] - postings[c["t"]][c["w"]]).alias("at"))
            )
            return F.flatten(F.transform(F.filter(chosen, lambda c: c["w"].isNotNull()), at))

        return let(F.array_intersect(by_rarity, F.transform(hits, lambda s: s["w"])), tried)

    def standing(o: Column) -> Column:
        """The words of the notice that the file has within ``GAP`` words of their place."""

        def stands(w: Column, k: Column) -> Column:
            first = F.greatest(o["at"] + k - GAP, F.lit(0))
            return F.array_contains(F.slice(words, first + 1, F.greatest(o["at"] + k + GAP + 1 - first, F.lit(0))), w)

        return F.filter(texts[o["t"]], stands)

    def keyed(o: Column) -> Column:
        start = o["at"] + key_at[o["t"]]
        return F.when(start >= 0, F.slice(words, start + 1, F.size(keys[o["t"]])) == keys[o["t"]]).otherwise(False)

    def verified(offsets: Column) -> Column:
        def told(o: Column) -> Column:
            cover = F.size(standing(o)) / F.size(texts[o["t"]])
            return F.struct(names[o["t"]].alias("label"), F.greatest(o["at"], F.lit(0)).alias("start"), cover.alias("cover"))

        return F.filter(F.transform(F.filter(offsets, keyed), told), lambda v: v["cover"] >= COVER)

    def labelled(hits: Column, phrase: str, label: str) -> Column:
        """Places of a base phrase, found from its word that is in the vocabulary."""
        parts = _words(phrase)
        anchor = next(k for k, w in enumerate(parts) if w in VOCABULARY)

        def stands(s: Column) -> Column:
            ok = (s["w"] == parts[anchor]) & (s["i"] >= anchor)
            for k, word in enumerate(parts):
                if k != anchor:
                    ok = ok & F.coalesce(F.get(words, F.greatest(s["i"] + (k - anchor), F.lit(0))) == word, F.lit(False))
            return ok

        return F.transform(
            F.filter(hits, stands), lambda s: F.struct((s["i"] - anchor).alias("start"), F.lit(label).alias("label"))
        )

    def both(hits: Column) -> Column:
        aligned = let(offsets(hits), verified)
        places = F.flatten(F.array(*[labelled(hits, phrase, label) for phrase, label in PHRASES.items()]))
        return F.struct(places.alias("places"), aligned.alias("found"))

    has = words.isNotNull()
    seen = rows.select("doc_id", "n_words", F.when(has, let(hits, both)).alias("seen"))
    return seen.select("doc_id", "n_words", F.col("seen.places").alias("places"), F.col("seen.found").alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    ``score`` is 1 where a base phrase stands, else the share of the best notice's words that stand about their place, or 0.
    """
    rows = scan(docs)
    starts = F.transform("places", lambda p: p["start"])
    base = F.coalesce(F.transform("places", lambda p: p["label"]), F.array().cast("array<string>"))
    more = F.coalesce(F.transform("found", lambda p: p["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("found", lambda p: p["cover"])), F.lit(0.0))
    n = F.coalesce(F.size("places"), F.lit(0))
    return rows.select(
        "doc_id",
        "n_words",
        F.greatest(n, F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
