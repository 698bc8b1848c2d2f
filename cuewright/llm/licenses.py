"""Licence scan by a positional rare-token index, in DataFrame functions only.

How many documents hold each licence word is counted over the whole corpus. Of each template's key phrase,
which is mandatory, the RANKS words of highest IDF go into the index with their places. A file's indexed
words, rarest of a template first, each propose templates and the place where the template would begin; the
proposals of a template's RANKS words are intersected, so a start stays if all of them stand at their
relative places. A candidate is verified: the key phrase must stand there whole, and of all the template's
words a share of COVER must stand within DRIFT places of theirs, so a few inserted or lost words do no harm.
A template found gives its label. A file may begin or end inside a template.

Beside that stand the base phrases, found by their words in sequence. One projection does it all: no join
and no shuffle but the count of licence words.

Defined results: null text counts as empty; no words give zero counts, null places, empty labels and score
0. Very long texts are scanned whole. Repeated rows are scanned each and alike; of templates that match
equally all labels are given. An empty table gives no rows. Other columns pass through whatever their names;
those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, read

COVER, DRIFT, RANKS = 0.8, 2, 3
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, template, key phrase) in the licences' public wording, lower-cased words only.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "free of charge to any person obtaining a copy"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "copies or substantial portions of the software"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "the mit license"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program", "in the hope that it will be useful"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "must reproduce the above copyright notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "use copy modify and or distribute this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPAN = 1 << 40  # above any place in a text


def key_place(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _words(text: str) -> Column:
    """Words of the lower-cased text, none of them empty."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.trim(F.regexp_replace(low, _SEPARATORS, " ")), " ")


def vocabulary() -> list[str]:
    return sorted({w for _, t, _ in TEMPLATES for w in t.split()})


def document_counts(docs: DataFrame) -> dict[str, int]:
    """In how many documents each licence word stands, over all documents."""
    own = F.array_intersect(_words("text"), F.array(*[F.lit(w) for w in vocabulary()]))
    return {r["w"]: r["n"] for r in docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row for each licence word


def index(counts: dict[str, int]) -> list[dict[str, list[tuple[int, int]]]]:
    """For each rank, word -> [(template, place)]: rank r holds each template's r-th rarest key word.

    A template with fewer key words repeats its last one, so all ranks have all templates.
    """
    out: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(RANKS)]
    for t, (_, text, key) in enumerate(TEMPLATES):
        words, need = text.split(), key.split()
        at = key_place(words, need)
        rare = sorted(set(need), key=lambda w: (counts.get(w, 0), w))[:RANKS]
        for r in range(RANKS):
            word = rare[min(r, len(rare) - 1)]
            out[r].setdefault(word, []).extend((t, at + p) for p, w in enumerate(need) if w == word)
    return out


def scan(docs: DataFrame, counts: dict[str, int]) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and matches."""
    out = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    kept = [c for c in docs.columns if c.lower() not in out]
    words, places, starts, base_, *phrase = free(docs, "_words", "_places", "_starts", "_base", *[f"_{x}" for x in BASE.values()])
    lit_array = lambda values: F.array(*[F.lit(v) for v in values])  # noqa: E731  folded once, not made for each row
    table = []
    for label, text, key in TEMPLATES:
        own, need = text.split(), key.split()
        table.append(F.struct(F.lit(label).alias("label"), lit_array(own).alias("words"), F.lit(key_place(own, need)).alias("key_at"), lit_array(need).alias("key")))
    templates, ranks = F.array(*table), index(counts)
    rare = sorted({*ranks[0], "license"})  # a text without any of these has no match and no base phrase
    df = docs.drop(*out).withColumn(words, _words("text"))
    df = df.withColumn("n_words", F.when(F.col(words)[0] == "", F.lit(0)).otherwise(F.size(words)).cast("bigint"))
    df = df.withColumn(words, F.when(F.arrays_overlap(words, lit_array(rare)), F.col(words)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(places, F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>")))
    word = lambda i: F.get(words, i)  # noqa: E731  null outside

    def stands(own: list[str]):
        def here(i):
            found = word(i) == own[0]
            for k, w in enumerate(own[1:], 1):
                found = found & (word(i + k) == w)
            return found

        return here

    df = df.withColumns({c: F.filter(places, stands(x.split())) for c, x in zip(phrase, BASE, strict=True)})

    def proposed(rank: dict) -> Column:
        """template * _SPAN + start for each posting of each of the rank's words that stand in the text."""
        table = F.create_map(*[x for w, ps in sorted(rank.items()) for x in (F.lit(w), F.array(*[F.lit(t * _SPAN - p).cast("bigint") for t, p in ps]))])
        at = F.filter(places, lambda i: F.coalesce(word(i).isin(*rank), F.lit(False)))
        return F.flatten(F.transform(at, lambda i: F.transform(F.element_at(table, word(i)), lambda x: x + i)))

    both = proposed(ranks[0])
    for rank in ranks[1:]:
        both = F.array_intersect(both, proposed(rank))
    df = df.withColumn(starts, F.when(F.size(words) > 0, F.array_distinct(both)).otherwise(F.array().cast("array<bigint>")))

    def verified(x: Column) -> Column:
        # a start may be negative, as far as a template is long: the file begins inside it
        t = F.floor((x + (1 << 20)) / _SPAN).cast("int")
        start, own = (x - t * F.lit(_SPAN)).cast("int"), F.get(templates, t)

        def near(p) -> Column:
            lo = F.greatest(start + p - DRIFT, F.lit(0))
            return F.slice(words, lo + 1, F.greatest(start + p + DRIFT - lo + 1, F.lit(0)))

        in_place = F.size(F.filter(F.transform(own["words"], lambda w, p: F.array_contains(near(p), w)), lambda hit: hit))
        key = F.transform(own["key"], lambda w, p: F.coalesce(word(start + own["key_at"] + p) == w, F.lit(False)))
        whole = ~F.array_contains(key, F.lit(False))
        return F.struct(own["label"].alias("label"), start.cast("bigint").alias("start"), F.when(whole, in_place / F.size(own["words"])).otherwise(F.lit(0.0)).alias("cover"))

    df = df.withColumn("matches", F.array_sort(F.filter(F.transform(starts, verified), lambda m: m["cover"] >= COVER)))
    every = F.concat(*[F.col(c) for c in phrase])
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(x)) for c, x in zip(phrase, BASE.values(), strict=True)])))
    df = df.withColumns({"n_base": F.size(every).cast("bigint"), "first_word": F.array_min(every).cast("bigint"), "last_word": F.array_max(every).cast("bigint"), base_: found})
    df = df.withColumn("base_labels", F.array_join(base_, ","))
    df = df.withColumn("labels", F.array_join(F.array_sort(F.array_union(base_, F.transform("matches", lambda m: m["label"]))), ","))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["cover"])), F.lit(0.0))
    df = df.withColumn("score", F.greatest(best, F.when(F.size(base_) > 0, F.lit(COVER)).otherwise(F.lit(0.0))))
    return df.select(*kept, *out)


def query(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, document_counts(docs)).drop("text", "matches")
