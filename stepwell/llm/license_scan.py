"""License scans by a positional rare-token index.

Templates are short licence notices, as words, each with key phrases that must stand in a file. The index maps every
licence word (words of templates but for a few function words) to its postings (template, position). A file's licence
words are ranked by inverse document frequency, counted over all documents. For each template the highest of its
own are looked up, as many as must hold ``AGREE`` different ones in place wherever the coverage is reached (see anchors), so
the rest need no look and no template hides another. Every
occurrence at file position d of a word posted at template position p votes for the template starting at d - p: posting
lists intersected by relative position. A start on which enough different words agree is verified: the template's key
phrases must stand, word by word, near their places, and the share of template words found in place gives the coverage.

Beside the templates, plain *phrases* are found wherever their words stand consecutively.

Defined results: null and empty texts have no words, no labels and score 0. Labels are distinct and sorted. Places of a
phrase may overlap; all count. The score is the highest coverage of a labelled template, or 1 where a phrase stands.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import text_bytes

#: The least number of different licence words that must agree on a start.
AGREE = 2
#: Coverage from which a template gives its label; how far a key phrase may stand from its place.
COVERAGE, SLACK = 0.6, 3
#: Starts voted on at a time: votes need memory for so many, however long a file is and however often a word stands in it.
MANY = 2000

#: A-Z become a-z; a-z, 0-9 and bytes of characters beyond ASCII stay; the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Function words that are no licence words.
FUNCTION_WORDS = frozenset(b"a an and any are as at be by for from in into is it its of on or that the this to under with you your all work".split())

#: Phrases of the base rule, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices as they are commonly written, with labels and key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("bsd-3-clause", "released under the bsd 3 clause license", ("bsd 3 clause",)),
    ("bsd-2-clause", "released under the bsd 2 clause license", ("bsd 2 clause",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("wtfpl", "do what the fuck you want to public license", ("want to public license",)),
    ("proprietary", "this software is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", ("proprietary and confidential",)),
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


@dataclass
class Index:
    """Templates and their postings, with the weight (IDF) of each licence word."""

    templates: list[tuple[str, list[bytes], list[tuple[int, list[bytes]]]]]
    postings: dict[bytes, list[tuple[int, int]]]
    phrases: list[tuple[bytes, str]]
    weight: dict[bytes, float] = field(default_factory=dict)

    @classmethod
    def of(cls, templates=TEMPLATES, phrases=PHRASES) -> Index:
        made, postings = [], defaultdict(list)
        for t, (label, text, keys) in enumerate(templates):
            words = words_of(text.encode())
            places = []
            for key in keys:
                k = words_of(key.encode())
                at = next(i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k)
                places.append((at, k))
            made.append((label, words, places))
            for p, w in enumerate(words):
                if w not in FUNCTION_WORDS:
                    postings[w].append((t, p))
        return cls(made, dict(postings), [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases])

    def phrase_places(self, joined: bytes) -> dict[str, list[int]]:
        """Word positions of every place of each phrase. joined: the words with a blank before, between and after."""
        found: dict[str, list[int]] = {}
        for phrase, label in self.phrases:
            at, before, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", before, at)
                found.setdefault(label, []).append(word)
                before = at
                at = joined.find(phrase, at + 1)
        return found

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label -> coverage of the templates that stand in a file."""
        present = self.postings.keys() & set(words)
        if len(present) < AGREE:
            return {}
        have, anchors = set(words), {}
        for t in range(len(self.templates)):
            if len(found := self.anchors(t, have)) >= AGREE:
                anchors[t] = found
        wanted, where = set().union(*anchors.values()), defaultdict(list)
        for d, w in enumerate(words):
            if w in wanted:
                where[w].append(d)
        return self._verified(words, anchors, where)

    def anchors(self, t: int, have: set[bytes]) -> set[bytes]:
        """The rarest licence words of a template, as many as any start of enough coverage must hold AGREE of: more of
        their places than may be missed remain without the AGREE - 1 words of most places. None where the words of a
        file can't reach the coverage; all that the file has where they don't suffice for this."""
        template = self.templates[t][1]
        size = len(template)
        missed = max(n for n in range(size + 1) if (size - n) / size >= COVERAGE) - sum(w not in have for w in template)
        if missed < 0:
            return set()
        places = Counter(w for w in template if w in self.postings and w in have)
        chosen: list[bytes] = []
        for w in sorted(places, key=lambda w: (-self.weight.get(w, 0.0), w)):
            chosen.append(w)
            if sum(sorted(places[c] for c in chosen)[: len(chosen) - AGREE + 1]) > missed and len(chosen) >= AGREE:
                break
        return set(chosen)

    def _verified(self, words: list[bytes], anchors: dict[int, set[bytes]], where: dict[bytes, list[int]]) -> dict[str, float]:
        found: dict[str, float] = {}
        for t, chosen in anchors.items():
            label, template, keys = self.templates[t]
            posted = [(w, p) for w in chosen for at, p in self.postings[w] if at == t]
            for block in range(1 - len(template), len(words), MANY):
                votes: dict[int, set[bytes]] = defaultdict(set)
                for w, p in posted:
                    places = where[w]
                    for d in places[bisect_left(places, block + p) : bisect_left(places, block + MANY + p)]:
                        votes[d - p].add(w)
                for start, agreed in votes.items():
                    if len(agreed) < AGREE or not all(self._stands(words, start + at, key) for at, key in keys):
                        continue
                    lo = max(0, start)
                    hits = sum(a == b for a, b in zip(template[lo - start :], words[lo : start + len(template)], strict=False))
                    coverage = hits / len(template)
                    if coverage >= COVERAGE:
                        found[label] = max(found.get(label, 0.0), coverage)
        return found

    @staticmethod
    def _stands(words: list[bytes], at: int, key: list[bytes]) -> bool:
        return any(words[i : i + len(key)] == key for i in range(max(0, at - SLACK), at + SLACK + 1))


def document_frequencies(docs: DataFrame, index: Index, text_column: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and how many there are; counted over all rows, one row a task and
    word. The result is as long as the templates' vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, vocabulary = Counter(), 0, index.postings.keys()
        for batch in batches:
            n += batch.num_rows
            for text in batch.column("text"):
                counts.update(vocabulary & set(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *counts], pa.binary()), "n": pa.array([n, *counts.values()], pa.int64())})

    rows = docs.select(text_bytes(text_column)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def weighted(docs: DataFrame, index: Index | None = None, text_column: str = "text") -> Index:
    """The index with IDF weights from docs."""
    index = index or Index.of()
    found, n = document_frequencies(docs, index, text_column)
    index.weight = {w: float(np.log((n + 1) / (found.get(w, 0) + 1))) for w in index.postings}
    return index


def scan(docs: DataFrame, index: Index | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, places (label and word position of each place of a phrase), matches
    (label and coverage of each template that stands in the text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(index or weighted(docs, None, text_column))
    places_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    matches_type = pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            counts, places, matches = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                counts.append(len(words))
                found = index.phrase_places(b" %b " % b" ".join(words))
                places.append([{"label": label, "word": w} for label, at in found.items() for w in at])
                matches.append([{"label": label, "coverage": c} for label, c in sorted(index.matches(words).items())])
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "n_words": pa.array(counts, pa.int64()), "places": pa.array(places, places_type), "matches": pa.array(matches, matches_type)}
            )

    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"id {id_type}, n_words long, places array<struct<label: string, word: long>>, matches array<struct<label: string, coverage: double>>"
    return docs.select(F.col(id_column).alias("id"), text_bytes(text_column)).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def as_query(result: DataFrame) -> DataFrame:
    base, more = F.col("places.label"), F.col("matches.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return result.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0))).alias("score"),
    )
