"""Licence notices by a positional index of rare template words.

Templates are short public notices. A positional index maps each template word to
its (template, position) postings. For a file, the words of the index that occur in
it are ranked by their document frequency over the whole corpus; of each template
the rarest ones are looked up, so many that a stretch of the accepted score always
holds AGREE of them, whatever else the file holds. Every (occurrence, posting) pair
votes for a template at a relative position. A template stands where enough of its
words agree on one position and each of its mandatory key phrases occurs in the
aligned stretch; its score is the share of its words that stand in place.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Base
labels come from four phrases and always stay. Defined cases: null counts as empty;
without words there are no labels and the score is 0; repeated rows each get a row.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, notice, mandatory key phrases.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ["apache license version 2 0", "except in compliance"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["cc by nd"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc0", "released under CC0 1.0 Universal public domain dedication", ["cc0 1 0"]),
    ("all-rights-reserved", "All rights reserved", ["all rights reserved"]),
]
#: At least so many looked-up words must agree on a position; the least score of a notice.
AGREE, ACCEPT = 2, 0.6


def _words(text: str) -> list[bytes]:
    return text.encode().translate(tx.FOLD_WORDS).split()


NOTICES = [(label, _words(text), [b" %b " % b" ".join(_words(k)) for k in keys]) for label, text, keys in TEMPLATES]
PHRASES = [(b" %b " % b" ".join(_words(p)), label) for p, label in BASE.items()]
INDEX: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
for _t, (_, _notice, _) in enumerate(NOTICES):
    for _q, _w in enumerate(_notice):
        INDEX[_w].append((_t, _q))


def index_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """Documents that hold each index word, over all documents; bounded by the index."""

    def run(batches):
        total: Counter = Counter()
        for batch in tx.slices(batches, "text"):
            for text in tx.byte_texts(batch.column(0)):
                if text:
                    total.update(INDEX.keys() & set(text.translate(tx.FOLD_WORDS).split()))
        yield pa.record_batch([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return {r.word.encode(): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _places(line: bytes, phrase: bytes) -> list[int]:
    found, at = [], line.find(phrase)
    while at >= 0:
        found.append(at)
        at = line.find(phrase, at + len(phrase) - 1)
    return found


def looked_up(rank: dict[bytes, int]) -> list[list[tuple[bytes, int]]]:
    """Of each template the rarest (word, position) pairs.

    A stretch may miss len - least of a template's words, so AGREE of any
    len - least + AGREE of them stand in place.
    """
    out = []
    for _, notice, _ in NOTICES:
        least = next(n for n in range(len(notice) + 1) if n / len(notice) >= ACCEPT)
        places = sorted(range(len(notice)), key=lambda q: (rank.get(notice[q], 0), notice[q], q))
        out.append([(notice[q], q) for q in places[: len(notice) - least + AGREE]])
    return out


def notices(words: list[bytes], line: bytes, rarest: list[list[tuple[bytes, int]]]) -> list[tuple[str, int, float]]:
    """(label, word position, score) of each template that stands in the text."""
    # a template whose key phrases aren't all in the text can't stand in it
    possible = [t for t, (_, _, keys) in enumerate(NOTICES) if all(key in line for key in keys)]
    if not possible:
        return []
    at: dict[bytes, list[int]] = {w: [] for t in possible for w, _ in rarest[t]}
    for p, w in enumerate(words):
        if w in at:
            at[w].append(p)
    votes: Counter = Counter()
    for t in possible:
        for word, q in rarest[t]:
            votes.update((t, p - q) for p in at[word])
    best: dict[str, tuple[float, int]] = {}
    for (t, begin), n in votes.items():
        label, notice, keys = NOTICES[t]
        if n < min(AGREE, len(notice)):
            continue
        low = max(0, begin)
        stretch = words[low : begin + len(notice)]
        placed = sum(w == notice[low - begin + i] for i, w in enumerate(stretch))
        score = placed / len(notice)
        if score >= ACCEPT and all(k in b" %b " % b" ".join(stretch) for k in keys):
            best[label] = max(best.get(label, (0.0, 0)), (score, -low))
    return [(label, -low, score) for label, (score, low) in sorted(best.items())]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places by label and the notices found, a row per document."""
    frequencies = index_frequencies(docs)
    rarest = looked_up(frequencies)

    def task():
        kinds = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64())]))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, base, found = [], [], []
            for text in tx.byte_texts(batch.column(1)):
                words = (text or b"").translate(tx.FOLD_WORDS).split()
                line = b" %b " % b" ".join(words)
                counts.append(len(words))
                places = [(label, p) for phrase, label in PHRASES for p in _places(line, phrase)]
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20) if places else ()
                at = np.searchsorted(spaces, [p for _, p in places]).tolist() if places else []
                base.append([{"label": label, "word": n, "score": 1.0} for (label, _), n in zip(places, at)])
                found.append([{"label": a, "word": b, "score": c} for a, b, c in notices(words, line, rarest)])
            return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(base, kinds), pa.array(found, kinds)], names=["doc_id", "n_words", "base", "notices"])

        return step

    spans = "array<struct<label:string,word:long,score:double>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tx.map_slices(rows, "text", task, f"doc_id long, n_words long, base {spans}, notices {spans}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base places and labels, the method's labels, and a score."""
    found = scan(tx.documents(spark, sf_dir))
    label = lambda spans: F.transform(spans, lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base_score = F.when(F.size("base") > 0, 0.5).otherwise(0.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["word"])).alias("last_word"),
        joined(label("base")).alias("base_labels"),
        joined(F.concat(label("base"), label("notices"))).alias("labels"),
        F.greatest(base_score, F.coalesce(F.array_max(F.transform("notices", lambda s: s["score"])), F.lit(0.0))).alias("score"),
    )
