"""Licence notices by a positional index of rare words.

Words are runs of 0-9, A-Z, a-z and characters above ASCII, A-Z lower-cased
(compared by 64-bit hashes). A template is the text of a licence notice with
mandatory key phrases. The index has, for every key phrase, its rarest words by
idf over all documents and where in the phrase they stand. A document looks its
licence words up from the rarest on: every occurrence of a phrase's rarest word
gives a relative position (place in the document less place in the phrase), and
the postings of the other words of the phrase, from rare to frequent, are
intersected by it until none or only whole occurrences are left. So every
occurrence of every phrase is found, and frequent words are only looked at
beside rare ones.

A template occurs where all of its key phrases do: one for each occurrence of the
first phrase, the others at their nearest occurrence, at most `SLACK` words
off the relative position of the first. Its share is the idf of the words that stand at
the relative position of their phrase (of the nearest one in the template, the
earlier of two) over the idf of all its words; from `LEAST` on its label counts.
Base phrases are templates of one phrase; all of their places count. The score of
a document is its largest share.

Documents are read twice, for the document frequencies of the words of the
templates and for the places; nothing is shuffled but those counts. What travels
to the tasks is bounded by the templates.

A null text is empty: no words, no places, empty labels, score 0. Repeated rows
give repeated results; a long text is taken whole. Without documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysem.llm import chars
from polysem.llm.chars import small
from polysem.llm.privacy import found_in

SLACK = 12
LEAST = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...] = field(default=())  # the text itself if none
    base: bool = False


# The base phrases, and the wording of well-known public licence notices.
BASE = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)
NOTICES = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template("mit-notice", "released under the mit license", ("under the mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template(
        "apache-2.0-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ("apache license version 2", "in compliance with the license"),
    ),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2",),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0-1.0", "cc0 1 0 universal", ("cc0 1",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4",)),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4",)),
)
TEMPLATES = BASE + NOTICES


def vocabulary(templates: tuple[Template, ...]) -> np.ndarray:
    """The sorted hashes of all words of the templates."""
    return np.unique(np.concatenate([chars.plain_word_hashes(t.text) for t in templates]))


def document_frequency(texts: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of the texts each of the words is, and the number of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for batch in small(batches):
            for _, some in chars.text_slices([t or "" for t in batch.column(0).to_pylist()]):
                owner, _, _, value = chars.plain_words(*chars.code_points(some))
                hit = found_in(value, words)
                met = np.zeros((len(some), len(words)), bool)
                met[owner[hit], np.searchsorted(words, value[hit])] = True
                total[:-1] += met.sum(axis=0)
                total[-1] += len(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "df"])

    found = texts.mapInArrow(work, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(words) + 1, np.int64)
    out[found["word"].to_numpy()] = found["df"].to_numpy()
    return out[:-1], int(out[-1])


@dataclass
class Phrase:
    words: np.ndarray  # hashes
    order: np.ndarray  # places, rarest word first
    at: int  # where it begins in the template


class Index:
    """The templates by their phrases' rarest words."""

    def __init__(self, templates: tuple[Template, ...], words: np.ndarray, df: np.ndarray, n: int) -> None:
        idf = np.log(1 + max(n, 1) / (1 + df))
        self.templates = templates
        self.phrases: list[list[Phrase]] = []
        self.weights, self.values, self.nearest = [], [], []
        for t in templates:
            whole = chars.plain_word_hashes(t.text)
            weight = idf[np.searchsorted(words, whole)]
            found = []
            for text in t.phrases or (t.text,):
                some = chars.plain_word_hashes(text)
                at = next(i for i in range(len(whole)) if np.array_equal(whole[i : i + len(some)], some))
                found.append(Phrase(some, np.argsort(-weight[at : at + len(some)], kind="stable"), at))
            place = np.arange(len(whole))
            gap = np.stack([np.maximum(0, np.maximum(p.at - place, place - p.at - len(p.words) + 1)) for p in found])
            self.phrases.append(found)
            self.weights.append(weight / weight.sum())
            self.values.append(whole)
            self.nearest.append(gap.argmin(axis=0))
        self.rare = np.unique([p.words[p.order[0]] for some in self.phrases for p in some])

    def occurrences(self, phrase: Phrase, rare: dict[int, np.ndarray], value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Where in `value` the phrase begins: relative positions left of the intersection."""
        first, *rest = phrase.order.tolist()
        begin = rare.get(int(phrase.words[first]), np.zeros(0, np.int64)) - first
        last = len(phrase.words) - 1
        begin = begin[(begin >= 0) & (begin + last < len(value))]
        for place in rest:
            if not len(begin):
                break
            begin = begin[value[begin + place] == phrase.words[place]]
        return begin[owner[begin] == owner[begin + last]]

    def find(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
        """Words of each text, and (text, template, first word, share) of every occurrence."""
        owner, _, _, value = chars.plain_words(*chars.code_points(texts))
        sizes = np.bincount(owner, minlength=len(texts))
        starts = np.cumsum(sizes) - sizes
        hit = found_in(value, self.rare)
        order = np.argsort(value[hit], kind="stable")
        kept, first = np.unique(value[hit][order], return_index=True)
        rare = dict(zip(kept.tolist(), np.split(hit[order], first[1:]), strict=True)) if len(kept) else {}
        out: list[tuple[int, int, int, float]] = []
        for t, phrases in enumerate(self.phrases):
            begins = [self.occurrences(p, rare, value, owner) for p in phrases]
            if not all(map(len, begins)):
                continue
            offset = self.aligned([b - p.at for b, p in zip(begins, phrases, strict=True)], owner, phrases, begins[0])
            if not len(offset):
                continue
            share = self.share(t, offset, value, owner, phrases[0].at)
            for o, s in zip(offset[:, 0].tolist(), share.tolist(), strict=True):
                text = int(owner[o + phrases[0].at])
                out.append((text, t, o + phrases[0].at - int(starts[text]), s))
        return sizes, out

    def aligned(self, offsets: list[np.ndarray], owner: np.ndarray, phrases: list[Phrase], first: np.ndarray) -> np.ndarray:
        """Occurrence x phrase: relative positions, for the occurrences of the first phrase with all
        others within the slack and in the same text."""
        rows = [offsets[0]]
        good = np.ones(len(first), bool)
        for phrase, some in zip(phrases[1:], offsets[1:], strict=True):
            at = np.searchsorted(some, offsets[0])
            low, high = some[np.maximum(at - 1, 0)], some[np.minimum(at, len(some) - 1)]
            near = np.where(np.abs(low - offsets[0]) <= np.abs(high - offsets[0]), low, high)
            good &= (np.abs(near - offsets[0]) <= SLACK) & (owner[near + phrase.at] == owner[first])
            rows.append(near)
        return np.stack(rows, axis=1)[good]

    def share(self, t: int, offset: np.ndarray, value: np.ndarray, owner: np.ndarray, at: int) -> np.ndarray:
        place = offset[:, self.nearest[t]] + np.arange(len(self.values[t]))
        inside = (place >= 0) & (place < len(value))
        place = np.where(inside, place, 0)
        same = inside & (value[place] == self.values[t]) & (owner[place] == owner[offset[:, 0] + at][:, None])
        return np.minimum(1.0, np.where(same, self.weights[t], 0.0).sum(axis=1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word (of base
    places), base_labels, labels, score, places (label:first word:share of every
    place that counts)."""
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    words = vocabulary(templates)
    df, n = document_frequency(rows.select("text"), words)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, words, df, n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in small(batches):
            out: list[tuple] = []
            for _, some in chars.text_slices([t or "" for t in batch.column(1).to_pylist()]):
                sizes, found = index.find(some)
                own: dict[int, list] = {}
                for text, t, at, share in found:
                    own.setdefault(text, []).append((index.templates[t], at, share))
                out += [summary(int(n), own.get(i, [])) for i, n in enumerate(sizes)]
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=NAMES)

    return rows.mapInArrow(
        work,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, places string",
    )


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]


def summary(n_words: int, found: list[tuple[Template, int, float]]) -> tuple:
    some = sorted((at, t.label, share, t.base) for t, at, share in found if t.base or share >= LEAST)
    base = [at for at, _, _, is_base in some if is_base]
    return (
        n_words, len(base), min(base, default=None), max(base, default=None),
        ",".join(sorted({label for _, label, _, is_base in some if is_base})), ",".join(sorted({label for _, label, _, _ in some})),
        max((share for _, _, share, _ in some), default=0.0), ",".join(f"{label}:{at}:{share:.3f}" for at, label, share, _ in some),
    )
