"""Licence scans with a positional index of rare tokens.

Templates are word sequences with mandatory key phrases. Document frequencies of all
template words are counted over the whole corpus; each template is then indexed under the
words of highest IDF of its key phrases (``RARE`` of them), with their positions. A match
must have those words in place, so the starts that a file's postings of all of them give
are intersected, and no other place can hold the template. At every start that is left the
template's words are compared in place and its key phrases must all stand there. Phrases
that must be found everywhere are templates of their own whose words are all mandatory. No
file's words are left out, so a file's labels depend neither on what else it holds nor on
the rest of the corpus. Long licences are several templates, a paragraph each, for one word
more or less would put all that follows out of place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factflow.llm import vectext as V
from factflow.llm.shared import renamed

LEAST_SHARE, RARE, BLOCK = 0.7, 3, 1 << 16
#: Everything but 0-9, letters and non-ASCII separates words.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = True
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = False
# Phrases found at every place, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, words, mandatory key phrases of licence notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("you may not use this file", "apache org licenses license 2 0")),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    ("lgpl-2.1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license", "either version 2 1 of the license")),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license", "either version 3 of the license")),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("to deal in the software without restriction", "sublicense and or sell copies")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included", "substantial portions of the software")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain", "this list of conditions")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce", "this list of conditions")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name of", "may be used to endorse or promote products")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "this permission notice appear in all copies")),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("permission is granted to anyone", "alter it and redistribute it freely")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software", "public domain")),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization", "accompanying documentation covered by this license")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("source code form is subject", "copy of the mpl was not distributed")),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "related or neighboring rights")),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # first word and end of each mandatory phrase


def templates(specs=TEMPLATES) -> list[Template]:
    out = []
    for label, text, phrases in specs:
        words = tuple(text.split())
        keys = []
        for phrase in phrases:
            p = tuple(phrase.split())
            at = next(k for k in range(len(words)) if words[k : k + len(p)] == p)
            keys.append((at, at + len(p)))
        out.append(Template(label, words, tuple(keys)))
    return out


def hash_of(words: list[str]) -> np.ndarray:
    raw, offsets = V.buffer_of(pa.array(words, pa.string()))
    return V.words_of(raw, offsets, space=BETWEEN, fold=True)[3]


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many of all texts each word stands; under "" the number of texts. The result is as long as ``words``."""
    order = np.argsort(known := hash_of(words))
    known = known[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(words), np.int64), 0
        for whole in batches:
            for b in V.slices(whole, "text"):
                raw, offsets = V.buffer_of(b.column("text"))
                _, _, text, h = V.words_of(raw, offsets, space=BETWEEN, fold=True)
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[k] == h
                total += np.bincount(np.unique(text[hit] * len(words) + k[hit]) % len(words), minlength=len(words))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*[words[k] for k in order], ""]), pa.array([*total.tolist(), n])], names=["word", "df"])

    rows = renamed(docs, text=text_col).mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()
    return {w: 0 for w in [*words, ""]} | {r.word: r.df for r in rows}


class Index:
    """Each template under the rarest words of its key phrases and their positions."""

    def __init__(self, found: list[Template], df: dict[str, int]) -> None:
        self.templates, self.df, n = found, df, max(1, df.get("", 1))
        self.hashes = [hash_of(list(t.words)) for t in found]
        self.anchors = []
        for t in found:
            idf = {w: float(np.log((n + 1) / (df.get(w, 0) + 1))) for w in t.words}
            self.anchors.append(sorted({p for a, b in t.keys for p in range(a, b)}, key=lambda p: (-idf[t.words[p]], t.words[p], p))[:RARE])

    def matches(self, words: np.ndarray, text: np.ndarray) -> Iterator[tuple[Template, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, text numbers, starts, shares of the template's words in place) over the words of many texts."""
        order = np.argsort(words, kind="stable")
        ranked = words[order]

        def postings(h: np.uint64) -> np.ndarray:
            return order[np.searchsorted(ranked, h, "left") : np.searchsorted(ranked, h, "right")]

        for t, h, anchors in zip(self.templates, self.hashes, self.anchors, strict=True):
            start, anchor = postings(h[anchors[0]]) - anchors[0], anchors[0]
            for p in anchors[1:]:
                start = np.intersect1d(start, postings(h[p]) - p, assume_unique=True) if len(start) else start
            for lo in range(0, len(start), BLOCK):
                at = start[lo : lo + BLOCK] + anchor
                place = at[:, None] - anchor + np.arange(len(h))[None]
                inside = np.clip(place, 0, len(words) - 1)
                same = (place == inside) & (words[inside] == h[None]) & (text[inside] == text[at][:, None])
                share = same.mean(axis=1)
                ok = share >= LEAST_SHARE
                for a, b in t.keys:
                    ok &= same[:, a:b].all(axis=1)
                yield t, text[at[ok]], at[ok] - anchor, share[ok]


def scan(docs: DataFrame, index: Index, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row.

    n_base counts all places of the base phrases, first_word and last_word are their
    smallest and largest (null without one). Labels are distinct, sorted and joined by
    commas. score is the largest share of a template found in place, 1 for a base phrase.
    Null and empty texts have no words. Ids may be null or repeat, other columns are
    ignored, an empty table gives no rows.
    """
    phrases = Index(templates([(label, p, (p,)) for p, label in base.items()]), index.df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in V.slices(whole, "text"):
                n = b.num_rows
                raw, offsets = V.buffer_of(b.column("text"))
                _, _, text, h = V.words_of(raw, offsets, space=BETWEEN, fold=True)
                cut = V.runs(n, text)
                found: dict[int, list[tuple[int, str]]] = defaultdict(list)
                for t, where, start, _ in phrases.matches(h, text):
                    for d, place in zip(where.tolist(), start.tolist(), strict=True):
                        found[d].append((place - int(cut[d]), t.label))
                more: dict[int, list[tuple[str, float]]] = defaultdict(list)
                for t, where, _, share in index.matches(h, text):
                    for d, x in zip(where.tolist(), share.tolist(), strict=True):
                        more[d].append((t.label, x))
                rows = []
                for d in range(n):
                    places = [p for p, _ in found.get(d, ())]
                    labels = {x for _, x in found.get(d, ())}
                    rest = more.get(d, ())
                    score = 1.0 if places else max((s for _, s in rest), default=0.0)
                    rows.append((int(cut[d + 1] - cut[d]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _ in rest})), score))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    own = renamed(docs, id=id_col, text=text_col)
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)


def scan_corpus(docs: DataFrame, found: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` with an index weighted by this corpus's own document frequencies; of an empty table all are 0 and no rows come out."""
    found = templates() if found is None else found
    words = sorted({w for t in found for w in t.words} | {w for p in BASE for w in p.split()})
    return scan(docs, Index(found, document_frequencies(docs, words, text_col)), id_col=id_col, text_col=text_col)
