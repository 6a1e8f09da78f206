"""Licence scan: files streamed through a suffix automaton of licence templates and phrases.

Matching statistics give every stretch that some template holds and that can't go on. Stretches of ``LEAST`` words or more
are chained in template order, small gaps allowed, into covered spans; a template covered by ``COVERAGE`` of its words names
the file's licence. Phrases are windows of the same automaton and are counted wherever they stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.automaton import TextIndex, plain_words
from textwarden.llm.wordstream import PLAIN_WORDS, words_in

LEAST, GAP, COVERAGE = 6, 12, 0.5

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Passages of public licence texts and their labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty.",
}


def chained(matches: list[tuple[int, int, int]], gap: int = GAP) -> tuple[int, int, int]:
    """Best chain of (first, end, template end) in file order: (template words covered, first word, end word).

    The next match must go on in the template behind the last one, at most ``gap`` words further in either text.
    """
    best = (0, 0, 0)
    chains: list[tuple[int, int, int, int]] = []  # covered, first, end, template end
    for first, end, t_end in sorted(matches):
        covered, begin = end - first, first
        for c in reversed(chains):
            if first - c[2] > gap:
                break
            skip = max(0, c[2] - first, c[3] - (t_end - (end - first)))
            if c[3] < t_end and t_end - (end - first) - c[3] <= gap and c[0] + end - first - skip > covered:
                covered, begin = c[0] + end - first - skip, c[1]
        chains.append((covered, begin, end, t_end))
        chains.sort(key=lambda c: c[2])
        best = max(best, (covered, begin, end))
    return best


def _scan(phrases, templates, labels: dict[str, str], least: int, coverage: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: TextIndex = phrases.value
        legal, lengths = templates.value
        for batch in batches:
            out = defaultdict(list)
            for row, end, words in words_in(batch.column("_text"), PLAIN_WORDS, True):
                base, chains = defaultdict(list), defaultdict(lambda: defaultdict(list))
                for first, _, keys in said.hits(words):
                    base[int(np.searchsorted(words.bounds, first, side="right")) - 1].append((first, keys))
                for first, stop, places in legal.long_matches(words, least):
                    d = int(np.searchsorted(words.bounds, first, side="right")) - 1
                    for key, t_end in places:
                        chains[d][key].append((first, stop, t_end))
                for d in range(end - row):
                    lo = int(words.bounds[d])
                    places = sorted({first - lo for first, _ in base[d]}) if d in base else []
                    own = {labels[k] for _, keys in base.get(d, ()) for k in keys}
                    n_base = sum(len(keys) for _, keys in base.get(d, ()))
                    spans, top = [], 0.0
                    for key, matches in chains.get(d, {}).items():
                        covered, first, stop = chained(matches)
                        share = min(1.0, covered / lengths[key])
                        top = max(top, share)
                        if share >= coverage:
                            spans.append({"label": key, "first": first - lo, "end": stop - lo, "coverage": share})
                    out["n_words"].append(int(words.counts[d]))
                    out["n_base"].append(n_base)
                    out["first_word"].append(places[0] if places else None)
                    out["last_word"].append(places[-1] if places else None)
                    out["base_labels"].append(",".join(sorted(own)))
                    out["labels"].append(",".join(sorted(own | {s["label"] for s in spans})))
                    out["score"].append(max(top, 0.5 if n_base else 0.0))
                    out["spans"].append(sorted(spans, key=lambda s: (s["first"], s["label"])))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(out[n], k) for n, k in zip(names, kinds, strict=True))], ["_id", *names])

    return work


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Per document: id, n_words, n_base (places of phrases), first_word, last_word (of their starts, else null), base_labels,
    labels (with the templates'; both distinct, sorted, comma-joined), score (largest covered share of a template, at
    least 0.5 where a phrase stands) and spans (label, first, end, coverage).

    A null or empty text has no words and empty labels. Every input row gives a row, whatever its id. Phrases and templates are
    parameters of a few pages of text: they are broadcast as automata. Other columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    said = TextIndex([(p, plain_words(p)) for p in sorted(phrases)], max((len(plain_words(p)) for p in phrases), default=1))
    hashed = [(k, plain_words(t)) for k, t in sorted(templates.items())]
    legal = TextIndex(hashed, least)
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: int, end: int, coverage: double>>"
    work = _scan(spark.sparkContext.broadcast(said), spark.sparkContext.broadcast((legal, {k: len(h) for k, h in hashed})), dict(phrases), least, coverage)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(work, schema).withColumnRenamed("_id", id_col)
