"""Operator 7: licences recognised by the sentences of their notices.

A text is cut into units at line ends and behind . ; : ! ?, and a run of units, as long as the longest known sentence at most, is a sentence if its
normal form (lower case, letters and digits, one space) is in the table of known sentences; the longest run wins. That
gives a sequence of sentence identifiers. A licence's rule is an ordered sequence of identifiers: it is met where they
follow each other in that order, with no more than `gap` units between two. Rules that lie inside the span of a longer
rule that is met are not reported.

Null and empty texts have no sentences. A null doc_id is kept; rows that repeat a doc_id each give a row. Texts without
a known sentence give no row. Of sentences that begin together the longest counts, and rules of equal span are each
returned. A text of any length takes time in proportion to its units. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Known sentences by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-use": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0-dedicated": "Dedicated to the public domain under CC0 1.0.",
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-merchantability": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "library-free": "This library is free software;",
    "lgpl21-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "library-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
#: Identifiers of licences that lines of the form "SPDX-License-Identifier: name" may give.
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "BSL-1.0", "EPL-2.0", "MPL-2.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
#: Licences by ordered rules of identifiers; a licence may have several.
RULES = (
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("Apache-2.0", ("apache2-header", "apache2-use", "apache2-copy")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl-free", "gpl3-redistribute", "gpl-hope")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("Proprietary", ("rights-reserved",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache2-header", "apache2-use", "apache2-copy", "apache2-unless")),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty")),
    ("GPL-2.0", ("gpl-free", "gpl2-redistribute", "gpl-hope", "gpl-merchantability")),
    ("GPL-3.0", ("gpl-free", "gpl3-redistribute", "gpl-hope", "gpl-merchantability")),
    ("LGPL-2.1", ("library-free", "lgpl21-redistribute", "library-hope", "gpl-merchantability")),
    ("LGPL-3.0", ("gpl-free", "lgpl3-redistribute", "gpl-hope", "gpl-merchantability")),
    ("AGPL-3.0", ("gpl-free", "agpl3-redistribute", "gpl-hope", "gpl-merchantability")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("BSL-1.0", ("boost-grant", "mit-warranty")),
    ("BSL-1.0", ("boost-distributed",)),
    ("EPL-2.0", ("epl2-available",)),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    *((x, (f"spdx-{x.lower()}",)) for x in SPDX),
)

_CUT = re.compile(r"(?<=[.;:!?])\s+|\n+")
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Recogniser:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, gap: int = 4):
        self.known = {normal(v): k for k, v in sentences.items()}
        # A text with a known sentence has one of these words; each sentence has the longest of its own.
        self.words = sorted({max(n.split(), key=lambda w: (len(w), w)) for n in self.known})
        self.begins = {w[:2] for n in self.known for w in [tuple(n.split())]}
        self.longest = max(map(len, self.known))
        self.rules, self.gap = rules, gap

    def sequence(self, text: str) -> list[tuple[int, int, str]]:
        """First unit, last unit and identifier of the known sentences of a text, in order."""
        low = text.lower()
        if not any(w in low for w in self.words):
            return []
        units = [u for u in map(normal, _CUT.split(text)) if u]
        out, i = [], 0
        while i < len(units):
            best = None
            if tuple(units[i].split(" ", 2)[:2]) in self.begins or " " not in units[i]:
                run = ""
                for j in range(i, len(units)):
                    run = f"{run} {units[j]}" if run else units[j]
                    if len(run) > self.longest:
                        break
                    if run in self.known:
                        best = j
                        name = self.known[run]
            if best is None:
                i += 1
            else:
                out.append((i, best, name))
                i = best + 1
        return out

    def licences(self, sequence: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
        """Licence, first unit and last unit of the rules that the sequence meets."""
        at: dict[str, list[int]] = {}
        for k, (_, _, name) in enumerate(sequence):
            at.setdefault(name, []).append(k)
        met = set()
        for name, rule in self.rules:
            for k in at.get(rule[0], ()):
                first, end = sequence[k][0], sequence[k][1]
                for step in rule[1:]:
                    places = at.get(step, [])
                    next_ = bisect.bisect_right(places, k)
                    if next_ == len(places) or sequence[places[next_]][0] - end > self.gap + 1:
                        break
                    k = places[next_]
                    end = sequence[k][1]
                else:
                    met.add((name, first, end))
        # From left to right, the longer first: a rule lies inside one that began before and reaches as far, or that began with it and reaches further.
        kept, far, same = [], -1, (-1, -1)
        for m in sorted(met, key=lambda m: (m[1], -m[2], m[0])):
            if m[1] != same[0]:
                far, same = max(far, same[1]), (m[1], m[2])
            if far < m[2] and same[1] <= m[2]:
                kept.append(m)
        return sorted(kept, key=lambda m: (m[1], m[2], m[0]))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("licences", pa.string()), ("spans", pa.string()), ("sentences", pa.string())])


def licence_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, licences (sorted, distinct), spans (licence:first:last unit) and sentences (identifiers), comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Recogniser(sentences, rules)
        for batch in (b.slice(i, j - i) for b in batches for i, j in common.chunks(b.column(1))):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and (found := seen.sequence(text)):
                    met = seen.licences(found)
                    rows.append((doc_id, ",".join(sorted({m[0] for m in met})), ",".join(f"{a}:{b}:{c}" for a, b, c in met), ",".join(x[2] for x in found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return common.texts(docs).mapInArrow(run, "doc_id long, licences string, spans string, sentences string")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(common.table(spark, sf_dir, "documents"))
