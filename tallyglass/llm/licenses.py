"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences twice: at sentence ends and line breaks, and at sentence ends and blank lines alone (for
sentences wrapped over lines). Each sentence is normalised (lower case, runs of other characters than letters, digits
and dots between digits become a space) and mapped to the identifier of the known licence sentence that it equals.
Rules are sequences of identifiers; a licence is recognised where the identifiers of a text hold its rule in order,
others in between allowed. No rows are exploded or shuffled: the known sentences are a constant of bounded size.

Results for odd input: null and empty texts have no sentences and no licence; a sentence that repeats is listed each
time; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Licences by SPDX identifier, with a short key and the names by which notices call them.
NAMES = {
    "MIT": ("mit", ["the MIT License", "the MIT license (MIT)"]),
    "Apache-2.0": ("apache", ["the Apache License, Version 2.0", "the Apache License 2.0"]),
    "GPL-2.0": ("gpl2", ["the GNU General Public License, version 2", "the GNU General Public License version 2", "the GNU General Public License v2.0", "the GNU GPL v2"]),
    "GPL-3.0": ("gpl3", ["the GNU General Public License, version 3", "the GNU General Public License version 3", "the GNU General Public License v3.0", "the GNU GPL v3"]),
    "LGPL-2.1": ("lgpl21", ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"]),
    "LGPL-3.0": ("lgpl3", ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"]),
    "AGPL-3.0": ("agpl3", ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0"]),
    "MPL-2.0": ("mpl2", ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"]),
    "EPL-2.0": ("epl2", ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"]),
    "BSL-1.0": ("bsl1", ["the Boost Software License, version 1.0", "the Boost Software License 1.0"]),
    "BSD-2-Clause": ("bsd2", ["the BSD 2-Clause License", "the Simplified BSD License"]),
    "BSD-3-Clause": ("bsd3", ["the BSD 3-Clause License", "the New BSD License"]),
    "ISC": ("isc", ["the ISC License"]),
    "Zlib": ("zlib", ["the zlib License"]),
    "Unlicense": ("unlicense", ["the Unlicense"]),
    "CC0-1.0": ("cc0", ["CC0 1.0", "the Creative Commons Zero v1.0 Universal license"]),
}
#: Elements of Creative Commons licences, version 4.0.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: How notices begin.
NOTICES = ["Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This program is licensed under", "This software is licensed under"]
#: Sentences of licence texts by identifier, as published.
TEXTS = {
    "mit-title": ["The MIT License (MIT)", "MIT License"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is-mit": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache-notice": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl-free": ["This program is free software:", "This program is free software;", "This library is free software;", "This library is free software:"],
    "gpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl3-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-publisher": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "lgpl-publisher": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "version-2": ["either version 2 of the License, or (at your option) any later version.", "version 2 of the License."],
    "version-2.1": ["either version 2.1 of the License, or (at your option) any later version.", "version 2.1 of the License."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-disclaimer": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    ],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-disclaimer": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "mpl2-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "bsl1-terms": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "cc0-notice": ["This work is dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0."],
    "reserved": ["All rights reserved."],
}
#: Rules for licence texts, as (licence, identifiers in order).
TEXT_RULES = [
    ("MIT", ["mit-grant", "mit-condition", "as-is-mit"]),
    ("Apache-2.0", ["apache-compliance", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0", ["gpl-free", "gpl-publisher", "version-2"]),
    ("LGPL-3.0", ["gpl-free", "lgpl3-terms"]),
    ("LGPL-2.1", ["gpl-free", "lgpl-publisher", "version-2.1"]),
    ("AGPL-3.0", ["gpl-free", "agpl3-terms"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-grant", "isc-disclaimer"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("BSL-1.0", ["bsl1-terms"]),
    ("all-rights-reserved", ["reserved"]),
]
#: The line by which files name their licence; its colon ends no sentence.
SPDX = "spdx-license-identifier:"


def knowledge() -> tuple[dict[str, list[str]], list[tuple[str, list[str]]]]:
    """(sentences by identifier, rules): what licence texts say, notices by the licences' names, and SPDX lines."""
    sentences, rules = {i: list(x) for i, x in TEXTS.items()}, list(TEXT_RULES)
    named = {spdx: (key, [f"{start} {name}." for start in NOTICES for name in names]) for spdx, (key, names) in NAMES.items()}
    for element, name in COMMONS.items():
        named[f"CC-{element}-4.0"] = f"cc-{element.lower()}", [*(f"{start} CC {element} 4.0." for start in NOTICES), f"This work is licensed under a Creative Commons {name} 4.0 International License."]
    for spdx, (key, notices) in named.items():
        sentences[f"{key}-notice"] = [*sentences.get(f"{key}-notice", []), *notices]
        sentences[f"{key}-spdx"] = [f"{SPDX[:-1]} {spdx}{more}" for more in ("", "-only", "-or-later")]
        rules += [(spdx, [f"{key}-notice"]), (spdx, [f"{key}-spdx"])]
    return sentences, rules


SENTENCES, RULES = knowledge()
#: What training may do with a text, the strictest class that it holds; others are permissive.
RESTRICTED = ["CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "all-rights-reserved"]
COPYLEFT = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC-BY-SA-4.0"]

LINE_END = r"[.!?;:]+[\x20\x09-\x0D]+|[\n\r]+"
TEXT_END = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
#: What normalising takes out: all but letters, digits, non-ASCII characters and dots that a digit follows.
NOISE = r"(?:[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]|\.(?![0-9]))+"


def normalise(sentence: str) -> str:
    """The same as normalised() for one string of the driver."""
    return re.sub(NOISE, " ", sentence.translate({c: c + 32 for c in range(65, 91)})).strip(" ")


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, NOISE, " "))


def known_ids(sentences: Column, known: list[tuple[str, str]]) -> Column:
    """Identifiers of the sentences that are known, in their order. known: (normalised sentence, identifier). isin() with many
    constants looks each sentence up in a hash set; only those that are in it are looked for in the list."""
    texts, ids = [s for s, _ in known], F.array(*(F.lit(i) for _, i in known))
    found = F.filter(F.transform(sentences, normalised), lambda s: s.isin(texts))
    return F.transform(found, lambda s: F.element_at(ids, F.array_position(F.array(*map(F.lit, texts)), s).cast("int")))


def in_order(ids: Column, rule: list[str]) -> Column:
    """Do the rule's identifiers stand among ids in order, others in between allowed? One look through ids."""
    after = lambda seq, i: let(seq, lambda s: F.when(F.array_contains(s, i), F.slice(s, F.array_position(s, i).cast("int") + 1, F.size(s))))
    return F.size(reduce(after, rule, ids)) >= 0


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(id, n_known, sentence_ids, licenses, license_class) for each row: known sentences in order, comma-joined; licences recognised, sorted and comma-joined."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = sorted({(normalise(s), i) for i, ss in sentences.items() for s in ss})
    text = F.replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(SPDX), F.lit(f"{SPDX[:-1]} "))
    found = docs.select(F.col(id_col), let(text, lambda t: F.struct(known_ids(F.split(t, LINE_END), known).alias("lines"), F.when(F.contains(t, F.lit("\n")), known_ids(F.split(t, TEXT_END), known)).otherwise(F.array().cast("array<string>")).alias("text"))).alias("k"))
    # each cut of the text is matched by itself; the fuller one is reported
    by_line, by_text = F.col("k")["lines"], F.col("k")["text"]
    matched = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(in_order(by_line, r) | in_order(by_text, r), F.lit(name)) for name, r in rules)))))
    licenses = F.when(F.size(by_line) + F.size(by_text) > 0, matched).otherwise(F.array().cast("array<string>"))
    held = lambda names: F.arrays_overlap("licenses", F.array(*map(F.lit, names)))
    best = F.when(F.size(by_text) > F.size(by_line), by_text).otherwise(by_line)
    kind = F.when(F.size("licenses") == 0, "none").when(held(RESTRICTED), "restricted").when(held(COPYLEFT), "copyleft").otherwise("permissive")
    return found.select(F.col(id_col), best.alias("ids"), licenses.alias("licenses")).select(id_col, F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), kind.alias("license_class"))
