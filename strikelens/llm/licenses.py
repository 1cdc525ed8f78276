"""Licence recognition by sentences: known sentences become identifiers, identifiers meet rules.

Comment leaders go from the beginnings of lines, then texts are cut into sentences, however these
are wrapped, and normalised; a sentence that equals a known one has its number.
The numbers of a text in order, with U for a run of unknown sentences, are matched against
ordered rules, the most telling first; what a rule has matched is gone for the rules after it.
All of it is one projection per row: no shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known licences and notices, by number.
SENTENCES = {
    1: "Licensed under CC BY-NC 4.0.",
    2: "This work is licensed under the GNU General Public License, version 3.",
    3: "Licensed under the Apache License, Version 2.0.",
    4: "Released under the MIT License.",
    5: 'Licensed under the Apache License, Version 2.0 (the "License");',
    6: "you may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    8: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    9: "See the License for the specific language governing permissions and limitations under the License.",
    10: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    13: "This program is free software;",
    14: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    15: "either version 2 of the License, or (at your option) any later version.",
    16: "either version 3 of the License, or (at your option) any later version.",
    17: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    18: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    19: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    20: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    21: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    22: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    23: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    24: "This is free and unencumbered software released into the public domain.",
    25: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    26: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    27: "Licensed under CC BY 4.0.",
    28: "Licensed under CC BY-SA 4.0.",
    29: "Licensed under the MIT License.",
    30: "All rights reserved.",
    31: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    32: "This library is free software;",
    33: "either version 2.1 of the License, or (at your option) any later version.",
    34: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation;",
    35: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    36: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    37: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    38: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    39: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v.",
    40: "Distributed under the Boost Software License, Version 1.0.",
    41: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    42: "The origin of this software must not be misrepresented;",
    43: "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    44: "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.",
    45: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    46: "The MIT License (MIT)",
    47: "MIT License",
    48: "Apache License, Version 2.0",
    49: "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    50: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    51: "Licensed under the BSD 3-Clause License.",
    52: "Licensed under the Mozilla Public License, version 2.0.",
    53: "2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
}
# Identifiers of licences as they stand in SPDX lines.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
FIRST_SPDX = 1001
# Fixed values: (licence, numbers of its sentences in order), tried from the first to the last.
RULES = (
    ("Apache-2.0", (5, 6, 7, 8, 9)),
    ("Apache-2.0", (5, 6)),
    ("MIT", (10, 11, 12)),
    ("MIT", (10, 11)),
    ("GPL-3.0-or-later", (13, 14, 16)),
    ("GPL-2.0-or-later", (13, 14, 15)),
    ("LGPL-2.1-or-later", (32, 31, 33)),
    ("LGPL-2.1-or-later", (13, 31, 33)),
    ("LGPL-3.0-or-later", (32, 31, 16)),
    ("LGPL-3.0-or-later", (13, 31, 16)),
    ("AGPL-3.0-or-later", (13, 34, 16)),
    ("GPL-2.0-only", (13, 35)),
    ("BSD-3-Clause", (18, 19, 20, 21)),
    ("BSD-3-Clause", (18, 19, 20, 49)),
    ("BSD-2-Clause", (18, 19, 20)),
    ("ISC", (22,)),
    ("ISC", (50,)),
    ("MPL-2.0", (23, 36)),
    ("MPL-2.0", (23, 37)),
    ("MPL-2.0", (23,)),
    ("EPL-2.0", (38,)),
    ("EPL-2.0", (39, 53)),
    ("BSL-1.0", (40,)),
    ("Zlib", (41, 42)),
    ("BSD-3-Clause", (43,)),
    ("MIT", (44,)),
    ("CC0-1.0", (45,)),
    ("Unlicense", (24,)),
    ("Apache-2.0", (3,)),
    ("GPL-3.0-only", (2,)),
    ("MIT", (4,)),
    ("MIT", (29,)),
    ("BSD-3-Clause", (51,)),
    ("MPL-2.0", (52,)),
    ("MIT", (46,)),
    ("MIT", (47,)),
    ("Apache-2.0", (48,)),
    ("CC-BY-NC-4.0", (1,)),
    ("CC-BY-SA-4.0", (26,)),
    ("CC-BY-SA-4.0", (28,)),
    ("CC-BY-4.0", (25,)),
    ("CC-BY-4.0", (27,)),
    *((name, (FIRST_SPDX + k,)) for k, name in enumerate(SPDX)),
)
#: Every known sentence holds one of these, so texts without any need no cutting.
SIGNS = ("licen", "permission", "warrant", "redistribut", "software", "rights reserved", "copy of the mpl", "rights to this")
#: Marks of a cut between sentences and of a line end within one.
MARK, LINE = "\x01", "\x02"
#: Comment signs that begin a line, in any number, and those that end one.
LEADERS = r"^[ \t]*((/\*+|\*+/?|#+|//+|--+|;+|<!--)[ \t]*)*"
TRAILERS = r"[ \t]*(\*+/|-->)[ \t]*$"
SPDX_LINE = r"[Ss][Pp][Dd][Xx]-[Ll]icense-[Ii]dentifier:[ \t]*([A-Za-z0-9.-]+)"


def _plain(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


#: Known sentences and identifiers as they read after normalisation.
_KNOWN = {
    **{_plain(s): n for n, s in SENTENCES.items()},
    **{_plain(f"SPDX {name}"): FIRST_SPDX + k for k, name in enumerate(SPDX)},
    # Older names of identifiers.
    **{_plain(f"SPDX {name.removesuffix('-only')}"): FIRST_SPDX + k for k, name in enumerate(SPDX) if name.endswith("-only")},
}


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentence_numbers(text: Column, number: Callable[[Column], Column], longest: int) -> Column:
    """The numbers of a text's sentences in order, null for an unknown one.

    A sentence ends with . ! ? ; or : before white space, at an empty line, and around a line that
    is a known one by itself; an SPDX identifier is a sentence of its own. Within a sentence of
    several lines the last ones may be a known sentence, what stands above them is one unknown.
    No known sentence has more than ``longest`` characters, so no more of the end is looked at.
    """
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, TRAILERS, ""), LEADERS, ""))
    later = F.transform(lines, lambda x: F.when(x.rlike(SPDX_LINE), F.replace(x, F.lit("+"), F.lit("-or-later"))).otherwise(x))
    named = F.transform(later, lambda x: F.regexp_replace(x, SPDX_LINE, f"{MARK}spdx $1{MARK}"))
    alone = F.transform(
        named,
        lambda x: F.when(number(_normal(x)).isNotNull(), F.concat(F.lit(MARK), x, F.lit(MARK))).when(F.trim(x) == "", MARK).otherwise(x),
    )
    cut = F.split(F.regexp_replace(F.array_join(alone, LINE), rf"([.!?;:])[ \t{LINE}]+", rf"$1{MARK}"), MARK)
    kept = F.transform(cut, lambda x: F.regexp_replace(F.lower(x), f"[^a-z0-9{LINE}]+", " "))
    kept = F.transform(kept, lambda x: F.btrim(F.regexp_replace(x, f" ?{LINE}[ {LINE}]*", LINE), F.lit(f" {LINE}")))

    def numbers(x: Column) -> Column:
        whole = number(F.replace(x, F.lit(LINE), F.lit(" ")))
        parts = F.split(F.right(x, F.lit(longest + 1)), LINE)
        ends = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
        found = F.filter(F.transform(ends, lambda i: number(F.array_join(F.slice(parts, i, F.size(parts)), " "))), lambda n: n.isNotNull())
        none = F.lit(None).cast("int")
        several = F.when(F.size(found) > 0, F.array(none, found[0])).otherwise(F.array(none))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(several)

    return F.flatten(F.transform(F.filter(kept, lambda x: x != ""), numbers))


def recognise(df: DataFrame, max_gap: int = 2, rules=RULES, known: dict[str, int] | None = None) -> DataFrame:
    """A row for each row: ``doc_id``, ``sentence_ids``, ``licenses`` and ``unmatched``.

    ``sentence_ids`` has the numbers of known sentences in order, joined by commas, with U for
    each run of unknown sentences between them; ``licenses`` the licences whose rules matched, in
    the order of the rules and joined by commas; ``unmatched`` how many known sentences no rule
    took. The sentences of a rule must follow each other; a run of at most ``max_gap`` unknown
    ones may stand between two (written u, a longer run U). Null and empty texts hold no
    sentence; very long ones are cut whole. An empty table gives no rows. Repeated rows get equal results; other columns are ignored.
    """
    known = known or _KNOWN
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.expr("false")
    lowered = F.lower(text)
    for sign in SIGNS:
        told = told | lowered.contains(sign)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = sentence_numbers(text, lambda sentence: F.try_element_at(table, sentence), max(map(len, known)))
    found = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(told, ids).otherwise(F.array().cast("array<int>")).alias("ids"),
    )
    # Only texts with a known sentence are written out; unknown sentences become u, one each.
    said = F.when(
        F.exists("ids", lambda x: x.isNotNull()),
        F.array_join(F.transform("ids", lambda x: F.coalesce(F.concat(F.lit("<"), x.cast("string"), F.lit(">")), F.lit("u"))), ""),
    ).otherwise("")
    line = F.regexp_replace(F.regexp_replace(said, "^u+|u+$", ""), f"u{{{max_gap + 1},}}", "U")
    line = F.regexp_replace(line, "u+", "u")
    rows = found.select("doc_id", line.alias("line")).withColumn("left", F.col("line"))
    # Rules of several sentences one after another; a rule of one sentence is a look at its number.
    hits = []
    for k, (_, ids) in enumerate(rules):
        if len(ids) > 1:
            pattern = "u?".join(f"<{i}>" for i in ids)
            rows = rows.withColumn(f"hit{k}", F.when(F.col("left").rlike(pattern), F.lit(k)))
            rows = rows.withColumn("left", F.regexp_replace("left", pattern, "#"))
            hits.append(F.col(f"hit{k}"))
    single = [F.lit(x) for k, (_, ids) in reversed(list(enumerate(rules))) if len(ids) == 1 for x in (str(ids[0]), k)]
    rest = F.regexp_extract_all("left", F.lit("<([0-9]+)>"), F.lit(1))
    taken = F.transform(rest, lambda i: F.try_element_at(F.create_map(*single), i)) if single else F.array().cast("array<int>")
    names = F.array(*[F.lit(name) for name, _ in rules])
    order = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*hits, F.lit(None).cast("int")), taken))))
    ids = F.array_join(F.split(F.regexp_replace(F.upper("line"), "<([0-9]+)>|(U)", "$1$2,"), ","), ",")
    return rows.select(
        "doc_id",
        F.regexp_replace(ids, ",+$", "").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.transform(order, lambda k: names[k])), ",").alias("licenses"),
        (F.size(rest) - F.size(F.array_compact(taken))).cast("long").alias("unmatched"),
    )
