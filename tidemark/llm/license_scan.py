"""Licence recognition by sentence rules, with DataFrame functions only.

A text is cut into units (at line ends, and after . ! ? ; or : before white space). Each unit is normalised (small
letters, every other character than a-z and 0-9 a space, single spaces). A known licence sentence is found where neighbouring units, with no
blank line among them, make up the whole of it, so it may be wrapped over lines or hold a stop; where several begin at one unit, the longest counts, and the
search goes on after it. Both tables are constants of this module, so that they are literals of the plan and nothing is shuffled. The identifiers
found in a document, in order, are matched against ordered rules, longest first: a rule holds where its identifiers follow
one another directly among those found that no longer rule with the same identifiers has taken.

Defined cases: null or empty text has no sentence and no licence; a sentence that repeats counts each time; a licence is
named once however often its rules hold; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences by identifier.
SENTENCES: dict[str, str] = {
    "mit-ref": "Released under the MIT License.",
    "mit-ref-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "gpl-v3": "Version 3, 29 June 2007",
    "gpl-v2": "Version 2, June 1991",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc0-ref": "This work is dedicated to the public domain under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
    "apache-title": "Apache License",
    "apache-v2": "Version 2.0, January 2004",
    "gpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "lgpl-v21": "Version 2.1, February 1999",
    "lgpl21-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "agpl-v3": "Version 3, 19 November 2007",
    "agpl3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl11-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-title": "Eclipse Public License - v 1.0",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-ref": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-event": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "wtfpl-v2": "Version 2, December 2004",
    "cc0-title": "CC0 1.0 Universal",
    "cc-by-title": "Creative Commons Attribution 4.0 International",
    "cc-by-sa-title": "Creative Commons Attribution-ShareAlike 4.0 International",
    "cc-by-nc-title": "Creative Commons Attribution-NonCommercial 4.0 International",
    "bsd3-ref": "Licensed under the BSD 3-Clause License.",
    "bsd2-ref": "Licensed under the BSD 2-Clause License.",
    "isc-title": "ISC License",
}

# Licence identifiers that stand after "SPDX-License-Identifier:", each a sentence and a rule of its own.
SPDX: list[str] = """MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib BSL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0
    GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later
    AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense WTFPL Artistic-2.0 PostgreSQL
    Python-2.0 EUPL-1.2 NCSA""".split()
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}

# Rules as (licence, identifiers in order).
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-licensed",)),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title-the", "mit-grant")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-title", "apache-v2")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0", ("gpl-title", "gpl-v3")),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("LGPL-2.1", ("lgpl-title", "lgpl-v21")),
    ("LGPL-2.1", ("lgpl21-notice",)),
    ("LGPL-3.0", ("lgpl-title", "gpl-v3")),
    ("LGPL-3.0", ("lgpl3-notice",)),
    ("AGPL-3.0", ("agpl-title", "agpl-v3")),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("MPL-2.0", ("mpl-title",)),
    ("MPL-1.1", ("mpl11-notice",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-ref",)),
    ("Zlib", ("zlib-warranty", "zlib-event")),
    ("WTFPL", ("wtfpl-title", "wtfpl-v2")),
    ("CC0-1.0", ("cc0-title",)),
    ("CC-BY-4.0", ("cc-by-title",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-title",)),
    ("GPL-2.0", ("gpl-title", "gpl-v2")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl-notice",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
]

RULES += [(re.sub("-(only|or-later)$", "", x), (f"spdx-{x.lower()}",)) for x in SPDX]

INNER_BREAK = r"([.!?;:])[ \t\r]+(?=[^ \t\r\n])"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def forms(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised form of each whole sentence to identifier."""
    out: dict[str, str] = {}
    for name, sentence in sentences.items():
        form = plain(sentence)
        if not form or form in out:
            raise ValueError(f"licence sentence {name} is {f'the same as {out[form]}' if form else 'empty'}")
        out[form] = name
    return out


def found_ids(text: Column, sentences: dict[str, str]) -> Column:
    if not sentences:
        return F.array().cast("array<string>")
    known = forms(sentences)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    units = F.translate(F.regexp_replace(text, INNER_BREAK, "$1\n"), capitals, small)
    units = F.regexp_replace(F.regexp_replace(units, r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n")
    units = F.concat(F.lit("\n"), F.trim(units), F.lit("\n"))
    whole = "|".join(form.replace(" ", r"[ \n]") for form in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(units, F.lit(rf"\n({whole})(?=\n)"), F.lit(1))
    return F.coalesce(F.transform(found, lambda s: F.element_at(names, F.translate(s, "\n", " "))), F.array().cast("array<string>"))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) per document row: identifiers in order and licences sorted, comma-joined."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found_ids(F.col("text"), sentences).alias("ids"))
    trail = F.array_join(F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), "")
    held = F.array(*[F.when(F.contains(without(trail, longer), F.lit(step(ids))), F.lit(name)) for name, ids, longer in ordered(rules)])
    licences = F.array_sort(F.array_distinct(F.filter(held, lambda x: x.isNotNull())))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licences, ",").alias("licenses"))


def step(ids: tuple[str, ...]) -> str:
    return "".join(f",{x}," for x in ids)


def ordered(rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, tuple[str, ...], list[tuple[str, ...]]]]:
    """Each rule with the longer ones that hold its identifiers, longest first: where those hold, it doesn't."""
    return [(name, ids, sorted({x for _, x in rules if len(x) > len(ids) and step(ids) in step(x)}, key=len, reverse=True)) for name, ids in rules]


def without(trail: Column, taken: list[tuple[str, ...]]) -> Column:
    for ids in taken:
        trail = F.replace(trail, F.lit(step(ids)), F.lit("|"))
    return trail


def oracle() -> str:
    """The same in DuckDB's SQL: line ends are doubled there, as its patterns can't look ahead."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = forms(SENTENCES)
    names = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known.items())
    whole = "|".join(form.replace(" ", "(?: |\n\n)") for form in sorted(known, key=len, reverse=True))

    def rest(longer: list[tuple[str, ...]]) -> str:
        out = "trail"
        for ids in longer:
            out = f"replace({out}, {quote(step(ids))}, '|')"
        return out

    rules = ", ".join(f"CASE WHEN contains({rest(longer)}, {quote(step(ids))}) THEN {quote(name)} END" for name, ids, longer in ordered(RULES))
    return f"""
    WITH cut AS (SELECT doc_id, translate(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r]+([^ \t\r\n])', '\1' || chr(10) || '\2', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    units AS (SELECT doc_id, chr(10) || trim(regexp_replace(regexp_replace(t, '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ') || chr(10) AS t FROM cut),
    found AS (SELECT doc_id, list_transform(regexp_extract_all(replace(t, chr(10), chr(10) || chr(10)), '\n({whole})\n', 1),
        lambda s: MAP {{{names}}}[replace(s, chr(10) || chr(10), ' ')]) AS ids FROM units),
    trails AS (SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda x: ',' || x || ','), 'string_agg', '') AS trail FROM found)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
        array_to_string(list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))), ',') AS licenses FROM trails"""
