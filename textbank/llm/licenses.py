"""License scans by sentence rules.

Texts are cut into sentences, sentences are normalised and looked up in a table
of licence sentences, and the resulting sequence of sentence identifiers of a
document is matched against ordered licence rules: a rule holds where its
identifiers follow each other, and the first rule in order wins a place. Only
DataFrame functions are used.

A sentence ends at a closing mark before white space or at a line that is blank
but for signs, as between paragraphs of a comment; a line end does not end it, so
wrapped texts are read as written. Where such a sentence is unknown, each of its
lines is looked up as a sentence too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textbank.llm.common import BROADCAST_ROWS

_GNU = {"gpl2": ("general public license", "2"), "gpl3": ("general public license", "3"), "lgpl21": ("lesser general public license", "2.1"), "lgpl3": ("lesser general public license", "3"), "agpl3": ("affero general public license", "3")}
_MODIFY = "you can redistribute it and/or modify it under the terms of the GNU "


def _gnu() -> dict[str, list[str]]:
    """Sentences of the notices of the GNU licences, by licence and version."""
    out: dict[str, list[str]] = {}
    for key, (name, v) in _GNU.items():
        own = f"{_MODIFY}{name}"
        short = key.rstrip("123").upper()
        full = v if "." in v else f"{v}.0"
        names = [f"GNU {name} {x}" for x in (f"version {v}", f"version {full}", f"v{v}", f"v{full}", v, full)] + [f"{gnu}{short}{x}" for gnu in ("", "GNU ") for x in (f"-{full}", f"v{v}", f"v{full}", f" version {v}", f" {full}", f" v{v}")]
        out[f"{key}-ref"] = [f"Licensed under the {n}" for n in names]
        out[f"{key}-ref-later"] = [f"{s} {later}" for s in out[f"{key}-ref"] for later in ("or later", "or any later version", "or (at your option) any later version")]
        out[f"{key}-notice"] = [f"{own} as published by the Free Software Foundation, version {v}", f"{own} version {v} as published by the Free Software Foundation", f"{own} as published by the Free Software Foundation, version {v} of the License", f"{own} as published by the Free Software Foundation, either version {v} of the License", f"{own}, version {v}, as published by the Free Software Foundation"]
        out[f"{key}-notice-later"] = [f"{own} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"]
    for key in ("gpl", "lgpl", "agpl"):
        name = next(n for k, (n, _) in _GNU.items() if k.startswith(key))
        out[f"{key}-modify"] = [f"{_MODIFY}{name} as published by the Free Software Foundation"]
    for v in ("2", "2.1", "3"):
        key = v.replace(".", "")
        out[f"version-{key}"] = [f"either version {v} of the License", f"version {v} of the License"]
        out[f"version-{key}-later"] = [f"either version {v} of the License, or (at your option) any later version"]
    return out


#: Names of licences in references, by identifier.
NAMES = {
    "mit-ref": ("MIT License", "MIT", "MIT License (MIT)", "Expat License"),
    "apache-ref": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"),
    "bsd3-ref": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "BSD-3-Clause License", "New BSD License", "Modified BSD License"),
    "bsd2-ref": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "BSD-2-Clause License", "Simplified BSD License"),
    "isc-ref": ("ISC License", "ISC"),
    "0bsd-ref": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD"),
    "mpl-ref": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"),
    "zlib-ref": ("zlib License", "zlib/libpng License", "Zlib"),
    "unlicense-ref": ("Unlicense",),
    "boost-ref": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "cc-by-ref": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International"),
    "cc-by-sa-ref": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "cc0-ref": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
}
#: Licence tags of files, by the licence that they mean.
TAGS = {
    **{x: (x,) for x in ("MIT", "Apache-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "MPL-2.0", "Zlib", "Unlicense", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC0-1.0")},
    **{f"{x}-only": (f"{x}-only", x) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
    **{f"{x}-or-later": (f"{x}-or-later",) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}

#: Licence sentences as published, by identifier. They are normalised as texts are.
SENTENCES = {
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Licensed under MIT", "This software is released under the MIT License", "This code is licensed under the MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "notice-kept": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "The software is provided \"as is\", without warranty of any kind, express or implied",
    ],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed under Apache 2.0", "This project is licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Licensed under the Apache License 2.0"],
    "apache-limits": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-title": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-endorse": [
        f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for holder in ("the copyright holder", "the University", "the copyright owner", "the organization", "the author", "the project")
    ],
    "bsd-as-is": [
        f"THIS SOFTWARE IS PROVIDED BY {holder} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
        for holder in ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS", "THE AUTHOR", "THE AUTHOR AND CONTRIBUTORS")
    ],
    "bsd3-ref": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "Licensed under the 3-Clause BSD License"],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "Licensed under the 2-Clause BSD License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": [f"THE SOFTWARE IS PROVIDED \"AS IS\" AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS" for who in ("THE AUTHOR", "ISC")],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-ref": ["Licensed under the ISC License", "Released under the ISC License"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "mpl-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, v.2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "mpl-ref": ["Licensed under the Mozilla Public License, Version 2.0", "Licensed under the Mozilla Public License 2.0"],
    "free-software": ["This program is free software", "This file is free software", "This library is free software", "This software is free software", "It is free software"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gpl-later": ["or (at your option) any later version"],
    **_gnu(),
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under the Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["This work is dedicated to the public domain", "Licensed under CC0 1.0", "CC0 1.0 Universal"],
    "reserved": ["All rights reserved"],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "tag": ["SPDX-License-Identifier"],
    **{f"tag-{x}": list(ids) for x, ids in TAGS.items()},
    **{f"tagged-{x}": [f"SPDX-License-Identifier:{i}" for i in ids] for x, ids in TAGS.items()},
}
for _id, _names in NAMES.items():
    SENTENCES[_id] = [*SENTENCES.get(_id, []), *(f"Licensed under the {n}" for n in _names)]


def _gnu_rules() -> list[tuple[tuple[str, ...], str]]:
    out: list[tuple[tuple[str, ...], str]] = []
    for key, (_, v) in _GNU.items():
        family = key.rstrip("123")
        name, version = f"{family.upper()}-{v if '.' in v else v + '.0'}", v.replace(".", "")
        later = [(f"{key}-notice-later",), (f"{family}-modify", f"version-{version}-later"), (f"{key}-ref-later",), (f"{key}-ref", "gpl-later")]
        only = [(f"{key}-notice",), (f"{family}-modify", f"version-{version}"), (f"{key}-ref",)]
        # The text of a licence ends with an example of its notice, which grants nothing.
        out += [((f"{key}-title", *free, *rule), f"{name}-only") for free in (("free-software",), ()) for rule in (*later[:2], *only[:2])] + [((f"{key}-title",), f"{name}-only")]
        for rules, suffix in ((later, "-or-later"), (only, "-only")):
            out += [((*free, *rule), name + suffix) for free in (("free-software",), ()) for rule in rules]
    return out


#: Ordered rules, more specific first; a rule is a sequence of sentence identifiers and the licence it means.
RULES = [
    *[(("tag", f"tag-{x}"), x) for x in TAGS],
    *[((f"tagged-{x}",), x) for x in TAGS],
    *[(("mit-title", *rest), "MIT") for rest in (("mit-grant", "notice-kept", "as-is", "no-liability"), ("mit-grant", "notice-kept", "as-is"), ("mit-grant", "notice-kept"), ("mit-grant",))],
    (("mit-grant", "notice-kept", "as-is", "no-liability"), "MIT"),
    (("mit-grant", "notice-kept", "as-is"), "MIT"),
    (("mit-grant", "notice-kept"), "MIT"),
    (("mit-grant",), "MIT"),
    (("mit-ref",), "MIT"),
    (("mit-title",), "MIT"),
    (("apache-title", "apache-ref", "apache-limits", "apache-copy", "apache-basis"), "Apache-2.0"),
    (("apache-ref", "apache-limits", "apache-copy", "apache-basis"), "Apache-2.0"),
    (("apache-ref", "apache-limits"), "Apache-2.0"),
    (("apache-title",), "Apache-2.0"),
    (("apache-ref",), "Apache-2.0"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-as-is"), "BSD-4-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is"), "BSD-2-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-as-is"), "BSD-1-Clause"),
    (("bsd-redistribution",), "BSD-2-Clause"),
    (("bsd3-ref",), "BSD-3-Clause"),
    (("bsd2-ref",), "BSD-2-Clause"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("0bsd-grant",), "0BSD"),
    (("isc-ref",), "ISC"),
    (("mpl-title", "mpl-header", "mpl-copy"), "MPL-2.0"),
    (("mpl-title", "mpl-header"), "MPL-2.0"),
    (("mpl-header", "mpl-copy"), "MPL-2.0"),
    (("mpl-header",), "MPL-2.0"),
    (("mpl-title",), "MPL-2.0"),
    (("mpl-ref",), "MPL-2.0"),
    *_gnu_rules(),
    (("0bsd-ref",), "0BSD"),
    (("zlib-grant",), "Zlib"),
    (("zlib-ref",), "Zlib"),
    (("unlicense",), "Unlicense"),
    (("unlicense-ref",), "Unlicense"),
    (("boost-title",), "BSL-1.0"),
    (("boost-ref",), "BSL-1.0"),
    (("cc-by-ref",), "CC-BY-4.0"),
    (("cc-by-sa-ref",), "CC-BY-SA-4.0"),
    (("cc0-ref",), "CC0-1.0"),
    (("cc-by",), "CC-BY-4.0"),
    (("cc-by-sa",), "CC-BY-SA-4.0"),
    (("cc-by-nc",), "CC-BY-NC-4.0"),
    (("cc-by-nc-sa",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nd",), "CC-BY-ND-4.0"),
    (("cc0",), "CC0-1.0"),
    (("reserved",), "LicenseRef-All-Rights-Reserved"),
]

#: Where a sentence ends: a closing mark before white space or the end, or a line without ASCII letters and digits.
SENTENCE_END = r"[.!?:;][ \t\r\n]+|[.!?:;]\z|\n[^\nA-Za-z0-9]*\n"


#: How a normalised sentence starts that says what something is licensed under; every such start becomes "under".
LEAD = "^(?:(?:this|the) [a-z0-9]+ is |it is )?(?:licensed|released|distributed|published|provided|available|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def normalise(sentence: Column) -> Column:
    """Lower case, with runs of anything but ASCII letters and digits as one space, none at the ends, and one form for all ways to begin a reference."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), LEAD, "under ")


def _sentence_table(docs: DataFrame, sentences: dict[str, list[str]]) -> DataFrame:
    """sentence (normalised), sentence_id; broadcast if their number allows it."""
    rows = list({text: name for name, texts in sentences.items() for text in texts}.items())
    pairs = F.array(*[F.struct(F.lit(t).alias("raw"), F.lit(n).alias("sentence_id")) for t, n in rows])
    known = docs.sparkSession.range(1).select(F.inline(pairs)).groupBy(normalise(F.col("raw")).alias("sentence")).agg(F.min("sentence_id").alias("sentence_id"))
    return F.broadcast(known) if len(rows) <= BROADCAST_ROWS else known


def scan(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[tuple[str, ...], str]] | None = None) -> DataFrame:
    """doc_id, sentence_ids (in order), licenses (sorted, each once) and n_matches for each row of docs (doc_id, text).

    sentences and rules are parameters: published sentences by identifier, each
    without a sentence end inside, and sequences of identifiers, of which the
    first in order wins. A null or empty text has no sentence and no licence.
    Rows that share an id and a text share their answer; other columns are ignored.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("version"))
    known = _sentence_table(docs, sentences)
    whole = docs.select("doc_id", "version", F.posexplode(F.split("text", SENTENCE_END)).alias("pos", "raw"))
    lines = F.when(F.contains("raw", F.lit("\n")), F.concat(F.array("raw"), F.split("raw", "\n"))).otherwise(F.array("raw"))
    parts = whole.select("doc_id", "version", "pos", F.posexplode(lines).alias("line", "part"))
    hits = parts.withColumn("sentence", normalise(F.col("part"))).join(known, "sentence")
    # A known sentence stands for its lines.
    placed = hits.groupBy("doc_id", "version", "pos").agg(F.min("line").alias("least"), F.array_sort(F.collect_set(F.struct("line", "sentence_id"))).alias("own"))
    placed = placed.select("doc_id", "version", "pos", F.when(F.col("least") == 0, F.slice("own", 1, 1)).otherwise(F.col("own")).alias("own"))
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"]))
    found = placed.groupBy("doc_id", "version").agg(in_order.alias("own")).select("doc_id", "version", F.transform("own", lambda x: x["sentence_id"]).alias("sentence_ids"))
    none = F.array().cast(ArrayType(StringType()))
    # Rules take their places in order: what a rule has matched is replaced by its licence.
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    for sequence, name in rules:
        line = F.replace(line, F.lit(" " + "  ".join(sequence) + " "), F.lit(f" ={name} "))
    matched = F.filter(F.split(line, " +"), lambda x: x.startswith("="))
    found = found.withColumn("matched", F.transform(matched, lambda x: F.substring(x, F.lit(2), F.length(x)))).select(F.col("doc_id").alias("id_"), F.col("version").alias("version_"), "sentence_ids", "matched")
    return docs.select("doc_id", "version").join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("version").eqNullSafe(F.col("version_")), "left").select(
        "doc_id",
        F.coalesce("sentence_ids", none).alias("sentence_ids"),
        F.array_sort(F.array_distinct(F.coalesce("matched", none))).alias("licenses"),
        F.size(F.coalesce("matched", none)).cast("long").alias("n_matches"),
    )


def _sql() -> str:
    known = ", ".join("('{}', '{}')".format(t.replace("'", "''"), n) for n, texts in SENTENCES.items() for t in texts)
    normal = f"regexp_replace(trim(regexp_replace(lower({{}}), '[^a-z0-9]+', ' ', 'g')), '{LEAD}', 'under ')"
    line = "' ' || string_agg(sentence_id, '  ' ORDER BY pos, line) || ' '"
    for sequence, name in RULES:
        line = f"replace({line}, ' {'  '.join(sequence)} ', ' ={name} ')"
    return rf"""
WITH known AS (SELECT {normal.format('t')} AS sentence, min(n) AS sentence_id FROM (VALUES {known}) AS v(t, n) GROUP BY 1), p AS (
  SELECT doc_id, unnest(s) AS raw, generate_subscripts(s, 1) AS pos
  FROM (SELECT doc_id, regexp_split_to_array(text, '{SENTENCE_END}') AS s FROM documents WHERE text IS NOT NULL)
), q AS (
  SELECT doc_id, pos, unnest(c) AS part, generate_subscripts(c, 1) AS line
  FROM (SELECT doc_id, pos, CASE WHEN contains(raw, chr(10)) THEN list_concat([raw], string_split(raw, chr(10))) ELSE [raw] END AS c FROM p)
), h AS (
  SELECT doc_id, pos, line, sentence_id FROM q JOIN known ON {normal.format('part')} = sentence
  QUALIFY line = 1 OR min(line) OVER (PARTITION BY doc_id, pos) > 1
), l AS (SELECT doc_id, string_agg(sentence_id, ',' ORDER BY pos, line) AS ids, {line} AS line FROM h GROUP BY doc_id),
m AS (SELECT doc_id, ids, list_transform(list_filter(string_split(line, ' '), lambda x: starts_with(x, '=')), lambda x: x[2:]) AS found FROM l)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, array_to_string(list_sort(list_distinct(coalesce(found, []))), ',') AS licenses, CAST(len(coalesce(found, [])) AS BIGINT) AS n_matches
FROM documents d LEFT JOIN m USING (doc_id)
"""


SQL = _sql()
