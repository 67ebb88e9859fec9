"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into pieces behind . ! ? ; : before white space, and at line feeds; all is
normalised (lower case, runs of other characters than letters and digits as one space). A
known licence sentence is found where it equals a run of whole pieces, so neither wrapped
lines, with or without comment marks, nor a cut within it matter; lines without a letter or
digit end every run. The identifiers found, in order, are matched against ordered rules: a
rule holds if its identifiers occur in that order, with any other sentences between them.
Rules with more identifiers come first and use up what they match, so a rule that a longer
one contains holds only where its sentences stand once more. A tag that names a licence by its
short identifier (SPDX) is a sentence of its own.

Texts without any keyword are not cut at all; every known sentence holds a keyword, so
this changes no result. Everything happens within a row: no shuffle.

Edge cases: null and empty texts have no sentences; a sentence that repeats is found
each time; rows are independent, so repeated rows give repeated results; an empty table
gives an empty result; extra columns stay, but those made are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, normalised.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-compliance": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc4-notice": "licensed under cc by nc 4 0",
    "cc-by4-notice": "licensed under cc by 4 0",
    "cc-by-sa4-notice": "licensed under cc by sa 4 0",
    "cc-by4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd4-work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc0-dedication": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-only-as": "this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense-grant": "this is free and unencumbered software released into the public domain",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-notice": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "eupl12-notice": "licensed under the eupl version 1 2",
    "wtfpl-grant": "this program is free software it comes without any warranty to the extent permitted by applicable law",
    "artistic2-notice": "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
}

#: Short identifiers that a tag may name.
SPDX = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BlueOak-1.0.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later
GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0
MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 QPL-1.0 Ruby SSPL-1.0 UPL-1.0 Unlicense Vim W3C WTFPL X11 ZPL-2.1 Zlib curl
""".split()


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


SENTENCES |= {f"spdx-{i.lower()}": f"spdx license identifier {_plain(i)}" for i in SPDX}

#: Licence, and the identifiers that must occur in this order.
RULES = [
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-the-license", "apache2-compliance"]),
    ("Apache-2.0", ["apache2-copy", "apache2-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-4.0", ["cc-by4-notice"]),
    ("CC-BY-4.0", ["cc-by4-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("0BSD", ["0bsd-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-warranty"]),
    ("Artistic-2.0", ["artistic2-notice"]),
    ("BSL-1.0", ["boost-notice"]),
    ("BSL-1.0", ["boost-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-work"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-work"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EUPL-1.2", ["eupl12-notice"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-as"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "lgpl-warranty"]),
    ("Unlicense", ["unlicense-grant"]),
    ("WTFPL", ["wtfpl-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    *((i, [f"spdx-{i.lower()}"]) for i in SPDX),
]


def _pattern(rule: list[str]) -> str:
    """A rule over identifiers between < and >, with what stands in between as groups."""
    return "((?:<[^>]*>)*?)".join(f"<{re.escape(i)}>" for i in rule)


#: Rules of several identifiers, those with the most first, and the pairs of a licence and an identifier that is enough.
LONG_RULES = sorted((r for r in RULES if len(r[1]) > 1), key=lambda r: -len(r[1]))
SINGLE_RULES = [(name, rule[0]) for name, rule in RULES if len(rule) == 1]

#: Every known sentence holds one of these.
KEYWORDS = ("licen", "permi", "warrant", "redistribut", "endorse", "unencumbered", "dedicated", "eupl")
MARK = "\u0001"


#: Stands for lines without a letter or digit.
PARAGRAPH = "\u0002"
#: Known sentences between two cuts, cut or not between their words; of those that begin alike the shortest comes first.
_KNOWN = "|".join(s.replace(" ", f"[ {MARK}]+") for s in sorted(SENTENCES.values(), key=len))
_FOUND = f"[{MARK}{PARAGRAPH}] *({_KNOWN})(?= *[{MARK}{PARAGRAPH}])"


def sentences(text: Column) -> Column:
    """The known sentences that the text holds, normalised, in order."""
    cut = F.regexp_replace(text, f"[{MARK}{PARAGRAPH}]", " ")
    cut = F.regexp_replace(cut, r"\n[^\p{L}\p{N}\n]*(?:\n[^\p{L}\p{N}\n]*)*\n", PARAGRAPH)
    cut = F.regexp_replace(cut, r"([.!?;:])\s+|\n", "$1" + MARK)
    plain = F.regexp_replace(F.lower(cut), rf"[^\p{{L}}\p{{N}}{MARK}{PARAGRAPH}]+", " ")
    # lines and cuts without a word in between are one cut
    plain = F.regexp_replace(F.concat(F.lit(MARK), plain, F.lit(MARK)), f"{MARK}[ {MARK}]*", MARK)
    found = F.regexp_extract_all(plain, F.lit(_FOUND), F.lit(1))
    return F.transform(found, lambda s: F.regexp_replace(s, f"[ {MARK}]+", " "))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with sentence_ids (in order), licences (sorted, distinct) and n_sentences
    (known sentences found)."""
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    keyword = F.coalesce(F.col(text).rlike("(?i)" + "|".join(KEYWORDS)), F.lit(False))
    ids = F.filter(F.transform(sentences(F.col(text)), lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    ids = F.when(keyword, ids).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("sentence_ids", ids)
    some = F.size("sentence_ids") > 0
    line = F.when(some, F.concat(F.lit("<"), F.array_join("sentence_ids", "><"), F.lit(">"))).otherwise("")
    held = []
    for name, rule in LONG_RULES:  # what a rule uses up is gone for those that follow
        pattern = _pattern(rule)
        held.append(F.when(line.rlike(pattern), F.lit(name)))
        line = F.regexp_replace(line, pattern, "".join(f"${i}" for i in range(1, len(rule))))
    names = F.create_map(*(F.lit(x) for name, i in SINGLE_RULES for x in (i, name)))
    alone = F.transform(F.regexp_extract_all(line, F.lit("<([^>]*)>"), F.lit(1)), lambda i: F.try_element_at(names, i))
    found = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*held), alone), lambda x: x.isNotNull())))
    licences = F.when(some, found).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"licences": licences, "n_sentences": F.size("sentence_ids").cast("long")})


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of op5's query: the same cut, in a dialect without look-ahead, so each mark stands twice."""
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    single = ", ".join(f"('{name}', '<{i}>')" for name, i in SINGLE_RULES)
    sentence = "|".join(s.replace(" ", "[ \x01]+") for s in sorted(SENTENCES.values(), key=len))
    steps, line = [], "line"
    for k, (name, rule) in enumerate(LONG_RULES):
        back = "".join(f"\\{i}" for i in range(1, len(rule)))
        steps.append(f"l{k + 1} AS (SELECT * EXCLUDE (line, held), regexp_replace(line, '{_pattern(rule)}', '{back}', 'g') AS line, CASE WHEN regexp_matches(line, '{_pattern(rule)}') THEN list_append(held, '{name}') ELSE held END AS held FROM l{k})")
    return f"""
WITH known(id, sentence) AS (VALUES {known}),
single(licence, tag) AS (VALUES {single}),
cut AS (
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x01\\x02]', ' ', 'g'), '\n[^\\p{{L}}\\p{{N}}\n]*(?:\n[^\\p{{L}}\\p{{N}}\n]*)*\n', chr(2), 'g'), '([.!?;:])[ \t\n\x0B\f\r]+|\n', '\1' || chr(1), 'g') AS t
    FROM {table}
),
plain AS (
    SELECT doc_id, regexp_replace(chr(1) || regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}\\x01\\x02]+', ' ', 'g') || chr(1), '\\x01[ \\x01]*', chr(1), 'g') AS t FROM cut
),
pieces AS (
    SELECT doc_id, regexp_extract_all(regexp_replace(t, '([\\x01\\x02])', '\1\1', 'g'), '[\\x01\\x02] *((?:{sentence})) *[\\x01\\x02]', 1) AS s FROM plain
),
each AS (SELECT doc_id, trim(regexp_replace(unnest(s), '[ \\x01]+', ' ', 'g')) AS sentence, generate_subscripts(s, 1) AS pos FROM pieces),
l0 AS (SELECT doc_id, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY pos) AS line, CAST([] AS VARCHAR[]) AS held FROM each JOIN known USING (sentence) GROUP BY doc_id),
{", ".join(steps)},
alone AS (SELECT doc_id, list(licence) AS more FROM l{len(steps)} JOIN single ON contains(line, tag) GROUP BY doc_id)
SELECT d.doc_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(l.held, coalesce(a.more, [])))), ','), '') AS licences, coalesce(l.n, 0) AS n_sentences
FROM {table} d LEFT JOIN l{len(steps)} l USING (doc_id) LEFT JOIN alone a USING (doc_id)
"""
