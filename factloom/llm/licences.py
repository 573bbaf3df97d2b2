"""Licence scan by sentence rules, in DataFrame functions only.

A text's sentences (cut at line ends and at full stops before white space) are normalised to lower-case letters and digits with single
spaces. A sentence that is a known licence sentence becomes its identifier, and so does a run of consecutive lines that makes one up,
the longest from where it begins, so that wrapped texts are found; others break nothing and are left out. Blank lines (comment marks alone too) end a run. The
sequence of a document's identifiers is then matched against licence rules in order: a rule that matches names its
licence, once, and takes its identifiers out of the sequence before the next rule is tried.

Only texts with one of a few words, of which every sentence given has one, are cut at all. Null and empty texts have no sentences and no licence.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shared import fresh

#: Known sentences, normalised, by identifier; fixed values.
SENTENCES = {
    "mit_name": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "the mit license mit", "mit license", "distributed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind"],
    "liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2_name": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "apache license version 2 0", "apache license 2 0"],
    "apache2_comply": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2_disclaim": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl2_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl2_only": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "gpl2_name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"],
    "gpl3_name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3"],
    "lgpl21_name": ["licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"],
    "lgpl3_name": ["this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"],
    "agpl3_name": ["this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"],
    "gpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_copy": ["you should have received a copy of the gnu general public license along with this program"],
    "mpl2_name": ["mozilla public license version 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "epl2_name": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "licensed under the eclipse public license 2 0", "licensed under the eclipse public license version 2 0", "eclipse public license v 2 0"],
    "epl1_name": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "licensed under the eclipse public license version 1 0", "eclipse public license v 1 0"],
    "bsl_name": ["distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0", "boost software license version 1 0"],
    "bsl_grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "licensed under the unlicense"],
    "unlicense_any": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib_as_is": ["this software is provided as is without any express or implied warranty"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "wtfpl": ["do what the fuck you want to public license", "licensed under the wtfpl"],
    "bsd2_name": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "released under the bsd 2 clause license"],
    "bsd3_name": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "released under the bsd 3 clause license"],
    "isc_name": ["licensed under the isc license", "isc license", "released under the isc license"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "cc0": ["this work is released under the cc0 1 0 license", "licensed under cc0 1 0", "released under cc0 1 0"],
    "cc_by": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by_nc_sa": ["licensed under cc by nc sa 4 0"],
    "cc_by_nc_nd": ["licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"],
    "cc_by_nd": ["licensed under cc by nd 4 0"],
    "reserved": ["all rights reserved"],
    "spdx_mit": ["spdx license identifier mit"],
    "spdx_apache2": ["spdx license identifier apache 2 0"],
    "spdx_bsd2": ["spdx license identifier bsd 2 clause"],
    "spdx_bsd3": ["spdx license identifier bsd 3 clause"],
    "spdx_isc": ["spdx license identifier isc"],
    "spdx_gpl2": ["spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0"],
    "spdx_gpl2_later": ["spdx license identifier gpl 2 0 or later"],
    "spdx_gpl3": ["spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"],
    "spdx_gpl3_later": ["spdx license identifier gpl 3 0 or later"],
    "spdx_mpl2": ["spdx license identifier mpl 2 0"],
    "spdx_epl2": ["spdx license identifier epl 2 0"],
    "spdx_bsl": ["spdx license identifier bsl 1 0"],
    "spdx_unlicense": ["spdx license identifier unlicense"],
    "spdx_zlib": ["spdx license identifier zlib"],
    "spdx_cc0": ["spdx license identifier cc0 1 0"],
}
#: (licence, identifiers in order; a question mark makes one optional), tried from first to last; fixed values.
RULES = [
    ("MIT", "mit_name? mit_grant mit_notice? as_is? liability?"),
    ("BSL-1.0", "bsl_name? bsl_grant as_is?"),
    ("ISC", "isc_grant as_is?"),
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_names as_is?"),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary as_is?"),
    ("Apache-2.0", "apache2_name apache2_comply apache2_copy? apache2_disclaim? apache2_see?"),
    ("GPL-3.0-or-later", "gpl_free gpl_hope? gpl_copy?"),
    ("GPL-2.0-or-later", "gpl2_free gpl_hope? gpl_copy?"),
    ("GPL-2.0-only", "gpl2_only gpl_hope? gpl_copy?"),
    ("Unlicense", "unlicense unlicense_any? as_is?"),
    ("Zlib", "zlib_as_is zlib_grant"),
    ("MIT", "mit_name"), ("MIT", "spdx_mit"), ("Apache-2.0", "apache2_name"), ("Apache-2.0", "spdx_apache2"),
    ("GPL-2.0-only", "gpl2_name"), ("GPL-3.0-only", "gpl3_name"), ("LGPL-3.0-only", "lgpl3_name"), ("AGPL-3.0-only", "agpl3_name"), ("MPL-2.0", "mpl2_name"),
    ("EPL-2.0", "epl2_name"), ("EPL-1.0", "epl1_name"), ("BSL-1.0", "bsl_name"), ("WTFPL", "wtfpl"), ("LGPL-2.1-only", "lgpl21_name"),
    ("BSD-2-Clause", "bsd2_name"), ("BSD-3-Clause", "bsd3_name"), ("ISC", "isc_name"),
    ("BSD-2-Clause", "spdx_bsd2"), ("BSD-3-Clause", "spdx_bsd3"), ("ISC", "spdx_isc"), ("GPL-2.0-only", "spdx_gpl2"), ("GPL-2.0-or-later", "spdx_gpl2_later"), ("GPL-3.0-only", "spdx_gpl3"),
    ("GPL-3.0-or-later", "spdx_gpl3_later"), ("MPL-2.0", "spdx_mpl2"), ("EPL-2.0", "spdx_epl2"), ("BSL-1.0", "spdx_bsl"), ("Unlicense", "spdx_unlicense"), ("Zlib", "spdx_zlib"), ("CC0-1.0", "spdx_cc0"),
    ("CC-BY-NC-ND-4.0", "cc_by_nc_nd"), ("CC0-1.0", "cc0"), ("CC-BY-4.0", "cc_by"), ("CC-BY-SA-4.0", "cc_by_sa"), ("CC-BY-NC-4.0", "cc_by_nc"), ("CC-BY-NC-SA-4.0", "cc_by_nc_sa"), ("CC-BY-ND-4.0", "cc_by_nd"),
    ("Proprietary", "reserved"),
]
#: Words that tell little of a text.
COMMON = frozenset("the and for this that with you may are under above other without whom from all any terms".split())
END, LINE = r"[.!?]+(?=\s|$)", r"\r\n|[\r\n]"


def hint(sentences: dict) -> str:
    """A pattern that every text with one of the sentences matches: few words, of which each sentence has one."""
    left = [set(s.split()) for own in sentences.values() for s in own if s]
    words: list[str] = []
    while left:
        telling = [w - COMMON or w for w in left]
        held = Counter(x for w in telling for x in w)
        words.append(min(held, key=lambda x: (-held[x], -len(x), x)))
        left = [w for w in left if words[-1] not in w]
    return "(?iu)" + ("|".join(words) or "(?!)")


HINT = hint(SENTENCES)


def pattern(rule: str) -> str:
    """The rule over a sequence in which each identifier stands between two commas of its own."""
    return "".join(f"(,{x[:-1]},)?" if x.endswith("?") else f",{x}," for x in rule.split())


def scan(docs: DataFrame, text: str = "text", sentences: dict | None = None, rules: list | None = None) -> DataFrame:
    """``docs``, all columns, with ``sentence_ids`` and ``licences`` (comma-joined) and ``n_sentences`` (known ones)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = [(s, i) for i, own in sentences.items() for s in own]
    table = F.map_from_arrays(F.array(*[F.lit(s) for s, _ in known]), F.array(*[F.lit(i) for _, i in known]))
    parts, ids, left = made = [fresh(docs, f"_licence_{x}") for x in ("parts", "ids", "left")]
    # sentence ends and line ends are marked apart, what lies between is normalised, and line ends at blank lines or sentence ends become those
    marked = F.lower(F.regexp_replace(F.regexp_replace(text, END, "\u0001"), LINE, "\u0002"))
    marked = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9\u0001\u0002]+", " "), " ?([\u0001\u0002]) ?", "$1")
    marked = F.regexp_replace(marked, "\u0002*\u0001[\u0001\u0002]*|\u0002{2,}", "\u0001")
    one = "|".join(s.replace(" ", "[ \u0002]") for s, _ in sorted(known, key=lambda k: (-len(k[0]), k[0])))
    # possible only from one end to another
    hit = F.regexp_extract_all(F.trim(marked), F.lit(f"(?<![^\u0001\u0002])(?:{one})(?![^\u0001\u0002])"), F.lit(0))
    df = docs.withColumn(parts, F.when(F.col(text).rlike(HINT if sentences is SENTENCES else hint(sentences)), hit))
    df = df.withColumn(ids, F.coalesce(F.transform(parts, lambda s: table[F.translate(s, "\u0002", " ")]), F.expr("cast(array() as array<string>)")))
    seed = F.when(F.size(ids) > 0, F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(",")))
    df = df.withColumn(left, seed)
    plan = F.expr("array(" + ",".join(f"named_struct('n','{n}','p','{pattern(r)}')" for n, r in rules) + ")")

    def step(acc, rule):
        there = F.rlike(acc["left"], rule["p"])
        new = there & ~F.array_contains(acc["names"], rule["n"])
        return F.struct(F.when(there, F.regexp_replace(acc["left"], rule["p"], F.lit(";"))).otherwise(acc["left"]).alias("left"), F.when(new, F.array_append(acc["names"], rule["n"])).otherwise(acc["names"]).alias("names"))

    start = F.struct(F.col(left).alias("left"), F.expr("cast(array() as array<string>)").alias("names"))
    names = F.when(F.col(left).isNotNull(), F.aggregate(plan, start, step, lambda acc: F.array_join(acc["names"], ","))).otherwise(F.lit(""))
    return df.withColumns({"n_sentences": F.size(ids).cast("long"), "sentence_ids": F.array_join(ids, ","), "licences": names}).drop(*made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the licences of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licences")


def sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for i, own in SENTENCES.items() for s in own)
    out = f"""
WITH k(s, id) AS (VALUES {known}),
m0 AS (SELECT doc_id, lower(regexp_replace(regexp_replace(coalesce(text, ''), '[.!?]+([ \\t\\n\\x0B\\f\\r]|$)', chr(1), 'g'), '\\r\\n|[\\r\\n]', chr(2), 'g')) AS m FROM documents),
m1 AS (SELECT doc_id, regexp_replace(regexp_replace(m, '[^a-z0-9' || chr(1) || chr(2) || ']+', ' ', 'g'), ' ?([' || chr(1) || chr(2) || ']) ?', '\\1', 'g') AS m FROM m0),
m2 AS (SELECT doc_id, trim(regexp_replace(m, chr(2) || '*' || chr(1) || '[' || chr(1) || chr(2) || ']*|' || chr(2) || '{{2,}}', chr(1), 'g')) AS m FROM m1),
p AS (SELECT doc_id, unnest(string_split(m, chr(1))) AS part, generate_subscripts(string_split(m, chr(1)), 1) AS n FROM m2),
l AS (SELECT doc_id, n, string_split(part, chr(2)) AS lines FROM p WHERE part <> ''),
x AS (SELECT doc_id, n, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
y AS (SELECT doc_id, n, i, unnest(range(i, least(len(lines), i + {max(len(s.split()) for own in SENTENCES.values() for s in own)}) + 1)) AS j, lines FROM x),
z AS (SELECT doc_id, n, i, max(j) AS j, arg_max(id, j) AS id FROM y JOIN k ON array_to_string(lines[i:j], ' ') = s GROUP BY doc_id, n, i),
g AS (SELECT doc_id, n, list({{'i': i, 'j': j, 'id': id}} ORDER BY i) AS items FROM z GROUP BY doc_id, n),
h AS (SELECT doc_id, n, unnest(list_reduce(list_transform(items, lambda a: [a]), lambda acc, b: CASE WHEN b[1].i > acc[len(acc)].j THEN list_concat(acc, b) ELSE acc END)) AS o FROM g),
u AS (SELECT doc_id, n, o.i AS i, o.id AS id FROM h),
t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY n, i) AS ids, ',' || string_agg(id, ',,' ORDER BY n, i) || ',' AS seq FROM u GROUP BY doc_id),
r0 AS (SELECT doc_id, n, ids, seq, []::VARCHAR[] AS names FROM t)"""
    for i, (name, rule) in enumerate(RULES):
        p = pattern(rule)
        out += f",\nr{i + 1} AS (SELECT doc_id, n, ids, regexp_replace(seq, '{p}', ';', 'g') AS seq, CASE WHEN regexp_matches(seq, '{p}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM r{i})"
    return out + f"\nSELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences FROM documents d LEFT JOIN r{len(RULES)} USING (doc_id)"


SQL = sql()
