"""Licence scan by sentence rules.

A text is cut into sentences, each normalised to its ASCII letters and digits.  A sentence that equals a known
licence sentence gets that sentence's identifier, a copyright line gets one by its form, and the sequence
of identifiers of a document is matched against rules, which are ordered sequences of identifiers.  All of
it happens in the row: the tables below are constants, and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import table, whole

# Sentences of public licences, by identifier.
SENTENCES = {
    "Apache2Short": "Licensed under the Apache License, Version 2.0.",
    "Apache2May": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache2Head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Apache2NotUse": "you may not use this file except in compliance with the License.",
    "Apache2Copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache2Unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache2See": "See the License for the specific language governing permissions and limitations under the License.",
    "MITShort": "Released under the MIT License.",
    "MITLicensed": "Licensed under the MIT License.",
    "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MITNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MITAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MITLiable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISCAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSDGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSDSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSDNames": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDAsIs": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "GPL3Short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL2Later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL3Later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPLFree": "This program is free software:",
    "GPL3Terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2Terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "GPL2Either": "either version 2 of the License, or (at your option) any later version.",
    "GPLHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GPLEven": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPLSee": "See the GNU General Public License for more details.",
    "MPL2Subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL2Start": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "MPL2Number": "2.0.",
    "CCBYNC4": "Licensed under CC BY-NC 4.0.",
    "CCBY4": "Licensed under CC BY 4.0.",
    "CCBYSA4": "Licensed under CC BY-SA 4.0.",
    "CC0": "Released under CC0 1.0.",
    "PublicDomain": "This is free and unencumbered software released into the public domain.",
    "AllRights": "All rights reserved.",
}
# Rules, from the longest; the identifiers must follow one another among a document's identifiers.
RULES = (
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs")),
    ("Apache-2.0", ("Apache2Head", "Apache2NotUse", "Apache2Copy", "Apache2Unless", "Apache2See")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    ("GPL-2.0-or-later", ("GPLFree", "GPL2Terms", "GPL2Either")),
    ("GPL-3.0-or-later", ("GPLFree", "GPL3Terms")),
    ("MPL-2.0", ("MPL2Start", "MPL2Number")),
    ("ISC", ("ISCGrant", "ISCAsIs")),
    ("Apache-2.0", ("Apache2Short",)), ("MIT", ("MITShort",)), ("MIT", ("MITLicensed",)),
    ("GPL-3.0-only", ("GPL3Short",)), ("CC-BY-NC-4.0", ("CCBYNC4",)), ("CC-BY-4.0", ("CCBY4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)), ("CC0-1.0", ("CC0",)), ("Unlicense", ("PublicDomain",)),
    ("Copyrighted", ("Copyright", "AllRights")),
)
COPYRIGHT = r"^copyright (c )?[0-9]{4}( |$)"
ABOUT = r"(^| )(licen[cs]e[ds]?|copyright)( |$)"
# A sentence ends at a mark followed by white space, or at an empty line; \x01 stands for the end.
ENDS = r"([.!?;:])[ \t\n\r\f\x0B]+|\n[ \t\r]*\n"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES,
         rules=RULES) -> DataFrame:
    """One row per document: id, n_sentences, identifiers, licences, n_unknown.

    ``identifiers`` are the known sentences in their order, joined by spaces; ``licences`` the names of the
    rules that match, sorted, without repeats, joined by commas; ``n_unknown`` counts sentences that speak of a
    licence or copyright and are not known.  A null or empty text has no sentences.  Repeated rows give a
    row each, an empty table none.
    """
    known = {}
    for name, sentence in sentences.items():
        known.setdefault(normal(sentence), name)
    marked = F.regexp_replace(F.lower(whole(text_col)), ENDS, "$1\x01")
    flat = F.regexp_replace(marked, "[^a-z0-9\x01]+", " ")
    cut = docs.select(F.col(id_col).alias("id"), F.split(flat, " ?\x01 ?").alias("s"))
    cut = cut.select("id", F.filter(F.transform("s", lambda s: F.trim(s)), lambda s: s != "").alias("s"))
    hit = F.filter("s", lambda s: s.isin(list(known)) | s.rlike(COPYRIGHT))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ids = F.transform("hit", lambda s: F.coalesce(F.try_element_at(names, s), F.lit("Copyright")))
    found = cut.select("id", "s", hit.alias("hit")).select("id", F.size("s").cast("long").alias("n_sentences"), F.size(
        F.filter("s", lambda s: s.rlike(ABOUT) & ~(s.isin(list(known)) | s.rlike(COPYRIGHT)))).cast("long").alias("n_unknown"),
        F.array_join(ids, " ").alias("identifiers"))
    line = F.concat(F.lit(" "), F.col("identifiers"), F.lit(" "))
    fits = F.array(*[F.when(line.contains(" " + " ".join(r) + " "), F.lit(name)) for name, r in rules])
    return found.select(F.col("id").alias(id_col), "n_sentences", "identifiers",
                        F.array_join(F.array_sort(F.array_distinct(F.array_compact(fits))), ",").alias("licences"), "n_unknown")


def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    first = {}
    for name, sentence in SENTENCES.items():
        first.setdefault(normal(sentence), name)
    known = ", ".join(f"({quoted(s)}, {quoted(n)})" for s, n in first.items())
    rules = ", ".join(f"({quoted(n)}, {quoted(' ' + ' '.join(r) + ' ')})" for n, r in RULES)
    return f"""
with known(sentence, name) as (values {known}),
rules(licence, form) as (values {rules}),
cut as (
  select doc_id, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')),
           '([.!?;:])[ \\t\\n\\r\\f\\x0B]+|\\n[ \\t\\r]*\\n', '\\1' || chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)) as s
  from documents),
pieces as (select doc_id, place, trim(s[place]) as sentence
           from (select doc_id, s, unnest(range(1, len(s) + 1)) as place from cut)),
judged as (
  select doc_id, place, coalesce(name, case when regexp_matches(sentence, '{COPYRIGHT}') then 'Copyright' end) as name,
         regexp_matches(sentence, '{ABOUT}') as about
  from pieces left join known using (sentence) where sentence <> ''),
lines as (
  select doc_id, count(*) as n_sentences, count(*) filter (where about and name is null) as n_unknown,
         coalesce(string_agg(name, ' ' order by place) filter (where name is not null), '') as identifiers
  from judged group by doc_id),
found as (select doc_id, string_agg(distinct licence, ',' order by licence) as licences
          from lines join rules on contains(' ' || identifiers || ' ', form) group by doc_id)
select doc_id, coalesce(n_sentences, 0) as n_sentences, coalesce(identifiers, '') as identifiers,
       coalesce(licences, '') as licences, coalesce(n_unknown, 0) as n_unknown
from documents left join lines using (doc_id) left join found using (doc_id)
"""


SQL = _sql()
