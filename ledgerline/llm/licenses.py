"""Licence scan by sentence rules, in DataFrame operations only.

A text is cut into sentences, each is normalised, and those that are known licence sentences become
their identifiers; every run of other sentences becomes one gap. A rule is an ordered sequence of
identifiers that follow each other without a gap; where rules overlap, the earliest, then the one
listed first (longer ones come first) counts. No text is exploded or shuffled.

Normalising: characters other than ASCII letters, digits, '.' and line ends become one space,
letters lower case, sentences end at '.' before a space, outer spaces and dots go. Each
paragraph (between blank lines) is read twice, with line ends as ends of sentences and, for wrapped
notices, as one run; the reading with more known sentences counts (on a tie the first), and what the
paragraphs give is put together before rules are looked for.

Before the lookup a few sentences with free parts are brought to one form: who is named in the clauses on
endorsement and warranty of BSD texts or in an advertising clause, the program that a GNU notice names, the
verb of "licensed under", a tail like "see the LICENSE file". The period of an abbreviation ("Inc.", "v.")
that a comma, small letter or digit follows ends no sentence. A binary clause that another, unknown clause
follows is BsdBinaryMore: such a list is no two-clause text.

A sentence "SPDX-License-Identifier: EXPRESSION" becomes an identifier for each licence of the
expression (of any table entry, in the forms -only, -or-later, + and bare for GNU licences, exceptions
aside) and a gap for each other.

A sentence that only numbers a list item ("1", "a", "iv") is no gap between two identifiers, and a line
that begins with one begins a sentence; it still counts in n_sentences.

Defined results: a null or empty text has no sentence and no licence; repeated rows each get their
result; a known sentence that no rule uses counts as unresolved; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "MitShort": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License.", "Licensed under MIT."],
    "MitGrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MitAsIs": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "MitLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ApacheLicensed": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "ApacheShort": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "This project is licensed under the Apache License, Version 2.0.", "Licensed under Apache 2.0.", "Licensed under the Apache-2.0 License."],
    "ApacheFull": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "ApacheComply": ["you may not use this file except in compliance with the License."],
    "ApacheCopy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "ApacheUrl": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "ApacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License."],
    "Gpl3Short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3.", "Licensed under the GNU General Public License v3.0."],
    "Gpl2Short": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2."],
    "Lgpl3Short": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "Gpl3Plus": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Gpl2Plus": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GnuHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "GnuSee": ["See the GNU General Public License for more details."],
    "GnuReceived": ["You should have received a copy of the GNU General Public License along with this program."],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BsdAdvert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."],
    "Bsd2Short": ["Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "Bsd3Short": ["Licensed under the BSD 3-Clause License.", "Licensed under the New BSD License."],
    "IscShort": ["Licensed under the ISC License."],
    "MplShort": ["Licensed under the Mozilla Public License 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "BsdAsIs": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MplForm": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CcByNc4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CcBy4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CcBySa4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Cc0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Agpl3Plus": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AgplSee": ["See the GNU Affero General Public License for more details."],
    "AgplReceived": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "Lgpl21Plus": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "Lgpl3Plus": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LgplSee": ["See the GNU Lesser General Public License for more details."],
    "LgplReceived": ["You should have received a copy of the GNU Lesser General Public License along with this library."],
    "Gpl2Only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "Boost": ["Distributed under the Boost Software License, Version 1.0."],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty."],
    "ZlibLiable": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Epl2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}
# Ordered rules, longer ones first, with the licence that each shows.
RULES = [
    ("MitGrant MitNotice MitAsIs MitLiable", "MIT"),
    ("MitGrant MitNotice MitAsIs", "MIT"),
    ("MitGrant MitNotice", "MIT"),
    ("ApacheFull ApacheCopy ApacheUrl ApacheAsIs ApacheSee", "Apache-2.0"),
    ("ApacheFull ApacheCopy ApacheAsIs ApacheSee", "Apache-2.0"),
    ("ApacheLicensed ApacheComply ApacheCopy ApacheUrl ApacheAsIs ApacheSee", "Apache-2.0"),
    ("ApacheLicensed ApacheComply", "Apache-2.0"),
    ("ApacheFull", "Apache-2.0"),
    ("Gpl3Plus GnuHope GnuSee GnuReceived", "GPL-3.0-or-later"),
    ("Gpl3Plus GnuHope GnuSee", "GPL-3.0-or-later"),
    ("Gpl3Plus", "GPL-3.0-or-later"),
    ("Gpl2Plus GnuHope GnuSee GnuReceived", "GPL-2.0-or-later"),
    ("Gpl2Plus GnuHope GnuSee", "GPL-2.0-or-later"),
    ("Gpl2Plus", "GPL-2.0-or-later"),
    ("BsdGrant BsdSource BsdBinary BsdAdvert BsdEndorse BsdAsIs", "BSD-4-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdAdvert BsdEndorse", "BSD-4-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdAsIs", "BSD-2-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary", "BSD-2-Clause"),
    ("Bsd3Short", "BSD-3-Clause"),
    ("Bsd2Short", "BSD-2-Clause"),
    ("IscGrant", "ISC"),
    ("IscShort", "ISC"),
    ("MplForm", "MPL-2.0"),
    ("MplShort", "MPL-2.0"),
    ("MitShort", "MIT"),
    ("ApacheShort", "Apache-2.0"),
    ("Gpl3Short", "GPL-3.0-only"),
    ("Gpl2Short", "GPL-2.0-only"),
    ("Lgpl3Short", "LGPL-3.0-only"),
    ("CcByNc4", "CC-BY-NC-4.0"),
    ("CcBySa4", "CC-BY-SA-4.0"),
    ("CcBy4", "CC-BY-4.0"),
    ("Cc0", "CC0-1.0"),
    ("Unlicense", "Unlicense"),
    ("Agpl3Plus GnuHope AgplSee AgplReceived", "AGPL-3.0-or-later"),
    ("Agpl3Plus GnuHope AgplSee", "AGPL-3.0-or-later"),
    ("Agpl3Plus", "AGPL-3.0-or-later"),
    ("Lgpl21Plus GnuHope LgplSee LgplReceived", "LGPL-2.1-or-later"),
    ("Lgpl21Plus GnuHope LgplSee", "LGPL-2.1-or-later"),
    ("Lgpl21Plus", "LGPL-2.1-or-later"),
    ("Lgpl3Plus GnuHope LgplSee", "LGPL-3.0-or-later"),
    ("Lgpl3Plus", "LGPL-3.0-or-later"),
    ("Gpl2Only GnuHope GnuSee", "GPL-2.0-only"),
    ("Gpl2Only", "GPL-2.0-only"),
    ("Boost", "BSL-1.0"),
    ("ZlibAsIs ZlibLiable ZlibGrant", "Zlib"),
    ("Epl2", "EPL-2.0"),
]
# Names of SPDX's licence list, and of those GNU licences that have -only and -or-later forms.
SPDX = (
    "MIT MIT-0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 Artistic-2.0 PostgreSQL "
    "Python-2.0 PSF-2.0 OFL-1.1 EUPL-1.2 NCSA Ruby WTFPL"
).split()
GNU = "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-1.0 AGPL-3.0".split()
_ENDORSE = "be used to endorse or promote products derived from this software without (?:specific )?prior written permission(?: of .{1,120})?$"
_ENDORSED = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: Normalised sentences with a free part, and their one form (\\1: what is kept). Every one of them holds one of TRIGGERS.
FORMS = [
    ("^(?:[0-9]{1,2}|[a-z]|[ivx]{1,4}) (redistributions (?:of|in) |neither the name|the name|all advertising )", r"\1"),
    (f"^neither the names? .{{1,200}} may {_ENDORSE}", _ENDORSED),
    (f"^the names? .{{1,200}} may not {_ENDORSE}", _ENDORSED),
    ("^(all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by) .{1,200}$", r"\1 the organization"),
    ("^this software is provided by .{1,200} as is and any express or implied warranties (.{1,400}) are disclaimed$", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties \1 are disclaimed"),
    ("^.{1,100}? is free software (you can redistribute it and or modify it under the terms of the gnu )", r"this program is free software \1"),
    ("^.{1,100}? is distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful"),
    ("^(you should have received a copy of the gnu (?:lesser |affero |library )?general public license) along with .{1,100}?(?: if not (?:see|write) .*)?$", r"\1 along with this program"),
    ("^(.{0,60}(?:licensed|released|distributed|available) under .{1,100}?) see (?:the )?.{0,40}(?:licen[sc]e|copying|notice).{0,80}$", r"\1"),
    ("^(?:this [a-z]{1,20} is |(?:the )?(?:code|source|software|project) is )?(?:licensed|released|distributed|(?:made )?available) under (?:the terms of )?(?:the )?", "licensed under the "),
]
TRIGGERS = ["redistributions ", "endorse or promote", "advertising materials", "are disclaimed", "is free software", "in the hope", "should have received", " under "]
#: Abbreviations whose period, if it ends no sentence, goes before texts are normalised.
ABBREVIATIONS = [
    (r"\b(Inc|Ltd|Corp|Co|LLC|GmbH|Univ|e\.g|i\.e|etc|vs)\.([,;:)]|[ \t\r]*\n?[ \t]*[a-z0-9])", r"\1\2"),
    (r"\b(v|V|No)\.([ \t]*[0-9])", r"\1\2"),
]


def canonical(sentence: str) -> str:
    for pattern, form in FORMS:
        sentence = re.sub(pattern, form, sentence)
    return sentence


def sentences_of(text: str | None) -> list[str]:
    """The normalised sentences of a text by its lines, as the plan below has them."""
    text = text or ""
    for pattern, kept in ABBREVIATIONS:
        text = re.sub(pattern, kept, text)
    flat = re.sub(r"[^A-Za-z0-9.\n]+", " ", text).lower()
    parts = re.sub(r"\. ", "\n", flat).split("\n")
    return [canonical(s) for s in (p.strip(" .") for p in parts) if s]


def _known() -> dict[str, str]:
    known: dict[str, str] = {}
    for name, texts in SENTENCES.items():
        for text in texts:
            known.setdefault(sentences_of(text)[0], name)
    return known


def _tags() -> dict[str, str]:
    """Licences by what normalising, and writing "or later" as one word, leaves of their names."""
    forms = {x: x for x in SPDX}
    for x in GNU:
        forms |= {x: f"{x}-only", f"{x}-only": f"{x}-only", f"{x}-orlater": f"{x}-or-later"}
    return {sentences_of(k)[0]: v for k, v in forms.items()}


KNOWN, TAGS = _known(), _tags()
TAG = "spdx license identifier "
_name = lambda licence: "Spdx" + re.sub("[^A-Za-z0-9]", "", licence)
MARK = {"<" + "><".join(rule.split()) + ">": licence for rule, licence in [*RULES, *((_name(x), x) for x in dict.fromkeys(TAGS.values()))]}
PATTERN = "|".join(MARK)
#: A sentence that only numbers what follows: digits, a letter or a roman numeral.
ENUMERATOR = "(?:[0-9]{1,3}|[a-z]|[ivxlc]{1,6})"
#: A binary clause and the sign of a further unknown one: a number before it, or the disclaimer behind it.
MORE = "<BsdBinary>(#+-|[-#]*-[-#]*<BsdAsIs>)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, rule_matches, licenses, unresolved) per row of ``docs``.

    sentence_ids: the identifiers in order, '-' for each gap; licenses: distinct, in order of place.
    """
    java = lambda form: form.replace("\\", "$")
    whole = F.regexp_replace(text_or_empty(text_col), r"(SPDX-License-Identifier:[^\n]*?[0-9])\+", "$1-or-later")
    for pattern, kept in ABBREVIATIONS:
        whole = F.regexp_replace(whole, pattern, java(kept))
    flat = F.lower(F.regexp_replace(whole, r"[^A-Za-z0-9.\n]+", " "))
    tags = F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (k, f"<{_name(v)}>")])
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    licence = F.create_map(*[F.lit(x) for pair in MARK.items() for x in pair])
    count = lambda c: F.length(F.regexp_replace(c, "[^<]+", "")).cast("long")

    def tagged(sentence: Column) -> Column:
        parts = F.split(F.regexp_replace(F.substring(sentence, len(TAG) + 1, 1 << 30), " or later", " orlater"), " (?:or|and) ")
        return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(tags, F.regexp_replace(x, " with .*", "")), F.lit("-"))), "")

    def one_form(sentence: Column) -> Column:
        held, out = F.lit(False), sentence
        for word in TRIGGERS:
            held |= (F.concat(F.lit(" "), sentence) if word.startswith(" ") else sentence).contains(word)
        for pattern, form in FORMS:
            out = F.regexp_replace(out, pattern, java(form))
        return F.when(held, out).otherwise(sentence)

    def reading(text: Column) -> Column:
        """An identifier or a gap for each sentence."""
        parts = F.split(F.regexp_replace(text, r"\. ", "\n"), "\n")
        sentences = F.transform(F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" ."))), lambda s: s != ""), one_form)
        return F.transform(sentences, lambda s: F.when(s.isin(*KNOWN), F.concat(F.lit("<"), F.element_at(names, s), F.lit(">"))).when(s.startswith(TAG), tagged(s)).when(s.rlike(f"^{ENUMERATOR}$"), "#").otherwise(F.lit("-")))

    def joined(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, rf"\n(?= ?{ENUMERATOR}\. )", ". "), r"\n", " "), " +", " ")

    known = lambda r: F.size(F.filter(r, lambda s: s.startswith("<")))
    readings = F.transform(F.split("flat", r"\n(?: ?\n)+"), lambda t: F.array(reading(t), reading(joined(t))))
    chosen = F.flatten(F.transform(readings, lambda r: F.when(known(r[1]) > known(r[0]), r[1]).otherwise(r[0])))
    cut = docs.select(F.col(id_col).alias("doc_id"), flat.alias("flat")).select("doc_id", chosen.alias("ids"))
    seq = F.regexp_replace(F.array_join("ids", ""), MORE, "<BsdBinaryMore>$1")
    seq = F.regexp_replace(F.regexp_replace(seq, "(?<=>)#+(?=<)", ""), "[-#]+", "-")
    hits = cut.select("doc_id", F.size("ids").cast("long").alias("n"), seq.alias("seq")).select("*", F.regexp_extract_all("seq", F.lit(f"({PATTERN})"), F.lit(1)).alias("hits"))
    return hits.select(
        "doc_id",
        F.col("n").alias("n_sentences"),
        F.when(F.col("seq") == "-", "").otherwise(F.col("seq")).alias("sentence_ids"),
        F.size("hits").cast("long").alias("rule_matches"),
        F.array_join(F.array_distinct(F.transform("hits", lambda m: F.element_at(licence, m))), ",").alias("licenses"),
        (count(F.col("seq")) - count(F.array_join("hits", ""))).alias("unresolved"),
    )


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same over the whole table in DuckDB."""
    table = lambda pairs: "MAP {" + ", ".join(f"{_sql_text(k)}: {_sql_text(v)}" for k, v in pairs) + "}"
    known, tags, licence = table((k, f"<{v}>") for k, v in KNOWN.items()), table((k, f"<{_name(v)}>") for k, v in TAGS.items()), table(MARK.items())
    tagged = f"array_to_string(list_transform(string_split_regex(replace(substr(s, {len(TAG) + 1}), ' or later', ' orlater'), ' (?:or|and) '), lambda x: coalesce({tags}[regexp_replace(x, ' with .*', '')], '-')), '')"
    one_form, whole = "trim(s, ' .')", "coalesce(text, '')"
    for pattern, form in FORMS:
        one_form = f"regexp_replace({one_form}, {_sql_text(pattern)}, {_sql_text(form)})"
    whole = f"regexp_replace({whole}, '(SPDX-License-Identifier:[^\\n]*?[0-9])\\+', '\\1-or-later', 'g')"
    for pattern, kept in ABBREVIATIONS:
        whole = f"regexp_replace({whole}, {_sql_text(pattern)}, {_sql_text(kept)}, 'g')"
    sign = f"coalesce({known}[s], case when starts_with(s, '{TAG}') then {tagged} when regexp_full_match(s, '{ENUMERATOR}') then '#' else '-' end)"
    ids = lambda t: f"list_transform(list_filter(list_transform(string_split(regexp_replace({t}, '\\. ', chr(10), 'g'), chr(10)), lambda s: {one_form}), lambda s: s <> ''), lambda s: {sign})"
    joined = f"regexp_replace(replace(regexp_replace(p, '\\n( ?{ENUMERATOR}\\. )', '. \\1', 'g'), chr(10), ' '), ' +', ' ', 'g')"
    hits = lambda r: f"len(list_filter({r}, lambda s: starts_with(s, '<')))"
    return f"""
with whole as (select doc_id, {whole} as w from documents),
flat as (select doc_id, lower(regexp_replace(w, '[^A-Za-z0-9.\\n]+', ' ', 'g')) as t from whole),
readings as (select doc_id, list_transform(string_split_regex(t, '\\n(?: ?\\n)+'), lambda p: [{ids('p')}, {ids(joined)}]) as r from flat),
cut as (select doc_id, flatten(list_transform(r, lambda x: case when {hits('x[2]')} > {hits('x[1]')} then x[2] else x[1] end)) as ids from readings),
seqs as (select doc_id, len(ids) as n, regexp_replace(regexp_replace(regexp_replace(array_to_string(ids, ''), {_sql_text(MORE)}, '<BsdBinaryMore>\\1', 'g'), '>#+<', '><', 'g'), '[-#]+', '-', 'g') as seq from cut),
hits as (select *, regexp_extract_all(seq, {_sql_text(PATTERN)}) as hits from seqs)
select doc_id, cast(n as bigint) as n_sentences, case when seq = '-' then '' else seq end as sentence_ids, cast(len(hits) as bigint) as rule_matches,
  coalesce(array_to_string(list_transform(list_filter(list_zip(hits, range(len(hits))), lambda x: list_position(list_transform(hits, lambda h: {licence}[h]), {licence}[x[1]]) = x[2] + 1), lambda x: {licence}[x[1]]), ','), '') as licenses,
  cast(length(regexp_replace(seq, '[^<]+', '', 'g')) - length(regexp_replace(array_to_string(hits, ''), '[^<]+', '', 'g')) as bigint) as unresolved
from hits"""
