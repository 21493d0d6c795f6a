"""Licence recognition by sentences and rules.

A text is cut into sentences and each is normalised (lower case, marks and white space
as single blanks).  Full stops and blank lines end a sentence.  Line ends, colons and
semicolons may end one or stand inside it: licences are wrapped anywhere, and stand in
comments, whose leaders are marks like any other.  Known sentences map to identifiers:
whole ones by their hash, those with a slot (a holder's name, a year), names of licences
and sentences known by their opening by pattern.  The sequence of identifiers of a text
is then matched against ordered rules.  A rule that matches takes its identifiers
away, so a more specific rule that stands earlier keeps a later one from claiming the
same sentences.

Only DataFrame functions are used, without a shuffle: sentences are matched inside
the row.  Every known sentence holds one of ``ANCHORS``, so texts and sentences without
one are passed over; a test holds the table to that.

Defined cases: null, empty and licence-free texts give empty lists; a known
sentence that no rule claims is reported as ``unmatched``; repeated sentences
are each listed; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of which every known sentence has one, as a pattern of the lower-case text.
ANCHORS = "licen|permission|copyright|distribut|warrant|liab|spdx|reserved|endorse|creative|gpl|apache|bsd|mozilla|public|cc0|cc[^a-z0-9]+by"

# Sentences of licences as they are published, by identifier; {} stands for any words.
SENTENCES = [
    ("MIT_GRANT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT_NOTICE", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("MIT_WARRANTY", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("MIT_LIABILITY", "IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC_GRANT", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC_WARRANTY", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("ISC_LIABILITY", "IN NO EVENT SHALL {} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD_GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD_ENDORSE", "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD_WARRANTY", "THIS SOFTWARE IS PROVIDED BY {} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD_LIABILITY", "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ZLIB_WARRANTY", "This software is provided 'as-is', without any express or implied warranty."),
    ("ZLIB_LIABILITY", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("ZLIB_GRANT", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ZLIB_NOTICE", "This notice may not be removed or altered from any source distribution."),
    ("BSL_GRANT", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("BSL_TITLE", "Boost Software License - Version 1.0 - August 17th, 2003"),
    # two licences at once are two identifiers
    ("NAMED_Apache-2.0><NAMED_MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("NAMED_Apache-2.0><NAMED_MIT", "Dual licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("NAMED_Apache-2.0><NAMED_MIT", "This project is licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("CC_BY_TITLE", "This is an Open Access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited."),
    ("CC_BY_TITLE", "This is an Open Access article distributed under the terms of the Creative Commons Attribution License {}, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited."),
    ("UNLICENSE", "This is free and unencumbered software released into the public domain."),
    ("APACHE2_MAY", "you may not use this file except in compliance with the License."),
    ("APACHE2_MAY", "you may not use this work except in compliance with the License."),
    ("APACHE2_COPY", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2_COPY", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2_UNLESS", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("APACHE2_SEE", "See the License for the specific language governing permissions and limitations under the License."),
    ("APACHE2_TITLE", "Apache License Version 2.0, January 2004"),
    ("APACHE2_TITLE", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL2_TITLE", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL3_TITLE", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL21_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL3_TITLE", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL3_TITLE", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL_VERBATIM", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL2_LATER", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL3_LATER", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL21_LATER", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL3_LATER", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL3_LATER", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL_WARRANTY", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL_WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL_SEE", "See the GNU General Public License for more details."),
    ("GPL_SEE", "See the GNU Lesser General Public License for more details."),
    ("GPL_SEE", "See the GNU Affero General Public License for more details."),
    ("GPL_COPY", "You should have received a copy of the GNU General Public License along with this program."),
    ("GPL_COPY", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("GPL_COPY", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("MPL2_TITLE", "Mozilla Public License Version 2.0"),
    ("MPL2_SUBJECT", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2_COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL2_COPY", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL2_TITLE", "Eclipse Public License - v 2.0"),
    ("CC0_TITLE", "CC0 1.0 Universal"),
    ("CC0_TITLE", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC_BY_TITLE", "Creative Commons Attribution 4.0 International Public License"),
    ("CC_BY_SA_TITLE", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC_BY_NC_TITLE", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("PUBLIC_DOMAIN", "{} dedicated to the public domain."),
    ("PUBLIC_DOMAIN", "{} released into the public domain."),
    ("RESERVED", "All rights reserved."),
    ("RESERVED", "{} all rights reserved."),
]

# Sentences of changed or shortened licences are known by how they begin.
OPENINGS = [
    ("MIT_GRANT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included in all copies"),
    ("MIT_WARRANTY", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'),
    ("MIT_LIABILITY", "In no event shall the authors or copyright holders be liable"),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("APACHE2_UNLESS", "Unless required by applicable law or agreed to in writing, software distributed under the License"),
    ("BSD_GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice"),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice"),
    ("BSD_ENDORSE", "Neither the name of {} endorse or promote"),
    ("BSD_WARRANTY", "This software is provided by {} as is and any express or implied warranties"),
    ("GPL_REDISTRIBUTE", "{} redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL_WARRANTY", "This program is distributed in the hope that it will be useful, but without any warranty"),
    ("GPL_COPY", "You should have received a copy of the GNU General Public License"),
]

# Licences by name, as patterns of the normalised name.
NAMES = {
    "Apache-2.0": "apache(?: software)? license(?: version)? 2(?: 0)?|apache 2(?: 0)?(?: license)?",
    "MIT": "mit license",
    "ISC": "isc license",
    "BSD-3-Clause": "(?:3|three) clause bsd license|bsd (?:3|three) clause license|(?:new|modified) bsd license",
    "BSD-2-Clause": "(?:2|two) clause bsd license|bsd (?:2|two) clause license|simplified bsd license",
    "BSD": "bsd(?: style)? license",
    "AGPL-3.0": "gnu affero general public license(?: version 3| v3)?(?: 0)?|(?:gnu )?agpl ?v?3(?: 0)?",
    "LGPL": "gnu (?:lesser|library) general public license(?:(?: version)? v?(?:2 1|2 0|2|3 0|3))?|(?:gnu )?lgpl(?: ?v?(?:2 1|3)(?: 0)?)?",
    "GPL-3.0": "gnu general public license(?: version)? v?3(?: 0)?|(?:gnu )?gpl ?v?3(?: 0)?",
    "GPL-2.0": "gnu general public license(?: version)? v?2(?: 0)?|(?:gnu )?gpl ?v?2(?: 0)?",
    "MPL-2.0": "mozilla public license(?: version)? ?(?:v ?)?2 0",
    "EPL-2.0": "eclipse public license(?: version)? ?(?:v ?)?2 0",
    "BSL-1.0": "boost software license(?: version 1 0)?",
    "CC-BY-NC-ND": "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s",
    "CC-BY-NC-SA": "cc by nc sa|creative commons attribution non ?commercial share ?alike",
    "CC-BY-NC": "cc by nc|creative commons attribution non ?commercial",
    "CC-BY-ND": "cc by nd|creative commons attribution no ?deriv(?:ative)?s",
    "CC-BY-SA": "cc by sa|creative commons attribution share ?alike",
    "CC-BY": "cc by|creative commons attribution",
    "OFL-1.1": "sil open font license(?: version)?(?: 1 1)?|sil ofl(?: 1 1)?",
    "Artistic-2.0": "artistic license(?: version)? 2 0",
    "WTFPL": "wtfpl|do what the fuck you want to public license(?: version 2)?",
    "CC0-1.0": "cc0(?: 1 0)?(?: universal)?|creative commons zero",
}
#: What may stand before and after a name.
_BEFORE = (
    "(?:(?:this|the|all|our|its) (?:[a-z0-9]+ ){1,4}(?:is|are) |content is )?(?:released|licensed|distributed|available|published|provided|shared) "
    "under (?:the |a |an )?(?:terms of the )?(?:a href [a-z0-9 ]{1,200}? )?"
)
_AFTER = (
    "(?: 4 0| 3 0)?(?: international)?(?: licen[sc]e)?(?: the license)?(?: a)?(?: unless otherwise (?:noted|stated|specified))?"
    "(?: see the licen[sc]e(?: md| txt)?(?: file)? for (?:more )?details)?"
)

# Licences of which SPDX tags are known; "-only" adds nothing to the name.
TAGS = "MIT MIT-0 ISC 0BSD Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 Zlib Unlicense WTFPL MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 Artistic-2.0 Python-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0".split()

#: The tags as they are in normalised text, longer ones first.
_TAG = "|".join(sorted((re.sub("[^a-z0-9]+", " ", t.lower()) for t in TAGS), key=len, reverse=True))
_WITH = "(?: with [a-z0-9 ]{1,200}? exception(?: [a-z0-9])?(?: [a-z0-9])?)?"
#: SPDX tags joined by AND and OR, exceptions aside; parentheses are marks like others.
EXPRESSION = f"spdx license identifier (?:{_TAG}){_WITH}(?: (?:and|or) (?:{_TAG}){_WITH})*"

# Ordered rules, (licence, sequence of identifiers).  X? may be missing; others may not stand between.
RULES = [
    ("MIT", "RESERVED? MIT_GRANT MIT_NOTICE? MIT_WARRANTY? MIT_LIABILITY?"),
    ("ISC", "RESERVED? ISC_GRANT ISC_WARRANTY? MIT_WARRANTY? ISC_LIABILITY?"),
    ("0BSD", "0BSD_GRANT ISC_WARRANTY? ISC_LIABILITY?"),
    ("BSD-3-Clause", "RESERVED? BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE BSD_WARRANTY? BSD_LIABILITY?"),
    ("BSD-2-Clause", "RESERVED? BSD_GRANT BSD_SOURCE BSD_BINARY BSD_WARRANTY? BSD_LIABILITY?"),
    ("Zlib", "ZLIB_WARRANTY ZLIB_LIABILITY? ZLIB_GRANT ZLIB_NOTICE?"),
    ("BSL-1.0", "BSL_TITLE? BSL_GRANT MIT_WARRANTY?"),
    ("Unlicense", "UNLICENSE MIT_WARRANTY? MIT_LIABILITY?"),
    ("Apache-2.0", "APACHE2_TITLE NAMED_Apache-2.0? APACHE2_MAY? APACHE2_COPY? APACHE2_UNLESS? APACHE2_SEE?"),
    ("Apache-2.0", "NAMED_Apache-2.0 APACHE2_MAY? APACHE2_COPY? APACHE2_UNLESS? APACHE2_SEE?"),
    ("AGPL-3.0", "AGPL3_TITLE GPL_VERBATIM? AGPL3_LATER? GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("LGPL-2.1", "LGPL21_TITLE GPL_VERBATIM? LGPL21_LATER? GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("LGPL-3.0", "LGPL3_TITLE GPL_VERBATIM?"),
    ("GPL-3.0", "GPL3_TITLE GPL_VERBATIM? GPL3_LATER? GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("GPL-2.0", "GPL2_TITLE GPL_VERBATIM? GPL2_LATER? GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("AGPL-3.0-or-later", "AGPL3_LATER GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("LGPL-2.1-or-later", "LGPL21_LATER GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("LGPL-3.0-or-later", "LGPL3_LATER GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("GPL-3.0-or-later", "GPL3_LATER GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("GPL-2.0-or-later", "GPL2_LATER GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("GPL", "GPL_REDISTRIBUTE GPL_WARRANTY? GPL_SEE? GPL_COPY?"),
    ("MPL-2.0", "MPL2_TITLE MPL2_SUBJECT? MPL2_COPY?"),
    ("MPL-2.0", "MPL2_SUBJECT MPL2_COPY?"),
    ("EPL-2.0", "EPL2_TITLE"),
    ("CC-BY-NC", "CC_BY_NC_TITLE"),
    ("CC-BY-SA", "CC_BY_SA_TITLE"),
    ("CC-BY", "CC_BY_TITLE"),
    ("CC0-1.0", "CC0_TITLE"),
    ("MIT", "NAMED_MIT MIT_WARRANTY?"),
    *[(name, f"NAMED_{name}") for name in NAMES if name not in ("MIT", "Apache-2.0")],
    *[(re.sub("-only$|(?<=CC-BY)-4.0|(?<=-SA)-4.0|(?<=-NC)-4.0|(?<=-ND)-4.0", "", tag), f"SPDX_{tag}") for tag in TAGS],
    ("Public domain", "PUBLIC_DOMAIN"),
    ("Proprietary", "RESERVED"),
]

#: Most lines of a sentence that the SQL joins.
_LINES = 60


def plain(sentence: str) -> str:
    """A sentence as it is compared, slots kept."""
    return re.sub("[^a-z0-9{}]+", " ", sentence.lower()).strip()


@lru_cache(1)
def table() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(whole sentences, patterns): known sentences with their identifiers, in the order they are tried."""
    slot = "[a-z0-9 ]{1,200}?"
    whole = [(plain(t), i) for i, t in SENTENCES if "{}" not in t] + [(plain(f"SPDX-License-Identifier: {t}"), f"SPDX_{t}") for t in TAGS]
    slotted = [(plain(t).replace("{}", slot), i) for i, t in SENTENCES if "{}" in t and not t.startswith("{}")]
    named = [(f"{_BEFORE}(?:{p}){_AFTER}", f"NAMED_{n}") for n, p in NAMES.items()]
    opened = [(f"{plain(t).replace('{}', slot)}(?: [a-z0-9 ]*)?", i) for i, t in OPENINGS]
    loose = [(plain(t).replace("{}", slot), i) for i, t in SENTENCES if t.startswith("{}")]
    return sorted(whole, key=lambda x: -len(x[0])), [*slotted, *named, *opened, *loose, (EXPRESSION, "EXPRESSION")]


def rule_pattern(rule: str) -> str:
    """The rule over a sequence written as ``<A><B>``."""
    name = lambda x: "<" + re.escape(x).replace("\\-", "-") + ">"
    return "".join(f"(?:{name(x[:-1])})?" if x.endswith("?") else name(x) for x in rule.split())


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null: whole sentences by hash, the rest by pattern.

    A sentence that names several licences has several, written ``A><B``.
    """
    whole, patterns = table()
    by_hash = F.create_map(*[x for s, i in whole for x in (F.xxhash64(F.lit(s)), F.lit(i))])
    chain = F.when(F.lit(False), F.lit(""))
    for pattern, name in patterns:
        chain = chain.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    tags = F.create_map(*[F.lit(x) for t in TAGS for x in (plain(t), f"SPDX_{t}")])
    listed = F.transform(F.regexp_extract_all(sentence, F.lit(f"\\b({_TAG})\\b"), F.lit(1)), lambda t: tags[t])
    chain = F.when(chain == "EXPRESSION", F.array_join(listed, "><")).otherwise(chain)
    return F.coalesce(by_hash[F.xxhash64(sentence)], chain)


@lru_cache(1)
def lines_pattern() -> str:
    """A known sentence at whole lines, an item's number before it aside; a blank may be a line end."""
    whole, patterns = table()
    soft = [p.replace(" ", "[ \\n]").replace("[a-z0-9[ \\n]]", "[a-z0-9 \\n]").replace("[ \\n]?", "[ \\n]?") for p in [*(s for s, _ in whole), *(p for p, _ in patterns)]]
    # an opening ends with its line
    soft = [p.replace("(?:[ \\n][a-z0-9 \\n]*)?", "(?:[ \\n][a-z0-9 ]*)?") for p in soft]
    return "(?m)^(?:[0-9a-z][ \\n])?(" + "|".join(f"(?:{p})" for p in soft) + ")$"


def segments(text: Column) -> Column:
    """Stretches of a text between full stops or blank lines, normalised, with line ends where a sentence may end."""
    soft = F.regexp_replace(F.lower(text), r"(?m)^[ \t]*(?:rem|dnl)[ \t]", "")
    soft = F.regexp_replace(soft, r"[.!?]\s+([^0-9\s])", "\n\n$1")
    soft = F.regexp_replace(soft, r"[.!?;:]\s+", "\n")
    soft = F.regexp_replace(F.regexp_replace(soft, r"[^a-z0-9\n]+", " "), " ?\n ?", "\n")
    return F.split(soft, "\n\n+")


def sequence(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order, as ``<A><B>``."""
    parts = F.filter(segments(text), lambda s: s.rlike(ANCHORS.replace("[^a-z0-9]+", "[ \\n]")))
    found = F.flatten(F.transform(parts, lambda s: F.regexp_extract_all(F.btrim(s, F.lit(" \n")), F.lit(lines_pattern()), F.lit(1))))
    known = F.filter(F.transform(found, lambda s: identifier(F.translate(s, "\n", " "))), lambda x: x.isNotNull())
    return F.concat_ws("", F.transform(known, lambda x: F.concat(F.lit("<"), x, F.lit(">"))))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sentences (identifiers in order), licenses (names, sorted), unmatched (identifiers no rule claims)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    found = rows.select(id_col, F.when(F.lower("__text").rlike(ANCHORS), sequence(F.col("__text"))).otherwise(F.lit("")).alias("__seq"))
    rules = F.array(*[F.struct(F.lit(f"{name},").alias("name"), F.lit(rule_pattern(rule)).alias("pattern")) for name, rule in RULES])

    def apply(state: Column, rule: Column) -> Column:
        # what a rule claims becomes a bar, which no later rule can match across
        left = F.regexp_replace(state["left"], rule["pattern"], F.lit("|"))
        return F.struct(left.alias("left"), F.concat(state["names"], F.when(left != state["left"], rule["name"]).otherwise(F.lit(""))).alias("names"))

    start = F.struct(F.col("__seq").alias("left"), F.lit("").alias("names"))
    end = F.when(F.col("__seq") != "", F.aggregate(rules, start, apply)).otherwise(start)
    found = found.withColumn("__end", end)
    listed = F.array_sort(F.array_distinct(F.filter(F.split(F.col("__end.names"), ","), lambda x: x != "")))
    return found.select(id_col, _identifiers("__seq").alias("sentences"), listed.alias("licenses"), _identifiers("__end.left").alias("unmatched"))


def _identifiers(col: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.col(col), r"[<>|]+", " "), " "), lambda x: x != "")


def scan_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The lists of ``scan`` as text and figures."""
    return found.select(id_col, F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))


def oracle() -> str:
    """The same for the table ``documents`` in DuckDB's SQL, found another way: every run of
    lines between full stops is joined with the known sentences; nothing is filtered before."""
    whole, patterns = table()
    known = ", ".join(f"('{s}', '{i}', {k})" for k, (s, i) in enumerate(whole))
    case = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN {k}" for k, (p, _) in enumerate(patterns)) + " END"
    tags = ", ".join(f"'{plain(t)}': 'SPDX_{t}'" for t in TAGS)
    names_of = ", ".join(f"({k}, '{i}')" for k, (_, i) in enumerate(patterns))
    steps, last = [], "seq"
    for k, (_, rule) in enumerate(RULES):
        steps.append(f"regexp_replace({last}, '{rule_pattern(rule)}', '|', 'g') AS l{k}")
        last = f"l{k}"
    names = ", ".join(f"CASE WHEN l{k} <> {f'l{k - 1}' if k else 'seq'} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    ids = "[x FOR x IN string_split(regexp_replace({0}, '[<>|]+', ' ', 'g'), ' ') IF x <> '']"
    return rf"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '(?m)^[ \t]*(?:rem|dnl)[ \t]', '', 'g'),
             '[.!?]\s+([^0-9\s])', chr(10) || chr(10) || '\1', 'g'), '[.!?;:]\s+', chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[^a-z0-9\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, unnest(string_split_regex(t, '\n\n+')) AS part, unnest(range(len(string_split_regex(t, '\n\n+')))) AS p FROM b),
d AS (SELECT doc_id, p, string_split(trim(part, chr(10) || chr(32)), chr(10)) AS lines FROM c),
e AS (SELECT doc_id, p, lines, unnest(range(len(lines))) AS i FROM d),
f AS (SELECT doc_id, p, i, lines, unnest(range(i, least(len(lines), i + {_LINES}))) AS j FROM e),
g AS (SELECT doc_id, p, i, j, array_to_string(lines[i + 1:j + 1], ' ') AS s FROM f),
h AS (SELECT doc_id, p, i, j, regexp_replace(s, '^[0-9a-z] ', '') AS s FROM g),
known(s, id, k) AS (VALUES {known}),
pattern(k, id) AS (VALUES {names_of}),
w AS (SELECT doc_id, p, i, j, id, k FROM h JOIN known USING (s)
      UNION ALL SELECT doc_id, p, i, j, CASE WHEN id = 'EXPRESSION' THEN array_to_string(list_transform(regexp_extract_all(s, '\b({_TAG})\b'),
        lambda t: element_at(MAP {{{tags}}}, t)[1]), '><') ELSE id END, 1000 + k FROM (SELECT doc_id, p, i, j, s, {case} AS k FROM h) JOIN pattern USING (k)),
m AS (SELECT doc_id, p, i, arg_min(j, k * 1000 + j) AS j, arg_min(id, k * 1000 + j) AS id FROM w GROUP BY doc_id, p, i),
o AS (SELECT doc_id, p, i, id FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS n WHERE n.doc_id = m.doc_id AND n.p = m.p AND n.i < m.i AND n.j >= m.i)),
q AS (SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY p, i) AS seq FROM o GROUP BY doc_id),
x AS (SELECT doc_id, coalesce(q.seq, '') AS seq FROM documents LEFT JOIN q USING (doc_id)),
r AS (SELECT doc_id, seq, {", ".join(steps)} FROM x),
n AS (SELECT doc_id, seq, {last} AS rest, [{names}] AS names FROM r)
SELECT doc_id, CAST(len({ids.format("seq")}) AS BIGINT) AS n_sentences, array_to_string({ids.format("seq")}, ',') AS sentences,
       array_to_string(list_sort(list_distinct([x FOR x IN names IF x IS NOT NULL])), ',') AS licenses,
       array_to_string({ids.format("rest")}, ',') AS unmatched
FROM n
"""
