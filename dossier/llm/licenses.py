"""Licences of texts by sentence rules.

A text is cut into lines and sentences and normalised: A-Z in lower case, ASCII marks as spaces, comment signs
gone with them. A known sentence starts where a line or sentence starts, may run over line ends, and stops where a line or
sentence stops. It is mapped to its identifier; the identifiers of a document, in order, are matched with rules, tried
in their order: what a rule matches is taken out of the sequence, so a full licence is found before the parts it shares
with others. Identifiers no rule has taken are reported as unmatched.

Column expressions only; nothing is shuffled. A null or empty text has no sentences. Repeated rows give repeated
results. A null id is carried along. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import ASCII_UPPER, query, table

# --- fixed values: sentences of published licences, normalised, with their identifiers; rules in order ----------
SENTENCES = {
    "apache-grant": ["licensed under the apache license version 2.0 the license", "licensed under the apache license version 2.0",
                     "licensed under the apache license 2.0", "this project is licensed under the apache license version 2.0",
                     "this project is licensed under the apache license 2.0",
                     "licensed to the apache software foundation asf under one or more contributor license agreements",
                     "released under the apache license version 2.0", "released under the apache license 2.0"],
    "apache-asf": ["the asf licenses this file to you under the apache license version 2.0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license",
                      "you may not use this file except in compliance with the license."],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is "
                     "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-name": ["released under the mit license", "licensed under the mit license", "distributed under the mit license",
                 "this project is licensed under the mit license", "this software is released under the mit license",
                 "this software is licensed under the mit license", "this code is released under the mit license", "mit license",
                 "the mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation "
                  "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
                  "permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial "
                   "portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to "
                  "the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability "
                      "whether in an action of contract tort or otherwise arising from out of or in connection with the "
                      "software or the use or other dealings in the software"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies",
                  "permission to use copy modify and distribute this software for any purpose with or without fee is hereby "
                  "granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-name": ["isc license", "released under the isc license", "licensed under the isc license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that "
                  "the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the "
                   "following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                   "following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied "
                  "warranties including but not limited to the implied warranties of merchantability and fitness for a "
                  "particular purpose are disclaimed"],
    "bsd-3-name": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "bsd 3 clause license"],
    "bsd-2-name": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "bsd 2 clause license"],
    "bsd-name": ["licensed under the bsd license", "released under the bsd license"],
    "gpl-free": ["this program is free software"],
    "gpl-3-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                    "the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-2-later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by "
                    "the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl-implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-details": ["see the gnu general public license for more details"],
    "gpl-3-name": ["this work is licensed under the gnu general public license version 3",
                   "licensed under the gnu general public license version 3", "licensed under the gnu general public license v3.0",
                   "released under the gnu general public license version 3", "licensed under the gpl v3", "licensed under gpl 3.0"],
    "gpl-2-name": ["this work is licensed under the gnu general public license version 2",
                   "licensed under the gnu general public license version 2", "licensed under the gpl v2"],
    "lgpl-3-name": ["licensed under the gnu lesser general public license version 3"],
    "agpl-3-name": ["licensed under the gnu affero general public license version 3"],
    "mpl-grant": ["this source code form is subject to the terms of the mozilla public license v. 2.0",
                  "licensed under the mozilla public license version 2.0", "licensed under the mozilla public license 2.0"],
    "cc-by-nc-name": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0",
                      "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa-name": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0",
                      "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nd-name": ["licensed under cc by nd 4.0", "this work is licensed under cc by nd 4.0"],
    "cc-by-name": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0",
                   "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc0-name": ["cc0 1.0 universal", "released under cc0 1.0", "licensed under cc0 1.0"],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
    "public-domain": ["this work is in the public domain", "released into the public domain", "placed in the public domain"],
    "spdx-mit": ["spdx license identifier mit"],
    "spdx-apache": ["spdx license identifier apache 2.0"],
    "spdx-bsd-3": ["spdx license identifier bsd 3 clause"],
    "spdx-bsd-2": ["spdx license identifier bsd 2 clause"],
    "spdx-gpl-3": ["spdx license identifier gpl 3.0 only", "spdx license identifier gpl 3.0"],
    "spdx-gpl-3-later": ["spdx license identifier gpl 3.0 or later"],
    "spdx-gpl-2": ["spdx license identifier gpl 2.0 only", "spdx license identifier gpl 2.0"],
    "spdx-mpl": ["spdx license identifier mpl 2.0"],
    "all-rights": ["all rights reserved"],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it "
                   "and redistribute it freely subject to the following restrictions"],
    "zlib-origin": ["the origin of this software must not be misrepresented"],
    "zlib-altered": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
    "zlib-notice": ["this notice may not be removed or altered from any source distribution"],
    "bsl-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
                  "documentation covered by this license the software to use reproduce display distribute execute and transmit the software "
                  "and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so "
                  "all subject to the following"],
    "bsl-notice": ["the copyright notices in the software and this entire statement including the above license grant this restriction and the "
                   "following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the "
                   "software unless such copies or derivative works are solely in the form of machine executable object code generated by a "
                   "source language processor"],
    "mit-as-is-title": ["the software is provided as is without warranty of any kind express or implied including but not limited to the "
                        "warranties of merchantability fitness for a particular purpose title and non infringement"],
    "bsl-liable": ["in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability "
                   "whether in contract tort or otherwise arising from out of or in connection with the software or the use or other "
                   "dealings in the software"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "0bsd-as-is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
                   "warranties of merchantability and fitness"],
    "0bsd-liable": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
                    "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
                    "out of or in connection with the use or performance of this software"],
    "wtfpl-grant": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is "
                    "allowed as long as the name is changed"],
    "psf-agree": ["this license agreement is between the python software foundation psf and the individual or organization licensee "
                  "accessing and otherwise using this software python in source or binary form and its associated documentation"],
    "psf-grant": ["subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world "
                  "wide license to reproduce analyze test perform and or display publicly prepare derivative works distribute and otherwise "
                  "use python alone or in any derivative version provided however that psf s license agreement and psf s notice of copyright"],
    "epl-grant": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is "
                  "available at https www.eclipse.org legal epl 2.0",
                  "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "cddl-grant": ["the contents of this file are subject to the terms of the common development and distribution license the license"],
    "artistic-grant": ["you can redistribute it and or modify it under the terms of the artistic license 2.0"],
    "gpl-see": ["if not see https www.gnu.org licenses", "if not see http www.gnu.org licenses",
                "if not write to the free software foundation inc", "see https www.gnu.org licenses"],
}
# Licences that are named in one line: the end of the identifier, the name in the rules, and how the licence is called.
NAMED = {
    "apache-grant": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license"],
    "mit-name": ["mit license", "mit licence", "expat license"],
    "isc-name": ["isc license"],
    "bsd-3-name": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "bsd-2-name": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "bsd-name": ["bsd license"],
    "gpl-3-name": ["gnu general public license version 3", "gnu general public license v3.0", "gnu gpl version 3", "gpl v3", "gplv3", "gpl 3.0"],
    "gpl-2-name": ["gnu general public license version 2", "gnu general public license v2.0", "gnu gpl version 2", "gpl v2", "gplv2", "gpl 2.0"],
    "lgpl-3-name": ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "lgpl v3", "lgplv3"],
    "lgpl-2.1-name": ["gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgpl v2.1", "lgplv2.1"],
    "agpl-3-name": ["gnu affero general public license version 3", "gnu affero general public license v3.0", "agpl v3", "agplv3"],
    "mpl-grant": ["mozilla public license version 2.0", "mozilla public license v. 2.0", "mozilla public license 2.0", "mpl 2.0"],
    "epl-name": ["eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license 2.0"],
    "cddl-name": ["common development and distribution license version 1.0", "cddl 1.0"],
    "artistic-name": ["artistic license 2.0", "artistic license version 2.0"],
    "zlib-name": ["zlib license"],
    "bsl-name": ["boost software license version 1.0", "boost software license 1.0"],
    "0bsd-name": ["zero clause bsd license", "0bsd license", "bsd zero clause license"],
    "wtfpl-name": ["wtfpl", "do what the fuck you want to public license"],
    "psf-name": ["python software foundation license version 2", "psf license"],
}
# The notices of the three families of one licence, for each version.
FAMILIES = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
VERSIONS = {"gpl": ["2", "3"], "lgpl": ["2.1", "3"], "agpl": ["3"]}
RULES = [
    ("Zlib", "zlib-as-is zlib-liable zlib-grant zlib-origin zlib-altered zlib-notice"),
    ("BSL-1.0", "bsl-grant bsl-notice mit-as-is-title bsl-liable"),
    ("0BSD", "0bsd-grant 0bsd-as-is 0bsd-liable"),
    ("WTFPL", "wtfpl-grant"),
    ("PSF-2.0", "psf-agree psf-grant"),
    ("EPL-2.0", "epl-grant"),
    ("CDDL-1.0", "cddl-grant"),
    ("Artistic-2.0", "artistic-grant"),
    ("Apache-2.0", "apache-grant apache-asf apache-comply apache-copy apache-as-is apache-see"),
    ("Apache-2.0", "apache-grant apache-comply apache-copy apache-as-is apache-see"),
    ("Apache-2.0", "apache-grant apache-comply"),
    ("Apache-2.0", "apache-grant"),
    ("Apache-2.0", "spdx-apache"),
    ("MIT", "mit-name mit-grant mit-notice mit-as-is mit-liability"),
    ("MIT", "mit-grant mit-notice mit-as-is mit-liability"),
    ("MIT", "mit-name"),
    ("MIT", "spdx-mit"),
    ("ISC", "isc-name isc-grant"),
    ("ISC", "isc-grant"),
    ("ISC", "isc-name"),
    ("BSD-3-Clause", "bsd-3-name bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-endorse bsd-as-is"),
    ("BSD-2-Clause", "bsd-2-name bsd-grant bsd-source bsd-binary bsd-as-is"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is"),
    ("BSD-3-Clause", "bsd-3-name"),
    ("BSD-3-Clause", "spdx-bsd-3"),
    ("BSD-2-Clause", "bsd-2-name"),
    ("BSD-2-Clause", "spdx-bsd-2"),
    ("BSD", "bsd-name"),
    ("GPL-3.0-or-later", "gpl-free gpl-3-later gpl-hope gpl-implied gpl-details"),
    ("GPL-3.0-or-later", "gpl-free gpl-3-later"),
    ("GPL-3.0-or-later", "spdx-gpl-3-later"),
    ("GPL-2.0-or-later", "gpl-free gpl-2-later gpl-hope gpl-implied gpl-details"),
    ("GPL-2.0-or-later", "gpl-free gpl-2-later"),
    ("GPL-3.0-only", "gpl-3-name"),
    ("GPL-3.0-only", "spdx-gpl-3"),
    ("GPL-2.0-only", "gpl-2-name"),
    ("GPL-2.0-only", "spdx-gpl-2"),
    ("LGPL-3.0-only", "lgpl-3-name"),
    ("AGPL-3.0-only", "agpl-3-name"),
    ("MPL-2.0", "mpl-grant"),
    ("MPL-2.0", "spdx-mpl"),
    ("CC-BY-NC-4.0", "cc-by-nc-name"),
    ("CC-BY-SA-4.0", "cc-by-sa-name"),
    ("CC-BY-ND-4.0", "cc-by-nd-name"),
    ("CC-BY-4.0", "cc-by-name"),
    ("CC0-1.0", "cc0-name"),
    ("Unlicense", "unlicense-grant"),
    ("public-domain", "public-domain"),
]
# ----------------------------------------------------------------------------------------------------------------


GAP = r"(?:\x20|\n\n)"
# What a sentence may say in several ways is said in one: who is licensed and how, what a notice speaks of, the holder's name. $1 is
# what the brackets have found.
WIDE = r"(?:\x20|\n\n|\n\.\n)"  # also the stop after "Inc."
SLOTS = [tuple(x.replace("~", WIDE).replace(" ", GAP) if i == 0 else x for i, x in enumerate(slot)) for slot in (
    (r"\n(?:this (?:project|software|work|code|program|file|library) is )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?("
     + "|".join(sorted({call.split()[0] for calls in NAMED.values() for call in calls} | {"cc", "cc0", "a"})) + r")\b", "\nlicensed under $1"),
    (r"\bthis (?:library|software|file|work) (is free software|is distributed in the hope)", "this program $1"),
    (r"\balong with this (?:library|software|file|work)\b", "along with this program"),
    (r"\bneither the name of (?:[^\x20\n]+~){1,12}?nor the names of", "neither the name of the copyright holder nor the names of"),
    (r"\bthis software is provided by (?:[^\x20\n]+~){1,12}?as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
)]


def canonical(sentence: str) -> str:
    """A sentence in the one way it is said in."""
    t = f"\n{sentence}\n"
    for pattern, new in SLOTS:
        t = re.sub(pattern, new.replace("$1", r"\1"), t)
    return t.strip("\n")


def _by_rule() -> dict[str, str]:
    """Sentences that differ in one word only, with their identifiers."""
    found = {f"licensed under {call}": name for name, calls in NAMED.items() for call in calls}
    free = "this program is free software"
    for family, called in FAMILIES.items():
        found[f"you should have received a copy of the {called} along with this program"] = "gpl-copy"
        found[f"see the {called} for more details"] = "gpl-details"
        for version in VERSIONS[family]:
            published = f"you can redistribute it and or modify it under the terms of {{}}the {called} as published by the free software foundation"
            later = published.format("") + f" either version {version} of the license or at your option any later version"
            only = published.format(f"version {version} of ")
            found |= {later: f"{family}-{version}-later", f"{free} {later}": f"{family}-{version}-later-whole",
                      only: f"{family}-{version}-only", f"{free} {only}": f"{family}-{version}-only-whole"}
    return found


IDENTIFIERS = {canonical(sentence): name for name, several in SENTENCES.items() for sentence in several} | _by_rule()
NOTICE = "gpl-hope gpl-implied gpl-details"
_NOTICES = []  # before all other rules
for _family, _versions in VERSIONS.items():
    for _version in _versions:
        for _end, _kind in (("later", "or-later"), ("only", "only")):
            _name = f"{_family.upper()}-{_version if '.' in _version else _version + '.0'}-{_kind}"
            for _lead in (f"{_family}-{_version}-{_end}-whole", f"gpl-free {_family}-{_version}-{_end}"):
                # The longest form first.
                _NOTICES += [(_name, f"{_lead} {NOTICE} gpl-copy gpl-see"), (_name, f"{_lead} {NOTICE} gpl-copy"), (_name, f"{_lead} {NOTICE}"), (_name, _lead)]
RULES = _NOTICES + RULES + [(name, identifier) for identifier, name in (
    ("lgpl-2.1-name", "LGPL-2.1-only"), ("epl-name", "EPL-2.0"), ("cddl-name", "CDDL-1.0"), ("artistic-name", "Artistic-2.0"), ("zlib-name", "Zlib"),
    ("bsl-name", "BSL-1.0"), ("0bsd-name", "0BSD"), ("wtfpl-name", "WTFPL"), ("psf-name", "PSF-2.0"))]
# Known sentences that may stand anywhere, also between those of a rule.
ANYWHERE = ["all-rights"]
# A sentence stop, with closing marks, before white space; a line end; marks. In this order; \x01 stands for a stop meanwhile.
STEPS = [
    (r"\r\n?|[\x0B\x0C]", "\n"),
    (r"[.;!?][.;!?\x22')]*[ \t\n]+", "\x01"),
    (r"[^a-z0-9.+\n\x01\x{80}-\x{10FFFF}]+", " "),
    (r" *\n *", "\n\n"),
    (r" *\x01 *", "\n.\n"),
]


def _tree(sentences: list[list[str]]) -> str:
    """A pattern for any of some sentences that tries words they begin with in common once; the longest one is taken."""
    heads: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            heads.setdefault(words[0], []).append(words[1:])
    branches = [word.replace(".", r"\.") + (GAP + rest if (rest := _tree(tails)) and [] not in tails else f"(?:{GAP}{rest})?" if rest else "")
                for word, tails in sorted(heads.items())]
    return "" if not branches else branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


# Line ends are doubled, so neighbours share none.
KNOWN = r"\n(" + _tree([s.split() for s in sorted(IDENTIFIERS)]) + r")\n"


def marked(rule: str) -> str:
    return "".join(f"<{name}>" for name in rule.split())


def normalised(text: Column) -> Column:
    t = F.concat(F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower()), F.lit(" "))
    for pattern, new in STEPS:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(new))
    t = F.concat(F.lit("\n"), F.btrim(t, F.lit(" ")), F.lit("\n"))
    for pattern, new in SLOTS:
        t = F.regexp_replace(t, F.lit(pattern), F.lit(new))
    return t


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    ids = F.create_map(*[F.lit(v) for pair in IDENTIFIERS.items() for v in pair])
    found = F.regexp_extract_all(normalised(text), F.lit(KNOWN), F.lit(1))
    return F.transform(found, lambda s: F.element_at(ids, F.replace(s, F.lit("\n\n"), F.lit(" "))))


def licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order), licenses (names, sorted), unmatched (identifiers no rule took)."""
    rows = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    own = F.filter("ids", lambda i: ~i.isin(ANYWHERE))
    sequence = F.array_join(F.transform(own, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for name, rule in RULES:
        sequence = F.replace(sequence, F.lit(marked(rule)), F.lit("{" + name + "}"))
    return rows.select("doc_id", "ids", sequence.alias("sequence")).select(
        "doc_id", F.col("ids").alias("sentences"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("sequence", F.lit(r"\{([^}]*)\}"), F.lit(1)))).alias("licenses"),
        F.concat(F.regexp_extract_all("sequence", F.lit("<([^>]*)>"), F.lit(1)), F.filter("ids", lambda i: i.isin(ANYWHERE))).alias("unmatched"))


def _sql() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    t = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}') || ' '"
    for pattern, new in STEPS:
        t = f"regexp_replace({t}, {lit(pattern)}, {lit(new)}, 'g')"
    t = f"chr(10) || trim({t}, ' ') || chr(10)"
    for pattern, new in SLOTS:
        t = f"regexp_replace({t}, {lit(pattern)}, {lit(new.replace('$1', chr(92) + '1'))}, 'g')"
    ids = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in IDENTIFIERS.items()) + "}"
    s = "q"
    for name, rule in RULES:
        s = f"replace({s}, {lit(marked(rule))}, {lit('{' + name + '}')})"
    return f"""
WITH n AS (SELECT doc_id, {t} AS t FROM documents),
f AS (SELECT doc_id, [{ids}[replace(x, chr(10) || chr(10), ' ')] FOR x IN regexp_extract_all(t, {lit(KNOWN)}, 1)] AS ids FROM n),
q AS (SELECT doc_id, ids, array_to_string(['<' || i || '>' FOR i IN ids IF NOT i IN ({", ".join(map(lit, ANYWHERE))})], '') AS q FROM f),
s AS (SELECT doc_id, ids, {s} AS s FROM q)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
  coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(s, '\\{{([^}}]*)\\}}', 1))), ','), '') AS licenses,
  coalesce(array_to_string(list_concat(regexp_extract_all(s, '<([^>]*)>', 1), [i FOR i IN ids IF i IN ({", ".join(map(lit, ANYWHERE))})]), ','), '') AS unmatched
FROM s"""


@query("op3_licenses", _sql())
def op3_licenses(spark, sf_dir):
    return licences(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))
