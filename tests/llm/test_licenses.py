"""Standard notices as published, holders' names, and lines in between."""

import pytest

from dossier.llm import licenses

WARRANTY = """
{hash}
{hash} This {thing} is distributed in the hope that it will be useful,
{hash} but WITHOUT ANY WARRANTY; without even the implied warranty of
{hash} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{hash} {name} for more details.
{hash}
{hash} You should have received a copy of the {name}
{hash} along with this {thing}.  If not, see <https://www.gnu.org/licenses/>.
"""
NOTICE = """{hash} This {thing} is free software{colon} you can redistribute it and/or modify
{hash} it under the terms of the {name} as published by
{hash} the Free Software Foundation, either version {version} of the License, or
{hash} (at your option) any later version.""" + WARRANTY
ONLY = """{hash} This {thing} is free software; you can redistribute it and/or
{hash} modify it under the terms of version {version} of the {name} as published by the Free Software Foundation.""" + WARRANTY
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}

BSD = """Copyright (c) 2019, {holder}
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY {by} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
THIRD = """
3. Neither the name of {holder} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


@pytest.fixture
def read(spark):
    def names(*texts):
        rows = licenses.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
        return [(r["licenses"], r["unmatched"]) for r in sorted(rows, key=lambda r: r["doc_id"])]

    return names


def test_gnu_notices(read):
    cases = []
    for family, versions in licenses.VERSIONS.items():
        for version in versions:
            for thing, mark, colon in (("program", "", ":"), ("library", "#", ";"), ("file", "//", ":"), ("software", " *", ";")):
                given = dict(thing=thing, hash=mark, colon=colon, name=GNU[family.upper()], version=version)
                full = version if "." in version else version + ".0"
                cases += [(f"{family.upper()}-{full}-or-later", NOTICE.format(**given)), (f"{family.upper()}-{full}-only", ONLY.format(**given))]
    for (name, text), got in zip(cases, read(*[text for _, text in cases]), strict=True):
        assert got == ([name], []), text


def test_bsd_with_any_holder(read):
    three = [BSD.format(holder=h, by=by, third=THIRD.format(holder=h)) for h, by in (
        ("the copyright holder", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"), ("Example Labs, Inc.", "EXAMPLE LABS, INC. AND CONTRIBUTORS"),
        ("the University of Nowhere", "THE REGENTS AND CONTRIBUTORS"))]
    two = BSD.format(holder="Jo Do", by="JO DO", third="")
    got = read(*three, two)
    assert [g[0] for g in got] == [["BSD-3-Clause"]] * 3 + [["BSD-2-Clause"]] and all(g[1] == ["all-rights"] for g in got)


def test_lines_in_between_and_whole_texts(read):
    between = APACHE.replace("You may obtain", "All rights reserved.\nYou may obtain")
    assert read(APACHE, between, ZLIB) == [(["Apache-2.0"], []), (["Apache-2.0"], ["all-rights"]), (["Zlib"], [])]


@pytest.mark.parametrize("line, name", [
    ("Distributed under the terms of the MIT license.", "MIT"), ("This library is available under the zlib license.", "Zlib"),
    ("This program is released under the terms of the Eclipse Public License 2.0.", "EPL-2.0"), ("Licensed under LGPLv3", "LGPL-3.0-only"),
    ("This file is distributed under the Artistic License 2.0", "Artistic-2.0"), ("Released under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"),
    ("Licensed under the new BSD license", "BSD-3-Clause"), ("This project is licensed under the Apache License 2.0", "Apache-2.0"),
    ("Released under the 0BSD license", "0BSD"), ("Licensed under the WTFPL", "WTFPL")])
def test_one_line_mentions(read, line, name):
    assert read(f"Some words\n{line}\nMore words") == [([name], [])]


def test_odd_rows(spark):
    assert licenses.licences(spark.createDataFrame([], "doc_id int, text string")).collect() == []
    rows = spark.createDataFrame([(None, "MIT License", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "x " * 200_000 + "\n" + APACHE, 4)], "doc_id int, text string, ids int")
    got = sorted(((r["doc_id"] or 0, r["licenses"]) for r in licenses.licences(rows).collect()))
    assert got == [(0, ["MIT"]), (1, []), (1, []), (2, []), (3, ["Apache-2.0"])]
