"""Unmodified licence notices, wrapped, commented and unwrapped."""

import duckdb
import pytest

from gridpulse.llm import licence_scan

MIT = """Copyright (c) 2020 Example Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
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
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD2 = """Copyright (c) 2020, Example Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD3 = BSD2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
AGPL = GPL.replace("GNU General", "GNU Affero General").replace("the\nGNU Affero General Public License for", "the\nGNU Affero General Public License for")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
NOTICES = {
    "LGPL-2.1-or-later": (LGPL, "<31><33><34><35>"),
    "AGPL-3.0-or-later": (AGPL, "<36><10><37><38>"),
    "MPL-2.0": (MPL, "<39><40>"),
    "ISC": (ISC, "<44>"),
    "Zlib": (ZLIB, "<46><47><48>"),
    "EPL-2.0": ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n", "<42>"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)\n", "<49>"),
    "MIT": (MIT, "<5><6><7><24>"),
    "Apache-2.0": (APACHE, "<1><2><3><22><23>"),
    "GPL-3.0-or-later": (GPL, "<9><10><11><25>"),
    "BSD-2-Clause": (BSD2 + BSD_END, "<21><15><16><17><26><27>"),
    "BSD-3-Clause": (BSD3 + BSD_END, "<21><15><16><17><18><26><27>"),
}
#: Single phrases, as lines without stops and within prose.
LINES = {"// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": ("<70>", "GPL-2.0-or-later"), "Some words\nReleased under the MIT License\nmore words": ("<4>", "MIT"), "x. All rights reserved. y": ("<21>", "Proprietary"), "it is not all rights reserved": ("", ""), "All. Rights. Reserved.": ("", "")}


def forms(text):
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    yield text
    yield text.replace("\n", "\r\n")
    yield "\n\n".join(paragraphs)
    yield " ".join(paragraphs)
    yield "".join(f"# {line}\n" for line in text.splitlines())
    yield "".join(f" * {line}\n" for line in text.splitlines())


@pytest.fixture(scope="module")
def cases():
    want = [(t, (ids, name)) for name, (notice, ids) in NOTICES.items() for t in forms(notice)]
    want += [(f"{MIT}\n{APACHE}", ("<5><6><7><24><1><2><3><22><23>", "MIT,Apache-2.0")), *LINES.items()]
    return want + [(None, ("", "")), ("", ("", "")), (". : \n" * 3000, ("", ""))]


def test_published_notices(spark, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licence_scan.find_licences(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_published_notices_in_sql(cases):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(cases)])
    got = {i: (ids, names) for i, ids, _, names, _ in con.sql(licence_scan.oracle()).fetchall()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_thirty_licences():
    assert len({name for name, _ in licence_scan.RULES}) >= 35
    assert all(set(ids) <= set(licence_scan.SENTENCES) for _, ids in licence_scan.RULES)
