import re
import textwrap

import duckdb
import pandas as pd

from ledgerline.llm import licenses


def scanned(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licenses.scan(rows).collect(), key=lambda r: r.doc_id)]


def bsd(names, apart, wrap):
    """The numbered text; ``apart`` is what stands between its parts."""
    said = [licenses.SENTENCES[x][0] for x in ("BsdGrant", *names, "BsdAsIs")]
    parts = [said[0], *(f"{i}. {x}" for i, x in enumerate(said[1:-1], 1)), said[-1]]
    return "Copyright (c) 2020, A\n\n" + apart.join(textwrap.fill(x, 72) if wrap else x for x in parts)


def test_numbered_bsd_texts(spark):
    two, three = ("BsdSource", "BsdBinary"), ("BsdSource", "BsdBinary", "BsdEndorse")
    cases = [(n, a, w) for n in (two, three) for a, w in (("\n\n", True), ("\n\n", False), ("\n", False))]
    got = scanned(spark, *(bsd(*c) for c in cases), "Released under the MIT License. 1. Foo.")
    assert [(r.licenses, r.rule_matches, r.unresolved) for r in got] == [("BSD-2-Clause", 1, 0)] * 3 + [("BSD-3-Clause", 1, 0)] * 3 + [("MIT", 1, 0)]


def test_notices_of_lines_and_wrapped_ones_in_one_text(spark):
    gpl = textwrap.fill(licenses.SENTENCES["Gpl3Plus"][0], 60)
    lines = "Notes for users\nReleased under the MIT License\nSee below"
    got = scanned(spark, f"{lines}\n\n{gpl}", f"{gpl}\n\n{lines}")
    assert [r.licenses for r in got] == ["MIT,GPL-3.0-or-later", "GPL-3.0-or-later,MIT"]
    assert all((r.rule_matches, r.unresolved) == (2, 0) for r in got)


# expected answers written by hand, from the notices as their licences give them
NOTICES = [
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later\nimport os", "GPL-3.0-or-later"),
    ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0-only"),
    ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later"),
    ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0-only"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    ("SPDX-License-Identifier: ISC", "ISC"),
    ("<!-- SPDX-License-Identifier: (MIT OR Apache-2.0) -->", "MIT,Apache-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later OR BSD-3-Clause", "GPL-2.0-or-later,BSD-3-Clause"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"),
    ("SPDX-License-Identifier: LicenseRef-Ours", ""),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU Affero General Public License for more details.", "AGPL-3.0-or-later"),
    ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("Released under the MIT License. 1. Foo.\nSPDX-License-Identifier: Zlib\n\n1. bar\n2. baz", "MIT,Zlib"),
    ("We like the GPL-3.0-or-later and the MIT licence.", ""),
]


SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
WARRANTY = 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT DAMAGES.'
ADVERT = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors."
NEITHER = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
HOLDERS = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"


def listed(*clauses, who=HOLDERS, wrap=72, number="{}. "):
    parts = [GRANT, *(number.format(i) + c for i, c in enumerate(clauses, 1)), WARRANTY.format(who, who)]
    return "Copyright (c) 1999, The Holder\n\n" + "\n\n".join(textwrap.fill(x, wrap) if wrap else x for x in parts)


def gnu(name, kind="", version="3", tail="this program", thing="program"):
    return textwrap.fill(f"{name} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.", 70) + "\n\n" + textwrap.fill(
        f"{name} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.", 70
    ) + "\n\n" + textwrap.fill(f"You should have received a copy of the GNU {kind}General Public License along with {tail}.", 70)


# expected answers written by hand: free parts, abbreviations, lists with clauses of their own
FREE = [
    (listed(SOURCE, BINARY, NEITHER.format("the copyright holder")), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, NEITHER.format("the University of California")), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, NEITHER.format("Example Inc.")), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, NEITHER.format("Example Inc."), wrap=0), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, NEITHER.format("the author, J. Doe & Sons Ltd.,")), ""),  # "J. " ends a sentence: the clause is unknown, so nothing is said
    (listed(SOURCE, BINARY, NEITHER.format("Acme Co., Ltd."), who="ACME AND ITS CONTRIBUTORS"), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", who="THE AUTHOR"), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, "The names of its contributors may not be used to endorse or promote products derived from this software without prior written permission of the Foo Project."), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, NEITHER.format("Foo"), number="* "), "BSD-3-Clause"),
    (listed(SOURCE, BINARY, NEITHER.format("Foo"), number="({}) "), "BSD-3-Clause"),
    (listed(SOURCE, BINARY), "BSD-2-Clause"),
    (listed(SOURCE, BINARY, who="THE REGENTS AND CONTRIBUTORS"), "BSD-2-Clause"),
    (listed(SOURCE, BINARY, "Modified versions must carry another name."), ""),
    (listed(SOURCE, BINARY, "Modified versions must carry another name.", number="- "), ""),
    (listed(SOURCE, BINARY, ADVERT, NEITHER.format("the University")), "BSD-4-Clause"),
    (f"{GRANT}\n\n{SOURCE}\n\n{BINARY}", "BSD-2-Clause"),
    (f"{GRANT}\n\n{SOURCE}\n\n{BINARY}\n\nHave fun with it.", "BSD-2-Clause"),
    (f"{GRANT}\n\n1. {SOURCE}\n\n2. {BINARY}\n\n3. Send a postcard.", ""),
    (gnu("Foo"), "GPL-3.0-or-later"),
    (gnu("The Foo Bar tool", tail="Foo Bar. If not, see <https://www.gnu.org/licenses/>"), "GPL-3.0-or-later"),
    (gnu("Foo", tail="Foo; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston"), "GPL-3.0-or-later"),
    (gnu("Foo", kind="Affero "), "AGPL-3.0-or-later"),
    (gnu("libfoo", kind="Lesser ", tail="libfoo"), "LGPL-3.0-or-later"),
    (gnu("Foo", version="4"), ""),
    ("Licensed under the MIT License, see LICENSE", "MIT"),
    ("This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.", "MIT"),
    ("Licensed under MIT.", "MIT"),
    ("This software is released under the terms of the MIT License.", "MIT"),
    ("The code is available under the Apache License, Version 2.0, see the LICENSE file.", "Apache-2.0"),
    ("Copyright Foo Inc. Licensed under the MIT License.", "MIT"),
    ("Distributed under the BSD 3-Clause License. See LICENSE for details.", "BSD-3-Clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("We are not licensed under the MIT License.", ""),
    ("He is free software. You can see the MIT License under the tree.", ""),
]


def test_free_parts_of_sentences(spark):
    got = scanned(spark, *(t for t, _ in FREE))
    assert [(i, r.licenses) for i, r in enumerate(got)] == [(i, x) for i, (_, x) in enumerate(FREE)]


def test_the_sentences_of_the_table_stand_for_themselves(spark):
    got = scanned(spark, *(t for texts in licenses.SENTENCES.values() for t in texts))
    assert [r.sentence_ids for r in got] == [f"<{n}>" for n, texts in licenses.SENTENCES.items() for _ in texts]
    assert all(any(w in f" {k}" for w in licenses.TRIGGERS) for k in licenses.KNOWN if any(re.search(p, k) for p, _ in licenses.FORMS))


def test_notices_and_tags(spark):
    got = scanned(spark, *(t for t, _ in NOTICES))
    assert [r.licenses for r in got] == [x for _, x in NOTICES]
    assert all(r.unresolved == 0 for r in got)


def test_the_sql_agrees_on_notices(spark):
    texts = [t for t, _ in NOTICES + FREE] + [bsd(("BsdSource", "BsdBinary"), a, w) for a, w in (("\n\n", True), ("\n", False))] + ["a\n 1. b\n2. c. d", "", None, "a\n\n \nb. \n", "x. " * 50]
    db, documents = duckdb.connect(), pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    db.register("documents", documents)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(db.execute(licenses.oracle_sql()).fetchall()) == sorted(tuple(r) for r in licenses.scan(rows).collect())
