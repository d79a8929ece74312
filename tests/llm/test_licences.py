"""Licence texts and notices as they are usually written, wrapped and not, and the same in SQL."""

import os
import re
import textwrap

import duckdb
import pandas as pd
import pytest

from lumenfold.llm import licenses

WHOLE = "/usr/share/common-licenses"
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE HOLDERS BE LIABLE.'
SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."
ENDORSE = "Neither the name of Some Company Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: made by some."
GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; {version}\n\nThis program comes WITHOUT ANY WARRANTY. See the GNU {kind}General Public License for more details.\n\nYou should have received a copy of the GNU {kind}General Public License along with this program."
NOTICES = {
    "mit": ('MIT License\n\nCopyright (c) 2020 Foo Inc. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n' + AS_IS, "MIT"),
    "mit without name": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n\nThe above copyright notice and this permission notice shall be included in all copies of the Software.', "MIT"),
    "isc": ("Copyright (c) 2011, Foo\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears.\n\n" + AS_IS, "ISC"),
    "bsd 2": ("\n\n".join(["Copyright 2001 Foo.", SOURCE, BINARY, AS_IS]), "BSD-2-Clause"),
    "bsd 3": ("\n\n".join(["Copyright 2001 Foo. All rights reserved.", SOURCE, BINARY, "3. " + ENDORSE, AS_IS]), "BSD-3-Clause"),
    "bsd 4": ("\n\n".join([SOURCE, BINARY, ADVERT, "4. " + ENDORSE, AS_IS]), "BSD-4-Clause"),
    "bsd 2 with another licence inside": ("\n\n".join([SOURCE, "Licensed under the Apache License, Version 2.0.", BINARY, AS_IS]), "Apache-2.0,BSD-2-Clause"),
    "gpl 3 or later": (GNU.format(kind="", version="either version 3 of the License, or (at your option) any later version."), "GPL-3.0-or-later"),
    "gpl 2 or later": (GNU.format(kind="", version="either version 2 of the License, or (at your option) any later version."), "GPL-2.0-or-later"),
    "gpl 2": (GNU.format(kind="", version="version 2 of the License."), "GPL-2.0"),
    "gpl 3": (GNU.format(kind="", version="version 3 only."), "GPL-3.0"),
    "lgpl": (GNU.format(kind="Lesser ", version="either version 2.1 of the License, or (at your option) any later version."), "LGPL-2.1-or-later"),
    "agpl": (GNU.format(kind="Affero ", version="either version 3 of the License, or (at your option) any later version."), "AGPL-3.0-or-later"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed, you can obtain one.", "MPL-2.0"),
    "apache title": ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"),
    "gpl title": ("GNU GENERAL PUBLIC LICENSE\n   Version 3", "GPL-3.0"),
    "identifier": ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
    "or-later identifier": ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    "plus": ("GPLv3+", "GPL-3.0-or-later"),
    "two": ("Dual licensed under the MIT license and GPL version 2 or later.", "GPL-2.0-or-later,MIT"),
    "commons": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "CC-BY-NC-SA-4.0"),
    "a number elsewhere": ("the GPL is nice and I have 2 cats", "GPL-unversioned"),
    "commented": ("# Redistribution and use in source and binary forms is permitted.\n#\n# Redistributions of source code must\n# retain the notice.\n#\n# Redistributions in binary form\n# must reproduce it.", "BSD-2-Clause"),
    "nothing": ("A simple example of permission and attribution in prose.", ""),
}


def wrapped(text):
    return "\n\n".join(textwrap.fill(p, 72) for p in text.split("\n\n"))


def found(spark, rows):
    """doc_id -> licences by Spark, after SQL has given the same identifiers, licences and status."""
    got = {r["doc_id"]: (",".join(r["sentence_ids"]), ",".join(r["licenses"]), r["status"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert got == {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, sentence_ids, licenses, status FROM ({licenses.oracle()})").fetchall()}
    return {k: v[1] for k, v in got.items()}


def test_notices(spark):
    rows = [(name, text) for name, (text, _) in NOTICES.items()]
    want = {name: licence for name, (_, licence) in NOTICES.items()}
    assert found(spark, rows) == want
    again = [(name, wrapped(text)) for name, text in rows if name not in ("identifier", "commented")]
    assert found(spark, again) == {name: want[name] for name, _ in again}


@pytest.mark.skipif(not os.path.isdir(WHOLE), reason="no licence texts on this machine")
def test_whole_texts(spark):
    """Whole texts name themselves alone, although they mention others of their family."""
    want = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for name in want:
        if os.path.exists(f"{WHOLE}/{name}"):
            with open(f"{WHOLE}/{name}", errors="replace") as f:
                text = f.read()
            paragraphs = [re.sub(r"\s+", " ", p) for p in re.split(r"\n\s*\n", text)]
            rows += [(name, text), (name + " in long lines", "\n\n".join(paragraphs)), (name + " then MIT", text + "\n\n" + NOTICES["mit"][0])]
    got = found(spark, rows)
    for name, _ in rows:
        base = name.split(" ")[0]
        assert got[name] == (",".join(sorted([want[base], "MIT"])) if name.endswith("MIT") else want[base]), name
