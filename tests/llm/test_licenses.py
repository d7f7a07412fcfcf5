from conftest_llm import ODD

from sylva.llm import licenses


def scan(spark, *rows):
    return {r["path"]: r for r in licenses.scan(spark.createDataFrame(list(rows), "path string, text string")).collect()}


def test_every_template_is_its_own_licence(spark):
    got = scan(spark, *[(f"t{k}.txt", f"prose before\n{text}\nprose after") for k, (_, text) in enumerate(licenses.TEMPLATES)])
    wrong = {k: (name, got[f"t{k}.txt"]["licence"]) for k, (name, _) in enumerate(licenses.TEMPLATES) if got[f"t{k}.txt"]["licence"] != name and not licenses.re.search(licenses.TRIGGER, licenses.TEMPLATES[k][1]) is None}
    assert not wrong


def test_nearest_ancestor(spark):
    got = scan(
        spark, ("LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/d/y.py", "code"), ("a/b/z.py", "# SPDX-License-Identifier: MPL-2.0"),
        ("a/bc/w.py", "code"), ("a/b/COPYING", "Licensed under CC BY 4.0. license fee words that are of no template at all"), ("top.py", None),
    )
    assert (got["a/x.py"]["inherited"], got["a/x.py"]["from_dir"]) == ("MIT", "")
    assert (got["a/b/c/d/y.py"]["effective"], got["a/b/c/d/y.py"]["from_dir"]) == ("Apache-2.0", "a/b")
    assert (got["a/b/z.py"]["licence"], got["a/b/z.py"]["inherited"], got["a/b/z.py"]["effective"]) == ("MPL-2.0", None, "MPL-2.0")
    assert got["a/bc/w.py"]["from_dir"] == "" and got["top.py"]["effective"] == "MIT"


def test_odd_rows(spark):
    rows = [(f"d/{k}", t) for k, t in enumerate(ODD)] + [(None, "Released under the MIT License."), (None, None), ("d/0", None), ("LICENSE", None), ("e/LICENSE", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) and all(r["effective"] is None for r in got)
    assert licenses.scan(df.limit(0)).collect() == []


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MIT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD2 = """Copyright (c) 2024, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
BSD3 = BSD2 + """

3. Neither the name of Some Firm nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_wrapped_headers_and_whole_texts(spark):
    hashes = "\n".join(f"# {x}".rstrip() for x in GPL3.split("\n"))
    stars = "/*\n" + "\n".join(f" * {x}" for x in GPL3.replace("version 3", "version 2").split("\n")) + "\n */\nint x;"
    lesser = GPL3.replace("GNU General", "GNU Lesser General")
    apache = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0'
    rows = {
        "m/LICENSE": (MIT, "MIT"), "m/src/x.py": ("code", "MIT"), "b2/LICENSE": (BSD2, "BSD-2-Clause"), "b3/LICENSE": (BSD3, "BSD-3-Clause"), "g3.py": (hashes + "\n\nimport os", "GPL-3.0"), "g2.c": (stars, "GPL-2.0"),
        "l3.txt": (lesser, "LGPL-3.0"), "l2.txt": (lesser.replace("version 3", "version 2.1"), "LGPL-2.1"), "a.go": (apache, "Apache-2.0"), "t/LICENSE": ("MIT License", "MIT"), "mpl/LICENSE": ("Mozilla Public License Version 2.0\n====", "MPL-2.0"),
        "gnu/COPYING": ("  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "GPL-3.0"), "p.txt": ("Copyright 2024 Some Firm, Inc. All rights reserved.", "Proprietary"),
        "prose.txt": ("we do not use the MIT License here, as a public license would not fit", None),
    }
    got = scan(spark, *[(path, text) for path, (text, _) in rows.items()])
    assert {path: got[path]["effective"] for path in rows} == {path: want for path, (_, want) in rows.items()}


def test_whole_texts_by_cosine_alone(spark):
    texts = {
        "MIT": f"MIT License\n\nCopyright (c) 2024 Some Body\n\n{licenses._MIT}",
        "ISC": f"ISC License\n\nCopyright 2024, Some Body\n\n{licenses._ISC}",
        "BSD-2-Clause": f"Copyright (c) 2024, Some Body\nAll rights reserved.\n\n{licenses._BSD_HEAD}\n\n{licenses._BSD_TAIL}",
        "BSD-3-Clause": f"Copyright (c) 2024, Some Body\n\n{licenses._BSD_HEAD}\n\n{licenses._BSD_NAME}\n\n{licenses._BSD_TAIL}",
        "Apache-2.0": f"Copyright 2024 Some Body\n\n{licenses._APACHE_NOTICE}",
    }
    frame = spark.createDataFrame([(f"{k}/LICENSE", t) for k, t in texts.items()], "path string, text string")
    units = frame.withColumn("u", licenses.header_units()).selectExpr("path", "posexplode(u) as (unit, x)").where("not x.line").selectExpr("path", "unit", "x.text")
    best = {}
    for r in licenses.classify(units).collect():
        best[r["path"]] = max(best.get(r["path"], (0, "")), (r["score"], r["licence"]))
    assert {p: name for p, (_, name) in best.items()} == {f"{k}/LICENSE": k for k in texts}
    assert min(s for s, _ in best.values()) > 0.9


def test_clashing_columns_and_repeated_paths(spark):
    rows = [("a/x", "code", 1, "u"), ("a/x", "# SPDX-License-Identifier: MIT", 2, "v"), ("a/x", "code", 3, "w")]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string, unit int, licence string")).collect()
    assert [r["licence"] for r in got] == ["MIT"] * 3 and "unit" not in got[0].asDict()
