"""License scans, with DataFrame functions only.

Units are the lines of a text that speak of licensing (``TRIGGER``), wherever they stand, and its header block: the
paragraphs that speak of licensing, together, as running words; a licence file (``LICENCE_FILE`` by name) is a unit as a
whole, too. Units and templates (short notices, wrapped headers, whole licence texts) are sparse TF-IDF vectors, IDF being
counted over the templates; a unit's licence is the template of highest cosine, from ``LEAST`` on. A file's own licence
is that of its header block or whole where these reach ``LEAST``: a single line of a wrapped header fits several
licences. Else, as in a header amid other text, ``PASSAGES`` are scored by containment: the share of their three-word
runs that the file's paragraphs hold (the one with most runs held wins, so that a text goes to the licence it quotes most
of). Then its best line counts, and last a line that is a title or a short notice (``NOTICES``) as a whole. A directory's licence is that of the best licence file in it, and files without one of their own inherit
from the nearest directory above that has one: directories are few against files, so each distinct directory meets its
ancestors by an equi join on path prefixes, and files then join on their directory.

The term weights (``weights()``, some thousand rows) are fixed by the templates, not by the data; only they are
broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and successors."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."""
_GNU_SHORT = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_NAMES = (
    ("GPL-3.0", "GNU General Public License", "3"),
    ("GPL-2.0", "GNU General Public License", "2"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)
# Notices, headers and whole texts of common licences, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and modify it under the terms of the GNU General Public License version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright has been waived. CC0 1.0 Universal public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-2-Clause", _BSD_HEAD),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAME}"),
    ("ISC", _ISC),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MPL-2.0", _MPL_NOTICE),
    *((spdx, form.format(name, version)) for spdx, name, version in _GNU_NAMES for form in (_GNU_NOTICE, _GNU_SHORT)),
)
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|public domain|hereby granted|redistribut"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"
LEAST = 0.75

_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
# Passages of licence texts and of wrapped headers, as running words; those of one row are counted together.
PASSAGES = (
    ("MIT", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",)),
    ("Apache-2.0", ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",)),
    ("Apache-2.0", ("apache license version 2 0 january 2004",)),
    ("GPL-3.0", (_GNU.format("general public license", "3"),)),
    ("GPL-3.0", ("gnu general public license version 3 29 june 2007",)),
    ("GPL-2.0", (_GNU.format("general public license", "2"),)),
    ("GPL-2.0", ("gnu general public license version 2 june 1991",)),
    ("LGPL-3.0", (_GNU.format("lesser general public license", "3"),)),
    ("LGPL-3.0", ("gnu lesser general public license version 3 29 june 2007",)),
    ("LGPL-2.1", (_GNU.format("lesser general public license", "2 1"),)),
    ("LGPL-2.1", ("gnu lesser general public license version 2 1 february 1999",)),
    ("AGPL-3.0", (_GNU.format("affero general public license", "3"),)),
    ("AGPL-3.0", ("gnu affero general public license version 3 19 november 2007",)),
    ("MPL-2.0", ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",)),
    ("BSD-2-Clause", (_BSD,)),
    ("BSD-3-Clause", (_BSD, "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("ISC", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",)),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",)),
)
STRETCH = TRIGGER + "|endorse or"
# Titles and short notices, as patterns of a line's words; the first that fits the whole line counts.
NOTICES = (
    ("MIT", "mit license( mit)?"),
    ("Apache-2.0", "apache license (version |v )?2 0"),
    ("LGPL-3.0", "gnu lesser general public license (version |v )?v?3( 0)?"),
    ("AGPL-3.0", "gnu affero general public license (version |v )?v?3( 0)?"),
    ("GPL-3.0", "gnu general public license (version |v )?v?3( 0)?"),
    ("GPL-2.0", "gnu general public license (version |v )?v?2( 0)?"),
    ("MPL-2.0", "mozilla public license (version |v )?2 0"),
    ("BSD-3-Clause", "bsd 3 clause (new or revised )?license"),
    ("BSD-2-Clause", "bsd 2 clause (simplified )?license"),
    ("ISC", "isc license( isc)?"),
    ("CC-BY-4.0", "creative commons attribution 4 0 international( public)? license"),
    ("CC-BY-SA-4.0", "creative commons attribution sharealike 4 0 international( public)? license"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4 0 international( public)? license"),
)
_NOTICE = "^(copyright .*)?((this|the) (file|work|project|software|program|code|library) is )?(licen[cs]ed |released |distributed )?(under )?(the )?(terms of )?(the )?{}( or( any)? later( version)?)?( copyright .*)?( all rights reserved)?$"
_RESERVED = "^(c )?copyright .*all rights reserved$"


def _terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def weights() -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """IDF by term, IDF of a term in no template, and rows ``(term, template, licence, weight)`` of unit vectors."""
    n = len(TEMPLATES)
    df = Counter(t for _, text in TEMPLATES for t in set(_terms(text)))
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        own = {t: c * idf[t] for t, c in Counter(_terms(text)).items()}
        norm = math.sqrt(sum(v * v for v in own.values()))
        rows += [(t, k, name, v / norm) for t, v in sorted(own.items())]
    return idf, math.log(1 + n) + 1, rows


def header_units():
    """The array of a file's units ``(line, text)``: the header block, the whole of a licence file, and every line that
    speaks of licensing. Needs path and text."""
    name = F.substring_index("path", "/", -1)
    unit = lambda line, text: F.struct(F.lit(line).alias("line"), text.alias("text"))
    none = F.array().cast("array<struct<line: boolean, text: string>>")
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(TRIGGER)), lambda x: unit(True, x))
    whole = F.when(F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)), F.array(unit(False, F.col("text")))).otherwise(none)
    return F.when(F.col("text").rlike(TRIGGER), F.concat(F.array(unit(False, F.array_join(_paragraphs(), " "))), whole, lines)).otherwise(none)


def classify(unit_rows: DataFrame) -> DataFrame:
    """``path, unit, licence, score``: the template of highest cosine (ties: the licence's name), of units that share a
    term with one. Cosines are rounded to six places so that ties do not hang on the order of sums."""
    spark = unit_rows.sparkSession
    idf, unseen, rows = weights()
    words = spark.createDataFrame([(t, v) for t, v in sorted(idf.items())], "term string, idf double")
    vectors = spark.createDataFrame(rows, "term string, template int, licence string, weight double")
    # Units are dealt out as texts, which are smaller than their terms; all that follows then stays where it is.
    dealt = unit_rows.select("path", "unit", "text").repartition("path", "unit")
    counted = dealt.select("path", "unit", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).groupBy("path", "unit", "term").agg(F.count("*").alias("tf"))
    tfidf = counted.join(F.broadcast(words), "term", "left").select("path", "unit", "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("v"))
    norms = tfidf.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = tfidf.join(F.broadcast(vectors), "term").groupBy("path", "unit", "template", "licence").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["path", "unit"]).select("path", "unit", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("path", "unit").agg(F.min(F.struct(-F.col("score"), "licence")).alias("x"))
    return best.select("path", "unit", F.col("x.licence").alias("licence"), (-F.col("x.col1")).alias("score"))


def _paragraphs():
    """The paragraphs (up to a line without letter or digit) that speak of licensing."""
    return F.filter(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda x: x.rlike(STRETCH))


def stretches():
    """The paragraphs of a text that speak of licensing; none where the whole does not. Needs text."""
    return F.when(F.col("text").rlike(TRIGGER), _paragraphs()).otherwise(F.array().cast("array<string>"))


def _words(text: str):
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def passages(rows: DataFrame) -> DataFrame:
    """``path, licence, score`` of the passage that a file's ``stretches`` hold most of, for files that hold LEAST of one."""
    runs = lambda text: {tuple(text.split()[k : k + 3]) for k in range(len(text.split()) - 2)}
    held = [(" ".join(r), k, name, len(all_)) for k, (name, texts) in enumerate(PASSAGES) for all_ in [set().union(*map(runs, texts))] for r in sorted(all_)]
    known = rows.sparkSession.createDataFrame(held, "run string, passage int, licence string, size int")
    w = rows.select("path", F.explode("stretches").alias("text")).select("path", F.split(_words("text"), " ").alias("w")).where(F.size("w") > 2)
    found = w.select("path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda k: F.array_join(F.slice("w", k, 3), " ")))).alias("run")).join(F.broadcast(known), "run")
    share = found.select("path", "run", "passage", "licence", "size").distinct().groupBy("path", "passage", "licence", "size").agg(F.count("*").alias("n")).withColumn("score", F.round(F.col("n") / F.col("size"), 6))
    best = share.where(F.col("score") >= LEAST).groupBy("path").agg(F.min(F.struct(-F.col("n"), -F.col("score"), "licence", "score")).alias("x"))
    return best.select("path", F.col("x.licence").alias("licence"), F.col("x.score").alias("score"))


def notices(unit_rows: DataFrame) -> DataFrame:
    """``path, licence, score`` (1) of the files with a line that is a title or a short notice; reserved rights last."""
    place = F.coalesce(*[F.when(F.col("w").rlike(_NOTICE.format(f"({pattern})")), k) for k, (_, pattern) in enumerate(NOTICES)], F.when(F.col("w").rlike(_RESERVED), len(NOTICES)))
    names = F.array(*[F.lit(name) for name, _ in NOTICES], F.lit("Proprietary"))
    first = unit_rows.select("path", _words("text").alias("w")).select("path", place.alias("k")).where("k is not null").groupBy("path").agg(F.min("k").alias("k"))
    return first.select("path", names[F.col("k")].alias("licence"), F.lit(1.0).alias("score"))


def directory_of(path: str = "path"):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame) -> DataFrame:
    """One row per row of files(path, text): ``path, licence, score`` of its own (null without one), ``inherited`` and
    ``from_dir`` (the nearest directory above, its own first, that has a licence; null where the file has its own or
    there is none) and ``effective``.

    Null and empty texts have no licence of their own; a null path has no directory and inherits nothing. Rows that
    repeat a path count as one file with the units of all, and each is returned. Long texts are read whole. Of licences
    that score the same the first by name wins. Only path and text are read, so other columns cannot clash. An empty
    table gives no rows.
    """
    # Each text is read once: what the later steps need of it is written as paths, header units and paragraphs.
    slim = Scratch(files.select("path", header_units().alias("units"), stretches().alias("stretches")), "headers").df
    files = slim
    units = slim.where("path is not null").select("path", F.posexplode("units").alias("unit", "u")).select("path", F.when(F.col("u.line"), F.col("unit")).otherwise(-1 - F.col("unit")).alias("unit"), "u.text")
    found = classify(units).where(F.col("score") >= LEAST).select(F.when(F.col("unit") < 0, 0).otherwise(2).alias("rank"), "path", "licence", "score")
    found = found.unionByName(passages(slim.where("path is not null")).withColumn("rank", F.lit(1))).unionByName(notices(units.where("unit >= 0")).withColumn("rank", F.lit(3)))
    own = found.groupBy("path").agg(F.min(F.struct("rank", -F.col("score"), "licence")).alias("x")).select("path", F.col("x.licence").alias("licence"), (-F.col("x.col2")).alias("score"))
    own = Scratch(own, "licences").df
    declared = own.where(F.substring_index("path", "/", -1).rlike(LICENCE_FILE)).groupBy(directory_of().alias("above")).agg(F.min(F.struct(-F.col("score"), "licence")).alias("x"))
    declared = declared.select("above", F.col("x.licence").alias("inherited"))
    dirs = files.where("path is not null").select(directory_of().alias("dir")).distinct()
    parts = F.split("dir", "/")
    climbs = dirs.select("dir", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")), F.when(F.col("dir") != "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("above"))
    nearest = climbs.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above"), "above", "inherited")).alias("x"))
    nearest = nearest.select("dir", F.col("x.above").alias("from_dir"), F.col("x.inherited").alias("inherited"))
    rows = files.select("path", directory_of().alias("dir")).join(own, "path", "left").join(nearest, "dir", "left")
    bare = F.col("licence").isNull()
    return rows.select("path", "licence", "score", F.when(bare, F.col("inherited")).alias("inherited"), F.when(bare, F.col("from_dir")).alias("from_dir"), F.coalesce("licence", "inherited").alias("effective"))
