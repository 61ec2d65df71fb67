"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Units of a file are compared with templates of licences: statements, usual headers, whole bodies, titles
of long licence files and SPDX lines.  Units are lines with a licence cue, comment blocks of two lines or more (runs of lines that begin
with a comment sign) that hold a cue, and of files named like licence files the whole text and the title (the first three lines with text).  Words are
weighed by their frequency in all texts, vectors are sparse, and a file takes the licence of the template
with the largest cosine of all its units, if that is ``MIN_COSINE`` or more.  A file without a licence of
its own takes that of the licence file (``LICENSE``, ``COPYING``, ...) in the
nearest directory above it.  DataFrame and SQL functions only.

Defined results: null and empty texts have no licence of their own but can
inherit; a file with a null path is in no directory and inherits nothing; equal
cosines go to the kind of unit in the order above, the unit, and the licence's name that come first; of licence files in one directory the first path
speaks; repeated rows get equal results, a row each; texts of any length are read whole; an empty table gives an empty table.  Only
the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.llm.scratch import stage

MIN_COSINE = 0.6
CUE = r"(?i)licen[cs]e|copyright|copyleft|spdx|public domain|all rights reserved|\bgpl|\bwarrant"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice|copyright)([._-][a-z0-9.]+)*$"

COMMENT = r"^[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)"

# fixed values: statements by which public licences are named
STATEMENTS = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright, all rights reserved."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
)
# fixed values: titles of licence files
TITLES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
# fixed values: usual headers and the bodies of short licences
BODIES = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.
If not, see https://www.gnu.org/licenses/."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Lesser General Public License for more details."""),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Lesser General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT", """MIT License. Copyright (c) year holder. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License. Copyright (c) year holder. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) year, holder. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Copyright (c) year, holder. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"""),
)


def _spdx(license: str) -> str:
    """The SPDX line of a licence; its name counts four times and its version thrice, so a line on another licence stays below the least cosine."""
    parts = license.replace("-", " ").split()
    return "SPDX-License-Identifier: " + " ".join(p for i, p in enumerate(parts) for _ in range(4 if i == 0 else 3 if p[0].isdigit() else 1))


TEMPLATES = (*STATEMENTS, *TITLES, *BODIES, *((name, _spdx(name)) for name, _ in STATEMENTS if name not in ("Proprietary",)))
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def _words(column: Column) -> Column:
    """Lower-case words; a point stays before a number."""
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def _templates(spark: SparkSession) -> DataFrame:
    """(template, license, word, tf) of the templates; a fixed table."""
    return (spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, statement string")
            .select("template", "license", F.explode(_words(F.col("statement"))).alias("word"))
            .groupBy("template", "license", "word").agg(F.count(F.lit(1)).alias("tf")))


def word_weights(files: DataFrame) -> tuple[DataFrame, Column]:
    """(word, idf) of the templates' words over all texts, and the weight of any other word."""
    vocabulary = sorted({r.word for r in _templates(files.sparkSession).collect()})        # a fixed table
    known = F.array(*[F.lit(w) for w in vocabulary])
    seen = (files.where(F.col("text").isNotNull())
            .select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(_words(F.col("text")), known))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    # one row per template word, and one (the empty word) for the number of texts
    df = {r.word: r.df for r in seen.collect()}
    n = df.pop("", 0)
    spark = files.sparkSession
    table = spark.createDataFrame([(w, df.get(w, 0), n) for w in vocabulary], "word string, df long, n long")
    return (table.select("word", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf")),
            F.log(F.lit(1.0 + n)) + 1.0)


def units(files: DataFrame) -> DataFrame:
    """(key, kind, unit, s): lines with a cue (0), comment blocks with one (1), whole licence files (2) and their titles (3).

    ``files`` has key, text and ``named``, whether the name is that of a licence file.
    """
    lines = F.split("text", "\n")
    # lines without a comment sign become empty, so that runs of the others stand between empty lines
    comments = F.regexp_replace("text", f"(?m)^(?!{COMMENT[1:]}).*$", "")
    blocks = F.filter(F.split(comments, "\n\n+"), lambda b: b.rlike(CUE) & F.trim(b, F.lit("\n")).contains("\n"))
    title = F.array_join(F.slice(F.filter(lines, lambda s: s.rlike(r"[^ \t\r]")), 1, 3), "\n")
    cue = F.col("text").rlike(CUE)
    hits = F.when(cue, F.filter(lines, lambda s: s.rlike(CUE)))
    parts = [_of_kind(kind, c) for kind, c in enumerate((hits, F.when(cue, blocks), F.when(F.col("named"), F.array("text")), F.when(F.col("named"), F.array(title))))]
    return files.where(cue | (F.col("named") & F.col("text").isNotNull())).select("key", F.explode(F.concat(*parts)).alias("u")).select("key", "u.*")


def _of_kind(kind: int, strings: Column) -> Column:
    """(kind, unit, s) of each of the strings; none where there is no array."""
    return F.transform(F.coalesce(strings, F.array().cast("array<string>")),
                       lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), s.alias("s")))


def own_licenses(files: DataFrame) -> DataFrame:
    """(key, license, score) of the files with a licence of their own; ``files`` has key, text and ``named``."""
    weights, other = word_weights(files)
    template = _templates(files.sparkSession).join(weights, "word").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = template.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("template_norm"))
    # a fixed table of some hundred words for each template
    template = F.broadcast(template.join(norms, "template").select("word", "template", "license", (F.col("weight") / F.col("template_norm")).alias("t")))
    # few lines hold a cue: written once, so that the texts are searched once
    found = stage(units(files))
    words = (found.select("key", "kind", "unit", F.explode(_words(F.col("s"))).alias("word"))
             .groupBy("key", "kind", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
             .join(F.broadcast(weights), "word", "left")
             .withColumn("weight", F.col("tf") * F.coalesce("idf", other)))
    norm = words.groupBy("key", "kind", "unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = (words.join(template, "word").groupBy("key", "kind", "unit", "template", "license").agg(F.sum(F.col("weight") * F.col("t")).alias("dot")))
    cosine = (dot.join(norm, ["key", "kind", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
              .where(F.col("score") >= MIN_COSINE))
    # the largest score; among equal ones the first kind of unit, the first unit, then the first name
    best = F.min(F.struct((-F.col("score")).alias("s"), "kind", "unit", "license", "score")).alias("b")
    return cosine.groupBy("key").agg(best).select("key", "b.license", "b.score")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """key, path, license, score, origin (own, inherited or null) and license_path of every row.

    ``files`` has key, path and text; equal keys are taken for equal files.
    """
    files = files.select("key", "path", "text")
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    own = own_licenses(files.select("key", "text", named.alias("named")))
    marked = stage(files.select("key", "path", directory(F.col("path")).alias("dir")).join(own, "key", "left"))
    # at most one licence file speaks for a directory: the one whose path comes first
    given = (marked.where(F.col("license").isNotNull() & F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE))
             .groupBy("dir").agg(F.min(F.struct("path", "license", "score")).alias("g")))
    given = given.select(F.col("dir").alias("above"), F.col("g.license").alias("l"), F.col("g.score").alias("sc"), F.col("g.path").alias("lp"))
    # every directory once, with those above it; the longest path that has a licence file is the nearest
    parts = F.split("dir", "/")
    dirs = (marked.select("dir").where(F.col("dir").isNotNull()).distinct()
            .select("dir", F.explode(F.array_union(F.array(F.lit("")),        # the root, of relative paths too
                                                   F.transform(F.sequence(F.lit(1), F.size(parts)),
                                                               lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("above")))
    nearest = (dirs.join(given, "above").groupBy("dir")
               .agg(F.max_by(F.struct("l", "sc", "lp"), F.length("above")).alias("i")))
    found = marked.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return found.select(
        "key", "path", F.when(mine, F.col("license")).otherwise(F.col("i.l")).alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("i.sc")).alias("score"),
        F.when(mine, "own").when(F.col("i.l").isNotNull(), "inherited").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("i.lp")).alias("license_path"))
