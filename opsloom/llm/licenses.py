"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories. DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import stored, table

# What licences put into files and into their own texts, by SPDX name: statements, file headers, paragraphs.
TEMPLATES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution 4.0 International, CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, under the CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("ISC", "ISC License"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# Words that count for nothing, and those of which a block must hold one to be compared.
STOP = ["a", "and", "are", "http", "https", "in", "is", "of", "or", "the", "this", "to", "www"]
ANCHORS = ["agpl", "apache", "bsd", "cc", "cc0", "copyleft", "copyright", "domain", "gpl", "isc", "lgpl", "licence", "license", "licensed", "licenses", "mit",
           "mozilla", "permission", "redistribute", "redistribution", "redistributions", "released", "rights", "software"]
#: Least cosine of a block to a template.
LEAST = 0.7
#: Blocks end at tags and at empty lines.
_CUT, _WORD = "<[^>]*>|\\n[ \\t\\r]*\\n", "[a-z0-9]+"
#: Every licence has its own holders: what stands between a copyright sign and the end of its line or sentence counts for nothing.
_HOLDER = "(?i)(copyright|\\(c\\)|©)[ \\t]*(\\(c\\)|©)?[ \\t]*[0-9\\[{][^\\n.<]*"
#: A reservation of rights is a statement of its own, wherever it stands.
_RESERVED = "(?i)all rights reserved"
#: File names that make a file the licence file of its directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.\-_].*)?$"


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), lambda w: ~w.isin(*STOP))


def blocks_of(text: Column) -> Column:
    """The stretches between tags and empty lines, without holders, reservations apart."""
    apart = F.regexp_replace(text, _RESERVED, "\n\nall rights reserved\n\n")
    return F.split(F.regexp_replace(apart, _HOLDER, " "), _CUT)


def _template_terms() -> list[tuple[int, str, str, int]]:
    """template, licence, term and its count in the template."""
    out = []
    for i, (name, text) in enumerate(TEMPLATES):
        words = [w for w in re.findall(_WORD, text.lower()) if w not in STOP]
        out += [(i, name, w, n) for w, n in sorted(Counter(words).items())]
    return out


def path_of(url: Column) -> Column:
    """Host and path: no scheme, query, fragment or closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[A-Za-z]+://", ""), "[?#].*$", ""), "/+$", "")


def _idf(blocks: Column, df: Column) -> Column:
    """Binary digits of blocks / df, a whole number, so that sums are exact in every engine."""
    return F.length(F.bin(F.floor(blocks / df).cast("long"))).cast("long")


def licence_blocks(files: DataFrame, body: str = "html", least: float = LEAST) -> DataFrame:
    """file_id, block, header, licence, n, score: licences with a template that a block is near, cosine at least ``least``.

    Blocks are the stretches between tags and empty lines; all of every text
    is read. The first block that has a word is the file's header. A term
    weighs its count times its idf over all blocks of all files; terms of no
    template only lengthen a block's vector, each with the greatest idf.
    Blocks without a word of ANCHORS are not compared. Template terms are
    picked inside the rows, so that only their counts are shuffled.
    """
    spark = files.sparkSession
    model = _template_terms()
    known = sorted({w for _, _, w, _ in model})
    vocabulary = spark.createDataFrame(model, "template int, licence string, term string, t long")
    split = files.select("file_id", F.posexplode_outer(blocks_of(F.coalesce(F.col(body), F.lit("")))).alias("block", "text"))
    blocks = split.select("file_id", "block", terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    picked = blocks.select("file_id", "block", F.size("terms").cast("long").alias("n"), F.filter("terms", lambda w: w.isin(*known)).alias("own"))
    # both are small beside the texts, which are read three times and no more
    asked = picked.where(F.exists("own", lambda w: w.isin(*ANCHORS))).select("file_id", "block", "n", F.explode("own").alias("term"))
    hits = stored(asked.groupBy("file_id", "block", "term").agg(F.count("*").alias("k"), F.first("n").alias("n")), "licence-terms")
    heads = stored(blocks.groupBy("file_id").agg(F.min("block").alias("head"), F.count("*").alias("blocks")), "licence-heads")
    df = stored(picked.select(F.explode(F.array_distinct("own")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "licence-df")
    total = heads.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"))
    # one row per template term, whatever the corpus
    weights = vocabulary.select("term").distinct().join(df, "term", "left").join(F.broadcast(total)).select(
        "term", "blocks", _idf(F.col("blocks"), F.coalesce("df", F.lit(1))).alias("idf"))
    square = F.col("idf") * F.col("idf")
    length = vocabulary.join(weights, "term").groupBy("template", "licence").agg(F.sum(F.col("t") * F.col("t") * square).alias("model_sq"))
    weighed = hits.join(F.broadcast(weights), "term")
    rest = (F.max("n") - F.sum("k")) * F.max(_idf(F.col("blocks"), F.lit(1))) * F.max(_idf(F.col("blocks"), F.lit(1)))
    own = weighed.groupBy("file_id", "block").agg(F.max("n").alias("n"), (F.sum(F.col("k") * F.col("k") * square) + rest).alias("block_sq"))
    dots = (weighed.select("file_id", "block", "term", "k", "idf").join(F.broadcast(vocabulary.drop("licence")), "term")
            .groupBy("file_id", "block", "template").agg(F.sum(F.col("k") * F.col("t") * square).cast("double").alias("dot")))
    scored = (dots.join(own, ["file_id", "block"]).join(F.broadcast(length), "template")
              .withColumn("score", F.sqrt(F.col("dot") * F.col("dot") / (F.col("block_sq").cast("double") * F.col("model_sq").cast("double"))))
              .where(F.col("score") >= least))
    nearest = scored.groupBy("file_id", "block", "licence").agg(F.max("score").alias("score"), F.max("n").alias("n"))
    return nearest.join(heads, "file_id").select("file_id", "block", (F.col("block") == F.col("head")).alias("header"), "licence", "n", "score")


def scan(files: DataFrame, body: str = "html", least: float = LEAST) -> DataFrame:
    """file_id, path, licence, score, found, place for every file.

    found is ``own`` where blocks of the file state a licence: the one that the
    most words are in blocks of, then that of the best score, the earlier
    block, the first by name; so a text that several licences share goes to
    the one that has the rest of the file too. It is ``inherited`` where the nearest ancestor
    directory with a licence file gives it, else ``none``. A licence file is
    one whose header is a licence statement, or whose name says so; of several
    in a directory the best score counts, then the licence's name. place is
    the directory that gave it.

    ``files`` has file_id, url and the body. Null body: no statement of its
    own. Null url: no directory. Repeated rows are files each, if their ids
    differ; rows of one id are read as one file. Empty table: no rows.
    """
    named = files.select("file_id", path_of(F.col("url")).alias("path")).groupBy("file_id").agg(F.min("path").alias("path"))
    stated = stored(licence_blocks(files, body, least), "licences")
    sums = stated.groupBy("file_id", "licence").agg(F.sum("n").alias("n"), F.max("score").alias("score"), F.min("block").alias("block"))
    first = W.partitionBy("file_id").orderBy(F.desc("n"), F.desc("score"), "block", "licence")
    own = (sums.withColumn("r", F.row_number().over(first)).where("r = 1").select("file_id", "licence", "score"))
    heads = stated.groupBy("file_id").agg(F.max("header").alias("header"))
    known = named.join(own, "file_id", "left").join(heads, "file_id", "left")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    is_file = F.col("licence").isNotNull() & (F.col("header") | F.element_at(parts, -1).rlike(LICENCE_FILE))
    given = (known.where(is_file & (F.size(parts) > 1)).select(folder.alias("place"), F.col("licence").alias("given"), F.col("score").alias("s"))
             .groupBy("place").agg(F.min(F.struct((-F.col("s")).alias("s"), "given")).alias("g")).select("place", "g.given", (-F.col("g.s")).alias("s")))
    steps = F.when(F.col("path").isNotNull() & (F.size(parts) > 1), F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    above = (known.where(F.col("licence").isNull()).select("file_id", parts.alias("parts"), F.explode(steps).alias("depth"))
             .select("file_id", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("place")))
    nearest = above.join(given, "place").groupBy("file_id").agg(F.max(F.struct("depth", "place", "given", "s")).alias("a"))
    both = known.join(nearest, "file_id", "left")
    found = F.when(F.col("licence").isNotNull(), "own").when(F.col("a").isNotNull(), "inherited").otherwise("none")
    return both.select("file_id", "path", F.coalesce("licence", "a.given").alias("licence"), F.coalesce("score", "a.s").alias("score"),
                       found.alias("found"), F.when(F.col("licence").isNull(), F.col("a.place")).alias("place"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumnRenamed("page_id", "file_id")
    return scan(pages).withColumnRenamed("file_id", "page_id")


def _sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"({i}, '{name}', '{w}', cast({n} as bigint))" for i, name, w, n in _template_terms())
    known = listed(sorted({w for _, _, w, _ in _template_terms()}))
    return f"""
with v(template, licence, term, t) as (values {values}),
cut as (select page_id, string_split_regex(regexp_replace(regexp_replace(coalesce(html, ''), '{_RESERVED}', chr(10) || chr(10) || 'all rights reserved' || chr(10) || chr(10), 'g'),
          '{_HOLDER}', ' ', 'g'), '{_CUT}') as parts from pages),
b as (select page_id, block, list_filter(regexp_extract_all(lower(txt), '{_WORD}'), lambda w: not list_contains({listed(STOP)}, w)) as terms
      from (select page_id, unnest(parts) as txt, unnest(range(len(parts))) as block from cut)),
bl as (select page_id, block, len(terms) as n, list_filter(terms, lambda w: list_contains({known}, w)) as own from b where len(terms) > 0),
w as (select page_id, block, n, unnest(own) as term from bl where list_has_any(own, {listed(ANCHORS)})),
h as (select page_id, block, term, count(*) as k, any_value(n) as n from w group by 1, 2, 3),
n as (select count(*) as blocks from bl),
d as (select term, count(*) as df from (select unnest(list_distinct(own)) as term from bl) group by 1),
i as (select term, blocks, length(bin(blocks // coalesce(df, 1))) as idf
      from (select distinct term from v) left join d using (term) cross join n),
ms as (select template, licence, sum(t * t * idf * idf) as model_sq from v join i using (term) group by 1, 2),
bs as (select page_id, block, max(n) as n, sum(k * k * idf * idf) + (max(n) - sum(k)) * max(length(bin(blocks))) * max(length(bin(blocks))) as block_sq
       from h join i using (term) group by 1, 2),
ds as (select page_id, block, template, cast(sum(k * t * idf * idf) as double) as dot from h join i using (term) join v using (term) group by 1, 2, 3),
sc as (select page_id, block, licence, n, sqrt(dot * dot / (cast(block_sq as double) * cast(model_sq as double))) as score
       from ds join bs using (page_id, block) join ms using (template)),
nb as (select page_id, block, licence, max(score) as score, max(n) as n from sc where score >= {LEAST} group by 1, 2, 3),
hd as (select page_id, min(block) as head from bl group by 1),
fl as (select page_id, licence, sum(n) as n, max(score) as score, min(block) as block from nb group by 1, 2),
own as (select * from (select *, row_number() over (partition by page_id order by n desc, score desc, block, licence) as r2 from fl) where r2 = 1),
he as (select page_id, bool_or(block = head) as header from nb join hd using (page_id) group by 1),
p as (select page_id, min(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', ''), '/+$', '')) as path
      from pages group by 1),
k as (select p.page_id, path, string_split(path, '/') as parts, licence, score, header
      from p left join own using (page_id) left join he using (page_id)),
g as (select place, given, s from (
        select array_to_string(parts[1:len(parts) - 1], '/') as place, licence as given, score as s,
               row_number() over (partition by array_to_string(parts[1:len(parts) - 1], '/') order by score desc, licence) as r
        from k where licence is not null and len(parts) > 1
                 and (header or regexp_matches(parts[len(parts)], '^(licen[cs]e|copying|notice)([.\\-_].*)?$', 'i'))) where r = 1),
a as (select page_id, depth, array_to_string(parts[1:depth], '/') as place
      from (select page_id, parts, unnest(range(1, len(parts))) as depth from k where licence is null)),
na as (select * from (select a.page_id, a.place, given, s, row_number() over (partition by a.page_id order by depth desc) as r
                      from a join g using (place)) where r = 1)
select k.page_id, path, coalesce(licence, given) as licence, coalesce(score, s) as score,
       case when licence is not null then 'own' when given is not null then 'inherited' else 'none' end as found,
       case when licence is null then na.place end as place
from k left join na using (page_id)
"""


OP4_SQL = _sql()
