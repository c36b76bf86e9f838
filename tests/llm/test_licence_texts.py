"""Licence texts and headers as they stand in files, near misses, and awkward rows."""

import pytest

from opsloom.llm import licenses

MIT = """MIT License

Copyright (c) 2019 Jane Doe and contributors

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD2 = """Copyright (c) 2001, Example Org.
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

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
APACHE = """/*
 * Copyright 2018 The Example Authors.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *      http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package org.example;
"""
GPL = """# Copyright (C) 2012  A. Hacker
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {n} of the License, or
# (at your option) any later version.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main() { return 0; }
"""
ISC = """Copyright (c) 2020, Someone <someone@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
FOUND = [
    ("MIT", MIT), ("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("Apache-2.0", APACHE), ("GPL-3.0", GPL.format(n=3)), ("GPL-2.0", GPL.format(n=2)),
    ("LGPL-3.0", GPL.format(n=3).replace("program", "library").replace("General Public", "Lesser General Public")),
    ("AGPL-3.0", GPL.format(n=3).replace("General Public", "Affero General Public")), ("MPL-2.0", MPL), ("ISC", ISC),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy.\n"),
    ("CC-BY-4.0", "<p>text text</p><p>This work is licensed under a Creative Commons Attribution 4.0 International License.</p>"),
    ("CC-BY-SA-4.0", "<footer>This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License</footer>"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "CC0 1.0 Universal\nPublic Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("Proprietary", "(c) 2021 Example GmbH. All rights reserved."), ("Proprietary", "<div>words before. Copyright © 2020 Foo Bar. All Rights Reserved.</div>"),
    ("MIT", "<h1>Project</h1><p>Released under the MIT License.</p>"),
]
MISSED = ["the cat sat on the mat", "<p>She studied at MIT and had a driving license for years before that.</p>",
          "The licence of the pub was lost, and the rights of the owner to reserve a table of version 2 with it.",
          "We sell software. Ask for permission to use the free version of our general public web page.", "", "<br>", "license"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for _, t in FOUND] + MISSED
    filler = [f"plain words number {i} of the software and the use of a source in binary forms with the names of conditions" for i in range(40)]
    rows = [(i, f"https://h/{i}/page.txt", t) for i, t in enumerate(texts + filler)]
    return [r["licence"] for r in sorted(licenses.scan(spark.createDataFrame(rows, "file_id long, url string, html string")).collect())]


@pytest.mark.parametrize("at", range(len(FOUND)))
def test_licence_is_found(found, at):
    assert found[at] == FOUND[at][0]


def test_near_misses_are_refused(found):
    assert found[len(FOUND):] == [None] * (len(found) - len(FOUND))


def test_licence_file_is_inherited(spark):
    rows = [(1, "https://h/p/LICENSE", MIT), (2, "https://h/p/src/a.c", "int x;"), (3, "https://h/p/lib/COPYING.txt", BSD3), (4, "https://h/p/lib/deep/b.c", "int y;"),
            (5, "https://h/other/c.c", "int z;"), (6, None, APACHE), (7, "https://h/p/d.c", None), (8, "https://h/p/long.txt", "word license " * 400_000), (8, "https://h/p/long.txt", "again")]
    df = spark.createDataFrame(rows, "file_id long, url string, html string").selectExpr("*", "'x' as block", "'y' as licence", "1 as n", "2 as term", "3 as path", "4 as text")
    got = {r["file_id"]: (r["licence"], r["found"]) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("BSD-3-Clause", "own"), 4: ("BSD-3-Clause", "inherited"), 5: (None, "none"),
                   6: ("Apache-2.0", "own"), 7: ("MIT", "inherited"), 8: ("MIT", "inherited")}
