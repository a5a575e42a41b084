"""Licences as files carry them: wrapped, in comments, with other subjects and spellings."""

import textwrap

import pytest
from pyspark.sql import functions as F

from ontoloom.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
TEXTS = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (GPL.format(":", "", 3), "GPL-3.0"), (GPL.format(";", "", 2), "GPL-2.0"), (GPL.format(":", "Affero ", 3), "AGPL-3.0"), (ISC, "ISC"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0")]
TEXTS += [("This dataset is licensed under CC BY 4.0", "CC-BY-4.0"), ("The code is released under the MIT License", "MIT"), ("Our tables are licensed under the GNU General Public Licence, version 3.", "GPL-3.0")]


@pytest.mark.parametrize("prefix", ["", " * ", "// ", "# ", ";; "])
def test_wrapped(spark, prefix):
    wrapped = [("\n".join(f"{prefix}{line}".rstrip() for part in t.split("\n") for line in textwrap.wrap(part, 60) or [""]), name) for t, name in TEXTS]
    docs = spark.createDataFrame([(i, f"int x\n\n{t}\n\nint y") for i, (t, _) in enumerate(wrapped)], "doc_id long, text string")
    assert sorted((r.doc_id, r.licence) for r in licences.scan(docs).collect()) == [(i, name) for i, (_, name) in enumerate(wrapped)]


def test_whole_rules_hold(spark):
    docs = spark.createDataFrame([(0, "\n".join(textwrap.wrap(APACHE.replace("\n\n", " "), 60)).replace(" at https", " at\n\n  https"))], "doc_id long, text string")
    assert {r.sid for r in licences.licence_sentences(docs).collect()} == {"apache2-name", "apache2-comply", "apache2-copy"}


def test_words_are_whole_and_sentences_apart(spark):
    docs = spark.createDataFrame([(0, "permit licensed under cc by 4 05"), (1, "not released under the summit license"), (2, "It is released under the MIT.\nLicense follows."), (3, "licensed under the\n\nmit license2")], "doc_id long, text string")
    assert licences.scan(docs).where(F.col("licence").isNotNull()).count() == 0
