"""Licence scans by sentence rules.

A text is cut into sentences at . ! ? and at blank lines (single line ends and
comment prefixes are white space), which are normalised (lower case, letters and
digits only, one space between words, "license" also where "licence" is written).
Known licence sentences that stand in them as runs of whole words give ids.  The
ids of a document, in order, are matched against the licence rules: a rule holds
if its sentences occur in its order (others may stand between), and a rule whose
occurrence contains another rule's wins over it.

Every known sentence holds a word of KEYWORDS, so texts without any of them are
skipped without loss.  Null and empty texts have no licence; very long texts
are cut like others; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import own_columns, table

#: Licence sentences, normalised, by id.
SENTENCES = {
    "mit-name": ["released under the mit license", "licensed under the mit license", "the mit license", "mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "apache2-name": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "apache license version 2 0", "released under the apache license 2 0", "released under the apache license version 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "gpl3-name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl3-name": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"],
    "bsd-redistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-name": ["licensed under the bsd license", "released under the bsd license", "bsd 3 clause license", "bsd 2 clause license"],
    "mpl2-name": ["this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0"],
    "cc-by-4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa-4": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-4": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd-4": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc0": ["licensed under cc0 1 0", "cc0 1 0 universal public domain dedication"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "reserved": ["all rights reserved"],
}
#: Ordered rules: licence, class, sentence ids in order. An earlier rule that contains a later one's ids wins over it.
RULES = [
    ("BSD-3-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("MIT", "permissive", ["mit-name"]),
    ("Apache-2.0", "permissive", ["apache2-name", "apache2-comply", "apache2-copy"]),
    ("Apache-2.0", "permissive", ["apache2-name"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-warranty"]),
    ("GPL-3.0", "copyleft", ["gpl3-name"]),
    ("GPL-3.0", "copyleft", ["gpl-free"]),
    ("GPL-2.0", "copyleft", ["gpl2-name"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-name"]),
    ("BSD", "permissive", ["bsd-name"]),
    ("MPL-2.0", "copyleft", ["mpl2-name"]),
    ("CC-BY-4.0", "permissive", ["cc-by-4"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-4"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc-4"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd-4"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("Unlicense", "permissive", ["unlicense"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("Proprietary", "restricted", ["reserved"]),
]
KEYWORDS = ("licen", "copyright", "permi", "warrant", "redistribut", "domain", "right", "cc by", "cc0")
#: As SENTENCES and RULES, but not part of OP5_SQL.
MORE_SENTENCES = {
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "agpl3-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-name": ["gnu affero general public license version 3"],
}
MORE_RULES = [
    ("GPL-2.0", "copyleft", ["gpl2-free"]),
    ("AGPL-3.0", "copyleft", ["agpl3-free"]),
    ("AGPL-3.0", "copyleft", ["agpl3-name"]),
]
#: What stands before the text of a comment's line.
_PREFIX = r"(?m)^[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|<!--+|%+|>+|(?:dnl|rem)(?=\s))[ \t]*)+"
#: A sentence ends at . ! ? before white space or the end (but not in "v. 2.0"), or at a blank line, unless a link follows.
_END = r"(?<!\bv)[.!?]+(?=\s|$)|\n\s*\n(?!\s*<?https?:)"


def licence_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, at, sid: the known sentences of each document, in order of the sentence they stand in and their place there."""
    spark = docs.sparkSession
    known = [(s, i) for i, all_of in (SENTENCES | MORE_SENTENCES).items() for s in all_of]
    text = F.lower(F.regexp_replace("text", r"(?i)\bcc[-\s]?by\b", "cc by"))
    likely = docs.where(text.rlike("|".join(KEYWORDS)))
    lines = F.regexp_replace(F.regexp_replace(F.lower("text"), r"\r\n?", "\n"), _PREFIX, "")
    cut = likely.select("doc_id", F.posexplode(F.split(lines, _END, -1)).alias("pos", "s"))
    words = F.regexp_replace(F.regexp_replace("s", "[^a-z0-9]+", " "), "licence", "license")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(words, "\\bhttps www apache", "http www apache")), F.lit(" "))
    cut = cut.select("doc_id", "pos", words.alias("words")).where(F.col("words").rlike("|".join(KEYWORDS)))
    # The longest known sentence at each word; the look-ahead finds overlapping ones too.
    run = "(?<= )(?=(" + "|".join(sorted((s for s, _ in known), key=len, reverse=True)) + ") )"
    cut = cut.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("words", F.lit(run), 1)).alias("at", "sentence"))
    return cut.join(F.broadcast(spark.createDataFrame(known, "sentence string, sid string")), "sentence").select("doc_id", "pos", "at", "sid")  # a fixed table


def _first(sid: str) -> Column:
    return F.array_min(F.transform(F.filter("s", lambda x: x["sid"] == sid), lambda x: x["pos"]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, licence_class, first_sentence: one row a document and a licence it names."""
    found = licence_sentences(own_columns(docs, "doc_id", "text"))
    by_doc = found.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "at", "sid")).alias("s"))
    ordered = by_doc.select("doc_id", F.array_sort("s").alias("s"))
    ordered = ordered.select("doc_id", "s", F.concat(F.lit(" "), F.array_join(F.transform("s", lambda x: x["sid"]), " "), F.lit(" ")).alias("ids"))
    matches = []
    rules = RULES + MORE_RULES
    for number, (licence, kind, ids) in enumerate(rules):
        held = F.col("ids").rlike(" " + " (?:.* )?".join(ids) + " ")
        wins = [k for k in range(number) if set(ids) < set(rules[k][2])]
        first = _first(ids[0])
        row = F.struct(F.lit(licence).alias("licence"), F.lit(kind).alias("licence_class"), first.cast("long").alias("first_sentence"), F.lit(number).alias("rule"), F.array(*map(F.lit, wins)).cast("array<int>").alias("under"))
        matches.append(F.when(held, row))
    rows = ordered.select("doc_id", F.filter(F.array(*matches), lambda m: m.isNotNull()).alias("m"))
    numbers = F.transform("m", lambda m: m["rule"])
    rows = rows.select("doc_id", F.filter("m", lambda m: ~F.arrays_overlap(m["under"], numbers)).alias("m"))
    return rows.select("doc_id", F.inline("m")).groupBy("doc_id", "licence", "licence_class").agg(F.min("first_sentence").alias("first_sentence"))


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "licence", "licence_class")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Here rules of several sentences are matched step by step, by joins on ever later positions.
OP5_SQL = f"""
WITH RECURSIVE known(sentence, sid) AS (VALUES {_values((s, i) for i, all_of in SENTENCES.items() for s in all_of)}),
rules(rule, licence, licence_class, step, sid) AS (VALUES {_values((n, lic, kind, k, sid) for n, (lic, kind, ids) in enumerate(RULES) for k, sid in enumerate(ids))}),
under(rule, over_rule) AS (VALUES {_values([(n, k) for n in range(len(RULES)) for k in range(n) if set(RULES[n][2]) < set(RULES[k][2])])}),
parts AS (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '[.!?;:]+(\\s|$)', chr(10), 'g'), chr(10)) AS p FROM documents),
cut AS (SELECT doc_id, i AS pos, trim(regexp_replace(p[i], '[^a-z0-9]+', ' ', 'g')) AS sentence FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
found AS (SELECT c.doc_id, c.pos, k.sid FROM cut c JOIN known k USING (sentence)),
steps AS (
  SELECT f.doc_id, r.rule, 0 AS step, min(f.pos) AS first_pos, min(f.pos) AS pos FROM found f JOIN rules r ON f.sid = r.sid AND r.step = 0 GROUP BY 1, 2
  UNION ALL
  SELECT s.doc_id, s.rule, s.step + 1, s.first_pos, (SELECT min(f.pos) FROM found f JOIN rules r ON f.sid = r.sid WHERE r.rule = s.rule AND r.step = s.step + 1 AND f.doc_id = s.doc_id AND f.pos > s.pos)
  FROM steps s WHERE s.pos IS NOT NULL AND s.step + 1 < (SELECT count(*) FROM rules r WHERE r.rule = s.rule)
),
held AS (SELECT doc_id, rule, first_pos FROM steps s WHERE pos IS NOT NULL AND step + 1 = (SELECT count(*) FROM rules r WHERE r.rule = s.rule)),
won AS (SELECT h.* FROM held h WHERE NOT EXISTS (SELECT 1 FROM under u JOIN held o ON o.rule = u.over_rule AND o.doc_id = h.doc_id WHERE u.rule = h.rule))
SELECT w.doc_id, r.licence, r.licence_class FROM won w JOIN rules r ON r.rule = w.rule AND r.step = 0 GROUP BY 1, 2, 3
"""
