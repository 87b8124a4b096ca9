import re

from pyspark.sql import functions as F

from lumenfold.llm import license_scan as ls
from lumenfold.llm import queries
from lumenfold.llm.license_rules import RULES


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in ls.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    labels = set()
    for line in (text or "").lower().split("\n"):
        spans = [(m.start(), m.end(), p, n, label) for n, (label, p, key, regex) in enumerate(RULES) if key in line for m in re.finditer(regex, line, re.ASCII)]
        for s in spans:
            inside = [o for o in spans if o[0] <= s[0] and o[1] >= s[1] and (o[2] > s[2] or (o[2] == s[2] and (o[1] - o[0] > s[1] - s[0] or (o[:2] == s[:2] and o[3] < s[3]))))]
            if not inside:
                labels.add(s[4])
    return len(words), places, labels


def test_rules():
    ls.check_rules()
    assert len(RULES) >= 200
    stems = ls._stems([k for _, _, k, _ in RULES])
    assert all(any(s in k for s in stems) for _, _, k, _ in RULES)


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in ls.scan(df).collect():
        n, places, labels = brute(r.text)
        assert (r.n_words, [(p.start, p.label) for p in r.places], {d.label for d in r.detections}) == (n, places, labels), r.text[:200]


def test_documents_against_brute_force(spark, small):
    compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_detections(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: MIT-0", "the MIT License and the GNU General Public License v3",
        "see https://creativecommons.org/licenses/by-nc/4.0/ and CC BY-SA 4.0", "Mozilla Public License 2.0, BSD 3-Clause License", "GNU Lesser General Public License version 2.1 or (at your option) any later version",
        "mit license mit license\nMIT LICENSE", "permission is hereby granted, free of charge, to any person obtaining a copy", "plain words only", "All rights reserved. public domain",
    ]
    compare(spark, list(enumerate(texts)))
    got = {r.doc_id: {d.label for d in r.detections} for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[1] == {"gpl-2.0-or-later"} and got[2] == {"mit-0"} and {"cc-by-nc-4.0", "cc-by-sa-4.0"} <= got[4] and got[9] == set()


def test_defined_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "MIT license"), (3, "MIT license"), (None, "apache license"), (4, "general public license " * 3000), (5, "K mité license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("p")).withColumn("labels", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels, got[1].score) == (0, 0, None, "", "", 0.0)
    assert got[2] == got[2] and got[3].base_labels == "mit" and "mit" in got[3].labels.split(",") and got[None].base_labels == "apache"
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (3000, 0, 8997) and got[5].n_base == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    plan = ls.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert ls.scan(df.limit(0)).count() == 0


def test_statements_wrap_over_line_ends(spark):
    texts = [
        "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License, \n * version 2 of the License. */",
        "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted",
        "// Licensed under the\r\n//   Apache License, Version 2.0", "the MIT\n\nLicense stands apart", "SPDX-License-Identifier: MIT\nAll rights reserved.",
    ]
    got = {r.doc_id: {d.label for d in r.detections} for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {"gpl", "gpl-2.0"} & got[0] and any(x.startswith("gpl-2.0") for x in got[0]) and "isc" in got[1] and "apache-2.0" in got[2] and got[3] == set()
    one = ls.scan(spark.createDataFrame([(0, " ".join(t.replace(" * ", " ") for t in texts[0].split("\n")))], "doc_id long, text string")).first()
    assert {d.label for d in one.detections} == got[0] and got[4] == brute(texts[4])[2]
