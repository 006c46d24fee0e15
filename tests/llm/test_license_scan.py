import pytest

import brute
from thermalframe.llm.license_scan import BadExpression, evaluate, expression_after, postfix, scan_licenses

TEXTS = [
    "Released under the MIT License.", "licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "cc-by CC BY  cc\nby",
    "GNU General Public\tLicense, version 3; gnu GENERAL public license mit license apache license", "mitlicense mit licenses",
    "amit license", "cc by cc by", "// SPDX-License-Identifier: MIT\ncode", "# spdx-license-identifier: (MIT OR Apache-2.0) AND BSD-3-Clause",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */ int x;", "SPDX-License-Identifier: AND MIT",
    "SPDX-License-Identifier:", "é mit license É", "mit license é" * 2, "\x00mit\x00license\x7f",
]


def test_equals_plain_version(spark, docs, texts):
    rows = list(texts) + [(500 + i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (500, TEXTS[0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, score int").repartition(3)
    got = sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted(((i, brute.license_base(t)) for i, t in rows), key=str)


@pytest.mark.parametrize("expression, labels, free", [
    ("MIT", {"mit"}, True), ("MIT OR GPL-3.0", {"mit", "gpl-3.0"}, True), ("MIT AND GPL-3.0", {"mit", "gpl-3.0"}, False),
    ("GPL-2.0 OR MIT AND Apache-2.0", {"gpl-2.0", "mit", "apache-2.0"}, True),
    ("(GPL-2.0 OR MIT) AND GPL-3.0", {"gpl-2.0", "mit", "gpl-3.0"}, False),
    ("Apache-2.0 WITH LLVM-exception OR GPL-2.0", {"apache-2.0 with llvm-exception", "gpl-2.0"}, True)])
def test_expressions(expression, labels, free):
    assert evaluate(expression) == (labels, free)


def test_precedence():
    assert postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]


@pytest.mark.parametrize("bad", ["", "and", "a and", "a b", "(a", "a)", "()", "a with (b or c)", "(a and b) with c"])
def test_bad_expressions(bad):
    with pytest.raises(BadExpression):
        evaluate(bad)


def test_expression_ends_where_it_ends():
    assert expression_after(" MIT OR Apache-2.0 */ int x") == "MIT OR Apache-2.0"
    assert expression_after("MIT. Some words") == "MIT"
    assert expression_after("MIT\nAND BSD") == "MIT"


def test_labels(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert got[1].labels == "apache,apache-2.0" and got[1].score == 0.9
    assert got[8].labels == "mit" and got[8].score == 1 and got[8].permissive
    assert got[9].labels == "apache-2.0,bsd-3-clause,mit" and got[9].permissive
    assert got[10].expressions == "GPL-2.0-or-later WITH Classpath-exception-2.0" and got[10].permissive is False
    assert got[11].labels == "" and got[11].score == 0


def test_long_expressions_are_read_to_their_end(spark):
    names = [f"licenseref-{i:04d}" for i in range(600)]
    line = " AND ".join(names)
    assert len(line) > 4096 and evaluate(line)[0] == set(names)
    texts = [f"é SPDX-License-Identifier: {line}\ncode", f"SPDX-License-Identifier: ({line}) OR MIT */",
             "SPDX-License-Identifier:" + " " * 200_000 + "MIT\n", "SPDX-License-Identifier:" + " " * 200_000,
             "SPDX-License-Identifier: MIT " * 20_000, f"SPDX-License-Identifier:\u00a0MIT é\nSPDX-License-Identifier: {line}"]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == ",".join(names) and got[0].expressions == line and got[0].score == 1
    assert got[1].labels == ",".join([*names, "mit"]) and got[1].permissive
    assert got[2].labels == "mit" and got[3].labels == "" and got[3].score == 0
    assert got[4].expressions == ";".join(["MIT"] * 20_000)
    assert got[5].labels == ",".join([*names, "mit"])


def test_empty(empty):
    assert scan_licenses(empty).count() == 0


@pytest.mark.parametrize("word, licence", [
    ("mit", True), ("gpl-2.0", True), ("gpl-2.0-only", True), ("gpl-2.0-or-later", True), ("gpl-2.0+", True), ("apache-2.0", True),
    ("cc-by-nc-sa-4.0", True), ("bsd-3-clause", True), ("bsd-2-clause-patent", True), ("licenseref-acme", True), ("odc-by-1.0", True),
    ("hello", False), ("tag", False), ("gpl", False), ("gpl-9.0", False), ("apache", False), ("cc-by", False), ("mit+", False), ("", False), ("-", False)])
def test_known_identifiers(word, licence):
    from thermalframe.llm.license_scan import known
    assert known(word) == licence


@pytest.mark.parametrize("bad", ["hello", "MIT OR tag", "MIT WITH Apache-2.0", "LLVM-exception", "MIT AND LLVM-exception", "LLVM-exception WITH MIT"])
def test_unknown_words_are_refused(bad):
    with pytest.raises(BadExpression):
        evaluate(bad)


def test_prose_behind_a_tag_gives_no_label(spark):
    texts = ["SPDX-License-Identifier: hello world", "see SPDX-License-Identifier: tag in the header", "spdx-license-identifier: MIT hello",
             "SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier:MITSPDX-License-Identifier:ISC"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(df).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("mit", 1.0), 3: ("apache-2.0,mit", 1.0), 4: ("isc,mit", 1.0)}


def test_tags_without_a_gap_take_time_by_length():
    import time

    from thermalframe.llm.license_scan import automata, scan
    start = time.perf_counter()
    scan(b"SPDX-License-Identifier:" * 40_000, *automata())
    assert time.perf_counter() - start < 10
