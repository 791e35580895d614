"""Whole licence files and the copyright lines in front of them."""

import os

import pytest
from pyspark.sql import functions as F

from leadspark.llm import licenses

FILES = "/usr/share/common-licenses"
NAMES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1",
         "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "Artistic": "Artistic-1.0-Perl"}


def found(spark, texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.text_license for r in sorted(got, key=lambda r: r.doc_id)]


@pytest.mark.skipif(not os.path.isdir(FILES), reason="no licence files on this machine")
def test_whole_licence_files(spark):
    """As they are, in one line, with other case and quotes, and without what follows the terms; a changed word is no licence."""
    texts = {name: open(f"{FILES}/{f}", encoding="utf-8").read() for f, name in NAMES.items()}
    assert found(spark, texts.values()) == list(texts)
    assert found(spark, [" ".join(t.split()).replace('"', "“") for n, t in texts.items() if n in ("MPL-2.0", "CC0-1.0")]) == ["CC0-1.0", "MPL-2.0"]
    end = "END OF TERMS AND CONDITIONS"
    assert found(spark, [t.split(end)[0] + end for t in texts.values() if end in t]) == [n for n, t in texts.items() if end in t]
    assert found(spark, [t.replace("software", "hardware", 1) for n, t in texts.items() if n in ("GPL-3.0", "MPL-2.0")]) == [None, None]


def test_copyright_lines(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))
    lines = ["Copyright (c) 2020 Ann", "Copyright The Go Authors", "Copyright <year> <holder>", "Copyright Acme Inc. 2020", "COPYRIGHT (C) 1999", "# Copyright [yyyy] [name]", "© Ann", "copyright 2001-2004 bob",
             "Copyright Ärzte e.V.", "Copyright (c) 2020 Ann\nAll rights reserved.", "(c) 2020 Ann", "Copyright \"Ann\" 2020"]
    assert found(spark, [f"{line}\n\n{mit}" for line in lines]) == ["MIT"] * len(lines)
    assert found(spark, [f"MIT License\n\n{line}\n\n{mit}" for line in lines]) == ["MIT"] * len(lines)
    bsd = next(t for n, t in licenses.KNOWN if n == "BSD-3-Clause" and t.startswith("Redistribution"))
    wrapped = bsd.replace("THE COPYRIGHT", "THE\nCOPYRIGHT").replace("above copyright", "above\n  copyright")
    assert wrapped != bsd and found(spark, [wrapped, wrapped.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "Copyright 2020, X\n" + wrapped.upper().replace("COPYRIGHT NOTICE", "copyright notice")]) == ["BSD-3-Clause"] * 3
    assert found(spark, ["Copyright The Go Authors", "Licensed under the Apache License, Version 2.0 (the \"License\");", None]) == [None, "Apache-2.0", None]


def test_known_texts_are_their_licences(spark):
    assert found(spark, [t for _, t in licenses.KNOWN]) == [n for n, _ in licenses.KNOWN]
    assert licenses.known_digests(spark).groupBy("digest").count().filter(F.col("count") > 1).count() == 0
