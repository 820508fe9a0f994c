from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

#: Texts with what operators must bear: null, empty, white space, odd characters, long, repeated.
ODD = [None, "", " \n\t ", "one", "two words", "é漢😀 e\u0301 \u00a0x\u2003y", "a b c d e f g h i j k l " * 30, "x" * 50_000, "same text here for all of us to see again", "same text here for all of us to see again"]


@pytest.fixture()
def odd_docs(spark):
    """Odd texts, null and repeated ids, fully equal rows, and extra columns with clashing names."""
    rows = [(i, t, None if i == 3 else "en", "s" if i % 2 else None, 7, "mine", True) for i, t in enumerate(ODD)]
    rows += [(None, "null id text with several words in it to be judged", "en", "s", 7, "mine", True)] * 2 + [rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, p boolean")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.where("false")
