"""Licence texts in other dress are found, others aren't."""

from attestor.llm import licences


def test_scan(spark):
    mit = licences.MIT
    dressed = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,").replace("\n", "\r\n") + "\n"
    rows = [(1, mit), (2, dressed), (3, mit + " extra"), (4, None), (5, ""), (None, licences.ISC), (2, dressed), (6, "  spdx-license-identifier:  mit "), (7, "SPDX-Licence-Identifier: MIT")]
    found = sorted(((r.doc_id or 0, r.licence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == [(0, "ISC"), (1, "MIT"), (2, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "SPDX-MIT"), (7, "SPDX-MIT")]
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
