"""Licence scan: planted notices, paragraphs, edge rows."""

from conftest import SF
from text_cases import odd_documents, table

from kolekta.llm import licences

NOTICES = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT",
           "This work is licensed under the GNU General Public License, version 3.": "GPL",
           "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "All-rights-reserved"}


def test_query_finds_the_notices_of_the_documents(spark):
    got = {r.doc_id: r for r in licences.query(spark, SF).collect()}
    rows = table(spark, SF, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = sorted({f for notice, f in NOTICES.items() if notice in r.text})
        assert got[r.doc_id].families == want and (got[r.doc_id].licence in want if want else got[r.doc_id].licence is None)


def test_families_wrapped_text_and_unknown(spark):
    bsd = licences.TEMPLATES["BSD"][2].replace("forms,", "forms,\n  ").replace("permitted", "\npermitted")
    cases = {1: ("Some text first.\n" + bsd + "\nMore.", ["BSD"]),
             2: ("Licensed under the Foo Example Licence, all of it yours.", []),
             3: ("We discuss the MIT campus and its license plates.", []),
             4: ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC", "MIT"])}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    corpus = table(spark, SF, "documents")
    found = {r.doc_id: r.families for r in licences.scan(docs, licences.train(corpus)).collect()}
    assert found == {i: f for i, (_, f) in cases.items()}


def test_paragraphs():
    assert licences.paragraphs(b"one\ntwo.\n\nthree") == [b"one", b"two.", b"one two.", b"three"]
    assert licences.paragraphs(b"") == []


def test_odd_rows(spark):
    docs = odd_documents(spark)
    c = licences.train(docs)
    rows = licences.scan(docs, c).collect()
    assert len(rows) == 12 and all(r.families == [] and r.licence is None for r in rows)
    assert licences.scan(docs.limit(0), c).count() == 0
    assert licences.train(docs.limit(0)).names[0] == licences.UNKNOWN


def test_short_wordings_are_confirmed(spark):
    cases = {"All rights reserved.": ["All-rights-reserved"], "Copyright (c) 2019 Example Ltd. All rights reserved.": ["All-rights-reserved"],
             "Distributed under the MIT License.": ["MIT"], "SPDX-License-Identifier: MIT": ["MIT"],
             "Available under the Apache License.": ["Apache-2.0"], "// SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"],
             "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL"], "Covered by the GNU Lesser General Public License.": ["LGPL"],
             "SPDX-License-Identifier: CC-BY-SA-4.0": ["CC-BY-SA"], "Distributed under the BSD 3-Clause License.": ["BSD"],
             "All seats are reserved, and all rights of way end here.": [], "The permit is a license of the city.": []}
    corpus = table(spark, SF, "documents")
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: r.families for r in licences.scan(docs, licences.train(corpus)).collect()}
    assert {t: found[i] for i, t in enumerate(cases)} == cases


def test_query_finds_the_bare_reservation_in_the_documents(spark):
    got = {r.doc_id: r.families for r in licences.query(spark, SF).collect()}
    rows = [r for r in table(spark, SF, "documents").collect() if "All rights reserved." in r.text]
    assert rows and all("All-rights-reserved" in got[r.doc_id] for r in rows)
