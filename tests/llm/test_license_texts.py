"""Entire licence texts, and texts that are equal but for their layout."""

import textwrap

from linework.llm import licenses
from linework.llm.license_texts import TEXTS


def test_entire_texts_and_layouts(spark):
    known = {}
    for name, text in TEXTS:
        known.setdefault(name, text)
    names = ["GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"]
    rows = [(n, f"Copyright (c) 2021 A. Person\n\n{known[n]}") for n in names]
    rows.append(("Apache-2.0", max((t for n, t in TEXTS if n == "Apache-2.0"), key=len)))
    bsd = known["BSD-3-Clause"]
    rows += [("BSD-3-Clause", textwrap.fill(bsd, w)) for w in (30, 40, 47, 60, 72)]
    at = bsd.index("copyright notice")
    rows.append(("BSD-3-Clause", bsd[:at] + "\n" + bsd[at:]))
    rows.append(("BSD-3-Clause", bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "   * ")))
    rows.append((None, bsd.replace("Redistributions of source code must retain the above copyright notice, ", "Redistributions of source code must retain ")))
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id long, want string, text string")
    got = licenses.scan(df).collect()
    assert [(r.doc_id, r.license_) for r in got if r.license_ != r.want] == []
