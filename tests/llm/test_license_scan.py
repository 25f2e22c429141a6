import math
import re

from millrace.llm import license_scan
from millrace.llm.license_scan import GAP, PHRASES, TEMPLATES


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(GAP, low) if w]


def brute(key, text, threshold=0.8):
    w, found, base = words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        found += at
        base |= {label} if at else set()
    more, best = set(), 0.0
    for label, template in TEMPLATES:
        t, run = set(words(template)), math.ceil(1.25 * len(words(template)))
        shared = max((len(t & set(w[i : i + run])) for i in range(len(w))), default=0)
        if shared >= math.ceil(threshold * len(t) - 1e-9):
            more.add(label)
            best = max(best, shared / len(t))
    return key, len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best


def order(rows):
    return sorted(map(repr, rows))


def test_odd_documents(odd, texts):
    assert order(tuple(r) for r in license_scan.license_scan(odd).collect()) == order(brute(*x) for x in texts)


def test_containment_at_the_threshold(spark):
    template = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    rows = [(n, f"x {' '.join(template[:n])} y\nother line") for n in range(len(template) + 1)]
    rows += [(50, "\n".join(template)), (51, " ".join(reversed(template)) + "\n" + " ".join(template))]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(tuple(r) for r in got) == order(brute(*x) for x in rows)
    assert {r["labels"] for r in got} >= {"", "mit"}


# Notices as public licenses wrap them.
WRAPPED = {
    "mit": "# Permission is hereby granted, free of charge, to any person obtaining\n# a copy of this software and associated documentation files (the\n# \"Software\"), to deal in the Software without restriction",
    "apache-2": "// you may not use this file except in compliance with\n// the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "   This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0.",
}


def test_wrapped_notices(spark):
    """Alone, amid much text that ends near the edge of a block, and too far apart to be one notice."""
    rows = [(i, t) for i, t in enumerate(WRAPPED.values())]
    rows += [(100 + n, f"{'word ' * n}{WRAPPED['bsd']} {'the of and to a ' * 50}") for n in range(0, 70, 3)]
    rows += [(500, (" x" * 9 + " ").join(words(WRAPPED["bsd"]))), (501, "the of and to a is in for " * 3000 + WRAPPED["gpl"])]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert order(tuple(r) for r in got) == order(brute(*x) for x in rows)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[i] for i in range(5)] == list(WRAPPED) and labels[500] == "" and labels[501] == "gpl" and {labels[100 + n] for n in range(0, 70, 3)} == {"bsd"}


def test_empty(empty):
    assert license_scan.license_scan(empty).count() == 0
