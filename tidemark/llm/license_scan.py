"""Operator 7: sentence-rule licence recognition with DataFrame functions.

A text is cut into pieces at line ends and at ``.``, ``!``, ``?``, ``;`` or ``:`` before
white space. Pieces are normalised (A-Z lower-cased, everything but a-z and 0-9 to one
space), so that comment signs vanish. A sentence is one or more whole pieces one after another
without a blank line between them (a wrapped line, or a sentence with ``v. 2`` or ``;`` in it)
that read as an entry of a table of known licence sentences; of those that begin at one piece
the longest counts. The identifiers that a text holds, in its order and without the sentences that
are unknown, are matched against rules: sequences of identifiers that must stand one after
another. Rules are tried in their order, and each takes the identifiers that it matches, so
that a later and less specific rule does not report them again.

The table is made of the notices below and of short forms (``licensed under the ...``, SPDX
lines) of a list of licences; both can be passed. Everything happens in the row; nothing is
shuffled.

Nulls and odd rows: a null or empty text has no licence; repeated rows each get theirs;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: public licence sentences, normalised, with their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "licensed under the apache license version 2 0 the license": "apache-grant",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
}

#: Fixed values: further opening sentences.
MORE_SENTENCES = {"this library is free software": "gpl-free"}

#: Fixed values: SPDX identifier, whether it is open (no copyleft, no restriction of use), and names, normalised.
LICENSES = [
    ("MIT", True, ("mit license", "mit")),
    ("Apache-2.0", True, ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0")),
    ("BSD-3-Clause", True, ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license")),
    ("BSD-2-Clause", True, ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    ("ISC", True, ("isc license",)),
    ("Zlib", True, ("zlib license",)),
    ("Unlicense", True, ("unlicense",)),
    ("BSL-1.0", True, ("boost software license version 1 0", "boost software license")),
    ("CC0-1.0", True, ("cc0 1 0", "creative commons zero v1 0 universal")),
    ("CC-BY-4.0", True, ("cc by 4 0", "creative commons attribution 4 0 international license")),
    ("CC-BY-SA-4.0", False, ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license")),
    ("CC-BY-NC-4.0", False, ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license")),
    ("GPL-2.0", False, ("gnu general public license version 2", "gnu gpl v2", "gpl v2", "gplv2")),
    ("GPL-3.0", False, ("gnu general public license version 3", "gnu gpl v3", "gpl v3", "gplv3")),
    ("LGPL-2.1", False, ("gnu lesser general public license version 2 1", "lgpl v2 1")),
    ("LGPL-3.0", False, ("gnu lesser general public license version 3", "lgpl v3")),
    ("AGPL-3.0", False, ("gnu affero general public license version 3", "agpl v3")),
    ("MPL-2.0", False, ("mozilla public license version 2 0", "mozilla public license v 2 0", "mpl 2 0")),
    ("EPL-2.0", False, ("eclipse public license version 2 0", "eclipse public license 2 0")),
]
#: Fixed values: how a notice names its licence.
FORMS = (
    "licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "distributed under the {}", "available under the {}",
    "this project is licensed under the {}", "this project is released under the {}", "this software is licensed under the {}", "this software is released under the {}",
    "this code is licensed under the {}", "this work is licensed under the {}", "this work is licensed under a {}", "this file is licensed under the {}",
    "this program is licensed under the {}", "this library is licensed under the {}", "license {}",
)  # fmt: skip
_SUFFIXES = {"GPL": ("", " only", " or later"), "LGP": ("", " only", " or later"), "AGP": ("", " only", " or later")}


def short_sentences(licenses: list = LICENSES) -> dict[str, str]:
    """The short forms of all names, and the SPDX lines."""
    found = {}
    for spdx, _, names in licenses:
        for name in names:
            found |= {form.format(name): f"{spdx}-short" for form in FORMS}
        for suffix in _SUFFIXES.get(spdx[:3], ("",)):
            found["spdx license identifier " + spdx.lower().replace("-", " ").replace(".", " ") + suffix] = f"{spdx}-spdx"
    return found


#: Fixed values: licence, whether it is open, and the identifiers in their order; the first rules are the most specific.
NOTICE_RULES = [
    ("BSD-3-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", True, ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", True, ("mit-grant", "mit-notice")),
    ("Apache-2.0", True, ("apache-grant", "apache-comply", "apache-copy")),
    ("GPL-3.0", False, ("gpl-free", "gpl3-terms")),
    ("GPL-2.0", False, ("gpl-free", "gpl2-terms")),
    ("LGPL-2.1", False, ("gpl-free", "lgpl-terms")),
    ("MPL-2.0", False, ("mpl-grant",)),
    ("ISC", True, ("isc-grant",)),
]


def rules_of(licenses: list = LICENSES) -> list[tuple[str, bool, tuple[str, ...]]]:
    """The rules of whole notices, then those of the short forms."""
    return NOTICE_RULES + [(spdx, is_open, (f"{spdx}-{kind}",)) for spdx, is_open, _ in licenses for kind in ("short", "spdx")]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUT, JUNK = r"[.!?;:]+([ \t\n\f\r]+|$)", "[^a-z0-9]+"


def sentences_of(licenses: list = LICENSES) -> dict[str, str]:
    return short_sentences(licenses) | MORE_SENTENCES | SENTENCES


def _lists(rules: list) -> list[tuple[str, bool]]:
    """The licences in the order of their first rules."""
    return list(dict.fromkeys((name, is_open) for name, is_open, _ in rules))


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    pieces = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), CUT, "\n")
    pieces = F.trim(F.regexp_replace(F.regexp_replace(pieces, r"[^a-z0-9\n]+", " "), " ?\n ?", "\n"))
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    heads: dict[str, list[str]] = {}
    for s in sorted(sentences, key=len, reverse=True):
        head, _, rest = s.partition(" ")
        heads.setdefault(head, []).append(rest)
    # sentences that begin with one word stand together, longest first, so that most pieces are left after one look
    forms = "|".join(f"{head}[ \\n](?:" + "|".join(r.replace(" ", r"[ \n]") for r in rests) + ")" for head, rests in heads.items())
    found = F.regexp_extract_all(pieces, F.lit(rf"(?<![^\n])(?:{forms})(?![^\n])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "\n", " ")))


def scan_licenses(docs: DataFrame, licenses: list = LICENSES, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """Per document: doc_id, sentence_ids and licenses (comma-joined), n_licenses, restricted."""
    sentences, rules = sentences or sentences_of(licenses), rules or rules_of(licenses)
    found = docs.select("doc_id", sentence_ids(F.col("text"), sentences).alias("ids"))
    marks = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("sequence")) for name, _, ids in rules])
    start = F.struct(marks.alias("left"), F.array().cast("array<string>").alias("names"))

    def take(held: Column, rule: Column) -> Column:
        """A rule takes what it matches and leaves a mark, so that what stood apart stays apart."""
        hit = F.contains(held["left"], rule["sequence"])
        return F.struct(F.replace(held["left"], rule["sequence"], F.lit("<>")).alias("left"), F.when(hit, F.array_append(held["names"], rule["name"])).otherwise(held["names"]).alias("names"))

    held = found.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, F.aggregate(table, start, take)["names"]).otherwise(F.array().cast("array<string>")).alias("licenses"))
    closed = F.array(*[F.lit(name) for name, is_open in _lists(rules) if not is_open])
    unique = F.array_distinct("licenses")
    return held.select("doc_id", "sentence_ids", F.array_join(unique, ",").alias("licenses"), F.size(unique).cast("long").alias("n_licenses"), F.arrays_overlap(unique, closed).alias("restricted"))


def oracle() -> str:
    """The scan of ``documents`` in DuckDB's SQL: known sentences by lookups of runs of pieces in a table,
    rules by a fold over their list."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences_of().items())
    rules = ", ".join(f"{{'name': '{n}', 'shut': {str(not o).lower()}, 's': '{''.join(f'<{i}>' for i in ids)}'}}" for n, o, ids in rules_of())
    return rf"""WITH known(s, id) AS (VALUES {known}),
p AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.!?;:]+([ 	

]+|$)', chr(10), 'g'), '[^a-z0-9
]+', ' ', 'g'), ' ?
 ?', chr(10), 'g')), chr(10)) AS x FROM documents),
e AS (SELECT r, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM p),
w AS (SELECT r, i, list(s) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 69 FOLLOWING) AS l FROM e),
m AS (SELECT r, i, i + n - 1 AS j, known.id FROM (SELECT r, i, n, array_to_string(l[1:n], ' ') AS s FROM w, range(1, 71) t(n) WHERE n <= len(l) AND len(list_filter(l[1:n], lambda y: y = '')) = 0) q JOIN known ON known.s = q.s QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY n DESC) = 1),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.r = m.r AND b.i < m.i AND b.j >= m.i)),
d AS (SELECT r, string_agg(id, ',' ORDER BY i) AS ids, string_agg('<' || id || '>', '' ORDER BY i) AS marks FROM k GROUP BY r),
f AS (SELECT r, ids, list_reduce([{rules}], lambda a, b: {{'name': CASE WHEN contains(a.s, b.s) THEN a.name || ',' || b.name ELSE a.name END, 'shut': a.shut OR (b.shut AND contains(a.s, b.s)), 's': replace(a.s, b.s, '<>')}}, {{'name': '', 'shut': false, 's': marks}}) AS o FROM d),
g AS (SELECT r, ids, o.shut AS shut, list_filter(string_split(o.name, ','), lambda y: y <> '') AS names FROM f)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(list_filter(names, lambda y, n: NOT list_contains(names[1:n - 1], y)), ','), '') AS licenses,
  CAST(coalesce(len(list_distinct(names)), 0) AS BIGINT) AS n_licenses, coalesce(shut, false) AS restricted FROM p LEFT JOIN g ON g.r = p.r"""
