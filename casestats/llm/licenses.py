"""License scans by sentence-rule recognition.

Texts are cut into sentences and normalised; a known licence sentence gets its identifier.
The identifiers of a text, in order, are matched against licence rules: a rule is a sequence
of identifiers that must follow each other (other sentences may stand between them). A rule
whose licence is also found by a longer rule containing it adds nothing.

Licence texts are usually wrapped and longer than the stored sentences. So a known sentence
may also go over single line ends (a blank line, or one without letters and digits, ends it),
and over `:` and `;`, which may start and end one as well; the longest known sentence at a
place counts. `TEXTS` holds the full sentences of standard texts and notices. `n_sentences`
counts the pieces between line ends and marks.

NULL and empty texts have no sentences and no licences. Repeated sentences repeat their
identifier; repeated rows get equal results.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casestats.llm.common import fold_ascii

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files the software to deal in the software "
    "without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied":
        "mit-warranty",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-condition",
    "you may obtain a copy of the license at": "apache-2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms "
    "of the gnu general public license": "gpl-grant",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used "
    "to endorse or promote products": "bsd-name",
    "this source code form is subject to the terms of the mozilla public license v 2 0":
        "mpl-2-notice",
    "permission to use copy modify and or distribute this software for any purpose with or "
    "without fee is hereby granted": "isc-grant",
}

# Licence, identifiers in order.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("Apache-2.0", ["apache-2-notice", "apache-2-condition", "apache-2-copy"]),
    ("GPL-3.0", ["gpl-3-notice"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl-2-later"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("ISC", ["isc-grant", "mit-warranty"]),
]
# A rule that holds makes the shorter rule of the other licence void.
VOIDS = {"BSD-3-Clause": "BSD-2-Clause"}


def _gpl_texts() -> dict[str, str]:
    """Notices and titles of the GNU licences: kind, version, and whether later ones hold."""
    out = {}
    kinds = [
        ("gnu general public license", "gpl", {"2": "2", "3": "3"}),
        ("gnu library general public license", "lgpl", {"2": "2"}),
        ("gnu lesser general public license", "lgpl", {"2": "2", "2 1": "2.1", "3": "3"}),
        ("gnu affero general public license", "agpl", {"3": "3"}),
    ]
    heads = ["", *(f"this {x} is free software " for x in ("program", "library", "file"))]
    ends = ("", " as published by the free software foundation")
    for (name, kind, versions), head in product(kinds, heads):
        grant = f"{head}you can redistribute it and or modify it under the terms of the {name}"
        for words, version in versions.items():
            for either, end in product(("either ", ""), ends):
                text = f"{grant}{end} {either}version {words}"
                for of in (" of the license", ""):
                    out[f"{text}{of} or at your option any later version"] = f"{kind}-{version}-or-later-notice"
                    if not either:
                        out[f"{text}{of}"] = f"{kind}-{version}-only-notice"
            out[f"{grant} version {words} as published by the free software foundation"] = f"{kind}-{version}-only-notice"
    for name, kind, words, date in (
        ("gnu general public license", "gpl-2", "2", "june 1991"),
        ("gnu general public license", "gpl-3", "3", "29 june 2007"),
        ("gnu library general public license", "lgpl-2", "2", "june 1991"),
        ("gnu lesser general public license", "lgpl-2.1", "2 1", "february 1999"),
        ("gnu lesser general public license", "lgpl-3", "3", "29 june 2007"),
        ("gnu affero general public license", "agpl-3", "3", "19 november 2007"),
    ):
        out[f"{name} version {words} {date}"] = f"{kind}-title"
    return out


_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions"
)
_PERMIT = "for any purpose with or without fee is hereby granted"
_APPEAR = "the above copyright notice and this permission notice appear in all copies"
_FROM = "may be used to endorse or promote products derived from this software without specific prior written permission"

# Normalised full sentences of standard texts and notices, with common variants;
# `*` stands for one to twelve words (names).
TEXTS = {
    _MIT_GRANT: "mit-grant",
    _MIT_GRANT.removesuffix(" subject to the following conditions"): "mit-0-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be "
    "included in all copies or substantial portions of the software": "mit-condition",
    **{
        "the software is provided as is without warranty of any kind express or implied including "
        f"but not limited to the warranties of merchantability fitness for a particular purpose and {x}":
            "mit-warranty"
        for x in ("noninfringement", "non infringement")
    },
    "apache license version 2 0 january 2004": "apache-2-title",
    "licensed under the apache license version 2 0 the license": "apache-2-notice",
    **{
        f"{x} licenses this file to you under the apache license version 2 0 the license": "apache-2-notice"
        for x in ("the asf", "the apache software foundation")
    },
    **{
        f"redistributions of source code must retain the above copyright {x} this list of conditions "
        f"and the following disclaimer{y}": "bsd-source"
        for x in ("notice", "notices") for y in ("", " and")
    },
    **{
        f"redistributions in binary form must reproduce the above copyright {x} this list of conditions "
        "and the following disclaimer in the documentation and or other materials provided with the "
        f"distribution{y}": "bsd-binary"
        for x in ("notice", "notices") for y in ("", " and")
    },
    "all advertising materials mentioning features or use of this software must display the following "
    "acknowledgement": "bsd-advertising",
    **{
        f"{x} {_FROM}": "bsd-name"
        for x in (
            "neither the name of * nor the names of its contributors",
            "neither the name of * nor the names of their contributors",
            "neither the names of * nor the names of its contributors",
            "neither the name of * nor the names of contributors",
            "neither the name of *",
            "neither the names of *",
        )
    },
    f"the name of the author {_FROM.replace('may', 'may not')}": "bsd-name",
    f"the names of * {_FROM.replace('may', 'may not')}": "bsd-name",
    f"the name of * {_FROM.replace('may', 'may not')}": "bsd-name",
    **{
        f"permission to use copy modify {x} this software {_PERMIT} provided that {_APPEAR}": "isc-grant-full"
        for x in ("and or distribute", "and distribute")
    },
    **{
        f"the software is provided as is and {x} all warranties with regard to this software including "
        "all implied warranties of merchantability and fitness": "isc-warranty"
        for x in ("the author disclaims", "the authors disclaim", "* disclaims", "* disclaim")
    },
    "mozilla public license version 2 0": "mpl-2-title",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in "
    "source code form or as a compiled binary for any purpose commercial or non commercial and by "
    "any means": "unlicense-grant",
    **{
        f"{work}licensed under {a}creative commons {name} 4 0 international license": f"cc-{code}-4-notice"
        for work in ("", "this work is ") for a in ("", "a ", "the ")
        for name, code in (
            ("attribution", "by"), ("attribution noncommercial", "by-nc"),
            ("attribution sharealike", "by-sa"),
        )
    },
    **_gpl_texts(),
}

# Licence, identifiers of `TEXTS` and `SENTENCES` in order.
TEXT_RULES = [
    ("MIT-0", ["mit-0-grant"]),
    ("Apache-2.0", ["apache-2-title"]),
    ("MPL-2.0", ["mpl-2-title"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name"]),
    ("ISC", ["isc-grant-full"]),
    ("ISC", ["isc-grant-full", "isc-warranty"]),
    ("0BSD", ["isc-grant", "isc-warranty"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Unlicense", ["unlicense-domain", "unlicense-grant"]),
    *(
        (f"{kind.upper()}-{version}{'' if '.' in version else '.0'}{end}", [f"{kind}-{version}{end}-notice"])
        for kind, versions in (("gpl", "2 3"), ("lgpl", "2 2.1 3"), ("agpl", "3"))
        for version in versions.split() for end in ("-only", "-or-later")
    ),
    *(
        (f"{kind.upper()}-{version}{'' if '.' in version else '.0'}", [f"{kind}-{version}-title"])
        for kind, versions in (("gpl", "2 3"), ("lgpl", "2 2.1 3"), ("agpl", "3"))
        for version in versions.split()
    ),
]
TEXT_VOIDS = [("BSD-4-Clause", "BSD-3-Clause")]

# Ends a sentence: a line end, or a full stop, mark or semicolon before a blank or line end.
ENDS = r"\n+|[.!?;](?=\s|$)"


def sentences(text: Column) -> Column:
    """Normalised sentences: letters a-z and digits, single blanks, none at the ends."""
    parts = F.split(fold_ascii(text), ENDS)
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.array_remove(plain, "")


# Every known sentence contains one of these; texts without them aren't matched against any.
HINTS = ("license", "software", "redistribution", "endorse")
# Marks in a normalised text: `|` ends a sentence, `/` may end one or stand within.
GAP = " (?:/ )*"


def known_pattern() -> str:
    """Any known sentence between two marks; of those with one beginning the longest."""
    tree: dict = {}
    for sentence in {**SENTENCES, **TEXTS}:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        slot = f"[a-z0-9]+(?:{GAP}[a-z0-9]+){{0,11}}?"
        parts = [
            (slot if word == "*" else word) + "".join(rest(node[word]))
            for word in sorted(node, key=lambda w: (w == "*", w))
            if word
        ]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    def rest(node: dict):
        if set(node) != {""}:
            more = GAP + pattern(node)
            yield f"(?:{more})?" if "" in node else more

    return f"(?<=[|/] ){pattern(tree)}(?= [|/])"


def marked(text: Column) -> Column:
    """The normalised text with its marks, one at either end."""
    out = F.regexp_replace(fold_ascii(text), r"\bv\. ?(?=[0-9])", "v ")
    out = F.regexp_replace(out, r"[|/]", " ")
    out = F.regexp_replace(out, r"\n[^a-z0-9\n]*(?=\n)|[.!?](?=\s|$)|(?<![a-z0-9])[0-9]\)(?=\s)", " | ")
    out = F.regexp_replace(out, r"\n|[;:](?=\s|$)", " / ")
    return F.concat(F.lit("| "), F.trim(F.regexp_replace(out, "[^a-z0-9|/]+", " ")), F.lit(" |"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    every = {**SENTENCES, **TEXTS}
    plain = {s: i for s, i in every.items() if "*" not in s}
    known = F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))
    found = F.regexp_extract_all(marked(text), F.lit(known_pattern()), F.lit(0))

    def named(match):
        sentence = F.regexp_replace(match, "[ /]+", " ")
        out = F.try_element_at(known, sentence)
        for s, i in every.items():
            if "*" in s:
                whole = "^" + s.replace("*", "[a-z0-9 ]+") + "$"
                out = F.coalesce(out, F.when(sentence.rlike(whole), F.lit(i)))
        return out

    folded = fold_ascii(text)
    hinted = reduce(or_, [F.contains(folded, F.lit(h)) for h in HINTS])
    return F.when(hinted, F.transform(found, named)).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (in order, comma-joined), licenses (sorted,
    comma-joined), n_licenses, n_rules (rules that hold)."""
    ids = (
        docs.select(
            "doc_id",
            sentences(F.col("text")).alias("sentences"),
            sentence_ids(F.col("text")).alias("known"),
        )
        .select(
            "doc_id",
            F.size("sentences").cast("long").alias("n_sentences"),
            F.array_join("known", ",").alias("sentence_ids"),
        )
    )

    def holds(rule):
        pattern = "(^|,)" + ",(.*,)?".join(map(re.escape, rule)) + "(,|$)"
        return F.col("sentence_ids").rlike(pattern)

    met = F.array(*(F.when(holds(rule), F.lit(name)) for name, rule in RULES + TEXT_RULES))
    rules = F.filter(met, lambda x: x.isNotNull())
    found = F.array_sort(F.array_distinct(F.col("met")))
    for longer, shorter in [*VOIDS.items(), *TEXT_VOIDS]:
        found = F.when(
            F.array_contains("met", longer), F.array_remove(found, shorter)
        ).otherwise(found)
    return (
        ids.withColumn("met", rules)
        .withColumn("names", found)
        .select(
            "doc_id",
            "n_sentences",
            "sentence_ids",
            F.array_join("names", ",").alias("licenses"),
            F.size("names").cast("long").alias("n_licenses"),
            F.size("met").cast("long").alias("n_rules"),
        )
    )
