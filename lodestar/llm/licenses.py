"""Licences by their sentences: known sentences become identifiers, and ordered rules match sequences of them. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pick

# Sentences of public licence texts and notices, as they stand there, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "spdx": ("SPDX-License-Identifier", "SPDX License Identifier"),
    "name-apache2": ("Apache-2.0",),
    "name-mit": ("MIT",),
    "name-gpl3": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "name-gpl2": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "name-bsd3": ("BSD-3-Clause",),
    "name-bsd2": ("BSD-2-Clause",),
    "name-mpl2": ("MPL-2.0",),
    "name-cc-by": ("CC-BY-4.0",),
    "name-cc0": ("CC0-1.0",),
    "apache2-short": (
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "This work is licensed under the Apache License, Version 2.0"
    ),
    "apache2-grant": (
        'Licensed under the Apache License, Version 2.0 (the "License")',
        'This file is licensed under the Apache License, Version 2.0 (the "License")'
    ),
    "apache2-comply": ("you may not use this file except in compliance with the License",),
    "apache2-copy": ("You may obtain a copy of the License at",),
    "apache2-warranty": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    ),
    "mit-short": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit-title": ("MIT License", "The MIT License (MIT)", "The MIT License"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    ),
    "gpl3-short": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0"
    ),
    "gpl2-short": (
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License, version 2",
        "Released under the GNU General Public License, version 2"
    ),
    "gpl-grant": ("This program is free software",),
    "gpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "gpl2-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    ),
    "mpl2-grant": ("This Source Code Form is subject to the terms of the Mozilla Public License, v",),
    "cc-by-short": (
        "Licensed under CC BY 4.0",
        "This work is licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License"
    ),
    "cc-by-sa-short": (
        "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"
    ),
    "cc-by-nc-short": (
        "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"
    ),
    "rights": ("All rights reserved",),
}

#: (licence, pattern over the identifiers, each with a space on either side), in the order of the result.
GAP = "([^ ]+ )*"
#: Names of an SPDX expression before the one that counts.
NAMED = "(name-[^ ]+ )*"
RULES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", f" apache2-short | apache2-grant {GAP}apache2-(comply|copy|warranty) | spdx {NAMED}name-apache2 "),
    ("MIT", f" mit-short | mit-title {GAP}mit-grant | mit-grant {GAP}mit-notice | mit-grant {GAP}mit-warranty | spdx {NAMED}name-mit "),
    ("GPL-3.0", f" gpl3-short | gpl-grant {GAP}gpl3-terms | spdx {NAMED}name-gpl3 "),
    ("GPL-2.0", f" gpl2-short | gpl-grant {GAP}gpl2-terms | spdx {NAMED}name-gpl2 "),
    ("BSD-3-Clause", f" bsd-grant {GAP}bsd-endorse {GAP}bsd-warranty | spdx {NAMED}name-bsd3 "),
    ("BSD-2-Clause", f" bsd-grant bsd-warranty | spdx {NAMED}name-bsd2 "),
    ("MPL-2.0", f" mpl2-grant | spdx {NAMED}name-mpl2 "),
    ("CC-BY-NC-4.0", " cc-by-nc-short "),
    ("CC-BY-SA-4.0", " cc-by-sa-short "),
    ("CC-BY-4.0", f" cc-by-short | spdx {NAMED}name-cc-by "),
    ("CC0-1.0", f" spdx {NAMED}name-cc0 "),
    ("LicenseRef-rights-reserved", " rights "),
)

# What the DuckDB twin has no part in: more sentences, patterns for those with free names or many wordings, and their rules.
MORE_SENTENCES: dict[str, tuple[str, ...]] = {
    "bsl-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    ),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-altered": (
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    ),
    "unlicense-grant": ("This is free and unencumbered software released into the public domain",),
    "bsd-advert": (
        "All advertising materials mentioning features or use of this software must display the following acknowledgement",
        "All advertising materials mentioning features or use of this software must display the following acknowledgment"
    ),
    "either-3": ("either version 3 of the License, or (at your option) any later version", "either version 3 of the License"),
    "either-21": ("either version 2.1 of the License, or (at your option) any later version", "either version 2.1 of the License"),
    "either-2": ("either version 2 of the License, or (at your option) any later version", "either version 2 of the License"),
}
#: SPDX identifiers that may stand in an expression, by licence; those of the GNU licences also with -only and -or-later.
NAMES: dict[str, str] = {
    "Apache-2.0": "apache2", "MIT": "mit", "GPL-3.0": "gpl3", "GPL-2.0": "gpl2", "BSD-3-Clause": "bsd3", "BSD-2-Clause": "bsd2",
    "BSD-4-Clause": "bsd4", "0BSD": "bsd0", "MPL-2.0": "mpl2", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
    "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC0-1.0": "cc0", "LGPL-3.0": "lgpl3", "LGPL-2.1": "lgpl21",
    "LGPL-2.0": "lgpl2", "AGPL-3.0": "agpl3", "ISC": "isc", "EPL-2.0": "epl2", "EPL-1.0": "epl1", "Unlicense": "unlicense",
    "Zlib": "zlib", "BSL-1.0": "bsl", "Artistic-2.0": "artistic2", "CDDL-1.0": "cddl1", "WTFPL": "wtfpl", "OFL-1.1": "ofl11",
    "EUPL-1.2": "eupl12", "PostgreSQL": "postgresql",
}
_LATER = "( or later| only| or at your option any later version| or any later version)?"
_SHORT = "(((this|the|our) ([^ ]+ ){1,5}|((?!this |the |our )[^ ]+ ){1,4})(is|are) )?((dual )?licen[cs]ed|released|distributed|(made )?available) under (the )?(terms (and conditions )?of )?(the )?"
_GNU = {"gpl": ("", "gpl"), "lgpl": ("(lesser |library )", "lgpl"), "agpl": ("affero ", "agpl")}
_NUMBER = {"3": "3( 0)?", "21": "2 1", "2": "2( 0)?"}
_GNU_VERSIONS = (("gpl", "3"), ("gpl", "2"), ("lgpl", "3"), ("lgpl", "21"), ("lgpl", "2"), ("agpl", "3"))
#: (identifier, pattern that a whole normalised sentence must match); the first that does counts.
PATTERNS: tuple[tuple[str, str], ...] = (
    (
        "bsd-grant",
        "redistribution and use (of .+ )?in source and binary forms with or without modification (are|is) permitted provided that the following conditions are met"
    ),
    (
        "bsd-endorse",
        "(.+ )?(may (not )?be used|be used) to endorse or promote products derived from this software without (specific )?prior written permission( of .+| from .+)?"
    ),
    (
        "bsd-warranty",
        "(.+ )?as is and any express(ed)? or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ),
    (
        "isc-grant",
        "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    *(
        (
            f"{kind}{v}-terms",
            f"(.+ )?under the terms of (the )?gnu {_GNU[kind][0]}general public license (version {_NUMBER[v]} as published by the free software foundation|as published by the free software foundation (either )?version {_NUMBER[v]}( of the license)?){_LATER}"
        ) for kind, v in _GNU_VERSIONS
    ),
    *(
        (
            f"{kind}-terms",
            f"(.+ )?under the terms of (the )?gnu {_GNU[kind][0]}general public license as published by the free software foundation"
        ) for kind in _GNU
    ),
    *(
        (
            f"{kind}{v}-short",
            f"{_SHORT}(gnu {_GNU[kind][0]}general public license ((version|v) ?)?{_NUMBER[v]}|(gnu )?{_GNU[kind][1]} ?((version|v) ?)?{_NUMBER[v]}){_LATER}( license)?"
        ) for kind, v in _GNU_VERSIONS
    ),
    *((f"epl{v}-grant", f"(.+ )?under the terms of the eclipse public license ((version|v) ?)?{v} 0( which .+| and .+)?") for v in "21"),
    *((f"epl{v}-short", f"{_SHORT}(eclipse public license|epl) ?((version|v) ?)?{v} 0( license)?") for v in "21"),
    ("apache2-short", f"{_SHORT}apache (license )?((version|v) ?)?2( 0)?( license)?"),
    ("mit-short", f"{_SHORT}(mit|expat)( license)?"),
    ("mpl2-short", f"{_SHORT}(mozilla public license|mpl) ?((version|v) ?)?2 0( license)?"),
    ("bsd3-short", f"{_SHORT}(bsd (3|three) clause|(3|three) clause bsd|(new|revised|modified) bsd)( license)?"),
    ("bsd2-short", f"{_SHORT}(bsd (2|two) clause|(2|two) clause bsd|simplified bsd)( license)?"),
    ("isc-short", f"{_SHORT}isc( license)?"),
    ("unlicense-short", f"{_SHORT}unlicense"),
    ("bsl-short", f"{_SHORT}boost software license( (version )?1 0)?"),
    ("zlib-short", f"{_SHORT}zlib( license)?"),
    ("cc0-short", f"{_SHORT}(cc0|creative commons (cc0|zero))( 1 0)?( universal)?( license| public domain dedication)?"),
)


def _but(name: str) -> str:
    return f"((?!{name} )[^ ]+ )*"


def _gnu_rule(kind: str, v: str) -> str:
    return f" {kind}{v}-short | {kind}{v}-terms | {kind}-terms either-{v} | spdx {NAMED}name-{kind}{v} "


#: Rules in place of, or after, those of RULES; a BSD text is named by what stands between its grant and its warranty.
MORE_RULES: dict[str, str] = {
    "GPL-3.0": _gnu_rule("gpl", "3"),
    "GPL-2.0": _gnu_rule("gpl", "2"),
    "BSD-3-Clause": f" bsd3-short | bsd-grant {_but('bsd-(?:advert|grant)')}bsd-endorse {_but('bsd-(?:advert|grant)')}bsd-warranty | spdx {NAMED}name-bsd3 ",
    "BSD-2-Clause": f" bsd2-short | bsd-grant {_but('bsd-(?:advert|endorse|grant)')}bsd-warranty | spdx {NAMED}name-bsd2 ",
    "MPL-2.0": f" mpl2-grant | mpl2-short | spdx {NAMED}name-mpl2 ",
    "CC-BY-NC-4.0": f" cc-by-nc-short | spdx {NAMED}name-cc-by-nc ",
    "CC-BY-SA-4.0": f" cc-by-sa-short | spdx {NAMED}name-cc-by-sa ",
    "CC0-1.0": f" cc0-short | spdx {NAMED}name-cc0 ",
    "BSD-4-Clause": f" bsd-grant {_but('bsd-grant')}bsd-advert {_but('bsd-grant')}bsd-warranty | spdx {NAMED}name-bsd4 ",
    "LGPL-3.0": _gnu_rule("lgpl", "3"),
    "LGPL-2.1": _gnu_rule("lgpl", "21"),
    "LGPL-2.0": _gnu_rule("lgpl", "2"),
    "AGPL-3.0": _gnu_rule("agpl", "3"),
    "ISC": f" isc-grant | isc-short | spdx {NAMED}name-isc ",
    "EPL-2.0": f" epl2-grant | epl2-short | spdx {NAMED}name-epl2 ",
    "EPL-1.0": f" epl1-grant | epl1-short | spdx {NAMED}name-epl1 ",
    "BSL-1.0": " bsl-grant | bsl-short ",
    "Zlib": f" zlib-warranty {GAP}zlib-altered | zlib-short ",
    "Unlicense": f" unlicense-grant | unlicense-short | spdx {NAMED}name-unlicense ",
}
#: A rule matches the line split only where the sentence split has none of these: a wrapped sentence is missing in lines.
BUT_SENTENCES = {"BSD-3-Clause": " bsd-advert ", "BSD-2-Clause": " bsd-(advert|endorse) "}
SENTENCE_END, LINE_END = r"[.!?;:]\s+|\n\s*\n", r"[.!?;:]\s+|\n"
#: Every known sentence has one of these words or, if it is short names, begins with one of them.
ANCHORS = (
    "licen", "redistribut", "permission", "software", "reserved", "released", "distributed", "available", "warranties", "domain", "altered"
)
FIRST = "(?:0bsd|a?gpl|lgpl|apache|artistic|bsd|bsl|cc|cc0|cddl|epl|eupl|isc|mit|mpl|ofl|postgresql|unlicense|wtfpl|zlib)(?![a-z0-9])"
#: A name where a sentence of either split may begin.
BEGINS = rf"(?:^|[.!?;:]\s|\n)[^a-z0-9]*{FIRST}"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def dictionary() -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {normal(s): name for name, sentences in SENTENCES.items() for s in sentences}


def rules() -> dict[str, str]:
    """Patterns over identifiers by licence, in the order of the result; any licence with a name may be named by SPDX."""
    found = dict(RULES) | MORE_RULES
    for licence, name in NAMES.items():
        tag = f" spdx {NAMED}name-{name} "
        found[licence] = found[licence] if tag in found.get(licence, "") else "|".join(filter(None, [found.get(licence), tag]))
    return found


def expression() -> tuple[str, str, dict[str, str]]:
    """An SPDX expression of normalised names: the pattern of one name, that of a whole expression, and identifiers by name."""
    names = {normal(licence): f"name-{name}" for licence, name in NAMES.items()}
    some = "|".join(sorted(names, key=len, reverse=True))
    one = f"(?<![a-z0-9])(?:{some})(?: only| or later)?(?![a-z0-9])"
    return one, f"^{one}(?: (?:and|or) {one}| with [a-z0-9 ]*exception(?: [0-9]+)*)*$", names


def has_anchor(text: Column) -> Column:
    some = F.lit(False)
    for anchor in ANCHORS:
        some = some | F.contains(text, F.lit(anchor))
    return some


def _identifiers(low: Column, ends: str) -> Column:
    """Identifiers of the known sentences of a text, in order; an SPDX expression gives one for each of its names."""
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    known = table((dictionary() | {normal(s): name for name, sentences in MORE_SENTENCES.items() for s in sentences}).items())
    one, whole, names = expression()
    named = table(names.items())
    plain = lambda name: named[F.regexp_replace(name, "( only| or later)$", "")]
    free = lambda s: F.coalesce(*[F.when(s.rlike(f"^({pattern})$"), F.lit(name)) for name, pattern in PATTERNS])

    def of(s: Column) -> Column:
        listed = F.when(s.rlike(whole), F.transform(F.regexp_extract_all(s, F.lit(one), F.lit(0)), plain))
        return F.coalesce(listed, F.array(F.coalesce(known[s], F.when(has_anchor(s), free(s)))))

    sentences = F.transform(F.split(low, ends), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    likely = F.filter(sentences, lambda s: has_anchor(s) | s.rlike(f"^{FIRST}"))
    return F.array_compact(F.flatten(F.transform(likely, of)))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences that each whole text names or holds, by ordered rules over its known sentences.

    Returns the id, ``sentence_ids`` (array, in text order), ``line_ids`` (the same with line ends as
    sentence ends, for notices without a full stop) and ``licenses`` (array, in rule order, of the
    rules that match either; a BSD text is judged by its whole sentences). A sentence ends at one of
    . ! ? ; : before white space, or at an empty line, so wrapped licence texts are whole; it is compared
    in lower case with all but letters and digits as one space. An SPDX expression (names joined by AND,
    OR, or WITH an exception) is a sentence of all its names. Licences that SENTENCES, PATTERNS and NAMES
    don't know are not found.

    A null or empty text has empty arrays; repeated rows are scanned alike; an empty table gives no
    rows; other columns are ignored. No shuffle.
    """
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = pick(df, id=id_col, text=text_col)
    none = F.array().cast("array<string>")
    rows = rows.select("id", low.alias("low")).select("id", "low", (has_anchor(F.col("low")) | F.col("low").rlike(BEGINS)).alias("worth"))
    found = lambda ends: F.when(F.col("worth"), _identifiers(F.col("low"), ends)).otherwise(none)
    rows = rows.select("id", found(SENTENCE_END).alias("a"), found(LINE_END).alias("b"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    rows = rows.withColumn("sa", spaced("a")).withColumn("sb", spaced("b"))

    def lines(name: str, rule: str) -> Column:
        hit = F.col("sb").rlike(rule)
        return hit & ~F.col("sa").rlike(BUT_SENTENCES[name]) if name in BUT_SENTENCES else hit

    named = F.array_compact(F.array(*[F.when(F.col("sa").rlike(rule) | lines(name, rule), F.lit(name)) for name, rule in rules().items()]))
    some = (F.size("a") > 0) | (F.size("b") > 0)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("a").alias("sentence_ids"),
        F.col("b").alias("line_ids"),
        F.when(some, named).otherwise(none).alias("licenses")
    )
