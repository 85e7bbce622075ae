"""License scans: ordered signature rules, gated by keywords, with overlapping detections resolved.

A text is lower-cased and cut down to its words with single spaces. Base phrases are counted and placed in every
text. A rule is a regex with a priority and its keywords: clauses of literals, and every match holds a literal of each
clause. One regex made of the rules' first clauses looks whether any rule may match a text at all; if so, the rules
whose clauses all hold are run. Detections are intervals of the text. One that lies within another is suppressed, of
equal intervals the rule with the better (lower) priority stays, and of two that overlap in part the one with the
worse priority yields.

Rules run where the text is read; only detections are shuffled, never texts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Families: label, regex of the name in words, keywords (every match of the name, in a text with a space before and
#: after each word, holds one of them), versions (each makes rules of its own). The names are built into rules below.
FAMILIES = (
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", ("affero general public license", " agpl"), ("1 0", "3 0")),
    ("lgpl", r"(?:gnu )?(?:lesser general public license|library general public license|lgpl)", ("lesser general public license", "library general public license", " lgpl"), ("2 0", "2 1", "3 0")),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", ("general public license", " gpl"), ("1 0", "2 0", "3 0")),
    ("gfdl", r"(?:gnu )?(?:free documentation license|gfdl)", ("free documentation license", " gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", r"apache(?: software)?(?: license)?", (" apache",), ("1 0", "1 1", "2 0")),
    ("mpl", r"(?:mozilla public license|mpl)", ("mozilla public license", " mpl"), ("1 0", "1 1", "2 0")),
    ("epl", r"(?:eclipse public license|epl)", ("eclipse public license", " epl"), ("1 0", "2 0")),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", ("european union public licen", " eupl"), ("1 0", "1 1", "1 2")),
    ("cddl", r"(?:common development and distribution license|cddl)", ("common development and distribution license", " cddl"), ("1 0", "1 1")),
    ("cpl", r"(?:common public license|cpl)", ("common public license", " cpl"), ("1 0",)),
    ("osl", r"(?:open software license|osl)", ("open software license", " osl"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", r"(?:academic free license|afl)", ("academic free license", " afl"), ("1 1", "2 0", "2 1", "3 0")),
    ("artistic", r"(?:perl )?artistic license", ("artistic license",), ("1 0", "2 0")),
    ("bsl", r"(?:boost software license|bsl)", ("boost software license", " bsl"), ("1 0",)),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)|cc by nc nd)", ("creative commons attribution non", " cc by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)", ("creative commons attribution non", " cc by nc sa"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)", ("creative commons attribution non", " cc by nc"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:ative|s|atives)|cc by nd)", ("creative commons attribution no", " cc by nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)", ("creative commons attribution share", " cc by sa"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", r"(?:creative commons attribution|cc by)", ("creative commons attribution", " cc by"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", r"(?:creative commons zero|cc0)", ("creative commons zero", " cc0"), ("1 0",)),
    ("zpl", r"(?:zope public license|zpl)", ("zope public license", " zpl"), ("1 1", "2 0", "2 1")),
    ("psf", r"python software foundation license", ("python software foundation license",), ("2 0",)),
    ("php", r"php license", ("php license",), ("3 0", "3 01")),
    ("odbl", r"(?:open database license|odbl)", ("open database license", " odbl"), ("1 0",)),
    ("ofl", r"(?:sil )?open font license", ("open font license",), ("1 0", "1 1")),
    ("ms-pl", r"(?:microsoft public license|ms pl)", ("microsoft public license", " ms pl"), ("1 0",)),
    ("upl", r"universal permissive license", ("universal permissive license",), ("1 0",)),
    ("ecl", r"educational community license", ("educational community license",), ("1 0", "2 0")),
    ("ncsa", r"(?:university of illinois ncsa open source license|ncsa license)", ("ncsa open source license", "ncsa license"), ()),
    ("mit", r"(?:mit|expat)(?: x11)?", (" mit ", " expat "), ()),
    ("isc", r"isc", (" isc ",), ()),
    ("zlib", r"zlib(?: libpng)?", (" zlib ",), ()),
    ("bsd", r"(?:new |modified |revised |simplified )?bsd", (" bsd",), ("2 clause", "3 clause", "4 clause")),
    ("wtfpl", r"(?:do what the \w+ you want to public license|wtfpl)", ("you want to public license", " wtfpl"), ("2 0",)),
    ("unlicense", r"unlicense", (" unlicense ",), ()),
    ("beerware", r"beer ?ware", (" beerware ", " beer ware "), ()),
)

#: Whole signatures, written by hand: label, regex, keyword (in every match), weight.
TEXTS = (
    # notices that grant the rights
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 1.0),
    ("mit", r"(?:the|this) above copyright notice and this permission notice (?:\S+ )?shall be included in all copies or substantial portions", "permission notice", 0.9),
    ("mit-advertising", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute", "without written agreement", 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee", 1.0),
    ("ntp", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", "software and its documentation", 0.9),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "with or without fee", 0.9),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose", "no representations about the suitability", 0.7),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 1.0),
    ("bsd-2-clause", r"redistributions (?:of source code must retain|in binary form must reproduce) the above copyright notice", "redistributions ", 0.8),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors", "neither the name", 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising materials", 1.0),
    ("x11", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising", "except as contained in this notice", 0.9),
    ("zlib", r"this software is provided as is without any express or implied warranty", "express or implied", 0.7),
    ("zlib", r"altered source versions must be plainly marked as such", "altered source versions", 0.9),
    ("libpng", r"the contributing authors and group 42 inc disclaim all warranties", "contributing authors", 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy", 1.0),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "whatever you want with this stuff", 1.0),
    ("json", r"the software shall be used for good not evil", "for good not evil", 1.0),
    ("cc0-1.0", r"to the extent possible under law (?:\S+ ){1,20}has waived all copyright and related or neighboring rights", "related or neighboring rights", 1.0),
    ("perl", r"(?:under|on) the same terms as perl(?: \S+ \S+)? itself", "the same terms as perl", 1.0),
    ("fsf-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "in any medium without royalty", 1.0),
    ("fsf-unlimited", r"this file is free software the free software foundation gives unlimited permission to copy", "gives unlimited permission", 1.0),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg group", 1.0),
    ("freetype", r"portions of this software are copyright (?:\S+ ){1,4}the freetype project", "the freetype project", 0.9),
    # headers of files
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "is free software", 1.0),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "is free software", 1.0),
    ("agpl", r"under the terms of the gnu affero general public license", "gnu affero general public license", 1.0),
    ("gpl", r"you should have received a copy of the gnu general public license", "should have received a copy", 0.9),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", "should have received a copy", 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "should have received a copy", 0.9),
    ("gpl-2.0-or-later", r"either version 2 (?:0 )?of the license or at your option any later version", "at your option any later version", 0.8),
    ("lgpl-2.1-or-later", r"either version 2 1 of the license or at your option any later version", "at your option any later version", 0.8),
    ("gpl-3.0-or-later", r"either version 3 (?:0 )?of the license or at your option any later version", "at your option any later version", 0.8),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "modify this document", 1.0),
    ("apache-2.0", r"licensed under the apache license version 2 0(?: the license)?", "apache license", 1.0),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "except in compliance with the license", 0.8),
    ("apache-2.0", r"apache org licenses license 2 0", "apache org licenses", 1.0),
    ("apache-1.1", r"this product includes software developed by the apache (?:software foundation|group)", "software developed by the apache", 0.9),
    ("openssl", r"this product includes software developed by the openssl project", "software developed by the openssl project", 1.0),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic software written by", 1.0),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "source code form", 1.0),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "a copy of the mpl", 1.0),
    ("mpl", r"the contents of this file are subject to the (?:terms of the )?mozilla public license", "the contents of this file", 0.9),
    ("npl", r"the contents of this file are subject to the netscape public license", "the contents of this file", 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "the contents of this file", 1.0),
    ("cddl", r"use is subject to license terms", "use is subject to license terms", 0.4),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 1.0),
    ("cpl", r"this program and the accompanying materials are made available under the terms of the common public license", "accompanying materials", 1.0),
    ("php", r"this source file is subject to version (?:2 02|3 0|3 01) of the php license", "this source file is subject to", 1.0),
    ("psf-2.0", r"this license agreement is between the python software foundation", "python software foundation", 1.0),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "this font software", 1.0),
    ("bsl-1.0", r"boost software license version 1 0 august 17th 2003", "boost software license", 1.0),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "any person or organization", 1.0),
    ("cc", r"this (?:work|book|article|text|image|content|document) is licensed under (?:a|the) creative commons", "under ", 0.8),
    ("cc", r"to view a copy of this license visit (?:https? )?(?:www )?creativecommons org", "creativecommons org", 0.7),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons org publicdomain", 1.0),
    ("spdx-tag", r"spdx license identifier", "spdx license identifier", 0.6),
    # exceptions
    ("classpath-exception", r"as a special exception the copyright holders of this library give you permission to link", "as a special exception", 1.0),
    ("classpath-exception", r"classpath exception", "classpath exception", 0.9),
    ("gcc-exception", r"gcc runtime library exception", "gcc runtime library exception", 1.0),
    ("autoconf-exception", r"if you distribute this file as part of a program that contains a configuration script generated by autoconf", "generated by autoconf", 1.0),
    ("bison-exception", r"you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton", 1.0),
    ("font-exception", r"this font does not by itself cause the resulting document to be covered by the gnu general public license", "by itself cause the resulting document", 1.0),
    ("llvm-exception", r"llvm exceptions? to the apache(?: 2 0)? license", "llvm exception", 1.0),
    ("linux-syscall-note", r"this copyright does not cover user programs that use kernel services by normal system calls", "by normal system calls", 1.0),
    ("openssl-exception", r"permission to link the code of (?:\S+ ){1,8}with the openssl (?:project s )?library", "permission to link the code", 0.9),
    ("commons-clause", r"commons clause(?: license)? condition", "commons clause", 1.0),
    # names without families of versions
    ("ibm-public-license", r"ibm public license", "ibm public license", 0.8),
    ("sissl", r"sun industry standards source license", "sun industry standards source license", 0.9),
    ("npl", r"netscape public license", "netscape public license", 0.8),
    ("intel", r"intel open source license", "intel open source license", 0.9),
    ("qpl", r"q public license", " q public license", 0.8),
    ("sleepycat", r"sleepycat (?:software )?license", " sleepycat ", 0.8),
    ("vim", r"vim license", " vim license", 0.8),
    ("ruby", r"ruby(?: s)? license", " ruby ", 0.7),
    ("postgresql", r"postgresql licen[cs]e", " postgresql licen", 0.9),
    ("openldap", r"openldap public license", "openldap public license", 0.9),
    ("lppl", r"latex project public license", "latex project public license", 0.9),
    ("opl", r"open publication license", "open publication license", 0.8),
    ("aladdin", r"aladdin free public license", "aladdin free public license", 0.9),
    ("sspl", r"server side public license", "server side public license", 0.9),
    ("busl", r"business source license", "business source license", 0.9),
    ("elastic", r"elastic license(?: 2 0| v2)?", "elastic license", 0.9),
    ("mulan", r"mulan (?:permissive software|public) license", " mulan ", 0.9),
    ("blueoak", r"blue oak model license", "blue oak model license", 0.9),
    ("ogl", r"open government licen[cs]e", "open government licen", 0.9),
    ("nasa", r"nasa open source agreement", "nasa open source agreement", 0.9),
    ("apsl", r"apple public source license", "apple public source license", 0.9),
    ("rpl", r"reciprocal public license", "reciprocal public license", 0.9),
    ("ms-rl", r"microsoft reciprocal license", "microsoft reciprocal license", 0.9),
    ("cern-ohl", r"cern open hardware licen[cs]e", "cern open hardware licen", 0.9),
    ("odc-by", r"open data commons attribution license", "open data commons attribution license", 0.9),
    ("pddl", r"public domain dedication and licen[cs]e", "public domain dedication", 0.9),
    ("cdla", r"community data license agreement", "community data license agreement", 0.9),
    ("parity", r"parity public license", "parity public license", 0.9),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) license", " polyform ", 0.9),
    ("confluent", r"confluent community license", "confluent community license", 0.9),
    ("rsal", r"redis source available license", "redis source available license", 0.9),
    ("imagemagick", r"imagemagick license", "imagemagick license", 0.9),
    ("info-zip", r"info zip license", "info zip license", 0.9),
    ("w3c", r"w3c (?:software|document)(?: notice and)? licen[cs]e", " w3c ", 0.9),
    ("unicode", r"unicode (?:inc )?license agreement", "license agreement", 0.8),
    ("openrail", r"(?:creativeml |bigscience )?open rail m(?: license)?", " open rail m", 0.9),
    ("llama", r"llama (?:2 |3 )?community license agreement", "community license agreement", 0.9),
    # reserved rights and plain statements
    ("proprietary", r"all rights reserved", "all rights reserved", 0.4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 0.6),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|work)", " unauthorized ", 0.6),
    ("proprietary", r"(?:may|must) not be (?:reproduced|copied|redistributed) without (?:the )?(?:prior )?(?:written )?permission", " not be ", 0.5),
    ("some-rights-reserved", r"some rights reserved", "some rights reserved", 0.4),
    ("end-user-license", r"end user license agreement", "end user license agreement", 0.5),
    ("freeware", r"(?:this|the) (?:software|program|font) is freeware", " is freeware", 0.5),
    ("non-commercial", r"for (?:personal|academic|research|educational|non ?commercial)(?: and non ?commercial)? use only", " use only", 0.5),
    ("public-domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain", 0.8),
    ("warranty-disclaimer", r"(?:the software is provided as is )?without warranty of any kind", "without warranty", 0.5),
    ("warranty-disclaimer", r"without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty of merchantability", 0.5),
    ("warranty-disclaimer", r"in no event shall the (?:authors?|copyright holders?|regents)", "in no event shall the", 0.5),
    ("copyright-notice", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright", 0.3),
    ("open-source", r"open source license", "open source license", 0.4),
    ("open-source", r"licensed under an? (?:osi approved|open source) licen[cs]e", "licensed under ", 0.5),
    ("dual-license", r"(?:dual|triple) licensed under", " licensed under ", 0.5),
)

#: What stands before a name in "licensed under the terms of the ...".
GRANTS = ("licensed", "released", "distributed", "available", "published", "provided")
UNDER = rf"(?:{'|'.join(GRANTS)}) under (?:the )?(?:terms of )?(?:the )?"
#: Names that are words of prose, too: keywords of the name with "license" behind it.
PROSE = {"mit": (" mit licen", " mit x11 licen", " expat licen", " expat x11 licen"), "isc": (" isc licen",), "zlib": (" zlib licen", " zlib libpng licen")}


def rules() -> list[tuple[int, str, str, tuple[tuple[str, ...], ...], float]]:
    """(priority, label, regex, clauses, weight), best first: identifier tags, whole signatures, names with a
    version, "licensed under" phrases, bare names. Every match of the regex, with a space before and after it, holds
    a literal of each clause; the first clause is the rare one."""
    found = []
    for label, regex, keyword, weight in TEXTS:
        found.append((1, label, regex, ((keyword,),), weight))
    for family, name, keywords, versions in FAMILIES:
        tag = family.replace("-", " ")
        bare = (4, family, name + r" licen[cs]e" if "licen" not in name else name, (PROSE.get(family, keywords),), 0.6)
        found.append(bare)
        found.append((3, family, UNDER + name, (tuple(f" {g} under " for g in GRANTS), keywords), 0.8))
        found.append((0, family, rf"spdx license identifier {tag}", (("spdx license identifier",), (f" {tag} ",)), 1.0))
        for v in versions:
            own = f"{family}-{v.replace(' ', '.' if v[-1].isdigit() else '-')}"
            short = v.removesuffix(" 0")
            number = f"{short}(?: 0)?" if v.endswith(" 0") else v
            found.append((0, own, rf"spdx license identifier {tag} {v}(?: only| or later)?", (("spdx license identifier",), (f" {tag} {v} ",)), 1.0))
            found.append((2, own, rf"{name}(?: licen[cs]e)?(?: version| v)? ?{number}(?: or (?:any )?later(?: version)?)?", (keywords, (f"{short} ",)), 0.9))
            if v[-1].isdigit():
                found.append((2, own, rf"licen[cs]es {tag} {v}", ((f" licenses {tag} {v} ", f" licences {tag} {v} "),), 0.7))
            else:
                found.append((2, own, rf"{v} {name}(?: licen[cs]e)?", (keywords, (f" {v} ",)), 0.9))
    return sorted(set(found))


def gate(every: list) -> str:
    """A regex that is found in every text with a base phrase or a detection: the first clauses of all rules, as one
    alternation, literals with the same first letter together."""
    literals = {p for p in BASE} | {k.lstrip() for r in every for k in r[3][0]}
    least = sorted(k for k in literals if not any(x != k and k.startswith(x) for x in literals))
    first: dict[str, list[str]] = {}
    for k in least:
        first.setdefault(k[0], []).append(k[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(first.items())) + ")"


def normalised(text: Column) -> Column:
    """Lower-case words with a space before each and after the last; " " if there are none.

    ``lower`` and A-Z lower-casing agree on what is a word and on every base phrase."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))


def spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def base_matches(norm: Column, n_words: Column) -> dict[str, Column]:
    counts = {p: F.regexp_count(norm, F.lit(f" {p}(?= )")) for p in BASE}
    firsts = [F.when(counts[p] > 0, spaces(F.substring_index(norm, f" {p} ", 1))) for p in BASE]
    lasts = [F.when(counts[p] > 0, n_words - spaces(F.substring_index(norm, f" {p} ", -1)) - len(p.split())) for p in BASE]
    maybe = norm.contains(" license ") | norm.contains(" cc by ")
    labels = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(counts[p] > 0, F.lit(x)) for p, x in BASE.items()]))), ",")
    return {
        "n_base": F.when(maybe, sum(counts.values(), F.lit(0))).otherwise(0).cast("long"),
        "first_word": F.when(maybe, F.least(*firsts)),
        "last_word": F.when(maybe, F.greatest(*lasts)),
        "base_labels": F.when(maybe, labels).otherwise(F.lit("")),
    }


_TABLE = "array<struct<clause:array<string>,members:array<struct<rule:int,priority:int,label:string,regex:string,weight:double,rest:array<array<string>>>>>>"


def matches(norm: Column, every: list) -> Column:
    """Array of {rule, priority, label, weight, sizes} of the rules that match in a text. ``sizes`` has for each match
    the number of characters between it and the one before, and its own; a match begins with the space before its
    first word."""
    by_clause: dict[tuple, list] = {}
    for n, (priority, label, regex, clauses, weight) in enumerate(every):
        by_clause.setdefault(clauses[0], []).append({"rule": n, "priority": priority, "label": label, "regex": f" {regex}(?= )", "weight": weight, "rest": clauses[1:]})
    # one literal, read once when the plan is made
    table = F.from_json(F.lit(json.dumps([{"clause": c, "members": m} for c, m in by_clause.items()])), _TABLE)
    holds = lambda clause: F.exists(clause, lambda k: F.contains(norm, k))
    maybe = F.flatten(F.transform(F.filter(table, lambda g: holds(g.clause)), lambda g: g.members))
    found = F.filter(maybe, lambda r: F.forall(r.rest, holds) & F.regexp_like(norm, r.regex))

    def sizes(regex: Column) -> Column:
        parts, own = F.split(norm, regex, -1), F.regexp_extract_all(norm, regex, F.lit(0))
        return F.transform(F.arrays_zip(parts.alias("s"), own.alias("m")), lambda x: F.struct(F.length(x.s).alias("skip"), F.length(x.m).alias("size")))

    return F.transform(found, lambda r: F.struct(r.rule.alias("rule"), r.priority.alias("priority"), r.label.alias("label"), r.weight.alias("weight"), sizes(r.regex).alias("sizes")))


def placed(hits: DataFrame, key: str, column: str) -> DataFrame:
    """``key, priority, label, weight, start, end`` of all matches in the arrays that :func:`matches` makes."""
    each = hits.filter(F.size(column) > 0).select(key, F.explode(column).alias("h")).select(key, "h.rule", "h.priority", "h.label", "h.weight", F.posexplode("h.sizes").alias("i", "x")).filter("x.size is not null")  # no match ends in what follows the last
    run = Window.partitionBy(key, "rule").orderBy("i")
    # one shuffle serves all windows of a row
    ends = each.repartition(key).withColumn("end", F.sum(F.col("x.skip") + F.col("x.size")).over(run))
    return ends.select(key, "priority", "label", "weight", (F.col("end") - F.col("x.size")).alias("start"), "end")


def resolve(found: DataFrame, key: str) -> DataFrame:
    """The rows of ``found(key, priority, label, weight, start, end)`` that stay: not within another one (of equal
    intervals the best priority, then the first label stays), and no neighbour that overlaps them has a better priority
    or, with the same priority and label, stands before them."""
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), "priority", "label")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chain = found.withColumn("__reach", reach).filter("__reach is null or end > __reach").drop("__reach")
    # what is left has rising starts and ends, so the neighbours are the ones next to it
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    yields = (before("end") > F.col("start")) & ((before("priority") < F.col("priority")) | ((before("priority") == F.col("priority")) & (before("label") == F.col("label"))))
    yields = F.coalesce(yields, F.lit(False)) | F.coalesce((after("start") < F.col("end")) & (after("priority") < F.col("priority")), F.lit(False))
    return chain.withColumn("__yields", yields).filter(~F.col("__yields")).drop("__yields")


OWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan_licenses(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the weight of the best detection that stays, 0.5 for a base phrase alone, else 0. Null and empty
    texts have no words and no labels; very long texts are scanned whole; detections that tie in place and priority
    are told apart by label; equal rows get equal results; an empty table gives an empty table. Columns that aren't
    asked for don't matter; of those that are, one with the name of a new column is replaced."""
    keep, every = [c for c in keep if c not in OWN], rules()
    norm = F.col("__norm")
    rows = docs.select(*keep, normalised(F.col(text)).alias("__norm")).withColumn("n_words", F.greatest(spaces(norm) - 1, F.lit(0)))
    gated = rows.select(*keep, "n_words", *[c.alias(n) for n, c in base_matches(norm, F.col("n_words")).items()], F.when(norm.rlike(gate(every)), norm).alias("__norm"))
    hits = F.when(norm.isNotNull(), matches(norm, every))
    # written once: a row keeps its number, and no text goes further
    rows = materialize(gated.select(*keep, *OWN[:5], hits.alias("__hits"), F.monotonically_increasing_id().alias("__row")), "licenses")
    stays = resolve(placed(rows.select("__row", "__hits"), "__row", "__hits"), "__row")
    labels = stays.groupBy("__row").agg(F.collect_set("label").alias("__labels"), F.max("weight").alias("__score"))
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    own = F.coalesce("__labels", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("__score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    out = rows.drop("__hits").join(labels, "__row", "left")
    return out.select(*keep, *OWN[:5], F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"), score.alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), ["doc_id"])
