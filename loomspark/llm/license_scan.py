"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes words. Each rule is a regular expression over words with one keyword marked by `@`; rules are tried only
around the words that are some rule's keyword, as far as the longest text of any rule reaches, and only if the text near them also has the word the rule needs. A
match is an interval of words with the rule's label and priority. Expressions after `SPDX-License-Identifier:` are read from the text itself, whatever licenses they
name: operands with `+`, AND, OR, WITH and parentheses. One operator alone: its operands without repeats, shorter first, joined by it; both: as written. A match is suppressed if a match of the same or a
stronger priority covers its interval; equal intervals go to the stronger, then the earlier rule.

Scale: one pass over the texts; what moves is one row for each keyword found, with its neighbouring words, and one for
each document. The rules are a fixed table of some hundreds of rows, so they may be broadcast.

Edge cases: null and empty texts have no words and no labels; each row is a document of its own, so rows repeated in full
give a row each; phrases may overlap; a tag without an expression names no license; parentheses too many or too few at an
expression's end are dropped or added. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, read_table, words_of

SPDX, FULL, GRANT, NAME, MENTION, BASE = range(6)
CONFIDENCE = {SPDX: 1.0, FULL: 0.95, GRANT: 0.9, NAME: 0.8, MENTION: 0.7, BASE: 0.6}
#: Label, a word that must stand near, and the license's name over words.
NAMES = [
    ("mit", "mit", "mit"), ("apache-2.0", "apache", "apache(?: license)?(?: version)? 2(?: 0)?"), ("apache-1.1", "apache", "apache(?: software)?(?: version)? 1 1"),
    ("apache", "apache", "apache(?: software)?"), ("gpl-2.0", "gnu", "gnu (?:general public license|gpl)(?: version| v)? 2(?: 0)?"), ("gpl-3.0", "gnu", "gnu (?:general public license|gpl)(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: version| v)? 2(?: 1)?"), ("lgpl-3.0", "lesser", "gnu lesser general public license(?: version| v)? 3(?: 0)?"),
    ("agpl-3.0", "affero", "gnu affero general public license(?:(?: version| v)? 3(?: 0)?)?"), ("gpl", "gnu", "gnu general public"), ("lgpl", "lesser", "gnu lesser general public"),
    ("bsd-3-clause", "3", "bsd 3 clause"), ("bsd-3-clause", "new", "new bsd"), ("bsd-2-clause", "2", "bsd 2 clause"), ("bsd-2-clause", "simplified", "simplified bsd"), ("bsd", "bsd", "bsd(?: style)?"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?"), ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1"), ("mpl", "mozilla", "mozilla public"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?"), ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?"), ("epl", "eclipse", "eclipse public"),
    ("cddl-1.0", "distribution", "common development and distribution"), ("artistic-2.0", "artistic", "artistic(?: license)?(?: version)? 2(?: 0)?"), ("artistic", "artistic", "artistic"),
    ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("boost", "boost", "boost software"), ("unlicense", "the", "the unlicense"), ("wtfpl", "want", "do what the fuck you want to public"),
    ("cc-by-4.0", "attribution", "creative commons attribution 4(?: 0)?(?: international)?"), ("cc-by-sa-4.0", "sharealike", "creative commons attribution sharealike 4(?: 0)?(?: international)?"),
    ("cc-by-nc-4.0", "noncommercial", "creative commons attribution noncommercial 4(?: 0)?(?: international)?"), ("cc-by-3.0", "attribution", "creative commons attribution 3(?: 0)?(?: unported)?"),
    ("cc-by-sa-3.0", "sharealike", "creative commons attribution sharealike 3(?: 0)?(?: unported)?"), ("cc-by", "attribution", "creative commons attribution"), ("cc", "commons", "creative commons"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("ofl-1.1", "font", "(?:sil )?open font"), ("python-2.0", "python", "python software foundation"), ("openssl", "openssl", "openssl"), ("postgresql", "postgresql", "postgresql"),
    ("eupl-1.2", "european", "european union public"), ("ms-pl", "microsoft", "microsoft public"), ("vim", "vim", "vim"), ("ruby", "ruby", "ruby"), ("php-3.01", "php", "php"), ("odbl-1.0", "database", "open database"),
]
#: How a license is named or granted; `{}` is its name. The keyword is marked by `@`.
SHAPES = [
    (GRANT, "(?:licensed|released|distributed|available|published|provided|covered|governed by|subject to|according to|in compliance with)(?: under)?(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {} @license"),
    (GRANT, "@licensed under (?:the )?(?:terms of )?(?:the )?{}"),
    (NAME, "(?:the )?{} @license(?: agreement)?(?: version| v) ?[0-9]+(?: [0-9]+)?"),
    (MENTION, "{} @license"),
    (MENTION, "{} @licence"),
]
#: Rules for single texts: label, a word that must stand near, expression. FULL: sentences of a license or its notice.
SENTENCES = [
    ("mit", "charge", "permission is @hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", "permission", "the above @copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "merge", "to use copy modify merge publish distribute @sublicense and or sell copies of the software"),
    ("mit", "noninfringement", "the software is provided as is without @warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "style", "use of this source code is governed by an mit style @license"),
    ("x11", "advertising", "of the above @copyright (?:holder|holders) shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("hpnd", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is @hereby granted"),
    ("postgresql", "agreement", "for any purpose without fee and without a written agreement is @hereby granted"),
    ("isc", "fee", "to use copy modify (?:and or |and )?distribute this software for any purpose with or without fee is @hereby granted"),
    ("bsd", "binary", "@redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
    ("bsd", "retain", "@redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce", "@redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "holders", "this software is provided by the copyright holders and contributors as is and any express or implied @warranties"),
    ("bsd", "style", "use of this source code is governed by a bsd style @license"),
    ("bsd-3-clause", "promote", "(?:name|names) of (?:its|the) contributors may be used to @endorse or promote products derived from this software"),
    ("bsd-3-clause", "promote", "(?:may|must) not be used to @endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", "patent", "no express or implied @licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following @acknowledgement"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following @acknowledgment"),
    ("openssl", "whatsoever", "@redistributions of any form whatsoever must retain the following (?:acknowledgment|acknowledgement)"),
    ("apache-2.0", "apache", "@licensed under the apache license version 2 0 the license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the @license"),
    ("apache-2.0", "apache", "you may obtain a copy of the @license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2.0", "writing", "unless required by applicable law or agreed to in writing software distributed under the @license is distributed on an as is basis"),
    ("apache-2.0", "asf", "@licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "irrevocable", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable @copyright license"),
    ("apache-2.0", "january", "apache @license version 2 0 january 2004"),
    ("gpl", "modify", "(?:this program is free software )?you can @redistribute it and or modify it(?: under the terms of the gnu general public license)?(?: as published by the free software foundation)?"),
    ("gpl", "hope", "distributed in the hope that it will be useful but without any @warranty"),
    ("gpl", "received", "you should have received a copy of the gnu general public @license along with this (?:program|file|library|package)"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this @license document but changing it is not allowed"),
    ("gpl-2.0", "freedom", "the @licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft @license for software and other kinds of works"),
    ("gpl-2.0-or-later", "later", "either version 2 of the @license or at your option any later version"),
    ("gpl-3.0-or-later", "later", "either version 3 of the @license or at your option any later version"),
    ("lgpl-2.1-or-later", "later", "either version 2 1 of the @license or at your option any later version"),
    ("gpl-2.0-only", "published", "gnu general public @license (?:version|v) 2 as published by the free software foundation"),
    ("gpl-2.0-only", "published", "gnu general public @license as published by the free software foundation version 2 of the license"),
    ("gpl-3.0-only", "published", "gnu general public @license (?:version|v) 3 as published by the free software foundation"),
    ("gpl-3.0-only", "published", "gnu general public @license as published by the free software foundation version 3 of the license"),
    ("lgpl", "library", "this library is free software you can @redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public @license"),
    ("lgpl-2.0", "library", "gnu library general public @license(?: version| v)? 2"),
    ("agpl-3.0", "received", "you should have received a copy of the gnu affero general public @license"),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public @license as published by the free software foundation"),
    ("gfdl", "document", "copy distribute and or modify this document under the terms of the gnu free documentation @license"),
    ("gfdl-1.3", "documentation", "gnu free documentation @license (?:version|v) 1 3"),
    ("gfdl-1.2", "documentation", "gnu free documentation @license (?:version|v) 1 2"),
    ("classpath-exception-2.0", "modules", "@linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception-2.0", "classpath", "@gpl(?: version| v)? 2(?: 0)?(?: only)? with (?:the )?classpath exception"),
    ("linking-exception", "link", "as a special exception the @copyright (?:holder|holders) of this library give you permission to link"),
    ("gcc-exception-3.1", "runtime", "gcc runtime library @exception(?: version)? 3 1"),
    ("bison-exception-2.2", "bison", "as a special @exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "autoconf", "as part of a program that contains a configuration script generated by autoconf you may include it under the same @distribution terms"),
    ("linux-syscall-note", "kernel", "this @copyright does not cover user programs that use kernel services by normal system calls"),
    ("mpl-2.0", "form", "this source code form is subject to the terms of the mozilla public @license v 2 0"),
    ("mpl-2.0", "obtain", "you can obtain one at (?:http|https) @mozilla org mpl 2 0"),
    ("mpl-2.0-no-copyleft-exception", "incompatible", "this source code form is incompatible with secondary @licenses"),
    ("mpl-1.1", "contents", "the contents of this file are subject to the mozilla public @license version 1 1"),
    ("mpl-1.1", "governing", "see the @license for the specific language governing rights and limitations under the license"),
    ("epl-2.0", "accompanying", "the accompanying materials are made available under the terms of the eclipse public @license(?: version| v)? 2 0"),
    ("epl-1.0", "accompanying", "the accompanying materials are made available under the terms of the eclipse public @license(?: version| v)? 1 0"),
    ("cddl-1.0", "contents", "the contents of this file are subject to the terms of the common development and distribution @license"),
    ("cpl-1.0", "common", "common public @license(?: version| v)? 1 0"),
    ("ipl-1.0", "ibm", "ibm public @license(?: version| v)? 1 0"),
    ("zlib", "authors", "this software is provided as is without any express or implied @warranty in no event will the authors be held liable"),
    ("zlib", "alter", "including commercial applications and to alter it and @redistribute it freely"),
    ("boost", "organization", "permission is @hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("boost", "boost", "distributed under the boost software @license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public @domain"),
    ("unlicense", "dedicate", "the author or authors of this software dedicate any and all @copyright interest in the software to the public domain"),
    ("cc0-1.0", "neighboring", "waived all @copyright and related or neighboring rights"),
    ("cc0-1.0", "deed", "who associated a work with this deed has dedicated the work to the public @domain"),
    ("cc-by-4.0", "attribution", "this work is @licensed under (?:a|the) creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "sharealike", "this work is @licensed under (?:a|the) creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "noncommercial", "this work is @licensed under (?:a|the) creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-4.0", "noderivatives", "this work is @licensed under (?:a|the) creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa-4.0", "sharealike", "this work is @licensed under (?:a|the) creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4.0", "noderivatives", "this work is @licensed under (?:a|the) creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("wtfpl", "allowed", "verbatim or modified copies of this @license document and changing it is allowed as long as the name is changed"),
    ("artistic-1.0", "artistic", "such that the @copyright holder maintains some semblance of artistic control"),
    ("artistic-1.0-or-gpl", "perl", "you (?:can|may) @redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("python-2.0", "psf", "psf is making python available to @licensee on an as is basis"),
    ("python-2.0", "psf", "subject to the terms and conditions of this @license agreement psf hereby grants licensee"),
    ("ofl-1.1", "font", "this font software is @licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "fonts", "the ofl allows the @licensed fonts to be used studied modified and redistributed freely"),
    ("tcl", "retained", "use copy modify distribute and @license this software and its documentation for any purpose provided that existing copyright notices are retained"),
    ("w3c", "w3c", "w3c software (?:notice and|and document notice and) @license"),
    ("unicode", "unicode", "unicode inc @license agreement data files and software"),
    ("ncsa", "illinois", "university of illinois ncsa open source @license"),
    ("eupl-1.2", "eupl", "@licensed under the eupl(?: version| v)?(?: 1 2)?"),
    ("busl-1.1", "business", "business source @license(?: version)? 1 1"),
    ("sspl-1.0", "server", "server side public @license(?: version| v)? 1"),
    ("elastic-2.0", "elastic", "elastic @license(?: version| v)? 2 0"),
    ("proprietary", "confidential", "this software is the confidential and @proprietary information of"),
    ("proprietary", "property", "@licensed materials property of"),
    ("proprietary", "prohibited", "@reproduction or distribution (?:of this (?:file|software|material) )?(?:without (?:prior )?(?:written )?permission )?is strictly prohibited"),
    ("public-domain", "public", "(?:released|dedicated|placed|put) (?:in|into|to) the public @domain"),
    ("public-domain", "public", "this (?:file|work|code|software|program) is in the public @domain"),
]
#: Expressions after an SPDX tag: label, the last word, the words.
EXPRESSIONS = [
    ("gpl-2.0-only", "only", "gpl 2 0 only"), ("gpl-2.0-or-later", "later", "gpl 2 0 or later"), ("gpl-3.0-only", "only", "gpl 3 0 only"), ("gpl-3.0-or-later", "later", "gpl 3 0 or later"),
    ("lgpl-2.1-only", "only", "lgpl 2 1 only"), ("lgpl-2.1-or-later", "later", "lgpl 2 1 or later"), ("lgpl-3.0-only", "only", "lgpl 3 0 only"), ("lgpl-3.0-or-later", "later", "lgpl 3 0 or later"),
    ("agpl-3.0-only", "only", "agpl 3 0 only"), ("agpl-3.0-or-later", "later", "agpl 3 0 or later"), ("mit-or-apache-2.0", "apache", "mit or apache 2 0"), ("mit-or-apache-2.0", "apache", "apache 2 0 or mit"),
    ("mit-and-apache-2.0", "apache", "mit and apache 2 0"), ("mit-and-apache-2.0", "apache", "apache 2 0 and mit"), ("apache-2.0-with-llvm-exception", "llvm", "apache 2 0 with llvm exception"), ("gpl-2.0-with-classpath-exception", "classpath", "gpl 2 0(?: only)? with classpath exception 2 0"),
    ("gpl-2.0-with-linux-syscall-note", "syscall", "gpl 2 0(?: only)? with linux syscall note"), ("gpl-2.0-or-mit", "mit", "gpl 2 0(?: only| or later)? or mit"), ("gpl-2.0-or-bsd", "bsd", "gpl 2 0(?: only| or later)? or bsd [0-9]+ clause"), ("0bsd", "0bsd", "0bsd"), ("mit-0", "mit", "mit 0"),
]
#: Shorter phrases: label, a word that must stand near, expression.
PHRASES = [
    ("gpl-2.0", "gpl", "@gpl(?: version| v)? 2(?: 0)?"), ("gpl-3.0", "gpl", "@gpl(?: version| v)? 3(?: 0)?"), ("gpl", "gpl", "(?:gnu )?@gpl"),
    ("lgpl-2.1", "lgpl", "@lgpl(?: version| v)? 2 1"), ("lgpl-3.0", "lgpl", "@lgpl(?: version| v)? 3(?: 0)?"), ("lgpl", "lgpl", "(?:gnu )?@lgpl"), ("agpl-3.0", "agpl", "@agpl(?: version| v)? 3(?: 0)?"), ("agpl", "agpl", "(?:gnu )?@agpl"),
    ("public-domain", "public", "public @domain"), ("proprietary", "rights", "all rights @reserved"), ("cc", "some", "some rights @reserved"), ("cc", "creative", "creative @commons"), ("proprietary", "confidential", "@proprietary and confidential"), ("proprietary", "confidential", "confidential and @proprietary"),
    ("eula", "user", "end user @license agreement"), ("commercial", "commercial", "commercial @license"), ("dual", "dual", "dual @licensed"), ("dual", "dual", "dual @license"), ("see-license", "see", "see (?:the )?@license(?: file| txt| md)? for (?:details|more information|license information)"),
    ("json", "json", "json @license"), ("beerware", "beer", "beer ware @license"), ("curl", "curl", "curl @license"), ("libpng", "libpng", "libpng @license"), ("ms-rl", "reciprocal", "microsoft reciprocal @license"), ("afl-3.0", "academic", "academic free @license"), ("osl-3.0", "software", "open software @license"),
    ("ogl-3.0", "government", "open government @licence(?: version| v)?(?: 3 0)?"), ("eupl-1.2", "union", "european union public @licence(?: version| v)?(?: 1 2)?"), ("odc-by-1.0", "commons", "open data commons attribution @license"), ("pddl-1.0", "dedication", "public domain dedication and @license"),
    ("commons-clause", "clause", "commons clause @license condition"), ("polyform-noncommercial", "polyform", "polyform noncommercial @license"), ("llama", "community", "llama(?: [0-9]+)? community @license"), ("openrail", "rail", "open rail(?: m)? @license"), ("gpl", "copyleft", "copyleft @license"),
]
#: The phrases that every scan reports, with their labels.
BASE_PHRASES = [("mit", "mit", "mit @license"), ("apache", "apache", "apache @license"), ("gpl", "public", "general public @license")]
#: Parts of words, one of which each keyword has; a text without any of them has no keyword.
STEMS = ["licen", "hereby", "redistribut", "domain", "reserved", "mozilla", "commons", "gpl", "copyright", "warrant", "endorse", "acknowledg", "linking", "exception", "distribution", "proprietary", "reproduction"]


def rules() -> list[tuple]:
    """(rule, label, priority, keyword, need, expression, base): a fixed table of some hundreds of rows."""
    out = [(label, BASE, need, rx, True) for label, need, rx in BASE_PHRASES]
    out += [(label, FULL, need, rx, False) for label, need, rx in SENTENCES]
    out += [(label, SPDX, need, f"spdx @license identifier {rx}", False) for label, need, rx in EXPRESSIONS]
    out += [(label, MENTION, need, rx, False) for label, need, rx in PHRASES]
    for label, need, name in NAMES:
        spdx = label.replace("-", " ").replace(".", " ")
        if (tag := (label, SPDX, spdx.split()[-1], f"spdx @license identifier {spdx}", False)) not in out:
            out.append(tag)
        out += [(label, priority, need, shape.format(name), False) for priority, shape in SHAPES]
    out = [(label, priority, need, rx.replace("(?: version| v)? ", "(?: version| v)? (?:v)?"), base) for label, priority, need, rx, base in out]  # also v2 in one word
    return [(i, label, priority, re.search("@([a-z]+)", rx)[1], need, rx, base) for i, (label, priority, need, rx, base) in enumerate(out)]


def longest(rx: str) -> str:
    """The text of most words that a rule's expression matches."""
    rx = rx.replace("[0-9]+", "7").replace(" ?", " ")
    while "(" in rx:
        rx = re.sub(r"\(\?:([^()]*)\)\??", lambda m: max(m[1].split("|"), key=lambda x: x.count(" ")), rx)
    return rx


def reach() -> tuple[int, int]:
    """How many words before and after a keyword the rules can use."""
    sides = [longest(r[5]).split("@") for r in rules()]
    return max(before.count(" ") for before, _ in sides), max(after.count(" ") for _, after in sides)


#: A word's character, for looking around.
IN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: What stands before the expression of a tag.
TAG = "spdx-license-identifier"
#: Marks the tags whose expression is read; this private character is another one in the texts.
MARK, UNMARKED = "\ue0f1", "\ue0f2"
_ID = rf"[a-z0-9]++(?:[.:-]++[a-z0-9]++)*+\+?+(?!{IN_WORD})"
_OPERAND = rf"(?:\([ \t]*+)*+{_ID}(?:[ \t]*+\))*+"
#: An expression: operands joined by operators, on one line.
EXPRESSION = rf"^[ \t]*({_OPERAND}(?:[ \t]++(?:and|or|with)[ \t]++{_OPERAND})*+)"


def operands(x: Column) -> Column:
    """The licenses of an expression, with their exceptions, without repeats, shorter first; `+` is `-or-later`."""
    x = F.replace(F.regexp_replace(F.translate(x, "()\t", "   "), " {2,}", " "), F.lit("+"), F.lit("-or-later"))
    x = F.replace(F.regexp_replace(x, " or later(?![a-z0-9.:-])", "-or-later"), F.lit(" with "), F.lit("-with-"))
    each = F.array_distinct(F.split(F.trim(x), " (?:and|or) "))
    return F.transform(F.array_sort(F.transform(each, lambda o: F.struct(F.length(o).alias("n"), o.alias("o")))), lambda o: o["o"])


def expression_label(x: Column) -> Column:
    """The label of an expression."""
    y = F.replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?<=\() | (?=\))", ""), F.lit("+"), F.lit("-or-later"))
    y = F.regexp_replace(F.regexp_replace(y, " or later(?![a-z0-9.:-])", "-or-later"), " (with) ", "-$1-")
    mixed = y.contains(" and ") & y.contains(" or ")
    bare = F.rtrim(y, F.lit(")"))
    n = lambda c: F.length(y) - F.length(F.replace(y, F.lit(c), F.lit("")))
    closing = F.length(y) - F.length(bare) + n("(") - n(")")
    whole = F.regexp_replace(F.concat(bare, F.repeat(F.lit(")"), F.greatest(closing, F.lit(0)))), " (and|or) ", "-$1-")
    return F.when(mixed, whole).when(y.contains(" and "), F.array_join(operands(x), "-and-")).otherwise(F.array_join(operands(x), "-or-"))


def rule_table(spark) -> DataFrame:
    rows = ", ".join(f"({i}, '{label}', {priority}, '{keyword}', '{need}', '{rx}', {base})" for i, label, priority, keyword, need, rx, base in rules())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, label, priority, keyword, need, rx, base)")


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(row, id, n_words, i, word, near, the rule, hit): a row a rule that matches, one an expression, and one a document, whose i is -1."""
    table = rule_table(docs.sparkSession)
    keywords = sorted({r[3] for r in rules()})
    n_before, n_after = reach()

    def places(ws: Column) -> Column:
        def near(w: Column, i: Column) -> Column:
            before = F.array_join(F.slice(ws, F.greatest(F.lit(1), i - n_before + 1), F.least(i, F.lit(n_before))), " ")
            after = F.array_join(F.slice(ws, i + 2, F.lit(n_after)), " ")
            return F.struct(i.alias("i"), w.alias("word"), F.concat(F.lit(" "), before, F.lit(" @"), w, F.lit(" "), after, F.lit(" ")).alias("near"))

        found = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i).isin(keywords))
        return F.transform(found, lambda i: near(F.get(ws, i), i))

    def tags(ws: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i) == MARK + "spdx")
        lines = F.split("low", MARK + TAG + ":")
        read = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.regexp_extract(x, EXPRESSION, 1))
        both = F.zip_with(at, read, lambda i, x: F.struct(i.alias("i"), F.lit(MARK).alias("word"), x.alias("near")))
        return F.filter(both, lambda x: x["near"] != "")

    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    marked = F.regexp_replace(F.translate("low", MARK, UNMARKED), rf"(?<!{IN_WORD}){TAG}[ \t]*:", MARK + TAG + ":")
    may = F.lit(False)
    for stem in STEMS:
        may = may | F.col("low").contains(stem)
    none = F.array().cast("array<struct<i:int,word:string,near:string>>")
    own = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("word"), F.lit("").alias("near")))
    each = let(
        words_of(F.col("low")),
        lambda ws: F.array(F.struct(F.size(ws).alias("n"), F.concat(own, F.when(may & (F.size(ws) > 0), places(ws)).otherwise(none), F.when(F.col("low").contains(MARK), tags(ws)).otherwise(none)).alias("at"))),
    )
    found = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), low.alias("low"))
        .withColumn("low", F.when(F.col("low").contains(TAG), marked).otherwise(F.translate("low", MARK, UNMARKED)))
        .select("row", "id", F.get(each, F.lit(0)).alias("e"))
        .select("row", "id", F.col("e.n").cast("long").alias("n_words"), F.explode("e.at").alias("p"))
        .select("row", "id", "n_words", "p.*")
    )
    hit = F.regexp_substr("near", F.concat(F.lit(" "), F.col("rx"), F.lit("(?= )")))
    needed = (F.col("need") == F.col("keyword")) | F.col("near").contains(F.concat(F.lit(" "), F.col("need"), F.lit(" ")))
    gated = found.join(F.broadcast(table), (F.col("word") == F.col("keyword")) & needed, "left")
    return gated.withColumn("hit", F.when(F.col("rule").isNotNull(), hit)).where((F.col("i") < 0) | (F.col("word") == MARK) | F.col("hit").isNotNull())


def matches(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(row, id, n_words, rule, label, priority, base, start, stop, operands, kept): one row a match, and one a document, without a start.

    Expressions are rule -1; `operands` are their licenses. `kept` are the matches that suppression leaves.
    """
    hit = F.ltrim("hit")
    start = F.col("i") - (F.size(F.split(F.substring_index(hit, "@", 1), " ")) - 1)
    m, tag = F.col("hit").isNotNull(), F.col("word") == MARK

    def either(of_tag: Column, of_rule: Column) -> Column:
        return F.when(tag, of_tag).when(m, of_rule)

    placed = scan(docs, id_col, text_col).select(
        "row", "id", "n_words", either(F.lit(-1), F.col("rule")).alias("rule"), either(expression_label(F.col("near")), F.col("label")).alias("label"), either(F.lit(SPDX), F.col("priority")).alias("priority"), either(F.lit(False), F.col("base")).alias("base"),
        either(F.col("i"), start).alias("start"), either(F.col("i") + 3 + F.size(words_of(F.col("near"))), start + F.size(F.split(hit, " ")) - 1).alias("stop"), F.when(tag, operands(F.col("near"))).alias("operands"),
    )
    earlier = Window.partitionBy("row").orderBy(F.col("start"), F.desc("stop"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covers = F.lit(False)
    for p in range(BASE + 1):
        far = F.max(F.when(F.col("priority") == p, F.col("stop"))).over(earlier)
        covers = covers | F.coalesce((far >= F.col("stop")) & (F.col("priority") >= p), F.lit(False))
    return placed.withColumn("kept", F.col("start").isNotNull() & ~covers)


def summarize(found: DataFrame, id_col="doc_id") -> DataFrame:
    """One row for each document."""
    base = F.coalesce("base", F.lit(False))
    trust = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("priority"))
    return found.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | F.col("kept"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), trust)), F.lit(0.0)).alias("score"),
    ).drop("row").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return summarize(matches(read_table(spark, sf_dir, "documents")))
