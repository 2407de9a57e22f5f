"""License scans: ordered signature rules over a text's words.

A text is written as its words between single spaces. Rules are regular expressions over this line, each behind a keyword: one
pass finds which keywords a text has, and only their rules are tried, so that a text without any costs no expression at all. A detection
is a run of words (start, end, label, priority). Of detections one of which lies within the other, the one of the better priority stays;
at the same priority the longer, then the rule that stands first. As lying within is transitive, what is suppressed by
a suppressed detection is suppressed by what suppressed that, too: the running maximum of ends for each priority, in order of starts, decides
in linear time. Base phrases are counted at all their places and are never suppressed.

All is SQL functions over a document's own row: nothing is shuffled, however often a license is repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.arrays import running, scan

#: Phrases whose places are always counted: (words, label).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, once A-Z are lower-cased
KELVIN = "K"  # the one character beyond ASCII whose lower case is ASCII: it is no k
TEXT, GRANT, NAME, HINT = 0, 1, 2, 3
#: How much a detection of each priority says; a base phrase alone says as much as a hint.
STRENGTH = (1.0, 0.9, 0.7, 0.4)

#: Licenses as ``label | keyword | name over words``. Each gives three rules: its tag, a grant under its name, and its name.
NAMES = """
0bsd | 0bsd | 0bsd(?: license)?
0bsd | zero | (?:bsd zero clause|zero clause bsd)(?: license)?
afl-3.0 | academic | academic free license(?: (?:version |v)?3(?: 0)?)?
agpl-3.0 | affero | (?:gnu )?affero general public license(?: (?:version |v )?3(?: 0)?)?
agpl-3.0 | agpl | (?:gnu )?agpl(?: (?:version |v )?3(?: 0)?)?
agpl-3.0 | agplv3 | (?:gnu )?agplv3
apache-1.0 | apache | apache (?:software )?license (?:version )?1 0
apache-1.1 | apache | apache (?:software )?license (?:version )?1 1
apache-2.0 | apache | apache (?:software )?license(?: (?:version |v)?2(?: 0)?)?
apsl-2.0 | apple | apple public source license(?: (?:version )?2(?: 0)?)?
artistic-1.0 | artistic | artistic license 1 0
artistic-2.0 | artistic | artistic license(?: (?:version )?2(?: 0)?)?
beerware | beerware | beerware(?: license)?
blueoak-1.0.0 | oak | blue oak model license(?: 1 0 0)?
bsd-1-clause | bsd | (?:1|one) clause bsd(?: license)?
bsd-2-clause | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | bsd | simplified bsd(?: license)?
bsd-3-clause | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd)(?: license)?
bsd-4-clause | bsd | (?:4|four) clause bsd(?: license)?
bsd-4-clause | bsd | (?:original bsd|old bsd)(?: license)?
bsd | bsd | bsd (?:style )?license
bsl-1.0 | boost | boost software license(?: (?:version )?1(?: 0)?)?
busl-1.1 | business | business source license(?: 1 1)?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | universal | cc0 1 0 universal public domain dedication
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by-2.0 | cc | cc by 2 0
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-sa | attribution | (?:creative commons )?attribution share(?: )?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc | attribution | (?:creative commons )?attribution non(?: )?commercial(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-sa | attribution | (?:creative commons )?attribution non(?: )?commercial share(?: )?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-nd | attribution | (?:creative commons )?attribution non(?: )?commercial no(?: )?deriv(?:s|atives)(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nd | attribution | (?:creative commons )?attribution no(?: )?deriv(?:s|atives)(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by | attribution | creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: license)?
cc | commons | creative commons(?: public)? license
cddl-1.0 | cddl | cddl(?: (?:version )?1 0)?
cddl-1.0 | distribution | common development and distribution license(?: (?:version )?1 0)?
cecill-2.1 | cecill | cecill(?: free software)?(?: license)?(?: (?:agreement )?(?:version )?2 1)?
cpal-1.0 | attribution | common public attribution license(?: (?:version )?1 0)?
cpl-1.0 | common | common public license(?: (?:version )?1 0)?
ecl-2.0 | educational | educational community license(?: (?:version )?2 0)?
epl-1.0 | eclipse | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse | eclipse public license(?: (?:version |v )?2 0)?
eupl-1.2 | eupl | eupl(?: (?:version |v )?1 2)?
eupl-1.2 | european | european union public licen[cs]e(?: (?:version |v )?1 2)?
gfdl-1.3 | documentation | (?:gnu )?free documentation license(?: (?:version )?1 3)?
gpl-1.0 | gnu | gnu general public license (?:version |v )?1(?: 0)?
gpl-2.0 | public | (?:gnu )?general public license (?:version |v )?2(?: 0)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2
gpl-2.0 | gpl | (?:gnu )?gpl (?:version |v )?2(?: 0)?
gpl-3.0 | public | (?:gnu )?general public license (?:version |v )?3(?: 0)?
gpl-3.0 | gplv3 | (?:gnu )?gplv3
gpl-3.0 | gpl | (?:gnu )?gpl (?:version |v )?3(?: 0)?
gpl | public | (?:gnu )?general public license
gpl | gpl | (?:gnu )?gpl
hpnd | hpnd | hpnd
hpnd | historical | historical permission notice and disclaimer
ipl-1.0 | ibm | ibm public license(?: (?:version )?1 0)?
isc | isc | isc license
lgpl-2.0 | library | (?:gnu )?library general public license(?: (?:version |v )?2(?: 0)?)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license (?:version |v )?2 1
lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | lesser | (?:gnu )?lesser general public license (?:version |v )?3(?: 0)?
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
lgpl | lesser | (?:gnu )?lesser general public license
lgpl | lgpl | (?:gnu )?lgpl(?: (?:version |v )?[23](?: [01])?)?
lppl-1.3c | latex | latex project public license(?: (?:version )?1 3c?)?
mit | mit | mit license
mit | mit | mit x11 license
mit | expat | expat license
mit-0 | mit | mit no attribution(?: license)?
mpl-1.1 | mozilla | mozilla public license (?:version |v )?1 1
mpl-2.0 | mozilla | mozilla public license(?: (?:version |v )?2 0)?
mpl-2.0 | mpl | mpl (?:version |v )?2 0
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ncsa | ncsa | (?:university of illinois )?ncsa open source license
odbl-1.0 | database | (?:open data commons )?open database license(?: (?:version |v )?1 0)?
odc-by-1.0 | odc | odc (?:by|attribution license)(?: 1 0)?
ofl-1.1 | font | (?:sil )?open font license(?: (?:version )?1 1)?
openrail | openrail | (?:bigscience )?openrail(?: m)?(?: license)?
openssl | openssl | openssl license
osl-3.0 | open | open software license(?: (?:version |v )?3 0)?
pddl-1.0 | pddl | (?:open data commons )?pddl(?: 1 0)?
php-3.01 | php | php license(?: (?:version )?3 01)?
postgresql | postgresql | postgresql licen[cs]e
psf-2.0 | python | python software foundation license(?: (?:version )?2)?
qpl-1.0 | qt | qt public license(?: (?:version )?1 0)?
ruby | ruby | ruby license
sleepycat | sleepycat | sleepycat license
sspl-1.0 | server | server side public license(?: (?:version |v )?1)?
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | permissive | universal permissive license(?: (?:version |v )?1 0)?
vim | vim | vim license
w3c | w3c | w3c software (?:notice and )?(?:document )?license
wtfpl | wtfpl | wtfpl(?: (?:version )?2)?
zlib | zlib | zlib(?: libpng)? license
zpl-2.1 | zope | zope public license(?: (?:version )?2 1)?
"""

#: Sentences of licenses and their addresses, as ``label | keyword | expression over words``.
TEXTS = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | sublicense | use copy modify merge publish distribute sublicense and or sell copies of the software
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd-3-clause | endorse | neither the name of (?:the )?(?:[^ ]+ ){1,12}?(?:nor the names of its contributors )?may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
isc | copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
apache-2.0 | compliance | you may not use this (?:file|software|work) except in compliance with the license
apache-2.0 | unless | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | copies | everyone is permitted to copy and distribute verbatim copies of this license document
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl-3.0 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl-2.0 | either | general public license as published by the free software foundation either version 2
gpl-3.0 | either | general public license as published by the free software foundation either version 3
gpl-2.0 | later | gpl version 2 or (?:any )?later
gpl-3.0 | later | gpl version 3 or (?:any )?later
mpl-2.0 | subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | subject | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1.0 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?1 0
cddl-1.0 | contents | the contents of this file are subject to the terms of the common development and distribution license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | machine | machine executable object code generated by a source language processor
cc0-1.0 | waived | waived all copyright and related or neighboring rights
beerware | beer | you can buy me a beer in return
ofl-1.1 | font | this font software is licensed under the sil open font license
artistic-2.0 | standard | distribute verbatim copies of the standard version of this package
postgresql | documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee
hpnd | advertising | not be used in advertising or publicity pertaining to distribution of the software without specific
ms-pl | governs | this license governs use of the accompanying software if you use the software you accept this license
ncsa | deal | to deal with the software without restriction
openssl | toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php | this product includes php software freely available from
mit | opensource | opensource org licen[cs]es? mit(?: license)?(?: php)?
bsd-3-clause | opensource | opensource org licen[cs]es? bsd 3 clause
bsd-2-clause | opensource | opensource org licen[cs]es? bsd 2 clause
apache-2.0 | apache | apache org licenses license 2 0
gpl-3.0 | gnu | gnu org licenses gpl 3 0
gpl-2.0 | gnu | gnu org licenses (?:old licenses )?gpl 2 0
gpl | gnu | gnu org licenses gpl
lgpl-3.0 | gnu | gnu org licenses lgpl 3 0
lgpl-2.1 | gnu | gnu org licenses (?:old licenses )?lgpl 2 1
agpl-3.0 | gnu | gnu org licenses agpl 3 0
mpl-2.0 | mozilla | mozilla org mpl 2 0
epl-2.0 | eclipse | eclipse org legal epl 2 0
cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
unlicense | unlicense | unlicense org
"""

#: What speaks of rights without naming a license.
HINTS = """
public-domain | domain | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
proprietary | proprietary | proprietary (?:and confidential|software|license|information)
proprietary | unauthorized | unauthorized (?:copying|reproduction|use|distribution) (?:of this (?:file|work|document) )?(?:via any medium )?is (?:strictly )?prohibited
proprietary | redistributed | may not be (?:published broadcast rewritten or )?redistributed
copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright | copyrighted | (?:is|are) copyrighted(?: material)?
no-ai | training | (?:not|may not be used) (?:be used )?for (?:the )?(?:ai|machine learning|text and data mining)(?: model)? training
permission | permission | (?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission
personal-use | personal | for personal (?:and )?(?:non(?: )?commercial )?use only
"""

GRANTS = "(?:licensed|released|distributed|published|provided|available|covered) under (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?"


@dataclass(frozen=True)
class Rule:
    """``pattern`` over a line of words, tried where ``keyword`` is one of them; rules of a lower number come first."""

    label: str
    keyword: str
    pattern: str
    priority: int


def _lines(table: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules by priority: texts and tags, grants, names, hints."""
    names = _lines(NAMES)
    tags = {label: "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", label)) + "(?: or later| only)?" for label, _, _ in names}
    found = [Rule(label, key, pattern, TEXT) for label, key, pattern in _lines(TEXTS)]
    found += [Rule(label, "spdx", pattern, TEXT) for label, pattern in tags.items()]
    found += [Rule(label, key, GRANTS + pattern, GRANT) for label, key, pattern in names]
    found += [Rule(label, key, pattern, NAME) for label, key, pattern in names]
    return found + [Rule(label, key, pattern, HINT) for label, key, pattern in _lines(HINTS)]


def word_line(text: Column) -> Column:
    """A text's words between single spaces, one before the first and after the last; one space if there are none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.replace(text, F.lit(KELVIN), F.lit("ı"))), F.lit(" ")), BETWEEN, " ")


def _spaces(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))).cast("long")


def _strings(values: list[str]) -> Column:
    """An array of strings as one literal."""
    return F.split(F.lit("\n".join(values)), "\n")


def _with_places(df: DataFrame, line: str, keywords: list[str], patterns: list[str], words: list[int | None], to: str) -> DataFrame:
    """Adds ``to``, an array of (start, less, rule): each pattern's matches as words, ``less`` is the end's negative, sorted.

    ``words`` has how many words a match of each pattern stands for, None for those that it has. A pattern is tried where its keyword is a word of the line.
    """
    keys, tried, hit = f"{to}_keys", f"{to}_tried", f"{to}_hit"
    df = df.withColumn(keys, F.array_intersect(F.split(line, " "), _strings(sorted(set(keywords)))))
    numbers = F.sequence(F.lit(0), F.lit(len(patterns) - 1))
    df = df.withColumn(tried, F.when(F.size(keys) > 0, F.filter(numbers, lambda i: F.array_contains(F.col(keys), F.get(_strings(keywords), i)))).otherwise(F.array().cast("array<int>")))
    all_hits = F.transform(tried, lambda i: F.struct(i.alias("rule"), F.regexp_extract_all(F.col(line), F.get(_strings(patterns), i), F.lit(0)).alias("hits")))
    df = df.withColumn(hit, F.filter(all_hits, lambda h: F.size(h["hits"]) > 0))
    own = F.split(F.lit(",".join(str(n or 0) for n in words)), ",").cast("array<int>")
    # words before each match, and of each match: what stands between two matches has a space more than words
    measured = F.transform(
        hit,
        lambda h: F.struct(
            h["rule"].alias("rule"),
            F.transform(F.split(F.col(line), F.get(_strings(patterns), h["rule"]), -1), lambda p: _spaces(p) - F.lit(1)).alias("gaps"),
            F.transform(h["hits"], lambda x: _spaces(x) + F.lit(1)).alias("matched"),
            F.get(own, h["rule"]).alias("words"),
        ),
    )
    added = F.transform(
        f"{to}_measured",
        lambda m: F.struct(
            m["rule"].alias("rule"),
            m["matched"].alias("matched"),
            m["words"].alias("words"),
            running(F.flatten(F.zip_with(F.slice(m["gaps"], 1, F.size(m["matched"])), m["matched"], lambda g, x: F.array(g, x)))).alias("sums"),
        ),
    )
    df = df.withColumn(f"{to}_measured", measured).withColumn(f"{to}_added", added)
    place = lambda a: F.transform(
        a["matched"],
        lambda n, i: F.struct(
            F.get(a["sums"], F.lit(2) * i + F.lit(1)).alias("start"),
            (-(F.get(a["sums"], F.lit(2) * i + F.lit(1)) + F.when(a["words"] > 0, a["words"]).otherwise(n))).alias("less"),
            a["rule"].alias("rule"),
        ),
    )
    placed = F.array_sort(F.flatten(F.transform(f"{to}_added", place)))
    return df.withColumn(to, placed).drop(keys, tried, hit, f"{to}_measured", f"{to}_added")


def find(docs: DataFrame, text_col: str = "text", own: list[Rule] | None = None, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (start, end, label) and ``found`` (start, end, label, priority, rule), arrays by start.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased, counted from 0; ends are exclusive.
    ``base`` has every place where a phrase's words stand side by side, overlapping ones too. ``found`` has the detections of the
    rules that no other suppresses. Null, empty and wordless texts have no words and empty arrays. Every row stays, repeated rows
    too. Columns of the added names are replaced; all others pass through, whatever they are called.
    """
    own = rules() if own is None else own
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_words", "base", "found")])
    line = "_license_line"
    while line in {c.lower() for c in rows.columns}:
        line = f"_{line}"
    df = rows.withColumn(line, word_line(F.col(f"`{text_col}`")))
    phrases = [p.split() for p, _ in base]
    here = [f"(?<= ){p[0]}(?= {' '.join([*p[1:], ''])})" for p in phrases]
    df = _with_places(df, line, [max(p, key=len) for p in phrases], here, [len(p) for p in phrases], f"{line}_base")
    df = _with_places(df, line, [r.keyword for r in own], [f"(?<= )(?:{r.pattern})(?= )" for r in own], [None] * len(own), f"{line}_found")
    priorities = F.split(F.lit(",".join(str(r.priority) for r in own)), ",").cast("array<int>")
    dets = f"{line}_dets"
    ordered = F.array_sort(
        F.transform(
            f"{line}_found",
            lambda d: F.struct(d["start"].alias("start"), d["less"].alias("less"), F.get(priorities, d["rule"]).alias("priority"), d["rule"].alias("rule")),
        )
    )
    df = df.withColumn(dets, ordered)
    # how far better or equal detections before each one reach: arrays are put side by side, as a column read inside a lambda may be worked out for every element
    zero = F.lit(0).cast("long")
    limits = F.transform(dets, lambda d: F.struct(d.alias("d"), zero.alias("reach")))

    def with_reach(limits: Column, p: int) -> Column:
        ends = F.transform(dets, lambda d: F.when(d["priority"] <= p, -d["less"]).otherwise(zero))
        reached = F.slice(scan(ends, zero, lambda a, b: F.greatest(a, b)), 1, F.size(dets))
        return F.zip_with(limits, reached, lambda x, m: F.struct(x["d"].alias("d"), F.when(x["d"]["priority"] == p, m).otherwise(x["reach"]).alias("reach")))

    limits = reduce(with_reach, range(len(STRENGTH)), limits)
    kept = F.when(F.size(dets) > 1, F.transform(F.filter(limits, lambda x: x["reach"] < -x["d"]["less"]), lambda x: x["d"])).otherwise(F.col(dets))
    labels, base_labels = _strings([r.label for r in own]), _strings([label for _, label in base])
    named = lambda d, names: (d["start"].alias("start"), (-d["less"]).alias("end"), F.get(names, d["rule"]).alias("label"))
    return df.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        (_spaces(F.col(line)) - F.lit(1)).alias("n_words"),
        F.transform(f"{line}_base", lambda d: F.struct(*named(d, base_labels))).alias("base"),
        F.transform(kept, lambda d: F.struct(*named(d, labels), d["priority"].alias("priority"), d["rule"].alias("rule"))).alias("found"),
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found) of ``find``'s rows.

    ``first_word`` and ``last_word`` are the least and the greatest start of a base phrase, null without any; labels are distinct, sorted
    and comma-joined; ``score`` is the strength of the best detection, a base phrase counting as a hint, 0 without any.
    """
    starts = F.transform("base", lambda b: b["start"])
    joined = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    own, theirs = F.transform("base", lambda b: b["label"]), F.transform("found", lambda d: d["label"])
    strength = F.array(*[F.lit(s) for s in STRENGTH])
    best = reduce(F.greatest, [F.coalesce(F.array_max(F.transform("found", lambda d: F.get(strength, d["priority"]))), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(STRENGTH[HINT])).otherwise(F.lit(0.0))])
    return scanned.select(
        F.col(id_col).alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(own, theirs).alias("labels"),
        best.alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
