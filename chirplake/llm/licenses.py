"""License scan, by DataFrame functions alone.

Texts are brought to words: lower case, everything that is no letter, digit or
beyond ASCII made one space.  Signature rules are regular expressions over that
form.  They are gated thrice: a text without any general license word runs none
of them; a name, short name or wording is looked for, by one constant pattern,
only where its keyword stands in the text; and the rules made of it run only
where it was found.  No rule can match without its gate's pattern.

Detections are word intervals with the rule's priority.  A detection inside
another is suppressed when the outer one is longer, or is of higher priority;
of equal ones the earlier rule stays.  Of those left, one that overlaps another
of higher priority is suppressed; equal priorities both stay.  The base phrases
are counted apart and are never suppressed.

Defined cases: null text is empty, without words, labels or score; equal rows
are each answered; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import PART, let, placed
from .shared import id_and_text

# The phrases and labels that the results are defined by.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licenses: label, how the name reads in words, versions ("" for none).
NAMES = (
    ("gpl", "gnu general public licen[cs]e", ("1", "2", "3")),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
    ("agpl", "gnu affero general public licen[cs]e", ("1", "3")),
    ("gfdl", "gnu free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mit", "mit licen[cs]e", ("",)),
    ("bsd-2-clause", "(?:simplified|2 clause) bsd licen[cs]e", ("",)),
    ("bsd-3-clause", "(?:new|revised|modified|3 clause) bsd licen[cs]e", ("",)),
    ("mpl", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("cddl", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common public licen[cs]e", ("1 0",)),
    ("eupl", "european union public licen[cs]e", ("1 1", "1 2")),
    ("artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("bsl", "boost software licen[cs]e", ("1 0",)),
    ("isc", "isc licen[cs]e", ("",)),
    ("zlib", "zlib licen[cs]e", ("",)),
    ("psf", "python software foundation licen[cs]e", ("2",)),
    ("cc-by", "(?:cc by|creative commons attribution)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", ("2 0", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?derivatives)", ("3 0", "4 0")),
    ("cc0", "(?:cc0|creative commons zero)", ("1 0",)),
    ("odbl", "open database licen[cs]e", ("1 0",)),
    ("ofl", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("unlicense", "the unlicense", ("",)),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", ("2",)),
    ("ms-pl", "microsoft public licen[cs]e", ("",)),
)
# How a license is named in a text: pattern around the name, priority, score.
FORMS = (
    ("spdx license identifier {id}", 100, 1.0),
    ("(?:is |are )?licensed under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 90, 0.95),
    ("(?:is |are )?(?:distributed|released|published|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 80, 0.9),
    ("under the terms of (?:the )?{name}", 70, 0.85),
    ("{name}", 50, 0.6),
)
# Short names: label, pattern, keyword, versions ("" for the name alone).
SHORT = (
    ("gpl", "(?:gnu )?gpl", " gpl", ("", "1", "2", "3")),
    ("lgpl", "(?:gnu )?lgpl", " lgpl", ("", "2", "2 1", "3")),
    ("agpl", "(?:gnu )?agpl", " agpl", ("", "1", "3")),
    ("apache", "apache", " apache", ("1 0", "1 1", "2 0")),
    ("apache", "asl", " asl", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", " mpl", ("1 0", "1 1", "2 0")),
    ("epl", "epl", " epl", ("1 0", "2 0")),
    ("cddl", "cddl", " cddl", ("", "1 0", "1 1")),
    ("eupl", "eupl", " eupl", ("", "1 1", "1 2")),
    ("bsl", "bsl", " bsl", ("1 0",)),
    ("bsl", "boost", " boost", ("1 0",)),
    ("wtfpl", "wtfpl", " wtfpl", ("", "2")),
    ("bsd", "bsd (?:style )?licen[cs]ed?", " bsd ", ("",)),
    ("bsd", "licensed under (?:the |a )?bsd", " bsd ", ("",)),
    ("bsd-2-clause", "bsd 2 clause(?: licen[cs]e)?", " bsd ", ("",)),
    ("bsd-3-clause", "bsd 3 clause(?: licen[cs]e)?", " bsd ", ("",)),
    ("mit", "(?:mit (?:style )?licensed|mit style licen[cs]e|licensed under (?:the )?mit)", " mit ", ("",)),
    ("mit", "expat licen[cs]e", " expat ", ("",)),
    ("mit", "x11 licen[cs]e", " x11 ", ("",)),
)
_NOTICE = "this [^ ]+ is free software you can redistribute it"
_FSF = "(?: as published by the free software foundation)?"
# Wording of licenses and notices: label, keyword, pattern.
TEXTS = (
    ("mit", " hereby ", "permission is hereby granted free of charge(?: to any person obtaining a copy(?: of this software and associated documentation files(?: the software)?)?)?"),
    ("mit", " substantial ", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsl", " organization ", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl", " font ", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("isc", " fee ", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", " fee ", "permission to use copy modify(?: and)? distribute (?:and sell )?this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted"),
    ("bsd", " redistribution ", "redistribution and use in source and binary forms(?: with or without modification are permitted(?: provided that the following conditions are met)?)?"),
    ("bsd-3-clause", " endorse ", "neither the names? of (?:[^ ]+ ){1,16}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", " advertising ", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", " redistribute ", "this program is free software you can redistribute it(?: and or modify it)?"),
    ("lgpl", " redistribute ", "this library is free software you can redistribute it(?: and or modify it)?"),
    *((label, " redistribute ", f"{_NOTICE} and or modify it under the terms of (?:the )?gnu {kind}general public licen[cs]e{_FSF}") for label, kind in (("gpl", ""), ("lgpl", "(?:lesser|library) "), ("agpl", "affero "))),
    *((f"{label}-{v.replace(' ', '.')}", " redistribute ", f"{_NOTICE} and or modify it under the terms of (?:the )?gnu {kind}general public licen[cs]e{_FSF}(?: either)? version {v} of the licen[cs]e") for label, kind, versions in (("gpl", "", "1|2|3"), ("lgpl", "(?:lesser|library) ", "2|2 1|3"), ("agpl", "affero ", "1|3")) for v in versions.split("|")),
    ("apache", " compliance ", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache", " reproduction ", "terms and conditions for use reproduction and distribution"),
    ("apache-2.0", " basis ", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("mpl-2.0", " mozilla ", "this source code form is subject to the terms of the mozilla public licen[cs]e(?: v 2 0)?"),
    ("mpl-1.1", " mozilla ", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl", " eclipse ", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", " development ", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("unlicense", " unencumbered ", "this is free and unencumbered software released into the public domain"),
    ("zlib", " liable ", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", " misrepresented ", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("cc0", " waived ", "waived all copyright and related or neighbou?ring rights"),
    ("wtfpl", " verbatim ", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document"),
    ("artistic", " intent ", "the intent of this document is to state the conditions under which a package may be copied"),
    ("psf", " python ", "this licen[cs]e agreement is between the python software foundation"),
    ("ms-pl", " governs ", "this licen[cs]e governs use of the accompanying software"),
)
#: A text with none of these words has no license.
GENERAL = r" (?:licen[cs]e[ds]?|spdx|cc|cc0|creative|copyright|unlicense|(?:[al]?gpl|asl|apache|mpl|epl|cddl|eupl|bsl|boost|wtfpl)(?:v?[0-9])?|bsd|hereby|redistribut(?:e|ion)|reproduction|endorse|advertising|unencumbered|liable|misrepresented|waived|intent) "
BASE_SCORE = 0.5
#: No rule matches so many words.
LONGEST = 64


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, score), in order: every license and version in every form, short names, wording."""
    out = []
    for label, name, versions in NAMES:
        keyword = " " + next(w for w in name.replace("(?:", " ").replace("|", " ").split() if w.isalpha() or w == "cc0")
        keyword = {"cc": " c", "cc0": " c"}.get(keyword.strip(), keyword)
        if "(?:" in name[:3] or name.startswith("(?:"):
            keyword = {"bsd-2-clause": " bsd ", "bsd-3-clause": " bsd ", "ofl": " font "}.get(label, " c")
        for version in dict.fromkeys(["", *versions]):
            tail = f"(?: version| v)? ?v?{version}" if version else ""
            for form, priority, score in FORMS:
                spdx = " ".join([label.replace("-", " "), *([version] if version else [])])
                full = form.format(name=name + tail, id=spdx + "(?: only| or later)?")
                out.append((f"{label}-{version.replace(' ', '.')}" if version else label, " spdx " if priority == 100 else keyword, f"(?<= ){full}(?= )", priority + (5 if version else 0), score))
    for label, name, keyword, versions in SHORT:
        for version in versions:
            tail = f"(?: version| v)? ?v?{version.removesuffix(' 0')}(?: 0)?(?: only| or later)?" if version else ""
            out.append((f"{label}-{version.replace(' ', '.')}" if version else label, keyword, f"(?<= ){name}{tail}(?= )", 45 if version else 40, 0.5))
    out += [(label, keyword, f"(?<= ){pattern}(?= )", 85, 0.9) for label, keyword, pattern in TEXTS]
    return out


def gates() -> list[tuple[str, str]]:
    """(keyword, pattern) of each rule, in the order of ``rules``: rules of one name share a gate, whatever version or form they ask for."""
    needed = []
    for label, name, versions in NAMES:
        spdx = f" spdx license identifier {label.replace('-', ' ')}"
        for _ in dict.fromkeys(["", *versions]):
            needed += [spdx if priority == 100 else f" {name}" for _, priority, _ in FORMS]
    for _, name, _, versions in SHORT:
        needed += [f" {name}"] * len(versions)
    needed += [f" {pattern}" for _, _, pattern in TEXTS]
    return [(rule[1], pattern) for rule, pattern in zip(rules(), needed, strict=True)]


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column | str) -> Column:
    """(start, end, match) in words, from 0; each word of ``words`` has a space before it."""
    return F.transform(placed(words, pattern, _spaces), lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: base places and labels, the surviving rules' labels, score, and detections."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce("text", F.lit("")), upper, lower)
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    words = F.col("words")
    out = id_and_text(docs).select("doc_id", spaced.alias("words"))
    out = out.withColumn("some", words.rlike(GENERAL))
    gate_of = gates()
    numbers = {gate: i for i, gate in enumerate(dict.fromkeys(gate_of))}
    # one constant, parsed once as the query is planned: thousands of literals take longer to plan than the texts to scan
    rows = [{"rule": i, "gate": numbers[gate_of[i]], "label": l, "pattern": p, "priority": r, "score": s} for i, (l, _, p, r, s) in enumerate(rules())]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<rule:int,gate:int,label:string,pattern:string,priority:int,score:double>>")
    none = F.array().cast("array<struct<start:bigint,end:bigint,rule:int,label:string,priority:int,score:double>>")

    def run(rule: Column) -> Column:
        return F.transform(_places(words, rule["pattern"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["score"].alias("score")))

    opened = F.array(*[F.contains(words, F.lit(keyword)) & words.rlike(pattern) for keyword, pattern in numbers])
    found = let(opened, lambda o: F.flatten(F.transform(F.filter(table, lambda r: F.get(o, r["gate"])), run)))
    out = out.withColumn("found", F.when(F.col("some"), found).otherwise(none))
    for i, phrase in enumerate(BASE):
        out = out.withColumn(f"base{i}", F.when(F.col("some") & F.contains(words, F.lit(f" {phrase} ")), F.transform(_places(words, f"(?<= ){phrase}(?= )"), lambda p: p["start"])).otherwise(F.array().cast("array<bigint>")))

    # outer intervals first: one that ends no later than some earlier one is inside it
    order = F.sort_array(F.transform("found", lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("low"), d["rule"].alias("rule"), d["label"].alias("label"), d["score"].alias("score"))))
    out = out.withColumn("order", order)
    part = lambda c: F.slice("order", c * PART + 1, F.lit(PART))
    parts = F.sequence(F.lit(0), F.floor((F.size("order") - 1) / PART).cast("int"))
    tops = F.transform(parts, lambda c: -F.array_min(F.transform(part(c), lambda d: d["back"])))
    zero = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<bigint>").alias("out"))
    before = F.aggregate(tops, zero, lambda a, t: F.struct(F.greatest(a["to"], t).alias("to"), F.concat(a["out"], F.array(a["to"])).alias("out")), lambda a: a["out"])
    kept_type = "array<struct<start:bigint,end:bigint,label:string,priority:int,score:double>>"

    def sweep(to: Column, c: Column) -> Column:
        def step(a: Column, d: Column) -> Column:
            end = -d["back"]
            one = F.array(F.struct(d["start"].alias("start"), end.alias("end"), d["label"].alias("label"), (-d["low"]).alias("priority"), d["score"].alias("score")))
            return F.when(end > a["to"], F.struct(end.alias("to"), F.concat(a["out"], one).alias("out"))).otherwise(a)

        return F.aggregate(part(c), F.struct(to.alias("to"), F.array().cast(kept_type).alias("out")), step, lambda a: a["out"])

    out = out.withColumn("outer", F.when(F.size("order") > 0, F.flatten(F.transform(before, sweep))).otherwise(F.array().cast(kept_type)))
    # none is inside another now, so those that overlap one stand next to it, fewer than LONGEST on either side
    near = lambda i: F.slice("outer", F.greatest(i + 2 - LONGEST, F.lit(1)), F.lit(2 * LONGEST))
    stronger = lambda d: lambda o: (o["priority"] > d["priority"]) & (o["start"] < d["end"]) & (d["start"] < o["end"])
    out = out.withColumn("kept", F.filter("outer", lambda d, i: ~F.exists(near(i), stronger(d))))
    starts = F.concat(*[F.col(f"base{i}") for i in range(len(BASE))])
    base_labels = F.filter(F.array(*[F.when(F.size(f"base{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    out = out.withColumn("starts", starts).withColumn("base", F.array_sort(base_labels))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0)))
    return out.select(
        "doc_id",
        F.when(words == "  ", F.lit(0)).otherwise(_spaces(words) - 1).cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("base"), F.transform("kept", lambda d: d["label"])))), ",").alias("labels"),
        score.alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["priority"].alias("priority"))).alias("detections"),
    )
