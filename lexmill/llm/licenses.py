"""Licence detection by ordered signature rules, with DataFrame functions only.

Texts become words joined by single spaces. A rule is a regular expression over them, gated by a keyword (a word that
every match holds; rules are joined to a text by equality with its words) and a second literal. The rules are a
fixed table of a few hundred rows. Detections are intervals of words: one contained in another of no lower priority is
suppressed, of equal ones with equal priority the first rule's stays. The base phrases are counted beside the rules and
always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower

#: Base phrases and their labels (fixed values of the contract).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What separates words (fixed value of the contract).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Licences: label, keyword, second literal, name, identifier words. Names and identifiers are patterns over words.
NAMES = [
    ("gpl", "gnu", "general", r"gnu general public licen[sc]e", "gpl"),
    ("gpl", "gpl", "gpl", r"(?:gnu )?gpl", "gpl"),
    ("lgpl", "gnu", "lesser", r"gnu lesser general public licen[sc]e", "lgpl"),
    ("lgpl", "gnu", "library", r"gnu library general public licen[sc]e", "lgpl"),
    ("lgpl", "lgpl", "lgpl", r"(?:gnu )?lgpl", "lgpl"),
    ("agpl", "affero", "affero", r"(?:gnu )?affero general public licen[sc]e", "agpl"),
    ("agpl", "agpl", "agpl", r"(?:gnu )?agpl", "agpl"),
    ("gfdl", "gnu", "documentation", r"gnu free documentation licen[sc]e", "gfdl"),
    ("mit", "mit", "licen", r"(?:the )?mit (?:x11 )?licen[sc]e", "mit"),
    ("mit", "expat", "licen", r"expat licen[sc]e", "mit"),
    ("x11", "x11", "licen", r"x11 licen[sc]e", "x11"),
    ("isc", "isc", "licen", r"(?:the )?isc licen[sc]e", "isc"),
    ("zlib", "zlib", "licen", r"zlib (?:libpng )?licen[sc]e", "zlib"),
    ("libpng", "libpng", "licen", r"libpng licen[sc]e", "libpng"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("beerware", "beerware", "beerware", r"beerware licen[sc]e", "beerware"),
    ("postgresql", "postgresql", "licen", r"postgresql licen[sc]e", "postgresql"),
    ("python", "python", "licen", r"python software foundation licen[sc]e", "psf"),
    ("ruby", "ruby", "licen", r"ruby licen[sc]e", "ruby"),
    ("php", "php", "licen", r"php licen[sc]e", "php"),
    ("perl-artistic", "artistic", "licen", r"artistic licen[sc]e", "artistic"),
    ("vim", "vim", "licen", r"vim licen[sc]e", "vim"),
    ("openssl", "openssl", "licen", r"openssl licen[sc]e", "openssl"),
    ("curl", "curl", "licen", r"curl licen[sc]e", "curl"),
    ("ncsa", "ncsa", "licen", r"(?:university of illinois )?ncsa open source licen[sc]e", "ncsa"),
    ("intel", "intel", "licen", r"intel open source licen[sc]e", "intel"),
    ("sun-cddl", "cddl", "cddl", r"cddl", "cddl"),
    ("sun-cddl", "distribution", "common development", r"common development and distribution licen[sc]e", "cddl"),
    ("cpl", "common", "public licen", r"common public licen[sc]e", "cpl"),
    ("ibm-public", "ibm", "public licen", r"ibm public licen[sc]e", "ipl"),
    ("eclipse", "eclipse", "licen", r"eclipse public licen[sc]e", "epl"),
    ("eclipse", "epl", "epl", r"epl", "epl"),
    ("edl", "eclipse", "distribution licen", r"eclipse distribution licen[sc]e", "edl"),
    ("mozilla", "mozilla", "licen", r"mozilla public licen[sc]e", "mpl"),
    ("mozilla", "mpl", "mpl", r"mpl", "mpl"),
    ("netscape", "netscape", "licen", r"netscape public licen[sc]e", "npl"),
    ("microsoft-public", "microsoft", "public licen", r"microsoft public licen[sc]e", "ms pl"),
    ("microsoft-reciprocal", "microsoft", "reciprocal", r"microsoft reciprocal licen[sc]e", "ms rl"),
    ("boost", "boost", "licen", r"boost software licen[sc]e", "bsl"),
    ("academic-free", "academic", "free licen", r"academic free licen[sc]e", "afl"),
    ("open-software", "open", "software licen", r"open software licen[sc]e", "osl"),
    ("eupl", "eupl", "eupl", r"eupl", "eupl"),
    ("eupl", "european", "union public", r"european union public licen[sc]e", "eupl"),
    ("cecill", "cecill", "cecill", r"cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?", "cecill"),
    ("open-font", "font", "sil open", r"sil open font licen[sc]e", "ofl"),
    ("open-database", "odbl", "odbl", r"odbl", "odbl"),
    ("open-database", "database", "open database", r"open database licen[sc]e", "odbl"),
    ("odc-by", "commons", "open data", r"open data commons attribution licen[sc]e", "odc by"),
    ("pddl", "pddl", "pddl", r"pddl", "pddl"),
    ("open-government", "government", "licen", r"open government licen[sc]e", "ogl"),
    ("zope", "zope", "licen", r"zope public licen[sc]e", "zpl"),
    ("w3c", "w3c", "licen", r"w3c software (?:notice and )?licen[sc]e", "w3c"),
    ("qt", "qpl", "qpl", r"qpl", "qpl"),
    ("sleepycat", "sleepycat", "licen", r"sleepycat licen[sc]e", "sleepycat"),
    ("tcl", "tcl", "licen", r"tcl tk licen[sc]e", "tcl"),
    ("upl", "universal", "permissive", r"universal permissive licen[sc]e", "upl"),
    ("server-side", "sspl", "sspl", r"sspl", "sspl"),
    ("server-side", "server", "side public", r"server side public licen[sc]e", "sspl"),
    ("business-source", "business", "source licen", r"business source licen[sc]e", "busl"),
    ("elastic", "elastic", "licen", r"elastic licen[sc]e", "elastic"),
    ("commons-clause", "clause", "commons clause", r"commons clause(?: licen[sc]e condition)?", "commons clause"),
    ("mulan", "mulan", "mulan", r"mulan permissive software licen[sc]e", "mulanpsl"),
    ("blueoak", "oak", "blue oak", r"blue oak model licen[sc]e", "blueoak"),
    ("apache", "apache", "licen", r"apache (?:software )?licen[sc]e", "apache"),
]
#: Versions in words, for the labels that have them.
VERSIONS = {
    "gpl": ("1 0", "2 0", "3 0"), "lgpl": ("2 0", "2 1", "3 0"), "agpl": ("1 0", "3 0"), "gfdl": ("1 1", "1 2", "1 3"),
    "apache": ("1 0", "1 1", "2 0"), "mozilla": ("1 0", "1 1", "2 0"), "eclipse": ("1 0", "2 0"), "perl-artistic": ("1 0", "2 0"),
    "eupl": ("1 0", "1 1", "1 2"), "open-font": ("1 0", "1 1"), "academic-free": ("2 1", "3 0"), "open-software": ("2 1", "3 0"),
    "php": ("3 0", "3 01"), "sun-cddl": ("1 0", "1 1"), "zope": ("2 0", "2 1"), "business-source": ("1 1",), "elastic": ("2 0",),
    "cecill": ("1 0", "2 0", "2 1"), "boost": ("1 0",), "open-database": ("1 0",), "open-government": ("1 0", "2 0", "3 0"), "mulan": ("1 0", "2 0"),
}
#: Creative Commons: parts of a licence's label, their short words and their names.
CC_PARTS = {
    "by": ("by", "attribution"), "by-sa": ("by sa", "attribution share ?alike"), "by-nd": ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    "by-nc": ("by nc", "attribution non ?commercial"), "by-nc-sa": ("by nc sa", "attribution non ?commercial share ?alike"),
    "by-nc-nd": ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences of licences and notices: label, priority, keyword, second literal, pattern.
SENTENCES = [
    ("mit", 90, "documentation", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", 90, "fee", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 90, "redistribution", "binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 92, "endorse", "endorse or promote", r"neither the names? of .{1,160}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 92, "advertising", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 60, "bsd", "licen", r"bsd (?:style )?licen[sc]e"),
    ("bsd-2-clause", 70, "bsd", "2 clause", r"bsd 2 clause(?: simplified)?(?: licen[sc]e)?"),
    ("bsd-3-clause", 70, "bsd", "3 clause", r"bsd 3 clause(?: new| revised| clear)?(?: licen[sc]e)?"),
    ("bsd-4-clause", 70, "bsd", "4 clause", r"bsd 4 clause(?: original)?(?: licen[sc]e)?"),
    ("bsd-2-clause", 65, "simplified", "bsd licen", r"simplified bsd licen[sc]e"),
    ("bsd-2-clause", 65, "freebsd", "bsd licen", r"freebsd bsd licen[sc]e"),
    ("bsd-3-clause", 65, "bsd", "bsd licen", r"(?:new|modified|revised) bsd licen[sc]e"),
    ("0bsd", 70, "0bsd", "0bsd", r"0bsd"),
    ("zlib", 90, "misrepresented", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("unlicense", 90, "unencumbered", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 70, "domain", "public domain", r"(?:placed|dedicated|released|is) (?:in|to|into) the public domain"),
    ("public-domain", 40, "domain", "public domain", r"public domain"),
    ("gpl", 88, "redistribute", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 88, "redistribute", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("gpl", 86, "gnu", "along with this program", r"you should have received a copy of the gnu general public licen[sc]e along with this program"),
    ("apache", 88, "compliance", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache", 86, "conditions", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("mozilla", 88, "mozilla", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("boost", 88, "boost", "boost software licen", r"distributed under the boost software licen[sc]e"),
    ("wtfpl", 88, "fuck", "do what the", r"do what the fuck you want to public licen[sc]e"),
    ("cc0", 80, "cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 82, "zero", "creative commons", r"creative commons (?:cc )?zero"),
    ("cc", 45, "creative", "creative commons", r"creative commons(?: licen[sc]e)?"),
    ("proprietary", 60, "reserved", "all rights", r"all rights reserved"),
    ("proprietary", 70, "proprietary", "proprietary", r"proprietary and confidential"),
    ("warranty-disclaimer", 30, "warranty", "warrant", r"without (?:any |even the implied )?warranty(?: of (?:merchantability|any kind))?"),
]
#: How a grant begins.
GRANT = r"(?:licen[sc]ed|released|distributed|available|provided|published|covered) (?:under|by)(?: the)?(?: terms of)?(?: the| a)? "


def rules() -> list[tuple[str, int, str, str, str]]:
    """(label, priority, keyword, second literal, pattern), highest priority first."""
    out = list(SENTENCES)
    for label, keyword, also, name, short in NAMES:
        out += [(label, 50, keyword, also, name), (label, 75, keyword, also, GRANT + name)]
        out.append((label, 95, "spdx", short, rf"spdx licen[sc]e identifier {short}(?: or later| only)?"))
        for version in VERSIONS.get(label, ()):
            number = version.removesuffix(" 0") + ("(?: 0)?" if version.endswith(" 0") else "")
            exact, later = f"{label}-{version.replace(' ', '.')}", r"(?: or(?: at your option)?(?: any)? later(?: version)?| only)?"
            out.append((exact, 60, keyword, also, rf"{name} (?:version |v ?)?{number}{later}"))
            out.append((exact, 85, keyword, also, rf"{GRANT}{name} (?:version |v ?)?{number}{later}"))
            out.append((exact, 62, short.split()[0], short, rf"{short} {number}{later}"))
            if " " not in short:
                major, _, minor = version.partition(" ")
                joined = f"{short}v{major}"
                out.append((exact, 62, joined, joined, joined + (f" {minor}" if minor != "0" else "(?: 0)?") + later))
            out.append((exact, 97, "spdx", short, rf"spdx licen[sc]e identifier {short} {number}{later}"))
    for part, (short, name) in CC_PARTS.items():
        out += [(f"cc-{part}", 55, "cc", f"cc {short}", f"cc {short}"), (f"cc-{part}", 58, "creative", "attribution", f"creative commons {name}")]
        for version in CC_VERSIONS:
            exact = f"cc-{part}-{version.replace(' ', '.')}"
            out += [(exact, 65, "cc", f"cc {short} {version}", f"cc {short} {version}"), (exact, 68, "creative", "attribution", f"creative commons {name} (?:(?:international|unported|generic) )?(?:public )?(?:licen[sc]e )?(?:version )?{version}")]
    return sorted(set(out), key=lambda r: (-r[1], r))


def words(text: Column) -> Column:
    """A text's words joined by single spaces, with one at both ends; one space if it has none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, " ")), F.lit(" "))


def gaps(text: Column) -> Column:
    """Spaces in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    ``score`` is the highest priority of what was found over 100 (0.5 for a base phrase alone). Defined cases: null
    and empty texts have no words, no labels and score 0; a row with a null id is scanned alike; rows repeating an
    id and text give equal rows; an empty table gives an empty table; other columns play no part.
    """
    spark = docs.sparkSession
    table = spark.sql("select * from values " + ", ".join(f"({i}, '{label}', {priority}, '{keyword}', '{also}', r'(?<= )(?:{pattern})(?= )')" for i, (label, priority, keyword, also, pattern) in enumerate(rules())) + " as t(rule, label, priority, keyword, also, pattern)")
    keywords = F.array(*[F.lit(k) for k in sorted({r[2] for r in rules()})])
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(13), F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), words(F.col(text_col)).alias("w"))

    counts, firsts, lasts, named = [], [], [], []
    for phrase, label in BASE.items():
        padded = F.lit(f" {phrase} ")
        at, back = F.instr(F.col("w"), f" {phrase} "), F.instr(F.reverse("w"), f" {phrase[::-1]} ")
        there = F.contains(F.col("w"), padded)
        counts.append(F.when(there, F.regexp_count("w", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, gaps(F.substring(F.col("w"), F.lit(1), at)) - 1))
        lasts.append(F.when(there, gaps("w") - 1 - gaps(F.substring(F.reverse("w"), F.lit(1), back)) + 1 - len(phrase.split())))
        named.append(F.when(there, F.lit(label)))
    n_words = F.when(F.length("w") <= 2, F.when(F.trim("w") == "", 0).otherwise(1)).otherwise(gaps("w") - 1)
    plain = base.select(
        "doc_id", "mark", n_words.cast("long").alias("n_words"), reduce(Column.__add__, counts).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*named))).alias("_base"),
    )

    gated = base.withColumn("keyword", F.explode(F.array_intersect(F.split(F.trim("w"), " "), keywords))).join(F.broadcast(table), "keyword")  # a fixed table
    gated = gated.filter(F.contains("w", "also"))
    hits = gated.select("doc_id", "mark", "rule", "label", "priority", F.expr("regexp_extract_all(w, pattern, 0)").alias("m"), F.expr("split(w, pattern, -1)").alias("p")).filter(F.size("m") > 0)
    # from here on only numbers of words move, not texts
    hits = hits.withColumn("m", F.transform("m", gaps)).withColumn("p", F.transform("p", gaps))
    places = hits.select("doc_id", "mark", "rule", "label", "priority", F.posexplode(F.arrays_zip("m", "p")).alias("i", "x")).filter("x.m is not null").distinct().repartition("doc_id", "mark")
    doc = Window.partitionBy("doc_id", "mark")
    before = Window.partitionBy("doc_id", "mark", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        places.withColumn("to", F.sum(F.col("x.p") + F.col("x.m")).over(before))
        .withColumn("first", F.col("to") - F.col("x.m") - 1)
        .withColumn("last", F.col("to") - 1)
    )
    ahead = doc.orderBy("first", F.desc("last"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    # how far the spans ahead reach, of each priority or above; what contains a span is ahead of it
    levels = sorted({r[1] for r in rules()})
    reach = F.coalesce(*[F.when(F.col("priority") == k, F.max(F.when(F.col("priority") >= k, F.col("last"))).over(ahead)) for k in levels])
    kept = spans.withColumn("reach", reach).filter("reach is null or reach < last")
    found = kept.groupBy("doc_id", "mark").agg(F.collect_set("label").alias("_labels"), F.max("priority").alias("_best"))
    out = plain.join(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    best = F.greatest(F.coalesce("_best", F.lit(0)), F.when(F.size("_base") > 0, 50).otherwise(0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), (best / F.lit(100.0)).alias("score"))
