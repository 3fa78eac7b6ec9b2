"""License scans: ordered signature rules over the words of a text, in SQL expressions only.

A text is reduced to its lower-case words joined by single blanks; rules are regular expressions over that form.
Each rule names a keyword; only texts with a keyword are scanned, and only with the rules of the keywords they
contain. A rule's places are word intervals. Of all detections of a text, one whose interval lies inside the
interval of another is suppressed; of equal intervals the rule that comes first stays.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.llm.arrays import free_name


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str


#: Phrases that always count, and their labels.
BASE = (
    Rule("cc-by", "cc", "cc by"),
    Rule("gpl", "public", "general public license"),
    Rule("reserved", "reserved", "all rights reserved"),
)

#: Licenses with versions: short name, keyword, name as a pattern, versions.
VERSIONED = (
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "1.0 2.0 3.0"),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "2.0 2.1 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache (?:software )?licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "1.0 2.0"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "1.0 1.1"),
    ("eupl", "european", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("osl", "software", "open software licen[cs]e", "1.0 2.0 2.1 3.0"),
    ("afl", "academic", "academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic", "artistic licen[cs]e", "1.0 2.0"),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("odbl", "database", "open database licen[cs]e", "1.0"),
    ("cpl", "common", "common public licen[cs]e", "1.0"),
    ("zpl", "zope", "zope public licen[cs]e", "1.1 2.0 2.1"),
    ("bsl", "boost", "boost software licen[cs]e", "1.0"),
    ("psf", "python", "python software foundation licen[cs]e", "2.0"),
    ("php", "php", "php licen[cs]e", "3.0 3.01"),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "1.0 1.1 2.0 2.1"),
)

#: Ways to write a versioned license around its name and version; the last part of the label, or none.
FORMS = (
    ("-or-later", "{name} (?:as published by the free software foundation )?(?:either )?(?:v|version )?{version} (?:or|and) (?:\\(at your option\\) )?(?:any )?later(?: version)?"),
    ("-only", "{name} (?:as published by the free software foundation )?(?:v|version )?{version} only"),
    ("", "{name} (?:as published by the free software foundation )?(?:v|version )?{version}"),
    ("", "spdx license identifier {short} {version}"),
)

CC_PARTS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
CC_WORDS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?", "sa": "share ?alike"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Licenses without versions and notices: label, keyword, pattern.
PLAIN = (
    Rule("mit", "license", "(?:(?:released|licensed|distributed|available) under )?(?:the )?(?:terms of the )?mit license"),
    Rule("mit", "licence", "(?:(?:released|licensed|distributed|available) under )?(?:the )?(?:terms of the )?mit licence"),
    Rule("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("bsd-2-clause", "bsd", "(?:simplified bsd licen[cs]e|(?:bsd 2|2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause)"),
    Rule("bsd-3-clause", "bsd", "(?:(?:new|modified|revised) bsd licen[cs]e|(?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause)"),
    Rule("bsd-4-clause", "bsd", "(?:(?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause)"),
    Rule("bsd", "bsd", "bsd (?:style )?licen[cs]e"),
    Rule("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("isc", "isc", "isc licen[cs]e"),
    Rule("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Rule("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    Rule("unlicense", "unlicense", "(?:the )?unlicense"),
    Rule("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    Rule("wtfpl", "wtfpl", "wtfpl"),
    Rule("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    Rule("public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    Rule("public-domain", "domain", "public domain dedication"),
    Rule("gpl", "gpl", "(?:gnu )?gpl(?: ?v?[123])?"),
    Rule("lgpl", "lgpl", "(?:gnu )?lgpl(?: ?v?[23])?"),
    Rule("agpl", "agpl", "(?:gnu )?agpl(?: ?v?[13])?"),
    Rule("creative-commons", "creative", "creative commons(?: licen[cs]e)?"),
    Rule("proprietary", "confidential", "proprietary and confidential"),
    Rule("proprietary", "prohibited", "(?:unauthorized|unauthorised) (?:copying|use|distribution) of this (?:file|software|work) is (?:strictly )?prohibited"),
    Rule("no-reuse", "permission", "(?:may|must) not be reproduced (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission"),
    Rule("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    Rule("copyright", "copyright", "copyright notice"),
    Rule("warranty-disclaimer", "warranty", "(?:without warranty of any kind|without any warranty|as is without warranty)"),
)


def rules() -> list[Rule]:
    """All rules, the more specific before the less specific ones; versions are written as words."""
    spaced = lambda version: version.replace(".", " ")
    out: list[Rule] = []
    for suffix, form in FORMS:
        for short, keyword, name, versions in VERSIONED:
            for version in versions.split():
                number = spaced(version)
                if number.endswith(" 0"):
                    number = f"{number[:-2]}(?: 0)?"
                word = "spdx" if "spdx" in form else keyword
                pattern = form.format(name=f"(?:the )?{name}", short=short, version=number).replace("\\(at your option\\)", "at your option")
                out.append(Rule(f"{short}-{version}{suffix}", word, pattern))
    for parts in CC_PARTS:
        long = " ".join(CC_WORDS[p] for p in parts.split())
        for version in CC_VERSIONS:
            label = f"cc-{parts.replace(' ', '-')}-{version}"
            out.append(Rule(label, "cc", f"cc {parts} {spaced(version)}"))
            out.append(Rule(label, "creative", f"creative commons {long}(?: international| unported| generic)? (?:licen[cs]e )?(?:version )?{spaced(version)}"))
        out.append(Rule(f"cc-{parts.replace(' ', '-')}", "cc", f"cc {parts}"))
        out.append(Rule(f"cc-{parts.replace(' ', '-')}", "creative", f"creative commons {long}"))
    for short, keyword, name, _ in VERSIONED:
        out.append(Rule(short, keyword, f"(?:the )?{name}"))
    return [*out, *PLAIN]


def _words(text: Column) -> Column:
    """The lower-case words of a text, with a blank before, between and after them."""
    upper = "".join(map(chr, range(65, 91)))
    lower = F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())
    spaced = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, rule: Column) -> Column:
    """Word intervals (start, stop) of a rule: what stands before a match tells the number of its first word."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    hits = F.regexp_extract_all(words, pattern, F.lit(0))
    between = F.split(words, pattern)
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<label:string,priority:int,start:int,stop:int>>").alias("out"))

    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + _blanks(F.get(between, i))
        stop = begin + _blanks(F.get(hits, i)) + 1
        found = F.struct(
            rule["label"].alias("label"), rule["priority"].alias("priority"), begin.cast("int").alias("start"), stop.cast("int").alias("stop")
        )
        return F.struct((stop - 1).cast("int").alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda s: s["out"])
    return F.when(F.size(hits) > 0, found).otherwise(start["out"])


def _table(found: list[Rule], numbers: list[int]) -> Column:
    """The rules of these numbers, which are their priorities."""
    row = lambda i: F.struct(F.lit(found[i].label).alias("label"), F.lit(found[i].pattern).alias("pattern"), F.lit(i).alias("priority"))
    return F.array(*map(row, numbers))


def _detections(words: Column, found: list[Rule]) -> Column:
    """Detections of the rules whose keyword is a word of the text, by start, longest first, then by priority."""
    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(found):
        by_keyword.setdefault(rule.keyword, []).append(i)
    present = F.array_intersect(F.split(F.trim(words), " "), F.array(*map(F.lit, sorted(by_keyword))))
    known = F.create_map(*[x for k, own in sorted(by_keyword.items()) for x in (F.lit(k), _table(found, own))])
    wanted = F.flatten(F.transform(present, lambda k: F.element_at(known, k)))
    return F.flatten(F.transform(wanted, lambda r: _places(words, r)))


def _surviving(found: Column) -> Column:
    """Drops every detection inside another one."""
    by_place = F.array_sort(
        F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("ends"), d["priority"].alias("priority"), d["label"].alias("label")))
    )
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<struct<label:string,priority:int,start:int,stop:int>>").alias("out"))

    def step(state: Column, d: Column) -> Column:
        kept = F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["start"].alias("start"), (-d["ends"]).cast("int").alias("stop"))
        inside = -d["ends"] <= state["reach"]
        reach = F.greatest(state["reach"], (-d["ends"]).cast("int")).alias("reach")
        return F.struct(reach, F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(kept))).alias("out"))

    return F.aggregate(by_place, start, step, lambda s: s["out"])


def scan_licenses(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """Adds license detections to every row.

    Added columns: ``n_words`` long, ``base_places`` and ``detections`` (arrays of label, priority, start, stop in
    words; ``base_places`` has every place of a base phrase, ``detections`` what survives suppression). Null and
    empty texts have no words and empty arrays. Input columns of these names are replaced, others stay; rows are
    independent, repeated rows stay repeated, and nothing is shuffled.
    """
    found = rules() if found is None else found
    added = ("n_words", "base_places", "detections")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    gate = "|".join(sorted({r.keyword for r in (*BASE, *found)}))
    none = F.array().cast("array<struct<label:string,priority:int,start:int,stop:int>>")
    held, opened = free_name(docs.columns, "__words"), free_name(docs.columns, "__open")
    rows = docs.select(*kept, _words(F.col("text")).alias(held))
    rows = rows.withColumn(opened, F.col(held).rlike(f" (?:{gate}) "))
    words, opened = F.col(held), F.col(opened)
    base = F.flatten(F.transform(_table(list(BASE), list(range(len(BASE)))), lambda r: _places(words, r)))
    return rows.select(
        *kept,
        F.greatest(F.lit(0), _blanks(words) - 1).cast("long").alias("n_words"),
        F.when(opened, base).otherwise(none).alias("base_places"),
        F.when(opened, _surviving(_detections(words, found))).otherwise(none).alias("detections"),
    )


def digest_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row.

    ``score`` is 0 without any detection, else one half and up to another half with the share of words inside
    detections.
    """
    rows = scan_licenses(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base, found = F.col("base_places"), F.col("detections")
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    own = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform(base, lambda p: p["label"]), F.transform(found, lambda p: p["label"]))))
    covered = F.aggregate(found, F.lit(0), lambda s, p: s + p["stop"] - p["start"])
    share = F.least(F.lit(1.0), covered / F.greatest(F.col("n_words"), F.lit(1)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size(base) + F.size(found) == 0, 0.0).otherwise(0.5 + 0.5 * share).alias("score"),
        F.size(found).cast("long").alias("n_detections"),
    )
