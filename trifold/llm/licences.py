"""Operator 10: licence scans by sentence rules.

A text is cut into sentences at lines without a letter or digit, after full
stops and semicolons (but for `; either version`), and after the colons of `free software:` and `following
conditions:`. Wrapped lines are joined, but a line that is a statement of its own
(a copyright notice, an SPDX tag, `Licensed under the MIT License`) is a sentence,
and a line that begins as a licence sentence does begins one.
Sentences that hold a licensing word are normalised (lower case, comment marks
and punctuation to single spaces) and mapped to the identifier of the first
sentence pattern that matches the whole of them; where none does, those of its
lines that match a pattern count in its place. The identifiers, in order, form
a sequence; ordered licence rules are matched against it one after the other, and
a rule that matches takes its identifiers out of the sequence, so that no
sentence counts for two licences.

Only DataFrame functions are used. Defined results: null and empty texts have no
sentence; a licensing sentence without a pattern counts as unknown; of patterns
and rules that match alike the first in the list counts; very long texts are
scanned whole; rows that share a doc_id are scanned one by one; an empty table
gives no row; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trifold.llm.common import let

#: Words without which a sentence isn't examined. Each sentence that a pattern matches has one (for `c ...`, only as `(c)`).
HINT = r"(?i)(?<![A-Za-z0-9])(?:licen[cs]|copyright|warrant|permission|redistribut|spdx|as[^A-Za-z0-9]+is\b|liable|liabilit|public[^A-Za-z0-9]+domain|rights[^A-Za-z0-9]+reserved|free[^A-Za-z0-9]+software|creative[^A-Za-z0-9]+commons|cc[^A-Za-z0-9]+by|cc0|copyleft)|\(c\)(?:\s|[0-9])"

#: Sentence identifiers and the normalised sentences that they stand for (patterns for the whole sentence).
SENTENCES = [
    ("spdxMIT", r"spdx license identifier mit"),
    ("spdxApache2", r"spdx license identifier apache 2 0"),
    ("spdxBSD3", r"spdx license identifier bsd 3 clause"),
    ("spdxBSD2", r"spdx license identifier bsd 2 clause"),
    ("spdxGPL2", r"spdx license identifier gpl 2 0( only| or later)?"),
    ("spdxGPL3", r"spdx license identifier gpl 3 0( only| or later)?"),
    ("spdxLGPL", r"spdx license identifier lgpl [23] [01]( only| or later)?"),
    ("spdxMPL2", r"spdx license identifier mpl 2 0"),
    ("spdxOther", r"spdx license identifier .*"),
    ("apacheRef", r"(this .* is )?(licensed|released|distributed|available|provided) under the apache (software )?license( version)? 2( 0)?( the license)?"),
    ("apacheUse", r"you may not use this (file|work|software) except in compliance with the license"),
    ("apacheCopy", r"you may obtain a copy of the license at.*"),
    ("apacheBasis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mitRef", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?(mit|expat|x11) licen[cs]e"),
    ("mitPerm", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("mitNotice", r"the above copyright notice and this permission notice .*shall be included in all copies or substantial portions of the software"),
    ("asIsSoftware", r"the software is provided as is without warranty of any kind.*"),
    ("mitLiable", r"in no event shall the authors or copyright holders be liable .*"),
    ("iscPerm", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsdRef", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?((new|modified|simplified|revised|[23] clause) )?bsd( [23] clause)? licen[cs]e"),
    ("bsdPerm", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsdSource", r".*redistributions of source code must retain the above copyright notice.*"),
    ("bsdBinary", r".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsdEndorse", r".*neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsdAsIs", r"this software is provided by .* as is and any express or implied warranties .*"),
    ("gpl2Ref", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?gnu general public licen[cs]e( version)? (v )?2( 0)?"),
    ("gpl3Ref", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?gnu general public licen[cs]e( version)? (v )?3( 0)?"),
    ("gplRef", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?gnu general public licen[cs]e"),
    ("agplRef", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?gnu affero general public licen[cs]e.*"),
    ("lgplRef", r"(this .* is )?(licensed|released|distributed|available|provided) under the (terms of the )?gnu (lesser|library) general public licen[cs]e.*"),
    ("gplFree", r"(this program|this software|it|this file) is free software"),
    ("gpl2Later", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 .*"),
    ("gpl3Later", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 .*"),
    ("gplHope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("mplRef", r"this source code form is subject to the terms of the mozilla public license v(ersion)? 2 0|(licensed|released) under the mozilla public license( version)? 2( 0)?"),
    ("ccByNcRef", r"(this .* is )?(licensed|released|available) under (the )?(a )?(cc by nc|creative commons attribution non ?commercial)( [0-9] [0-9])?( international)?( license)?"),
    ("ccByNdRef", r"(this .* is )?(licensed|released|available) under (the )?(a )?(cc by nd|creative commons attribution no ?derivatives)( [0-9] [0-9])?( international)?( license)?"),
    ("ccBySaRef", r"(this .* is )?(licensed|released|available) under (the )?(a )?(cc by sa|creative commons attribution share ?alike)( [0-9] [0-9])?( international)?( license)?"),
    ("ccByRef", r"(this .* is )?(licensed|released|available) under (the )?(a )?(cc by|creative commons attribution)( [0-9] [0-9])?( international)?( license)?"),
    ("cc0Ref", r"(this .* is )?(licensed|released|available|dedicated) (under|to) (the )?cc0.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("publicDomain", r"(this .* is )?(released|dedicated|placed|in) (in|into|to|under)? ?the public domain"),
    ("rightsReserved", r"(copyright .*)?all rights reserved"),
    ("copyright", r"(copyright( c)?|c) .*"),
]

#: Normalised lines that are sentences of their own, wherever they stand, and those with which a sentence begins.
NOTICE = r"(?:copyright(?: c)?|c)(?! (?:notices?|holders?|owners?|licen[cs]\w*|laws?|statements?|and|or|in|of|is|shall)\b) .*"
OWN = "|".join([NOTICE, *[f"(?:{p})" for name, p in SENTENCES if name == "spdxOther" or not (p.endswith(".*") or name == "gplFree")]])
BEGINS = r"(?:permission is hereby granted|permission to use copy modify|redistribution and use in source|redistributions (?:of source|in binary)|neither the names? of|the software is provided as is|this software is provided by|this (?:program|software|file) is free|this program is distributed in|unless required by applicable law|see the license for the specific|this source code form is subject|this is free and unencumbered)\b.*"
#: A licence's version on the next line, lines without a letter or digit, and other ends of sentences.
VERSION = r"(?i)(licen[cs]e,?)[ \t\r]*\n[^A-Za-z0-9\n]*(v(?:ersion)?\b|v?[23]\b)"
ENDS = r"\n[^\p{L}\p{N}\n]*+\n|(?<=[.;])\s(?![^A-Za-z0-9]*+(?i:either[^A-Za-z0-9]+version))|(?i)(?<=free software:|following conditions:|are met:)\s"

#: Licences in the order in which their rules are tried, with the sentence identifiers in order.
RULES = [
    ("MIT", ["mitPerm", "mitNotice", "asIsSoftware", "mitLiable"]),
    ("MIT", ["mitPerm", "mitNotice", "asIsSoftware"]),
    ("ISC", ["iscPerm", "asIsSoftware"]),
    ("BSD-3-Clause", ["bsdPerm", "bsdSource", "bsdBinary", "bsdEndorse", "bsdAsIs"]),
    ("BSD-2-Clause", ["bsdPerm", "bsdSource", "bsdBinary", "bsdAsIs"]),
    ("Apache-2.0", ["apacheRef", "apacheUse", "apacheCopy", "apacheBasis", "apacheSee"]),
    ("GPL-2.0-or-later", ["gplFree", "gpl2Later", "gplHope"]),
    ("GPL-3.0-or-later", ["gplFree", "gpl3Later", "gplHope"]),
    ("GPL-2.0-or-later", ["gplFree", "gpl2Later"]),
    ("GPL-3.0-or-later", ["gplFree", "gpl3Later"]),
    ("Apache-2.0", ["apacheRef"]),
    ("MIT", ["mitRef"]),
    ("BSD", ["bsdRef"]),
    ("GPL-2.0", ["gpl2Ref"]),
    ("GPL-3.0", ["gpl3Ref"]),
    ("GPL", ["gplRef"]),
    ("AGPL", ["agplRef"]),
    ("LGPL", ["lgplRef"]),
    ("MPL-2.0", ["mplRef"]),
    ("CC-BY-NC", ["ccByNcRef"]),
    ("CC-BY-ND", ["ccByNdRef"]),
    ("CC-BY-SA", ["ccBySaRef"]),
    ("CC-BY", ["ccByRef"]),
    ("CC0", ["cc0Ref"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["publicDomain"]),
    ("MIT", ["spdxMIT"]),
    ("Apache-2.0", ["spdxApache2"]),
    ("BSD-3-Clause", ["spdxBSD3"]),
    ("BSD-2-Clause", ["spdxBSD2"]),
    ("GPL-2.0", ["spdxGPL2"]),
    ("GPL-3.0", ["spdxGPL3"]),
    ("LGPL", ["spdxLGPL"]),
    ("MPL-2.0", ["spdxMPL2"]),
    ("Other-SPDX", ["spdxOther"]),
    ("All-Rights-Reserved", ["rightsReserved"]),
]


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentence_id(sentence: Column) -> Column:
    """The identifier of the first pattern that the normalised sentence matches, or `unknown`."""
    found = F.lit("unknown")
    for name, pattern in reversed(SENTENCES):
        found = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def sentences_of(text: Column) -> Column:
    """The sentences of a text, wrapped lines still apart."""

    def marked(line: Column) -> Column:
        own = lambda n: F.when(n.rlike(f"^(?:{OWN})$"), F.concat(F.lit("\n"), line, F.lit("\n"))).when(n.rlike(f"^{BEGINS}$"), F.concat(F.lit("\n"), line)).otherwise(line)
        return F.when(line.rlike(HINT), let(normalised(line), own)).otherwise(line)

    lines = F.split(F.regexp_replace(text, VERSION, "$1 $2"), "\n")
    return F.split(F.array_join(F.transform(lines, marked), "\n"), ENDS)


def ids_of(sentence: Column) -> Column:
    """The identifier of a sentence; where it has several lines and no pattern, those of its lines."""
    of = lambda x: let(normalised(x), sentence_id)
    lines = lambda: F.filter(F.transform(F.filter(F.split(sentence, "\n"), lambda x: x.rlike(HINT)), of), lambda i: ~i.isin("unknown", "copyright"))
    either = lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))
    return let(of(sentence), lambda i: F.when((i != "unknown") | ~sentence.contains("\n"), F.array(i)).otherwise(let(lines(), either)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_unknown, sentence_ids, licences, n_unmatched.

    sentence_ids are in order; licences in the order of the rules, each once;
    n_unmatched counts known sentences that no rule took.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.filter(sentences_of(text), lambda s: s.rlike(HINT))
    sentences = F.when(text.rlike(HINT), F.flatten(F.transform(cut, ids_of))).otherwise(F.array().cast("array<string>"))
    held = docs.select("doc_id", sentences.alias("ids"))

    # each identifier has a space of its own on either side, so that one taken out leaves its neighbours whole
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(ids) + " ").alias("ids")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(" "), F.array_join(F.filter("ids", lambda x: x != "unknown"), "  "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        there = F.contains(state["rest"], rule["ids"])
        return F.struct(
            F.when(there, F.replace(state["rest"], rule["ids"], F.lit(""))).otherwise(state["rest"]).alias("rest"),
            F.when(there, F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"]).alias("found"),
        )

    matched = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)).otherwise(start)
    done = held.select("doc_id", "ids", matched.alias("m"))
    rest = F.trim(F.col("m.rest"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.size(F.filter("ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.col("m.found")), ",").alias("licences"),
        F.when(rest == "", F.lit(0)).otherwise(F.size(F.split(rest, " +"))).cast("long").alias("n_unmatched"),
    )
