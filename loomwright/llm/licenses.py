"""Licence notices in texts by ordered signature rules, with DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.blocks import set_aside
from loomwright.session import stored

#: names of columns that a scan makes beside those of the table
HELPERS = ("_words", "_gated", "_n_words", "_key", "_text", "_n_base", "_first_word", "_last_word", "_base_labels", "_labels", "_score")

#: digits, letters, and all beyond ASCII (said positively, which Java's expressions match many times faster)
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: fixed values: the phrases that every scan reports, word by word, with their labels
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: fixed values: licences as (label, words of the name, short identifier); patterns over lower-case words and single blanks
NAMES = (
    ("0bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?", r"0bsd"),
    ("afl-3.0", r"academic free license(?: version)?(?: v?3(?: 0)?)?", r"afl 3 0"),
    ("agpl-3.0", r"(?:gnu )?affero general public license(?: version)?(?: v?3)?", r"agpl(?:v3| 3 0)"),
    ("apache-1.1", r"apache (?:software )?license(?: version)? 1 1", r"apache 1 1"),
    ("apache-2.0", r"apache (?:software )?license(?: version)? v?2(?: 0)?", r"apache 2 0"),
    ("artistic-2.0", r"artistic license(?: version)?(?: 2(?: 0)?)?", r"artistic 2 0"),
    ("beerware", r"beer ?ware license", r"beerware"),
    ("blessing", r"sqlite blessing", r"blessing"),
    ("boost-1.0", r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd license", r"bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd license", r"bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd license", r"bsd 4 clause"),
    ("bsd", r"bsd(?: style)? license", r"bsd"),
    ("busl-1.1", r"business source license(?: version)?(?: 1 1)?", r"busl 1 1"),
    ("cc-by", r"creative commons attribution(?: license)?(?! share| non| no)", r"cc by(?! sa| nc| nd)(?: [1-4] [05])?"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?! share| no)", r"cc by nc(?! sa| nd)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", r"creative commons attribution share ?alike", r"cc by sa(?: [1-4] [05])?"),
    ("cc0", r"creative commons (?:zero|cc0|public domain dedication)", r"cc0(?: 1 0)?"),
    ("cddl-1.0", r"common development and distribution license(?: version)?(?: 1 [01])?", r"cddl 1 [01]"),
    ("cecill-2.1", r"cecill(?: free software)? license(?: agreement)?", r"cecill 2 1"),
    ("commons-clause", r"commons clause(?: license condition)?", r"commons clause"),
    ("copyfree", r"copyfree license", r"copyfree"),
    ("cpl-1.0", r"common public license(?: version)?(?: 1 0)?", r"cpl 1 0"),
    ("curl", r"curl license", r"curl"),
    ("ecl-2.0", r"educational community license(?: version)?(?: 2 0)?", r"ecl 2 0"),
    ("efl-2.0", r"eiffel forum license(?: version)?(?: 2)?", r"efl 2 0"),
    ("elastic-2.0", r"elastic license(?: version)?(?: 2(?: 0)?)?", r"elastic 2 0"),
    ("epl-1.0", r"eclipse public license(?: version)? v?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", r"eclipse public license(?: version)? v?2(?: 0)?", r"epl 2 0"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version)?(?: v?1 [12])?", r"eupl 1 [12]"),
    ("fsl-1.1", r"functional source license(?: version)?(?: 1 1)?", r"fsl 1 1"),
    ("ftl", r"freetype(?: project)? license", r"ftl"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license(?: version)?(?: 1 [1-3])?", r"gfdl 1 [1-3]"),
    ("gpl-2.0", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?2(?: 0)?", r"gpl(?:v2| 2 0)"),
    ("gpl-3.0", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?", r"gpl(?:v3| 3 0)"),
    ("gpl", r"(?:gnu )?general public license", r"gpl"),
    ("hpnd", r"historical permission notice and disclaimer", r"hpnd"),
    ("icu", r"icu license", r"icu"),
    ("imagemagick", r"imagemagick license", r"imagemagick"),
    ("ipl-1.0", r"ibm public license(?: version)?(?: 1 0)?", r"ipl 1 0"),
    ("isc", r"isc license", r"isc"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public license(?: version)? v?2(?: [01])?", r"lgpl(?:v2| 2 [01])"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license(?: version)? v?3(?: 0)?", r"lgpl(?:v3| 3 0)"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", r"lgpl"),
    ("libpng", r"libpng license", r"libpng"),
    ("lppl-1.3c", r"latex project public license(?: version)?(?: 1 3c?)?", r"lppl 1 3c?"),
    ("mit-0", r"mit no attribution(?: license)?", r"mit 0"),
    ("mit", r"(?:expat|x11|mit(?: style)?) license", r"mit"),
    ("mpl-1.1", r"mozilla public license(?: version)? v?1(?: [01])?", r"mpl 1 [01]"),
    ("mpl-2.0", r"mozilla public license(?: version)?(?: v?2(?: 0)?)?", r"mpl 2 0"),
    ("ms-pl", r"microsoft public license", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal license", r"ms rl"),
    ("mulan-2.0", r"mulan permissive software license(?: version)?(?: 2)?", r"mulanpsl 2 0"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? license", r"ncsa"),
    ("odbl-1.0", r"open (?:data commons open )?database license(?: version)?(?: 1 0)?", r"odbl 1 0"),
    ("ofl-1.1", r"sil open font license(?: version)?(?: 1 [01])?", r"ofl 1 1"),
    ("openssl", r"openssl license", r"openssl"),
    ("osl-3.0", r"open software license(?: version)?(?: v?3 0)?", r"osl 3 0"),
    ("php-3.01", r"php license(?: version)?(?: 3 01?)?", r"php 3 01"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license", r"polyform noncommercial 1 0 0"),
    ("postgresql", r"postgresql license", r"postgresql"),
    ("public-domain", r"public domain dedication", r"pddl 1 0"),
    ("python-2.0", r"(?:python software foundation|psf) license(?: agreement)?(?: version)?(?: 2)?", r"psf 2 0"),
    ("qpl-1.0", r"q public license(?: version)?(?: 1 0)?", r"qpl 1 0"),
    ("ruby", r"ruby license", r"ruby"),
    ("sleepycat", r"sleepycat license", r"sleepycat"),
    ("sspl-1.0", r"server side public license(?: version)?(?: v?1)?", r"sspl 1 0"),
    ("unicode", r"unicode license(?: agreement)?(?: v3)?", r"unicode 3 0"),
    ("unlicense", r"unlicense", r"unlicense"),
    ("upl-1.0", r"universal permissive license(?: version)?(?: v?1 0)?", r"upl 1 0"),
    ("vim", r"vim license", r"vim"),
    ("w3c", r"w3c software(?: notice and)? license", r"w3c"),
    ("wtfpl", r"(?:do what the fuck you want to public license|wtfpl)", r"wtfpl"),
    ("x11", r"x11 license agreement", r"x11"),
    ("zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("zpl-2.1", r"zope public license(?: version)?(?: 2 [01])?", r"zpl 2 1"),
)

#: fixed values: sentences of licence bodies, as (label, pattern)
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", r"this program is free software you can redistribute it and or modify it"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("proprietary", r"all rights reserved (?:no part of|unauthorized)"),
    ("proprietary", r"proprietary and confidential"),
    ("afl-3.0", r"licensed under the academic free license version 3 0"),
    ("agpl-3.0", r"affero general public license for more details"),
    ("agpl-3.0", r"remote network interaction use with the gnu general public license"),
    ("apache-1.1", r"products derived from this software may not be called apache"),
    ("apache-2.0", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except)"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing"),
    ("beerware", r"buy me a beer in return"),
    ("blessing", r"may you find forgiveness for yourself and forgive others"),
    ("boost-1.0", r"machine executable object code generated by a source language processor"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", r"neither the names? of the copyright holders? nor the names of its contributors"),
    ("bsd-4-clause", r"advertising materials mentioning features or use of this software must display"),
    ("busl-1.1", r"change date(?: of)?(?: the)? licensed work"),
    ("busl-1.1", r"additional use grant"),
    ("cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0", r"no copyright cc0 the person who associated a work"),
    ("cc-by", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-nc", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nd", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc0", r"creativecommons org publicdomain zero 1 0"),
    ("cddl-1.0", r"subject to the terms of the common development and distribution license"),
    ("cecill-2.1", r"governed by the cecill license under french law"),
    ("commons-clause", r"sell means practicing any or all of the rights granted to you"),
    ("curl", r"copyright c 1996 20[0-2][0-9] daniel stenberg"),
    ("elastic-2.0", r"provide the software to third parties as a hosted or managed service"),
    ("epl-1.0", r"eclipse org legal epl v10"),
    ("epl-2.0", r"eclipse org legal epl (?:v20|2 0)"),
    ("eupl-1.2", r"licensed under the eupl(?: version)? 1 2 or as soon they will be approved"),
    ("ftl", r"portions of this software are copyright c (?:the )?freetype project"),
    ("gfdl-1.3", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("gfdl-1.3", r"invariant sections no front cover texts"),
    ("gpl", r"received a copy of the gnu general public license along with"),
    ("gpl", r"gnu org licenses gpl"),
    ("gpl-2.0", r"free software foundation either version 2 of the license"),
    ("gpl-3.0", r"free software foundation either version 3 of the license"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("isc", r"software is provided as is and the author disclaims all warranties with regard"),
    ("lgpl", r"received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl-2.1", r"lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", r"lesser general public license as published by the free software foundation either version 3"),
    ("lppl-1.3c", r"latex project org lppl"),
    ("mit", r"copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", r"opensource org licenses mit"),
    ("mpl-1.1", r"mozilla org mpl mpl 1 1"),
    ("mpl-2.0", r"mozilla org mpl 2 0"),
    ("mpl-2.0", r"incompatible with secondary licenses as defined by the mozilla public license"),
    ("odbl-1.0", r"opendatacommons org licenses odbl"),
    ("ofl-1.1", r"reserved font names?"),
    ("ofl-1.1", r"scripts sil org ofl"),
    ("openssl", r"developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", r"includes php software freely available from"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("python-2.0", r"psf is making python available to licensee on an as is basis"),
    ("proprietary", r"confidential and proprietary"),
    ("proprietary", r"unauthorized (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:file|software|document|work)"),
    ("public-domain", r"dedicated to the public domain"),
    ("public-domain", r"released into the public domain"),
    ("sspl-1.0", r"offering the program as a service"),
    ("unicode", r"unicode org copyright html"),
    ("unlicense", r"unlicense org"),
    ("upl-1.0", r"larger works? to which the software is contributed"),
    ("w3c", r"w3 org consortium legal"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("zlib", r"origin of this software must not be misrepresented"),
    ("zpl-2.1", r"zope org resources zpl"),
)

#: notices in front of a name; their first words are the keywords of these rules
NOTICE_VERBS = ("licensed", "released", "distributed", "available", "published", "covered")
NOTICE = r"(?:licensed|released|distributed|available|published|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)?"
WINDOW_WORDS = 24


@dataclass(frozen=True)
class Rule:
    """A signature: it applies where one of ``keywords`` stands, with which all that it matches begins; of overlapping
    detections the lower ``priority`` is stronger."""

    keywords: tuple[str, ...]
    pattern: str
    label: str
    priority: int
    confidence: float
    base: bool = False


def _first_words(pattern: str) -> tuple[str, ...]:
    """The words that a name pattern can begin with, by its leading alternatives."""
    if pattern.startswith("(?:"):
        depth, end = 0, 0
        for end, c in enumerate(pattern):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        inside, rest = pattern[3:end], pattern[end + 1:]
        choices, depth, part = [], 0, ""
        for c in inside + "|":
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                choices.append(part)
                part = ""
            else:
                part += c
        if rest.startswith("?"):
            return tuple(dict.fromkeys([w for c in choices for w in _first_words(c)] + [*_first_words(rest[1:])]))
        return tuple(dict.fromkeys(w for c in choices for w in _first_words(c if " " in c.strip() else c.strip() + " ")))
    word = pattern.split(" ")[0]
    return _expanded(word)


def _expanded(word: str) -> tuple[str, ...]:
    """The plain words that a short pattern without blanks stands for."""
    if "(?:" in word:
        head, rest = word.split("(?:", 1)
        inside = rest.split(")", 1)[0]
        return tuple(dict.fromkeys(f"{head}{choice}".split(" ")[0] for choice in inside.split("|")) | ({head: None} if rest.endswith(")?") else {}))
    return (word.split("(")[0],)


def _strings(pattern: str, at: int = 0) -> tuple[list[str], int]:
    """All texts that a pattern of letters, groups, classes and question marks stands for, from ``at`` to the end of the
    group; what must not follow is left out."""
    done, texts = [], [""]
    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            done, texts, at = done + texts, [""], at + 1
            continue
        if pattern[at] == "(":
            unwanted = pattern.startswith("(?!", at)
            choices, at = _strings(pattern, at + 3)
            choices = [""] if unwanted else choices
        elif pattern[at] == "[":
            end = pattern.index("]", at)
            choices = [chr(c) for c in range(48, 123) if re.match(pattern[at: end + 1], chr(c))]
            at = end
        else:
            choices = [pattern[at]]
        at += 1
        if pattern.startswith("?", at):
            choices, at = ["", *choices], at + 1
        texts = [a + b for a in texts for b in choices]
    return done + texts, at


@cache
def required() -> dict[str, tuple[str, ...]]:
    """For each keyword, words of which a text has at least one if a rule of the keyword applies: of everything that a
    rule can match, the longest word beside the keyword, or the keyword if it is all."""
    out: dict[str, set[str]] = {}
    for rule in rules():
        for text in _strings(rule.pattern.removeprefix(f"{NOTICE} "))[0]:
            for keyword in rule.keywords:
                words = [keyword, *text.split(" ")] if rule.pattern.startswith(NOTICE) else text.split(" ")
                if words[0] == keyword:
                    out.setdefault(keyword, set()).add(max(words[1:] or words, key=len))
    return {keyword: tuple(sorted(words)) for keyword, words in sorted(out.items())}


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: identifiers, notices, body sentences, names, base phrases."""
    out = []
    for label, name, short in NAMES:
        out.append(Rule(("spdx",), rf"spdx license identifier {short}", label, 0, 1.0))
        out.append(Rule(NOTICE_VERBS, rf"{NOTICE} (?:{name}|{short}(?: license)?)", label, 1, 0.95))
        out.append(Rule(_first_words(name), name, label, 3, 0.8))
        if label.startswith("cc"):
            out.append(Rule((short.split(" ")[0].split("(")[0],), short, label, 3, 0.7))
    for label, sentence in BODIES:
        out.append(Rule((sentence.split(" ")[0],), sentence, label, 2, 0.9))
    for phrase, label in BASE_PHRASES:
        out.append(Rule((phrase.split(" ")[0],), phrase, label, 4, 0.6, True))
    return tuple(sorted(out, key=lambda r: (r.priority, r.label, r.pattern)))


def rule_table(spark: SparkSession, chosen: tuple[Rule, ...]) -> DataFrame:
    kind = T.StructType([T.StructField("_rule", T.IntegerType()), T.StructField("_keyword", T.StringType()), T.StructField("_pattern", T.StringType()),
                         T.StructField("_label", T.StringType()), T.StructField("_priority", T.IntegerType()), T.StructField("_confidence", T.DoubleType()),
                         T.StructField("_base", T.BooleanType())])
    return spark.createDataFrame(
        [(k, word, f"^(?:{r.pattern})(?= |$)", r.label, r.priority, r.confidence, r.base) for k, r in enumerate(chosen) for word in r.keywords], kind)


@dataclass(frozen=True)
class LicenseScan:
    """Find licence notices in whole texts.

    A text is its words (ASCII lower-cased). A gate made from the rules keeps the texts in which a rule can apply: those
    with a keyword and another word that one of its rules requires (``required``). In those, every rule is tried where
    its keyword stands. A detection inside another one of stronger or equal
    priority is suppressed (of two with the same rank and place, the first rule stays). Base phrases are counted and
    labelled whatever suppresses them. Equal texts are scanned once, whatever their number.

    NULL and empty texts have no words and no detection. Repeated rows each get their result; other columns stay as
    they are, those with names added here are replaced. An empty table gives an empty one.
    """

    text: str = "text"

    def _words(self, text: str) -> Column:
        return F.regexp_extract_all(F.translate(F.col(text), CAPITALS, SMALLS), F.lit(WORD), 0)

    def gated(self, words: Column | None = None) -> Column:
        """Whether a rule can apply, by the words of the text."""
        pairs = required()
        listed = F.array(*(F.lit(w) for w in sorted({*pairs, *(w for others in pairs.values() for w in others)})))
        others = F.create_map(*(c for k, w in pairs.items() for c in (F.lit(k), F.array(*map(F.lit, w)))))
        # the few words of rules that the text has, each once, are bound to a name by the array around them
        known = F.array(F.array_intersect(self._words(self.text) if words is None else words, listed))
        return F.coalesce(F.exists(known, lambda has: F.exists(has, lambda w: F.arrays_overlap(has, F.element_at(others, w)))), F.lit(False))

    def detections(self, docs: DataFrame) -> DataFrame:
        """Per different text (``_key``: its SHA-256): rule, label, first and end word, and whether it is suppressed."""
        return self._detections(docs.where(self.gated()).select(self._digest().alias("_key"), F.col(self.text).alias("_text")))

    def _digest(self) -> Column:
        return F.sha2(F.col(self.text).cast("binary"), 256)

    def _detections(self, texts: DataFrame) -> DataFrame:
        spark, chosen = texts.sparkSession, rules()
        keywords = sorted({word for r in chosen for word in r.keywords})
        texts = texts.withColumn("_words", self._words("_text"))
        placed = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(keywords))
        # a copy of a text makes the same rows: they go where rows are made distinct below
        spots = texts.select("_key", "_words", F.explode(placed).alias("_spot")).select(
            "_key", F.col("_spot.at").alias("_first"), F.col("_spot.word").alias("_keyword"),
            F.array_join(F.slice("_words", F.col("_spot.at") + 1, WINDOW_WORDS), " ").alias("_window")).distinct()
        found = (spots.join(F.broadcast(rule_table(spark, chosen)), "_keyword")  # the rules are a fixed list
                 .withColumn("_match", F.expr("regexp_extract(_window, _pattern, 0)")).where("_match != ''")
                 .withColumn("_end", F.col("_first") + F.size(F.split("_match", " "))))
        order = (F.col("_first"), F.col("_end").desc(), F.col("_priority"), F.col("_rule"))
        earlier = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.lit(False)
        for rank in sorted({r.priority for r in chosen}):
            reach = F.max(F.when(F.col("_priority") == rank, F.col("_end"))).over(earlier)
            inside = inside | ((F.col("_priority") >= rank) & F.coalesce(reach >= F.col("_end"), F.lit(False)))
        return found.select("_key", "_rule", "_label", "_priority", "_confidence", "_base", "_first", "_end", inside.alias("_suppressed"))

    def __call__(self, docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """n_words, n_base, first_word, last_word, base_labels, labels and score of every text."""
        held, back = set_aside(docs, HELPERS)
        if back:  # own columns step aside, whatever their names
            there = {name: new for new, name in back.items()}
            own = None if keep is None else tuple(there.get(c, c) for c in keep)
            return replace(self, text=there.get(self.text, self.text))(held, own).withColumnsRenamed(back)
        added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        names = [c for c in (docs.columns if keep is None else keep) if c not in added]
        shown = (F.col("_base") | ~F.col("_suppressed"))
        gated = F.col("_gated")
        # texts that no rule looks at get keys of their own, so that they do not meet in one task
        key = F.when(gated, self._digest()).otherwise(F.concat(F.lit("-"), F.xxhash64(*names).cast("string")))
        counted = docs.select("*", self._words(self.text).alias("_words")).select(
            "*", F.coalesce(F.size(F.col("_words")), F.lit(0)).cast("long").alias("_n_words"), self.gated(F.col("_words")).alias("_gated"))
        rows = stored(counted.select(
            *names, F.col("_n_words").alias("n_words"), key.alias("_key"), F.when(gated, F.col(self.text)).alias("_text")), "license-texts")
        found = self._detections(rows.where("_text is not null").select("_key", "_text")).groupBy("_key").agg(
            F.count(F.when(F.col("_base"), 1)).alias("_n_base"),
            F.min(F.when(F.col("_base"), F.col("_first"))).cast("long").alias("_first_word"),
            F.max(F.when(F.col("_base"), F.col("_first"))).cast("long").alias("_last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("_base"), F.col("_label")))), ",").alias("_base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(shown, F.col("_label")))), ",").alias("_labels"),
            F.max(F.when(shown, F.col("_confidence"))).alias("_score"))
        return rows.drop("_text").join(found, "_key", "left").select(
            *names, "n_words", F.coalesce("_n_base", F.lit(0)).cast("long").alias("n_base"), F.col("_first_word").alias("first_word"),
            F.col("_last_word").alias("last_word"), F.coalesce("_base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("_labels", F.lit("")).alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"))
