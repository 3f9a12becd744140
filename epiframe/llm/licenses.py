"""Operator 9: licence scan by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word in lower-cased text, and the same in text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases every scan reports, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence names as word patterns: label, words that must be present (the first from its
#: beginning), pattern, short identifier (if not that of another line).
NAMES = (
    ("mit", "mit", "mit (?:software )?licen[cs]e", "mit"),
    ("mit", "expat", "expat licen[cs]e", "expat"),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("x11", "x11", "x11 licen[cs]e", "x11"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e(?: version)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[cs]e(?: version| v)? ?(?:v?2)(?: 0)?", "apache 2 0"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e(?: version| v)? v?1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e(?: version| v)? v?2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e(?: version| v)? v?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "library general", "(?:gnu )?library general public licen[cs]e(?: version| v)?(?: v?2(?: 0)?)?", "lgpl 2 0"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? v?2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public licen[cs]e(?: version| v)? v?3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public licen[cs]e", "lgpl"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: version| v)?(?: v?3(?: 0)?)?", "agpl 3 0"),
    ("fdl-1.3", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)?(?: 1 [0-9])?", "gfdl 1 3"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-2-clause", "freebsd", "freebsd(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsd-0-clause", "bsd", "(?:zero clause bsd|0 clause bsd)(?: licen[cs]e)?", "0bsd"),
    ("bsd-0-clause", "0bsd", "0bsd(?: licen[cs]e)?", ""),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? v?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version| v)?(?: v?2(?: 0)?)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? v?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version| v)?(?: v?2(?: 0)?)?", "epl 2 0"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e", "cddl 1 0"),
    ("eupl-1.2", "european union", "european union public licen[cs]e", "eupl 1 2"),
    ("isc", "isc", "isc licen[cs]e", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", "libpng licen[cs]e", "libpng"),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?: version| v)?(?: 1 0)?", "bsl 1 0"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version| v)?(?: 2(?: 0)?)?", "artistic 2 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("psf-2.0", "python software", "python software foundation licen[cs]e", "psf 2 0"),
    ("php-3.01", "php", "php licen[cs]e(?: version| v)?(?: 3 0?1)?", "php 3 01"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open database", "open database licen[cs]e", "odbl 1 0"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", "ms pl"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd-4.0", "nd", "(?:cc|creative commons) by nc nd(?: 4 0)?", "cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "sa", "(?:cc|creative commons) by nc sa(?: 4 0)?", "cc by nc sa 4 0"),
    ("cc-by-nc-4.0", "by nc", "(?:cc|creative commons) by nc(?: 4 0)?", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "by nd", "(?:cc|creative commons) by nd(?: 4 0)?", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "by sa", "(?:cc|creative commons) by sa(?: 4 0)?", "cc by sa 4 0"),
    ("cc-by-4.0", "by", "(?:cc|creative commons) by(?: 4 0)?", "cc by 4 0"),
    ("cc-by", "creative commons", "creative commons attribution(?: licen[cs]e)?", "cc by"),
)

#: How a name is brought in: word that must be present, words before the name, priority, weight.
FORMS = (
    ("", "", 10, 0.4),
    ("licensed under", "licensed under (?:the )?(?:terms of )?(?:the )?", 40, 0.9),
    ("released under", "released under (?:the )?(?:terms of )?(?:the )?", 40, 0.9),
    ("distributed under", "distributed under (?:the )?(?:terms of )?(?:the )?", 40, 0.9),
    ("available under", "available under (?:the )?(?:terms of )?(?:the )?", 40, 0.85),
    ("subject to", "subject to (?:the )?(?:terms of )?(?:the )?", 30, 0.7),
)

#: Phrases of licence texts: label, keyword, pattern, priority, weight.
TEXTS = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 60, 0.95),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software", 60, 0.9),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 60, 0.9),
    ("bsd-3-clause", "endorse or promote", "(?:may be used )?to endorse or promote products derived from this software", 50, 0.8),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features", 60, 0.9),
    ("apache-2.0", "apache org", "www apache org licenses license 2 0", 60, 0.95),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify", 60, 0.9),
    ("agpl-3.0", "remote network", "remote network interaction use with the gnu general public license", 60, 0.9),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 60, 0.95),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", 20, 0.5),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such", 60, 0.9),
    ("bsl-1.0", "boost org", "www boost org license 1 0", 60, 0.9),
    ("proprietary", "rights reserved", "all rights reserved", 20, 0.3),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)", 30, 0.6),
    ("warranty-disclaimer", "as is", "(?:is )?provided (?:by [a-z ]{1,60} )?as is", 15, 0.3),
    ("see-license-file", "license", "see (?:the )?(?:accompanying )?license (?:file|txt|md)(?: for details)?", 25, 0.5),
)

#: A text in which none of these stands cannot match any rule. Single words only: what lies between words is free.
GATE = (r"(?i)licen[cs]e|spdx|reserved|commons|domain|wtfpl|bsd|cc0|attribution|confidential|provided|permission|redistribut"
        r"|software|advertising|endorse|plainly|apache|boost|(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])cc(?:$|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])")


@dataclass(frozen=True)
class Rule:
    """A signature: its pattern is tried where all keywords stand in the words."""

    label: str
    keywords: tuple[str, str]
    pattern: str
    priority: int
    weight: float
    base: bool = False


def default_rules() -> list[Rule]:
    """The base phrases, every name in every form, identifiers, and texts' phrases."""
    rules = [Rule(label, (phrase, phrase), phrase, 5, 0.4, True) for phrase, label in BASE]
    for label, keyword, pattern, short in NAMES:
        rules += [Rule(label, (keyword, form), before + pattern, priority, weight) for form, before, priority, weight in FORMS]
        if short:
            rules.append(Rule(label, ("spdx", short), f"spdx license identifier {short}(?: only| or later)?", 70, 0.98))
    rules += [Rule(label, (keyword, keyword), pattern, priority, weight) for label, keyword, pattern, priority, weight in TEXTS]
    return rules


_RULE = ("array<struct<id:int,label:string,first:string,second:string,pattern:string,"
         "priority:int,weight:double,base:boolean>>")


def _rules_column(rules: list[Rule]) -> Column:
    """All rules as one constant."""
    rows = [{"id": i, "label": r.label, "first": f" {r.keywords[0]}", "second": r.keywords[1] and f" {r.keywords[1]}",
             "pattern": f"(?<= )({r.pattern})(?= )", "priority": r.priority, "weight": float(r.weight), "base": r.base}
            for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), _RULE)


def _detections(words: Column, rules: Column) -> Column:
    """All matches of the rules whose keywords are present: start, -end, -priority, rule id, ..."""
    def matches(r: Column) -> Column:
        marked = F.split(F.btrim(F.regexp_replace(words, r["pattern"], F.lit("\u0001$1\u0002"))), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i)), F.isnotnull)
        ends = F.filter(F.transform(marked, lambda w, i: F.when(w.endswith("\u0002"), i)), F.isnotnull)
        return F.zip_with(starts, ends, lambda s, e: F.struct(
            s.alias("start"), (-e - 1).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["id"].alias("rule"),
            r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base")))

    active = F.filter(rules, lambda r: F.contains(words, r["first"]) & F.contains(words, r["second"]))
    return F.sort_array(F.flatten(F.transform(active, matches)))


def _resolve(found: Column) -> Column:
    """Fold detections in order of (start, longest, priority): labels and score of those that stay.

    One inside the reach of those before it goes (of equal spans the first, of higher
    priority, stays); one that begins inside and ends beyond goes if its priority is lower.
    """
    zero = F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("priority"),
                    F.lit(0).alias("kept"), F.lit(1.0).alias("miss"), F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["neg_end"], -d["neg_priority"]
        stays = (end > acc["reach"]) & ((d["start"] >= acc["reach"]) | (priority >= acc["priority"]))
        return F.struct(
            F.when(stays, end).otherwise(acc["reach"]).alias("reach"),
            F.when(stays, priority).otherwise(acc["priority"]).alias("priority"),
            (acc["kept"] + stays.cast("int")).alias("kept"),
            F.when(stays, acc["miss"] * (F.lit(1.0) - d["weight"])).otherwise(acc["miss"]).alias("miss"),
            F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"))

    return F.aggregate(found, zero, step)


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text",
         gate: str = GATE) -> DataFrame:
    """Scan whole texts for licence statements; one row per row of ``docs``.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (smallest and largest start of one, in words from 0; null without), base_labels,
    labels (base and method, distinct, sorted, comma-joined), n_kept (detections that
    stay), score (1 - product of 1 - weight over these). Everything is computed within
    the row, no data is moved. Null text is empty: no words, no labels, score 0. Null
    ids and repeated rows give rows of their own.
    """
    own = _rules_column(rules if rules is not None else default_rules())
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
                       F.when(text.rlike(gate), text).otherwise(F.lit("")).alias("text"))
    rows = rows.select("doc_id", "n_words", F.when(F.length("text") > 0, F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(
        F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)), " "), F.lit(" "))).otherwise(F.lit("")).alias("words"))
    rows = rows.select("doc_id", "n_words", _detections(F.col("words"), own).alias("found"))
    rows = rows.select("doc_id", "n_words", F.filter("found", lambda d: d["base"]).alias("base"), _resolve(F.col("found")).alias("kept"))
    base_labels = F.array_distinct(F.transform("base", lambda d: d["label"]))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("kept.labels"))), ",").alias("labels"),
        F.col("kept.kept").alias("n_kept"), (F.lit(1.0) - F.col("kept.miss")).alias("score"))
