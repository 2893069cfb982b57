"""License scan: ordered signature rules over the words of a text.

A text becomes ``" w1 w2 ... wn "``: words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, one
blank before and after each. Three passes, all DataFrame expressions inside one projection (no shuffle at all):

1. *gate*: one regular expression over the few words that every rule needs some of; most texts stop here;
2. *keyword prefilter*: of the rules, those whose keyword the text holds;
3. *detection*: the rule's expression, all its places; then priority and interval containment: a detection goes if
   one of the same or a higher priority covers it. Sorted by start, longest and highest first, the covering one always
   stands earlier, so one sweep with the furthest end for each priority decides.

Nulls: a null text is empty. Empty texts: no words, no labels, score 0. Repeated rows give repeated results; every
row is judged alone, so ties, skew and extra columns don't matter.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import let, table

#: The contract's phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Confidence of a detection by priority: 3 names a license and its version or tag, 2 names it, 1 only speaks of licensing.
CONFIDENCE = {3: 1.0, 2: 0.8, 1: 0.4}

_V = r"(?: (?:version|v|ver))?"
_OR = r"(?: or (?:any )?(?:later|newer)(?: versions?)?)?"


def _families() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression over words). Each expression starts at the blank before its first word."""
    rules: list[tuple[str, int, str, str]] = []
    add = lambda label, priority, keyword, *patterns: rules.extend((label, priority, keyword, p) for p in patterns)

    # Creative Commons: licence elements, then versions.
    for tail, words, spoken in (
        ("by", "by", "attribution"),
        ("by-sa", "by sa", "attribution share ?alike"),
        ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
        ("by-nc", "by nc", "attribution non ?commercial"),
        ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
        ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ):
        add(f"cc-{tail}", 2, " cc ", rf" cc {words}")
        add(f"cc-{tail}", 2, " creativecommons ", rf" creativecommons org licenses {words}")
        add(f"cc-{tail}", 2, " creative", rf" creative commons {spoken}(?: international| unported| generic)?(?: public)?(?: license| licence)?")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{tail}-{version.replace(' ', '.')}"
            add(label, 3, " cc ", rf" cc {words} {version}")
            add(label, 3, " creative", rf" creative commons {spoken} {version}(?: international| unported| generic)?(?: public)?(?: license| licence)?")
            add(label, 3, " creativecommons ", rf" creativecommons org licenses {words} {version}")
    add("cc0-1.0", 3, " cc0 ", r" cc0(?: 1 0)?(?: universal)?")
    add("cc0-1.0", 3, " creativecommons ", r" creativecommons org publicdomain zero 1 0")
    add("public-domain", 2, " public domain ", r" (?:released|placed|dedicated|is) (?:in|into|to) the public domain", r" public domain (?:dedication|mark|work)")
    add("creative-commons", 1, " creative", r" creative commons(?: licen[cs]e)?")

    # GNU: three licences, their versions, and the usual ways to write them.
    for label, short, name in (("gpl", "gpl", "gnu general public"), ("lgpl", "lgpl", "gnu (?:lesser|library) general public"), ("agpl", "agpl", "gnu affero general public")):
        add(label, 2, f" {short}", rf" (?:gnu )?{short}(?: licen[cs]ed?)?(?= )")
        add(label, 2, " general public ", rf" (?:the )?{name} licen[cs]e")
        for version in ("1", "2", "2 1", "3"):
            full = f"{label}-{version.replace(' ', '.')}"
            dot = rf"{version}(?: 0)?(?= )"
            add(full, 3, f" {short}", rf" (?:gnu )?{short}{_V} ?v?{dot}{_OR}")
            add(full, 3, " general public ", rf" (?:the )?{name} licen[cs]e{_V} {dot}{_OR}", rf" version {dot} of the {name} licen[cs]e{_OR}")
            add(full, 3, " spdx ", rf" spdx license identifier {short} {dot}(?: only| or later)?")
    add("gpl", 2, " general public ", r" general public licen[cs]e")
    add("gfdl", 2, " free documentation ", r" gnu free documentation licen[cs]e(?: version 1 [123])?")

    # Permissive and copyleft licences that carry versions.
    for label, name, versions in (
        ("apache", "apache", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla public", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse public", ("1 0", "2 0")),
        ("cddl", "common development and distribution", ("1 0", "1 1")),
        ("eupl", "european union public", ("1 1", "1 2")),
        ("artistic", "artistic", ("1 0", "2 0")),
        ("boost", "boost software", ("1 0",)),
        ("cpl", "common public", ("1 0",)),
        ("ofl", "(?:sil )?open font", ("1 0", "1 1")),
        ("afl", "academic free", ("2 1", "3 0")),
        ("osl", "open software", ("2 1", "3 0")),
        ("odbl", "open (?:data commons open )?database", ("1 0",)),
        ("python", "python software foundation", ("2",)),
        ("zpl", "zope public", ("2 0", "2 1")),
        ("ecl", "educational community", ("1 0", "2 0")),
        ("upl", "universal permissive", ("1 0",)),
        ("cecill", "cecill(?: free software)?", ("2 0", "2 1")),
        ("openldap", "openldap public", ("2 7", "2 8")),
        ("php", "php", ("3 0", "3 01")),
        ("llgpl", "lisp lesser general public", ("2 1",)),
    ):
        add(label, 2, " licen", rf" (?:the )?{name} licen[cs]e")
        for version in versions:
            add(f"{label}-{version.replace(' ', '.')}", 3, " licen", rf" (?:the )?{name} licen[cs]e{_V} {version}", rf" version {version} of the {name} licen[cs]e")
            if name.isalpha():
                add(f"{label}-{version.replace(' ', '.')}", 3, f" {name} ", rf" {name} {version}(?= )")
                add(f"{label}-{version.replace(' ', '.')}", 3, " spdx ", rf" spdx license identifier {name} {version}")
    add("apache-2.0", 3, " apache ", r" www apache org licenses license 2 0")
    add("mpl", 2, " mozilla ", r" mozilla org mpl(?: 2 0)?")

    # Licences without versions, by name and by their best known sentences.
    for label, name in (
        ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib(?: libpng)?"), ("x11", "x11"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("ncsa", "university of illinois ncsa open source"),
        ("postgresql", "postgresql"), ("beerware", "beer ?ware"), ("ruby", "ruby"), ("vim", "vim"), ("curl", "curl"), ("openssl", "openssl"), ("intel", "intel open source"), ("ibm-pl", "ibm public"),
        ("microsoft-pl", "microsoft public"), ("microsoft-rl", "microsoft reciprocal"), ("sleepycat", "sleepycat"), ("w3c", "w3c software"), ("unicode", "unicode(?: inc)?"),
        ("json", "json"), ("ms-eula", "end user"), ("proprietary", "proprietary"), ("commercial", "commercial"), ("elastic", "elastic"), ("sspl", "server side public"), ("busl", "business source"),
    ):
        add(label, 2, " licen", rf" (?:the )?{name} licen[cs]e", rf" licensed under (?:the )?(?:terms of )?(?:the )?{name}(?= )")
    for n in ("0", "1", "2", "3", "4"):
        add(f"bsd-{n}-clause", 3, " bsd ", rf" bsd {n} clause(?: licen[cs]e)?", rf" {n} clause bsd(?: licen[cs]e)?")
    for n, word in (("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{n}-clause", 3, " bsd ", rf" {word} clause bsd(?: licen[cs]e)?")
    add("bsd-2-clause", 3, " bsd ", r" simplified bsd(?: licen[cs]e)?", r" freebsd licen[cs]e")
    add("bsd-3-clause", 3, " bsd ", r" (?:new|modified|revised) bsd(?: licen[cs]e)?")
    add("bsd", 2, " bsd ", r" bsd(?: style)? licen[cs]e")
    add("mit", 3, " permission ", r" permission is hereby granted free of charge to any person obtaining a copy")
    add("isc", 3, " permission ", r" permission to use copy modify and or distribute this software for any purpose with or without fee")
    add("bsd", 3, " redistribution", r" redistribution and use in source and binary forms with or without modification are permitted")
    add("zlib", 3, " altered ", r" altered source versions must be plainly marked as such")
    add("unlicense", 3, " unencumbered ", r" free and unencumbered software released into the public domain")
    add("wtfpl", 3, " do what ", r" do what the \S+ you want to public licen[cs]e")
    add("no-warranty", 2, " warrant", r" provided as is without warrant(?:y|ies) of any kind", r" without warrant(?:y|ies) of any kind")

    # Terms that name no licence.
    add("reserved", 2, " rights reserved ", r" all rights reserved")
    add("some-reserved", 2, " rights reserved ", r" some rights reserved")
    add("copyright", 1, " copyright", r" copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?", r" copyrighted (?:material|work|by)", r" copyright (?:holders?|owners?|notice)")
    add("no-derivatives", 1, " reproduc", r" no part of this (?:publication|book|work|document) may be reproduced", r" may not be reproduced(?: or distributed)? without")
    add("permission", 1, " permission", r" (?:used|reprinted|reproduced) (?:with|by) (?:kind )?permission", r" without (?:the )?(?:prior )?(?:express )?(?:written )?permission")
    add("non-commercial", 1, " commercial ", r" (?:for )?non ?commercial (?:use|purposes?)(?: only)?", r" not for commercial use")
    add("confidential", 1, " confidential ", r" (?:strictly |company )?confidential and proprietary", r" proprietary and confidential")
    add("trademark", 1, " trademark", r" (?:is|are) (?:a )?(?:registered )?trademarks? of")
    add("license", 1, " licen", r" (?:is |are )?(?:released|licensed|distributed|published|available) under", r" licen[cs]e agreement", r" terms of (?:the|this) licen[cs]e", r" see (?:the )?licen[cs]e")
    return rules


def rules() -> list[dict]:
    """All rules in order; a rule's place in the list is its id."""
    return [{"rule": i, "label": a, "priority": b, "keyword": k, "pattern": f"(?i){p}(?= )"} for i, (a, b, k, p) in enumerate(_families())]


#: Every rule's keyword holds one of these stems, so a text without any needs no rule.
STEMS = ("licen", "copyright", "rights reserved", " cc ", " cc0 ", "creative", "gpl", "general public", "public domain", "free documentation", "spdx", "apache", "mozilla", "bsd", "permission", "redistribution", "altered", "unencumbered", "do what", "warrant", "reproduc", "commercial", "confidential", "trademark", " php ", " artistic ")


def words_only(text: Column) -> Column:
    """``" w1 w2 "``: each word with a blank before it and a blank at the end; case is left alone."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _rule_table() -> Column:
    """The rules as one constant, which the optimizer folds before any row is read."""
    rows = (f"struct({r['rule']} AS rule, r'{r['label']}' AS label, {r['priority']} AS priority, r'{r['keyword']}' AS keyword, r'{r['pattern']}' AS pattern)" for r in rules())
    return F.expr(f"array({', '.join(rows)})")


def _detections(norm: Column, lower: Column) -> Column:
    """array<struct<start, neg_end, neg_priority, rule, label>> of all rules whose keyword the text holds."""

    none = F.array().cast("array<struct<end:int,m:int>>")
    block = 64  # sums of whole blocks first, so that many places in one text don't cost their square
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["g"] + x["m"])

    def ends(steps: Column) -> Column:
        """Where each match ends: all gaps up to it, all matches before it, and itself."""
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / block).cast("int")), lambda b: total(F.slice(steps, b * block + 1, F.lit(block))))
        return let(
            sums,
            lambda blocks: F.transform(
                steps,
                lambda x, i: F.struct(
                    (
                        F.aggregate(F.slice(blocks, F.lit(1), F.floor(i / block).cast("int")), F.lit(0), lambda a, y: a + y)
                        + total(F.slice(steps, (F.floor(i / block) * block + 1).cast("int"), (i % block + 1).cast("int")))
                    ).alias("end"),
                    x["m"].alias("m"),
                ),
            ),
        )

    def places(r: Column) -> Column:
        def steps(found: Column) -> Column:
            gaps = F.transform(F.split(norm, r["pattern"], -1), F.length)
            zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.transform(found, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
            return F.when(F.size(found) > 0, let(zipped, ends)).otherwise(none)

        return let(F.regexp_extract_all(norm, r["pattern"], F.lit(0)), steps)

    hit = F.filter(_rule_table(), lambda r: F.contains(lower, r["keyword"]))
    return F.array_sort(
        F.flatten(
            F.transform(
                hit,
                lambda r: F.transform(
                    places(r),
                    lambda p: F.struct(
                        (p["end"] - p["m"]).alias("start"), (-p["end"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["rule"].alias("rule"), r["label"].alias("label")
                    ),
                ),
            )
        )
    )


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, rules (numbers of those with a detection that survives), n_detections
    (before suppression) and score. Columns of ``docs`` with these names are replaced; names that begin with two underscores are ours. A null text is
    empty: no words, no labels, score 0. Repeated rows get equal results; an empty table gives no rows."""
    raw = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__norm", words_only(raw))
    d = d.withColumn("__norm", F.when(F.col("__norm") == "  ", F.lit(" ")).otherwise(F.col("__norm")))
    norm = F.col("__norm")
    d = d.withColumn("n_words", (_blanks(norm) - 1).cast("long"))
    # Case is folded by (?i), which means A-Z in Java; lower() folds more, so it can only let too many through a prefilter.
    d = d.withColumn("__lower", F.lower(norm))
    lower = F.col("__lower")
    d = d.withColumn("__gate", functools.reduce(lambda a, b: a | b, [lower.contains(s) for s in STEMS]))
    gate = F.col("__gate")
    base = []
    for phrase, label in BASE:
        parts = F.split(norm, f"(?i) {phrase}(?= )", -1)
        k = phrase.count(" ") + 1
        n = F.size(parts) - 1
        base.append(
            F.when(
                lower.contains(f" {phrase} ") & (n > 0),
                F.struct(
                    F.lit(label).alias("label"),
                    n.cast("long").alias("n"),
                    _blanks(F.element_at(parts, 1)).cast("long").alias("first"),
                    (F.col("n_words") - (_blanks(F.element_at(parts, -1)) - 1) - k).cast("long").alias("last"),
                ),
            )
        )
    d = d.withColumn("__base", F.when(gate, F.array_compact(F.array(*base))).otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")))
    d = d.withColumn("__found", F.when(gate, _detections(norm, lower)).otherwise(F.array().cast("array<struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>>")))
    # The sweep. Ends are kept for priority 1 and more, 2 and more, 3; an end at or past ours covers us.
    start = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        end, priority = -x["neg_end"], -x["neg_priority"]
        reach = F.when(priority == 1, a["e1"]).when(priority == 2, a["e2"]).otherwise(a["e3"])
        return F.struct(
            F.greatest(a["e1"], end).alias("e1"),
            F.when(priority >= 2, F.greatest(a["e2"], end)).otherwise(a["e2"]).alias("e2"),
            F.when(priority >= 3, F.greatest(a["e3"], end)).otherwise(a["e3"]).alias("e3"),
            # a rule id stands once however often the text repeats it: the state stays as small as the rule list
            F.when(reach >= end, a["kept"]).otherwise(F.array_union(a["kept"], F.array(x["rule"]))).alias("kept"),
        )

    d = d.withColumn("__kept", F.when(F.size("__found") > 0, F.aggregate(F.col("__found"), start, step, lambda a: a["kept"])).otherwise(F.array().cast("array<int>")))
    by_rule = F.transform(F.col("__kept"), lambda i: F.element_at(_rule_table(), i + 1))
    d = d.withColumn("__hits", F.when(F.size("__kept") > 0, by_rule).otherwise(F.array().cast("array<struct<rule:int,label:string,priority:int,keyword:string,pattern:string>>")))
    conf = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.array_max(F.transform(F.col("__hits"), lambda h: h["priority"])))
    return d.withColumns(
        {
            "n_base": F.aggregate(F.col("__base"), F.lit(0).cast("long"), lambda a, x: a + x["n"]),
            "first_word": F.array_min(F.transform(F.col("__base"), lambda x: x["first"])),
            "last_word": F.array_max(F.transform(F.col("__base"), lambda x: x["last"])),
            "base_labels": F.array_join(F.array_sort(F.transform(F.col("__base"), lambda x: x["label"])), ","),
            "labels": F.array_join(
                F.array_sort(F.array_union(F.transform(F.col("__base"), lambda x: x["label"]), F.array_distinct(F.transform(F.col("__hits"), lambda h: h["label"])))), ","
            ),
            "rules": F.array_sort(F.col("__kept")),
            "n_detections": F.size("__found").cast("long"),
            "score": F.when(F.size("__hits") > 0, conf).when(F.size("__base") > 0, F.lit(CONFIDENCE[2])).otherwise(F.lit(0.0)),
        }
    ).drop("__norm", "__lower", "__gate", "__base", "__found", "__kept", "__hits")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")
