"""License detection by ordered signature rules. Column expressions, windows and one join only.

A text becomes a stream of words, each with a blank before and after it. A rule is a regular expression over that
stream with a label, a priority and a weight. Rules are written for single notices and, for every
license, from its name in each of the forms in which a license is usually named.

A rule runs on a text only if its keyword stands there: one scan lists the keywords of a text, and a lookup by
keyword gives its rules. Of overlapping detections the one is dropped that lies inside another
of a better or equal priority (of two alike the rule that comes first stays), which a running maximum of ends
over the detections of a text settles. Detections of ``BASE`` are facts about the text and always stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinelink.llm.common import stored
from brinelink.llm.variants import LOWER, UPPER

#: Characters that separate words, after A-Z are folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The notation of rules: words of the stream one after another. ``a|b`` is either word, ``a?`` may be missing,
# ``~4`` stands for up to four words of any kind. The keyword of a rule must be one of its fixed words.

#: Phrases whose every place counts, and their labels (fixed values).
BASE = [
    ("under the mit license", "mit", "mit"),
    ("apache license version 2", "apache-2", "apache"),
    ("cc by nc", "cc-by-nc", "cc"),
]

#: Licenses: label, name in the stream, keyword, and whether the name alone is a sign.
NAMES = [
    ("mit", "mit", "mit", False),
    ("mit-0", "mit no attribution", "attribution", True),
    ("apache-2", "apache software? license|licence? version|v? 2|v2 0?", "apache", True),
    ("apache-1.1", "apache software? license|licence? version|v? 1 1", "apache", True),
    ("apache", "apache", "apache", False),
    ("bsd-2", "2|two clause bsd", "bsd", True),
    ("bsd-2", "bsd 2|two clause", "bsd", True),
    ("bsd-2", "simplified bsd", "bsd", True),
    ("bsd-3", "3|three clause bsd", "bsd", True),
    ("bsd-3", "bsd 3|three clause", "bsd", True),
    ("bsd-3", "new|modified|revised bsd", "bsd", True),
    ("bsd-4", "4|four clause bsd", "bsd", True),
    ("bsd-4", "bsd 4|four clause", "bsd", True),
    ("bsd-0", "zero|0 clause bsd", "bsd", True),
    ("bsd", "bsd", "bsd", False),
    ("gpl-2", "gnu? gpl version|v? 2|v2 0?", "gpl", True),
    ("gpl-2", "gnu general public license|licence version|v? 2|v2 0?", "public", True),
    ("gpl-3", "gnu? gpl version|v? 3|v3 0?", "gpl", True),
    ("gpl-3", "gnu general public license|licence version|v? 3|v3 0?", "public", True),
    ("gpl", "gnu general public license|licence", "public", True),
    ("gpl", "gpl|gplv2|gplv3", "", True),
    ("lgpl-2.1", "gnu? lgpl version|v? 2|v2 1", "lgpl", True),
    ("lgpl-2.1", "gnu lesser general public license|licence version|v? 2|v2 1", "lesser", True),
    ("lgpl-3", "gnu? lgpl version|v? 3|v3 0?", "lgpl", True),
    ("lgpl-3", "gnu lesser general public license|licence version|v? 3|v3 0?", "lesser", True),
    ("lgpl", "gnu lesser|library general public license|licence", "general", True),
    ("lgpl", "lgpl", "lgpl", True),
    ("agpl-3", "gnu? agpl version|v? 3|v3 0?", "agpl", True),
    ("agpl-3", "gnu? affero general public license|licence version|v? 3|v3 0?", "affero", True),
    ("agpl", "affero general public license|licence", "affero", True),
    ("agpl", "agpl", "agpl", True),
    ("mpl-1.1", "mozilla public license|licence? version|v? 1 1", "mozilla", True),
    ("mpl-2", "mozilla public license|licence? version|v? 2|v2 0?", "mozilla", True),
    ("mpl-2", "mpl version|v? 2|v2 0?", "mpl", True),
    ("mpl", "mozilla public", "mozilla", True),
    ("epl-1", "eclipse public license|licence? version|v? 1|v1 0?", "eclipse", True),
    ("epl-2", "eclipse public license|licence? version|v? 2|v2 0?", "eclipse", True),
    ("epl", "eclipse public", "eclipse", True),
    ("edl", "eclipse distribution", "eclipse", True),
    ("cddl", "common development and distribution", "development", True),
    ("cddl", "cddl", "cddl", True),
    ("eupl", "european union public", "european", True),
    ("eupl", "eupl", "eupl", True),
    ("isc", "isc", "isc", False),
    ("zlib", "zlib libpng?", "zlib", False),
    ("boost", "boost software", "boost", True),
    ("artistic-2", "artistic license|licence? version|v? 2 0?", "artistic", True),
    ("artistic", "artistic", "artistic", False),
    ("python", "python software foundation", "python", True),
    ("unlicense", "unlicense", "unlicense", True),
    ("wtfpl", "wtfpl", "wtfpl", True),
    ("ofl", "sil open font", "sil", True),
    ("postgresql", "postgresql", "postgresql", False),
    ("cc0", "cc0", "cc0", True),
    ("cc0", "cc 0", "cc", True),
    ("cc0", "creative commons zero", "commons", True),
    ("cc-by", "cc by", "cc", True),
    ("cc-by-sa", "cc by sa", "cc", True),
    ("cc-by-nd", "cc by nd", "cc", True),
    ("cc-by-nc", "cc by nc", "cc", True),
    ("cc-by-nc-sa", "cc by nc sa", "cc", True),
    ("cc-by-nc-nd", "cc by nc nd", "cc", True),
    ("cc-by", "creative commons attribution", "commons", True),
    ("cc-by-sa", "creative commons attribution share sharealike|alike", "commons", True),
    ("cc-by-sa", "creative commons attribution sharealike", "commons", True),
    ("cc-by-nd", "creative commons attribution noderivatives|noderivs", "commons", True),
    ("cc-by-nc", "creative commons attribution noncommercial", "commons", True),
    ("cc-by-nc", "creative commons attribution non commercial", "commons", True),
    ("cc-by-nc-sa", "creative commons attribution non? noncommercial|commercial share? sharealike|alike", "commons", True),
    ("cc", "creative commons", "commons", True),
    ("odbl", "open database", "database", False),
    ("odc-by", "open data commons attribution", "commons", True),
    ("pddl", "public domain dedication", "dedication", True),
    ("sspl", "server side public", "server", False),
    ("busl", "business source", "business", False),
    ("elastic", "elastic", "elastic", False),
    ("openrail", "openrail|rail", "", False),
    ("llama", "llama 2|3 community", "llama", False),
]

#: Forms of naming a license: priority, weight, words around the name (None: the name itself).
FORMS = [
    (1, 1.0, "spdx license identifier {}"),
    (2, 0.95, "licensed|released|distributed|published|provided|available ~2 under|with ~5 {}"),
    (2, 0.9, "under ~5 {} license|licence|licenses|terms"),
    (3, 0.8, "{} license|licence|licensed"),
    (3, 0.75, "license|licence|licenses|licensing {}"),
    (3, 0.7, "see ~3 {} for details|terms"),
    (4, 0.5, "{}"),
]

#: Rules for single notices: label, priority, weight, words, keyword.
NOTICES = [
    ("mit", 1, 1.0, "permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("isc", 1, 1.0, "permission to use copy modify and or? distribute this software for any purpose", "modify"),
    ("bsd", 1, 1.0, "redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("bsd-3", 1, 0.9, "neither the name of ~8 nor the names of its contributors", "contributors"),
    ("bsd-4", 1, 0.9, "all advertising materials mentioning features or use of this software", "advertising"),
    ("gpl", 1, 0.9, "this program is free software you can redistribute it and or modify it", "redistribute"),
    ("lgpl", 1, 0.9, "this library is free software you can redistribute it and or modify it", "redistribute"),
    ("zlib", 1, 0.9, "altered source versions must be plainly marked as such", "altered"),
    ("unlicense", 1, 1.0, "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", 1, 0.9, "do what the fuck you want to public", "fuck"),
    ("boost", 1, 0.9, "boost software license version 1 0", "boost"),
    ("mpl-2", 1, 1.0, "this source code form is subject to the terms of the mozilla public license v|version 2 0", "mozilla"),
    ("apache-2", 1, 1.0, "www apache org licenses license 2 0", "apache"),
    ("apache-2", 1, 0.9, "you may not use this file except in compliance with the license", "compliance"),
    ("gpl", 1, 0.9, "www gnu org licenses gpl", "gnu"),
    ("lgpl", 1, 0.9, "www gnu org licenses lgpl", "gnu"),
    ("agpl", 1, 0.9, "www gnu org licenses agpl", "gnu"),
    ("mit", 1, 0.9, "opensource org licenses mit", "opensource"),
    ("bsd", 1, 0.9, "opensource org licenses bsd", "opensource"),
    ("cc-by", 1, 0.9, "creativecommons org licenses by", "creativecommons"),
    ("cc-by-sa", 1, 0.95, "creativecommons org licenses by sa", "creativecommons"),
    ("cc-by-nc", 1, 0.95, "creativecommons org licenses by nc", "creativecommons"),
    ("cc-by-nd", 1, 0.95, "creativecommons org licenses by nd", "creativecommons"),
    ("cc-by-nc-sa", 1, 1.0, "creativecommons org licenses by nc sa", "creativecommons"),
    ("cc-by-nc-nd", 1, 1.0, "creativecommons org licenses by nc nd", "creativecommons"),
    ("cc0", 1, 1.0, "creativecommons org publicdomain zero", "creativecommons"),
    ("public-domain", 3, 0.7, "released|placed|dedicated|is in|into|to the public domain", "domain"),
    ("public-domain", 4, 0.4, "public domain", "domain"),
    ("proprietary", 3, 0.7, "all rights reserved", "reserved"),
    ("proprietary", 2, 0.8, "proprietary and confidential", "proprietary"),
    ("proprietary", 2, 0.8, "may not be reproduced ~8 without ~3 permission", "reproduced"),
]

#: Most places of a better or equal priority are looked up by these classes.
PRIORITIES = (0, 1, 2, 3, 4)


def _token(token: str) -> str:
    if token.startswith("~"):
        return f"(?: [^ ]+ ){{0,{token[1:]}}}"
    word = token.rstrip("?")
    one = f" (?:{word}) " if "|" in word else f" {word} "
    return f"(?:{one})?" if token.endswith("?") else one


def expression(words: str) -> str:
    """The regular expression of a rule in the notation above."""
    return "".join(map(_token, words.split()))


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """All rules in order: number, label, priority, weight, expression and keyword."""
    listed = [(label, 0, 1.0, words, key) for words, label, key in BASE] + NOTICES
    for priority, weight, form in FORMS:
        for label, name, key, alone in NAMES:
            if form != "{}" or alone:
                # several names of one word each have no word in common: a rule for each
                for one, by in [(name, key)] if key else [(n, n) for n in name.split("|")]:
                    listed.append((label, priority, weight, form.format(one), by))
    for _, _, _, words, key in listed:
        if key not in words.split():
            raise ValueError(f"the keyword {key!r} must be a fixed word of {words!r}")
    return [(i, label, priority, weight, expression(words), key) for i, (label, priority, weight, words, key) in enumerate(listed)]


def _any_of(words: list[str]) -> str:
    """An expression for any of the words, grouped by their first letter so that a scan gives up early."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (w[0], -len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return " ((?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + ")) "


def stream(text: Column) -> Column:
    """The words of a text, A-Z as a-z, each between two blanks."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count(piece: Column) -> Column:
    """Words in a piece of the stream: each has two blanks."""
    return ((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("int")


def _rule_book(found: list[tuple]) -> Column:
    """Rules by keyword, as a constant map."""
    by: dict[str, list[tuple]] = {}
    for rule in found:
        by.setdefault(rule[5], []).append(rule)
    entries = []
    for key, of_key in by.items():
        entries += [F.lit(key), F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[4]).alias("rx")) for r in of_key])]
    return F.create_map(*entries)


def detections(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` numbered (uid, doc_id, n_words), and every place of every rule: uid, rule, start, end.

    Starts and ends count words from 0, the end lies behind the last. The numbered table is stored.
    """
    book = rules()
    text = docs.select("doc_id", stream(F.col("text")).alias("words"))
    keys = F.array_distinct(F.regexp_extract_all("words", F.lit(_any_of([r[5] for r in book])), F.lit(1)))
    held = F.transform(
        F.flatten(F.transform(keys, lambda k: F.element_at(_rule_book(book), k))),
        lambda r: F.struct(
            r["rule"].alias("rule"),
            F.transform(F.regexp_extract_all("words", r["rx"], F.lit(0)), _count).alias("held"),
            F.transform(F.split("words", r["rx"], -1), _count).alias("before"),
        ),
    )
    places = F.filter(held, lambda h: F.size(h["held"]) > 0)
    rows = text.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", _count(F.col("words")).cast("long").alias("n_words"), places.alias("places")
    )
    rows = stored(rows, "licenses")
    each = rows.select("uid", F.explode("places").alias("p"))
    each = each.select("uid", "p.rule", F.posexplode(F.arrays_zip(F.col("p.before").alias("before"), F.col("p.held").alias("held"))).alias("at", "x"))
    each = each.where("x.held is not null")  # there is one gap more than places
    so_far = Window.partitionBy("uid", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = each.select("uid", "rule", F.sum(F.col("x.before") + F.col("x.held")).over(so_far).alias("end"), "x.held")
    return rows.select("uid", "doc_id", "n_words"), ends.select("uid", "rule", (F.col("end") - F.col("held")).alias("start"), "end")


def survivors(found: DataFrame) -> DataFrame:
    """Detections (uid, rule, start, end) with label, priority, weight and whether they stay (kept)."""
    traits = F.array(*[F.struct(F.lit(r[1]).alias("label"), F.lit(r[2]).alias("priority"), F.lit(r[3]).alias("weight")) for r in rules()])
    found = found.select("*", F.element_at(traits, F.col("rule") + 1).alias("x")).select("uid", "rule", "start", "end", "x.*")
    before = Window.partitionBy("uid").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.array(*[F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in PRIORITIES])
    covered = F.coalesce(F.element_at(reach, F.col("priority") + 1) >= F.col("end"), F.lit(False))
    return found.withColumn("kept", ~covered | (F.col("priority") == 0))


def licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts all places of the phrases of ``BASE``, ``first_word`` and ``last_word`` are their
    smallest and largest start (null: none). ``base_labels`` are their labels, ``labels`` those of all detections that stay, both
    distinct, sorted and joined by commas (none: empty). ``score`` is the largest weight of a detection that stays, 0 without one.

    A null text is empty and has no words; repeated rows give a row each; a null id is kept; other columns are not
    read; no rows give none. A text of any length is scanned as a whole.
    """
    rows, found = detections(docs)
    base, kept = F.col("priority") == 0, F.col("kept")
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    by_row = survivors(found).groupBy("uid").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.max(F.when(kept, F.col("weight"))).alias("score"),
    )
    return rows.join(by_row, "uid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """The same in DuckDB: every rule on every text, and containment by comparing the places of a text."""
    book = ", ".join(f"({i}, '{label}', {p}, {w}::DOUBLE, '{rx}')" for i, label, p, w, rx, _ in rules())
    count = "((length({0}) - length(replace({0}, ' ', ''))) // 2)"
    separators = re.sub(r"\\x(..)", r"\\x{\1}", SEPARATORS)
    return f"""
WITH rules(rule, label, priority, weight, rx) AS (VALUES {book}
), words AS (
  SELECT row_number() OVER () AS uid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{separators}', '  ', 'g'), ' ') AS w FROM documents
), streams AS (
  SELECT uid, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS s FROM words
), hits AS (
  SELECT uid, rule, label, priority, weight, regexp_extract_all(s, rx) AS held, string_split_regex(s, rx) AS before
  FROM streams, rules WHERE regexp_matches(s, rx)
), pieces AS (
  SELECT uid, rule, label, priority, weight, unnest(held) AS h, unnest(before[:len(held)]) AS b, unnest(range(len(held))) AS i FROM hits
), counted AS (
  SELECT uid, rule, label, priority, weight, {count.format("h")} AS n, sum({count.format("h")} + {count.format("b")}) OVER (PARTITION BY uid, rule ORDER BY i) AS e FROM pieces
), places AS (
  SELECT uid, rule, label, priority, weight, (e - n)::BIGINT AS s, e::BIGINT AS e FROM counted
), kept AS (
  SELECT p.* FROM places p WHERE p.priority = 0 OR NOT EXISTS (
    SELECT 1 FROM places o WHERE o.uid = p.uid AND o.s <= p.s AND o.e >= p.e AND o.priority <= p.priority AND o.rule <> p.rule
      AND (o.s < p.s OR o.e > p.e OR o.priority < p.priority OR o.rule < p.rule))
), by_row AS (
  SELECT uid, count(*) FILTER (priority = 0) AS n_base, min(s) FILTER (priority = 0) AS first_word, max(s) FILTER (priority = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (priority = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
  FROM kept GROUP BY uid
)
SELECT doc_id, {count.format("s")}::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM streams LEFT JOIN by_row USING (uid)
"""
