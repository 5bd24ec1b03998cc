"""Licence scans (2): known licence sentences, then ordered rules over the sequence of their identifiers.

Each text is cut into pieces (at line ends and after ``.``, ``:``, ``!`` or ``?`` before white space), normalised to lower case
letters and digits, so that comment marks vanish and blank lines are no pieces. A sentence is one piece or, where it was
wrapped or has a blank line inside, several pieces that follow each other: at every piece that begins with the first word
of a known sentence, the text from there on is compared with the known sentences of that word, and the longest one that
ends where a piece ends gives the identifier. What is left of a document is its short sequence of identifiers with the
pieces they cover; a rule matches where its identifiers follow each other in order, with at most ``gap`` unknown pieces
between two of them. Of rules that match at one place the longest counts. SQL functions only.

A text's pieces and sequence are held in one row, so memory is bounded by the longest text; the look ahead from a piece
is bounded by the words of the longest known sentence.

Defined results: null text has no sentences; a null ``doc_id`` is a key of its own; repeated rows give repeated
results; two known sentences of the same words count as the one with the smaller number, rules of one length as the
first; an empty table gives an empty table; columns other than the key and the text, of any name, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.columns import let, text_of

# Sentences of public licences and notices, and the rules over them.
SENTENCES = {
    1: "Released under the MIT License.",
    2: "Licensed under the MIT License.",
    3: "This project is licensed under the terms of the MIT license.",
    4: "Licensed under the Apache License, Version 2.0.",
    5: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
       "compliance with the License.",
    6: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    7: "Unless required by applicable law or agreed to in writing, software distributed under the License is "
       "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    8: "See the License for the specific language governing permissions and limitations under the License.",
    9: "This work is licensed under the GNU General Public License, version 3.",
    10: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    11: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    12: "See the GNU General Public License for more details.",
    13: "Licensed under CC BY-NC 4.0.",
    14: "Licensed under CC BY 4.0.",
    15: "Licensed under CC BY-SA 4.0.",
    16: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    17: "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    18: "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    19: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",  # a sentence ends after "v."
    20: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    21: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    22: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    23: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
        "OR OTHER DEALINGS IN THE SOFTWARE.",
    24: "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    25: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    26: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    27: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
    28: "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    29: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    30: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    31: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    32: "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<http://www.gnu.org/licenses/>.",
}
#: (licence, identifiers in order); earlier rules win among rules of one length.
RULES = (
    ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)), ("MIT", (16, 17)),
    ("Apache-2.0", (4,)), ("Apache-2.0", (5,)), ("Apache-2.0", (5, 6)), ("Apache-2.0", (5, 6, 7, 8)),
    ("GPL-3.0", (9,)), ("GPL-3.0-or-later", (10,)), ("GPL-3.0-or-later", (10, 11, 12)),
    ("CC-BY-NC-4.0", (13,)), ("CC-BY-4.0", (14,)), ("CC-BY-SA-4.0", (15,)),
    ("BSD", (18,)), ("MPL-2.0", (19,)), ("CC-BY-4.0", (20,)), ("CC-BY-NC-4.0", (21,)),
    ("MIT", (16, 17, 22)), ("MIT", (16, 17, 22, 23)), ("MIT", (17, 22)), ("MIT", (17, 22, 23)),
    ("BSD-2-Clause", (18, 24, 25)), ("BSD-2-Clause", (18, 24, 25, 27)),
    ("BSD-3-Clause", (18, 24, 25, 26)), ("BSD-3-Clause", (18, 24, 25, 26, 27)),
    ("GPL-3.0-or-later", (10, 11, 12, 28)), ("GPL-3.0-or-later", (10, 11, 12, 32)),
    ("MPL-2.0", (29,)), ("MPL-2.0", (29, 30)), ("ISC", (31,)),
)
#: Pieces end at a line end, and after a full stop, colon, exclamation or question mark that white space follows.
BREAK = r"\n|(?<=[.!?:])[ \t\r]+"


def normalised(text: Column) -> Column:
    """Lower case letters and digits with one blank between words; line breaks stay, one between pieces with a word."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")
    return F.trim(F.regexp_replace(plain, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def known_sentences(documents: DataFrame, sentences: dict[int, str], key: str, text: str) -> DataFrame:
    """(key, mark, at, end, sentence): first and last piece and identifier of the longest known sentence that starts at
    a piece; ``mark`` is a digest of the text."""
    spark = documents.sparkSession
    plain = F.translate(normalised(F.col("words")), "\n", " ")
    table = spark.createDataFrame(list(sentences.items()), "sentence int, words string").select("sentence", plain.alias("words"))
    first_word = F.substring_index("words", " ", 1)
    table = table.where("words != ''").withColumn("head", first_word)
    # One row for the whole table of known sentences, whatever the documents.
    bounds = (table.groupBy("head").agg(F.collect_list("words").alias("words"))
              .agg(F.map_from_entries(F.collect_list(F.struct("head", "words"))).alias("heads"),
                   F.max(F.array_max(F.transform("words", lambda w: F.size(F.split(w, " "))))).alias("reach")))
    # A line break of its own marks every piece; the text goes through two patterns as a whole.
    broken = normalised(F.regexp_replace(text_of(text), BREAK, "\n"))
    pieces = (documents.select(F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("mark"),
                               F.split(broken, "\n", -1).alias("pieces")).join(F.broadcast(bounds)))

    def may_start(piece: Column, i: Column) -> Column:
        two = F.concat(piece, F.lit(" "), F.get(F.col("pieces"), i + 1))
        return F.exists(F.col("heads")[F.substring_index(piece, " ", 1)], lambda words: (words == piece)
                        | F.coalesce(F.startswith(words, two), F.lit(False)))

    starts = F.filter(F.transform("pieces", lambda piece, i: F.when(may_start(piece, i), i)), lambda i: i.isNotNull())

    def ahead_of(i: Column) -> Column:
        """The text from piece ``i`` on; no sentence covers more pieces than it has words."""
        following = F.sequence(i, F.least(i + F.col("reach"), F.size("pieces")) - 1)
        return F.array_join(F.transform(following, lambda k: F.get(F.col("pieces"), k)), "\n")

    ahead = F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), ahead_of(i).alias("text"))))
    met = (F.startswith(F.translate("text", "\n", " "), F.col("words"))
           & F.substring(F.col("text"), F.char_length("words") + 1, F.lit(1)).isin("", "\n"))
    covered = F.size(F.split(F.substring(F.col("text"), F.lit(1), F.char_length("words")), "\n"))
    return (pieces.select("key", "mark", ahead.alias("ahead")).select("key", "mark", "ahead.*")
            .join(F.broadcast(table), (F.substring_index(F.translate("text", "\n", " "), " ", 1) == F.col("head")) & met)
            .select("key", "mark", "at", (F.col("at") + covered - 1).alias("end"), "sentence"))


def _matched(sequence: Column, rules, gap: int) -> Column:
    """Licences in order of place: at each known sentence the longest rule that starts there."""
    ranked = sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), x[0]))

    def starts(ids: tuple[int, ...], i: Column) -> Column:
        met = F.lit(True)
        for k, sentence in enumerate(ids):
            met = met & F.coalesce(F.get(sequence, i + k)["sentence"] == sentence, F.lit(False))
            if k:
                met = met & F.coalesce(
                    F.get(sequence, i + k)["at"] - F.get(sequence, i + k - 1)["end"] <= gap + 1, F.lit(False))
        return met

    def at(i: Column) -> Column:
        choice = F.lit(None).cast("string")
        for _, (licence, ids) in reversed(ranked):
            choice = F.when(starts(ids, i), F.lit(licence)).otherwise(choice)
        return choice

    return F.array_distinct(F.filter(F.transform(
        F.sequence(F.lit(0), F.size(sequence) - 1), at), lambda licence: licence.isNotNull()))


def scan(documents: DataFrame, sentences: dict[int, str] | None = None, rules=RULES, gap: int = 1,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of known sentences, first known sentence's position, licences in order of place."""
    known = known_sentences(documents, SENTENCES if sentences is None else sentences, key, text)
    longest = known.groupBy("key", "mark", "at").agg(F.max(F.struct("end", -F.col("sentence"))).alias("best"))
    # One entry per sentence of a single text, so bounded by that text; repeated rows collapse before.
    found = (longest.groupBy("key", "mark").agg(F.array_sort(F.collect_list(F.struct(
                 "at", F.col("best.end").alias("end"), (-F.col("best.col2")).alias("sentence")))).alias("seq"))
             .select("key", "mark", "seq", let(F.col("seq"), lambda s: _matched(s, rules, gap)).alias("licences")))
    rows = documents.select(F.col(key).alias("id"), F.xxhash64(text_of(text)).alias("text_mark"))
    return (rows.join(found, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_mark") == F.col("mark")), "left")
            .select(F.col("id").alias(key), F.greatest(F.size("seq"), F.lit(0)).cast("long").alias("n_sentences"),
                    F.get("seq", F.lit(0))["at"].cast("long").alias("first_at"),
                    F.coalesce(F.array_join("licences", ","), F.lit("")).alias("licences")))
