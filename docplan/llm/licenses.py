"""Licence scans: text segments compared with licence templates by the Dice coefficient of their sets
of word bigrams.

Segments are the lines, the paragraphs (between blank lines) and the whole of a text, in lower case
and cut at everything but letters and digits. A template of b bigrams can reach the threshold t only
with a segment of t / (2 - t) * b to (2 - t) / t * b bigrams: segments no template can match are
never cut into bigrams, and the others meet only templates of fitting size. Nor are segments without
any of the words that every match must have (`telling_words`, taken from the templates). The bigrams of the
remaining segments are joined with those of the templates (a fixed table, broadcast), shared ones
are counted, and the Dice coefficient is 2 * shared / (bigrams + bigrams).

A licence need not be a segment (it has paragraphs, is wrapped, or stands in a line of prose), so every
template is also sought in the windows of a text: all runs of consecutive words, across lines and
paragraphs, of up to (2 - t) / t times the template's bigrams, repeated ones counted. The best window
begins and ends with bigrams of the template, so only those are tried, in rows that hold t / (2 - t)
of its bigrams. All of it is DataFrame and SQL expressions.

Result: for each row and template it reaches, the best segment or window. The SQL knows the segments
only: what windows add or improve is not in it. Null and empty texts have no
segment. Repeated rows are scanned each. An empty table gives an empty result. Columns other than id
and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Licence notices and short licences, as published.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."),
}


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    found = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(found, found[1:])))


def template_rows(templates: dict[str, str], threshold: float) -> list[tuple[str, str, int, float, float]]:
    """bigram, template, its number of bigrams, and the least and greatest fitting segment."""
    out = []
    for name, text in templates.items():
        own = bigrams_of(text)
        out += [(b, name, len(own), len(own) * threshold / (2 - threshold), len(own) * (2 - threshold) / threshold) for b in own]
    return out


def telling_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every segment that reaches the threshold has one.

    Such a segment shares at least t / (2 - t) of a template's bigrams. The longest words of each
    template are taken until fewer bigrams than that are without one of them.
    """
    out: dict[str, None] = {}
    for text in templates.values():
        own = [b.split(" ") for b in bigrams_of(text)]
        chosen: set[str] = set()
        for word in sorted({w for b in own for w in b}, key=lambda w: (-len(w), w)):
            if sum(not chosen & set(b) for b in own) < len(own) * threshold / (2 - threshold):
                break
            chosen.add(word)
        out |= dict.fromkeys(sorted(chosen))
    return list(out)


def window_rows(templates: dict[str, str], threshold: float) -> list[tuple[str, list[str], int, float, int]]:
    """template, its bigrams, their number, the fewest a match shares, and the most bigrams of a window, repeated ones counted."""
    out = []
    for name, text in templates.items():
        own, most = bigrams_of(text), (2 - threshold) / threshold
        out.append((name, own, len(own), len(own) * threshold / (2 - threshold), int((len(re.findall(r"[^\W_]+", text)) - 1) * most)))
    return out


def _found_in_windows(place: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """The best window of each row and template that reach the threshold; nothing is shuffled before that."""
    table = place.sparkSession.createDataFrame(
        window_rows(templates, threshold), "template string, own array<string>, n_template int, needed double, widest int")
    pairs = {b for text in templates.values() for b in bigrams_of(text)}
    # exploding arrays of one keeps the optimizer from computing what they hold once for every use
    once = lambda value: F.explode(F.array(value))
    cut = place.select("place", "doc_id", once(F.expr(f"filter(split(lower(text), r'{NOT_WORD}'), w -> w != '')")).alias("words")).where("size(words) > 1").where(
        F.exists("words", lambda w: w.isin(telling_words(templates, threshold))))
    # a bigram is built only where both of its words are in some template
    marked = cut.select("*", once(F.transform("words", lambda w: w.isin(sorted({w for b in pairs for w in b.split(" ")})))).alias("marks"))
    hits = marked.select("place", "doc_id", "words", once(F.expr(
        "transform(filter(sequence(0, size(words) - 2), i -> marks[i] and marks[i + 1]), i -> struct(i as at, concat(words[i], ' ', words[i + 1]) as bigram))"
    )).alias("hits")).select("*", once(F.expr("array_distinct(hits.bigram)")).alias("held"))
    # most rows hold too few of any template's bigrams
    near = hits.where(f"size(held) >= {min(r[3] for r in window_rows(templates, threshold))}").join(
        F.broadcast(table), F.expr("size(held) >= needed and size(array_intersect(held, own)) >= needed")).select(
        "place", "doc_id", "template", "n_template", "needed", "widest", "words", once(F.filter("hits", lambda h: F.array_contains("own", h["bigram"]))).alias("hits"))
    starts = near.select("*", F.posexplode("hits").alias("k", "start")).select(
        "place", "doc_id", "template", "n_template", "needed", "words", F.col("start.at").alias("begin"),
        once(F.expr("filter(slice(hits, k + 1, widest), h -> h.at < start.at + widest)")).alias("ahead")).where("size(array_distinct(ahead.bigram)) >= needed").select(
        "*", once(F.expr("transform(slice(words, begin + 1, ahead[size(ahead) - 1].at - begin + 1), (w, i) -> concat(w, ' ', words[begin + i + 1]))")).alias("grams"))
    # an end before the needed-th hit cannot match
    ends = starts.select("place", "doc_id", "template", "n_template", "begin", "ahead", "grams", F.explode(F.expr(
        "sequence(cast(ceil(needed) as int), size(ahead))")).alias("last")).select(
        "place", "doc_id", "template", "n_template", F.expr("size(array_distinct(slice(ahead.bigram, 1, last)))").alias("shared"),
        F.expr("size(array_distinct(slice(grams, 1, ahead[last - 1].at - begin + 1)))").alias("n_bigrams"))
    return ends.withColumn("dice", 2.0 * F.col("shared") / (F.col("n_bigrams") + F.col("n_template"))).where(f"dice >= {threshold}")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, template, dice, shared, n_bigrams and n_template of every row and template it reaches."""
    rows = template_rows(templates, threshold)
    table = docs.sparkSession.createDataFrame(rows, "bigram string, template string, n_template int, least double, greatest double")
    # of the words of a segment, repeated bigrams may be many, so only the lower bound holds for words
    fewest, most = min(r[3] for r in rows), max(r[4] for r in rows)
    place = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    segments = place.select("place", "doc_id", F.explode(F.expr(
        r"concat(split(text, '\n'), case when text rlike '\n' then array(text) else array() end, "
        r"case when text rlike '\n[ \t]*\n' then split(text, '\n[ \t]*\n') else array() end)")).alias("segment"))
    # each character belongs to one word at most and each word but the last is followed by another one
    words = segments.where(F.length("segment") >= 2 * fewest + 1).select(
        "place", "doc_id", F.expr(f"filter(split(lower(segment), r'{NOT_WORD}'), w -> w != '')").alias("words")).where(f"size(words) - 1 >= {fewest}").where(
        F.exists("words", lambda w: w.isin(telling_words(templates, threshold))))
    cut = words.select("place", "doc_id", F.xxhash64("words").alias("segment"), F.expr(
        "array_distinct(zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b)))"
    ).alias("bigrams")).where(f"size(bigrams) between {fewest} and {most}")
    met = cut.select("place", "doc_id", "segment", F.size("bigrams").alias("n_bigrams"), F.explode(F.array_distinct("bigrams")).alias("bigram")).join(
        F.broadcast(table), "bigram").where("n_bigrams between least and greatest")
    # equal segments of a row are one: their bigrams are counted once
    counted = met.groupBy("place", "doc_id", "segment", "template", "n_template", "n_bigrams").agg(F.countDistinct("bigram").alias("shared")).withColumn(
        "dice", 2.0 * F.col("shared") / (F.col("n_bigrams") + F.col("n_template"))).where(f"dice >= {threshold}")
    columns = ("place", "doc_id", "template", "dice", "shared", "n_bigrams", "n_template")
    both = counted.select(*columns).unionByName(_found_in_windows(place, templates, threshold).select(*columns))
    best = F.max(F.struct("dice", "shared", "n_bigrams", "n_template")).alias("best")
    return both.groupBy("place", "doc_id", "template").agg(best).select("doc_id", "template", "best.dice", "best.shared", "best.n_bigrams", "best.n_template")


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result over `documents` in SQL: every segment against every template of fitting size."""
    quoted = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in templates.items())
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
with t as (select name, {grams} as b from (select name, list_filter(regexp_split_to_array(lower(body), '{NOT_WORD}'), lambda x: x <> '') as w
           from (values {quoted}) v(name, body))),
seg as (select doc_id, row_number() over () as place, text from documents where text is not null),
parts as (select doc_id, place, unnest(string_split(text, chr(10))) as s from seg
          union all select doc_id, place, text from seg
          union all select doc_id, place, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) from seg),
cut as (select doc_id, place, {grams} as b
        from (select doc_id, place, list_filter(regexp_split_to_array(lower(s), '{NOT_WORD}'), lambda x: x <> '') as w from parts) where len(w) > 1),
pairs as (select doc_id, place, name, len(list_intersect(cut.b, t.b)) as shared, len(cut.b) as n, len(t.b) as m
          from cut join t on len(cut.b) >= len(t.b) * {threshold} / (2 - {threshold}) and len(cut.b) <= len(t.b) * (2 - {threshold}) / {threshold}),
good as (select *, 2.0::double * shared / (n + m) as dice from pairs where 2.0::double * shared / (n + m) >= {threshold})
select doc_id, name as template, dice, shared, n as n_bigrams, m as n_template
from good qualify row_number() over (partition by place, name order by dice desc, shared desc, n desc) = 1
"""
