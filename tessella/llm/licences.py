"""License scans by canonical digest lookup.

A text is brought to a canonical form: ASCII letters in lower case, lines of copyright notices and "all rights
reserved" dropped, equivalent spellings made one, all that is neither letter nor digit one blank. The sha256 of the whole
canonical text is looked up among those of known licences; the same lookup over single lines finds licence notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import file_count, table

#: A lookup table is broadcast up to so many bytes.
BROADCAST = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line whose first letters or digits are a copyright notice: with a year, a sign or a place for one, or nothing but the name.
_COPYRIGHT = r"(^|\n)[^a-z0-9\n©]*(copyright[^\n]*([0-9]{4}|\(c\)|©|[\[<{]y+[\]>}]|[\[<{]year)|copyright by |\(c\)[^\n]*[0-9]{4}|©|all rights reserved)[^\n]*"
#: Equivalent spellings, over the form with single blanks.
SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"\blicence(s|d)?\b", r"license$1"),
    (r"\bsub license\b", "sublicense"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bversion ([0-9])", r"v$1"),
    (r"\bhttps\b", "http"),
)
#: Names of licences in notices.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0", "Apache-2.0"),
    "MIT": ("the MIT License", "MIT License", "MIT"),
    "ISC": ("the ISC License", "ISC License", "ISC"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "BSD-3-Clause"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "GPL-2.0-only", "GPLv2"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "GPL-3.0-only", "GPLv3"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3", "LGPL-3.0-only", "LGPLv3"),
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3", "AGPL-3.0-only", "AGPLv3"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
}
_NOTICES = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Published under {}.", "This work is licensed under {}.", "This file is licensed under {}.", "This software is released under {}.", "This project is licensed under {}.", "Available under {}.", "SPDX-License-Identifier: {}", "License: {}")

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_TERMS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TERMS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Whole licence texts without title and copyright lines.
TEXTS: dict[str, tuple[tuple[str, ...], str]] = {
    "MIT": (("MIT License", "The MIT License", "The MIT License (MIT)"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    "ISC": (("ISC License",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TERMS),
    "0BSD": (("BSD Zero Clause License", "Zero-Clause BSD"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TERMS),
    "BSD-2-Clause": (("BSD 2-Clause License", "The 2-Clause BSD License"), _BSD_HEAD + " " + _BSD_TERMS),
    "BSD-3-Clause": (("BSD 3-Clause License", "The 3-Clause BSD License"), _BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TERMS),
}

#: sha256 of the canonical forms of licences that are too long to stand here, each with what follows its terms and without it.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("890175f2e81dae03626a98e35f6e227b9af3421ef35bfb554592a71ed676eaa9", "a07acaafbbd3efc89d910f8dc1c26425d3f82b06862987646e0b48edb9ca7c27",),
    "GPL-2.0-only": ("d1fa61212ae86f10c1b0ea5c8db2b3512d73899ca35873143cc967722492e2b6", "1e95e2d233ff8561dbfd49ec57a5544482a8cc2f9016994498703cf747ecfce1",),
    "GPL-3.0-only": ("b07aae232fe7102b06aac1554c541500375161e2927ea3c491131d1d067a8bac", "46e99e25e92b66359c6331c636ec7a0dc3b95e7daa4f0ed054dbc24be1a87cd4",),
    "LGPL-2.1-only": ("f8b1d38ac8ea665fe831af3585b7a2308e9b913f9b67be6f8b9716d7bb485690", "148e6979390d985bdd83fe6868101f4c9960e9978dac9c2c3175ea129fdad619",),
    "LGPL-3.0-only": ("b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6",),
    "MPL-2.0": ("50bee64b2a602a124fade3ae9610b3f3c9bce8184489f1c5a76646a64c53f7c5",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.3-only": ("3209be47de58b93782688c7d9082457fdd9dc9f2787c41054ba60a3f37bbb667",),
}


def canonical(text: Column) -> Column:
    """The canonical form. A null text is empty, and so is one without letters and digits."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    t = F.regexp_replace(t, _COPYRIGHT, "$1")
    t = F.btrim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    for pattern, one in SPELLINGS:
        t = F.regexp_replace(t, pattern, one)
    return t


def known(spark: SparkSession) -> DataFrame:
    """(licence, text, notice, digest): texts with and without their titles, digests of longer ones, and notices. A few hundred rows, by rule."""
    return spark.createDataFrame(_known_rows(), "licence string, text string, notice boolean, digest string")


def _known_rows() -> list[tuple[str, str | None, bool, str | None]]:
    whole = [(name, text, False, None) for name, (titles, body) in TEXTS.items() for text in (body, *(f"{t}\n{body}" for t in titles))]
    whole += [(name, None, False, digest) for name, digests in DIGESTS.items() for digest in digests]
    return whole + [(name, n.format(x), True, None) for name, xs in NAMES.items() for x in xs for n in _NOTICES]


def _small(lookup: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """Marked for broadcast if its measured size is within bound; else it is joined as Spark decides."""
    size = lookup.agg(F.sum(F.octet_length("licence") + F.lit(64 + 32))).first()[0] or 0
    return F.broadcast(lookup) if size <= bound else lookup


def scanned(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_sha256 (of the canonical text), licence (null if the whole text is none that is
    known) and notices (licences whose notice is a line of the text, sorted, comma-joined; '' without any).

    licences is the lookup table (licence, text, notice, digest); digest, the canonical text's sha256, counts where text is
    null. Of several licences of one canonical form the least name counts, and empty forms are left out. A null text is
    empty. A very long text is looked up whole, and each of its lines. Repeated rows are judged one by one, null doc_ids like any
    other. An empty table gives no rows. Columns of docs other than doc_id and text, whatever their names, play no part.
    """
    form = canonical(F.col("text"))
    forms = licences.select("licence", "notice", F.when(F.col("text").isNull(), F.col("digest")).when(form != "", F.sha2(form, 256)).alias("digest")).where("digest is not null")
    forms = forms.groupBy("notice", "digest").agg(F.min("licence").alias("licence"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    lines = rows.select("doc_id", "row", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "row", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    found = lines.join(_small(forms.where("notice").select("digest", "licence")), "digest").groupBy("doc_id", "row").agg(F.collect_set("licence").alias("names"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.array_join(F.sort_array("names"), ",").alias("notices"))
    texts = _small(forms.where("not notice").select(F.col("digest").alias("text_sha256"), "licence"))
    whole = rows.select("doc_id", "row", F.sha2(canonical(F.col("text")), 256).alias("text_sha256")).join(texts, "text_sha256", "left")
    return whole.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left").select("doc_id", "text_sha256", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def op8_canonical_digest_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, known(spark)).coalesce(file_count(docs))


def _sql_form(text: str) -> str:
    t = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    t = f"regexp_replace({t}, '{_COPYRIGHT}', '\\1', 'g')"
    t = f"trim(regexp_replace({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ')"
    for pattern, one in SPELLINGS:
        t = f"regexp_replace({t}, '{pattern}', '{one.replace('$1', chr(92) + '1')}', 'g')"
    return t


def op8_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {quoted(b) if b is not None else 'null'}, {str(c).lower()}, {quoted(d) if d else 'null'})" for a, b, c, d in _known_rows())
    return f"""
with known as (select coalesce(digest, sha256({_sql_form('text')})) as digest, notice, min(licence) as licence from (values {values}) k(licence, text, notice, digest) group by all),
docs as (select doc_id, sha256({_sql_form("coalesce(text, '')")}) as text_sha256, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
notices as (
  select doc_id, string_agg(distinct licence, ',' order by licence) as notices
  from (select doc_id, sha256({_sql_form('line')}) as digest from lines) l
  join known on known.digest = l.digest and notice group by doc_id)
select d.doc_id, text_sha256, licence, coalesce(notices, '') as notices
from docs d left join known on known.digest = d.text_sha256 and not notice left join notices n on n.doc_id = d.doc_id"""
