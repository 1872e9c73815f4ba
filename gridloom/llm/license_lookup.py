"""Licence scan by digests of canonical texts, in DataFrame functions only.

A text is made canonical: letters A-Z to lower case, lines that state a copyright out, equivalent spellings to one,
everything but letters and digits to one blank. The SHA-256 of that is looked up among the digests of known licence
texts by a hash join; the known table has a row for each form of a licence (with and without its title or what
follows its terms), fixed in this file and the folder `licenses` or given by the caller.
Besides whole texts, every single line is looked up in the same way, as a short notice is a text of its own.

What happens in each case: null text counts as the empty text; a text without letters or digits has the digest of the
empty text, which is no licence; repeated rows are looked up each for itself; a licence known by several names takes
the one that sorts first; an empty table gives an empty result; a null doc_id is kept; further columns are ignored,
whatever their names. Texts are handled whole.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line that states a copyright (not one that a wrapped text begins with that word): removed with its end. After
#: lower-casing.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*((portions )?copyright[ \t:,]*(\(c\)|©|<|\[|[12][0-9]{3}|by )|(\(c\)|©)[ \t]*[a-z0-9<]|all rights reserved)[^\n]*(\n|$)"
#: Pairs of equivalent spellings, as words of canonical text.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"),
    ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("labour", "labor"),
    ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("recognise", "recognize"),
    ("whilst", "while"), ("wilful", "willful"), ("redistribution s", "redistributions"), ("https", "http"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Name -> text of known public licences and notices.
_SHORT = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software.\n" + _AS_IS),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
     "License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in "
     'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
     "or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
)
#: Titles that stand above the texts that have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Texts in the folder `licenses`, a file each.
FILES = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
#: What follows this in a text is advice on its use, which many copies leave out.
TERMS_END = "END OF TERMS AND CONDITIONS"


def _forms(name: str, text: str) -> list[tuple[str, str]]:
    """(name, text) of each form in which a licence's text is found."""
    terms, end, _ = text.partition(TERMS_END)
    whole = [text, terms + end, terms] if end else [text]
    return [(name, x) for x in (*whole, *(f"{title}\n\n{text}" for title in TITLES.get(name, ())))]


KNOWN = _SHORT + tuple(
    form
    for name, text in (*_SHORT, *((n, resources.files(__package__).joinpath("licenses", f"{n}.txt").read_text("utf-8")) for n in FILES))
    for form in _forms(name, text)
    if form not in _SHORT
)
#: Rows of one text are dealt to so many shares.
SHARES = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but a-z, 0-9 and letters beyond ASCII; dashes and quotation marks are punctuation too.
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+|[\x{A0}\x{A9}\x{AE}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3000}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    # Every word has a blank of its own on either side, so that a word that comes again is found again.
    out = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(out, OTHER, " ")), " +", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """The lower-case hexadecimal SHA-256 of the canonical form. Never null, or a join would compute it twice to see that."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the licences of this file."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in KNOWN])
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license, notices): the digest of the whole text, the licence whose text it is (or null), and
    the licences and notices that single lines of it are, sorted.

    known: (license, text) rows, of any number: texts and lines are joined to them by their digests. Only the lines that
    are known go further, and only digests meet again.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    by_digest = known.select(digest(F.col("text")).alias("digest"), F.col("license")).groupBy("digest").agg(F.min("license").alias("license"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("th"))
    lines = rows.select(F.coalesce(F.sha2("text", 256), F.lit("")).alias("th"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    noted = lines.select("th", digest(F.col("line")).alias("digest")).join(by_digest, "digest")
    noted = noted.groupBy("th").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    # By sorting, as nothing bounds how many texts have such lines. Copies of one text are dealt out by their ids, and what was
    # found in it is there for each share, so that no task gets a whole group of copies.
    whole = whole.join(by_digest, "digest", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)), F.lit(0)).cast("int"))
    noted = noted.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    found = whole.join(noted.hint("merge"), ["th", "share"], "left")
    return found.select("doc_id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
