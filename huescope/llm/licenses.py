"""Licence scan: whole texts whose canonical form is that of a known licence.

Canonical form: A-Z lower-cased; lines that state a copyright ("copyright", "(c)" or the sign, at the line's
start) and "all rights reserved" dropped; punctuation and white space made one space; equivalent
spellings made one. The form's SHA-256 meets the known digests in a hash join. A text that only names
a licence is not one.

Nulls and empty texts have no form and no licence; rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(?:^|\n)[ \t#*/;.-]*(?:copyright|\(c\)|©)[^\n]*"
RESERVED = r"all rights reserved"
MARKS = r"[^a-z0-9\x80-\x{10FFFF}]+"
#: Spellings that licence matching treats alike.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
#: Public licence texts, with and without their titles.
LICENCES = {
    "MIT": ["MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT, "The MIT License\n" + _MIT, _MIT],
    "ISC": [t + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS for t in ("ISC License\n", "")],
    "0BSD": [t + _ISC_GRANT + ".\n" + _AS_IS for t in ("BSD Zero Clause License\n", "Zero-Clause BSD\n", "")],
    "BSD-2-Clause": [t + _BSD_START + _BSD_1 + _BSD_2 + _BSD_END for t in ("BSD 2-Clause License\n", "")],
    "BSD-3-Clause": [t + _BSD_START + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END for t in ("BSD 3-Clause License\n", "")],
}
#: Digests and names of long licences, made by license_digests.py.
DIGESTS = Path(__file__).with_name("license_digests.csv")


def canonical(text: Column) -> Column:
    """The canonical form of a text; null of a null one or one without anything left."""
    form = F.translate(text, UPPER, LOWER)
    form = F.regexp_replace(F.regexp_replace(form, COPYRIGHT, " "), RESERVED, " ")
    form = F.trim(F.regexp_replace(form, MARKS, " "))
    pairs = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    some = f"(?:^| )(?:{'|'.join(SPELLINGS)})(?: |$)"

    def alike(f: Column) -> Column:
        words = F.transform(F.split(f, " "), lambda w: F.coalesce(F.element_at(pairs, w), w))
        return F.when(f.rlike(some), F.array_join(words, " ")).otherwise(f)

    return F.nullif(F.transform(F.array(form), alike)[0], F.lit(""))


def canonical_text(text: str) -> str:
    """canonical() of one string, in Python: for the known texts."""
    import re

    form = re.sub(r"[A-Z]", lambda m: m[0].lower(), text)
    form = re.sub(RESERVED, " ", re.sub(COPYRIGHT, " ", form))
    form = re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", form).strip(" ")
    return " ".join(SPELLINGS.get(w, w) for w in form.split(" "))


def known_digests(licences: dict[str, list[str]] = LICENCES) -> list[tuple[str, str]]:
    """(digest, licence) of each known text; by default also those of DIGESTS."""
    import hashlib

    kept = DIGESTS.read_text().split() if licences is LICENCES else []
    return sorted({(hashlib.sha256(canonical_text(t).encode()).hexdigest(), name) for name, texts in licences.items() for t in texts} | {tuple(x.split(",")) for x in kept})


def known(spark: SparkSession, licences: dict[str, list[str]] = LICENCES) -> DataFrame:
    return spark.createDataFrame(known_digests(licences), "digest string, license string")


def scan(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, digest and license (null where none is known) of each row.

    digests: (digest, license), a row for each digest. A form longer than the longest known one can't match but is
    hashed all the same, so that the digests serve to find copies.
    """
    form = canonical(F.col("text"))
    found = docs.select("doc_id", F.sha2(form, 256).alias("digest"))
    return found.join(digests, "digest", "left").select("doc_id", "digest", "license")
