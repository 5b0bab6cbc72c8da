"""Licence scans by canonical digest.

A text is brought to a canonical form (lower case, no copyright notices, no punctuation, one spelling of
words that licences spell in several ways, no leading title, one name for whoever holds the rights) and its digest
is joined with those of known licences: a document is reported if the whole of it is a known licence text.

A copyright notice is a line that begins with the sign, with "copyright" and a year, a sign or a holder, or with "(c)" and
a year, or that says "all rights reserved" and no more.  Body text that a line break happens to begin with "copyright"
stays, so a text may be wrapped anywhere; a notice of several lines loses its first line only.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words that count as the same in licence texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "maximise": "maximize", "modelled": "modeled",
    "noncommercial": "non commercial", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "owner": "holder", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
# Words that follow "copyright" in the body of a licence and not in a notice.
BODY_WORDS = ("also and are act as disclaimer disclaimers doctrines for from holder holders if in infringement interest interests is "
              "law laws license licenses licence licences line notice notices of on or owner owners ownership permission protection "
              "resulting statement statements status that this to treaty which under").split()
BODY_PAIRS = r"the[ \t]+(?:library|program|software|work)"
# Applied in this order to the lower-cased text; the second and third take whole lines.
LINES = (
    (rf"(?md)^([^\p{{L}}\p{{N}}\n]*)copyright([^\p{{L}}\p{{N}}\n]*$|[,.\x22”]|[ \t]+(?:{'|'.join(BODY_WORDS)}|{BODY_PAIRS})\b)", "$1bodycopyright$2"),
    (r"(?md)^[^\p{L}\p{N}\n]*(copyright\b|©|\(c\)[^\p{L}\p{N}\n]*[0-9]{4})[^\n]*$", ""),
    (r"(?md)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", ""),
    (r"[^\p{L}\p{N}]+", " "),
    ("bodycopyright", "copyright"),
)
# Applied in this order to words with single spaces between them.
PHRASES = (
    (r"^(the )?(mit license( mit)?|expat license|mit no attribution( license)?|isc license( isc)?|bsd zero clause license|"
     r"zero clause bsd( license)?|((simplified|new|modified|revised) )?bsd( [23] clause)?( simplified| new or revised)? license|"
     r"[23] clause bsd license|zlib license|unlicense) ", ""),
    (r"\b([1234]|[abcd]) (redistributions of|redistributions in|neither the name|the origin of|altered source|this notice may)\b", "$2"),
    (r"\bneither the names? of .{1,100}? nor the names of\b", "neither the name of holder nor the names of"),
    (r"\bprovided by .{1,100}? as is and any\b", "provided by holder as is and any"),
    (r"\bas is and .{1,100}? disclaims? all\b", "as is and holder disclaims all"),
    (r"\bin no event shall .{1,100}? be liable for any\b", "in no event shall holder be liable for any"),
)

# Texts of short public licences, without their copyright lines.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
AUTHOR_DISCLAIMS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
{}
"""
BSD_DISCLAIMS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + AS_IS,
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so.

""" + AS_IS,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

""" + AUTHOR_DISCLAIMS,
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + AUTHOR_DISCLAIMS,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": BSD.format("") + BSD_DISCLAIMS,
    "BSD-3-Clause": BSD.format("""
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
""") + BSD_DISCLAIMS,
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs
and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
# Long licences as published, a file each.
KNOWN |= {path.stem: path.read_text("utf-8") for path in sorted((Path(__file__).parent / "known").glob("*.txt"))}


def canonical(text: Column) -> Column:
    """The canonical form of a text; NULL and texts without letters or digits give an empty text."""
    plain = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, instead in LINES:
        plain = F.regexp_replace(plain, pattern, instead)
    plain = F.btrim(plain)
    spelled = plain
    for word, same in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{word}\b", same)
    same = F.when(plain.rlike(rf"\b({'|'.join(SPELLINGS)})\b"), spelled).otherwise(plain)
    for pattern, instead in PHRASES:
        same = F.regexp_replace(same, pattern, instead)
    return same


def known_licences(spark: SparkSession, texts: dict[str, str] = KNOWN) -> DataFrame:
    """(licence, canonical_sha256) of known texts; of texts with equal canonical forms the least name stands.

    Terms that are published with instructions after them are known with and without these.
    """
    parts = [(name, text[:text.index(END_OF_TERMS) + len(END_OF_TERMS)]) for name, text in texts.items() if END_OF_TERMS in text]
    given = spark.createDataFrame(sorted([*texts.items(), *parts]), "licence string, text string")
    return given.groupBy(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, canonical_sha256, licence): one row per document; ``licence`` is NULL where the text is no known one.

    Repeated rows and NULL ids are scanned like any other; an empty table gives an empty result; other
    columns are not read.
    """
    digests = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(canonical(F.col(f"`{text_col}`")), 256).alias("canonical_sha256"))
    return digests.join(known, "canonical_sha256", "left").select("id", "canonical_sha256", "licence")
