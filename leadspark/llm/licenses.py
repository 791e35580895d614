"""Licence scan by canonical digests: native DataFrame expressions and one hash join.

A text is brought to a canonical form (lower case, copyright lines out, punctuation to spaces, equivalent spellings made one,
white space squeezed), and the SHA-256 of the whole canonical text is joined to the digests of known licences. Licence
statements often stand on a line of their own, so each line is looked up in the same way as a text of its own. The known table is a
fixed list, so its broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm.common import whole_text
from leadspark.operators.keyed import fence

# A copyright line starts with a capitalised "Copyright" and goes on with a sign, a year, a name or a placeholder. In a wrapped licence text a line may start
# with the word as well; there it is in lower case or followed by one of these words, and is first put in lower case.
_IN_TEXT = "HOLDERS?|OWNERS?|NOTICES?|LAWS?|LICENSES?|LICENCES?|PROTECTION|AND|OR|IN|OF|TO|IS|Holders?|Owners?|Notices?|Laws?|Licenses?|Licences?|Protection"
_WORD = r"(?m)^([^\p{L}\p{N}\n]*)(?:COPYRIGHT|Copyright)([ \t]+(?:" + _IN_TEXT + r")\b)"
_COPYRIGHT = (r"(?m)^[^\p{L}\p{N}\n]*((?:COPYRIGHT|Copyright|copyright)[ \t]*(?:\([cC]\)|©|[0-9<\[{])|(?:COPYRIGHT|Copyright)[ \t]+[\p{Lu}\p{Lo}\"']"
              r"|\([cC]\)[ \t]*[0-9<\[{\p{Lu}]|©|(?i:all rights reserved))[^\n]*")
_OTHER = r"[^\p{L}\p{N}\n]+"
SPELLINGS = (  # Fixed values: (variant, canonical form)
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("modelled", "modeled"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
)

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = f"{_BSD_HEAD}\n{_BSD_WARRANTY}"
_BSD_3 = f"{_BSD_HEAD}\n{_BSD_NAMES}\n{_BSD_WARRANTY}"
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _unnumbered(text: str) -> str:
    """The variant whose conditions stand behind bullets, which are no letters."""
    return "\n".join(line[3:] if line[:1].isdigit() else line for line in text.split("\n"))


DIGESTS = (  # Fixed values: (licence, SHA-256 of the canonical whole text), of texts too long to be listed
    ("Apache-2.0", "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847"),
    ("Apache-2.0", "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87"),
    ("Apache-2.0", "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "63bed425f664c96ae38cce61a56cbc66b69b299ec720b59f0f79eca7b324c2b2"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

KNOWN = (  # Fixed values: (licence, text or statement)
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n" + _ISC_GRANT + "\n" + _ISC_WARRANTY),
    ("ISC", _ISC_GRANT + "\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD_GRANT + "\n" + _ISC_WARRANTY),
    ("0BSD", _0BSD_GRANT + "\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", _unnumbered(_BSD_2)),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_3),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", _unnumbered(_BSD_3)),
    ("Unlicense", _UNLICENSE),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, line breaks kept."""
    named = F.regexp_replace(F.regexp_replace(text, _WORD, "$1copyright$2"), _COPYRIGHT, "")
    out = F.regexp_replace(F.lower(named), _OTHER, " ")
    for variant, form in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(form))
    return out


def squeezed(canonical: Column) -> Column:
    """A canonical text on one line."""
    return F.trim(F.regexp_replace(canonical, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license): one row for each different digest."""
    texts = spark.createDataFrame(list(known), "license string, body string").select(
        F.sha2(F.encode(squeezed(canonical_lines(F.col("body"))), "UTF-8"), 256).alias("digest"), "license")
    listed = spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license")
    return texts.unionByName(listed).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_sha256 (of the canonical text), text_license, line_licenses, n_license_lines.

    ``text_license`` is the licence that the whole text is; ``line_licenses`` are those that single lines
    are, sorted and comma-joined (empty where there are none). A null text counts as empty and has the digest of
    the empty text and no licence. Repeated rows and null ids keep their own rows. Other columns are not read. An empty table gives
    an empty result.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known))
    canon = fence(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(whole_text()).alias("canon")))
    units = canon.select("row", "doc_id", F.posexplode(F.concat(F.array(squeezed(F.col("canon"))), F.split("canon", "\n"))).alias("unit", "body"))
    looked = units.select("row", "doc_id", "unit", F.sha2(F.encode(F.trim("body"), "UTF-8"), 256).alias("digest")).join(table, "digest", "left")
    lines = F.when(F.col("unit") > 0, F.col("license"))
    return (looked.filter("unit = 0 OR license IS NOT NULL").groupBy("row", "doc_id")
            .agg(F.max(F.when(F.col("unit") == 0, F.col("digest"))).alias("text_sha256"),
                 F.max(F.when(F.col("unit") == 0, F.col("license"))).alias("text_license"),
                 F.array_join(F.array_sort(F.collect_set(lines)), ",").alias("line_licenses"),
                 F.count(lines).alias("n_license_lines")).drop("row"))


def _sql_canonical(text: str) -> str:
    quoted = _COPYRIGHT.replace("'", "''")
    named = f"regexp_replace(regexp_replace({text}, '{_WORD}', '\\1copyright\\2', 'g'), '{quoted}', '', 'g')"
    out = f"regexp_replace(lower({named}), '{_OTHER}', ' ', 'g')"
    for variant, form in SPELLINGS:
        out = f"replace({out}, '{variant}', '{form}')"
    return out


def _sql_known() -> str:
    return ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in KNOWN)


def _sql_digests() -> str:
    return ", ".join(f"('{digest}', '{name}')" for name, digest in DIGESTS)


def sql() -> str:
    """The scan as DuckDB SQL."""
    squeeze = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    return f"""
WITH k AS (SELECT sha256({squeeze.format(_sql_canonical('body'))}) AS digest, min(license) AS license
           FROM (VALUES {_sql_known()}) v(license, body) GROUP BY 1 UNION ALL SELECT * FROM (VALUES {_sql_digests()}) w(digest, license)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_sql_canonical("coalesce(text, '')")} AS canon FROM documents),
t AS (SELECT row, doc_id, sha256({squeeze.format('canon')}) AS text_sha256 FROM d),
l AS (SELECT row, sha256(trim(unnest(string_split(canon, chr(10))))) AS digest FROM d),
h AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM l JOIN k USING (digest) GROUP BY row)
SELECT t.doc_id, t.text_sha256, k.license AS text_license, coalesce(h.line_licenses, '') AS line_licenses, coalesce(h.n, 0) AS n_license_lines
FROM t LEFT JOIN k ON k.digest = t.text_sha256 LEFT JOIN h ON h.row = t.row
"""
