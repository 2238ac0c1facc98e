"""License scans by sentence rules: a text's sentences, normalised, are mapped to the names of known licence
sentences, and the sequence of names is matched against ordered licence rules. One pass, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and headers, normalised as normalise() does, and their names.
SENTENCES: dict[str, str] = {
    "this work is licensed under the gnu general public license version 3": "GplWork3",
    "this work is licensed under the gnu general public license version 2": "GplWork2",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4",
    "released under the mit license": "MitReleased",
    "licensed under the mit license": "MitReleased",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "licensed under the apache license version 2 0": "Apache2",
    "licensed under the apache license version 2 0 the license": "Apache2",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2",
    "all rights reserved": "AllRights",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdLiability",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GnuUseful",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GnuUseful",
    "see the gnu general public license for more details": "GnuSee",
    "see the gnu lesser general public license for more details": "GnuSee",
    "see the gnu affero general public license for more details": "GnuSee",
    "you should have received a copy of the gnu general public license along with this program": "GnuCopy",
    "you should have received a copy of the gnu lesser general public license along with this library": "GnuCopy",
    "you should have received a copy of the gnu affero general public license along with this program": "GnuCopy",
    "if not see https www gnu org licenses": "GnuUrl",
    "if not see http www gnu org licenses": "GnuUrl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Later",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscAsIs",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0": "Epl2",
    "this is free and unencumbered software released into the public domain": "UnlicenseFree",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseAnyone",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "ZlibOrigin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MplCopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MplCopy",
    "licensed under cc0 1 0": "Cc0",
    "licensed under the isc license": "IscReleased",
    "licensed under the bsd 2 clause license": "Bsd2Released",
    "licensed under the bsd 3 clause license": "Bsd3Released",
}

# Identifiers that a line "SPDX-License-Identifier: ..." may name.
IDENTIFIERS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", i.lower()): "Spdx " + i for i in IDENTIFIERS}

# In this order, a run of sentence names (a regular expression over "<Name><Name>") and the licence
# that it means. Where a rule fits, its names are taken and later rules don't see them.
_GNU = "(?:<GnuUseful>)?(?:<GnuSee>)?(?:<GnuCopy>)?(?:<GnuUrl>)?"
RULES: list[tuple[str, str]] = [
    ("<MitGrant><MitNotice>(?:<MitAsIs>)?(?:<MitLiability>)?", "MIT"),
    ("<BsdGrant><BsdSource><BsdBinary><BsdEndorse>(?:<BsdAsIs>)?(?:<BsdLiability>)?", "BSD-3-Clause"),
    ("<BsdGrant><BsdSource><BsdBinary>(?:<BsdAsIs>)?(?:<BsdLiability>)?", "BSD-2-Clause"),
    ("<Apache2>(?:<ApacheCompliance>)?(?:<ApacheCopy>)?(?:<ApacheAsIs>)?(?:<ApacheSee>)?", "Apache-2.0"),
    ("<Gpl3Later>" + _GNU, "GPL-3.0-or-later"),
    ("<Gpl2Later>" + _GNU, "GPL-2.0-or-later"),
    ("<Lgpl21Later>" + _GNU, "LGPL-2.1-or-later"),
    ("<Lgpl3Later>" + _GNU, "LGPL-3.0-or-later"),
    ("<Agpl3Later>" + _GNU, "AGPL-3.0-or-later"),
    ("<IscGrant>(?:<IscAsIs>)?(?:<IscLiability>)?", "ISC"),
    ("<ZeroBsdGrant>(?:<IscAsIs>)?(?:<IscLiability>)?", "0BSD"),
    ("<Epl2>", "EPL-2.0"),
    ("<UnlicenseFree>(?:<UnlicenseAnyone>)?", "Unlicense"),
    ("(?:<ZlibAsIs>)?(?:<ZlibLiability>)?<ZlibGrant>(?:<ZlibOrigin>)?(?:<ZlibAltered>)?(?:<ZlibNotice>)?", "Zlib"),
    ("<GplWork3>", "GPL-3.0"),
    ("<GplWork2>", "GPL-2.0"),
    ("<CcByNc4>", "CC-BY-NC-4.0"),
    ("<CcBySa4>", "CC-BY-SA-4.0"),
    ("<CcBy4>", "CC-BY-4.0"),
    ("<Mpl2>(?:<MplCopy>)?", "MPL-2.0"),
    ("<MitReleased>", "MIT"),
    ("<Cc0>", "CC0-1.0"),
    ("<IscReleased>", "ISC"),
    ("<Bsd2Released>", "BSD-2-Clause"),
    ("<Bsd3Released>", "BSD-3-Clause"),
    *[(f"<Spdx {re.escape(i)}>", i) for i in IDENTIFIERS],
    ("<MitGrant>", "MIT-incomplete"),
    ("<BsdGrant>", "BSD-incomplete"),
    ("<AllRights>", "Proprietary"),
]

#: A sentence ends at a line feed, or at . ! ? with white space or the text's end behind it (so not inside 2.0).
SPLIT = r"\n|[.!?]+(?:[ \t\r]+|$)"
#: Where a sentence that is wrapped over lines ends: . ! ? as above, a line feed also behind them, but not behind
#: the "v." of a version (no known sentence has another abbreviation); a line without letters or digits; a colon at
#: a line's end; and before a numbered item. SPLIT cuts at all of these too.
WRAPPED = r"(?<!\b[vV])[.!?]+(?:[ \t\r\n]+|$)|\n[^\p{L}\p{N}\n]*\n|:[ \t\r]*\n|\n(?=[ \t*#/]*[0-9]+[.)][ \t])"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: Column) -> Column:
    """A-Z lower-cased, whatever is no letter or digit of ASCII made one space, trimmed. Other characters
    count as spaces: no known sentence has any."""
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def license_scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``n_sentences`` (with any word), ``n_known``, ``sentence_ids`` (names of the known ones, in
    the text's order, "<Name>" each), ``licenses`` (of the rules that fit, in the rules' order, comma-joined, each
    once), ``unmatched`` (names that no rule took).

    A known sentence is found on a line, over lines with single line feeds, and as a part between semicolons of
    such; a wrapped one must begin and end where SPLIT or WRAPPED cut, or beside a known line. ``n_sentences``
    counts by SPLIT. A null or empty text has no sentences and all results empty. Repeated rows stay; other columns aren't read.
    The tables of sentences and rules are parameters of the plan, not data: a few hundred entries.
    """
    sentences, rules = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    if not sentences:
        raise ValueError("no sentences given")
    known = F.create_map(*[F.lit(x) for kv in sentences.items() for x in kv])
    # Most sentences are longer or shorter than any known one: their length spares the lookup.
    lengths = sorted({len(s) for s in sentences})
    name_of = lambda t: F.when(F.length(t).isin(lengths), known[t])
    # Two control characters mark known lines below; in a text they are made a third, which means nothing.
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\x01\x02", "\x03\x03")
    out = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    count = F.size(F.filter(F.split("_text", SPLIT), lambda s: s.rlike("[A-Za-z0-9]"))).cast("long")
    pieces = F.transform(F.split("_text", WRAPPED), lambda s: F.struct(s.alias("raw"), name_of(normalise(s)).alias("name")))
    out = out.select("_id", count.alias("n_sentences"), pieces.alias("_pieces"))

    def parts_of(raw: Column) -> Column:
        """Names in a piece that is unknown as a whole: of its lines, of what is joined between these, and of parts between semicolons."""
        line = lambda x: F.coalesce(F.concat(F.lit("\x01\x02"), name_of(normalise(x)), F.lit("\x01")), F.concat(x, F.lit(" ")))
        runs = F.split(F.array_join(F.transform(F.split(raw, SPLIT), line), ""), "\x01")
        cut = lambda r: F.transform(F.split(r, ";"), lambda x: name_of(normalise(x)))
        whole = lambda r: F.when(r.startswith("\x02"), F.substring(r, 2, 1000)).otherwise(name_of(normalise(r)))
        found = lambda r: F.element_at(F.transform(F.array(whole(r)), lambda w: F.when(w.isNotNull(), F.array(w)).otherwise(cut(r))), 1)
        return F.flatten(F.transform(runs, found))

    # A piece on one line without semicolons is one sentence of SPLIT: it has no parts.
    each = F.transform("_pieces", lambda p: F.when(p["name"].isNotNull(), F.array(p["name"])).when(p["raw"].rlike("[\\n;]|[vV][.]"), parts_of(p["raw"])).otherwise(F.array().cast("array<string>")))
    out = out.select("_id", "n_sentences", F.filter(F.flatten(each), lambda n: n.isNotNull()).alias("_names"))
    ids = F.concat_ws("", F.transform("_names", lambda n: F.concat(F.lit("<"), n, F.lit(">"))))
    out = out.select("_id", "n_sentences", F.size("_names").cast("long").alias("n_known"), ids.alias("sentence_ids"))
    some = F.col("n_known") > 0
    if not rules:
        return out.select(F.col("_id").alias(id_col), "n_sentences", "n_known", "sentence_ids", F.lit("").alias("licenses"), F.col("sentence_ids").alias("unmatched"))
    # One rule after the other, as a fold: rules written out one within the other would make a plan of their square.
    table = F.array(*[F.struct(F.lit(pattern).alias("pattern"), F.lit(name).alias("name")) for pattern, name in rules])
    zero = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("fits"))
    taken = lambda a, r: F.struct(F.regexp_replace(a["rest"], r["pattern"], F.lit("")).alias("rest"), F.concat(a["fits"], F.array(r["name"])).alias("fits"))
    out = out.withColumn("_x", F.when(some, F.aggregate(table, zero, lambda a, r: F.when(F.rlike(a["rest"], r["pattern"]), taken(a, r)).otherwise(a))))
    return out.select(F.col("_id").alias(id_col), "n_sentences", "n_known", "sentence_ids", F.when(some, F.concat_ws(",", F.array_distinct("_x.fits"))).otherwise("").alias("licenses"), F.when(some, F.col("_x.rest")).otherwise("").alias("unmatched"))


def oracle_sql() -> str:
    """The registered query in DuckDB's SQL, written out by hand for the known sentences that the given tables hold (on
    a line of their own, each a licence by itself): it shares no table with the code above."""
    return """WITH parts AS (SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(coalesce(text, ''), '\\n|[.!?]+(?:[ \\t\\r]+|$)') AS p FROM documents),
    each_one AS (SELECT rid, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM parts),
    normal AS (SELECT rid, pos, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s FROM each_one),
    known(s, name, licence, place) AS (VALUES
      ('licensed under the apache license version 2 0', 'Apache2', 'Apache-2.0', 1),
      ('this work is licensed under the gnu general public license version 3', 'GplWork3', 'GPL-3.0', 2),
      ('this work is licensed under the gnu general public license version 2', 'GplWork2', 'GPL-2.0', 3),
      ('licensed under cc by nc 4 0', 'CcByNc4', 'CC-BY-NC-4.0', 4),
      ('licensed under cc by sa 4 0', 'CcBySa4', 'CC-BY-SA-4.0', 5),
      ('licensed under cc by 4 0', 'CcBy4', 'CC-BY-4.0', 6),
      ('released under the mit license', 'MitReleased', 'MIT', 7),
      ('licensed under the mit license', 'MitReleased', 'MIT', 7),
      ('all rights reserved', 'AllRights', 'Proprietary', 8)),
    found AS (SELECT rid, count(*) FILTER (n.s <> '') AS n_sentences, count(name) AS n_known, coalesce(string_agg('<' || name || '>', '' ORDER BY pos) FILTER (name IS NOT NULL), '') AS sentence_ids FROM normal n LEFT JOIN known k ON n.s = k.s GROUP BY rid),
    named AS (SELECT rid, string_agg(licence, ',' ORDER BY place) AS licenses FROM (SELECT DISTINCT rid, licence, place FROM normal n JOIN known k ON n.s = k.s) GROUP BY rid)
    SELECT doc_id, n_sentences, n_known, sentence_ids, coalesce(licenses, '') AS licenses, '' AS unmatched
    FROM found JOIN parts USING (rid) LEFT JOIN named USING (rid)"""
