"""Licence scans by sentence rules, all in SQL functions.

1. Text that holds a licence word loses the comment marks at its lines' starts and is cut into sentences: at a blank line, after a dated copyright
   line, and after ``.`` ``;`` ``:`` before white space.  A sentence that isn't known as a whole is
   cut again into its lines, so wrapped notices and bare lines are both met.
2. Sentences are normalised (lower case, every run of other characters than letters
   and digits one blank) and looked up among known licence sentences; a known one
   becomes its identifier, an unknown one with a licence word becomes ``unknown``, others vanish.
   Other wordings of published notices (``VARIANTS``, other subjects, an organisation's name in BSD's third
   clause, SPDX lines) become the identifiers of the same statement.
3. The identifier sequence is matched against ordered rules.  Each rule is a pattern over
   neighbouring identifiers; where it matches, it names a licence and consumes them, so the full
   notice of a licence comes before the bare mention of its name.  "All rights reserved" names a licence
   (``Proprietary``) only where nothing else does: many notices hold it.

BSD's third clause is known for names of up to 1,000 characters.

Defined results: null, empty and licence-free texts give an empty sequence and no
licence; repeated rows repeat; identifiers that no rule consumes count as left over;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Known sentences (normalised) and their identifiers.  Fixed values, from the texts of the licences.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2head",
    "you may not use this file except in compliance with the license": "apachecomply",
    "you may obtain a copy of the license at": "apachecopy",
    "http www apache org licenses license 2 0": "apacheurl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied": "apachewarranty",
    "see the license for the specific language governing permissions and limitations under the license": "apachesee",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement": "mitwarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitliability",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 2": "gpl2",
    "this program is free software": "gplfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gplterms",
    "either version 3 of the license or at your option any later version": "gpl3later",
    "either version 2 of the license or at your option any later version": "gpl2later",
    "licensed under cc by 4 0": "ccby4",
    "licensed under cc by sa 4 0": "ccbysa4",
    "licensed under cc by nc 4 0": "ccbync4",
    "licensed under cc by nd 4 0": "ccbynd4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission": "bsdendorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "all rights reserved": "reserved",
    "https www apache org licenses license 2 0": "apacheurl",
    "this library is free software": "gplfree",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgplterms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agplterms",
    "either version 2 1 of the license or at your option any later version": "gpl21later",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies": "iscgrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies": "iscgrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness": "iscwarranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
    "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
    "this software": "iscliability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zerobsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
    "commercial or non commercial and by any means": "unlicenseuse",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain "
    "worldwide": "cc0",
    "this software is distributed without any warranty": "cc0warranty",
    "licensed under cc0 1 0": "cc0",
    "licensed under the boost software license version 1 0": "bsl1",
    "licensed under the eclipse public license 2 0": "epl2",
    "licensed under the eclipse public license v 2 0": "epl2",
    "licensed under the eclipse public license v2 0": "epl2",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21",
    "licensed under the gnu lesser general public license version 3": "lgpl3",
    "licensed under the gnu affero general public license version 3": "agpl3",
    "licensed under the isc license": "isc",
    "licensed under the zlib license": "zlib",
    "this software is provided as is without any express or implied warranty": "zlibwarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
    "subject to the following restrictions": "zlibgrant",
}
#: Ordered rules: licence and pattern over the sequence ``;id;id;``.
RULES = [
    ("Apache-2.0", ";apache2head;apachecomply;apachecopy;(apacheurl;)?apachewarranty;apachesee;"),
    ("MIT", ";mitgrant;mitnotice;mitwarranty;(mitliability;)?"),
    ("BSD-3-Clause", ";bsdgrant;bsdsource;bsdbinary;bsdendorse;"),
    ("BSD-2-Clause", ";bsdgrant;bsdsource;bsdbinary;"),
    ("GPL-3.0-or-later", ";gplfree;gplterms;gpl3later;"),
    ("GPL-2.0-or-later", ";gplfree;gplterms;gpl2later;"),
    ("LGPL-3.0-or-later", ";gplfree;lgplterms;gpl3later;"),
    ("LGPL-2.1-or-later", ";gplfree;lgplterms;gpl21later;"),
    ("AGPL-3.0-or-later", ";gplfree;agplterms;gpl3later;"),
    ("ISC", ";iscgrant;(iscwarranty;)?(iscliability;)?"),
    ("0BSD", ";zerobsd;(iscwarranty;)?(iscliability;)?"),
    ("Unlicense", ";unlicense;(unlicenseuse;)?(mitwarranty;)?"),
    ("CC0-1.0", ";cc0;(cc0warranty;)?"),
    ("Zlib", ";(zlibwarranty;)?zlibgrant;"),
    ("Apache-2.0", ";(apache2|apache2head);"),
    ("MIT", ";mit;"),
    ("GPL-3.0-only", ";gpl3;"),
    ("GPL-2.0-only", ";gpl2;"),
    ("CC-BY-NC-4.0", ";ccbync4;"),
    ("CC-BY-SA-4.0", ";ccbysa4;"),
    ("CC-BY-ND-4.0", ";ccbynd4;"),
    ("CC-BY-4.0", ";ccby4;"),
    ("MPL-2.0", ";mpl2;"),
    ("LGPL-2.1-only", ";lgpl21;"),
    ("LGPL-3.0-only", ";lgpl3;"),
    ("AGPL-3.0-only", ";agpl3;"),
    ("ISC", ";isc;"),
    ("Zlib", ";zlib;"),
    ("BSL-1.0", ";bsl1;"),
    ("EPL-2.0", ";epl2;"),
    ("Proprietary", ";reserved;"),
]
#: A text without any of these words has no licence sentence; ASCII case is ignored.
GATE = "(?i)licen[sc]|copyright|warrant|redistribut|permission|rights reserved|free software|apache|either version"
#: The same for what the sentences' other forms need: a line break within, SPDX lines.
ALSO = r"(?i)rights[^\p{L}\p{N}]+reserved|spdx-license-identifier|unencumbered software|under cc0"
_GPL = "you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation"
_ENDORSE = "to endorse or promote products derived from this software without specific prior written permission"
#: Other wordings (normalised) of known sentences, and their identifiers, joined by ``;``.
VARIANTS = {
    **{f"{_GPL.format(kind)} either version {v} of the license or at your option any later version": f"{short}gplterms;gpl{v.replace(' ', '')}later"
       for kind, short, v in (("", "", "2"), ("", "", "3"), ("lesser ", "l", "2 1"), ("lesser ", "l", "3"), ("affero ", "a", "3"))},
    **{f"the name of the {who} may not be used {_ENDORSE}": "bsdendorse" for who in ("author", "copyright holder")},
    **{f"{who} may not be used {_ENDORSE}": "bsdendorse" for who in ("the names of its contributors", "the name of the authors", "the names of the authors")},
    **{f"spdx {k}": v for k, v in {
        "mit": "mit", "apache 2 0": "apache2", "mpl 2 0": "mpl2", "cc by 4 0": "ccby4", "cc by sa 4 0": "ccbysa4", "cc by nc 4 0": "ccbync4", "cc by nd 4 0": "ccbynd4",
        "bsd 2 clause": "bsdgrant;bsdsource;bsdbinary", "bsd 3 clause": "bsdgrant;bsdsource;bsdbinary;bsdendorse", "gpl 2 0": "gpl2", "gpl 2 0 only": "gpl2",
        "gpl 3 0": "gpl3", "gpl 3 0 only": "gpl3", "isc": "isc", "unlicense": "unlicense", "cc0 1 0": "cc0", "bsl 1 0": "bsl1", "epl 2 0": "epl2", "zlib": "zlib", "0bsd": "zerobsd",
        "lgpl 2 1": "lgpl21", "lgpl 2 1 only": "lgpl21", "lgpl 3 0": "lgpl3", "lgpl 3 0 only": "lgpl3", "agpl 3 0": "agpl3", "agpl 3 0 only": "agpl3",
        "lgpl 2 1 or later": "gplfree;lgplterms;gpl21later", "lgpl 3 0 or later": "gplfree;lgplterms;gpl3later", "agpl 3 0 or later": "gplfree;agplterms;gpl3later", "gpl 2 0 or later": "gplfree;gplterms;gpl2later", "gpl 3 0 or later": "gplfree;gplterms;gpl3later"}.items()},
}
#: BSD's third clause under any name; the name may hold a full stop, so it is replaced before the text is cut.
NAMED = (r"(?is)\bneither\W+the\W+names?\W+of\W.{1,1000}?\Wnor\W+(?:the\W+)?names?\W+of\W+(?:its|their|any|the)\W+contributors\W+may\W+be\W+used\W+"
         + _ENDORSE.replace(" ", r"\W+"))
HOLDER = f"Neither the name of the copyright holder nor the names of its contributors may be used {_ENDORSE}"
#: Statements of any subject, but no negated or past ones.
NEGATED = r"\b(?:no|not|neither|nor|none|nothing|never|cannot|unless|if|whether|was|were|formerly|previously)\b"
SUBJECT = (r"^(?:.* )?(?:released|licensed|distributed|available|provided) under (?:the terms of )?(?:the )?(.*?)"
           r"(?: (?:see (?:the )?license|which (?:is available|accompanies)).*)?$")
STARTS = ("licensed under the", "licensed under", "this work is licensed under")
FREE = r" is free software$"
#: Marks at a line's start that comments have in many languages.
MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+)[ \t]?"
#: Where sentences end, and what stands for an end afterwards.
ENDS, END = r"([.;:])\s+|((?i:copyright)[^\n]*[0-9]{4}[^\n]*)\n|\n[ \t]*\n\s*", "\x01"
#: Ways to write SPDX lines, one after the other: pattern and replacement ($1 is the first group).
SPDX = [(r"(?i)(spdx-license-identifier:[^\n]*?[0-9])\+", "$1-or-later"), (r"(?i)spdx-license-identifier:[ \t]*([^\n]*)", "\n\nspdx license identifier $1\n\n")]


def _map() -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in (SENTENCES | VARIANTS).items())
    return f"map({pairs})"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _known(n: str) -> str:
    """The identifiers of the normalised sentence or line ``n``, or null."""
    spelled = f"replace({n}, 'licence', 'license')"
    stated = ", ".join(f"known[regexp_replace({spelled}, {_quoted(SUBJECT)}, '{start} $1')]" for start in STARTS)
    names = f"split(replace(substr({n}, 25), ' or later', ' or-later'), ' (?:or|and) ')"
    spdx = f"array_join(transform({names}, e -> coalesce(known[concat('spdx ', replace(e, 'or-later', 'or later'))], 'unknown')), ';')"
    return (f"coalesce(known[{n}], CASE WHEN {n} LIKE 'spdx license identifier %' THEN {spdx} WHEN {n} RLIKE {_quoted(NEGATED)} THEN NULL "
            f"WHEN {n} LIKE '% under %' THEN coalesce({stated}) WHEN {n} RLIKE {_quoted(FREE)} THEN 'gplfree' END)")


def _normal(s: str) -> str:
    return f"trim(regexp_replace(lower({s}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_sentences (known), sequence, licenses (sorted, comma-joined), n_licenses, n_left."""
    t = F.col(f"`{text}`").cast("string")
    named = F.regexp_replace(F.regexp_replace(t, MARKS, "$1"), NAMED, HOLDER)
    for pattern, written in SPDX:       # SPDX lines stand by themselves, with "+" in words
        named = F.regexp_replace(named, pattern, written)
    cut = F.split(F.regexp_replace(named, ENDS, f"$1$2{END}"), END)
    rows = docs.select("doc_id", F.when(t.rlike(GATE) | t.rlike(ALSO), cut).alias("cut"), F.expr(_map()).alias("known"))
    known = lambda x: f"transform(transform({x}, s -> named_struct('s', s, 'n', {_normal('s')})), x -> named_struct('s', x.s, 'k', {_known('x.n')}))"
    unknown = f"if(l.s RLIKE '{GATE}', 'unknown', NULL)"
    lines = known(r"split(y.s, '\\n')")
    ids = (f"flatten(transform(filter(flatten(transform({known('cut')}, y -> if(y.k IS NOT NULL, array(y.k), "
           f"transform({lines}, l -> coalesce(l.k, {unknown}))))), v -> v IS NOT NULL), v -> split(v, ';')))")
    rows = rows.select("doc_id", F.coalesce(F.expr(ids), F.array().cast("array<string>")).alias("ids"))
    rules = "array(" + ", ".join(f"named_struct('name', '{n}', 'rule', '{p}')" for n, p in RULES) + ")"
    start = "named_struct('seq', concat(';', array_join(ids, ';'), ';'), 'found', cast(array() AS array<string>))"
    # twice, as neighbouring matches share a mark
    step = ("(a, r) -> if(a.seq RLIKE r.rule, named_struct('seq', regexp_replace(regexp_replace(a.seq, r.rule, ';'), r.rule, ';'), "
            "'found', array_union(a.found, array(r.name))), a)")
    rows = rows.withColumn("m", F.when(F.size("ids") > 0, F.expr(f"aggregate({rules}, {start}, {step})")))
    left = F.coalesce(F.size(F.expr("filter(split(m.seq, ';'), v -> v <> '')")), F.lit(0))
    found = F.when(F.size("m.found") > 1, F.array_remove("m.found", "Proprietary")).otherwise(F.col("m.found"))
    found = F.coalesce(F.array_sort(found), F.array().cast("array<string>"))
    return rows.select("doc_id", F.size(F.expr("filter(ids, v -> v <> 'unknown')")).cast("long").alias("n_sentences"),
                       F.array_join("ids", ";").alias("sequence"), F.array_join(found, ",").alias("licenses"),
                       F.size(found).cast("long").alias("n_licenses"), F.when(F.size("ids") > 0, left).otherwise(0).cast("long").alias("n_left"))
