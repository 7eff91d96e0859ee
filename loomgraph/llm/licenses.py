"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (lower case, runs of anything but a-z and 0-9 are one blank) and
mapped to the identifier of a known licence sentence: by a map of whole sentences, and for those with parts that vary (names,
titles) by a list of expressions. Ordered rules over the sequence of identifiers then name the licences; a rule consumes what
it matches, so that a longer rule goes before the shorter ones it holds. Sentences may be wrapped over lines, also in comments.
A sentence that puts something under a licence which isn't known is UNKNOWN; the bare word licence is nothing.

Every known sentence holds one of a few anchor words, so texts without an anchor have no known sentence; this
is checked when the module loads and spares their sentences. A null or empty text has no licences. Each row stands
alone: ties, repeated rows and other columns make no difference.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forms(template: str) -> list[str]:
    """All sentences of a template: [a|b|] stands for a, b or nothing."""
    parts = [p[1:-1].split("|") if p[:1] == "[" else [p] for p in re.split(r"(\[[^\]]*\])", template)]
    return [re.sub(" +", " ", "".join(x)).strip() for x in product(*parts)]


#: How a sentence begins that puts something under a licence; it is read as "under".
BEGINS = r"^(this (work|program|software|file|project|library) is )?(released|licen[cs]ed|distributed|available) under (the terms of )?(the )?"
UNDER = "under "
#: Known sentences, normalised: identifier and templates. fixed values: wording of public licences
WHOLE = {
    "ApacheNotice": [UNDER + "apache license version 2 0[ the license|]", UNDER + "apache license 2 0", UNDER + "apache 2 0 license"],
    "ApacheReleased": [UNDER + "apache license"],
    "ApacheTitle": ["apache license[ version 2 0 january 2004| version 2 0]"],
    "ApacheComply": ["you may not use this [file|work|software] except in compliance with the license"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheSee": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitReleased": [UNDER + "mit license"],
    "MitTitle": ["[the |]mit license[ mit|]"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "BsdReleased": [UNDER + "bsd license"],
    "Bsd2Released": [UNDER + "[bsd 2 clause|2 clause bsd|simplified bsd] license"],
    "Bsd3Released": [UNDER + "[bsd 3 clause|3 clause bsd|modified bsd|new bsd] license"],
    "BsdRedistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "IscReleased": [UNDER + "isc license"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "MplNotice": ["this source code form is subject to the terms of the mozilla public license v[ 2 0|]"],
    "MplReleased": [UNDER + "mozilla public license[ version 2 0| v 2 0| 2 0|]"],
    "UnlicenseFree": ["this is free and unencumbered software released into the public domain"],
    "CcZero": [UNDER + "[cc0|creative commons zero|creative commons cc0][ 1 0|][ universal|][ license| licence|]"],
    "Gpl": [UNDER + "gnu general public license"],
    "Lgpl": [UNDER + "gnu lesser general public license"],
    "Agpl": [UNDER + "gnu affero general public license"],
    "AllRights": ["all rights reserved"],
}
#: Versions of the GNU licences: identifier part, name, words, licence prefix.
GNU = [("Gpl", "general public license", "GPL", ("2", "3")), ("Lgpl", "lesser general public license", "LGPL", ("2 1", "3")), ("Agpl", "affero general public license", "AGPL", ("3",))]
#: Identifiers of the SPDX list that are told apart. fixed values
SPDX = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "Unlicense"]
#: Creative Commons variants: marks and their spelled forms.
CC_WORDS = {"Nc": "(nc|non ?commercial)", "Sa": "(sa|share ?alike)", "Nd": "(nd|no ?deriv[a-z]*)"}
CC = [("Nc", "Sa"), ("Nc", "Nd"), ("Nc",), ("Sa",), ("Nd",), ()]


def camel(words: str) -> str:
    return "".join(w.capitalize() for w in re.split("[^A-Za-z0-9]+", words))


#: A sentence's identifier. A number stands for a version, Later for "or any later one".
EXACT: dict[str, str] = {text: name for name, templates in WHOLE.items() for t in templates for text in forms(t)}
for _id, _words, _, _versions in GNU:
    for _v in _versions:
        _n = _v.replace(" ", "")
        EXACT |= {t: f"{_id}{_n}" for v in (_v, f"{_v} 0" if " " not in _v else _v) for t in forms(f"{UNDER}gnu {_words}[ version | v | ]{v}")}
        EXACT |= {t: f"{_id}{_n}Later" for v in (_v, f"{_v} 0" if " " not in _v else _v) for t in forms(f"{UNDER}gnu {_words}[ version | v | ]{v} or [any |]later[ version|]")}
EXACT |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', x.lower())}": f"Spdx{camel(x)}" for x in SPDX}

#: Sentences with parts that vary: identifier and expression for the whole sentence. First hit counts.
SENTENCES = [
    ("ApacheObtain", r"you may obtain a copy of the license at( .*)?"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .*"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind express or implied .*"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties .*"),
    ("BsdSource", r"(1 )?redistributions of source code must retain the above copyright notice .*"),
    ("BsdBinary", r"(2 )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("BsdEndorse", r"(3 )?neither the name of .* may be used to endorse or promote products .*"),
    ("BsdAsIs", r"this software is provided by the (copyright holders and contributors|author|regents and contributors) as is .*"),
    *((f"{i}Free{v.replace(' ', '')}{later}", rf"this (program|library|file|work) is free software you can redistribute it and or modify it under the terms of the gnu {words} as published by the free software foundation {tail}")
      for i, words, _, versions in GNU for v in versions for later, tail in (("Later", rf"either version {v} of the license or at your option any later version"), ("", rf"version {v} of the license( only)?"))),
    *((f"{i}Free", rf"this (program|library|file|work) is free software you can redistribute it and or modify it under the terms of the gnu {words} .*") for i, words, _, _ in GNU),
    *((f"{i}Hope", rf"this (program|library|file|work) is distributed in the hope that it will be useful but without any warranty .*gnu {words} .*") for i, words, _, _ in GNU[1:]),
    ("GplHope", r"this (program|library|file|work) is distributed in the hope that it will be useful but without any warranty.*"),
    *((f"{i}Received", rf"you should have received a copy of the gnu {words}.*") for i, words, _, _ in GNU),
    *((f"CcBy{''.join(marks)}", r"(.* )?under (a |the )?(cc by|creative commons attribution)" + "".join(" " + CC_WORDS[m] for m in marks) + r"( [1-4] [05])?( international| unported| generic)?( public)?( licen[cs]e)?( .*)?") for marks in CC),
    ("Spdx", r"spdx license identifier .*"),
    ("Copyright", r"(portions )?copyright( c)? .*"),
    ("OtherLicence", r"(under|.* (licen[cs]ed|released|distributed|available) under) (a |an |the )?(.* )?licen[cs]e.*"),
]

#: Ordered rules over ",Id,Id,": licence and expression.
RULES = [
    ("Apache-2.0", r",(ApacheTitle,)?ApacheNotice(,ApacheComply)?(,ApacheObtain)?(,ApacheAsIs)?(,ApacheSee)?,"),
    ("Apache-2.0", r",(ApacheReleased|ApacheTitle|SpdxApache20),"),
    ("MIT", r",(MitTitle,)?(Copyright,)*(AllRights,)?MitGrant(,MitNotice)?(,MitAsIs)?,"),
    ("MIT", r",(MitReleased|MitTitle|SpdxMit),"),
    ("ISC", r",IscGrant(,IscAsIs)?,"),
    ("ISC", r",(IscReleased|SpdxIsc),"),
    ("BSD-3-Clause", r",BsdRedistribution,BsdSource,BsdBinary,BsdEndorse(,BsdAsIs)?,"),
    ("BSD-2-Clause", r",BsdRedistribution,BsdSource,BsdBinary(,BsdAsIs)?,"),
    ("BSD-3-Clause", r",(Bsd3Released|SpdxBsd3Clause),"),
    ("BSD-2-Clause", r",(Bsd2Released|SpdxBsd2Clause),"),
    ("BSD", r",BsdReleased,"),
    *((f"{name}-{v.replace(' ', '.') if ' ' in v else v + '.0'}{'-or-later' if later else ''}", rf",({i}Free{v.replace(' ', '')}{later}(,{i}Hope|,GplHope)?(,{i}Received)?|{i}{v.replace(' ', '')}{later}|Spdx{camel(name)}{v.replace(' ', '') if ' ' in v else v + '0'}{'OrLater' if later else '(Only)?'}),")
      for i, _, name, versions in GNU for v in versions for later in ("Later", "")),
    *((name, rf",({i}Free(,{i}Hope|,GplHope)?(,{i}Received)?|{i}),") for i, _, name, _ in GNU),
    ("MPL-2.0", r",(MplNotice|MplReleased|SpdxMpl20),"),
    ("Unlicense", r",(UnlicenseFree|SpdxUnlicense),"),
    *(("CC-BY" + "".join(f"-{m.upper()}" for m in marks), rf",(CcBy{''.join(marks)}|SpdxCcBy{''.join(marks)}40),") for marks in CC),
    ("CC0", r",(CcZero|SpdxCc010),"),
    ("UNKNOWN", r",(OtherLicence|Spdx),"),
]

#: One of these is in every known sentence.
ANCHORS = ["licen", "copyright", "permission", "redistribut", "warrant", "provided", "endorse", "reserved", "under cc", "creative commons", "unencumbered"]
for _id, _sentence in [*((n, t) for t, n in EXACT.items()), *SENTENCES]:
    assert any(a in _sentence or a == "licen" and "licen[cs]" in _sentence for a in ANCHORS) or "cc0" in _sentence, (_id, _sentence)
ANCHOR = "(?i)" + "|".join([*ANCHORS, "cc0"])
#: Ends of lines and sentences.
ENDS = r"[.!?]+[ \t\r]+|[.!?]*[ \t\r]*\n+"
#: Ends of sentences that may be wrapped: each is an end by ENDS too. Blank lines of comments count as blank.
PARTS = r"[.!?]+[ \t\r\n]+|:[ \t\r]*\n|\n[ \t\r*#/]*\n|\n(?=[ \t]*(?:-|\(?[0-9a-z]{1,2}[).])[ \t])"
#: A wrapped sentence starts where its part does, or at a line that starts like a known sentence.
STARTS = "^(?:" + "|".join(sorted({t.split()[0] for t in EXACT} | {"released", "licensed", "distributed", "available", "you", "permission", "the", "redistributions", "neither", "this", "portions", "copyright", "licenced"})) + r")\b"


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), BEGINS, UNDER)


def identifier(sentence: Column) -> Column:
    """The known sentence's identifier, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    known = F.map_from_arrays(F.split(F.lit("|".join(EXACT)), "[|]"), F.split(F.lit("|".join(EXACT.values())), "[|]"))
    return F.coalesce(F.try_element_at(known, sentence), out)


def part_ids(part: Column) -> Column:
    """Identifiers of a part: of its lines, up to one from which all that is left is a known sentence, wrapped.

    Lines and what is left from a line on are identified in one go, so the plan holds the expressions once.
    """
    lines = F.split(part, ENDS, -1)
    n = F.size(lines)

    def rest_from(k: Column) -> Column:
        first = (k < n) & ((k == 1) | normalised(F.element_at(lines, k)).rlike(STARTS))
        return F.when(first, F.array_join(F.slice(lines, k, n), " "))

    texts = F.concat(lines, F.transform(F.sequence(F.lit(1), n), rest_from))
    found = F.transform(texts, lambda s: F.when(s.rlike(ANCHOR), identifier(normalised(s))))

    def known(x: Column) -> Column:
        return F.coalesce(x != "OtherLicence", F.lit(False))

    def step(done: Column, k: Column) -> Column:
        ids = done["found"]
        half = (F.size(ids) / 2).cast("int")
        alone, rest = F.element_at(ids, k), F.element_at(ids, half + k)
        taken = ~known(alone) & known(rest)
        more = F.struct(ids.alias("found"), F.concat(done["ids"], F.array(F.when(taken, rest).otherwise(alone))).alias("ids"), taken.alias("over"))
        return F.when(done["over"], done).otherwise(more)

    start = F.struct(found.alias("found"), F.array().cast("array<string>").alias("ids"), F.lit(False).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda done: done["ids"])


def recognise(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses), both arrays in the text's order and the rules' order."""
    anchored = F.coalesce(F.col("text").rlike(ANCHOR), F.lit(False))
    parts = F.filter(F.split("text", PARTS, -1), lambda s: s.rlike(ANCHOR))
    ids = F.filter(F.flatten(F.transform(parts, part_ids)), lambda x: x.isNotNull())
    df = docs.select("doc_id", F.when(anchored, ids).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    # each identifier has its own commas, so that rules that follow each other both match
    text = F.when(F.size("sentence_ids") > 0, F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))).otherwise(F.lit(""))
    df = df.withColumn("left", text)
    names = []
    for k, (name, pattern) in enumerate(RULES):
        df = df.withColumn(f"r{k}", F.when(F.col("left").rlike(pattern), F.lit(name)))
        df = df.withColumn("left", F.when(F.col(f"r{k}").isNotNull(), F.regexp_replace("left", pattern, ",")).otherwise(F.col("left")))
        names.append(F.col(f"r{k}"))
    return df.select("doc_id", "sentence_ids", F.array_distinct(F.array_compact(F.array(*names))).alias("licenses"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def oracle() -> str:
    """The same rows in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    case = f"WHEN map_contains(known, s) THEN map_extract_value(known, s) " + " ".join(f"WHEN regexp_matches(s, {q(f'^(?:{p})$')}) THEN {q(n)}" for n, p in SENTENCES)
    known = f"MAP {{{', '.join(f'{q(t)}: {q(n)}' for t, n in EXACT.items())}}}"
    steps, last = [], "seq"
    for k, (_, pattern) in enumerate(RULES):
        steps.append(f"s{k} AS (SELECT *, regexp_matches(l{k}, {q(pattern)}) AS r{k}, regexp_replace(l{k}, {q(pattern)}, ',', 'g') AS l{k + 1} FROM {last})")
        last = f"s{k}"
    names = ", ".join(f"CASE WHEN r{k} THEN {q(n)} END" for k, (n, _) in enumerate(RULES))
    firsts = "list_filter(names, lambda x, i: x IS NOT NULL AND list_position(names, x) = i)"
    return f"""
WITH ids AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {q(ANCHOR)}) THEN
    list_filter(list_transform(list_filter(regexp_split_to_array(text, {q(ENDS)}), lambda x: regexp_matches(x, {q(ANCHOR)})),
      lambda y: list_extract(list_transform([regexp_replace(trim(regexp_replace(lower(y), '[^a-z0-9]+', ' ', 'g')), {q(BEGINS)}, '{UNDER}')], lambda s: CASE {case} END), 1)), lambda z: z IS NOT NULL)
    ELSE [] END AS ids FROM documents, (SELECT {known} AS known)),
seq AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',') || ',' ELSE '' END AS l0 FROM ids),
{", ".join(steps)},
named AS (SELECT doc_id, ids, [{names}] AS names FROM {last})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string({firsts}, ',') AS licenses FROM named"""


def recognise_in_python(text: str | None) -> tuple[list[str], list[str]]:
    """The same identifiers and licences, for tests."""
    ids = []
    plain = lambda s: re.sub(BEGINS, UNDER, re.sub("[^a-z0-9]+", " ", s.lower()).strip(" "))
    one = lambda s: EXACT.get(plain(s)) or next((n for n, p in SENTENCES if re.fullmatch(p, plain(s))), None)
    for part in re.split(PARTS, text or ""):
        lines = re.split(ENDS, part)
        for k, line in enumerate(lines):
            hit = one(line)
            if hit in (None, "OtherLicence") and k + 1 < len(lines) and (k == 0 or re.search(STARTS, plain(line))):
                rest = one(" ".join(lines[k:]))
                if rest not in (None, "OtherLicence"):
                    ids.append(rest)
                    break
            if hit:
                ids.append(hit)
    left, names = "," + ",".join(ids) + "," if ids else "", []
    for name, pattern in RULES:
        if re.search(pattern, left):
            names.append(name)
            left = re.sub(pattern, ",", left)
    return ids, list(dict.fromkeys(names))
