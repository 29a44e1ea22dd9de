"""License scans: ordered signature rules over whole texts.

``RULES`` are regexes in four tiers (identifier tags; notices that license something and sentences of licenses' own texts; names;
generic mentions), each with a keyword that must be in the text before its regex is tried. Rules of a family share its spellings. Detections overlap; going by priority, then length,
one that lies within an accepted detection is dropped. Beside the rules, ``PHRASES`` are found word by word, wherever they
stand, and never suppressed.

Words and phrases are found on the UTF-8 bytes of a batch, which is scanned as a whole; the keywords of a text are found in one pass
over it, and only rules with one of these are tried.

Defined results: a null text is an empty one; a text without words has n_words 0 and no places; each row gives a row, repeated
rows too; an empty table gives no rows; further columns can be kept by name, but for those that have the name of a new one, which raise an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, refuse_clashes

#: Fixed values of the contract: a phrase's words and its label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SEP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
WORD_BYTE = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

# Families: label | identifiers (regex) | names (regex) | the keyword that a name always holds. Texts are lower case; a
# blank in a regex stands for any white space.
FAMILIES = r"""
agpl-3.0 | agpl-3\.0(?:-only|-or-later)? | (?:gnu )?affero general public licen[sc]e(?:,? (?:version |v\.? ?)?3(?:\.0)?)? | affero
gpl-1.0 | gpl-1\.0(?:-only|-or-later)? | gnu general public licen[sc]e,? (?:version |v\.? ?)1(?:\.0)? | general public
gpl-2.0 | gpl-2\.0(?:-only|-or-later)?|gplv2 | gnu general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)? | general public
gpl-3.0 | gpl-3\.0(?:-only|-or-later)?|gplv3 | gnu general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)? | general public
lgpl-2.0 | lgpl-2\.0(?:-only|-or-later)? | gnu library general public licen[sc]e(?:,? (?:version |v\.? ?)2(?:\.0)?)? | library general
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later)?|lgplv2\.1 | gnu lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1 | lesser general
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later)?|lgplv3 | gnu lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)? | lesser general
gfdl-1.3 | gfdl-1\.[1-3](?:-only|-or-later)? | gnu free documentation licen[sc]e(?:,? (?:version |v\.? ?)1\.[1-3])? | free documentation
apache-1.0 | apache-1\.0 | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)1\.0 | apache
apache-1.1 | apache-1\.1 | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)1\.1 | apache
apache-2.0 | apache-2\.0|asl ?2\.0 | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)? | apache
mit-license | mit | (?:the )?(?:mit|expat) licen[sc]e | mit licen;expat licen
mit-0 | mit-0 | mit no attribution licen[sc]e | no attribution
x11 | x11 | (?:the )?x11 licen[sc]e | x11
isc | isc | (?:the )?isc licen[sc]e | isc licen
bsd-2-clause | bsd-2-clause | (?:simplified|freebsd|2-clause|two-clause) bsd licen[sc]e|bsd (?:2|two)[- ]clause(?: licen[sc]e)? | bsd
bsd-3-clause | bsd-3-clause | (?:new|revised|modified|3-clause|three-clause) bsd licen[sc]e|bsd (?:3|three)[- ]clause(?: licen[sc]e)? | bsd
bsd-4-clause | bsd-4-clause | (?:original|4-clause|four-clause) bsd licen[sc]e|bsd (?:4|four)[- ]clause(?: licen[sc]e)? | bsd
0bsd | 0bsd | (?:zero[- ]clause bsd|bsd zero[- ]clause) licen[sc]e | bsd
mpl-1.0 | mpl-1\.0 | mozilla public licen[sc]e,? (?:version |v\.? ?)1\.0 | mozilla
mpl-1.1 | mpl-1\.1 | mozilla public licen[sc]e,? (?:version |v\.? ?)1\.1 | mozilla
mpl-2.0 | mpl-2\.0 | mozilla public licen[sc]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)? | mozilla
epl-1.0 | epl-1\.0 | eclipse public licen[sc]e,? (?:version |v\.? ?|- v ?)1\.0 | eclipse
epl-2.0 | epl-2\.0 | eclipse public licen[sc]e(?:,? (?:version |v\.? ?|- v ?)2\.0)? | eclipse
edl-1.0 | edl-1\.0 | eclipse distribution licen[sc]e(?:,? (?:version |v\.? ?|- v ?)1\.0)? | eclipse
cddl-1.0 | cddl-1\.0 | common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)? | common development
cddl-1.1 | cddl-1\.1 | common development and distribution licen[sc]e,? (?:version |v\.? ?)?1\.1 | common development
cpl-1.0 | cpl-1\.0 | common public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)? | common public
cpal-1.0 | cpal-1\.0 | common public attribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)? | public attribution
eupl-1.1 | eupl-1\.1 | european union public licen[sc]e,? (?:version |v\.? ?)?1\.1 | european union
eupl-1.2 | eupl-1\.2 | european union public licen[sc]e(?:,? (?:version |v\.? ?)?1\.2)? | european union
artistic-1.0 | artistic-1\.0(?:-perl|-cl8)? | artistic licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)? | artistic
artistic-2.0 | artistic-2\.0 | artistic licen[sc]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)? | artistic
bsl-1.0 | bsl-1\.0 | boost software licen[sc]e(?:,? (?:- )?(?:version |v\.? ?)?1\.0)? | boost
busl-1.1 | busl-1\.1 | business source licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)? | business source
zlib | zlib | (?:the )?zlib(?:/libpng)? licen[sc]e | zlib
libpng | libpng(?:-2\.0)? | (?:the )?(?:png|libpng) licen[sc]e | png licen
unlicense | unlicense | the unlicense|this is free and unencumbered software released into the public domain | unlicense;unencumbered
wtfpl | wtfpl | do what the f\w* you want to public licen[sc]e | do what the
postgresql | postgresql | (?:the )?postgresql licen[sc]e | postgresql
python-2.0 | python-2\.0(?:\.1)?|psf-2\.0 | python software foundation licen[sc]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)? | python
php-3.01 | php-3\.0[01]? | (?:the )?php licen[sc]e(?:,? (?:version |v\.? ?)?3\.0[01]?)? | php licen
ruby | ruby | (?:the )?ruby licen[sc]e | ruby licen
ncsa | ncsa | (?:university of illinois/)?ncsa open source licen[sc]e | ncsa
openssl | openssl | (?:the )?openssl licen[sc]e | openssl
vim | vim | (?:the )?vim licen[sc]e | vim licen
w3c | w3c(?:-20150513)? | w3c software(?: notice)?(?: and)?(?: document)? licen[sc]e | w3c
ms-pl | ms-pl | microsoft public licen[sc]e | microsoft
ms-rl | ms-rl | microsoft reciprocal licen[sc]e | microsoft
osl-3.0 | osl-3\.0 | open software licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)? | open software
afl-3.0 | afl-3\.0 | academic free licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)? | academic free
ecl-2.0 | ecl-2\.0 | educational community licen[sc]e(?:,? (?:version |v\.? ?)?2\.0)? | educational community
upl-1.0 | upl-1\.0 | universal permissive licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)? | universal permissive
ofl-1.1 | ofl-1\.1(?:-rfn|-no-rfn)? | (?:sil )?open font licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)? | open font
odbl-1.0 | odbl-1\.0 | open (?:data commons open )?database licen[sc]e(?: \(?odbl\)?)?(?: v?1\.0)? | database licen
odc-by-1.0 | odc-by-1\.0 | open data commons attribution licen[sc]e(?: v?1\.0)? | data commons
pddl-1.0 | pddl-1\.0 | (?:open data commons )?public domain dedication (?:and|&) licen[sc]e | dedication
etalab-2.0 | etalab-2\.0 | licence ouverte(?:/open licence)?(?:,? (?:version |v\.? ?)?2\.0)? | ouverte
ogl-3.0 | ogl-uk-3\.0 | open government licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)? | open government
cecill-2.1 | cecill-2\.[01] | (?:licence )?cecill(?:,? (?:version |v\.? ?)?2\.[01])? | cecill
mulan-2.0 | mulanpsl-2\.0 | mulan permissive software licen[sc]e(?:,? (?:version |v\.? ?)?2)? | mulan
blueoak-1.0.0 | blueoak-1\.0\.0 | blue oak model licen[sc]e(?: 1\.0\.0)? | blue oak
sspl-1.0 | sspl-1\.0 | server side public licen[sc]e(?:,? (?:version |v\.? ?)?1)? | server side
elastic-2.0 | elastic-2\.0 | elastic licen[sc]e(?:,? (?:version |v\.? ?)?2\.0)? | elastic
polyform-nc-1.0.0 | polyform-noncommercial-1\.0\.0 | polyform noncommercial licen[sc]e(?: 1\.0\.0)? | polyform
llama | llama[23](?:\.\d)? | llama [234](?:\.\d)? community licen[sc]e(?: agreement)? | llama
openrail | (?:bigscience-|creativeml-)?openrail(?:-m|\+\+)? | (?:creativeml |bigscience )?open rail-?m? licen[sc]e | open rail
""".strip()

CC_PARTS = {"by": "attribution", "by-sa": "attribution[- ]share[- ]?alike", "by-nd": "attribution[- ]no[- ]?deriv(?:ative)?s?", "by-nc": "attribution[- ]non-?commercial", "by-nc-sa": "attribution[- ]non-?commercial[- ]share[- ]?alike", "by-nc-nd": "attribution[- ]non-?commercial[- ]no[- ]?deriv(?:ative)?s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# label | regex | keyword | score: sentences by which a license's own text or its usual notice is known
TEXTS = r"""
gpl-2.0 | you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation;? (?:either )?version 2 | redistribute | 0.95
gpl-3.0 | you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[,;] either version 3 | redistribute | 0.95
gpl-3.0 | the gnu general public license is a free, copyleft license for software and other kinds of works | copyleft | 0.9
gpl-2.0 | the licenses for most software are designed to take away your freedom to share and change it | freedom | 0.9
lgpl-2.1 | under the terms of the gnu lesser general public license as published by the free software foundation;? either version 2\.1 | lesser | 0.95
lgpl-3.0 | under the terms of the gnu lesser general public license as published by the free software foundation[,;] either version 3 | lesser | 0.95
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 | incorporates | 0.9
agpl-3.0 | under the terms of the gnu affero general public license as published by the free software foundation | affero | 0.95
agpl-3.0 | if the program is modified, your modified version must prominently offer all users interacting with it remotely | remotely | 0.9
gfdl-1.3 | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license | documentation | 0.95
gfdl-1.3 | with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts | invariant | 0.8
apache-2.0 | licensed under the apache license, version 2\.0 \(the ["“]license["”]\) | apache | 0.95
apache-2.0 | you may not use this file except in compliance with the license | compliance | 0.85
apache-2.0 | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license | perpetual | 0.9
apache-1.1 | this product includes software developed by the apache software foundation | apache | 0.85
mit-license | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files | obtaining | 0.9
mit-license | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | substantial | 0.9
mit-0 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the ["“]software["”]\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided | obtaining | 0.9
x11 | except as contained in this notice, the name of the x consortium shall not be used in advertising | consortium | 0.9
isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted | without fee | 0.9
0bsd | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided | without fee | 0.9
bsd-2-clause | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer | redistributions | 0.8
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation | redistributions | 0.8
bsd-3-clause | neither the name of .{1,80}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products | endorse | 0.9
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | advertising | 0.9
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1\.1 | mozilla | 0.95
mpl-2.0 | this source code form is subject to the terms of the mozilla public license,? v\. 2\.0 | source code form | 0.95
mpl-2.0 | if a copy of the mpl was not distributed with this file, you can obtain one at | copy of the mpl | 0.9
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0 | accompanying | 0.95
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. )?2\.0 | accompanying | 0.95
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license | common development | 0.95
cpl-1.0 | the accompanying program is provided under the terms of this common public license | common public | 0.9
eupl-1.2 | licensed under the eupl,? (?:version )?1\.2 or -? ?as soon they will be approved | eupl | 0.95
eupl-1.1 | licensed under the eupl,? (?:version )?1\.1 | eupl | 0.9
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied | intent of this | 0.9
artistic-2.0 | this license establishes the terms under which a given free software package may be copied, modified, distributed | establishes | 0.9
bsl-1.0 | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license | covered by this | 0.9
busl-1.1 | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work | non-production | 0.9
zlib | this software is provided ['"‘“]as-is['"’”], without any express or implied warranty\. in no event will the authors be held liable | as-is | 0.9
zlib | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software | misrepresented | 0.9
libpng | the png reference library is supplied ["“]as is["”] | png | 0.9
unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software | compile | 0.9
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed | verbatim | 0.9
postgresql | in no event shall the university of california be liable to any party for direct, indirect, special, incidental, or consequential damages | university of california | 0.8
python-2.0 | this license agreement is between the python software foundation \(["“]psf["”]\), and the individual or organization | python software | 0.9
php-3.01 | this product includes php software, freely available from | php software | 0.9
ruby | you may make and give away verbatim copies of the source form of the software without restriction | verbatim | 0.8
ncsa | permission is hereby granted, free of charge, to any person obtaining a copy of this software .{0,80}to deal with the software without restriction | deal with the software | 0.85
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | openssl | 0.9
vim | there are no restrictions on distributing unmodified copies of vim | copies of vim | 0.9
w3c | permission to copy, modify, and distribute this software and its documentation, with or without modification, for any purpose and without fee or royalty | royalty | 0.85
ms-pl | this license governs use of the accompanying software\. if you use the software, you accept this license | governs use | 0.8
osl-3.0 | licensed under the open software license version 3\.0 | open software | 0.95
afl-3.0 | licensed under the academic free license version 3\.0 | academic free | 0.95
ecl-2.0 | licensed under the educational community license, version 2\.0 | educational community | 0.95
upl-1.0 | subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data | set forth below | 0.85
ofl-1.1 | this font software is licensed under the sil open font license | font software | 0.95
ofl-1.1 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself | typefaces | 0.9
odbl-1.0 | is made available under the open database license | open database | 0.9
odbl-1.0 | any rights in individual contents of the database are licensed under the database contents license | database contents | 0.9
pddl-1.0 | is made available under the public domain dedication and license | dedication | 0.9
cc0-1.0 | to the extent possible under law, .{1,120}? has waived all copyright and related or neighboring rights | neighboring | 0.9
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain | associated a work | 0.9
cc-by-unversioned | you are free to share .{1,60}copy and redistribute the material in any medium or format | redistribute the material | 0.6
cc-by-unversioned | you must give appropriate credit, provide a link to the license, and indicate if changes were made | appropriate credit | 0.6
cc-by-nc-unversioned | you may not use the material for commercial purposes | commercial | 0.6
cc-by-sa-unversioned | if you remix, transform, or build upon the material, you must distribute your contributions under the same license | build upon | 0.6
cc-by-nd-unversioned | if you remix, transform, or build upon the material, you may not distribute the modified material | build upon | 0.6
ogl-3.0 | contains public sector information licensed under the open government licence v3\.0 | public sector | 0.95
etalab-2.0 | mis à disposition sous (?:la )?licence ouverte | ouverte | 0.9
cecill-2.1 | ce logiciel est régi par la licence cecill | cecill | 0.95
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service | as a service | 0.9
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service | managed service | 0.85
polyform-nc-1.0.0 | any noncommercial purpose is a permitted purpose | noncommercial | 0.9
llama | is licensed under the llama [234](?:\.\d)? community license,? copyright | llama | 0.95
openrail | you agree not to use the model or derivatives of the model | derivatives of the model | 0.85
blueoak-1.0.0 | this license gives everyone as much permission to work with this software as possible, while protecting contributors from liability | protecting contributors | 0.9
""".strip()

# label | regex | keyword | score: mentions that name no license
GENERIC = r"""
public-domain | (?:released|placed|dedicated|donated)(?: \w+)? (?:in)?to the public domain | public domain | 0.8
public-domain | is in the public domain | public domain | 0.7
copyleft | copyleft | copyleft | 0.4
all-rights-reserved | all rights reserved | rights reserved | 0.6
all-rights-reserved | tous droits réservés | réservés | 0.6
all-rights-reserved | alle rechte vorbehalten | vorbehalten | 0.6
all-rights-reserved | todos los derechos reservados | reservados | 0.6
copyright | copyright (?:\(c\)|©)? ?\d{4} | copyright | 0.4
copyright | © ?\d{4} | © | 0.4
proprietary | proprietary and confidential | proprietary | 0.6
proprietary | unauthorized (?:copying|use|distribution) .{0,60}prohibited | unauthorized | 0.5
no-warranty | provided [“"']?as is[”"']?,? without warranty of any kind | without warranty | 0.5
no-warranty | without any warranty; without even the implied warranty | implied warranty | 0.5
permissive-grant | permission is hereby granted,? free of charge | hereby granted | 0.8
permissive-grant | permission to use, copy, modify,? and/?(?:or)? distribute | permission to | 0.8
permissive-grant | redistribution and use in source and binary forms | redistribution | 0.8
non-commercial | for non-?commercial (?:use|purposes) only | commercial | 0.5
unknown-license | (?:licensed|released|distributed|available) under the terms of the [\w .-]{3,40} licen[sc]e | under the terms | 0.3
unknown-license | see (?:the )?(?:file )?licen[sc]e(?:\.txt|\.md)? for (?:details|more) | licen | 0.3
""".strip()


@dataclass(frozen=True)
class Rule:
    priority: int
    tier: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    score: float


def _regex(text: str) -> re.Pattern:
    return re.compile(r"(?<![a-z0-9])(?:" + text.replace(" ", r"\s+") + r")(?![a-z0-9])")


def build_rules() -> list[Rule]:
    """The rules in order of priority."""
    families = [[x.strip() for x in line.split(" | ")] for line in FAMILIES.splitlines()]
    for part, name in CC_PARTS.items():
        for version in CC_VERSIONS:
            v = re.escape(version)
            families.append([f"cc-{part}-{version}", f"cc-{part}-{v}", f"cc[- ]{part}[- ]{v}|creative commons {name}(?: licen[sc]e)?,? (?:version |v)?{v}(?: \\w+)?(?: licen[sc]e)?", "cc by;cc-by;creative"])
        families.append([f"cc-{part}-unversioned", f"cc-{part}", f"cc[- ]{part}|creative commons {name}(?: licen[sc]e)?", "cc by;cc-by;creative"])
    families.append(["cc0-1.0", r"cc0-1\.0", r"cc0(?: 1\.0)?|creative commons zero", "cc0;creative"])
    rules: list[Rule] = []
    granted = r"(?:(?:re)?licen[sc]ed|released|distributed|available|published|made available) (?:to you )?under (?:the )?(?:terms of )?(?:the )?"
    for tier in range(3):
        for label, tags, names, keyword in families:
            if tier == 0:
                rules.append(Rule(len(rules), tier, label, ("spdx",), _regex(rf"spdx-license-identifier:? ?(?:{tags})"), 1.0))
            elif tier == 1:
                rules.append(Rule(len(rules), tier, label, tuple(keyword.split(";")), _regex(rf"{granted}(?:{names})"), 0.95))
            else:
                rules.append(Rule(len(rules), tier, label, tuple(keyword.split(";")), _regex(names), 0.75))
    for tier, lines in ((1, TEXTS), (3, GENERIC)):
        for line in lines.splitlines():
            label, text, keyword, score = (x.strip() for x in line.split(" | "))
            rules.append(Rule(len(rules), tier, label, (keyword,), _regex(text), float(score)))
    return rules


RULES = build_rules()
KEYWORDS = frozenset(k for r in RULES for k in r.keywords)
PLACES = {label: re.compile(SEP.join(x.encode() for x in phrase.split(" "))) for phrase, label in PHRASES.items()}


@cache
def automaton():
    """An Aho-Corasick automaton of all keywords."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k in KEYWORDS:
        made.add_word(k, k)
    made.make_automaton()
    return made


def keywords_in(text: str) -> set[str]:
    """The keywords that a lower-case text holds; a blank of a keyword stands for any white space, as in the rules."""
    return {k for _, k in automaton().iter(" ".join(text.split()))}


def detect(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of the detections in a lower-case text, by start: tier by tier, the longest first,
    without those that lie within one taken before."""
    held = keywords_in(text)
    if not held:
        return []
    found = []
    for rule in RULES:
        if not held.isdisjoint(rule.keywords):
            found += [(rule.tier, m.start() - m.end(), rule.priority, m.start(), m.end(), rule.label, rule.score) for m in rule.pattern.finditer(text)]
    found.sort()
    rank = {start: k + 1 for k, start in enumerate(sorted({d[3] for d in found}))}
    furthest = [0] * (len(rank) + 1)  # a Fenwick tree: the largest end of those taken, by start
    kept = []
    for _, _, _, start, end, label, score in found:
        k = rank[start]
        while k and furthest[k] < end:
            k &= k - 1
        if k:
            continue
        kept.append((start, end, label, score))
        k = rank[start]
        while k < len(furthest):
            furthest[k] = max(furthest[k], end)
            k += k & -k
    return sorted(kept)


def scan_batch(column: pa.Array) -> tuple[np.ndarray, list[list[tuple[str, int]]], list[list[tuple[int, int, str, float]]]]:
    """(number of words, (label, first word) of each phrase's places, detections) of each text."""
    texts = column.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    word = WORD_BYTE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    starts[first] = word[first]
    before = np.concatenate(([0], np.cumsum(starts)))
    n_words = before[ends[1:]] - before[ends[:-1]]
    whole = data.tobytes()
    bounds = ends.tolist()
    of = lambda at: bisect_left(bounds, at + 1) - 1
    places: list[list[tuple[str, int]]] = [[] for _ in range(len(texts))]
    for label, pattern in PLACES.items():
        m = pattern.search(whole)
        while m:
            a, b = m.span()
            k = of(a)
            if starts[a] and b <= bounds[k + 1] and (b == bounds[k + 1] or not word[b]):
                places[k].append((label, int(before[a] - before[bounds[k]])))
            m = pattern.search(whole, a + 1)
    detections = [detect(whole[bounds[k] : bounds[k + 1]].decode()) for k in range(len(texts))]
    return n_words, places, detections


RESULT = "n_words long, places array<struct<label: string, word: long>>, detections array<struct<start: int, end: int, label: string, score: double>>"


def scan_licenses(docs: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, ``RESULT``) of each row of ``docs(text, ...)``; detections are in code points of the text.

    A kept column that has the name of a new one is refused.
    """
    kept = docs.select(*keep)
    refuse_clashes(kept, "n_words", "places", "detections")
    types = [
        pa.int64(),
        pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])),
        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("score", pa.float64())])),
    ]

    def compute(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            if batch.num_rows:
                n_words, places, found = scan_batch(batch.column(len(keep)))
                columns = [
                    pa.array(n_words, types[0]),
                    pa.array([[{"label": a, "word": b} for a, b in x] for x in places], types[1]),
                    pa.array([[dict(zip(("start", "end", "label", "score"), d, strict=True)) for d in x] for x in found], types[2]),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, "n_words", "places", "detections"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return arrow_map(docs.select(*keep, F.col("text")), compute, f"{schema}, {RESULT}")
