"""Signature rules for licences: names, phrasings and fragments of licence texts, all written by hand.

A rule is a regular expression over a text's lower-case words joined by single spaces. The product of names and
phrasings gives some hundreds of rules; fragments of licence texts are rules of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int       # of overlapping detections the higher one wins
    score: float        # how sure a detection is
    keywords: frozenset[bytes]  # every match contains one of these words
    pattern: re.Pattern


# Label, words of which one occurs in every match, and the ways a licence is named.
FAMILIES = [
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)? licen[cs]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("apache-2.0", "apache", r"(?:the )?apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache (?:software )?licen[cs]e (?:version |v)?1 1"),
    ("apache", "apache", r"(?:the )?apache (?:software )?licen[cs]e"),
    ("gpl-1.0", "general gpl", r"(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v)1(?: 0)?"),
    ("gpl-2.0", "general gpl", r"(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v)2(?: 0)?"),
    ("gpl-3.0", "general gpl", r"(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl) (?:version |v)3(?: 0)?"),
    ("gpl", "general gpl", r"(?:the )?gnu (?:general public licen[cs]e|gpl)"),
    ("lgpl-2.1", "lesser lgpl", r"(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v)2 1"),
    ("lgpl-3.0", "lesser lgpl", r"(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl) (?:version |v)3(?: 0)?"),
    ("lgpl", "lesser lgpl", r"(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl)"),
    ("lgpl-2.0", "library", r"(?:the )?(?:gnu )?library general public licen[cs]e"),
    ("agpl-3.0", "affero agpl", r"(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl) (?:version |v)3(?: 0)?"),
    ("agpl", "affero agpl", r"(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl)"),
    ("gfdl", "documentation", r"(?:the )?gnu free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public licen[cs]e (?:version |v)?2 0"),
    ("mpl", "mozilla", r"(?:the )?mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public licen[cs]e (?:version |v)?1 0"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public licen[cs]e (?:version |v)?2 0"),
    ("epl", "eclipse", r"(?:the )?eclipse public licen[cs]e"),
    ("cpl", "common", r"(?:the )?common public licen[cs]e"),
    ("cddl", "distribution", r"(?:the )?common development and distribution licen[cs]e"),
    ("eupl", "european", r"(?:the )?european union public licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:2|two) clause bsd licen[cs]e|(?:the )?simplified bsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:3|three) clause bsd licen[cs]e|(?:the )?(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd", "bsd", r"(?:a |the )?bsd (?:style )?licen[cs]e"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("boost", "boost", r"(?:the )?boost software licen[cs]e"),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[cs]e (?:version |v)?2(?: 0)?"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic licen[cs]e"),
    ("psf", "python psf", r"(?:the )?(?:python software foundation|psf) licen[cs]e"),
    ("php", "php", r"(?:the )?php licen[cs]e"),
    ("ofl", "font", r"(?:the )?(?:sil )?open font licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public licen[cs]e"),
    ("odbl", "database", r"(?:the )?open (?:data commons open )?database licen[cs]e"),
    ("cc0", "cc0", r"(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", "commons cc", r"(?:a |the )?(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc", "commons cc", r"(?:a |the )?(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-nd", "commons cc", r"(?:a |the )?(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by", "commons cc", r"(?:a |the )?(?:creative commons attribution|cc by)(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?"),
]

# How a text says which licence holds. `{}` is the name.
PHRASINGS = [
    ("licensed", 4, 0.95, r"(?:is |are |be )?(?:dual |re)?licen[cs]ed (?:to you )?under (?:the terms of |the conditions of )?{}"),
    ("released", 4, 0.95, r"(?:released|distributed|provided|published|made available|available|offered) under (?:the terms of |the conditions of )?{}"),
    ("subject", 4, 0.9, r"subject to (?:the )?(?:terms|conditions|terms and conditions) of {}"),
    ("terms", 4, 0.9, r"under the (?:terms|conditions|terms and conditions) of {}"),
    ("governed", 4, 0.9, r"(?:governed|covered) by {}"),
    ("copy", 3, 0.85, r"(?:you should have received |see |include[sd]? )(?:a copy of )?{}"),
    ("compliance", 3, 0.85, r"in compliance with {}"),
    ("field", 3, 0.9, r"licen[cs]e (?:is |type )?{}"),
    ("name", 2, 0.7, r"{}"),
]

# Label, words of which one occurs in every match, fragments of the licence texts themselves.
FRAGMENTS = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("apache-2.0", "licenses", r"www apache org licenses license 2 0"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-2.0", "either", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "either", r"either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("boost", "boost", r"distributed under the boost software license version 1 0"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to"),
    ("mit", "noninfringement", r"including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "dealings", r"out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "exemplary", r"direct indirect incidental special exemplary or consequential damages"),
    ("bsd-4-clause", "acknowledgement acknowledgment", r"(?:must|shall) display the following acknowledge?ment"),
    ("apache-2.0", "contributor", r"(?:to the apache software foundation asf )?under one or more contributor license agreements"),
    ("apache-2.0", "irrevocable", r"worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "hope", r"(?:is|are) distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "gnu", r"(?:see )?(?:https? )?(?:www )?gnu org licenses(?: gpl(?: 3 0| 2 0)?)?"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "lgpl", r"lgpl (?:2 1|3 0|2|3)(?: or later| only)?"),
    ("mpl-2.0", "mpl", r"(?:mozilla org )?mpl 2 0"),
    ("mpl-1.1", "initial", r"the initial developer of the original code is"),
    ("cddl", "cddl", r"(?:the )?cddl(?: license)?(?: version)?(?: 1 [01])?"),
    ("eupl", "eupl", r"(?:the )?eupl(?: v| version)?(?: 1 [12])?"),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty"),
    ("artistic", "perl", r"under the same terms as perl itself"),
    ("psf", "beopen", r"beopen python open source license agreement"),
    ("gfdl", "invariant", r"with no invariant sections(?: no front cover texts)?(?: and no back cover texts)?"),
    ("ofl", "ofl", r"(?:scripts sil org )?ofl(?: version)? 1 1"),
    ("beerware", "beer beerware", r"(?:the )?beer ?ware licen[cs]e|you can buy me a beer in return"),
    ("jquery", "jquery", r"jquery org license"),
    ("public-domain", "domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("cc0", "waived", r"has waived all copyright and related or neighbo(?:u)?ring rights"),
]

# Identifiers as they stand behind an SPDX tag, as words.
IDENTIFIERS = [
    ("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"),
    ("lgpl-3.0", "lgpl 3 0"), ("agpl-3.0", "agpl 3 0"), ("mpl-2.0", "mpl 2 0"), ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("cc0", "cc0 1 0"),
    ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("epl-2.0", "epl 2 0"), ("boost", "bsl 1 0"),
]


def _rule(name: str, label: str, priority: int, score: float, keywords: str, pattern: str) -> Rule:
    whole = rf"(?<= )(?:{pattern})(?= )"
    return Rule(name, label, priority, score, frozenset(k.encode() for k in keywords.split()), re.compile(whole.encode()))


def build_rules() -> list[Rule]:
    """All rules, the stronger ones first."""
    rules = [_rule(f"{label}/text-{i}", label, 5, 0.98, word, p) for i, (label, word, p) in enumerate(FRAGMENTS)]
    rules += [_rule(f"{label}/spdx", label, 5, 1.0, "spdx", f"spdx licen[cs]e identifier {words}(?: only| or later)?")
              for label, words in IDENTIFIERS]
    for place, (label, word, names) in enumerate(FAMILIES):
        for kind, priority, score, phrasing in PHRASINGS:
            rules.append(_rule(f"{label}/{kind}", label, priority, score, word, phrasing.format(f"(?:{names})")))
    return sorted(rules, key=lambda r: -r.priority)
