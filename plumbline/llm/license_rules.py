"""Ordered license signatures, written by hand: names in running text, names behind a licensing verb, identifiers, addresses,
titles, and sentences of the licenses' own texts.

A signature is a regular expression over lower-case words parted by single spaces. It is tried only where its keyword, the
first word, stands, and its literal beginning goes on. ``rank`` orders signatures: of two detections of which one holds the other, the inner one goes unless
its rank is higher. ``weight`` is how sure a detection is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Label, then the names by which it goes, as expressions over words.
FAMILIES = {
    "gpl-1": ["gnu general public license (?:version |v )?1(?: 0)?", "gpl (?:version |v )?1(?: 0)?", "gplv1"],
    "gpl-2": ["gnu general public license (?:version |v )?2(?: 0)?", "gpl (?:version |v )?2(?: 0)?", "gplv2"],
    "gpl-3": ["gnu general public license (?:version |v )?3(?: 0)?", "gpl (?:version |v )?3(?: 0)?", "gplv3"],
    "gpl": ["gnu general public license", "gnu gpl", "gpl license"],
    "lgpl-2.1": ["gnu lesser general public license (?:version |v )?2 1", "lgpl (?:version |v )?2 1", "lgplv2 1"],
    "lgpl-3": ["gnu lesser general public license (?:version |v )?3(?: 0)?", "lgpl (?:version |v )?3(?: 0)?", "lgplv3"],
    "lgpl": ["gnu (?:lesser|library) general public license", "gnu lgpl", "lgpl license"],
    "agpl-3": ["gnu affero general public license (?:version |v )?3(?: 0)?", "agpl (?:version |v )?3(?: 0)?", "agplv3"],
    "agpl": ["gnu affero general public license", "gnu agpl", "affero general public license"],
    "gfdl": ["gnu free documentation license(?: (?:version )?1 [123])?", "gfdl(?: 1 [123])?"],
    "apache-1.1": ["apache (?:software )?license (?:version |v )?1 1"],
    "apache-2.0": ["apache (?:software )?license (?:version |v )?2(?: 0)?", "apache 2(?: 0)? license", "apache 2 0"],
    "apache": ["apache license", "apache software license"],
    "mit": ["mit license", "mit licence", "mit x11 license", "mit expat license"],
    "bsd-2": ["bsd 2 clause(?: simplified)?(?: license)?", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "bsd-3": ["bsd 3 clause(?: new| revised)*(?: license)?", "3 clause bsd license", "(?:new|revised|modified) bsd license"],
    "bsd-4": ["bsd 4 clause(?: license)?", "4 clause bsd license", "original bsd license"],
    "bsd": ["bsd license", "bsd style license"],
    "0bsd": ["zero clause bsd(?: license)?", "0bsd"],
    "isc": ["isc license"],
    "mpl-1.1": ["mozilla public license (?:version |v )?1 1", "mpl (?:version |v )?1 1"],
    "mpl-2.0": ["mozilla public license (?:version |v )?2(?: 0)?", "mpl (?:version |v )?2(?: 0)?"],
    "mpl": ["mozilla public license"],
    "epl": ["eclipse public license(?: (?:version |v )?[12](?: 0)?)?", "epl [12] 0"],
    "cddl": ["common development and distribution license(?: (?:version )?1 [01])?", "cddl 1 [01]"],
    "cpl": ["common public license(?: (?:version )?1 0)?"],
    "eupl": ["european union public licen[sc]e(?: (?:version |v )?1 [012])?", "eupl(?: v)? 1 [012]"],
    "artistic": ["artistic license(?: [12] 0)?", "perl artistic license"],
    "boost": ["boost software license(?: (?:version )?1 0)?", "bsl 1 0"],
    "zlib": ["zlib license", "zlib libpng license"],
    "unlicense": ["unlicense license", "unlicense org"],
    "wtfpl": ["wtfpl(?: v2)?"],
    "cc0": ["cc0(?: 1 0)?(?: universal)?", "cc zero", "creative commons zero"],
    "cc-by-nc-nd": ["cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv\\w*(?: [1-4] [05])?"],
    "cc-by-nc-sa": ["cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"],
    "cc-by-nc": ["cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?"],
    "cc-by-nd": ["cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv\\w*(?: [1-4] [05])?"],
    "cc-by-sa": ["cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?"],
    "cc-by": ["cc by(?: [1-4] [05])?", "creative commons attribution(?: [1-4] [05])?(?: international)?(?: license)?"],
    "odbl": ["open data commons open database license", "open database license", "odbl(?: 1 0)?"],
    "ofl": ["sil open font license(?: (?:version )?1 1)?", "ofl 1 1"],
    "python": ["python software foundation license", "psf license"],
    "ruby": ["ruby license"],
    "postgresql": ["postgresql license"],
    "public-domain": ["public domain dedication", "dedicated to the public domain", "released into the public domain"],
    "proprietary": ["all rights reserved", "proprietary and confidential", "strictly confidential"],
}

#: Forms in which a license is named: words before the name, rank above the bare name's and weight in hundredths.
FORMS = [
    ("name", "", 0, 70),
    ("licensed", "licen[sc]ed under (?:the |a |an )?(?:terms of the )?", 2, 95),
    ("released", "released under (?:the |a |an )?(?:terms of the )?", 2, 95),
    ("distributed", "distributed under (?:the |a |an )?(?:terms of the )?", 2, 95),
    ("available", "available under (?:the |a |an )?(?:terms of the )?", 2, 90),
    ("covered", "covered by (?:the |a |an )?", 1, 80),
    ("subject", "subject to (?:the |a |an )?(?:terms of the )?", 1, 80),
]
_FIRST = {"licensed": ["licensed", "licenced"]}

#: Short names, which say a license only behind a verb or a field: label, then what stands there.
SHORT = {
    "gpl": ["gpl"], "gpl-2": ["gplv2", "gpl 2", "gpl v2"], "gpl-3": ["gplv3", "gpl 3", "gpl v3"], "lgpl": ["lgpl"], "agpl": ["agpl"], "mit": ["mit", "mit x11", "expat"],
    "apache-2.0": ["apache 2", "apache 2 0", "apache v2", "asl 2 0"], "apache": ["apache"], "bsd": ["bsd"], "bsd-2": ["bsd 2 clause", "2 clause bsd"],
    "bsd-3": ["bsd 3 clause", "3 clause bsd"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"], "mpl": ["mpl"], "mpl-2.0": ["mpl 2 0", "mplv2"], "epl": ["epl"],
    "cddl": ["cddl"], "eupl": ["eupl"], "artistic": ["artistic 2 0"], "postgresql": ["postgresql"], "python": ["psf"], "ofl": ["ofl"], "wtfpl": ["wtfpl"],
    "cc0": ["cc0"], "cc-by": ["cc by"], "cc-by-sa": ["cc by sa"], "cc-by-nc": ["cc by nc"], "cc-by-nd": ["cc by nd"], "odbl": ["odbl"], "gfdl": ["gfdl"],
}
SHORT_FORMS = [*FORMS[1:5], ("license", "licen[sc]e ", 1, 80)]
_FIRST["license"] = ["license", "licence"]

#: Identifiers as words, behind "spdx license identifier".
IDENTIFIERS = {
    "0bsd": ["0bsd"], "agpl-3": ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"], "agpl": ["agpl 1 0 only", "agpl 1 0 or later"], "apache-1.1": ["apache 1 1"], "apache-2.0": ["apache 2 0"],
    "artistic": ["artistic 1 0", "artistic 1 0 perl", "artistic 2 0"], "bsd-2": ["bsd 2 clause", "bsd 2 clause patent"], "bsd-3": ["bsd 3 clause", "bsd 3 clause clear"],
    "bsd-4": ["bsd 4 clause", "bsd 4 clause uc"], "boost": ["bsl 1 0"], "cc0": ["cc0 1 0"], "cc-by": ["cc by [1-4] [05]"], "cc-by-nc": ["cc by nc [1-4] [05]"],
    "cc-by-nc-nd": ["cc by nc nd [1-4] [05]"], "cc-by-nc-sa": ["cc by nc sa [1-4] [05]"], "cc-by-nd": ["cc by nd [1-4] [05]"], "cc-by-sa": ["cc by sa [1-4] [05]"],
    "cddl": ["cddl 1 [01]"], "cpl": ["cpl 1 0"], "epl": ["epl [12] 0"], "eupl": ["eupl 1 [012]"], "gfdl": ["gfdl 1 [123](?: only| or later)?"],
    "gpl-1": ["gpl 1 0 only", "gpl 1 0 or later"], "gpl-2": ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"], "gpl-3": ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "isc": ["isc"], "lgpl-2.1": ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"], "lgpl-3": ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"], "lgpl": ["lgpl 2 0 only", "lgpl 2 0 or later"],
    "mit": ["mit", "mit 0", "x11"], "mpl-1.1": ["mpl 1 1"], "mpl-2.0": ["mpl 2 0"], "odbl": ["odbl 1 0"], "ofl": ["ofl 1 [01]"], "postgresql": ["postgresql"], "python": ["psf 2 0", "python 2 0"],
    "ruby": ["ruby"], "unlicense": ["unlicense"], "wtfpl": ["wtfpl"], "zlib": ["zlib"],
}

#: Addresses as words, without what stands before the host.
ADDRESSES = {
    "agpl-3": ["gnu org licenses agpl 3 0", "opensource org licenses agpl 3 0"], "agpl": ["gnu org licenses agpl"], "apache-2.0": ["apache org licenses license 2 0", "opensource org licenses apache 2 0"],
    "apache": ["apache org licenses"], "artistic": ["opensource org licenses artistic license 2 0"], "boost": ["boost org license 1 0 txt", "opensource org licenses bsl 1 0"],
    "bsd-2": ["opensource org licenses bsd 2 clause"], "bsd-3": ["opensource org licenses bsd 3 clause"], "bsd": ["opensource org licenses bsd license"],
    "cc0": ["creativecommons org publicdomain zero 1 0"], "cc-by": ["creativecommons org licenses by [1-4] [05]"], "cc-by-nc": ["creativecommons org licenses by nc [1-4] [05]"],
    "cc-by-nc-nd": ["creativecommons org licenses by nc nd [1-4] [05]"], "cc-by-nc-sa": ["creativecommons org licenses by nc sa [1-4] [05]"],
    "cc-by-nd": ["creativecommons org licenses by nd [1-4] [05]"], "cc-by-sa": ["creativecommons org licenses by sa [1-4] [05]"], "public-domain": ["creativecommons org publicdomain mark 1 0"],
    "cddl": ["opensource org licenses cddl 1 0"], "epl": ["eclipse org legal epl v ?[12]0", "eclipse org legal epl 2 0"], "eupl": ["joinup ec europa eu (?:collection eupl|software page eupl)"],
    "gfdl": ["gnu org licenses fdl", "gnu org copyleft fdl html"], "gpl-2": ["gnu org licenses old licenses gpl 2 0", "gnu org licenses gpl 2 0", "opensource org licenses gpl 2 0"],
    "gpl-3": ["gnu org licenses gpl 3 0", "opensource org licenses gpl 3 0"], "gpl": ["gnu org licenses gpl", "gnu org copyleft gpl html", "gnu org licenses"],
    "isc": ["opensource org licenses isc"], "lgpl-2.1": ["gnu org licenses old licenses lgpl 2 1", "opensource org licenses lgpl 2 1"], "lgpl-3": ["gnu org licenses lgpl 3 0", "opensource org licenses lgpl 3 0"],
    "lgpl": ["gnu org licenses lgpl", "gnu org copyleft lesser html"], "mit": ["opensource org licenses mit", "mit license org"], "mpl-1.1": ["mozilla org mpl mpl 1 1"],
    "mpl-2.0": ["mozilla org mpl 2 0", "mozilla org en us mpl 2 0"], "mpl": ["mozilla org mpl"], "odbl": ["opendatacommons org licenses odbl"], "ofl": ["scripts sil org ofl"],
    "postgresql": ["postgresql org about licen[sc]e"], "python": ["docs python org 3 license html", "python org psf license"], "unlicense": ["unlicense org"], "wtfpl": ["wtfpl net", "sam zoy org wtfpl"],
    "zlib": ["zlib net zlib license html", "opensource org licenses zlib"],
}

#: Titles of license texts: rank 3.
TITLES = {
    "agpl-3": ["gnu affero general public license version 3 19 november 2007"], "apache-2.0": ["apache license version 2 0 january 2004"], "apache-1.1": ["the apache software license version 1 1"],
    "artistic": ["the artistic license 2 0 copyright"], "boost": ["boost software license version 1 0 august 17th 2003"], "cc0": ["cc0 1 0 universal creative commons legal code"],
    "cddl": ["common development and distribution license cddl version 1 [01]"], "epl": ["eclipse public license v [12] 0", "eclipse public license version [12] 0"],
    "gfdl": ["gnu free documentation license version 1 [123](?: 3 november 2008)?"], "gpl-1": ["gnu general public license version 1 february 1989"], "gpl-2": ["gnu general public license version 2 june 1991"],
    "gpl-3": ["gnu general public license version 3 29 june 2007"], "lgpl-2.1": ["gnu lesser general public license version 2 1 february 1999"], "lgpl-3": ["gnu lesser general public license version 3 29 june 2007"],
    "lgpl": ["gnu library general public license version 2 june 1991"], "mit": ["the mit license mit"], "mpl-2.0": ["mozilla public license version 2 0 1 definitions"],
    "ofl": ["sil open font license version 1 1 26 february 2007"], "wtfpl": ["do what the fuck you want to public license"], "postgresql": ["postgresql database management system formerly known as postgres"],
}

#: Sentences of license texts, notices and file headers: rank 3.
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy",
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense",
    ],
    "mit-0": ["deal in the software without restriction including without limitation the rights to use(?: \\w+){6,9} and to permit persons"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"],
    "postgresql": ["permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"],
    "python": ["permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer",
    ],
    "bsd-3": [
        "neither the name of(?: \\w+){1,9} nor the names of its contributors may be used to endorse or promote",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-4": ["advertising materials mentioning features or use of this software must display the following acknowledge?ment"],
    "gpl": [
        "program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "software is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "received a copy of the gnu general public license along with this program",
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license",
    ],
    "gpl-2": ["free software foundation either version 2 of the license or at your option any later version", "free software foundation version 2 of the license"],
    "gpl-3": ["free software foundation either version 3 of the license or at your option any later version", "free software foundation version 3 of the license"],
    "lgpl": [
        "library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public",
        "received a copy of the gnu (?:lesser|library) general public license along with this",
    ],
    "lgpl-2.1": ["free software foundation either version 2 1 of the license or at your option any later version"],
    "agpl": [
        "redistribute it and or modify it under the terms of the gnu affero general public license",
        "received a copy of the gnu affero general public license along with this program",
    ],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works",
    ],
    "mpl-2.0": ["source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl-1.1": ["contents of this file are subject to the mozilla public license version 1 1"],
    "cddl": ["contents of this file are subject to the terms of the common development and distribution license"],
    "epl": ["accompanying materials are made available under the terms of the eclipse public license"],
    "cpl": ["accompanying materials are made available under the terms of the common public license"],
    "boost": ["distributed under the boost software license version 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"],
    "zlib": [
        "software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ],
    "unlicense": [
        "free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or",
    ],
    "artistic": ["intent of this document is to state the conditions under which a package may be copied"],
    "ofl": ["font software is licensed under the sil open font license"],
    "cc0": [
        "waived all copyright and related or neighboring rights to this work",
        "extent possible under law the (?:author|person)(?: s)?(?: \\w+){0,8} waived all copyright",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders",
    ],
    "cc-by": ["work is licensed under (?:a|the) creative commons attribution [1-4] [05] (?:international|unported|generic) license", "free to share and adapt the material for any purpose even commercially"],
    "cc-by-sa": ["work is licensed under (?:a|the) creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic) license"],
    "cc-by-nc": ["work is licensed under (?:a|the) creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic) license"],
    "cc-by-nd": ["work is licensed under (?:a|the) creative commons attribution no ?derivatives [1-4] [05] (?:international|unported|generic) license"],
    "cc-by-nc-sa": ["work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike [1-4] [05] (?:international|unported|generic) license"],
    "cc-by-nc-nd": ["work is licensed under (?:a|the) creative commons attribution non ?commercial no ?derivatives [1-4] [05] (?:international|unported|generic) license"],
    "odbl": ["made available under the open database license", "any rights in individual contents of the database are licensed under the database contents license"],
    "public-domain": ["placed in the public domain", "hereby released into the public domain", "work of the u(?:nited)? ?s(?:tates)? government"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"],
    "gnu-text": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "as-is": ["software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"],
    "proprietary": [
        "may not be copied modified or distributed without (?:the )?(?:express )?(?:prior )?written (?:permission|consent)",
        "no part of this (?:publication|document|work|book) may be reproduced",
        "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|material|document) (?:via any medium )?is strictly prohibited",
        "internal use only do not distribute",
        "licensed for personal non commercial use only",
    ],
}

#: Words of the longest signature.
SPAN = 24


@dataclass(frozen=True)
class Signature:
    keyword: str
    pattern: str
    label: str
    rank: int
    weight: int

    @property
    def head(self) -> str:
        """The literal text with which every hit begins."""
        literal = re.match("[a-z0-9 ]*", self.pattern.removeprefix("^"))[0]
        return literal[:-1] if self.pattern[1 + len(literal) :][:1] in tuple("?*+{|") else literal

    @property
    def second(self) -> str | None:
        """The second word of every hit, if there is one and it is the same."""
        first, _, rest = self.pattern.removeprefix("^").partition(" ")
        word = rest.partition(" ")[0].removesuffix("(?=")
        return word if first.count("(") == first.count(")") and re.fullmatch("[a-z0-9]+", word) else None


def _first_words(name: str) -> list[str]:
    """The words with which a name can begin."""
    word = name.split(" ")[0]
    if word.startswith("(?:"):
        return word[3:].rstrip(")").split("|")
    return [word.split("(?:")[0]]


def signatures() -> list[Signature]:
    """All signatures. Within a rank, the families come in their order above, the more exact before the wider ones."""
    places = {label: i for i, label in enumerate(FAMILIES)}
    out = []

    def add(label: str, pattern: str, rank: int, weight: int, keywords: list[str]) -> None:
        order = 1000 * rank + len(places) - places.get(label, len(places))
        out.extend(Signature(k, f"^{pattern}(?= |$)", label, order, weight) for k in keywords)

    for names, forms in ((FAMILIES, FORMS), (SHORT, SHORT_FORMS)):
        for label, own in names.items():
            for name in own:
                for form, before, rank, weight in forms:
                    add(label, before + name, rank, weight, _first_words(name) if form == "name" else _FIRST.get(form, [form]))
    for label, own in IDENTIFIERS.items():
        for name in own:
            add(label, f"spdx licen[sc]e identifier {name}", 3, 100, ["spdx"])
    for table, weight in ((ADDRESSES, 90), (TITLES, 100), (NOTICES, 95)):
        for label, own in table.items():
            for pattern in own:
                add(label, pattern, 3, weight, _first_words(pattern))
    return list(dict.fromkeys(out))
