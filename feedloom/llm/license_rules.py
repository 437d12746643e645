"""The signature rules of the license scan: sentences of license texts, and names in templates.

Every license of ``NAMES`` has a sentence of its own text too. Patterns are written over lower-case words with one space between them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    level: int  # 0 comes first
    label: str
    keyword: str  # a word that every match holds
    pattern: str
    weight: float


# Label, gate word, name as a pattern, identifier as a pattern.
NAMES = (
    ("mit", "mit", "mit", "mit"),
    ("mit", "expat", "expat", "expat"),
    ("apache", "apache", "apache(?: software)?", "apache(?: 2 0| 1 1)?"),
    ("gpl", "general", "(?:gnu )?general public", "gpl"),
    ("gpl", "gpl", "(?:gnu )?gpl", "gpl(?: [23] 0)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", "lgpl"),
    ("lgpl", "library", "(?:gnu )?library general public", "lgpl"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "lgpl(?: [23] [01])?"),
    ("agpl", "affero", "(?:gnu )?affero general public", "agpl"),
    ("agpl", "agpl", "(?:gnu )?agpl", "agpl(?: 3 0)?"),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "gfdl(?: 1 [123])?"),
    ("bsd", "bsd", "(?:(?:new|modified|revised|simplified|original) )?bsd(?: [0234] clause)?", "bsd(?: [0234] clause)?"),
    ("isc", "isc", "isc", "isc"),
    ("mpl", "mozilla", "mozilla public", "mpl"),
    ("mpl", "mpl", "mpl", "mpl(?: [12] [01])?"),
    ("epl", "eclipse", "eclipse public", "epl"),
    ("epl", "epl", "epl", "epl(?: [12] 0)?"),
    ("cddl", "cddl", "cddl", "cddl(?: 1 [01])?"),
    ("cddl", "distribution", "common development and distribution", "cddl"),
    ("cpl", "common", "common public", "cpl(?: 1 0)?"),
    ("ipl", "ibm", "ibm public", "ipl 1 0"),
    ("eupl", "eupl", "eupl", "eupl(?: 1 [012])?"),
    ("eupl", "european", "european union public", "eupl"),
    ("artistic", "artistic", "(?:perl )?artistic", "artistic(?: [12] 0)?"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("boost", "boost", "boost(?: software)?", "bsl 1 0"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "nd", "cc by nc nd(?: [1234] 0)?", "cc by nc nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "sa", "cc by nc sa(?: [1234] 0)?", "cc by nc sa(?: [1234] 0)?"),
    ("cc-by-nc", "nc", "cc by nc(?: [1234] 0)?", "cc by nc(?: [1234] 0)?"),
    ("cc-by-nd", "nd", "cc by nd(?: [1234] 0)?", "cc by nd(?: [1234] 0)?"),
    ("cc-by-sa", "sa", "cc by sa(?: [1234] 0)?", "cc by sa(?: [1234] 0)?"),
    ("cc-by", "cc", "cc by(?: [1234] 0)?", "cc by(?: [1234] 0)?"),
    ("cc-by-nc-sa", "sharealike", "creative commons attribution non ?commercial sharealike(?: [1234] 0)?", "cc by nc sa"),
    ("cc-by-nc", "attribution", "creative commons attribution non ?commercial(?: [1234] 0)?", "cc by nc"),
    ("cc-by-sa", "attribution", "creative commons attribution share ?alike(?: [1234] 0)?", "cc by sa"),
    ("cc-by", "attribution", "creative commons attribution(?: [1234] 0)?", "cc by"),
    ("ofl", "sil", "sil open font", "ofl(?: 1 [01])?"),
    ("psf", "python", "python software foundation", "psf(?: 2 0)?"),
    ("php", "php", "php", "php 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "ms rl"),
    ("afl", "academic", "academic free", "afl(?: 3 0)?"),
    ("osl", "open", "open software", "osl(?: 3 0)?"),
    ("odbl", "database", "open database", "odbl(?: 1 0)?"),
    ("lppl", "latex", "latex project public", "lppl(?: 1 3[abc]?)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("upl", "permissive", "universal permissive", "upl(?: 1 0)?"),
    ("zpl", "zope", "zope public", "zpl(?: 2 [01])?"),
    ("ecl", "educational", "educational community", "ecl(?: 2 0)?"),
    ("cecill", "cecill", "cecill(?: [bc])?", "cecill(?: 2 [01])?"),
    ("sspl", "server", "server side public", "sspl(?: 1 0)?"),
    ("busl", "business", "business source", "busl(?: 1 1)?"),
    ("elastic", "elastic", "elastic", "elastic(?: 2 0)?"),
    ("w3c", "w3c", "w3c(?: software)?", "w3c"),
)

_VERSION = "(?: (?:version |v)?[0-9]+(?: [0-9]+)?)?"
_LICENSE = "licen[cs]e"
_GIVEN = "(?:released|distributed|available|provided|published|covered|redistributed|issued)"

# Level, weight and pattern around a name {n} or an identifier {i}.
TEMPLATES = (
    (0, 1.00, "spdx " + _LICENSE + " identifier {i}(?: only| or later)?"),
    (1, 0.95, "licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{n}(?: " + _LICENSE + ")?" + _VERSION),
    (1, 0.95, _GIVEN + " under (?:the )?(?:terms of (?:the )?)?{n}(?: " + _LICENSE + ")?" + _VERSION),
    (2, 0.90, "(?:subject|according) to (?:the )?(?:terms of (?:the )?)?{n} " + _LICENSE + _VERSION),
    (3, 0.80, "(?:the )?{n} " + _LICENSE + _VERSION),
)

# Level, label, gate word, pattern and weight of sentences of license texts, written by hand.
TEXTS = (
    # sentences that stand in one license only
    (0, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    (0, "mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    (0, "json", "evil", "the software shall be used for good not evil", 1.0),
    (0, "apache", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 1.0),
    (0, "apache", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", 1.0),
    (0, "apache", "apache", "this product includes software developed by the apache (?:software foundation|group)", 1.0),
    (0, "isc", "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee", 1.0),
    (0, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    (0, "bsd", "endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software", 1.0),
    (0, "bsd", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    (0, "zlib", "origin", "the origin of this software must not be misrepresented", 1.0),
    (0, "zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    (0, "gpl", "gnu", "under the terms of the gnu general public license as published by the free software foundation", 1.0),
    (0, "gpl", "freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change (?:it|the works)", 1.0),
    (0, "gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    (0, "lgpl", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation", 1.0),
    (0, "lgpl", "library", "under the terms of the gnu library general public license as published by the free software foundation", 1.0),
    (0, "lgpl", "lesser", "this license the lesser general public license applies to some specially designated software packages", 1.0),
    (0, "lgpl", "library", "this license the library general public license applies to some specially designated free software foundation software", 1.0),
    (0, "lgpl", "lesser", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", 1.0),
    (0, "agpl", "affero", "under the terms of the gnu affero general public license as published by the free software foundation", 1.0),
    (0, "agpl", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 1.0),
    (0, "gfdl", "textbook", "the purpose of this license is to make a manual textbook or other (?:functional and useful|written) document free in the sense of freedom", 1.0),
    (0, "gfdl", "documentation", "under the terms of the gnu free documentation license version 1 [123] or any later version published by the free software foundation", 1.0),
    (0, "mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    (0, "mpl", "hereby", "the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims", 1.0),
    (0, "cddl", "conditioned", "conditioned upon your compliance with section 3 1 below and subject to third party intellectual property claims the initial developer hereby grants you a world wide royalty free non exclusive license", 1.0),
    (0, "epl", "eclipse", "the accompanying program is provided under the terms of this eclipse public license", 1.0),
    (0, "epl", "steward", "the eclipse foundation is the initial agreement steward", 1.0),
    (0, "epl", "secondary", "this source code may also be made available under the following secondary licenses", 1.0),
    (0, "cpl", "common", "the accompanying program is provided under the terms of this common public license", 1.0),
    (0, "cpl", "steward", "ibm is the initial agreement steward", 1.0),
    (0, "ipl", "ibm", "the accompanying program is provided under the terms of this ibm public license", 1.0),
    (0, "ipl", "ibm", "ibm may publish new versions including revisions of this agreement from time to time", 1.0),
    (0, "eupl", "licensor", "the work is provided under the terms of this licence when the licensor as defined below has placed the following notice immediately following the copyright notice for the work", 1.0),
    (0, "eupl", "european", "the european commission may publish other linguistic versions and or new versions of this licence", 1.0),
    (0, "artistic", "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package", 1.0),
    (0, "artistic", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1.0),
    (0, "boost", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    (0, "wtfpl", "permitted", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 1.0),
    (0, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    (0, "unlicense", "compiled", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 1.0),
    (0, "cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights", 1.0),
    (0, "cc-by", "attribution", "bound by the terms and conditions of this creative commons attribution 4 0 international public license", 1.0),
    (0, "cc-by-sa", "attribution", "bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license", 1.0),
    (0, "cc-by-nd", "attribution", "bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license", 1.0),
    (0, "cc-by-nc", "attribution", "bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license", 1.0),
    (0, "cc-by-nc-sa", "attribution", "bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license", 1.0),
    (0, "cc-by-nc-nd", "attribution", "bound by the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license", 1.0),
    (0, "ofl", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 1.0),
    (0, "ofl", "font", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", 1.0),
    (0, "psf", "python", "this license agreement is between the python software foundation psf and the individual or organization licensee", 1.0),
    (0, "psf", "psf", "subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world wide license", 1.0),
    (0, "php", "php", "this product includes php software freely available from", 1.0),
    (0, "php", "php", "products derived from this software may not be called php nor may php appear in their name", 1.0),
    (0, "ruby", "verbatim", "you may make and give away verbatim copies of the source form of the software without restriction", 1.0),
    (0, "openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    (0, "postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    (0, "ms-pl", "accompanying", "this license governs use of the accompanying software if you use the software you accept this license", 1.0),
    (0, "ms-rl", "recipients", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license", 1.0),
    (0, "afl", "academic", "this academic free license the license applies to any original work of authorship", 1.0),
    (0, "afl", "contradict", "under any license of your choice that does not contradict the terms and conditions", 1.0),
    (0, "osl", "proviso", "with the proviso that copies of original work or derivative works that you distribute or communicate shall be licensed under this open software license", 1.0),
    (0, "odbl", "database", "license agreement intended to allow users to freely share modify and use this database while maintaining this same freedom for others", 1.0),
    (0, "lppl", "latex", "under the conditions of the latex project public license", 1.0),
    (0, "ncsa", "deal", "to deal with the software without restriction", 1.0),
    (0, "upl", "collectively", "permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data collectively the software", 1.0),
    (0, "zpl", "holders", "names of the copyright holders must not be used to endorse or promote products derived from this software", 1.0),
    (0, "ecl", "institution", "any patent license granted hereby with respect to contributions by an individual employed by an institution or organization", 1.0),
    (0, "cecill", "discussions", "this agreement is a free software license agreement that is the result of discussions between its authors", 1.0),
    (0, "sspl", "service", "make the service source code available via network download to everyone at no charge under the terms of this license", 1.0),
    (0, "busl", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    (0, "elastic", "hosted", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    (0, "w3c", "royalty", "permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted", 1.0),
    # what several licenses say, and what only hints at one
    (1, "wtfpl", "fuck", "do what the fuck you want to public license", 1.0),
    (1, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    (2, "gpl", "later", "either version [23] of the license or at your option any later version", 0.9),
    (2, "public-domain", "domain", "(?:dedicated|released|placed) (?:in)?to the public domain", 0.9),
    (3, "public-domain", "domain", "(?:in )?the public domain", 0.6),
    (3, "proprietary", "confidential", "this software is the confidential and proprietary information of", 0.8),
    (3, "proprietary", "rights", "all rights reserved", 0.5),
    (3, "unknown", "licensed", "licensed under (?:the )?following terms", 0.4),
)


def rules() -> list[Rule]:
    """All rules in order. A name's rule is gated by its word, or by that of its identifier."""
    found = [Rule(level, label, word, pattern, weight) for level, label, word, pattern, weight in TEXTS]
    for level, weight, template in TEMPLATES:
        for label, word, name, identifier in NAMES:
            gate = identifier.split(" ")[0].split("(")[0] if "{i}" in template else word
            found.append(Rule(level, label, gate, template.replace("{n}", f"(?:{name})").replace("{i}", f"(?:{identifier})"), weight))
    return sorted(dict.fromkeys(found), key=lambda r: r.level)


def spaced(pattern: str) -> str:
    """The pattern over text in which every word has a space of its own on both sides."""
    wide = pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    return f" {wide} "
