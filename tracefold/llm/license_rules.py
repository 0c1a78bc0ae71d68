"""Signature rules of the license scan.

A rule is (label, priority, keyword, pattern). Patterns are Java regular
expressions over a normal form of the text: A-Z lower-cased, every run of other
characters than letters, digits and non-ASCII characters turned into two spaces,
with one space before the first word and after the last. So ``W`` below, two
spaces, stands between words, and a rule can only begin and end at words.
A rule is tried only on texts that hold its keyword, one of few per family.
Where a wording leaves room, the room is part of the rule: up to six words in
``PLAIN``, up to eight before "any later version".
"""

from __future__ import annotations

W = "  "

#: Families with versions: label, keyword, the name's wordings, versions, and a
#: label for "or any later version" where the family has that clause.
VERSIONED = [
    ("apache", "apache", ["apache license", "apache software license", "apache public license"], ["1.0", "1.1", "2.0"]),
    ("gpl", "general  public  license", ["gnu general public license", "the general public license"], ["1", "2", "3", "1.0", "2.0", "3.0"]),
    ("lgpl", "lesser  general  public", ["gnu lesser general public license", "lesser general public license"], ["2.1", "3", "3.0"]),
    ("lgpl", "library  general  public", ["gnu library general public license", "library general public license"], ["2", "2.0"]),
    ("agpl", "affero", ["gnu affero general public license", "affero general public license"], ["1", "1.0", "3", "3.0"]),
    ("fdl", "free  documentation", ["gnu free documentation license"], ["1.1", "1.2", "1.3"]),
    ("mpl", "mozilla", ["mozilla public license"], ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", ["eclipse public license"], ["1.0", "2.0"]),
    ("cpl", "common  public", ["common public license"], ["0.5", "1.0"]),
    ("cddl", "development  and  distribution", ["common development and distribution license"], ["1.0", "1.1"]),
    ("eupl", "european  union", ["european union public licence", "european union public license"], ["1.0", "1.1", "1.2"]),
    ("osl", "open  software", ["open software license"], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", "academic  free", ["academic free license"], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic", ["artistic license"], ["1.0", "2.0"]),
    ("ofl", "sil  open", ["sil open font license"], ["1.0", "1.1"]),
    ("bsl", "boost", ["boost software license"], ["1.0"]),
    ("zpl", "zope", ["zope public license"], ["1.1", "2.0", "2.1"]),
    ("php", "php", ["php license"], ["2.02", "3.0", "3.01"]),
    ("lppl", "latex  project", ["latex project public license"], ["1.0", "1.1", "1.2", "1.3", "1.3a", "1.3c"]),
    ("odbl", "open  database", ["open database license"], ["1.0"]),
    ("odc-by", "open  data  commons", ["open data commons attribution license"], ["1.0"]),
    ("ncsa", "illinois", ["university of illinois ncsa open source license"], ["1.0"]),
    ("psf", "python", ["python software foundation license"], ["1", "2"]),
    ("psf", "psf  license", ["psf license agreement"], ["1", "2"]),
    ("ecl", "educational  community", ["educational community license"], ["1.0", "2.0"]),
    ("busl", "business  source", ["business source license"], ["1.0", "1.1"]),
    ("sspl", "server  side", ["server side public license"], ["1", "1.0"]),
    ("elastic", "elastic", ["elastic license"], ["1.0", "2.0"]),
    ("ipl", "ibm  public", ["ibm public license"], ["1.0"]),
    ("apsl", "apple", ["apple public source license"], ["1.0", "1.1", "1.2", "2.0"]),
    ("ms-pl", "microsoft  public", ["microsoft public license"], ["1.0"]),
    ("ms-rl", "microsoft  reciprocal", ["microsoft reciprocal license"], ["1.0"]),
    ("cecill", "cecill", ["cecill free software license agreement", "licence cecill"], ["1.0", "1.1", "2.0", "2.1"]),
]

#: Creative Commons: parts in short and long wording, for each version.
CC_PARTS = [("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives")]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: SPDX ids that may follow "spdx license identifier".
SPDX = ["0bsd", "afl 3.0", "agpl 3.0 only", "agpl 3.0 or later", "apache 2.0", "artistic 2.0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "bsl 1.0", "cc by 4.0", "cc by sa 4.0", "cc0 1.0", "cddl 1.0", "epl 1.0", "epl 2.0", "eupl 1.2", "gpl 2.0 only", "gpl 2.0 or later", "gpl 3.0 only", "gpl 3.0 or later", "isc", "lgpl 2.1 only", "lgpl 2.1 or later", "lgpl 3.0 only", "lgpl 3.0 or later", "mit", "mit 0", "mpl 2.0", "ncsa", "odbl 1.0", "ofl 1.1", "osl 3.0", "postgresql", "python 2.0", "unlicense", "upl 1.0", "wtfpl", "x11", "zlib", "zpl 2.1"]

#: Rules written out: label, priority, keyword, wording. "~" allows up to six words between.
PLAIN = [
    ("mit", 60, "mit  license", "mit license"),
    ("mit", 70, "mit  license", "released under the mit license"),
    ("mit", 70, "mit  license", "licensed under the mit license"),
    ("mit", 70, "mit  license", "the mit license mit"),
    ("mit", 90, "permission  is  hereby  granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 90, "permission  to  use", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", 60, "isc  license", "isc license"),
    ("bsd", 50, "bsd  license", "bsd license"),
    ("bsd-2-clause", 60, "bsd", "bsd 2 clause license"),
    ("bsd-2-clause", 60, "bsd", "simplified bsd license"),
    ("bsd-3-clause", 60, "bsd", "bsd 3 clause license"),
    ("bsd-3-clause", 60, "bsd", "new bsd license"),
    ("bsd-3-clause", 60, "bsd", "revised bsd license"),
    ("bsd-3-clause", 60, "bsd", "modified bsd license"),
    ("bsd-4-clause", 60, "bsd", "bsd 4 clause license"),
    ("bsd-4-clause", 60, "bsd", "original bsd license"),
    ("bsd", 80, "redistribution  and  use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 90, "endorse", "neither the name of ~ may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 95, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("zlib", 90, "altered  source", "altered source versions must be plainly marked as such"),
    ("zlib", 60, "zlib", "zlib license"),
    ("unlicense", 90, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 60, "unlicense", "the unlicense"),
    ("cc0", 60, "cc0", "cc0"),
    ("cc0", 80, "cc0", "cc0 1 0 universal"),
    ("cc0", 80, "public  domain", "public domain dedication"),
    ("public-domain", 50, "public  domain", "in the public domain"),
    ("public-domain", 50, "public  domain", "into the public domain"),
    ("wtfpl", 80, "wtfpl", "wtfpl"),
    ("wtfpl", 90, "what  the", "do what the fuck you want to public license"),
    ("beerware", 90, "beer", "beer ware license"),
    ("x11", 60, "x11", "x11 license"),
    ("postgresql", 60, "postgresql", "postgresql license"),
    ("openssl", 60, "openssl", "openssl license"),
    ("ruby", 60, "ruby", "ruby license"),
    ("perl", 60, "perl", "same terms as perl itself"),
    ("upl", 60, "universal  permissive", "universal permissive license"),
    ("0bsd", 60, "bsd", "bsd zero clause license"),
    ("json", 80, "good  not  evil", "shall be used for good not evil"),
    ("commons-clause", 80, "commons  clause", "commons clause license condition"),
    ("proprietary", 40, "proprietary", "proprietary and confidential"),
    ("proprietary", 40, "confidential", "confidential and proprietary"),
    ("proprietary", 40, "without  permission", "may not be reproduced ~ without permission"),
    ("proprietary", 40, "written  permission", "without the prior written permission of"),
    ("reserved", 30, "rights  reserved", "all rights reserved"),
    ("reserved", 30, "rights  reserved", "some rights reserved"),
    ("reserved", 30, "rechte  vorbehalten", "alle rechte vorbehalten"),
    ("reserved", 30, "droits", "tous droits réservés"),
    ("reserved", 30, "derechos  reservados", "todos los derechos reservados"),
    ("copyright", 10, "copyright", "copyright c ~ {year}"),
    ("copyright", 10, "copyright", "copyright {year}"),
    ("copyright", 10, "copyright", "copyright ©"),
    # clauses and notices of whole license texts
    ("mit", 85, "permission  notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 80, "permission  notice", "this permission notice shall be included in all copies"),
    ("mit", 85, "to  deal", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit-0", 80, "mit  no  attribution", "mit no attribution"),
    ("isc", 80, "author  disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("curl", 92, "with  or  without", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("hpnd", 85, "without  fee", "permission to use copy modify and distribute this software and its documentation for any purpose ~ without fee"),
    ("postgresql", 90, "written  agreement", "without fee and without a written agreement is hereby granted"),
    ("bsd", 80, "redistributions  of", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 80, "redistributions  in", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 80, "by  the  copyright", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause", 85, "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-protection", 60, "bsd", "bsd protection license"),
    ("zlib", 85, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", 85, "held  liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 85, "removed  or  altered", "this notice may not be removed or altered from any source distribution"),
    ("libpng", 90, "png  reference", "the png reference library is supplied as is"),
    ("ijg", 90, "jpeg  group", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", 90, "freetype", "portions of this software are copyright ~ the freetype project"),
    ("freetype", 60, "freetype", "freetype project license"),
    ("openssl", 90, "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", 90, "eric  young", "this product includes cryptographic software written by eric young"),
    ("apache", 80, "apache", "you may obtain a copy of the license at ~ apache org licenses license"),
    ("apache", 85, "in  compliance", "you may not use this file except in compliance with the license"),
    ("apache", 70, "apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 90, "apache", "this product includes software developed by the apache software foundation"),
    ("apache-2.0", 60, "apache", "apache license v2"),
    ("apache-2.0", 60, "apache", "apache 2 license"),
    ("gpl", 85, "redistribute  it", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 80, "copy  of  the  gnu", "you should have received a copy of the gnu general public license along with"),
    ("gpl", 60, "gnu  gpl", "gnu gpl"),
    ("gpl-2", 65, "gplv2", "gplv2"),
    ("gpl-3", 65, "gplv3", "gplv3"),
    ("lgpl", 85, "redistribute  it", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", 80, "copy  of  the  gnu", "you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl", 60, "gnu  lgpl", "gnu lgpl"),
    ("lgpl-2.1", 65, "lgplv2", "lgplv2 1"),
    ("lgpl-3", 65, "lgplv3", "lgplv3"),
    ("agpl", 85, "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", 80, "interacting  with", "all users interacting with it remotely through a computer network"),
    ("classpath-exception", 90, "special  exception", "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gcc-exception", 90, "runtime  library  exception", "gcc runtime library exception"),
    ("fdl", 85, "invariant  sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 90, "source  code  form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", 85, "subject  to  the", "the contents of this file are subject to the mozilla public license"),
    ("epl", 85, "accompanying  materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 85, "subject  to  the", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", 90, "anyone  is  free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 80, "unlicense", "please refer to ~ unlicense org"),
    ("wtfpl", 90, "what  the", "you just do what the fuck you want to"),
    ("beerware", 92, "buy  me", "you think this stuff is worth it you can buy me a beer in return"),
    ("charityware", 60, "charityware", "charityware"),
    ("cc0", 90, "under  law", "to the extent possible under law ~ has waived all copyright"),
    ("cc", 30, "creative  commons", "this work is licensed under a creative commons"),
    ("cc", 30, "creative  commons", "licensed under creative commons"),
    ("ofl", 90, "font  software", "this font software is licensed under the sil open font license"),
    ("ofl", 80, "reserved  font", "with reserved font name"),
    ("artistic", 85, "perl", "this program is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("php", 90, "php", "this source file is subject to version ~ of the php license"),
    ("psf", 90, "licensee  on  an", "psf is making python available to licensee on an as is basis"),
    ("ruby", 85, "clause  bsdl", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("proprietary", 60, "strictly  prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 60, "strictly  prohibited", "unauthorized use or distribution is strictly prohibited"),
    ("proprietary", 60, "trade  secret", "contains trade secrets of"),
    ("proprietary", 60, "confidential", "this software is the confidential and proprietary information of"),
    ("proprietary", 40, "be  reproduced", "no part of this ~ may be reproduced"),
    ("proprietary", 40, "internal  use", "for internal use only"),
    ("eula", 50, "end  user", "end user license agreement"),
    ("non-commercial", 50, "commercial  use", "for non commercial use only"),
    ("non-commercial", 50, "commercial  purposes", "may not be used for commercial purposes"),
    ("personal-use", 50, "personal  use", "for personal use only"),
    ("patent", 30, "patent  license", "hereby grants ~ a perpetual worldwide non exclusive no charge royalty free irrevocable patent license"),
    ("warranty", 5, "warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty", 5, "warranties", "basis without warranties or conditions of any kind either express or implied"),
    ("reserved", 30, "diritti", "tutti i diritti riservati"),
    ("reserved", 30, "direitos", "todos os direitos reservados"),
    ("reserved", 30, "rechten", "alle rechten voorbehouden"),
    ("copyright", 10, "portions  copyright", "portions copyright ~ {year}"),
    ("copyright", 10, "droit  d  auteur", "droit d auteur {year}"),
    ("copyright", 10, "urheberrecht", "urheberrecht ~ {year}"),
    ("gpl-or-later", 85, "any  later  version", "either version 2 ~ or at your option any later version"),
    ("gpl-or-later", 85, "any  later  version", "either version 3 ~ or at your option any later version"),
    ("warranty", 5, "warranty", "without warranty of any kind"),
    ("warranty", 5, "warranties", "without warranties or conditions of any kind"),
    ("permissive", 20, "licensed  under", "licensed under the same terms"),
    ("unknown-license", 1, "licensed  under", "licensed under ~ license"),
    ("unknown-license", 1, "released  under", "released under ~ license"),
    ("unknown-license", 1, "distributed  under", "distributed under ~ license"),
]

#: The phrases that every scan looks for, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def _words(wording: str) -> str:
    out = W.join(wording.split())
    return out.replace("~" + W, "(?:[^ ]+" + W + "){0,6}").replace("{year}", "(?:19|20)[0-9]{2}")


def _number(version: str) -> str:
    return W.join(version.split("."))


#: A grant may lead a named license; with it the match also covers what the rules for unnamed licenses find.
GRANT = f"(?:(?:licensed|released|distributed|available|covered|published){W}under{W}(?:the{W}|a{W})?)?"


def rules() -> list[tuple[str, int, str, str]]:
    """All rules, several hundred: (label, priority, keyword, pattern)."""
    out = [(label, priority, keyword, " " + ("" if priority < 5 else GRANT) + _words(text) + " ") for label, priority, keyword, text in PLAIN]
    for label, keyword, names, versions in VERSIONED:
        for name in names:
            out.append((label, 40, keyword, f" {GRANT}{_words(name)} "))
            for v in versions:
                out.append((f"{label}-{v.removesuffix('.0') if label in ('gpl', 'lgpl', 'agpl') else v}", 60, keyword, f" {GRANT}{_words(name)}{W}(?:version{W}|v{W}|v)?{_number(v)} "))
            out.append((f"{label}-or-later", 75, keyword, f" {GRANT}{_words(name)}{W}(?:[^ ]+{W}){{0,8}}any{W}later{W}version "))
    for short, long in CC_PARTS:
        tag = "cc-" + short.replace(" ", "-")
        out.append((tag, 40, "cc  by", f" {GRANT}cc{W}{_words(short)} "))
        out.append((tag, 40, "creative  commons", f" {GRANT}creative{W}commons{W}{_words(long)}(?:{W}[0-9])? "))
        for v in CC_VERSIONS:
            out.append((f"{tag}-{v}", 60, "cc  by", f" {GRANT}cc{W}{_words(short)}{W}{_number(v)} "))
            out.append((f"{tag}-{v}", 60, "creative  commons", f" {GRANT}creative{W}commons{W}{_words(long)}{W}{_number(v)} "))
    for name in SPDX:
        out.append((name.replace(" ", "-"), 100, "spdx", f" spdx{W}license{W}identifier{W}{W.join(name.replace('.', ' ').split())} "))
    return out
