"""Signatures of licenses: one regular expression a line, over words in lower case divided by single blanks.

A line is label and expression.  Sections give priority and confidence, and order lines: of rules with one
keyword the first that matches at a place wins.  LIC stands for license in both spellings, VER for what
stands before a version.  All sentences are quoted from the licenses' own texts and usual notices.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

LIC, VER = "licen[cs]e", "(?: version| ver| v)? v?"


@dataclass(frozen=True)
class Signature:
    """label where pattern matches; priority decides overlaps, confidence the score."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


# Machine-readable tags and the addresses of license texts.
_TAGS = """
gpl-2.0-or-later    spdx LIC identifier gpl 2 0 or later
gpl-2.0-only        spdx LIC identifier gpl 2 0(?: only)?
gpl-3.0-or-later    spdx LIC identifier gpl 3 0 or later
gpl-3.0-only        spdx LIC identifier gpl 3 0(?: only)?
lgpl-2.1-or-later   spdx LIC identifier lgpl 2 1 or later
lgpl-2.1-only       spdx LIC identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later   spdx LIC identifier lgpl 3 0 or later
lgpl-3.0-only       spdx LIC identifier lgpl 3 0(?: only)?
agpl-3.0-or-later   spdx LIC identifier agpl 3 0 or later
agpl-3.0-only       spdx LIC identifier agpl 3 0(?: only)?
apache-2.0          spdx LIC identifier apache 2 0
mit-0               spdx LIC identifier mit 0
mit                 spdx LIC identifier mit
bsd-2-clause        spdx LIC identifier bsd 2 clause
bsd-3-clause        spdx LIC identifier bsd 3 clause
0bsd                spdx LIC identifier 0bsd
isc                 spdx LIC identifier isc
mpl-2.0             spdx LIC identifier mpl 2 0
epl-2.0             spdx LIC identifier epl 2 0
epl-1.0             spdx LIC identifier epl 1 0
cddl-1.0            spdx LIC identifier cddl 1 0
eupl-1.2            spdx LIC identifier eupl 1 2
zlib                spdx LIC identifier zlib
bsl-1.0             spdx LIC identifier bsl 1 0
unlicense           spdx LIC identifier unlicense
wtfpl               spdx LIC identifier wtfpl
cc0-1.0             spdx LIC identifier cc0 1 0
cc-by-nc-nd-4.0     spdx LIC identifier cc by nc nd 4 0
cc-by-nc-sa-4.0     spdx LIC identifier cc by nc sa 4 0
cc-by-sa-4.0        spdx LIC identifier cc by sa 4 0
cc-by-nc-4.0        spdx LIC identifier cc by nc 4 0
cc-by-4.0           spdx LIC identifier cc by 4 0
ofl-1.1             spdx LIC identifier ofl 1 1
artistic-2.0        spdx LIC identifier artistic 2 0
apache-2.0          www apache org licenses license 2 0
apache-1.1          www apache org licenses license 1 1
gpl                 www gnu org (?:copyleft|licenses) (?:old licenses )?gpl(?: 2 0| 3 0)?
lgpl                www gnu org (?:copyleft|licenses) (?:old licenses )?(?:lgpl|lesser)(?: 2 1| 3 0)?
agpl                www gnu org licenses agpl(?: 3 0)?
gfdl                www gnu org (?:copyleft|licenses) fdl(?: 1 [123])?
mpl-2.0             (?:www )?mozilla org mpl 2 0
mpl-1.1             (?:www )?mozilla org mpl(?: mpl 1 1)?
epl                 (?:www )?eclipse org legal epl v(?:10|20)
bsl-1.0             (?:www )?boost org license 1 0 txt
unlicense           (?:www )?unlicense org
wtfpl               (?:www )?wtfpl net
ofl-1.1             scripts sil org ofl
mit                 (?:www )?opensource org licenses mit(?: license)?
bsd                 (?:www )?opensource org licenses bsd(?: [23] clause| license)?
isc                 (?:www )?opensource org licenses isc
cc0-1.0             creativecommons org publicdomain zero 1 0
public-domain       creativecommons org (?:publicdomain mark 1 0|licenses publicdomain)
cc-by-nc-nd         creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-sa         creativecommons org licenses by nc sa [1234] [05]
cc-by-sa            creativecommons org licenses by sa [1234] [05]
cc-by-nd            creativecommons org licenses by nd [1234] [05]
cc-by-nc            creativecommons org licenses by nc [1234] [05]
cc-by               creativecommons org licenses by [1234] [05]
"""

# Sentences of license texts that no other license has.
_BODIES = """
mit                 permission is hereby granted free of charge to any person obtaining a copy of this software
mit                 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0               to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-advertising     this permission notice shall be included in all copies of the software and its copyright notices in addition publicly documented acknowledgment
x11                 except as contained in this notice the name of the x consortium shall not be used in advertising
isc                 permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that
0bsd                permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd                permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
ntp                 permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsd-4-clause        all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause        neither the names? of (?:[^ ]+ ){1,20}(?:nor|or) the names of (?:its|their|any) contributors may be used to endorse or promote
bsd-3-clause        the names? of (?:[^ ]+ ){1,20}may not be used to endorse or promote products derived from this software
bsd                 redistribution and use in source and binary forms with or without modification are permitted
bsd                 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd                 redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-1-clause        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided
apache-1.1          the end user documentation included with the redistribution if any must include the following acknowledge?ment
apache-2.0          apache LIC version 2 0 january 2004
apache-2.0          each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) LIC
apache-2.0          derivative works that you distribute must include a readable copy of the attribution notices contained within such notice file
gpl-1.0             gnu general public LIC version 1 february 1989
gpl-2.0             gnu general public LIC version 2 june 1991
gpl-3.0             gnu general public LIC version 3 29 june 2007
lgpl-2.0            gnu library general public LIC version 2 june 1991
lgpl-2.1            gnu lesser general public LIC version 2 1 february 1999
lgpl-3.0            gnu lesser general public LIC version 3 29 june 2007
agpl-3.0            gnu affero general public LIC version 3 19 november 2007
gfdl-1.3            gnu free documentation LIC version 1 3 3 november 2008
gfdl-1.2            gnu free documentation LIC version 1 2 november 2002
gpl                 the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0             the licenses for most software and other practical works are designed to take away your freedom to share
gpl                 you may not impose any further restrictions on the recipients exercise of the rights granted herein
gpl                 you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl-3.0             you may convey verbatim copies of the program s source code as you receive it
lgpl                a program that contains no derivative of any portion of the library but is designed to work with the library
agpl-3.0            must prominently offer all users interacting with it remotely through a computer network
mpl-1.1             any modifications which you create or to which you contribute are governed by the terms of this LIC
mpl-2.0             all distribution of covered software in source code form including any modifications that you create
mpl-2.0             incompatible with secondary licenses means
epl                 each contributor hereby grants recipient a non exclusive worldwide royalty free (?:copyright|patent) LIC
cddl-1.0            any covered software that you distribute or otherwise make available in executable form must also be made available in source code form
cpl-1.0             the accompanying program is provided under the terms of this common public LIC
ms-pl               each contributor grants you a non exclusive worldwide royalty free copyright LIC to reproduce its contribution prepare derivative works
ms-rl               reciprocal grants for any file you distribute that contains code from the software
artistic-1.0        the intent of this document is to state the conditions under which a package may be copied
artistic-2.0        this LIC establishes the terms under which a given free software package may be copied modified distributed and or redistributed
zlib                the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib                permission is granted to anyone to use this software for any purpose including commercial applications and to alter it
libpng              if you modify libpng you may insert additional notices
bsl-1.0             boost software LIC version 1 0 august 17th 2003
bsl-1.0             permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this LIC
unlicense           this is free and unencumbered software released into the public domain
wtfpl               do what the f[^ ]{1,4} you want to
beerware            if we meet some day and you think this stuff is worth it you can buy me a beer
postgresql          permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
python-2.0          this LIC agreement is between the python software foundation psf and the individual or organization
php-3.01            products derived from this software may not be called php nor may php appear in their name
ruby                you may distribute the software in object code or binary form provided that you do at least one of the following
openssl             this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1             the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces
ofl-1.1             no modified version of the font software may use the reserved font name
cc0-1.0             affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc0-1.0             has waived all copyright and related or neighboring rights
cc-by               you may distribute publicly display publicly perform or publicly digitally perform the work only under the terms of this LIC
cc-by               you must give appropriate credit provide a link to the LIC and indicate if changes were made
cc-by-sa            if you remix transform or build upon the material you must distribute your contributions under the same LIC
cc-by-nc            you may not use the material for commercial purposes
cc-by-nd            if you remix transform or build upon the material you may not distribute the modified material
odbl-1.0            you must include a notice associated with the produced work reasonably calculated to make any person aware that content was obtained from the database
elastic-2.0         you may not provide the software to third parties as a hosted or managed service
sspl-1.0            the service source code means the corresponding source for the program or the modified version
bsl-business        the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
commons-clause      the software is provided to you by the licensor under the LIC as defined below subject to the following condition
"""

# Notices that put a work under a license, dual licensing and exceptions included.
_NOTICES = """
gpl-2.0-or-later    under the terms of the gnu general public LIC as published by the free software foundation either version 2 of the LIC or at your option any later version
gpl-3.0-or-later    under the terms of the gnu general public LIC as published by the free software foundation either version 3 of the LIC or at your option any later version
gpl-2.0-only        under the terms of the gnu general public LIC version 2(?: only)? as published by the free software foundation
lgpl-2.1-or-later   under the terms of the gnu lesser general public LIC as published by the free software foundation either version 2 1 of the LIC or at your option any later version
lgpl-3.0-or-later   under the terms of the gnu lesser general public LIC as published by the free software foundation either version 3 of the LIC or at your option any later version
lgpl-2.0-or-later   under the terms of the gnu library general public LIC as published by the free software foundation either version 2 of the LIC or at your option any later version
agpl-3.0-or-later   under the terms of the gnu affero general public LIC as published by the free software foundation either version 3 of the LIC or at your option any later version
gpl                 you should have received a copy of the gnu general public LIC along with
lgpl                you should have received a copy of the gnu lesser general public LIC along with
agpl                you should have received a copy of the gnu affero general public LIC along with
gpl                 (?:distributed|released|licen[cs]ed|available|covered|published) (?:under|by) (?:the )?(?:terms of )?(?:the )?gnu general public LIC(?: gpl)?
lgpl                (?:distributed|released|licen[cs]ed|available|covered|published) (?:under|by) (?:the )?(?:terms of )?(?:the )?gnu lesser general public LIC(?: lgpl)?
agpl                (?:distributed|released|licen[cs]ed|available|covered|published) (?:under|by) (?:the )?(?:terms of )?(?:the )?gnu affero general public LIC(?: agpl)?
gfdl                permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
gpl-font-exception  as a special exception if you create a document which uses this font
gpl-bison-exception as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl-classpath       linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception       gcc runtime library exception(?: version)?
llvm-exception      apache LIC v2 0 with llvm exceptions?
autoconf-exception  as a special exception to the gnu general public LIC if you distribute this file as part of a program that contains a configuration script generated by autoconf
apache-2.0          licensed under the apache LIC version 2 0 the LIC you may not use this file except in compliance with the LIC
apache-2.0          you may not use this file except in compliance with the LIC
apache-2.0          (?:distributed|released|licen[cs]ed|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? LICVER2(?: 0)?
apache              (?:distributed|released|licen[cs]ed|available|provided) under (?:the )?(?:terms of )?(?:the |an )?apache(?: software)? LIC
apache-or-mit       (?:dual )?licen[cs]ed under (?:either )?(?:the )?apache(?: LIC)?(?:VER2(?: 0)?)? (?:or|and) (?:the )?mit(?: LIC)?
mit-or-gpl          (?:dual |dually )licen[cs]ed under (?:the )?mit (?:and|or) (?:the )?gpl(?: licen[cs]es)?
mit                 (?:distributed|released|licen[cs]ed|available|provided) under (?:the )?(?:terms of )?(?:the |an )?(?:permissive )?mit LIC
mit                 (?:this )?(?:code|project|software|package|library|work) is mit licen[cs]ed
bsd-3-clause        (?:distributed|released|licen[cs]ed|available|provided) under (?:the )?(?:terms of )?(?:the |an? )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: LIC)?
bsd-2-clause        (?:distributed|released|licen[cs]ed|available|provided) under (?:the )?(?:terms of )?(?:the |an? )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: LIC)?
bsd                 (?:distributed|released|licen[cs]ed|available|provided) under (?:the )?(?:terms of )?(?:the |an? )?bsd(?: style)? LIC
bsd                 use of this source code is governed by a bsd style LIC that can be found in the LIC file
mpl-2.0             this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-1.1             the contents of this file are subject to the mozilla public LIC version 1 1
mpl-1.1-gpl-lgpl    alternatively the contents of this file may be used under the terms of either the gnu general public LIC
epl-1.0             made available under the terms of the eclipse public LIC v(?:ersion)? ?1 0
epl-2.0             made available under the terms of the eclipse public LIC (?:v(?:ersion)? ?)?2 0
cddl                the contents of this file are subject to the terms of the common development and distribution LIC
eupl-1.2            licen[cs]ed under the (?:eupl|european union public LIC)
perl                (?:you can redistribute it and or modify it|free software you can redistribute) (?:it )?under the same terms as perl itself
ruby                (?:distributed|released|licen[cs]ed) under (?:the )?(?:same terms as )?ruby(?: s)?(?: LIC)?
bsl-1.0             distributed under the boost software LIC version 1 0
zlib                (?:distributed|released|licen[cs]ed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? LIC
isc                 (?:distributed|released|licen[cs]ed|available) under (?:the )?(?:terms of )?(?:the )?isc LIC
unlicense           (?:distributed|released|licen[cs]ed|available) under (?:the )?unlicense
cc0-1.0             (?:distributed|released|licen[cs]ed|available|dedicated) (?:under|using|with) (?:the )?(?:creative commons )?cc0
cc-by-nc-nd         licen[cs]ed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa         licen[cs]ed under (?:a |the )?creative commons attribution non ?commercial share ?alike
cc-by-nc            licen[cs]ed under (?:a |the )?creative commons attribution non ?commercial
cc-by-sa            licen[cs]ed under (?:a |the )?creative commons attribution share ?alike
cc-by-nd            licen[cs]ed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s
cc-by               licen[cs]ed under (?:a |the )?creative commons attribution
cc-by-sa            (?:licen[cs]ed|released|available|published) under (?:the )?cc by sa(?: [1234] [05])?
cc-by-nc            (?:licen[cs]ed|released|available|published) under (?:the )?cc by nc(?: [1234] [05])?
cc-by               (?:licen[cs]ed|released|available|published) under (?:the )?cc by(?: [1234] [05])?
public-domain       (?:dedicated|released|placed|put|donated) (?:in|in ?to|to) the public domain
public-domain       this (?:work|file|code|software|text|image) is in the public domain
public-domain       the authors? (?:hereby )?disclaims? (?:all )?copyright to this source code
odbl-1.0            made available under the open database LIC
ofl-1.1             this font software is licensed under the sil open font LIC
sspl-1.0            under the terms of the server side public LIC
elastic             licen[cs]ed under the elastic LIC
proprietary         all rights reserved
proprietary         proprietary and confidential
proprietary         this (?:software|document|file) contains confidential (?:and proprietary )?information of
proprietary         unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document)(?: via any medium)? is (?:strictly )?prohibited
proprietary         end user LIC agreement
proprietary         for personal(?: and)? non ?commercial use only
proprietary         no part of this (?:publication|book|document|work) may be reproduced
"""

# Names with a version or a clause that tells licenses of one family apart.
_VERSIONS = """
gpl-3.0             gnu general public LICVER3(?: 0)?
gpl-2.0             gnu general public LICVER2(?: 0)?
gpl-1.0             gnu general public LICVER1(?: 0)?
gpl-3.0             (?:gnu )?gplVER3(?: 0)?(?: or later| only)?
gpl-3.0             (?:gnu )?gplv?3(?: 0)?(?: or later| only)?
gpl-2.0             (?:gnu )?gplVER2(?: 0)?(?: or later| only)?
gpl-2.0             (?:gnu )?gplv?2(?: 0)?(?: or later| only)?
lgpl-3.0            gnu lesser general public LICVER3(?: 0)?
lgpl-2.1            gnu lesser general public LICVER2 1
lgpl-2.0            gnu library general public LICVER2(?: 0)?
lgpl-3.0            lgplVER3(?: 0)?
lgpl-2.1            lgplVER2 1
lgpl-3.0            lgplv3
lgpl-2.1            lgplv2 1
agpl-3.0            gnu affero general public LICVER3(?: 0)?
agpl-3.0            agpl(?:VER|v)3(?: 0)?
gfdl-1.3            gnu free documentation LICVER1 3
gfdl-1.2            gnu free documentation LICVER1 2
gfdl-1.1            gnu free documentation LICVER1 1
apache-2.0          apache(?: software)? LICVER2(?: 0)?
apache-2.0          apache 2(?: 0)?(?: LIC)?
apache-1.1          apache(?: software)? LICVER1 1
apache-1.0          apache(?: software)? LICVER1 0
mpl-2.0             mozilla public LICVER2 0
mpl-1.1             mozilla public LICVER1 1
mpl-1.0             mozilla public LICVER1 0
epl-2.0             eclipse public LICVER2 0
epl-1.0             eclipse public LICVER1 0
cddl-1.1            common development and distribution LICVER1 1
cddl-1.0            common development and distribution LICVER1 0
eupl-1.2            european union public LICVER1 2
eupl-1.1            european union public LICVER1 1
artistic-2.0        artistic LICVER2 0
artistic-1.0        artistic LICVER1 0
bsl-1.0             boost software LICVER1 0
ofl-1.1             (?:sil )?open font LICVER1 1
ofl-1.0             (?:sil )?open font LICVER1 0
afl-3.0             academic free LICVER3 0
afl-2.1             academic free LICVER2 1
odbl-1.0            open database LICVER1 0
osl-3.0             open software LICVER3 0
python-2.0          python software foundation LICVER2
php-3.01            php LICVER3 01
zpl-2.1             zope public LICVER2 1
cpl-1.0             common public LICVER1 0
mit-0               mit no attribution(?: LIC)?
bsd-4-clause        bsd 4 clause(?: LIC)?
bsd-4-clause        (?:4 clause|four clause|original) bsd(?: LIC)?
bsd-3-clause        bsd 3 clause(?: LIC)?
bsd-3-clause        (?:3 clause|three clause|new|modified|revised) bsd(?: LIC)?
bsd-2-clause        bsd 2 clause(?: LIC)?
bsd-2-clause        (?:2 clause|two clause|simplified) bsd(?: LIC)?
bsd-2-clause        freebsd LIC
0bsd                zero clause bsd(?: LIC)?
0bsd                0bsd(?: LIC)?
cc-by-nc-nd         cc by nc nd(?: [1234] [05])?
cc-by-nc-sa         cc by nc sa(?: [1234] [05])?
cc-by-nc            cc by nc(?: [1234] [05])?
cc-by-sa            cc by sa(?: [1234] [05])?
cc-by-nd            cc by nd(?: [1234] [05])?
cc-by-4.0           cc by 4 0
cc-by-3.0           cc by 3 0
cc-by-2.5           cc by 2 5
cc-by-2.0           cc by 2 0
cc-by-nc-nd         creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?
cc-by-nc-sa         creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc            creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-sa            creative commons attribution share ?alike(?: [1234] [05])?
cc-by-nd            creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?
cc-by-4.0           creative commons attribution 4 0(?: international)?
cc-by-3.0           creative commons attribution 3 0(?: unported)?
cc0-1.0             cc0VER1 0(?: universal)?
cc0-1.0             creative commons zero(?:VER1 0)?
"""

# Bare names.
_NAMES = """
gpl                 gnu general public LIC
gpl                 (?:gnu )?gpl
lgpl                gnu lesser general public LIC
lgpl                gnu library general public LIC
lgpl                (?:gnu )?lgpl
agpl                gnu affero general public LIC
agpl                (?:gnu )?agpl
gfdl                gnu free documentation LIC
apache              apache(?: software)? LIC
mpl                 mozilla public LIC
epl                 eclipse public LIC
cddl                common development and distribution LIC
eupl                european union public LIC
artistic            artistic LIC
bsl                 boost software LIC
ms-pl               microsoft public LIC
ms-rl               microsoft reciprocal LIC
ofl                 (?:sil )?open font LIC
afl                 academic free LIC
osl                 open software LIC
odbl                open database LIC
zpl                 zope public LIC
cpl                 common public LIC
qpl                 q public LIC
ipl                 ibm public LIC
sspl                server side public LIC
elastic             elastic LIC
bsl-business        business source LIC
commons-clause      commons clause
mit                 mit LIC
x11                 x11 LIC
isc                 isc LIC
zlib                zlib(?: libpng)? LIC
libpng              libpng LIC
bsd                 bsd(?: style)? LIC
openssl             openssl LIC
php                 php LIC
python              python software foundation LIC
postgresql          postgresql LIC
ruby                ruby LIC
vim                 vim LIC
beerware            beer ?ware LIC
wtfpl               wtfpl
unlicense           (?:the )?unlicense
cc-by               cc by
cc0                 cc0
cc                  creative commons LIC
"""

#: Sections with priority and confidence, the surest first.
SECTIONS = ((_TAGS, 4, 1.0), (_BODIES, 4, 0.9), (_NOTICES, 3, 0.95), (_VERSIONS, 2, 0.8), (_NAMES, 1, 0.6))
#: Beginnings of words that gate rules, the rarest first: a rule's keyword is the first that each of its
#: matches holds.
KEYWORDS = (
    "spdx", "creativecommons", "opensource", "gnu org", "gnu lesser", "gnu affero", "gnu free", "gnu library", "gnu general", "creative commons", "cc by", "cc0", "lgpl", "agpl", "gpl",
    "apache", "mozilla", "eclipse", "boost", "mit lic", "bsd", "0bsd", "redistribut", "is hereby granted", "permission", "public domain", "wtfpl", "zlib", "isc lic", "unlicense",
    "font", "endorse", "rights reserved", "confidential", "covered", "derivative", "software", "licen", "copyright", "library", "advertis", "distribut", "exception",
    "material", "what the f", "no part of", "personal", "further restrictions", "scripts sil", "commons clause", "perl itself", "affirmer", "database", "remotely",
    "attribution", "prohibited", "verbatim cop", "libpng", "source code", "under ", "beer", "x consortium", "accompanying program",
)


def keyword_of(pattern: str) -> str:
    """The first of KEYWORDS that begins a word of a pattern outside brackets, so one of each of its matches."""
    plain, depth = " ", 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == ")" and pattern[i - 1] in " " and pattern[i + 1 : i + 2] in ("", "?"):
            plain += " "  # a bracket that ends with a blank
        elif depth == 0 and c not in ")?" and pattern[i + 1 : i + 2] not in ("?", "*"):
            plain += c
        else:
            plain += "\n"
    if "|" in plain:
        raise ValueError(f"an alternative outside brackets has no keyword: {pattern}")
    return next(k for k in KEYWORDS if " " + k in plain or " \n" + k in plain)


def gate(keywords: Iterable[str]) -> str:
    """A regular expression for a word that begins with one of the keywords, told apart by first letters."""
    by: dict[str, list[str]] = {}
    for k in sorted(set(keywords)):
        by.setdefault(k[0], []).append(k[1:])
    return f" (?:{'|'.join(first + '(?:' + '|'.join(rest) + ')' for first, rest in by.items())})"


def signatures() -> list[Signature]:
    """All rules in order."""
    out = []
    for text, priority, confidence in SECTIONS:
        for line in text.strip("\n").split("\n"):
            label, pattern = line[:20].strip(), line[20:]
            keyword = keyword_of(pattern.replace("LIC", "licen\n").replace("VER", "\n"))
            out.append(Signature(label, keyword, pattern.replace("LIC", LIC).replace("VER", VER), priority, confidence))
    return out
