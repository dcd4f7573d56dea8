"""Signatures of licenses, in order: ``priority | label | keyword | pattern`` a line.

Patterns are regular expressions over normalised words (a-z, 0-9 and non-ASCII, A-Z lower-cased) with single spaces
between them; they match whole words and hold no capturing groups. A rule's pattern is only tried where its keyword, words of
which the last may be a beginning only, stands in the text. Priorities: 4 a notice that grants or a whole title with its
version, 3 a name with version, 2 a name, 1 a phrase of a family, 0 a clue. Rules under ``base`` always stay."""
from __future__ import annotations

from typing import NamedTuple

BASE = """
1 | cc-by | cc by | cc by
1 | gpl | general public license | general public license
1 | reserved | all rights reserved | all rights reserved
"""

SIGNATURES = r"""
4 | apache-2.0 | apache | licensed (?:under|with) the apache license (?:version )?2 0
4 | apache-2.0 | apache | licensed under the apache license version 2 0 the license
4 | apache-2.0 | apache org | (?:https? )?www apache org licenses license 2 0
3 | apache-2.0 | apache | apache (?:software )?license (?:version |v)?2(?: 0)?
3 | apache-2.0 | apache | apache 2(?: 0)? licen[cs]e
3 | apache-2.0 | apache | spdx license identifier apache 2 0
3 | apache-1.1 | apache | apache (?:software )?license (?:version |v)?1 1
3 | apache-1.0 | apache | apache (?:software )?license (?:version |v)?1 0
2 | apache | apache | apache (?:software )?licen[cs]e
2 | apache | apache | licensed under (?:the )?apache
4 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
4 | mit | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies
4 | mit | mit licen | (?:released|licensed|distributed|available) under the (?:terms of the )?mit licen[cs]e
3 | mit | identifier mit | spdx license identifier mit
3 | mit | the mit | the mit licen[cs]e mit
2 | mit | mit licen | (?:the )?mit licen[cs]e
2 | mit | expat licen | (?:the )?expat licen[cs]e
2 | mit | expat licen | expat licen[cs]e
2 | mit-0 | mit no attribution | mit no attribution
2 | mit-0 | mit 0 | mit 0 licen[cs]e
1 | mit | licensed under | licensed under (?:the )?mit
2 | x11 | x11 | (?:mit )?x11 (?:style )?licen[cs]e
3 | isc | identifier isc | spdx license identifier isc
2 | isc | isc licen | (?:the )?isc licen[cs]e
4 | isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4 | bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
4 | bsd-3-clause | neither the name | neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse
4 | bsd-2-clause | redistribution | redistributions? (?:of|in) source code must retain the above copyright notice
4 | bsd-2-clause | redistribution | redistributions? in binary form must reproduce the above copyright notice
3 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
3 | bsd-4-clause | bsd | (?:4|four) clause bsd(?: licen[cs]e)?
3 | bsd-3-clause | bsd | (?:3|three) clause bsd(?: licen[cs]e)?
3 | bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[cs]e)?
3 | bsd-0-clause | bsd | (?:0|zero) clause bsd(?: licen[cs]e)?
3 | bsd-4-clause | bsd | bsd 4 clause(?: licen[cs]e)?
3 | bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
3 | bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
3 | bsd-0-clause | 0bsd | 0bsd
3 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e
3 | bsd-2-clause | simplified | simplified (?:bsd )?licen[cs]e
3 | bsd-2-clause | freebsd | freebsd licen[cs]e
3 | bsd-4-clause | bsd | (?:original|old) bsd licen[cs]e
2 | bsd | bsd | (?:the )?bsd (?:style |like )?licen[cs]e
1 | bsd | bsd | licensed under (?:the )?(?:terms of (?:the )?)?bsd
4 | gpl-3.0-or-later | general public license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
4 | gpl-2.0-or-later | general public license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
4 | gpl-3.0 | general public license | gnu general public license as published by the free software foundation version 3
4 | gpl-2.0 | general public license | gnu general public license as published by the free software foundation version 2
4 | gpl | general public license | (?:licensed|released|distributed) under (?:the terms of )?the gnu general public license
3 | gpl-3.0-or-later | general public license | general public license (?:version |v)?3(?: 0)? or (?:any )?later(?: version)?
3 | gpl-2.0-or-later | general public license | general public license (?:version |v)?2(?: 0)? or (?:any )?later(?: version)?
3 | gpl-3.0 | general public license | (?:gnu )?general public license (?:version |v)?3(?: 0)?
3 | gpl-2.0 | general public license | (?:gnu )?general public license (?:version |v)?2(?: 0)?
3 | gpl-1.0 | general public license | (?:gnu )?general public license (?:version |v)?1(?: 0)?
3 | gpl-3.0-or-later | gpl 3 | spdx license identifier gpl 3 0 or later
3 | gpl-3.0 | gpl 3 | spdx license identifier gpl 3 0(?: only)?
3 | gpl-2.0-or-later | gpl 2 | spdx license identifier gpl 2 0 or later
3 | gpl-2.0 | gpl 2 | spdx license identifier gpl 2 0(?: only)?
3 | gpl-3.0-or-later | gplv3 | gplv3 or (?:any )?later
3 | gpl-2.0-or-later | gplv2 | gplv2 or (?:any )?later
3 | gpl-3.0 | gplv3 | (?:gnu )?gplv3
3 | gpl-2.0 | gplv2 | (?:gnu )?gplv2
3 | gpl-3.0 | gpl | (?:gnu )?gpl (?:version |v)?3(?: 0)?
3 | gpl-2.0 | gpl | (?:gnu )?gpl (?:version |v)?2(?: 0)?
2 | gpl | gpl | (?:gnu )?gpl licen[cs]e
2 | gpl | gnu general public | gnu general public licen[cs]e
1 | gpl | gnu gpl | gnu gpl
3 | gpl-classpath | classpath exception | (?:gpl (?:2 0 )?)?(?:with )?classpath exception(?: 2 0)?
3 | gpl-gcc-exception | runtime library exception | gcc runtime library exception(?: 3 1)?
3 | gpl-linking | linking exception | (?:gpl )?(?:with )?linking exception
4 | lgpl | lesser general public | (?:licensed|released|distributed) under (?:the terms of )?the gnu lesser general public license
4 | lgpl-2.1-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
4 | lgpl-3.0-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
3 | lgpl-3.0 | lesser general public | (?:gnu )?lesser general public license (?:version |v)?3(?: 0)?
3 | lgpl-2.1 | lesser general public | (?:gnu )?lesser general public license (?:version |v)?2 1
3 | lgpl-2.0 | library general public | (?:gnu )?library general public license (?:version |v)?2(?: 0)?
3 | lgpl-3.0 | lgpl | (?:gnu )?lgpl(?: )?(?:version |v)?3(?: 0)?
3 | lgpl-2.1 | lgpl | (?:gnu )?lgpl (?:version |v)?2 1
3 | lgpl-3.0 | lgplv3 | lgplv3
3 | lgpl-2.1 | lgplv2 | lgplv2 1
2 | lgpl | lesser general public | (?:gnu )?lesser general public licen[cs]e
2 | lgpl | library general public | (?:gnu )?library general public licen[cs]e
2 | lgpl | lgpl | (?:gnu )?lgpl(?: licen[cs]e)?
4 | agpl | affero general public | (?:licensed|released|distributed) under (?:the terms of )?the gnu affero general public license
4 | agpl-3.0-or-later | affero general public | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
3 | agpl-3.0 | affero general public | (?:gnu )?affero general public license (?:version |v)?3(?: 0)?
3 | agpl-1.0 | affero general public | affero general public license (?:version |v)?1(?: 0)?
3 | agpl-3.0 | agpl | (?:gnu )?agpl (?:version |v)?3(?: 0)?
3 | agpl-3.0 | agplv3 | agplv3
2 | agpl | affero general public | (?:gnu )?affero general public licen[cs]e
2 | agpl | agpl | (?:gnu )?agpl(?: licen[cs]e)?
3 | gfdl-1.3 | free documentation | (?:gnu )?free documentation license (?:version |v)?1 3
3 | gfdl-1.2 | free documentation | (?:gnu )?free documentation license (?:version |v)?1 2
3 | gfdl-1.1 | free documentation | (?:gnu )?free documentation license (?:version |v)?1 1
2 | gfdl | free documentation | (?:gnu )?free documentation licen[cs]e
2 | gfdl | gfdl | (?:gnu )?gfdl
4 | cc-by-4.0 | attribution 4 | (?:licensed under (?:a |the )?)?creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-3.0 | attribution 3 | (?:licensed under (?:a |the )?)?creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
4 | cc-by-2.5 | attribution 2 | (?:licensed under (?:a |the )?)?creative commons attribution 2 5(?: generic)?(?: licen[cs]e)?
4 | cc-by-2.0 | attribution 2 | (?:licensed under (?:a |the )?)?creative commons attribution 2 0(?: generic)?(?: licen[cs]e)?
4 | cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-sa-3.0 | sharealike | creative commons attribution sharealike 3 0(?: unported)?(?: licen[cs]e)?
4 | cc-by-sa-2.5 | sharealike | creative commons attribution sharealike 2 5(?: generic)?(?: licen[cs]e)?
4 | cc-by-sa-4.0 | share alike | creative commons attribution share alike 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-sa-3.0 | share alike | creative commons attribution share alike 3 0(?: unported)?(?: licen[cs]e)?
4 | cc-by-nc-4.0 | attribution non | creative commons attribution non(?: )?commercial 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-nc-3.0 | attribution non | creative commons attribution non(?: )?commercial 3 0(?: unported)?(?: licen[cs]e)?
4 | cc-by-nc-sa-4.0 | attribution non | creative commons attribution non(?: )?commercial share(?: )?alike 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-nc-sa-3.0 | attribution non | creative commons attribution non(?: )?commercial share(?: )?alike 3 0(?: unported)?(?: licen[cs]e)?
4 | cc-by-nc-nd-4.0 | attribution non | creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s(?: works)? 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-nc-nd-3.0 | attribution non | creative commons attribution non(?: )?commercial no(?: )?deriv(?:ative)?s(?: works)? 3 0(?: unported)?(?: licen[cs]e)?
4 | cc-by-nd-4.0 | attribution no | creative commons attribution no(?: )?deriv(?:ative)?s(?: works)? 4 0(?: international)?(?: licen[cs]e)?
4 | cc-by-nd-3.0 | attribution no | creative commons attribution no(?: )?deriv(?:ative)?s(?: works)? 3 0(?: unported)?(?: licen[cs]e)?
3 | cc-by-4.0 | cc by 4 | (?:licensed under )?cc by 4 0
3 | cc-by-3.0 | cc by 3 | (?:licensed under )?cc by 3 0
3 | cc-by-2.5 | cc by 2 | (?:licensed under )?cc by 2 5
3 | cc-by-2.0 | cc by 2 | (?:licensed under )?cc by 2 0
3 | cc-by-sa-4.0 | cc by sa | (?:licensed under )?cc by sa 4 0
3 | cc-by-sa-3.0 | cc by sa | (?:licensed under )?cc by sa 3 0
3 | cc-by-sa-2.5 | cc by sa | (?:licensed under )?cc by sa 2 5
3 | cc-by-nc-4.0 | cc by nc | (?:licensed under )?cc by nc 4 0
3 | cc-by-nc-3.0 | cc by nc | (?:licensed under )?cc by nc 3 0
3 | cc-by-nd-4.0 | cc by nd | (?:licensed under )?cc by nd 4 0
3 | cc-by-nd-3.0 | cc by nd | (?:licensed under )?cc by nd 3 0
3 | cc-by-nc-sa-4.0 | cc by nc sa | (?:licensed under )?cc by nc sa 4 0
3 | cc-by-nc-sa-3.0 | cc by nc sa | (?:licensed under )?cc by nc sa 3 0
3 | cc-by-nc-nd-4.0 | cc by nc nd | (?:licensed under )?cc by nc nd 4 0
3 | cc-by-nc-nd-3.0 | cc by nc nd | (?:licensed under )?cc by nc nd 3 0
2 | cc-by-nc-sa | cc by nc sa | cc by nc sa
2 | cc-by-nc-nd | cc by nc nd | cc by nc nd
2 | cc-by-sa | cc by sa | cc by sa
2 | cc-by-nc | cc by nc | cc by nc
2 | cc-by-nd | cc by nd | cc by nd
3 | cc-by-sa | creativecommons org | (?:https? )?creativecommons org licenses by sa(?: \d \d)?
3 | cc-by-nc | creativecommons org | (?:https? )?creativecommons org licenses by nc(?: \d \d)?
3 | cc-by-nd | creativecommons org | (?:https? )?creativecommons org licenses by nd(?: \d \d)?
3 | cc-by-nc-sa | creativecommons org | (?:https? )?creativecommons org licenses by nc sa(?: \d \d)?
3 | cc-by-nc-nd | creativecommons org | (?:https? )?creativecommons org licenses by nc nd(?: \d \d)?
2 | cc-by | creativecommons org | (?:https? )?creativecommons org licenses by(?: \d \d)?
2 | cc-by | creative commons | creative commons attribution(?: licen[cs]e)?
2 | cc-by-sa | creative commons | creative commons attribution share(?: )?alike(?: licen[cs]e)?
2 | cc-by-nc | creative commons | creative commons attribution non(?: )?commercial(?: licen[cs]e)?
2 | cc-by | cc by | licensed under (?:a |the )?cc by(?: licen[cs]e)?
1 | cc | creative commons | (?:a )?creative commons licen[cs]e
4 | cc0-1.0 | cc0 | cc0 1 0(?: universal)?(?: public domain dedication)?
3 | cc0-1.0 | creativecommons org | (?:https? )?creativecommons org publicdomain zero 1 0
2 | cc0-1.0 | cc0 | cc0
2 | cc-pdm | public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
4 | unlicense | unencumbered software | this is free and unencumbered software released into the public domain
2 | unlicense | unlicense | (?:the )?unlicense
3 | public-domain | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
1 | public-domain | public domain | (?:in )?the public domain
2 | pddl-1.0 | public domain dedication | public domain dedication and licen[cs]e
2 | wtfpl | want to public license | do what the (?:\S+ ){1,2}you want to public license
2 | wtfpl | wtfpl | wtfpl
4 | mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
3 | mpl-2.0 | mozilla public | mozilla public license (?:version |v )?2(?: 0)?
3 | mpl-1.1 | mozilla public | mozilla public license (?:version |v )?1 1
3 | mpl-1.0 | mozilla public | mozilla public license (?:version |v )?1 0
3 | mpl-2.0 | mpl | mpl (?:v)?2 0
3 | mpl-1.1 | mpl | mpl (?:v)?1 1
2 | mpl | mozilla public | mozilla public licen[cs]e
3 | epl-2.0 | eclipse public | eclipse public license (?:version |v )?2(?: 0)?
3 | epl-1.0 | eclipse public | eclipse public license (?:version |v )?1(?: 0)?
2 | epl | eclipse public | eclipse public licen[cs]e
3 | edl-1.0 | eclipse distribution | eclipse distribution license (?:version |v )?1(?: 0)?
2 | edl | eclipse distribution | eclipse distribution licen[cs]e
3 | cddl-1.1 | common development | common development and distribution license (?:version |v )?1 1
3 | cddl-1.0 | common development | common development and distribution license (?:version |v )?1 0
2 | cddl | common development | common development and distribution licen[cs]e
2 | cddl | cddl | cddl(?: 1 [01])?
3 | cpl-1.0 | common public | common public license (?:version |v )?1 0
2 | cpl | common public | common public licen[cs]e
3 | eupl-1.2 | european union public | european union public licen[cs]e (?:version |v )?1 2
3 | eupl-1.1 | european union public | european union public licen[cs]e (?:version |v )?1 1
2 | eupl | european union public | european union public licen[cs]e
2 | eupl | eupl | eupl(?: 1 [12])?
3 | osl-3.0 | open software | open software license (?:version |v )?3 0
2 | osl | open software | open software licen[cs]e
3 | afl-3.0 | academic free | academic free license (?:version |v )?3 0
2 | afl | academic free | academic free licen[cs]e
3 | artistic-2.0 | artistic licen | artistic license (?:version |v )?2(?: 0)?
3 | artistic-1.0 | artistic licen | artistic license (?:version |v )?1(?: 0)?
2 | artistic | artistic licen | (?:the )?artistic licen[cs]e
3 | perl | same terms as perl | (?:under )?the same terms as perl itself
3 | bsl-1.0 | boost software | boost software license (?:version |v )?1 0
2 | bsl | boost software | boost software licen[cs]e
3 | busl-1.1 | business source | business source license (?:version |v )?1 1
2 | busl | business source | business source licen[cs]e
3 | sspl-1.0 | server side public | server side public license (?:version |v )?1
2 | sspl | server side public | server side public licen[cs]e
3 | elastic-2.0 | elastic licen | elastic license (?:version |v )?2(?: 0)?
2 | elastic | elastic licen | elastic licen[cs]e
2 | zlib | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
4 | zlib | provided as is | this software is provided as is without any express or implied warranty
2 | libpng | libpng | (?:the )?libpng licen[cs]e
2 | curl | curl licen | (?:the )?curl licen[cs]e
3 | openssl | openssl | openssl (?:combined )?licen[cs]e
3 | ssleay | ssleay | (?:original )?ssleay licen[cs]e
2 | php-3.01 | php licen | php license (?:version |v )?3 01
2 | php | php licen | (?:the )?php licen[cs]e
2 | psf-2.0 | python software foundation | python software foundation licen[cs]e(?: version 2)?
2 | python | python licen | (?:the )?python licen[cs]e
2 | ruby | ruby licen | (?:the )?ruby licen[cs]e
2 | postgresql | postgresql licen | (?:the )?postgresql licen[cs]e
2 | ncsa | ncsa | (?:university of illinois )?(?:ncsa )?open source licen[cs]e ncsa
2 | ncsa | ncsa | (?:the )?ncsa (?:open source )?licen[cs]e
3 | ms-pl | microsoft public | microsoft public licen[cs]e(?: ms pl)?
3 | ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)?
2 | ms-pl | ms pl | ms pl
2 | upl-1.0 | universal permissive | universal permissive licen[cs]e(?: (?:version |v )?1 0)?
2 | blueoak-1.0.0 | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
2 | ecl-2.0 | educational community | educational community licen[cs]e(?: (?:version )?2 0)?
2 | ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: (?:version )?1 1)?
2 | bitstream-vera | bitstream vera | bitstream vera (?:fonts? )?(?:copyright|licen[cs]e)
3 | odbl-1.0 | open database | open (?:data commons open )?database licen[cs]e(?: (?:version |v)?1 0)?
3 | odc-by-1.0 | open data commons | open data commons attribution licen[cs]e(?: (?:version |v)?1 0)?
2 | odbl | odbl | odbl
3 | ogl-3.0 | open government | open government licen[cs]e (?:version |v)?3(?: 0)?
3 | ogl-2.0 | open government | open government licen[cs]e (?:version |v)?2(?: 0)?
2 | ogl | open government | open government licen[cs]e
3 | etalab-2.0 | licence ouverte | licence ouverte(?: (?:version )?2 0)?
3 | dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung(?: (?:version )?2 0)?
3 | dl-de-zero-2.0 | datenlizenz | datenlizenz deutschland zero(?: (?:version )?2 0)?
2 | dl-de | datenlizenz | datenlizenz deutschland
3 | cecill-2.1 | cecill | (?:licence )?cecill (?:version )?2 1
3 | cecill-b | cecill | (?:licence )?cecill b
3 | cecill-c | cecill | (?:licence )?cecill c
2 | cecill | cecill | (?:licence )?cecill
3 | openrail-m | openrail | (?:creativeml )?openrail m(?: licen[cs]e)?
2 | openrail | openrail | openrail(?: licen[cs]e)?
2 | beerware | beer | (?:the )?beer(?: )?ware licen[cs]e
2 | json | software shall be used for good | the software shall be used for good not evil
3 | proprietary | proprietary and confidential | (?:this \S+ is )?proprietary and confidential
2 | proprietary | unauthori | unauthori[sz]ed copying of this (?:file|document|work)(?: via any medium)? is strictly prohibited
2 | proprietary | may not be reproduced | may not be reproduced (?:\S+ ){0,8}without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
2 | proprietary | no part of this | no part of this (?:publication|book|document|work) may be (?:reproduced|copied)
1 | proprietary | end user licen | end user licen[cs]e agreement
1 | proprietary | commercial licen | (?:under )?(?:a )?commercial licen[cs]e
2 | reserved | tous droits | tous droits r(?:é|e)serv(?:é|e)s
2 | reserved | alle rechte | alle rechte vorbehalten
2 | reserved | derechos reservados | todos los derechos reservados
2 | reserved | copyright | copyright (?:\S+ ){1,8}all rights reserved
1 | copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
0 | copyright | copyright | copyright notice
0 | warranty | warranty | without warranty of any kind
0 | warranty | warrant | (?:express or implied )?warrant(?:y|ies) of merchantability
0 | unknown-license | under the terms of | (?:licensed|released|distributed) under the terms of
0 | unknown-license | see the | see the (?:\S+ )?license file
0 | unknown-license | spdx | spdx license identifier
0 | unknown-license | open source licen | (?:an )?open source licen[cs]e
"""


class Rule(NamedTuple):
    number: int
    base: bool
    priority: int
    label: str
    keyword: str
    pattern: str


def parsed(lines: str, base: bool = False, after: int = 0) -> list[Rule]:
    """Rules of a table, numbered from ``after`` in order."""
    rules = []
    for k, line in enumerate(filter(str.strip, lines.splitlines())):
        priority, label, keyword, pattern = (part.strip() for part in line.split(" | ", 3))
        rules.append(Rule(after + k, base, int(priority), label, keyword, pattern))
    return rules


RULES = parsed(BASE, base=True)
RULES += parsed(SIGNATURES, after=len(RULES))
