"""The signature rules of the license scan, one a line: label | priority | keyword | pattern.

Patterns are over the words of a text in lower case with one blank between them; marks count as blanks, so
"GPL-3.0-or-later" reads "gpl 3 0 or later". Every match of a pattern holds its keyword. Priorities: 90 what a
license's own text says, 80 notices that grant it, 70 addresses, 60 identifiers, 50 titles, 40 and 30 mere traces.
No pattern repeats without a bound.
"""

from __future__ import annotations

import re

# Phrases of public license texts, notices and identifiers.
RULES = """
mit|90|free of charge|permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit|90|deal in the software|to deal in the software without restriction(?: including without limitation the rights to use copy modify merge publish distribute)?
mit|80|substantial portions|(?:the above copyright notice and )?this permission notice shall be included in all copies or substantial portions of the software
mit|80| mit |(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?mit(?: license| licence)?
mit|80| mit |subject to (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit|70|opensource org|opensource org licenses? mit
mit|60| mit |spdx license identifier mit
mit|60| mit |license mit
mit|50| mit |(?:the )?mit licen[sc]e
mit|50| expat |(?:the )?expat licen[sc]e
mit-0|80|mit no attribution|(?:the )?mit no attribution(?: license)?
mit-0|60| mit 0 |(?:spdx license identifier |license )?mit 0
x11|60| x11 |(?:the )?x11 licen[sc]e
x11|90|x consortium|except as contained in this notice the name of the x consortium shall not be used
bsd|90|source and binary forms|redistribution and use in source and binary forms with or without modification are permitted
bsd|80|redistributions of source|redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?
bsd|80|redistributions in binary|redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?
bsd|80| bsd |(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: license| licence)?
bsd|70|opensource org|opensource org licenses? bsd license(?: php)?
bsd|50| bsd |(?:the )?bsd(?: style)? licen[sc]e
bsd|40|copyright holders and contributors|this software is provided by the (?:copyright holders|regents) and contributors as is
bsd-2-clause|60| bsd 2 |(?:spdx license identifier )?bsd 2 clause(?: license)?
bsd-2-clause|60|simplified bsd|(?:the )?simplified bsd licen[sc]e
bsd-2-clause|60|freebsd license|(?:the )?freebsd license
bsd-2-clause|70|opensource org|opensource org licenses? bsd 2 clause
bsd-3-clause|90|endorse or promote|neither the name of [a-z0-9 ]{1,60} may be used to endorse or promote products derived from this software
bsd-3-clause|60| bsd 3 |(?:spdx license identifier )?bsd 3 clause(?: license)?
bsd-3-clause|60|new bsd|(?:the )?new bsd licen[sc]e
bsd-3-clause|60|modified bsd|(?:the )?modified bsd licen[sc]e
bsd-3-clause|60|revised bsd|(?:the )?revised bsd licen[sc]e
bsd-3-clause|70|opensource org|opensource org licenses? bsd 3 clause
bsd-4-clause|90|advertising materials|all advertising materials mentioning features or use of this software must display
bsd-4-clause|60| bsd 4 |(?:spdx license identifier )?bsd 4 clause(?: license)?
bsd-4-clause|60|original bsd|(?:the )?original bsd licen[sc]e
0bsd|60| 0bsd |(?:spdx license identifier )?0bsd
0bsd|60|zero clause bsd|(?:the )?zero clause bsd(?: license)?
0bsd|80|with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|80|permission to use copy|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc|90|above copyright notice and this permission|provided that the above copyright notice and this permission notice appear in all copies
isc|80| isc |(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?isc(?: license)?
isc|60| isc |(?:spdx license identifier|license) isc
isc|50| isc |(?:the )?isc licen[sc]e
isc|70|opensource org|opensource org licenses? isc
apache-2.0|90|apache license version 2|licensed under the apache license version 2 0(?: the license)?
apache-2.0|90|in compliance with the license|you may not use this file except in compliance with the license
apache-2.0|90|specific language governing|see the license for the specific language governing permissions and limitations under the license
apache-2.0|90|as is basis|distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0|90|grant of patent license|grant of patent license subject to the terms and conditions of this license
apache-2.0|80| apache |(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)?(?: version)?(?: v)? 2(?: 0)?
apache-2.0|70|apache org|apache org licenses license 2 0
apache-2.0|70|opensource org|opensource org licenses? apache 2 0
apache-2.0|60| apache 2 |(?:spdx license identifier |license )?apache 2 0
apache-2.0|60| apache |(?:the )?apache licen[sc]e(?: version)?(?: v)? 2(?: 0)?
apache-1.1|60| apache |(?:the )?apache(?: software)? licen[sc]e(?: version)? 1 1
apache-1.1|90|apache software foundation|this product includes software developed by the apache software foundation
apache-1.0|60| apache |(?:the )?apache(?: software)? licen[sc]e(?: version)? 1 0
apache|50| apache |(?:the )?apache(?: software)? licen[sc]e
apache|40|apache org|www apache org licenses
gpl|90|free software you can redistribute|is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl|80|published by the free software|general public license as published by the free software foundation
gpl|80|hope that it will be useful|distributed in the hope that it will be useful but without any warranty without even the implied warranty of
gpl|80|you should have received|you should have received a copy of the gnu general public license(?: along with this)?
gpl|80|general public license|(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license
gpl|80| gpl |(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl|70|gnu org|gnu org (?:licenses|copyleft) gpl(?: html| txt)?
gpl|60|gnu gpl|(?:the )?gnu gpl
gpl|50| gpl |(?:the )?gpl licen[sc]ed?
gpl|50|gnu general public|(?:the )?gnu general public license
gpl|40|later version|either version [123] of the license or at your option any later version
gpl-2.0|90|version 2 june 1991|gnu general public license version 2 june 1991
gpl-2.0|80|general public license|(?:under )?(?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?
gpl-2.0|60| gpl |(?:gnu )?gpl(?: version)?(?: v)? 2(?: 0)?(?: only)?
gpl-2.0|60| gplv2 |(?:gnu )?gplv2
gpl-2.0|70|gnu org|gnu org licenses(?: old licenses)? gpl 2 0
gpl-2.0-or-later|60| gpl 2 |(?:gnu )?gpl 2 0 or later
gpl-2.0-or-later|60| gplv2 |(?:gnu )?gplv2 or later
gpl-3.0|90|version 3 29 june|gnu general public license version 3 29 june 2007
gpl-3.0|80|general public license|(?:under )?(?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
gpl-3.0|60| gpl |(?:gnu )?gpl(?: version)?(?: v)? 3(?: 0)?(?: only)?
gpl-3.0|60| gplv3 |(?:gnu )?gplv3
gpl-3.0|70|gnu org|gnu org licenses gpl 3 0
gpl-3.0-or-later|60| gpl 3 |(?:gnu )?gpl 3 0 or later
gpl-3.0-or-later|60| gplv3 |(?:gnu )?gplv3 or later
gpl-1.0|60| gpl |(?:gnu )?gpl(?: version)?(?: v)? 1(?: 0)?
gpl-exception|60|classpath exception|(?:with |gnu )?(?:the )?classpath exception
gpl-exception|60|gcc runtime library|gcc runtime library exception
lgpl|90|lesser general public|modify it under the terms of the gnu lesser general public license
lgpl|80|lesser general public|you should have received a copy of the gnu lesser general public license
lgpl|80|lesser general public|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public license
lgpl|80| lgpl |(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl|70|gnu org|gnu org (?:licenses|copyleft) lgpl(?: html| txt)?
lgpl|50|lesser general public|(?:the )?(?:gnu )?lesser general public license
lgpl|50|library general public|(?:the )?(?:gnu )?library general public license
lgpl|50| lgpl |(?:the )?(?:gnu )?lgpl
lgpl-2.1|60|lesser general public|(?:the )?(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-2.1|60| lgpl |(?:gnu )?lgpl(?: version)?(?: v)? 2 1(?: only| or later)?
lgpl-2.1|60| lgplv2 |(?:gnu )?lgplv2(?: 1)?
lgpl-3.0|60|lesser general public|(?:the )?(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
lgpl-3.0|60| lgpl |(?:gnu )?lgpl(?: version)?(?: v)? 3(?: 0)?(?: only| or later)?
lgpl-3.0|60| lgplv3 |(?:gnu )?lgplv3
lgpl-2.0|60|library general public|(?:gnu )?library general public license(?: version)? 2(?: 0)?
agpl|90|affero general public|modify it under the terms of the gnu affero general public license
agpl|80|affero general public|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public license
agpl|80| agpl |(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl|90|remote network interaction|remote network interaction use with the gnu general public license
agpl|70|gnu org|gnu org licenses agpl(?: 3 0)?
agpl|50|affero general public|(?:the )?(?:gnu )?affero general public license
agpl|50| agpl |(?:the )?(?:gnu )?agpl
agpl-3.0|60|affero general public|(?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
agpl-3.0|60| agpl |(?:gnu )?agpl(?: version)?(?: v)? 3(?: 0)?(?: only| or later)?
agpl-3.0|60| agplv3 |(?:gnu )?agplv3
fdl|60|free documentation license|(?:the )?(?:gnu )?free documentation license(?: version)?(?: 1 [0-3])?
fdl|90|invariant sections|with no invariant sections no front cover texts and no back cover texts
fdl|60| gfdl |(?:gnu )?gfdl(?: 1 [0-3])?
mpl|90|source code form is subject|this source code form is subject to the terms of the mozilla public license
mpl|80|mozilla public|(?:licensed|released|distributed|available|published|provided|subject) (?:under|to) (?:the )?(?:terms of )?(?:the )?mozilla public license
mpl|90|if a copy of the mpl|if a copy of the mpl was not distributed with this file you can obtain one at
mpl|70|mozilla org|mozilla org (?:en us )?(?:mpl|foundation licensing)
mpl|50|mozilla public|(?:the )?mozilla public licen[sc]e
mpl-2.0|60|mozilla public|(?:the )?mozilla public license(?: version)?(?: v)? 2 0
mpl-2.0|60| mpl 2 |(?:spdx license identifier |license )?mpl 2 0
mpl-2.0|70|mozilla org|mozilla org mpl 2 0
mpl-1.1|60|mozilla public|(?:the )?mozilla public license(?: version)? 1 1
mpl-1.1|60| mpl 1 |mpl 1 1
mpl-1.1|90|contents of this file are subject|the contents of this file are subject to the mozilla public license
epl|90|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public license
epl|80|eclipse public|(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?eclipse public license
epl|70|eclipse org|eclipse org (?:legal|org documents) epl
epl|50|eclipse public|(?:the )?eclipse public licen[sc]e
epl-1.0|60|eclipse public|(?:the )?eclipse public license(?: version)?(?: v)? 1 0
epl-1.0|60| epl 1 |epl 1 0
epl-2.0|60|eclipse public|(?:the )?eclipse public license(?: version)?(?: v)? 2 0
epl-2.0|60| epl 2 |epl 2 0
cpl|60|common public license|(?:the )?common public license(?: version)?(?: 1 0)?
ipl|60|ibm public license|(?:the )?ibm public license(?: version)?(?: 1 0)?
cddl|80|common development and distribution|subject to the terms of the common development and distribution license
cddl|50|common development and distribution|(?:the )?common development and distribution license
cddl-1.0|60| cddl 1 |cddl 1 0
cddl-1.0|60|common development and distribution|common development and distribution license(?: cddl)?(?: version)? 1 0
cddl-1.1|60| cddl 1 |cddl 1 1
eupl|80|european union public|(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?european union public licen[sc]e
eupl|50|european union public|(?:the )?european union public licen[sc]e
eupl|70|joinup ec europa|joinup ec europa eu [a-z0-9 ]{0,40}eupl
eupl-1.1|60| eupl |eupl(?: version)?(?: v)? 1 1
eupl-1.2|60| eupl |eupl(?: version)?(?: v)? 1 2
cecill|60| cecill |(?:the )?cecill(?: [bc])?(?: license)?(?: version)?(?: [12] [01])?
cecill|90|french law|governed by the cecill license under french law
artistic|50|artistic license|(?:the )?artistic license
artistic-2.0|60|artistic license|(?:the )?artistic license(?: version)? 2 0
artistic-2.0|60| artistic 2 |artistic 2 0
artistic-1.0|60|artistic license|(?:the )?artistic license(?: version)? 1 0
perl|80|terms as perl|(?:under )?the same terms as perl (?:5 )?itself
zlib|90|misrepresented|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|90|altered source versions|altered source versions must be plainly marked as such and must not be misrepresented
zlib|80| zlib |(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)?(?: license)?
zlib|50| zlib |(?:the )?zlib(?: libpng)? licen[sc]e
libpng|50| libpng |(?:the )?libpng licen[sc]e
boost|90|boost software license|distributed under the boost software license version 1 0
boost|90|accompanying documentation|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost|70|boost org|boost org license 1 0(?: txt)?
boost|60| bsl 1 |(?:spdx license identifier |license )?bsl 1 0
boost|50|boost software license|(?:the )?boost software licen[sc]e
unlicense|90|unencumbered|this is free and unencumbered software released into the public domain
unlicense|90|anyone is free to copy|anyone is free to copy modify publish use compile sell or distribute this software
unlicense|70|unlicense org|unlicense org
unlicense|50| unlicense |(?:the )?unlicense
wtfpl|90|what the fuck you want|do what the fuck you want to(?: public license)?
wtfpl|70|wtfpl net|wtfpl net
wtfpl|50| wtfpl |(?:the )?wtfpl(?: version 2| v2)?
beerware|60| beerware |(?:the )?beerware(?: license)?
beerware|90|buy me a beer|you can buy me a beer in return
cc0|90|public domain dedication|(?:creative commons )?(?:cc0 )?(?:1 0 )?(?:universal )?public domain dedication
cc0|80| cc0 |(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:creative commons )?cc0
cc0|70|publicdomain zero|creativecommons org publicdomain zero(?: 1 0)?
cc0|60| cc0 |(?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-pd|70|publicdomain mark|creativecommons org publicdomain mark(?: 1 0)?
cc-by|90|creative commons attribution|(?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution
cc-by|70|licenses by|creativecommons org licenses by(?: [1-4] [05])?
cc-by|60| cc by |(?:licensed|released|distributed|available|published) under (?:the )?cc by(?: licen[sc]e)?
cc-by|50|creative commons attribution|creative commons attribution(?: licen[sc]e)?
cc-by-4.0|60| cc by 4 |cc by 4 0
cc-by-4.0|60|creative commons attribution 4|creative commons attribution 4 0(?: international)?
cc-by-3.0|60| cc by 3 |cc by 3 0
cc-by-3.0|60|creative commons attribution 3|creative commons attribution 3 0(?: unported)?
cc-by-2.0|60| cc by 2 |cc by 2 [05]
cc-by-sa|70|licenses by sa|creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-sa|50|attribution sharealike|(?:creative commons )?attribution sharealike(?: licen[sc]e)?
cc-by-sa|50|attribution share alike|(?:creative commons )?attribution share alike(?: licen[sc]e)?
cc-by-sa|50| cc by sa |cc by sa
cc-by-sa-4.0|60| cc by sa 4 |cc by sa 4 0
cc-by-sa-4.0|60|sharealike 4|(?:creative commons )?attribution sharealike 4 0(?: international)?
cc-by-sa-3.0|60| cc by sa 3 |cc by sa 3 0
cc-by-sa-3.0|60|sharealike 3|(?:creative commons )?attribution sharealike 3 0(?: unported)?
cc-by-sa-2.5|60| cc by sa 2 |cc by sa 2 5
cc-by-nc|70|licenses by nc|creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nc|50|attribution noncommercial|(?:creative commons )?attribution noncommercial(?: licen[sc]e)?
cc-by-nc|50|attribution non commercial|(?:creative commons )?attribution non commercial(?: licen[sc]e)?
cc-by-nc|50| cc by nc |cc by nc
cc-by-nc-4.0|60| cc by nc 4 |cc by nc 4 0
cc-by-nc-4.0|60|noncommercial 4|(?:creative commons )?attribution noncommercial 4 0(?: international)?
cc-by-nc-3.0|60| cc by nc 3 |cc by nc 3 0
cc-by-nd|70|licenses by nd|creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nd|50|attribution noderiv|(?:creative commons )?attribution noderiv(?:s|atives)(?: licen[sc]e)?
cc-by-nd|50| cc by nd |cc by nd
cc-by-nd-4.0|60| cc by nd 4 |cc by nd 4 0
cc-by-nc-sa|70|licenses by nc sa|creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-sa|60|noncommercial sharealike|(?:creative commons )?attribution noncommercial sharealike(?: licen[sc]e)?
cc-by-nc-sa|60| cc by nc sa |cc by nc sa
cc-by-nc-sa-4.0|60| cc by nc sa 4 |cc by nc sa 4 0
cc-by-nc-sa-4.0|60|noncommercial sharealike 4|(?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?
cc-by-nc-sa-3.0|60| cc by nc sa 3 |cc by nc sa 3 0
cc-by-nc-nd|70|licenses by nc nd|creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-nd|60|noncommercial noderiv|(?:creative commons )?attribution noncommercial noderiv(?:s|atives)(?: licen[sc]e)?
cc-by-nc-nd|60| cc by nc nd |cc by nc nd
cc-by-nc-nd-4.0|60| cc by nc nd 4 |cc by nc nd 4 0
cc|40|some rights reserved|some rights reserved
cc|40|creative commons license|(?:a )?creative commons license
ofl|90|sil open font license|this font software is licensed under the sil open font license
ofl|70|scripts sil org|scripts sil org ofl
ofl|50|open font license|(?:the )?(?:sil )?open font license(?: version)?(?: 1 [01])?
ofl|60| ofl |(?:sil )?ofl 1 1
odbl|80|open database license|(?:made |is )?available under (?:the )?open database license
odbl|50|open database license|(?:the )?open database license(?: odbl)?
odbl|70|opendatacommons org|opendatacommons org licenses odbl(?: 1 0)?
odc-by|70|opendatacommons org|opendatacommons org licenses by(?: 1 0)?
odc-by|60|open data commons attribution|(?:the )?open data commons attribution license
pddl|70|opendatacommons org|opendatacommons org licenses pddl(?: 1 0)?
pddl|60|public domain dedication and license|(?:open data commons )?public domain dedication and license
ogl|60|open government licence|(?:the )?open government licence(?: version)?(?: v)?(?: [123] 0)?
etalab|60|licence ouverte|(?:etalab )?licence ouverte(?: open licence)?(?: version)?(?: [12] 0)?
python|60|python software foundation license|(?:the )?python software foundation license(?: version)?(?: 2)?
python|60| psf |psf license(?: agreement)?
python|70|docs python org|docs python org [a-z0-9 ]{0,20}license
php|60|php license|(?:the )?php license(?: version)?(?: 3 0[01]?)?
ruby|60|ruby license|(?:the )?ruby license
ruby|80|terms as ruby|(?:under )?the same terms as ruby(?: itself)?
w3c|60|w3c software|(?:the )?w3c software(?: notice)?(?: and)?(?: document)? license
ncsa|60|illinois ncsa|university of illinois ncsa open source license
openssl|60| openssl |(?:the )?openssl(?: ssleay)? license
openssl|90|openssl toolkit|this product includes software developed by the openssl project for use in the openssl toolkit
curl|60|curl license|(?:the )?curl license
ijg|90|independent jpeg group|this software is based in part on the work of the independent jpeg group
unicode|60|unicode license|(?:the )?unicode license(?: v3| agreement)?
ms-pl|60|microsoft public license|(?:the )?microsoft public license(?: ms pl)?
ms-rl|60|microsoft reciprocal license|(?:the )?microsoft reciprocal license(?: ms rl)?
osl|60|open software license|(?:the )?open software license(?: version)?(?: v)?(?: [123] [01])?
afl|60|academic free license|(?:the )?academic free license(?: version)?(?: v)?(?: [123] [01])?
qpl|60|q public license|(?:the )?q public license(?: version)?(?: 1 0)?
sleepycat|60|sleepycat license|(?:the )?sleepycat license
postgresql|60|postgresql license|(?:the )?postgresql licen[sc]e
nasa|60|nasa open source agreement|(?:the )?nasa open source agreement(?: version)?(?: 1 3)?
upl|60|universal permissive license|(?:the )?universal permissive license(?: upl)?(?: version)?(?: v)?(?: 1 0)?
blueoak|60|blue oak model license|(?:the )?blue oak model license(?: 1 0 0)?
mulan|60|mulan psl|(?:the )?mulan psl(?: v)?(?: [12])?
sspl|60|server side public license|(?:the )?server side public license(?: version)?(?: v)?(?: 1)?
busl|60|business source license|(?:the )?business source license(?: version)?(?: 1 1)?
elastic|60|elastic license|(?:the )?elastic license(?: version)?(?: 2 0)?
commons-clause|60|commons clause|(?:the )?commons clause(?: license)?(?: condition)?(?: v)?(?: 1 0)?
polyform|60| polyform |(?:the )?polyform (?:noncommercial|shield|strict|small business) license
hippocratic|60|hippocratic license|(?:the )?hippocratic license
openrail|60| openrail |(?:the )?(?:creativeml )?(?:bigscience )?openrail(?: m| s| d)?(?: license)?
llama|60|community license agreement|llama [0-9] (?:[0-9] )?community license agreement
json|90|good not evil|the software shall be used for good not evil
public-domain|80|public domain|(?:this (?:work|file|software|code) )?(?:is|has been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain|60|public domain|is in the public domain
public-domain|40|public domain|(?:a )?public domain (?:work|text|image|book)
dual|80|dual licensed|(?:is )?dual licensed under
dual|60|at your option|at your option under (?:the )?(?:terms of )?either
reserved|80|rights reserved|copyright (?:c )?(?:19|20)[0-9]{2} [a-z0-9 ]{1,60}all rights reserved
reserved|50|all rights|all rights (?:are )?reserved
reserved|50|alle rechte|alle rechte vorbehalten
reserved|50|tous droits|tous droits réservés
reserved|50|todos los derechos|todos los derechos reservados
copyright|30|copyright|copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright|30|copyright holder|the copyright holders?
proprietary|80|confidential and proprietary|(?:this [a-z]{1,20} is )?confidential and proprietary(?: information)?
proprietary|80|proprietary and confidential|proprietary and confidential
proprietary|60|prior written|without (?:the )?(?:express )?prior written (?:permission|consent) of
proprietary|60|without prior written|without prior written (?:permission|consent)
proprietary|80|strictly prohibited|unauthorized (?:copying|use|reproduction|distribution|duplication)[a-z ]{0,60}is strictly prohibited
proprietary|60|may not be reproduced|(?:no part of this [a-z]{1,20} )?may not be reproduced(?: distributed)?(?: or transmitted)?
proprietary|60|no part of this|no part of this (?:book|publication|document|work) may be reproduced
proprietary|60|end user license|end user license agreement
proprietary|60|personal use only|for personal use only
noncommercial|60|non commercial use|(?:for )?non commercial use only
noncommercial|60|noncommercial use|(?:for )?noncommercial use only
noncommercial|60|research purposes only|for research purposes only
warranty|40|without warranty|(?:the software is )?provided as is without warranty of any kind(?: express or implied)?
warranty|40|merchantability|(?:the )?(?:implied )?warrant(?:y|ies) of merchantability(?: or| and)? fitness for a particular purpose
warranty|40|in no event shall|in no event shall the (?:authors?|copyright (?:holders?|owner)|regents) (?:or [a-z ]{1,30})?be liable
warranty|30|without warranties|without warranties or conditions of any kind
"""


#: Words that stand in any text, and so are no anchors.
COMMON = "a all an and any as at be by can do for from free has have if in is it its may no not of on one or other our part that the this to under use used want what with without work you your new".split()


def anchor(pattern: str) -> str:
    """A word that every match of a pattern holds: the longest of those outside groups, options and classes."""
    left = re.sub(r"\(\?:( ?)[^()]*?( ?)\)\??", "\\1\0\\2", pattern)
    while "(?:" in left:
        left = re.sub(r"\(\?:( ?)[^()]*?( ?)\)\??", "\\1\0\\2", left)
    left = re.sub(r"\[[^\]]*\](?:\{[0-9,]+\})?\??|[a-z]\?", "\0", left)
    return max((w for w in left.split() if "\0" not in w and w not in COMMON), key=len)


def read_rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of every rule, the highest priority first, else in the order above."""
    out = []
    for line in filter(None, RULES.split("\n")):
        label, priority, keyword, pattern = line.split("|", 3)
        out.append((int(priority), label, keyword, pattern))
    return sorted(out, key=lambda r: -r[0])
