"""Signatures of licences, in order: tier | label | gate | regular expression.

They are matched against a text's words, lower-cased and joined by single spaces; `..` stands for up to four words of any
kind. A rule is tried only where all words of its gate occur (`license` is met by `licence`, too). Tiers rank from `spdx` (an identifier made to be read by
machines) over `text` (a sentence of the licence itself), `notice` (something is put under it) and `name` (it is named) to
`hint` (terms without a name).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Tiers from the strongest to the weakest, and how sure each makes.
TIERS = {"spdx": 1.0, "text": 0.95, "notice": 0.9, "name": 0.7, "hint": 0.4}

SIGNATURES = r"""
spdx | mit | spdx mit | spdx license identifier mit(?! 0)
spdx | mit-0 | spdx mit | spdx license identifier mit 0
spdx | apache-2.0 | spdx apache | spdx license identifier apache 2 0
spdx | apache-1.1 | spdx apache | spdx license identifier apache 1 1
spdx | apache-1.0 | spdx apache | spdx license identifier apache 1 0
spdx | gpl-2.0-only | spdx gpl | spdx license identifier gpl 2 0(?: only)?(?! or later)
spdx | gpl-2.0-or-later | spdx gpl | spdx license identifier gpl 2 0 or later
spdx | gpl-3.0-only | spdx gpl | spdx license identifier gpl 3 0(?: only)?(?! or later)
spdx | gpl-3.0-or-later | spdx gpl | spdx license identifier gpl 3 0 or later
spdx | gpl-1.0-or-later | spdx gpl | spdx license identifier gpl 1 0 or later
spdx | lgpl-2.0 | spdx lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
spdx | lgpl-2.1-only | spdx lgpl | spdx license identifier lgpl 2 1(?: only)?(?! or later)
spdx | lgpl-2.1-or-later | spdx lgpl | spdx license identifier lgpl 2 1 or later
spdx | lgpl-3.0-only | spdx lgpl | spdx license identifier lgpl 3 0(?: only)?(?! or later)
spdx | lgpl-3.0-or-later | spdx lgpl | spdx license identifier lgpl 3 0 or later
spdx | agpl-3.0-only | spdx agpl | spdx license identifier agpl 3 0(?: only)?(?! or later)
spdx | agpl-3.0-or-later | spdx agpl | spdx license identifier agpl 3 0 or later
spdx | gfdl-1.3 | spdx gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
spdx | gfdl-1.2 | spdx gfdl | spdx license identifier gfdl 1 2(?: only| or later)?
spdx | bsd-1-clause | spdx bsd | spdx license identifier bsd 1 clause
spdx | bsd-2-clause | spdx bsd | spdx license identifier bsd 2 clause(?! patent)
spdx | bsd-2-clause-patent | spdx bsd | spdx license identifier bsd 2 clause patent
spdx | bsd-3-clause | spdx bsd | spdx license identifier bsd 3 clause(?! clear)
spdx | bsd-3-clause-clear | spdx bsd | spdx license identifier bsd 3 clause clear
spdx | bsd-4-clause | spdx bsd | spdx license identifier bsd 4 clause
spdx | 0bsd | spdx 0bsd | spdx license identifier 0bsd
spdx | isc | spdx isc | spdx license identifier isc
spdx | mpl-1.1 | spdx mpl | spdx license identifier mpl 1 1
spdx | mpl-2.0 | spdx mpl | spdx license identifier mpl 2 0
spdx | epl-1.0 | spdx epl | spdx license identifier epl 1 0
spdx | epl-2.0 | spdx epl | spdx license identifier epl 2 0
spdx | eupl-1.1 | spdx eupl | spdx license identifier eupl 1 1
spdx | eupl-1.2 | spdx eupl | spdx license identifier eupl 1 2
spdx | cddl-1.0 | spdx cddl | spdx license identifier cddl 1 0
spdx | cddl-1.1 | spdx cddl | spdx license identifier cddl 1 1
spdx | cpl-1.0 | spdx cpl | spdx license identifier cpl 1 0
spdx | cc0-1.0 | spdx cc0 | spdx license identifier cc0 1 0
spdx | cc-by-4.0 | spdx cc | spdx license identifier cc by 4 0
spdx | cc-by-3.0 | spdx cc | spdx license identifier cc by 3 0
spdx | cc-by-sa-4.0 | spdx cc sa | spdx license identifier cc by sa 4 0
spdx | cc-by-sa-3.0 | spdx cc sa | spdx license identifier cc by sa 3 0
spdx | cc-by-nc-4.0 | spdx cc nc | spdx license identifier cc by nc 4 0
spdx | cc-by-nd-4.0 | spdx cc nd | spdx license identifier cc by nd 4 0
spdx | cc-by-nc-sa-4.0 | spdx cc nc sa | spdx license identifier cc by nc sa 4 0
spdx | cc-by-nc-nd-4.0 | spdx cc nc nd | spdx license identifier cc by nc nd 4 0
spdx | zlib | spdx zlib | spdx license identifier zlib
spdx | bsl-1.0 | spdx bsl | spdx license identifier bsl 1 0
spdx | busl-1.1 | spdx busl | spdx license identifier busl 1 1
spdx | unlicense | spdx unlicense | spdx license identifier unlicense
spdx | wtfpl | spdx wtfpl | spdx license identifier wtfpl
spdx | artistic-1.0 | spdx artistic | spdx license identifier artistic 1 0
spdx | artistic-2.0 | spdx artistic | spdx license identifier artistic 2 0
spdx | ofl-1.1 | spdx ofl | spdx license identifier ofl 1 1
spdx | postgresql | spdx postgresql | spdx license identifier postgresql
spdx | python-2.0 | spdx python | spdx license identifier python 2 0
spdx | psf-2.0 | spdx psf | spdx license identifier psf 2 0
spdx | ncsa | spdx ncsa | spdx license identifier ncsa
spdx | upl-1.0 | spdx upl | spdx license identifier upl 1 0
spdx | ms-pl | spdx ms | spdx license identifier ms pl
spdx | ms-rl | spdx ms | spdx license identifier ms rl
spdx | sspl-1.0 | spdx sspl | spdx license identifier sspl 1 0
spdx | odbl-1.0 | spdx odbl | spdx license identifier odbl 1 0
spdx | openssl | spdx openssl | spdx license identifier openssl
spdx | vim | spdx vim | spdx license identifier vim
spdx | x11 | spdx x11 | spdx license identifier x11
spdx | afl-3.0 | spdx afl | spdx license identifier afl 3 0
spdx | osl-3.0 | spdx osl | spdx license identifier osl 3 0
spdx | mulanpsl-2.0 | spdx mulanpsl | spdx license identifier mulanpsl 2 0
spdx | ecl-2.0 | spdx ecl | spdx license identifier ecl 2 0
text | mit | permission granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text | mit | noninfringement merchantability | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
text | mit | substantial portions | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
text | x11 | consortium advertising | name of the x consortium shall not be used in advertising
text | isc | permission copy modify distribute fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text | isc | author disclaims warranties | the author disclaims all warranties with regard to this software including all implied warranties
text | bsd | redistribution source binary forms | redistribution and use in source and binary forms with or without modification are permitted
text | bsd-3-clause | endorse promote products derived | neither the names? of .. nor the names of its contributors may be used to endorse or promote products derived from this software
text | bsd-4-clause | advertising materials features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
text | bsd | redistributions retain disclaimer | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text | bsd | redistributions reproduce disclaimer | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
text | bsd | copyright holders contributors express | this software is provided by the copyright holders and contributors as is and any express or implied warranties
text | bsd-3-clause-clear | patent granted | no express or implied licenses to any partys? s? ?patent rights are granted by this license
text | apache-2.0 | apache compliance obtain | you may not use this file except in compliance with the license you may obtain a copy of the license at .. apache org licenses license 2 0
text | apache-2.0 | terms conditions reproduction distribution apache | apache license version 2 0 january 2004 .. terms and conditions for use reproduction and distribution
text | apache-1.1 | apache product includes | this product includes software developed by the apache (?:software foundation|group)
text | gpl | redistribute modify gnu | (?:this program|it|this file) is free software you can redistribute it and or modify it under the terms of the gnu general public license
text | gpl-2.0-or-later | foundation version later gnu | gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version
text | gpl-3.0-or-later | foundation version later gnu | gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
text | gpl-2.0-only | foundation version gnu | gnu general public license version 2 (?:only )?as published by the free software foundation
text | gpl-3.0-only | foundation version gnu | gnu general public license version 3 (?:only )?as published by the free software foundation
text | gpl-2.0 | gnu version june 1991 | gnu general public license version 2 june 1991
text | gpl-3.0 | gnu version june 2007 | gnu general public license version 3 29 june 2007
text | gpl | merchantability gnu details | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
text | gpl | intended guarantee freedom gnu | the gnu general public license is intended to guarantee your freedom to share and change
text | lgpl | redistribute modify gnu | (?:this library|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
text | lgpl-2.1-or-later | lesser version later foundation | gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version
text | lgpl-3.0-or-later | lesser version later foundation | gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
text | lgpl-2.0-or-later | library version later foundation | gnu library general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version
text | lgpl-2.1 | lesser february 1999 | gnu lesser general public license version 2 1 february 1999
text | lgpl-3.0 | lesser june 2007 | gnu lesser general public license version 3 29 june 2007
text | agpl-3.0-or-later | affero version later foundation | gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
text | agpl-3.0 | affero november 2007 | gnu affero general public license version 3 19 november 2007
text | gfdl | copy distribute modify gnu documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
text | mpl-2.0 | source subject terms mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
text | mpl-2.0 | mozilla org mpl obtain | if a copy of the mpl was not distributed with this file you can obtain one at .. mozilla org mpl 2 0
text | mpl-1.1 | contents file subject mozilla | the contents of this file are subject to the mozilla public license version 1 1
text | mpl-1.0 | contents file subject mozilla | the contents of this file are subject to the mozilla public license version 1 0
text | epl-1.0 | accompanying eclipse available | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
text | epl-2.0 | accompanying eclipse available | this program and the accompanying materials are made available under the terms of the eclipse public license v?(?:ersion)? ?2 0
text | cddl-1.0 | contents file subject development | the contents of this file are subject to the terms of the common development and distribution license
text | unlicense | unencumbered public domain | this is free and unencumbered software released into the public domain
text | unlicense | publish use compile sell | anyone is free to copy modify publish use compile sell or distribute this software
text | wtfpl | fuck | you just do what the fuck you want to
text | wtfpl | fuck public | do what the fuck you want to public license
text | zlib | provided express warranty authors arising | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
text | zlib | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
text | bsl-1.0 | boost 2003 | boost software license version 1 0 august 17th 2003
text | bsl-1.0 | boost distributed | distributed under the boost software license version 1 0
text | ofl-1.1 | sil font february | sil open font license version 1 1 26 february 2007
text | ofl-1.1 | font sold itself | neither the font software nor any of its individual components .. may be sold by itself
text | cc0-1.0 | waived copyright related neighboring | waived all copyright and related or neighboring rights
text | cc-by | appropriate credit indicate | you must give appropriate credit provide a link to the license and indicate if changes were made
text | cc-by-sa | remix transform build contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
text | cc-by-nc | material commercial purposes | you may not use the material for commercial purposes
text | cc-by-nd | remix transform distribute modified material | if you remix transform or build upon the material you may not distribute the modified material
text | postgresql | permission documentation agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text | ncsa | ncsa illinois | university of illinois .. ncsa open source license
text | openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
text | vim | vim uganda | vim is charityware .. (?:help|donate|donation) .. uganda
text | beer-ware | beer worth | if we meet some day and you think this stuff is worth it you can buy me a beer in return
text | json | good evil | the software shall be used for good not evil
text | ms-pl | governs accompanying | this license governs use of the accompanying software if you use the software you accept this license
text | upl-1.0 | universal permissive upl | the universal permissive license upl version 1 0
text | curl | daniel stenberg | copyright .. daniel stenberg .. all rights reserved permission to use copy modify and distribute
text | php-3.01 | php derived | products derived from this software may not be called php
text | artistic | intent document conditions | the intent of this document is to state the conditions under which a package may be copied
text | sleepycat | redistributions accompanied | redistributions in any form must be accompanied by information on how to obtain complete source code
text | busl-1.1 | business source parameters | business source license 1 1 .. parameters
text | sspl-1.0 | functionality modified service | if you make the functionality of the program or a modified version available to third parties as a service
text | elastic-2.0 | hosted managed service | you may not provide the software to third parties as a hosted or managed service
text | commons-clause | grant sell software | the license does not grant to you the right to sell the software
notice | mit | mit license | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?mit(?: x11)? licen[cs]e
notice | mit | mit | (?:is|are) mit licen[cs]ed
notice | mit | mit | licen[cs]e mit\b
notice | mit | mit opensource | opensource org licenses mit
notice | mit-0 | mit attribution | mit no attribution
notice | apache-2.0 | apache | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version| v)? v?2(?: 0)?
notice | apache-2.0 | apache | licen[cs]e apache 2 0
notice | apache-2.0 | apache licenses | apache org licenses license 2 0
notice | apache-1.1 | apache | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version| v)? 1 1
notice | apache | apache | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e
notice | gpl-1.0 | gnu | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e(?: version| v)? v?1(?: 0)?\b
notice | gpl-2.0 | gnu | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e(?: version| v)? v?2(?: 0)?\b
notice | gpl-3.0 | gnu | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e(?: version| v)? v?3(?: 0)?\b
notice | gpl | gnu | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e
notice | gpl-2.0 | gplv2 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gplv2
notice | gpl-3.0 | gplv3 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gplv3
notice | gpl | gpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl\b
notice | gpl-2.0 | gnu licenses | gnu org licenses (?:old licenses )?gpl 2 0
notice | gpl-3.0 | gnu licenses | gnu org licenses gpl 3 0
notice | gpl | gnu licenses | gnu org licenses gpl(?: html)?
notice | lgpl-2.1 | lesser | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu lesser general public licen[cs]e(?: version| v)? v?2 1
notice | lgpl-3.0 | lesser | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu lesser general public licen[cs]e(?: version| v)? v?3(?: 0)?
notice | lgpl-2.0 | library | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu library general public licen[cs]e
notice | lgpl | lesser | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[cs]e
notice | lgpl | lgpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
notice | lgpl-2.1 | gnu licenses | gnu org licenses (?:old licenses )?lgpl 2 1
notice | lgpl-3.0 | gnu licenses | gnu org licenses lgpl 3 0
notice | agpl-3.0 | affero | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu affero general public licen[cs]e(?: version| v)? v?3(?: 0)?
notice | agpl | affero | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[cs]e
notice | agpl-3.0 | agplv3 | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agplv3
notice | agpl-3.0 | gnu licenses | gnu org licenses agpl 3 0
notice | bsd-2-clause | bsd clause | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the |a )?(?:terms of )?(?:the )?(?:2|two) clause bsd
notice | bsd-3-clause | bsd clause | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the |a )?(?:terms of )?(?:the )?(?:3|three) clause bsd
notice | bsd-2-clause | bsd | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the |a )?(?:terms of )?(?:the )?(?:simplified|freebsd) bsd licen[cs]e
notice | bsd-3-clause | bsd | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the |a )?(?:terms of )?(?:the )?(?:new|modified|revised) bsd licen[cs]e
notice | bsd | bsd | (?:licen[cs]ed|released|distributed|available|published|provided|covered) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? licen[cs]e
notice | bsd | bsd | this .. bsd style licen[cs]e that can be found in the license file
notice | bsd-3-clause | opensource bsd | opensource org licenses bsd 3 clause
notice | bsd-2-clause | opensource bsd | opensource org licenses bsd 2 clause
notice | isc | isc | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
notice | mpl-2.0 | mozilla | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e(?: version| v)? v?2(?: 0)?
notice | mpl-1.1 | mozilla | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e(?: version| v)? 1 1
notice | mpl | mozilla | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e
notice | mpl-2.0 | mozilla mpl | mozilla org mpl 2 0
notice | epl-2.0 | eclipse | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e(?: version| v)? v?2(?: 0)?
notice | epl-1.0 | eclipse | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e(?: version| v)? v?1(?: 0)?
notice | epl | eclipse | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e
notice | eupl-1.2 | european union | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the european union public licen[cs]e(?: version| v)? ?1 2
notice | eupl | european union | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the european union public licen[cs]e
notice | eupl | eupl | licen[cs]ed under the eupl
notice | cddl-1.0 | cddl | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?cddl
notice | cddl-1.0 | development distribution | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?common development and distribution licen[cs]e
notice | cpl-1.0 | common | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?common public licen[cs]e
notice | cc-by-4.0 | attribution creative | creative commons attribution 4 0(?: international)?
notice | cc-by-3.0 | attribution creative | creative commons attribution 3 0(?: unported)?
notice | cc-by-2.0 | attribution creative | creative commons attribution 2 0
notice | cc-by-sa-4.0 | creative attribution | creative commons attribution share ?alike 4 0
notice | cc-by-sa-3.0 | creative attribution | creative commons attribution share ?alike 3 0
notice | cc-by-sa | creative attribution | creative commons attribution share ?alike
notice | cc-by-nc-4.0 | creative attribution | creative commons attribution non ?commercial 4 0
notice | cc-by-nc-sa-4.0 | creative attribution | creative commons attribution non ?commercial share ?alike 4 0
notice | cc-by-nc-sa | creative attribution | creative commons attribution non ?commercial share ?alike
notice | cc-by-nc-nd-4.0 | creative attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0
notice | cc-by-nc-nd | creative attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s
notice | cc-by-nc | creative attribution | creative commons attribution non ?commercial
notice | cc-by-nd-4.0 | creative attribution | creative commons attribution no ?deriv(?:ative)?s(?: works)? 4 0
notice | cc-by-nd | creative attribution | creative commons attribution no ?deriv(?:ative)?s
notice | cc-by | creative attribution | creative commons attribution(?: licen[cs]e)?
notice | cc-by-4.0 | creativecommons by | creativecommons org licenses by 4 0
notice | cc-by-3.0 | creativecommons by | creativecommons org licenses by 3 0
notice | cc-by-2.0 | creativecommons by | creativecommons org licenses by 2 0
notice | cc-by-sa-4.0 | creativecommons sa | creativecommons org licenses by sa 4 0
notice | cc-by-sa-3.0 | creativecommons sa | creativecommons org licenses by sa 3 0
notice | cc-by-nc-4.0 | creativecommons nc | creativecommons org licenses by nc 4 0
notice | cc-by-nd-4.0 | creativecommons nd | creativecommons org licenses by nd 4 0
notice | cc-by-nc-sa-4.0 | creativecommons nc sa | creativecommons org licenses by nc sa 4 0
notice | cc-by-nc-nd-4.0 | creativecommons nc nd | creativecommons org licenses by nc nd 4 0
notice | cc0-1.0 | creativecommons zero | creativecommons org publicdomain zero 1 0
notice | public-domain | creativecommons mark | creativecommons org publicdomain mark 1 0
notice | public-domain | public domain | (?:released|dedicated|placed|put|donated) (?:in|into|to) the public domain
notice | unlicense | unlicense | (?:released|licensed) under the unlicense
notice | wtfpl | wtfpl | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the (?:terms of the )?wtfpl
notice | zlib | zlib | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? licen[cs]e
notice | bsl-1.0 | boost | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?boost software licen[cs]e
notice | busl-1.1 | business source | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?business source licen[cs]e
notice | artistic-2.0 | artistic | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?artistic licen[cs]e(?: version)? 2 0
notice | artistic | artistic | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?(?:perl )?artistic licen[cs]e
notice | artistic-or-gpl | perl itself | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the same terms as perl itself
notice | ofl-1.1 | sil font | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the sil open font licen[cs]e
notice | psf-2.0 | python foundation | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the python software foundation licen[cs]e
notice | ms-pl | microsoft | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the microsoft public licen[cs]e
notice | ms-rl | microsoft reciprocal | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the microsoft reciprocal licen[cs]e
notice | sspl-1.0 | server side | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the server side public licen[cs]e
notice | elastic-2.0 | elastic | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under the elastic licen[cs]e(?: version| v)? ?2(?: 0)?
notice | odbl-1.0 | database | (?:under|by) the open (?:data commons open )?database licen[cs]e
notice | odc-by-1.0 | commons attribution data | open data commons attribution licen[cs]e
notice | pddl-1.0 | domain dedication commons | open data commons public domain dedication
notice | gfdl | documentation gnu | (?:(?:licen[cs]ed|released|distributed|available|published|provided|covered) )?under (?:the )?(?:terms of )?(?:the )?gnu free documentation licen[cs]e
notice | proprietary | confidential proprietary | (?:confidential and proprietary|proprietary and confidential)
notice | proprietary | copying file prohibited | unauthori[sz]ed copying of this file .. is strictly prohibited
name | gpl-2.0 | gnu | gnu general public licen[cs]e(?: version| v)? v?2(?: 0)?\b
name | gpl-3.0 | gnu | gnu general public licen[cs]e(?: version| v)? v?3(?: 0)?\b
name | gpl | gnu | gnu general public licen[cs]e
name | lgpl | lesser | gnu lesser general public licen[cs]e
name | agpl | affero | gnu affero general public licen[cs]e
name | gfdl | documentation gnu | gnu free documentation licen[cs]e
name | gpl-2.0 | gplv2 | gplv2
name | gpl-3.0 | gplv3 | gplv3
name | lgpl-2.1 | lgplv2 | lgplv2 1
name | lgpl-3.0 | lgplv3 | lgplv3
name | agpl-3.0 | agplv3 | agplv3
name | gpl | gpl | (?:gnu )?gpl licen[cs]e
name | lgpl | lgpl | (?:gnu )?lgpl licen[cs]e
name | apache-2.0 | apache | apache(?: software)? licen[cs]e(?: version| v)? v?2(?: 0)?\b
name | apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version| v)? 1 1
name | apache | apache | apache(?: software)? licen[cs]e
name | mit | mit license | mit licen[cs]e
name | x11 | x11 | x11 licen[cs]e
name | bsd-2-clause | bsd clause | bsd 2 clause(?: licen[cs]e)?
name | bsd-3-clause | bsd clause | bsd 3 clause(?: licen[cs]e)?
name | bsd-4-clause | bsd clause | bsd 4 clause(?: licen[cs]e)?
name | bsd | bsd | bsd licen[cs]e
name | isc | isc | isc licen[cs]e
name | mpl | mozilla | mozilla public licen[cs]e
name | epl | eclipse | eclipse public licen[cs]e
name | eupl | european union | european union public licen[cs]e
name | cddl-1.0 | development distribution | common development and distribution licen[cs]e
name | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
name | cc-by-sa-4.0 | cc sa | cc by sa 4 0
name | cc-by-sa-3.0 | cc sa | cc by sa 3 0
name | cc-by-sa | cc sa | cc by sa
name | cc-by-nc-sa-4.0 | cc nc sa | cc by nc sa 4 0
name | cc-by-nc-nd-4.0 | cc nc nd | cc by nc nd 4 0
name | cc-by-nc-4.0 | cc nc | cc by nc 4 0
name | cc-by-nc-sa | cc nc sa | cc by nc sa
name | cc-by-nc-nd | cc nc nd | cc by nc nd
name | cc-by-nc | cc nc | cc by nc
name | cc-by-nd | cc nd | cc by nd(?: 4 0)?
name | cc-by-4.0 | cc by | cc by 4 0
name | cc-by-3.0 | cc by | cc by 3 0
name | cc-by | cc by | cc by
name | creative-commons | creative commons | creative commons licen[cs]e
name | zlib | zlib | zlib licen[cs]e
name | bsl-1.0 | boost | boost software licen[cs]e
name | wtfpl | wtfpl | wtfpl
name | unlicense | unlicense | the unlicense
name | ofl-1.1 | font | open font licen[cs]e
name | artistic | artistic | artistic licen[cs]e
name | postgresql | postgresql | postgresql licen[cs]e
name | psf-2.0 | python foundation | python software foundation licen[cs]e
name | ncsa | ncsa | ncsa open source licen[cs]e
name | openssl | openssl | openssl licen[cs]e
name | sspl-1.0 | server side | server side public licen[cs]e
name | busl-1.1 | business source | business source licen[cs]e
name | beer-ware | beerware | beerware(?: licen[cs]e)?
name | ms-pl | microsoft | microsoft public licen[cs]e
name | commons-clause | commons clause | commons clause
hint | copyright-notice | copyright rights reserved | copyright .. \d{4} .. all rights reserved
hint | copyright-notice | rights reserved | all rights reserved
hint | copyright-notice | copyright | copyright c (?:19|20)\d\d
hint | no-warranty | provided | provided as is without (?:any )?warrant(?:y|ies)
hint | open-source | open source | open source licen[cs]e
hint | public-domain | public domain | (?:is|are) in the public domain
hint | free-use | free use | free for (?:personal|private|non ?commercial)(?: and commercial)? use
hint | permission-required | prior written permission | without (?:the )?(?:express )?prior written permission
"""


@dataclass(frozen=True)
class Rule:
    name: str
    tier: str
    label: str
    gate: frozenset[bytes]
    pattern: re.Pattern[bytes]


def rules(signatures: str = SIGNATURES) -> tuple[Rule, ...]:
    """The signatures as compiled rules, in order; earlier ones go before later ones of the same tier."""
    out = []
    for line in filter(str.strip, signatures.splitlines()):
        tier, label, gate, pattern = (x.strip() for x in line.split(" | ", 3))
        if tier not in TIERS or not gate:
            raise ValueError(f"not a rule: {line}")
        body = pattern.replace(" .. ", "(?: [^ ]+){0,4} ")
        out.append(Rule(f"{label}#{len(out) + 1}", tier, label, frozenset(gate.encode().split()), re.compile(rf" (?:{body})(?= )".encode())))
    return tuple(out)
