"""License scan by ordered signature rules.

Each rule is a regular expression behind keywords; one pass of an automaton over a text tells which
keywords it has, and only their rules run. Detections that lie inside a better one are suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# Label | keywords one of which must occur | expression for the name | SPDX identifier expression.
# In all tables a space in a keyword or an expression stands for any gap.
FAMILIES = """
mit | mit | mit(?:/x11| \\(expat\\))?(?: license)? | mit
apache | apache | apache(?: software)?(?: license)?(?:,? ?v(?:ersion)? ?[12](?:\\.\\d)?)? | apache-[12]\\.\\d
agpl | affero | (?:gnu )?affero general public license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | agpl-\\d\\.\\d(?:-only|-or-later)?
lgpl | lesser or library | (?:gnu )?(?:lesser|library) general public license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | lgpl-\\d\\.\\d(?:-only|-or-later)?
gpl | general public | (?:gnu )?general public license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | gpl-\\d\\.\\d(?:-only|-or-later)?
gpl-short | gpl | (?:gnu )?gpl(?: ?v?\\d(?:\\.\\d)?)?\\+? | gpl-\\d\\.\\d\\+
bsd-2-clause | bsd | (?:(?:2-clause|two-clause|simplified|freebsd) bsd|bsd(?: |-)(?:2-clause|two-clause|simplified))(?: license)? | bsd-2-clause
bsd-3-clause | bsd | (?:(?:3-clause|three-clause|new|modified|revised) bsd|bsd(?: |-)(?:3-clause|three-clause|new|modified|revised))(?: license)? | bsd-3-clause
bsd | bsd | bsd(?: license)? | bsd-4-clause
mpl | mozilla | mozilla public license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | mpl-\\d\\.\\d
epl | eclipse | eclipse public license(?:,? ?(?:-|v(?:ersion)?) ?v?\\d(?:\\.\\d)?)? | epl-\\d\\.\\d
eupl | european union public | european union public licen[cs]e(?:,? ?v(?:ersion)? ?\\.? ?\\d(?:\\.\\d)?)? | eupl-\\d\\.\\d
cddl | common development and distribution | common development and distribution license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | cddl-\\d\\.\\d
cpl | common public | common public license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | cpl-\\d\\.\\d
isc | isc | isc(?: license)? | isc
zlib | zlib | zlib(?:/libpng)?(?: license)? | zlib
boost | boost | boost software license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | bsl-\\d\\.\\d
artistic | artistic | artistic license(?:,? ?v?(?:ersion)? ?\\d(?:\\.\\d)?)? | artistic-\\d\\.\\d
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | want to public | do what the f\\*?u?\\*?c?k you want to public license | wtfpl
postgresql | postgresql | postgresql licen[cs]e | postgresql
python | python software foundation | python software foundation license(?:,? ?v(?:ersion)? ?\\d)? | python-\\d\\.\\d
php | php license | php license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d+)?)? | php-\\d\\.\\d+
ruby | ruby license | ruby license | ruby
openssl | openssl | openssl(?:/ssleay)? license | openssl
ofl | open font | (?:sil )?open font license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | ofl-\\d\\.\\d
odbl | open database | open database license(?:,? ?v?\\d?(?:\\.\\d)?)? | odbl-\\d\\.\\d
odc-by | open data commons attribution | open data commons attribution license | odc-by-\\d\\.\\d
pddl | public domain dedication and license | open data commons public domain dedication and license | pddl-\\d\\.\\d
gfdl | free documentation | (?:gnu )?free documentation license(?:,? ?v(?:ersion)? ?\\d(?:\\.\\d)?)? | gfdl-\\d\\.\\d
ms-pl | microsoft public | microsoft public license | ms-pl
ms-rl | microsoft reciprocal | microsoft reciprocal license | ms-rl
upl | universal permissive | universal permissive license(?:,? ?v?\\d?(?:\\.\\d)?)? | upl-\\d\\.\\d
afl | academic free | academic free license(?:,? ?v(?:ersion)? ?\\.? ?\\d(?:\\.\\d)?)? | afl-\\d\\.\\d
osl | open software license | open software license(?:,? ?v(?:ersion)? ?\\.? ?\\d(?:\\.\\d)?)? | osl-\\d\\.\\d
ncsa | illinois | university of illinois/ncsa open source license | ncsa
cecill | cecill | cecill(?:-[abc])?(?: free software)?(?: license)? | cecill-[abc\\d](?:\\.\\d)?
mulan | mulan | mulan permissive software license(?:,? ?v?\\d)? | mulanpsl-\\d\\.\\d
cc-by-nc-nd | creative commons or cc by or cc attribution | (?:cc |creative commons )(?:by-nc-nd|attribution-noncommercial-noderivatives)(?: \\d\\.\\d)? | cc-by-nc-nd-\\d\\.\\d
cc-by-nc-sa | creative commons or cc by or cc attribution | (?:cc |creative commons )(?:by-nc-sa|attribution-noncommercial-sharealike)(?: \\d\\.\\d)? | cc-by-nc-sa-\\d\\.\\d
cc-by-nc | creative commons or cc by or cc attribution | (?:cc |creative commons )(?:by-nc|attribution-noncommercial)(?!-)(?: \\d\\.\\d)? | cc-by-nc-\\d\\.\\d
cc-by-nd | creative commons or cc by or cc attribution | (?:cc |creative commons )(?:by-nd|attribution-noderivatives)(?: \\d\\.\\d)? | cc-by-nd-\\d\\.\\d
cc-by-sa | creative commons or cc by or cc attribution | (?:cc |creative commons )(?:by-sa|attribution-sharealike)(?: \\d\\.\\d)? | cc-by-sa-\\d\\.\\d
cc-by | creative commons or cc by or cc attribution | (?:cc |creative commons )(?:by|attribution)(?!-)(?: \\d\\.\\d)? | cc-by-\\d\\.\\d
cc0 | cc0 | cc0(?: \\d\\.\\d)?(?: universal)? | cc0-\\d\\.\\d
"""
# Rank | name of the form | single words one of which must occur | expression around <name> (or <id>). Higher ranks win.
FORMS = r"""
60 | spdx | spdx-license-identifier | spdx-license-identifier:\s*(?:<id>)\b
50 | licensed | licen | (?:is |are |be )?(?:dual-|re)?licen[sc]ed\s+(?:to you )?under\s+(?:the terms of\s+)?(?:the\s+|a\s+|an\s+)?(?:<name>)
45 | released | under | (?:released|distributed|published|provided|made available|available|redistributed)\s+under\s+(?:the terms (?:of|and conditions of)\s+)?(?:the\s+|a\s+|an\s+)?(?:<name>)
40 | terms | terms or conditions | (?:subject to|governed by|according to|in accordance with|under)\s+(?:the\s+)?(?:terms|conditions|terms and conditions)\s+of\s+(?:the\s+)?(?:<name>)
38 | under | under | under\s+(?:the\s+)?(?:<name>)(?<=licen[cs]e)
35 | copy | copy or text | (?:copy|text)\s+of\s+(?:the\s+)?(?:<name>)
45 | adjective | licen | (?:<name>)(?: |-)?licen[sc]ed
30 | notice | licen or lizenz | (?:licen[sc]es?|licensing|licencia|licenza|lizenz)\s*[:=]\s*(?:the\s+)?(?:<name>)
"""
# Rank | label | keyword | expression. Sentences, titles and addresses that belong to no family's forms.
NOTICES = r"""
55 | mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
52 | mit | to deal in the software | to deal in the software without restriction, including without limitation the rights to use, copy, modify
52 | mit | substantial portions | shall be included in all copies or substantial portions of the software
55 | isc | permission to use, copy | permission to use, copy, modify,? and/or distribute this software for any purpose
56 | 0bsd | permission to use, copy | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
55 | hpnd | permission to use, copy | permission to use, copy, modify,? and distribute this software and its documentation for any purpose
55 | bsd | redistribution and use | redistribution and use in source and binary forms, with or without modification
56 | bsd-3-clause | endorse or promote | neither the names? of .{1,80} nor the names of (?:its|any) contributors may be used to endorse or promote products
56 | bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
50 | bsd | above copyright notice | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
55 | gpl | free software foundation | redistribute it and/or modify it under the terms of the gnu general public license
57 | lgpl | free software foundation | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
57 | agpl | free software foundation | redistribute it and/or modify it under the terms of the gnu affero general public license
52 | gpl | either version | either version [123](?:\.0)? of the license, or \(at your option\) any later version
52 | gpl | a copy of the gnu general | you should have received a copy of the gnu general public license along with
53 | lgpl | a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license along with
53 | agpl | a copy of the gnu affero | you should have received a copy of the gnu affero general public license along with
50 | gpl | gpl-compatible | released as gpl-compatible free software
45 | gpl | copyleft | gnu general public license is a free, copyleft license
56 | zlib | without any express | provided 'as-is', without any express or implied warranty
54 | zlib | misrepresented | the origin of this software must not be misrepresented
54 | zlib | altered source | altered source versions must be plainly marked as such
55 | apache | in compliance with | you may not use this file except in compliance with the license
53 | apache | unless required by | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
54 | apache | apache software foundation | licensed to the apache software foundation \(asf\) under one or more contributor license agreements
54 | apache-1.1 | developed by the apache | this product includes software developed by the apache software foundation
55 | mpl | mozilla public | this source code form is subject to the terms of the mozilla public license
54 | mpl | incompatible with secondary | this source code form is "incompatible with secondary licenses"
54 | mpl | alternatively, the contents | alternatively, the contents of this file may be used under the terms of
55 | epl | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license
54 | cddl | cddl header start | cddl header start
55 | cddl | common development | the contents of this file are subject to the terms of the common development and distribution license
55 | boost | boost software license | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
53 | unlicense | public domain | this is free and unencumbered software released into the public domain
53 | unlicense | unencumbered | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
53 | wtfpl | what the fuck | you just do what the fuck you want to
55 | cc0 | creative commons | the person who associated a work with this deed has dedicated the work to the public domain
50 | cc-by | creative commons | this work is licensed under a creative commons attribution(?: \d\.\d)?(?: international| unported| generic)? license
51 | cc-by-sa | creative commons | this work is licensed under a creative commons attribution-sharealike(?: \d\.\d)?(?: international| unported| generic)? license
51 | cc-by-nc | creative commons | this work is licensed under a creative commons attribution-noncommercial(?: \d\.\d)?(?: international| unported| generic)? license
52 | cc-by-nc-sa | creative commons | this work is licensed under a creative commons attribution-noncommercial-sharealike(?: \d\.\d)?(?: international| unported| generic)? license
52 | cc-by-nc-nd | creative commons | this work is licensed under a creative commons attribution-noncommercial-noderivatives(?: \d\.\d)?(?: international| unported| generic)? license
54 | gfdl | free documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
53 | gfdl | invariant sections | with no invariant sections, no front-cover texts,? and no back-cover texts
54 | ofl | font software | this font software is licensed under the sil open font license
53 | ofl | reserved font name | with reserved font name
54 | artistic | artistic license | under the same terms as perl itself|under the terms of the artistic license
50 | perl | as perl itself | under the same terms as perl itself
54 | python | psf license | psf license agreement
54 | python | python software foundation | this license agreement is between the python software foundation
54 | postgresql | university of california | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement
54 | ncsa | deal with the software | to deal with the software without restriction
54 | openssl | openssl project | this product includes software developed by the openssl project
53 | curl | daniel stenberg | copyright \(c\) .{0,40}daniel stenberg
54 | libpng | libpng | this copy of the libpng notices is provided for your convenience
53 | ijg | independent jpeg | this software is based in part on the work of the independent jpeg group
53 | unicode | unicode data files | unicode data files and software
54 | w3c | w3c | w3c (?:software notice and license|software and document notice and license)
53 | icu | icu license | icu license - icu
54 | sleepycat | sleepycat | sleepycat license|the sleepycat software
54 | beerware | beer-ware | the beer-ware license
53 | json | good, not evil | the software shall be used for good, not evil
53 | vim | vim license | vim license
54 | ms-pl | microsoft public | this license governs use of the accompanying software\. if you use the software, you accept this license
54 | eupl | european union public | licen[cs]ed under the eupl
54 | cecill | cecill | governed by the cecill(?:-[abc])? license under french law
54 | busl | business source | business source license(?: 1\.1)?
54 | elastic | elastic license | elastic license(?: 2\.0)?
54 | sspl | server side public | server side public license
54 | commons-clause | commons clause | "?commons clause"? license condition
54 | polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license
54 | openrail | openrail | (?:creativeml |bigscience )?openrail(?:-m|\+\+-m|\+\+)?(?: license)?
54 | llama | community license | llama \d(?:\.\d)? community license
54 | odbl | open database | this .{1,60} is made available under the open database license
54 | data-license | community data | community data license agreement
58 | mit | opensource.org/licenses | opensource\.org/licenses/mit\b
58 | bsd-3-clause | opensource.org/licenses | opensource\.org/licenses/bsd-3-clause\b
58 | bsd-2-clause | opensource.org/licenses | opensource\.org/licenses/bsd-2-clause\b
58 | isc | opensource.org/licenses | opensource\.org/licenses/isc\b
58 | apache | opensource.org/licenses | opensource\.org/licenses/apache-2\.0
58 | gpl | opensource.org/licenses | opensource\.org/licenses/gpl-[23]\.0
58 | lgpl | opensource.org/licenses | opensource\.org/licenses/lgpl-[23]\.[01]
58 | apache | apache.org/licenses | apache\.org/licenses/license-[12]\.[01]
58 | gpl | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl(?:-[123]\.0)?(?:\.(?:html|txt|en\.html))?
58 | lgpl | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl(?:-[23]\.[01])?(?:\.(?:html|txt|en\.html))?
58 | agpl | gnu.org/licenses | gnu\.org/licenses/agpl(?:-3\.0)?(?:\.(?:html|txt|en\.html))?
58 | gfdl | gnu.org/licenses | gnu\.org/licenses/fdl(?:-1\.[123])?(?:\.(?:html|txt|en\.html))?
50 | gnu | gnu.org/licenses | gnu\.org/licenses/?(?![a-z])
58 | mpl | mozilla.org/mpl | mozilla\.org/mpl/[12]\.[01]
58 | mpl | mozilla.org/en-us/mpl | mozilla\.org/en-us/mpl/[12]\.[01]
58 | epl | eclipse.org/legal | eclipse\.org/legal/epl-(?:v10|2\.0|v20)
58 | boost | boost.org/license | boost\.org/license_1_0\.txt
58 | unlicense | unlicense.org | \bunlicense\.org\b
58 | ofl | scripts.sil.org/ofl | scripts\.sil\.org/ofl
58 | cc-by | creativecommons.org/licenses | creativecommons\.org/licenses/by/\d\.\d
58 | cc-by-sa | creativecommons.org/licenses | creativecommons\.org/licenses/by-sa/\d\.\d
58 | cc-by-nc | creativecommons.org/licenses | creativecommons\.org/licenses/by-nc/\d\.\d
58 | cc-by-nd | creativecommons.org/licenses | creativecommons\.org/licenses/by-nd/\d\.\d
58 | cc-by-nc-sa | creativecommons.org/licenses | creativecommons\.org/licenses/by-nc-sa/\d\.\d
58 | cc-by-nc-nd | creativecommons.org/licenses | creativecommons\.org/licenses/by-nc-nd/\d\.\d
58 | cc0 | creativecommons.org/publicdomain | creativecommons\.org/publicdomain/zero/\d\.\d
58 | public-domain | creativecommons.org/publicdomain | creativecommons\.org/publicdomain/mark/\d\.\d
58 | odbl | opendatacommons.org | opendatacommons\.org/licenses/odbl
58 | odc-by | opendatacommons.org | opendatacommons\.org/licenses/by
58 | pddl | opendatacommons.org | opendatacommons\.org/licenses/pddl
55 | public-domain | public domain | (?:released|dedicated|placed|committed|donated)\s+(?:in|in)?to\s+the\s+public\s+domain
50 | public-domain | public domain | works? of the (?:united states|u\.s\.) government .{0,60}public domain
25 | public-domain | public domain | \bpublic domain\b
25 | all-rights-reserved | rights reserved | all rights reserved
27 | some-rights-reserved | rights reserved | some rights reserved
28 | proprietary | proprietary | proprietary and confidential|confidential and proprietary
28 | proprietary | trade secret | (?:contains|constitutes?|is an?)\s+(?:\w+ ){0,3}trade secrets?\b
28 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) (?:of|or)
28 | proprietary | license agreement | end(?: |-)user license agreement
28 | proprietary | non-disclosure | under (?:the terms of )?a non-disclosure agreement
55 | apache-2.0 | apache license | apache license,? version 2\.0,? january 2004
55 | apache-2.0 | derivative works | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license
54 | apache-2.0 | patent license | no-charge, royalty-free, irrevocable \(except as stated in this section\) patent license
53 | apache-1.1 | end-user documentation | the end-user documentation included with the redistribution, if any, must include the following acknowledg
53 | apache-1.0 | apache group | this product includes software developed by the apache group
55 | gpl-1.0 | general public license | gnu general public license,? version 1, february 1989
55 | gpl-2.0 | general public license | gnu general public license,? version 2, june 1991
55 | gpl-3.0 | general public license | gnu general public license,? version 3, 29 june 2007
56 | lgpl-2.0 | library general public | gnu library general public license,? version 2, june 1991
56 | lgpl-2.1 | lesser general public | gnu lesser general public license,? version 2\.1, february 1999
56 | lgpl-3.0 | lesser general public | gnu lesser general public license,? version 3, 29 june 2007
56 | agpl-3.0 | affero general public | gnu affero general public license,? version 3, 19 november 2007
53 | gpl-2.0 | general public license | as published by the free software foundation; version 2 of the license
53 | gpl-2.0 | either version 2 | either version 2(?:\.0)? of the license, or \(at your option\) any later version
54 | gpl-3.0 | either version 3 | general public license as published by the free software foundation, either version 3 of the license
52 | gpl-2.0 | copying and distributing | you may copy and distribute verbatim copies of the program's source code as you receive it
52 | gpl-3.0 | corresponding source | the "corresponding source" for a work in object code form means all the source code
52 | lgpl-2.1 | work that uses the library | such a work, in isolation, is not a derivative work of the library, and therefore falls outside the scope
52 | agpl-3.0 | remote network | your modified version must prominently offer all users interacting with it remotely through a computer network
51 | gpl-exception | special exception | as a special exception, (?:the copyright holders|you may|if you link|the free software foundation)
51 | classpath-exception | classpath | gnu classpath exception|"classpath" exception
51 | gcc-exception | gcc runtime | gcc runtime library exception
51 | bison-exception | bison | as part or all of a larger work .{0,40}bison
55 | mpl-1.0 | mozilla public | mozilla public license version 1\.0
55 | mpl-1.1 | mozilla public | mozilla public license version 1\.1
55 | mpl-2.0 | mozilla public | mozilla public license,? (?:version|v\.?) ?2\.0
53 | mpl-1.1 | initial developer | the initial developer of the original code is
53 | npl | netscape public | netscape public license
55 | epl-1.0 | eclipse public | eclipse public license ?- ?v ?1\.0
55 | epl-2.0 | eclipse public | eclipse public license ?- ?v ?2\.0
54 | cpl-1.0 | common public license | common public license version 1\.0
54 | ipl-1.0 | ibm public | ibm public license version 1\.0
55 | cddl-1.0 | common development | common development and distribution license \(cddl\) version 1\.0
55 | cddl-1.1 | common development | common development and distribution license \(cddl\) version 1\.1
54 | apsl | apple public source | apple public source license
54 | spl | sun public | sun public license version 1\.0
54 | sissl | sun industry standards | sun industry standards source license
54 | qpl | q public | q public license version 1\.0
54 | rpl | reciprocal public | reciprocal public license
54 | ecl-2.0 | educational community | educational community license,? version 2\.0
54 | efl | eiffel forum | eiffel forum license
54 | entessa | entessa | entessa public license
54 | fair | fair license | usage of the works is permitted provided that this instrument is retained with the works
54 | frameworx | frameworx | frameworx open license
54 | intel | intel open source | intel open source license
54 | lucent | lucent public | lucent public license
54 | naumen | naumen | naumen public license
54 | nethack | nethack | nethack general public license
54 | nokia | nokia open source | nokia open source license
54 | oclc | oclc research | oclc research public license
54 | ogtsl | open group test suite | open group test suite license
54 | rpsl | realnetworks | realnetworks public source license
54 | watcom | sybase open watcom | sybase open watcom public license
54 | vsl | vovida | vovida software license
54 | wxwindows | wxwindows | wxwindows library licen[cs]e
54 | xnet | x.net | x\.net,? inc\. license
54 | zpl | zope public | zope public license(?: \(zpl\))?(?: version \d\.\d)?
54 | latex | latex project public | latex project public license
54 | nasa | nasa open source | nasa open source agreement
54 | motosoto | motosoto | motosoto open source license
54 | catosl | computer associates trusted | computer associates trusted open source license
54 | cua | cua office | cua office public license
54 | cpal | common public attribution | common public attribution license
54 | cnri | corporation for national research | cnri open source(?: gpl-compatible)? license agreement|cnri python license
54 | liliq | licence libre du qu | licence libre du qu[eé]bec
55 | mit-0 | without restriction | mit no attribution|mit-0 license
54 | mit-advertising | mit license | mit license with advertising clause
54 | x11 | x consortium | the name of the x consortium shall not be used in advertising
54 | ntp | without express or implied | it is provided "as is" without express or implied warranty
54 | bsd-1-clause | redistributions of source | bsd(?: |-)1-clause license
56 | bsd-3-clause | endorse or promote | neither the name of the (?:university|copyright holder|author|organization|company)(?: nor the names of its contributors)? .{0,40}may be used to endorse or promote products derived from this software
55 | bsd-4-clause-uc | university of california, berkeley | this product includes software developed by the university of california, berkeley and its contributors
55 | bsd-3-clause-clear | patent | no express or implied licenses to any party's patent rights are granted by this license
55 | bsd-2-clause-patent | patent | bsd(?: |-)2-clause plus patent
54 | bsd-protection | protection license | bsd protection license
54 | freetype | freetype | freetype (?:project )?license|this software is based in part of the work of the freetype team
54 | imagemagick | imagemagick | imagemagick(?:'s)? license
54 | gd | boutell | permission has been granted to copy, distribute and modify gd in any context
54 | tcl | tcl | this software is copyrighted by the regents of the university of california, sun microsystems
54 | info-zip | info-zip | info-zip license|this is version \d{4}-\w{3}-\d{2} of the info-zip
54 | bzip2 | julian seward | bzip2 .{0,60}julian seward
54 | libtiff | sam leffler | sam leffler and silicon graphics
54 | ssleay | eric young | this product includes cryptographic software written by eric young
54 | net-snmp | net-snmp | net-snmp license
54 | sgi-b | sgi free software | sgi free software license b
54 | sqlite | may you share freely | may you do good and not evil
54 | glide | 3dfx glide | 3dfx glide source code general public license
54 | mpich | argonne | argonne national laboratory .{0,80}mathematics and computer science division
54 | blas | netlib | the reference blas is a freely-available software package
54 | eurosym | eurosym | eurosym license
54 | bitstream-vera | bitstream vera | bitstream vera is a trademark of bitstream
54 | ubuntu-font | ubuntu font | ubuntu font licen[cs]e
54 | gust-font | gust font | gust font license
54 | arphic | arphic | arphic public license
54 | ipa-font | ipa font | ipa font license agreement
54 | dl-de-by | datenlizenz | datenlizenz deutschland ?[-–]? ?namensnennung
54 | dl-de-zero | datenlizenz | datenlizenz deutschland ?[-–]? ?zero
54 | etalab | licence ouverte | licence ouverte ?/? ?(?:open licence)?
54 | ogl-uk | open government licence | open government licence(?: v?\d\.\d)?
54 | nlod | norwegian licence | norwegian licence for open government data
54 | cdla-permissive | community data license | community data license agreement ?[-–]? ?permissive
55 | cdla-sharing | community data license | community data license agreement ?[-–]? ?sharing
54 | free-art | free art license | free art license|licence art libre
54 | opl | open publication license | open publication license
54 | oal | open audio license | eff open audio license
54 | gfdl-1.1 | free documentation | gnu free documentation license,? version 1\.1, march 2000
54 | gfdl-1.2 | free documentation | gnu free documentation license,? version 1\.2, november 2002
54 | gfdl-1.3 | free documentation | gnu free documentation license,? version 1\.3, 3 november 2008
54 | fsf-all-permissive | without any warranty | copying and distribution of this file, with or without modification, are permitted in any medium without royalty
54 | cern-ohl | open hardware licence | cern open hardware licen[cs]e
54 | tapr-ohl | tapr open hardware | tapr open hardware license
54 | solderpad | solderpad | solderpad hardware licen[cs]e
54 | hippocratic | hippocratic | hippocratic license
54 | parity | parity public | parity public license
54 | prosperity | prosperity public | prosperity public license
54 | blueoak | blue oak | blue oak model license
54 | osaasy | source-available | functional source license
54 | confluent | confluent community | confluent community license
54 | redis-source | redis source available | redis source available license
54 | timescale | timescale license | timescale license
54 | cockroach | cockroach community | cockroachdb community license
54 | anti-996 | anti 996 | anti 996 license
54 | gemma | gemma terms | gemma terms of use
54 | falcon | falcon llm license | falcon(?:-180b)?(?: tii)? llm license
54 | deepseek | deepseek license | deepseek license agreement
54 | qwen | qianwen license | tongyi qianwen license agreement
54 | bloom-rail | responsible ai license | bigscience (?:bloom )?rail license
54 | nvidia-model | nvidia open model | nvidia open model license
54 | microsoft-research | microsoft research license | microsoft research license (?:terms|agreement)
54 | adobe-2006 | adobe systems incorporated grants | adobe systems incorporated grants to you a perpetual
54 | diffmark | diffmark | diffmark is in the public domain|1\. you can do what you want with diffmark
54 | glwtpl | good luck with that | good luck with that public license
54 | dont-be-a-dick | be a dick | don't be a dick public license
54 | wtfnmfpl | want to public | what the fuck you want to but it's not my fault public license
54 | sal | simple public license | simple public license(?: 2\.0)?
54 | sugarcrm | sugarcrm public | sugarcrm public license
54 | unicode-dfs | unicode, inc | unicode,? inc\. license agreement
54 | w3c-19980720 | world wide web consortium | copyright .{0,60}world wide web consortium
54 | xfree86 | xfree86 | xfree86 license
54 | xpp | indiana university | indiana university extreme! lab software license
54 | yahoo-ypl | yahoo! public | yahoo! public license
54 | zend | zend engine | zend engine license
54 | zed | zed license | \(c\) jim davies, january 1995
10 | mit | mit license | \bmit licen[cs]e\b
10 | apache | apache license | \bapache licen[cs]e\b
10 | gpl | general public license | \bgeneral public license\b
"""

# A gap between words: white space, and at a line's end or start also signs of comments and boxes.
_BLANK, _SIGNS = r"[\t\f\v ]", r"[#*/;%!|-]"
GAP = rf"(?:(?<!{_SIGNS}){_BLANK}*+{_SIGNS}*+{_BLANK}*+[\r\n][\s#*/;%!|>-]*+|{_BLANK}++)"


def with_gaps(expression: str) -> str:
    """The expression with a gap for each space and each run of white space."""
    return re.sub(r"\\s\+| ", lambda _: GAP, re.sub(r"\\s\*", " ?", expression))


@dataclass(frozen=True)
class Rule:
    """A signature; of each of its sets of keywords one must stand in a text, or the rule does not run."""

    order: int
    rank: int
    name: str
    label: str
    keywords: tuple[tuple[str, ...], ...]
    pattern: str


def _fields(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> tuple[Rule, ...]:
    """All rules: every form of every family, then the notices. Keywords are lower case."""
    out: list[Rule] = []
    for label, keywords, name, spdx in _fields(FAMILIES):
        for rank, form, words, around in _fields(FORMS):
            keys = (tuple(words.split(" or ")),) if form == "spdx" else (tuple(keywords.split(" or ")), tuple(words.split(" or ")))
            whole = with_gaps(around.replace("<name>", name).replace("<id>", spdx))
            out.append(Rule(len(out), int(rank), f"{label}:{form}", label.removesuffix("-short"), keys, f"(?<![a-z0-9]){whole}(?![a-z0-9])"))
    for rank, label, keyword, expression in _fields(NOTICES):
        out.append(Rule(len(out), int(rank), f"{label}:notice{len(out)}", label, ((keyword,),), with_gaps(expression)))
    return tuple(out)


#: What joins the names of a list, and what before a detection says that it does not hold.
JOIN = with_gaps(r"(?: ?[,;/&|] ?(?:and |or )?| (?:and/or|and|or|und|oder|et|ou|y|o) )(?:under )?(?:the |a |an )?")
NEGATION = re.compile(with_gaps(r"\b(?:not|never|no longer|isn't|aren't|nicht|rather than|instead of|unlike)(?: [a-z]{1,12}){0,2} \Z").encode())
#: An expression of licence identifiers, and an identifier in it.
SPDX = re.compile(rb"spdx-license-identifier:[ \t]*((?:[(][ \t]*)*[a-z0-9.+-]+(?:[ \t)]+(?:or|and|with)[ \t(]+[a-z0-9.+-]+)*)")
SPDX_ID = re.compile(rb"[a-z0-9.+-]+")


def suppress(found: list[tuple[int, int, int, int]]) -> list[int]:
    """Indexes of the detections (rank, order, start, end) that no better one contains.

    A higher rank is better, of one rank the longer, then the rule that stands first. Detections that only
    cross both stay. A sweep over starts with a Fenwick tree over ends: n log n.
    """
    best = sorted(range(len(found)), key=lambda i: (-found[i][0], found[i][2] - found[i][3], found[i][1], found[i][2], i))
    place = {i: k for k, i in enumerate(best)}
    ends = {e: k for k, e in enumerate(sorted({f[3] for f in found}, reverse=True), 1)}
    tree, kept = [len(found)] * (len(ends) + 1), []
    # At one start the longer ones come first, then the better ones, so that all that contain a detection are in the tree.
    for i in sorted(range(len(found)), key=lambda i: (found[i][2], -found[i][3], place[i])):
        at, low = ends[found[i][3]], len(found)
        while at:
            low = min(low, tree[at])
            at -= at & -at
        if low > place[i]:
            kept.append(i)
        at = ends[found[i][3]]
        while at <= len(ends):
            tree[at] = min(tree[at], place[i])
            at += at & -at
    return kept


class Scanner:
    """Scans lower-cased UTF-8 (only A-Z are lowered), so that offsets are those of bytes."""

    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.gap = re.compile(GAP.encode())
        self.words = ahocorasick.Automaton()
        self.by_keyword: dict[str, list[int]] = {}
        for rule in self.rules:
            for keyword in rule.keywords[0]:
                self.by_keyword.setdefault(keyword, []).append(rule.order)
        for keyword in {k for rule in self.rules for some in rule.keywords for k in some}:
            self.words.add_word(keyword, keyword)
        self.words.make_automaton()
        self.compiled: dict[int, re.Pattern[bytes]] = {}
        # The rules of forms by number; by form, each family's name; each family's identifier.
        forms = [form for _, form, *_ in _fields(FORMS)]
        families = _fields(FAMILIES)
        self.forms = set(range(len(families) * len(forms)))
        self.join, self.names, self.ids = re.compile(JOIN.encode()), {f: [] for f in forms}, []
        for i, (_, _, name, spdx) in enumerate(families):
            for j, form in enumerate(forms):
                self.names[form].append((re.compile(f"(?:{with_gaps(name)})(?![a-z0-9])".encode()), i * len(forms) + j))
            self.ids.append((re.compile(rf"(?:{spdx})(?:-only|-or-later|\+)?".encode()), i * len(forms)))
        gap = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        edge = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
        self.base = [(re.compile(rb"(?<!" + edge + rb")" + gap.join(w.encode() for w in words) + rb"(?!" + edge + rb")"), label) for words, label in BASE.items()]
        self.letters = np.ones(256, bool)
        self.letters[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

    def word_starts(self, low: bytes) -> np.ndarray:
        inside = self.letters[np.frombuffer(low, np.uint8)]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        return starts

    def base_places(self, low: bytes) -> list[tuple[int, str]]:
        if b"license" not in low:
            return []
        return [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(low)]

    def detect(self, low: bytes) -> list[tuple[Rule, int, int]]:
        """Detections in order of place that no better one contains. Forms that are negated do not count;
        names that a form's list goes on with, and all identifiers of an SPDX expression, do."""
        keys = {k for _, k in self.words.iter(self.gap.sub(b" ", low).decode("latin-1"))}
        found = []
        for order in sorted({o for k in keys for o in self.by_keyword.get(k, ())}):
            rule = self.rules[order]
            if any(keys.isdisjoint(some) for some in rule.keywords[1:]):
                continue
            if order not in self.compiled:
                self.compiled[order] = re.compile(rule.pattern.encode())
            for m in self.compiled[order].finditer(low):
                if order not in self.forms:
                    found.append((rule.rank, order, m.start(), m.end()))
                elif not NEGATION.search(low, max(0, m.start() - 64), m.start()):
                    found += [(rule.rank, order, m.start(), m.end()), *self.listed(low, rule, m.end())]
        if "spdx-license-identifier" in keys:
            found += self.identifiers(low)
        found = sorted(set(found), key=lambda f: (f[1], f[2], f[3]))
        return [(self.rules[found[i][1]], *found[i][2:]) for i in suppress(found)]

    def listed(self, low: bytes, rule: Rule, at: int) -> list[tuple[int, int, int, int]]:
        """The names that follow a form's name in a list, by the same form of their families."""
        form, out = rule.name.rpartition(":")[2], []
        while join := self.join.match(low, at, at + 64):
            ends = [(m.end(), order) for name, order in self.names[form] if (m := name.match(low, join.end(), join.end() + 128))]
            if not ends:
                break
            at, order = max(ends, key=lambda e: (e[0], -e[1]))
            out.append((rule.rank, order, join.end(), at))
        return out

    def identifiers(self, low: bytes) -> list[tuple[int, int, int, int]]:
        """What the identifiers of SPDX expressions are, each at its place."""
        out = []
        for m in SPDX.finditer(low):
            for one in SPDX_ID.finditer(low, m.start(1), m.end(1)):
                order = next((o for pattern, o in self.ids if pattern.fullmatch(low, one.start(), one.end())), None)
                if order is not None:
                    out.append((self.rules[order].rank, order, one.start(), one.end()))
        return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score``, ``detections`` (rule, label, rank, start, end in characters).

    ``score`` is the highest detection's rank over 60 (a statement such as an SPDX line scores 1), at
    least 0.5 with a base place, 0 with neither. Null text is empty. Ties of rank go to the longer
    detection, then to the rule that stands first. Time grows with n log n of a text's detections and with
    its length. Repeated rows and null ids get answers of their own, an empty table an empty one; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                low = (raw or b"").lower()
                starts = scanner.word_starts(low)
                base, found = scanner.base_places(low), scanner.detect(low)
                before = np.cumsum(starts) - starts if base else None
                places = [int(before[at]) for at, _ in base]
                labels = {label for _, label in base}
                score = max([0.5 * bool(base), *(r.rank / 60 for r, _, _ in found)])
                # A character's first byte is any but a continuation byte.
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(low, np.uint8) & 0xC0) != 0x80)]) if found else None
                out = [{"rule": r.name, "label": r.label, "rank": r.rank, "start": int(chars[a]), "end": int(chars[b])} for r, a, b in found]
                rows.append((int(starts.sum()), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {r.label for r, _, _ in found})), score, out))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<rule:string,label:string,rank:int,start:long,end:long>>"
    return docs.select(id_col, F.col(text_col)).mapInArrow(scan, schema)
