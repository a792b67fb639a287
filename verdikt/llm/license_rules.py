"""The signature rules of the license scan, and the keywords that gate them.

Rules are ordered: tags, grants, names with a license word, then signatures. ``keywords`` derives from a pattern sets of
words, each of which has a member in every text that the pattern matches, so gating by them loses nothing.
"""

from __future__ import annotations

#: Label and pattern of a name. Patterns match whole words of lower-case text with single spaces.
NAMES = (
    ("0bsd", "(?:0bsd|bsd zero clause|zero clause bsd)"),
    ("afl-3.0", "academic free(?: license)?(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("agpl-3.0", "(?:gnu )?affero general public(?: license)?(?: v(?:ersion)?)? ?3(?: 0)?(?: or later| only)?"),
    ("agpl-3.0", "(?:gnu )?agpl ?v? ?3(?: 0)?(?: or later| only)?"),
    ("agpl", "(?:gnu )?agpl"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: v(?:ersion)?)? 1 1"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("apache", "apache(?: software)?"),
    ("apsl", "apple public source"),
    ("artistic-1.0", "artistic(?: license)?(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic(?: license)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("artistic", "artistic"),
    ("beerware", "beerware"),
    ("blueoak-1.0.0", "blue ?oak(?: model)?(?: 1 0 0)?"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd(?: style)?"),
    ("bsl-1.0", "boost(?: software)?(?: license)?(?: v(?:ersion)?)?(?: 1 0)?"),
    ("busl-1.1", "business source(?: license)?(?: 1 1)?"),
    ("cc0-1.0", "(?:cc0(?: 1 0)?|creative commons zero)"),
    ("cc-by", "cc by(?: [1-4] [05])?"),
    ("cc-by", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cddl-1.0", "cddl(?: 1 0)?"),
    ("cddl-1.0", "common development and distribution(?: license)?(?: 1 0)?"),
    ("cecill", "cecill(?: [abc])?(?: [12](?: [01])?)?"),
    ("cpal-1.0", "cpal(?: 1 0)?"),
    ("cpl-1.0", "common public(?: license)?(?: v(?:ersion)?)?(?: 1 0)?"),
    ("ecl-2.0", "educational community(?: license)?(?: v(?:ersion)?)?(?: 2 0)?"),
    ("elastic-2.0", "elastic(?: license)?(?: v?2(?: 0)?)?"),
    ("epl-1.0", "eclipse public(?: license)?(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse public(?: license)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("epl", "eclipse public"),
    ("epl-2.0", "epl 2 0"),
    ("eupl-1.1", "eupl(?: v)? ?1 1"),
    ("eupl-1.2", "eupl(?: v)? ?1 2"),
    ("eupl", "european union public"),
    ("gfdl", "gfdl(?: 1 [123])?"),
    ("gfdl", "(?:gnu )?free documentation"),
    ("gpl-1.0", "(?:gnu )?gpl ?v? ?1(?: 0)?(?: or later| only)?"),
    ("gpl-2.0", "(?:gnu )?gpl ?v? ?2(?: 0)?(?: or later| only)?"),
    ("gpl-2.0", "(?:gnu )?general public(?: license)?(?: as published by the free software foundation)?(?: v(?:ersion)?)? ?2(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", "(?:gnu )?gpl ?v? ?3(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", "(?:gnu )?general public(?: license)?(?: as published by the free software foundation)?(?: v(?:ersion)?)? ?3(?: 0)?(?: or later| only)?"),
    ("gpl", "(?:gnu )?general public"),
    ("gpl", "(?:gnu )?gpl"),
    ("hpnd", "historical permission notice and disclaimer"),
    ("ijg", "independent jpeg group"),
    ("ipl-1.0", "ibm public(?: license)?(?: v(?:ersion)?)?(?: 1 0)?"),
    ("isc", "isc"),
    ("lgpl-2.1", "(?:gnu )?lgpl ?v? ?2(?: [01])?(?: or later| only)?"),
    ("lgpl-2.1", "(?:gnu )?lesser general public(?: license)?(?: v(?:ersion)?)? ?2(?: [01])?(?: or later| only)?"),
    ("lgpl-2.0", "(?:gnu )?library general public(?: license)?(?: v(?:ersion)?)?(?: ?2(?: 0)?)?"),
    ("lgpl-3.0", "(?:gnu )?lgpl ?v? ?3(?: 0)?(?: or later| only)?"),
    ("lgpl-3.0", "(?:gnu )?lesser general public(?: license)?(?: v(?:ersion)?)? ?3(?: 0)?(?: or later| only)?"),
    ("gpl", "(?:gnu )?lgpl"),
    ("llama", "llama(?: [234](?: [0-9])?)?(?: community)?"),
    ("lppl-1.3c", "latex project public(?: license)?(?: v(?:ersion)?)?(?: 1 3[abc]?)?"),
    ("mit-0", "mit (?:0|no attribution)"),
    ("mit", "(?:x11 )?mit(?: x11| expat)?"),
    ("mit", "expat"),
    ("mpl-1.1", "mozilla public(?: license)?(?: v(?:ersion)?)? ?1 1"),
    ("mpl-2.0", "mozilla public(?: license)?(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl-2.0", "mpl ?v? ?2(?: 0)?"),
    ("mpl", "mozilla public"),
    ("ms-pl", "microsoft public"),
    ("ms-rl", "microsoft reciprocal"),
    ("mulanpsl-2.0", "mulan(?: permissive software)?(?: license)?(?: v?2(?: 0)?)?"),
    ("ncsa", "(?:university of illinois )?(?:illinois )?ncsa(?: open source)?"),
    ("odbl-1.0", "open (?:data commons )?(?:open )?database(?: license)?(?: 1 0)?"),
    ("odc-by-1.0", "open data commons attribution(?: license)?(?: 1 0)?"),
    ("ofl-1.1", "(?:sil )?open font(?: license)?(?: 1 1)?"),
    ("openssl", "openssl"),
    ("osl-3.0", "osl 3 0"),
    ("osl-3.0", "open software(?: license)?(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("pddl-1.0", "(?:odc )?public domain dedication(?: and license)?"),
    ("php-3.01", "php(?: license)?(?: v(?:ersion)?)?(?: 3 0?1)?"),
    ("polyform", "polyform(?: noncommercial| small business| shield| strict)?(?: 1 0 0)?"),
    ("postgresql", "postgresql"),
    ("psf-2.0", "python(?: software foundation)?(?: license)?(?: v(?:ersion)?)?(?: 2(?: 0)?)?"),
    ("qpl-1.0", "q public(?: license)?(?: 1 0)?"),
    ("rpl-1.5", "reciprocal public(?: license)?(?: 1 5)?"),
    ("ruby", "ruby"),
    ("sspl-1.0", "sspl(?: 1 0)?"),
    ("sspl-1.0", "server side public(?: license)?(?: v(?:ersion)?)?(?: 1)?"),
    ("unicode", "unicode(?: inc)?(?: terms of use| dfs)?"),
    ("unlicense", "(?:the )?unlicense"),
    ("upl-1.0", "upl(?: 1 0)?"),
    ("vim", "vim"),
    ("w3c", "w3c(?: software)?(?: notice and)?"),
    ("wtfpl", "wtfpl(?: v?2)?"),
    ("zlib", "zlib(?: libpng)?"),
    ("zpl-2.1", "zope public(?: license)?(?: v(?:ersion)?)?(?: 2 1)?"),
)
#: Kind, priority, confidence and pattern; @ stands for a name.
FORMS = (
    ("tag", 0, 1.0, "spdx licen[sc]e identifier @"),
    ("grant", 1, 0.95, "(?:licen[sc]ed|released|distributed|available|provided|published|redistributed|covered|governed)(?: only)? (?:under|by)(?: the)?(?: terms (?:and conditions )?of)?(?: the| an?)? @(?: licen[sc]es?)?(?: version [0-9](?: [0-9])?)?"),
    ("name", 2, 0.8, "@ licen[sc]es?(?: version [0-9](?: [0-9])?)?"),
)
#: The license word that some names may hold; where they must, the name stands for itself.
INNER, TITLE = "(?: license)?", " licen[sc]e"
#: Label and pattern of passages of license texts, notices, links and statements.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "(?:governed by|under|covered by) an? mit style licen[sc]e"),
    ("mit", "opensource org licenses mit(?: license)?(?: php| html)?"),
    ("mit", "(?:see|read) (?:the )?(?:license|copying)(?: file| md| txt)? for (?:the )?(?:full )?mit licen[sc]e(?: text)?"),
    ("mit", "mit license(?: see)? https? .{1,60}? license"),
    ("mit", "(?:is )?mit licen[sc]ed"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-feh", "and acknowledgment shall be given in the documentation and software packages that this software was used"),
    ("mit-0", "mit no attribution(?: licen[sc]e)?"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "internet systems consortium inc isc disclaims all warranties"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("hpnd", "that both (?:that|the) copyright notice and this permission notice appear in supporting documentation"),
    ("ntp", "the ntp licen[sc]e"),
    ("bsd", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author|authors) as is and any express or implied warranties"),
    ("bsd", "(?:governed by|under|covered by) an? bsd style licen[sc]e(?: that can be found in the license file)?"),
    ("bsd", "opensource org licenses bsd license(?: php)?"),
    ("bsd", "(?:is )?bsd licen[sc]ed"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("bsd-3-clause", "neither the names? of .{1,120}? may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "the names? of .{1,120}? may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg?e?ment"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-1-clause", "opensource org licenses bsd 1 clause"),
    ("bsd-source-code", "redistributions of the code in binary form must be accompanied by"),
    ("0bsd", "zero clause bsd(?: licen[sc]e)?|0bsd"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "opensource org licenses apache 2 0"),
    ("apache-2.0", "(?:under|the) apache2(?: licen[sc]e)?"),
    ("apache-2.0", "(?:the )?asl 2(?: 0)?(?: licen[sc]e)?"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.0", "this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|software|file|library|package)"),
    ("gpl", "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "(?:https? )?(?:www )?gnu org licenses(?: gpl)?(?: html)?"),
    ("gpl", "gnu org copyleft gpl(?: html)?"),
    ("gpl", "gpl compatible(?: licen[sc]e)?"),
    ("gpl", "gpl licen[sc]ed"),
    ("gpl-1.0", "gnu general public license(?: as published by the free software foundation)? (?:either )?version 1"),
    ("gpl-1.0-or-later", "either version 1 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license(?: as published by the free software foundation)? version 2 only"),
    ("gpl-2.0-only", "under the terms of (?:the gnu general public license )?version 2 (?:of the gnu general public license )?as published by the free software foundation"),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version"),
    ("gpl-2.0", "gnu general public license version 2 june 1991"),
    ("gpl-2.0", "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?"),
    ("gpl-2.0", "free software foundation inc 59 temple place(?: suite 330)? boston ma 02111"),
    ("gpl-2.0", "free software foundation inc 51 franklin st(?:reet)?(?: fifth floor)? boston ma 02110"),
    ("gpl-2.0", "(?:under|the) (?:gnu )?gplv2(?: or later| only)?"),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version"),
    ("gpl-3.0-only", "under the terms of (?:the gnu general public license )?version 3 (?:of the gnu general public license )?as published by the free software foundation"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007"),
    ("gpl-3.0", "gnu org licenses gpl 3 0(?: html| txt| en html)?"),
    ("gpl-3.0", "(?:under|the) (?:gnu )?gplv3(?: or later| only)?"),
    ("gpl-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-classpath-exception", "(?:with )?(?:the )?classpath exception(?: 2 0)?"),
    ("gpl-linking-exception", "as a special exception .{1,80}? give(?:s)? (?:you )?permission to link"),
    ("gcc-runtime-exception", "gcc runtime library exception(?: version 3 1)?"),
    ("bison-exception", "part or all of the bison parser skeleton"),
    ("autoconf-exception", "this file .{0,80}? distributed along with .{0,40}? configuration script generated by autoconf"),
    ("font-exception", "this font does not by itself cause the resulting document to be covered by the gnu general public license"),
    ("llvm-exception", "apache license v2 0 with llvm exceptions?"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license(?: as published by the free software foundation)?"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu library general public license(?: as published by the free software foundation)?"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|file|library|package)"),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?"),
    ("lgpl-2.1", "lgplv2(?: 1)?"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0(?: html| txt| en html)?"),
    ("lgpl-3.0", "lgplv3"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3.0", "gnu org licenses agpl 3 0(?: html| txt| en html)?"),
    ("agpl-3.0", "agplv3"),
    ("agpl-3.0", "all users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.1", "gnu free documentation license version 1 1 march 2000"),
    ("gfdl-1.2", "gnu free documentation license version 1 2 november 2002"),
    ("gfdl-1.3", "gnu free documentation license version 1 3 3 november 2008"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "gnu org licenses fdl(?: 1 [123])?(?: html)?"),
    ("mpl-1.0", "mozilla org mpl mpl 1 0(?: html| txt)?"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "mozilla org mpl mpl 1 1(?: html| txt)?"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses"),
    ("mpl-2.0", "mplv2"),
    ("npl-1.1", "netscape public license(?: version)?(?: 1 [01])?"),
    ("epl-1.0", "(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "made available under the terms of the eclipse public license(?: v)? ?2 0"),
    ("edl-1.0", "eclipse distribution license(?: v)? ?1 0"),
    ("cddl-1.0", "common development and distribution license(?: version)? 1 0 cddl"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.1", "cddl(?: version)? 1 1"),
    ("cpl-1.0", "accompanying program is provided under the terms of this common public license"),
    ("eupl-1.1", "european union public licen[sc]e v ?1 1"),
    ("eupl-1.2", "european union public licen[sc]e v ?1 2"),
    ("eupl", "licensed under the eupl(?: version)?(?: 1 [12])?(?: or later)?"),
    ("ofl-1.1", "this font software is licensed under the sil open font license(?: version 1 1)?"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("ofl-1.1", "with reserved font names?"),
    ("cc0-1.0", "creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "(?:dedicated|released|placed) (?:in|in|to|under|into)(?: the public domain under)?(?: the)? cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("pdm", "creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by", "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc-by-sa", "text is available under the creative commons attribution share ?alike licen[sc]e|wikipedia .{0,40}? creative commons attribution share ?alike"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "you must distribute your contributions under the same licen[sc]e as the original"),
    ("cc", "some rights reserved(?: creative commons)?"),
    ("cc", "creative commons (?:deed|legal code|public licen[sc]e)"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "(?:https? )?unlicense org"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the fuck you want to(?: public licen[sc]e)?"),
    ("beerware", "you can buy me a beer in return"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "png reference library(?: licen[sc]e)?|libpng licen[sc]e"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", "(?:www )?boost org license 1 0 txt"),
    ("bsl-1.0", "solely in the form of machine executable object code generated by a source language processor"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("artistic-perl", "under the same terms as perl(?: itself| 5)?"),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python", "under the same terms as python"),
    ("ruby", "under the same terms as ruby"),
    ("php-3.01", "this product includes php(?: software)? freely available from"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "this product includes cryptographic software written by eric young"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights"),
    ("w3c", "(?:www )?w3 org consortium legal .{0,60}? copyright software"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree"),
    ("unicode", "(?:www )?unicode org copyright(?: html)?"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "icu licen[sc]e(?: icu 1 8 1 and later)?"),
    ("curl", "this software is licensed as described in the file copying"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "portions of this software are copyright .{0,40}? the freetype project|freetype (?:project )?licen[sc]e"),
    ("imagemagick", "imagemagick org (?:script )?license(?: php)?|imagemagick licen[sc]e"),
    ("sleepycat", "sleepycat licen[sc]e|sleepycat software"),
    ("tcl", "tcl tk licen[sc]e|tcl licen[sc]e"),
    ("json", "the software shall be used for good not evil"),
    ("ms-pl", "microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal license ms rl"),
    ("ms-lpl", "microsoft limited public licen[sc]e"),
    ("ms-eula", "microsoft software license terms"),
    ("sspl-1.0", "server side public license(?: version| v)? ?1"),
    ("busl-1.1", "business source license(?: 1 1)?(?: change date)?"),
    ("busl-1.1", "additional use grant .{1,200}? change date"),
    ("commons-clause", "commons clause(?: licen[sc]e)?(?: condition)?(?: v1 0)?"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("polyform", "polyformproject org licenses .{1,40}? 1 0 0"),
    ("hippocratic", "hippocratic licen[sc]e(?: version)?(?: [0-9] [0-9])?"),
    ("openrail", "(?:creativeml |bigscience |bigcode )?open ?rail(?: ?[mds])?(?: licen[sc]e)?"),
    ("bigscience-bloom-rail", "bigscience (?:bloom )?rail(?: licen[sc]e)?(?: 1 0)?"),
    ("llama-2", "llama 2 community licen[sc]e agreement"),
    ("llama-3", "meta llama 3(?: [123])? community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma terms of use"),
    ("odbl-1.0", "made available under the open database licen[sc]e"),
    ("odbl-1.0", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("pddl-1.0", "opendatacommons org licenses pddl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons org licenses by(?: 1 0)?"),
    ("ogl-uk", "open government licen[sc]e(?: v)? ?[123](?: 0)?"),
    ("etalab-2.0", "licence ouverte(?: open licence)?(?: etalab)?(?: 2 0)?"),
    ("dl-de-by", "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("crown-copyright", "crown copyright(?: and database rights?)?"),
    ("us-government", "work of the (?:united states|u s) government"),
    ("public-domain", "(?:is|are|was|placed|released|dedicated)(?: hereby)? (?:in|into|to) the public domain"),
    ("public-domain", "(?:this|these) (?:work|works|file|files|code|data|software) (?:is|are) (?:in the )?public domain"),
    ("public-domain", "no (?:known )?copyright(?: restrictions?)?"),
    ("public-domain", "this ebook is for the use of anyone anywhere(?: in the united states and most other parts of the world)? at no cost"),
    ("project-gutenberg", "project gutenberg(?: tm)? licen[sc]e(?: included with this ebook)?"),
    ("copyright", "copyright(?: c)?(?: (?:19|20)[0-9]{2}){1,4}"),
    ("copyright", "(?:19|20)[0-9]{2} (?:by )?.{1,60}? all copyrights? reserved"),
    ("copyright", "copyrighted (?:material|work|by)"),
    ("reserved", "(?:all|some|no) rights reserved"),
    ("reserved", "alle rechte vorbehalten"),
    ("reserved", "tous droits réservés"),
    ("reserved", "todos los derechos reservados"),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution|disclosure)(?: of this (?:file|software|material))?(?: via any medium)?(?: is strictly prohibited)?"),
    ("proprietary", "may not be reproduced .{0,120}? without (?:the )?(?:express )?(?:prior )?written (?:permission|consent)"),
    ("proprietary", "contains? (?:valuable )?(?:trade secrets?|proprietary information)"),
    ("proprietary", "no part of this (?:publication|book|document|work|site) may be (?:reproduced|copied)"),
    ("proprietary", "(?:the )?(?:software|product) is licensed not sold"),
    ("proprietary", "you may not (?:copy )?(?:modify )?(?:decompile )?reverse engineer"),
    ("end-user-agreement", "end user licen[sc]e agreement(?: eula)?"),
    ("terms-of-use", "by (?:using|accessing) this (?:site|website|service) you agree to (?:be bound by )?(?:the|these|our) terms of (?:use|service)"),
    ("non-commercial", "(?:for )?non ?commercial (?:use|purposes?|research purposes?) only"),
    ("non-commercial", "(?:not for|no) commercial use"),
    ("non-commercial", "for personal use only"),
    ("academic-use", "for (?:academic )?research purposes only|for academic use only"),
    ("evaluation-use", "for evaluation purposes only"),
    ("educational-use", "for educational (?:use|purposes) only"),
    ("no-derivatives", "no derivative works"),
    ("patent-grant", "(?:perpetual )?worldwide .{0,90}? patent licen[sc]e"),
    ("royalty-free", "royalty free(?: perpetual| worldwide| irrevocable| non ?exclusive)* licen[sc]e"),
    ("royalty-free", "(?:perpetual |worldwide |irrevocable |non ?exclusive )+royalty free"),
    ("copyleft", "(?:weak |strong )?copyleft(?: licen[sc]es?)?"),
    ("dual-licensed", "dual licen[sc]ed(?: under)?"),
    ("dual-licensed", "under (?:either|any) of .{1,80}? at your option"),
    ("triple-licensed", "mpl 1 1 gpl 2 0 lgpl 2 1"),
    ("contributor-agreement", "(?:individual |corporate )?contributor licen[sc]e agreement"),
    ("developer-certificate", "developer certificate of origin(?: version)?(?: 1 1)?"),
    ("warranty-disclaimer", "without warrant(?:y|ies) of any kind(?: express or implied| either express or implied)?"),
    ("warranty-disclaimer", "provided as is without(?: any)? (?:express or implied )?warrant(?:y|ies)"),
    ("warranty-disclaimer", "(?:disclaims?|disclaimed) all (?:other )?warranties"),
    ("warranty-disclaimer", "implied warrant(?:y|ies) of merchantability(?: and| or)? fitness for a particular purpose"),
    ("liability-disclaimer", "in no event (?:shall|will) .{1,120}? be (?:held )?liable"),
    ("liability-disclaimer", "(?:indirect |incidental |special |exemplary |punitive )+or consequential damages"),
    ("trademark", "registered trademarks? of"),
    ("trademark", "does not grant (?:any )?(?:rights?|permission) .{0,40}? trademarks?"),
    ("export-control", "subject to (?:u s|united states) export (?:control )?(?:laws|regulations)"),
    ("third-party-notices", "third party (?:licen[sc]es|notices|software notices)(?: and information)?"),
    ("open-source", "(?:an )?(?:osi approved )?open source licen[sc]e"),
)
SIGNATURE_PRIORITY, SIGNATURE_CONFIDENCE = 3, 0.5
#: At most so many words in a keyword set.
MOST_KEYWORDS = 48
#: Words that keep little out.
COMMON = frozenset("a all an and any are as at be by for from in is it its may no not of on or other that the these this to under was were will with you your".split())


def _parse(pattern: str, at: int = 0) -> tuple[list, int]:
    """Alternatives of a group as lists of (node, least, most); a node is a set of characters, a nested list or None for
    any character. Knows what the rules use: characters, classes, groups, dots and quantifiers."""
    groups, seq = [], []
    while at < len(pattern) and pattern[at] != ")":
        c = pattern[at]
        if c == "|":
            groups.append(seq)
            seq, at = [], at + 1
            continue
        if c == "(":
            node, at = _parse(pattern, at + 3)  # (?:
            at += 1
        elif c == "[":
            end = pattern.index("]", at)
            inside, node = pattern[at + 1 : end], set()
            while inside:
                if inside[1:2] == "-":
                    node |= {chr(x) for x in range(ord(inside[0]), ord(inside[2]) + 1)}
                    inside = inside[3:]
                else:
                    node.add(inside[0])
                    inside = inside[1:]
            at = end + 1
        elif c == ".":
            node, at = None, at + 1
        else:
            if c == "\\":
                at += 1
            node, at = {pattern[at]}, at + 1
        least, most = 1, 1
        if pattern[at : at + 1] == "?":
            least, at = 0, at + 1
        elif pattern[at : at + 1] in ("*", "+"):
            least, most, at = (0 if pattern[at] == "*" else 1), None, at + 1
        elif pattern[at : at + 1] == "{":
            end = pattern.index("}", at)
            a, _, z = pattern[at + 1 : end].partition(",")
            least, most, at = int(a), int(z or a), end + 1
        if pattern[at : at + 1] == "?" and (least, most) != (1, 1) and (least, most) != (0, 1):
            at += 1  # reluctant
        seq.append((node, least, most))
    return [*groups, seq], at


def _exact(alternatives: list) -> set[str] | None:
    """All strings of a group, or None if they are too many."""
    out: set[str] = set()
    for seq in alternatives:
        own = {""}
        for node, least, most in seq:
            one = None if node is None else _exact(node) if isinstance(node, list) else node
            if one is None or most is None or most > 1:
                return None
            one = one | ({""} if least == 0 else set())
            own = {a + b for a in own for b in one}
            if len(own) > MOST_KEYWORDS:
                return None
        out |= own
    return out if len(out) <= MOST_KEYWORDS else None


def _word_sets(seq: list) -> list[set[str]]:
    """Sets of whole words of which every match of a sequence holds one; a match begins and ends at a word's border.

    ``open_`` holds what the word at hand may be so far, ``closed`` the words that it may already have been; both are None
    while it isn't known where the word began.
    """
    found: list[set[str]] = []
    open_: set[str] | None = {""}
    closed: set[str] = set()
    for node, least, most in seq:
        own = None if node is None else _exact(node) if isinstance(node, list) else node
        if own is None or most is None or most > 1:
            if open_ is not None and isinstance(node, list) and all(a and a[0] == ({" "}, 1, 1) for a in node):
                # a group that begins with a space ends the word where it stands
                closed |= open_
                if not least:
                    continue
                found.append(closed)
            ends = own is not None and least > 0 and all(x.endswith(" ") for x in own)
            open_, closed = ({""} if ends else None), set()
            continue
        if least and all(" " in x for x in own):
            if open_ is not None:
                found.append(closed | {(o + x).split(" ")[0] for o in open_ for x in own})
            open_, closed = {x.rsplit(" ", 1)[1] for x in own}, set()
            continue
        if open_ is None:
            continue
        both = {o + x for o in open_ for x in (own if least else own | {""})}
        closed |= {x.split(" ")[0] for x in both if " " in x}
        open_ = {x for x in both if " " not in x}
        if not open_:
            found.append(closed)
        if not open_ or len(open_) + len(closed) > MOST_KEYWORDS:
            open_, closed = None, set()
    if open_ is not None:
        found.append(open_ | closed)
    return [s for s in found if s and "" not in s and len(s) <= MOST_KEYWORDS]


def _worth(words: set[str]) -> float:
    return min(0 if w in COMMON or w.isdigit() else len(w) for w in words) - 0.2 * len(words)


def keywords(pattern: str) -> list[list[str]]:
    """Sets of words, the rarest words' set first: a text that the pattern matches holds a word of each."""
    alternatives, _ = _parse(pattern)
    sets = [sorted(_word_sets(seq), key=lambda s: (-_worth(s), sorted(s))) for seq in alternatives]
    if not all(sets):
        raise ValueError(f"no keyword stands in every match of {pattern}")
    if len(sets) > 1:
        return [sorted(set().union(*(s[0] for s in sets)))]
    out: list[list[str]] = []
    for x in map(sorted, sets[0]):
        if x not in out and (not out or _worth(set(x)) > 0):
            out.append(x)
    return out


def rules() -> list[tuple[str, int, float, str]]:
    """label, priority, confidence and regex: hundreds of rules in order of priority."""
    out = []
    for kind, priority, confidence, form in FORMS:
        out += [(label, priority, confidence, form.replace("@", name)) for label, name in NAMES]
        if kind == "name":
            out += [(label, priority, confidence, name.replace(INNER, TITLE, 1)) for label, name in NAMES if INNER in name]
    return out + [(label, SIGNATURE_PRIORITY, SIGNATURE_CONFIDENCE, pattern) for label, pattern in SIGNATURES]
