"""License detection by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z) and cut into words, which are joined by single spaces; rules are regular expressions over
that line and match whole words. A first test of the raw text skips all work for texts without any gate word. Then
each rule waits behind its keyword: only rules whose keyword occurs are run. A rule has a priority; a detection is
suppressed if another one contains its interval and has a higher priority, or the same and is longer, or covers the
same words by an earlier rule. The labels of the detections that remain are the text's licenses; the score is the
largest weight among them.

Rules come from the signatures below: each name is looked for behind a grant ("licensed under the ..."), behind an
SPDX tag and by itself, and over a hundred sentences of license texts and notices are known word by word.

Defined results: a null or empty text has no words and no detections; repeated rows are judged one by one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinery.runtime import spread

#: Label, keywords (any of which must occur), SPDX words, name after a grant, name by itself.
NAMES = [
    ("mit", "mit", "mit", "mit(?: licen[sc]e)?", "mit licen[sc]e"),
    ("mit-0", "mit", "mit 0", "mit (?:0|no attribution)(?: licen[sc]e)?", "mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", "x11", "x11(?: licen[sc]e)?", "x11 licen[sc]e"),
    ("isc", "isc", "isc", "isc(?: licen[sc]e)?", "isc licen[sc]e"),
    ("apache-1.1", "apache", "apache 1 1", "apache (?:software )?licen[sc]e (?:version |v)?1 1", "apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache-2", "apache", "apache 2 0", "apache(?: software)?(?: licen[sc]e)? (?:version |v ?)?2(?: 0)?", "apache(?: software)? licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("apache", "apache", "apache", "apache(?: software)? licen[sc]e", "apache(?: software)? licen[sc]e"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?", "(?:bsd (?:2|two) clause|(?:simplified|freebsd|2 clause|two clause) bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?", "(?:bsd (?:3|three) clause|(?:new|modified|revised|3 clause|three clause) bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:original|4 clause|four clause) bsd(?: licen[sc]e)?", "(?:bsd (?:4|four) clause|(?:original|4 clause|four clause) bsd)(?: licen[sc]e)?"),
    ("0bsd", "bsd", "0bsd", "(?:zero clause|0) bsd(?: licen[sc]e)?", "zero clause bsd(?: licen[sc]e)?"),
    ("bsd", "bsd", "bsd", "bsd(?: style)?(?: licen[sc]e)?", "bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "general public|gpl", "gpl 1 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v ?)?1(?: 0)?", "(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v ?)1(?: 0)?"),
    ("gpl-2.0", "general public|gpl", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v ?)?2(?: 0)?", "(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v ?)2(?: 0)?"),
    ("gpl-3.0", "general public|gpl", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v ?)?3(?: 0)?", "(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v ?)3(?: 0)?"),
    ("gpl", "general public|gpl", "gpl", "(?:gnu (?:general public licen[sc]e|gpl)|gpl)", "(?:gnu general public licen[sc]e|gnu gpl)"),
    ("lgpl-2.0", "lesser general|library general|lgpl", "lgpl 2 0(?: only| or later)?", "(?:gnu )?(?:library general public licen[sc]e|lgpl) (?:version |v ?)?2(?: 0)?", "(?:gnu )?(?:library general public licen[sc]e|lgpl) (?:version |v ?)2(?: 0)?"),
    ("lgpl-2.1", "lesser general|library general|lgpl", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl) (?:version |v ?)?2 1", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl) (?:version |v ?)2 1"),
    ("lgpl-3.0", "lesser general|library general|lgpl", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl) (?:version |v ?)?3(?: 0)?", "(?:gnu )?(?:lesser general public licen[sc]e|lgpl) (?:version |v ?)3(?: 0)?"),
    ("lgpl", "lesser general|library general|lgpl", "lgpl", "(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", "(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("agpl-3.0", "affero|agpl", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public licen[sc]e|agpl) (?:version |v ?)?3(?: 0)?", "(?:gnu )?(?:affero general public licen[sc]e|agpl) (?:version |v ?)3(?: 0)?"),
    ("agpl", "affero|agpl", "agpl", "(?:gnu )?(?:affero general public licen[sc]e|agpl)", "(?:gnu )?affero general public licen[sc]e"),
    ("gfdl-1.1", "free documentation", "gfdl 1 1(?: only| or later)?", "gnu free documentation licen[sc]e (?:version )?1 1", "gnu free documentation licen[sc]e (?:version )?1 1"),
    ("gfdl-1.2", "free documentation", "gfdl 1 2(?: only| or later)?", "gnu free documentation licen[sc]e (?:version )?1 2", "gnu free documentation licen[sc]e (?:version )?1 2"),
    ("gfdl-1.3", "free documentation", "gfdl 1 3(?: only| or later)?", "gnu free documentation licen[sc]e (?:version )?1 3", "gnu free documentation licen[sc]e (?:version )?1 3"),
    ("gfdl", "free documentation", "gfdl", "gnu free documentation licen[sc]e", "gnu free documentation licen[sc]e"),
    ("mpl-1.1", "mozilla|mpl", "mpl 1 1", "(?:mozilla public licen[sc]e|mpl) (?:version |v ?)?1 1", "mozilla public licen[sc]e (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla|mpl", "mpl 2 0", "(?:mozilla public licen[sc]e|mpl) (?:version |v ?)?2(?: 0)?", "mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("mpl", "mozilla", "mpl", "mozilla public licen[sc]e", "mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse|epl", "epl 1 0", "(?:eclipse public licen[sc]e|epl) (?:version |v ?)?1(?: 0)?", "eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse|epl", "epl 2 0", "(?:eclipse public licen[sc]e|epl) (?:version |v ?)?2(?: 0)?", "eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("cddl-1.0", "common development|cddl", "cddl 1 0", "(?:common development and distribution licen[sc]e|cddl)(?: (?:version |v ?)?1(?: 0)?)?", "common development and distribution licen[sc]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("cddl-1.1", "common development|cddl", "cddl 1 1", "(?:common development and distribution licen[sc]e|cddl) (?:version |v ?)?1 1", "common development and distribution licen[sc]e (?:version |v ?)?1 1"),
    ("cpl-1.0", "common public", "cpl 1 0", "common public licen[sc]e(?: (?:version |v ?)?1 0)?", "common public licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("ipl-1.0", "ibm", "ipl 1 0", "ibm public licen[sc]e(?: (?:version |v ?)?1 0)?", "ibm public licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("eupl-1.1", "european union|eupl", "eupl 1 1", "(?:european union public licen[sc]e|eupl) (?:version |v ?)?1 1", "european union public licen[sc]e (?:version |v ?)?1 1"),
    ("eupl-1.2", "european union|eupl", "eupl 1 2", "(?:european union public licen[sc]e|eupl)(?: (?:version |v ?)?1 2)?", "european union public licen[sc]e(?: (?:version |v ?)?1 2)?"),
    ("bsl-1.0", "boost", "bsl 1 0", "boost software licen[sc]e(?: (?:version |v ?)?1 0)?", "boost software licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("busl-1.1", "business source", "busl 1 1", "business source licen[sc]e(?: (?:version |v ?)?1 1)?", "business source licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)?(?: licen[sc]e)?", "zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", "libpng(?: 2 0)?", "libpng(?: licen[sc]e)?", "libpng licen[sc]e"),
    ("openssl", "openssl", "openssl", "openssl(?: ssleay)?(?: licen[sc]e)?", "openssl(?: ssleay)? licen[sc]e"),
    ("postgresql", "postgresql", "postgresql", "postgresql(?: licen[sc]e)?", "postgresql licen[sc]e"),
    ("python-2.0", "python|psf", "(?:python|psf) 2 0", "(?:python software foundation|psf|python)(?: licen[sc]e)(?: (?:version |v ?)?2(?: 0)?)?", "(?:python software foundation|psf) licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("php-3.01", "php", "php 3 01", "php licen[sc]e(?: (?:version |v ?)?3 01)?", "php licen[sc]e (?:version |v ?)?3 01"),
    ("ruby", "ruby", "ruby", "ruby(?: s)? licen[sc]e", "ruby licen[sc]e"),
    ("artistic-1.0", "artistic", "artistic 1 0(?: perl)?", "(?:perl )?artistic licen[sc]e (?:version |v ?)?1(?: 0)?", "artistic licen[sc]e (?:version |v ?)?1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic 2 0", "(?:perl )?artistic licen[sc]e (?:version |v ?)?2(?: 0)?", "artistic licen[sc]e (?:version |v ?)?2(?: 0)?"),
    ("artistic", "artistic", "artistic", "(?:perl )?artistic licen[sc]e", "(?:perl )?artistic licen[sc]e"),
    ("ofl-1.1", "open font|ofl", "ofl 1 1", "(?:sil )?(?:open font licen[sc]e|ofl)(?: (?:version |v ?)?1 1)?", "(?:sil )?open font licen[sc]e(?: (?:version |v ?)?1 1)?"),
    ("unlicense", "unlicen", "unlicense", "unlicen[sc]e", "(?:the )unlicen[sc]e"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl(?: licen[sc]e)?(?: version 2)?", "wtfpl licen[sc]e"),
    ("beerware", "beer", "beerware", "beer ?ware licen[sc]e", "beer ?ware licen[sc]e"),
    ("ms-pl", "microsoft|ms", "ms pl", "(?:microsoft public licen[sc]e|ms pl)", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft|ms", "ms rl", "(?:microsoft reciprocal licen[sc]e|ms rl)", "microsoft reciprocal licen[sc]e"),
    ("osl-3.0", "open software", "osl 3 0", "open software licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?", "open software licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("afl-3.0", "academic free", "afl 3 0", "academic free licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?", "academic free licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("ecl-2.0", "educational community", "ecl 2 0", "educational community licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?", "educational community licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("ncsa", "ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("upl-1.0", "universal permissive", "upl 1 0", "universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?", "universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("sspl-1.0", "server side public", "sspl 1 0", "server side public licen[sc]e(?: (?:version |v ?)?1)?", "server side public licen[sc]e(?: (?:version |v ?)?1)?"),
    ("elastic-2.0", "elastic", "elastic 2 0", "elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?", "elastic licen[sc]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("cecill-2.1", "cecill", "cecill 2 1", "cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: (?:version |v ?)?2 1)?", "cecill(?: free software)? licen[sc]e"),
    ("vim", "vim", "vim", "vim licen[sc]e", "vim licen[sc]e"),
    ("zpl-2.1", "zope", "zpl 2 1", "zope public licen[sc]e(?: (?:version |v ?)?2 1)?", "zope public licen[sc]e(?: (?:version |v ?)?2 1)?"),
    ("w3c", "w3c", "w3c", "w3c(?: software(?: notice)?)?(?: and)? licen[sc]e", "w3c software(?: notice)?(?: and)? licen[sc]e"),
    ("odbl-1.0", "open database|odbl", "odbl 1 0", "(?:open database licen[sc]e|odbl)(?: (?:version |v ?)?1 0)?", "open database licen[sc]e(?: (?:version |v ?)?1 0)?"),
    ("odc-by-1.0", "open data commons", "odc by 1 0", "open data commons attribution licen[sc]e(?: (?:version |v ?)?1 0)?", "open data commons attribution licen[sc]e"),
    ("pddl-1.0", "public domain dedication", "pddl 1 0", "(?:open data commons )?public domain dedication(?: and)? licen[sc]e", "(?:open data commons )?public domain dedication(?: and)? licen[sc]e"),
    ("ogl-3.0", "open government", "ogl uk 3 0", "open government licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?", "open government licen[sc]e(?: (?:version |v ?)?3(?: 0)?)?"),
    ("etalab-2.0", "etalab", "etalab 2 0", "(?:licence ouverte )?etalab(?: 2 0)?(?: licen[sc]e)?", "licence ouverte(?: 2 0)? etalab"),
    ("cc0-1.0", "creative commons|cc", "cc0 1 0", "(?:cc ?0|creative commons (?:cc ?0|zero))(?: 1 0)?(?: universal)?", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"),
    ("cc-by-1.0", "creative commons|cc", "cc by 1 0", "(?:cc by|creative commons attribution)(?: licen[sc]e)? 1 0", "(?:cc by|creative commons attribution(?: licen[sc]e)?) 1 0"),
    ("cc-by-2.0", "creative commons|cc", "cc by 2 0", "(?:cc by|creative commons attribution)(?: licen[sc]e)? 2 0", "(?:cc by|creative commons attribution(?: licen[sc]e)?) 2 0"),
    ("cc-by-2.5", "creative commons|cc", "cc by 2 5", "(?:cc by|creative commons attribution)(?: licen[sc]e)? 2 5", "(?:cc by|creative commons attribution(?: licen[sc]e)?) 2 5"),
    ("cc-by-3.0", "creative commons|cc", "cc by 3 0", "(?:cc by|creative commons attribution)(?: licen[sc]e)? 3 0", "(?:cc by|creative commons attribution(?: licen[sc]e)?) 3 0"),
    ("cc-by-4.0", "creative commons|cc", "cc by 4 0", "(?:cc by|creative commons attribution)(?: licen[sc]e)? 4 0", "(?:cc by|creative commons attribution(?: licen[sc]e)?) 4 0"),
    ("cc-by-sa-2.5", "creative commons|cc", "cc by sa 2 5", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? 2 5", "(?:cc by sa|creative commons attribution share ?alike(?: licen[sc]e)?) 2 5"),
    ("cc-by-sa-3.0", "creative commons|cc", "cc by sa 3 0", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? 3 0", "(?:cc by sa|creative commons attribution share ?alike(?: licen[sc]e)?) 3 0"),
    ("cc-by-sa-4.0", "creative commons|cc", "cc by sa 4 0", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? 4 0", "(?:cc by sa|creative commons attribution share ?alike(?: licen[sc]e)?) 4 0"),
    ("cc-by-nd-3.0", "creative commons|cc", "cc by nd 3 0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[sc]e)? 3 0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 3 0"),
    ("cc-by-nd-4.0", "creative commons|cc", "cc by nd 4 0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[sc]e)? 4 0", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 4 0"),
    ("cc-by-nc-3.0", "creative commons|cc", "cc by nc 3 0", "(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)? 3 0", "(?:cc by nc|creative commons attribution non ?commercial) 3 0"),
    ("cc-by-nc-4.0", "creative commons|cc", "cc by nc 4 0", "(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)? 4 0", "(?:cc by nc|creative commons attribution non ?commercial) 4 0"),
    ("cc-by-nc-sa-3.0", "creative commons|cc", "cc by nc sa 3 0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)? 3 0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0"),
    ("cc-by-nc-sa-4.0", "creative commons|cc", "cc by nc sa 4 0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)? 4 0", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0"),
    ("cc-by-nc-nd-3.0", "creative commons|cc", "cc by nc nd 3 0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[sc]e)? 3 0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 3 0"),
    ("cc-by-nc-nd-4.0", "creative commons|cc", "cc by nc nd 4 0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[sc]e)? 4 0", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 4 0"),
    ("cc-by", "creative commons|cc", "cc by", "(?:cc by|creative commons attribution)(?: licen[sc]e)?", "(?:cc by licen[sc]e|creative commons attribution)"),
    ("cc-by-sa", "creative commons|cc", "cc by sa", "(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)?", "(?:cc by sa|creative commons attribution share ?alike)"),
    ("cc-by-nd", "creative commons|cc", "cc by nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[sc]e)?", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)"),
    ("cc-by-nc", "creative commons|cc", "cc by nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)?", "(?:cc by nc|creative commons attribution non ?commercial)"),
    ("cc-by-nc-sa", "creative commons|cc", "cc by nc sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)?", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)"),
    ("cc-by-nc-nd", "creative commons|cc", "cc by nc nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[sc]e)?", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)"),
    ("creative-commons", "creative commons", "cc", "creative commons licen[sc]e", "creative commons licen[sc]e"),
]

#: Label, keyword, sentence of the license's own text or of a notice.
SENTENCES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "neither the name of (?:[^ ]+ ){1,12}(?:may|nor) (?:[^ ]+ ){0,12}be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "you may not use this file except", "you may not use this file except in compliance with the licen[sc]e"),
    ("gpl-2.0", "free software foundation", "free software foundation either version 2 of the licen[sc]e"),
    ("gpl-3.0", "free software foundation", "free software foundation either version 3 of the licen[sc]e"),
    ("gpl", "redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("zlib", "as is without any express", "this software is provided as is without any express or implied warranty"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[sc]e"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|in to|into|to) the public domain"),
    ("public-domain", "public domain", "(?:is|are) (?:hereby )?(?:in )?the public domain"),
    ("wtfpl", "what the", "do what the [^ ]+ you want to public licen[sc]e"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "prior written", "(?:no part of this [^ ]+ may be reproduced|reproduction is prohibited) (?:[^ ]+ ){0,12}without (?:the )?prior written (?:permission|consent)"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:[12][0-9]{3})(?: [12][0-9]{3})?"),
    ("mit", "substantial portions", "copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "above copyright", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies"),
    ("mit", "use of this source code", "use of this source code is governed by an mit style licen[sc]e"),
    ("bsd", "use of this source code", "use of this source code is governed by a bsd style licen[sc]e"),
    ("bsd", "source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-2-clause", "views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies (?:[^ ]+ ){0,12}copyright"),
    ("bsd-3-clause", "endorse or promote", "may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-3-clause-clear", "no express or implied licen", "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("0bsd", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("x11", "x consortium", "copyright (?:c )?(?:[12][0-9]{3} )?x consortium"),
    ("hpnd", "documentation for any purpose", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted (?:without fee )?provided that the above copyright notice appear in all copies"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation (?:[^ ]+ ){0,12}licen[sc]e"),
    ("apache-2", "contributor licen", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2", "apache org licen", "apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-2", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache-2", "governing permissions", "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2", "this file to you under", "licen[sc]es this file to you under the apache licen[sc]e"),
    ("gpl", "received a copy of the gnu", "you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|library|file)"),
    ("gpl", "gnu general public", "see the gnu general public licen[sc]e for more details"),
    ("gpl", "this program is free software", "this program is free software (?:[^ ]+ ){0,20}gnu general public licen[sc]e"),
    ("gpl", "merchantability or fitness", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-2.0", "at your option any later version", "either version 2 (?:of the licen[sc]e )?or at your option any later version (?:of the licen[sc]e)"),
    ("gpl-2.0", "version 2 as published", "gnu general public licen[sc]e version 2 as published by the free software foundation"),
    ("gpl-3.0", "version 3 as published", "gnu general public licen[sc]e version 3 as published by the free software foundation"),
    ("gpl-2.0-classpath", "statically or dynamically", "linking this library statically or dynamically with other modules (?:[^ ]+ ){0,30}general public licen[sc]e"),
    ("gcc-exception", "runtime library exception", "general public licen[sc]e (?:[^ ]+ ){0,12}gcc runtime library exception"),
    ("lgpl", "received a copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this (?:program|software|library|file)"),
    ("lgpl", "this library is free software", "this library is free software (?:[^ ]+ ){0,20}gnu (?:lesser|library) general public licen[sc]e"),
    ("lgpl", "gnu lesser general", "see the gnu lesser general public licen[sc]e for more details"),
    ("agpl", "received a copy of the gnu", "you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|software|library|file)"),
    ("agpl", "remotely through a computer network", "your modified version must prominently offer all users interacting with it remotely through a computer network (?:[^ ]+ ){0,40}general public licen[sc]e"),
    ("gfdl", "invariant sections", "with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts a copy of the licen[sc]e"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible with secondary", "this source code form is incompatible with secondary licen[sc]es"),
    ("epl-1.0", "this program and the accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "this program and the accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0"),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1.0", "accompanying materials", "accompanying materials are made available under the terms of the common public licen[sc]e"),
    ("eupl-1.2", "eupl", "licen[sc]ed under the eupl (?:version 1 2 )?or as soon they will be approved by the european commission"),
    ("bsl-1.0", "licen", "boost org licen[sc]e 1 0 txt"),
    ("busl-1.1", "change date", "effective on the change date (?:[^ ]+ ){0,40}change licen[sc]e"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software (?:[^ ]+ ){0,12}warranty"),
    ("libpng", "png reference library", "the png reference library is supplied as is (?:[^ ]+ ){0,20}warranty"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit (?:[^ ]+ ){0,12}copyright"),
    ("postgresql", "university of california", "in no event shall the university of california be liable to any party (?:[^ ]+ ){0,60}warranty"),
    ("python-2.0", "psf", "this licen[sc]e agreement is between the python software foundation psf and the individual or organization"),
    ("python-2.0", "python software foundation", "copyright (?:c )?(?:[^ ]+ ){0,8}python software foundation"),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php licen[sc]e"),
    ("artistic-1.0", "artistic", "this is free software you can redistribute it and or modify it under the same terms as perl (?:[^ ]+ ){0,8}artistic licen[sc]e"),
    ("artistic", "same terms as perl", "under the same terms as perl itself (?:[^ ]+ ){0,8}licen[sc]e"),
    ("ofl-1.1", "reserved font name", "with reserved font names? (?:[^ ]+ ){0,6}(?:this font software is licen[sc]ed under|licen[sc]e)"),
    ("unlicense", "unlicen", "for more information please refer to (?:http |https )?(?:www )?unlicen[sc]e org"),
    ("unlicense", "dedicate any and all copyright", "dedicate any and all copyright interest in the software to the public domain"),
    ("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "creativecommons org licen", "creativecommons org licen[sc]es by 4 0"),
    ("cc-by-3.0", "creativecommons org licen", "creativecommons org licen[sc]es by 3 0"),
    ("cc-by-sa-4.0", "creativecommons org licen", "creativecommons org licen[sc]es by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org licen", "creativecommons org licen[sc]es by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org licen", "creativecommons org licen[sc]es by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licen", "creativecommons org licen[sc]es by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licen", "creativecommons org licen[sc]es by nc nd 4 0"),
    ("cc-by-nd-4.0", "creativecommons org licen", "creativecommons org licen[sc]es by nd 4 0"),
    ("creative-commons", "some rights reserved", "some rights reserved"),
    ("odbl-1.0", "any rights in individual contents", "any rights in individual contents of the database are licen[sc]ed under the database contents licen[sc]e"),
    ("ogl-3.0", "public sector information", "contains public sector information licen[sc]ed under the open government licen[sc]e"),
    ("ogl-3.0", "crown copyright", "crown copyright"),
    ("ms-pl", "accompanying software", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e"),
    ("sspl-1.0", "third parties as a service", "if you make the functionality of the program or a modified version available to third parties as a service (?:[^ ]+ ){0,30}licen[sc]e"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service (?:[^ ]+ ){0,40}licen[sc]e"),
    ("commons-clause", "commons clause", "commons clause licen[sc]e condition"),
    ("json", "good not evil", "the software shall be used for good not evil (?:[^ ]+ ){0,12}warranty"),
    ("beerware", "whatever you want", "as long as you retain this notice you can do whatever you want with this stuff (?:[^ ]+ ){0,30}licen[sc]e"),
    ("public-domain", "copyright", "no (?:known )?copyright (?:restrictions|is claimed)"),
    ("public-domain", "work of the united states government", "work of the united states government (?:[^ ]+ ){0,12}(?:public domain|copyright)"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|document|text|work|software) via any medium is strictly prohibited"),
    ("proprietary", "trade secret", "(?:confidential and trade secret|trade secret and confidential) information"),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:[^ ]+ ){0,8}(?:without|except)"),
    ("proprietary", "personal use only", "for (?:your )?personal use only (?:[^ ]+ ){0,8}(?:prohibited|licen[sc]e|copyright)"),
    ("proprietary", "end user licen", "end user licen[sc]e agreement"),
]

GRANT = "(?:dual |re)?(?:licen[sc]ed|released|distributed|available|provided|published|shared|offered|covered) (?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:an? |the )?"
TAG = "spdx licen[sc]e identifier "
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Each rule and base phrase holds one of these at the start of a word, as it stands in a raw text.
GATE = (
    r"(?i)(?<![a-z0-9])(?:(?:un|re)?licen[sc]|copyright|public|reserved|granted|permitted|promote|advertising|warranty|unencumbered|confidential|prohibited|reproduced|spdx|wtfpl|creative|general|attribution"
    r"|(?:0?bsd|[la]?gpl|cc0?)(?![a-z])|(?:re)?(?:released|distributed|available|provided|published|shared|offered|covered)[^a-z0-9]+(?:under|by|with)(?![a-z]))"
)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[dict]:
    """All rules in order: label, keyword, priority, weight, regular expression over the line of words."""
    out = [("tag", label, "spdx", 4, 1.0, f"{TAG}{tag}") for label, _, tag, _, _ in NAMES]
    out += [("grant", label, keyword, 3, 0.95, f"{GRANT}{name}") for label, keyword, _, name, _ in NAMES]
    out += [("sentence", label, keyword, 2, 0.9, sentence) for label, keyword, sentence in SENTENCES]
    out += [("mention", label, keyword, 1, 0.7, mention) for label, keyword, _, _, mention in NAMES]
    return [dict(zip(("kind", "label", "keyword", "priority", "weight", "pattern"), r, strict=True), number=i) for i, r in enumerate(out)]


def _rules_column() -> Column:
    by: dict[str, list] = {}
    for r in rules():
        by.setdefault(r["keyword"], []).append({k: r[k] for k in ("label", "priority", "weight", "number")} | {"pattern": f"(?<= )(?:{r['pattern']})(?= )"})
    groups = [{"keywords": k.split("|"), "rules": v} for k, v in by.items()]
    return F.from_json(F.lit(json.dumps(groups)), "array<struct<keywords array<string>, rules array<struct<label string, priority int, weight double, number int, pattern string>>>>")


def squeezed(text: Column) -> Column:
    """The words of a text between single spaces, in their own case."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def line_of(words: Column) -> Column:
    """The line that rules are matched on, with a space at either end; words as squeezed() gives them."""
    return F.concat(F.lit(" "), F.translate(words, _UPPER, _LOWER), F.lit(" "))


def count_of(words: Column) -> Column:
    """Number of words in what squeezed() gives."""
    spaces = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", 0).otherwise(spaces + 1).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


_HIT = "struct<label string, priority int, weight double, number int, at int, stop int>"


def _swept(items: Column, zero: Column, step, emit, out: str) -> Column:
    """An array `out` of what emit(state, x) gives for each x, an array each; state is what step(state, x) made of zero and all x before.

    In runs of about the root of the number of items, so that no array is copied more often than that: states of equal runs are merged
    by step as well, so step(state, x) must take a state for x. Work is n^1.5 small steps and not n^2.
    """
    size = F.ceil(F.sqrt(F.size(items))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda k: F.slice(items, k * size + 1, size))

    def over(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, zero, step))
        none = F.struct(zero.alias("s"), F.array().cast(f"array<{out}>").alias("o"))
        before = F.aggregate(totals, F.struct(zero.alias("s"), F.array(zero).alias("o")), lambda st, t: _let(step(st["s"], t), lambda now: F.struct(now.alias("s"), F.concat(st["o"], F.array(now)).alias("o"))))["o"]

        def one(run: Column, start: Column) -> Column:
            first = F.struct(start.alias("s"), none["o"].alias("o"))
            return F.aggregate(run, first, lambda st, x: F.struct(step(st["s"], x).alias("s"), F.concat(st["o"], emit(st["s"], x)).alias("o")))["o"]

        return _let(before, lambda starts: F.flatten(F.transform(runs, lambda run, k: one(run, F.get(starts, k)))))

    return F.when(F.size(items) > 0, _let(runs, over)).otherwise(F.array().cast(f"array<{out}>"))


def _spans(line: Column, rule: Column) -> Column:
    """The matches of a rule as an array of _HIT, with places in the line."""

    def located(found: Column) -> Column:
        pieces = F.split(line, rule["pattern"])
        # each match with the text before it: `gap` and `size` symbols
        steps = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
        zero = F.struct(F.lit(0).alias("gap"), F.lit(0).alias("size"))
        total = lambda st, x: F.struct((st["gap"] + x["gap"]).alias("gap"), (st["size"] + x["size"]).alias("size"))

        def hit(st: Column, x: Column) -> Column:
            at = st["gap"] + st["size"] + x["gap"]
            return F.array(F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["number"].alias("number"), at.alias("at"), (at + x["size"]).alias("stop")))

        return F.when(F.size(found) == 0, F.array().cast(f"array<{_HIT}>")).otherwise(_let(steps, lambda items: _swept(items, zero, total, hit, _HIT)))

    return _let(F.regexp_extract_all(line, rule["pattern"], F.lit(0)), located)


def detections(line: Column) -> Column:
    """All matches of the rules whose keyword the line holds."""
    groups = F.filter(_rules_column(), lambda g: F.exists(g["keywords"], lambda k: F.contains(line, k)))
    return F.flatten(F.transform(F.flatten(F.transform(groups, lambda g: g["rules"])), lambda r: _spans(line, r)))


def remaining(found: Column) -> Column:
    """The detections that no other one suppresses, by place.

    Sorted by start, then longest, highest priority and earliest rule first, what suppresses a detection comes before it, has at
    least its priority and ends no earlier. So one sweep with the furthest stop so far of each priority or higher ones decides.
    """
    levels = sorted({r["priority"] for r in rules()})
    reach = lambda of: F.struct(*[of(p).alias(f"p{p}") for p in levels])
    item = lambda d: F.struct(d["at"].alias("at"), (-d["stop"]).alias("back"), (-d["priority"]).alias("low"), d["number"].alias("number"), reach(lambda p: F.when(d["priority"] >= p, d["stop"]).otherwise(-1)).alias("reach"), d.alias("d"))
    items = F.array_sort(F.transform(found, item))
    further = lambda st, x: reach(lambda p: F.greatest(st[f"p{p}"], x[f"p{p}"]))
    # a state for each detection, or a run's
    zero = F.struct(reach(lambda p: F.lit(-1)).alias("reach"))
    step = lambda st, x: F.struct(further(st["reach"], x["reach"]).alias("reach"))

    def kept(st: Column, x: Column) -> Column:
        held = F.lit(False)
        for p in levels:
            held = held | ((x["low"] == -p) & (st["reach"][f"p{p}"] >= x["d"]["stop"]))
        return F.when(held, F.array().cast(f"array<{_HIT}>")).otherwise(F.array(x["d"]))

    return _let(items, lambda all_: _swept(all_, zero, step, kept, _HIT))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, line (null where the gate is shut) and detections that remain, of each row."""
    docs = spread(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select("doc_id", squeezed(text).alias("words"), text.rlike(GATE).alias("open"))
    read = words.select("doc_id", count_of(F.col("words")).alias("n_words"), F.when(F.col("open"), line_of(F.col("words"))).alias("line"))
    hits = F.when(F.col("line").isNotNull(), remaining(detections(F.col("line")))).otherwise(F.array().cast(f"array<{_HIT}>"))
    return read.select("doc_id", "n_words", "line", hits.alias("detections"))
