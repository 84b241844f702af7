"""License scans by ordered signature rules.

``rules()`` gives some 400 rules in order. Written by hand are the names of ``LICENSES`` with, for some, a phrase
of their own, and the phrases of ``TEXTS``: grants, conditions, disclaimers, headers and addresses as the licenses
write them. Two templates add each license's SPDX tags and its grant ("licensed under the ..."). A rule has a
label, a priority, a pattern over the lower-cased text, a keyword and a kind. Its pattern runs only on texts
that hold the keyword and what its kind requires (``KINDS``); no match can do without either, so that no rule is
kept from a text. Of the places found, one that lies inside another's interval goes unless its priority is
higher; of equal intervals the rule of higher priority stays, then the earlier rule.

Three base phrases are found besides, as consecutive words whatever stands between the words.

Plan. One projection over the scan: no shuffle, no join, no Python; the rules are a constant array. Places come
from running sums, and suppression from running maxima of the ends over the places in order, one for each
priority, so that n places cost n log n steps.

Defined results: null text counts as empty: no words, no labels, score 0; only A-Z are lower-cased;
repeated rows are scanned each by itself; other columns pass through untouched, and where one is called like a
new one (n_words, places, spans, score), the new one gets an underscore after its name. ``score`` is the
highest priority among the places that stay, over 100.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.llm.spans import let, matches, running
from rootspan.llm.tasks import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Fixed value: the only other characters whose lower case has a letter of a-z. Without them ``lower`` may stand for
#: lowering A-Z: what it does to other letters neither makes nor breaks a word, a phrase or a rule's match.
TO_ASCII = "[\u0130\u212a]"
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided|free)\s+under\s"
#: What the rules of a kind cannot do without: a literal, and for some a pattern besides. A literal is looked
#: for first, as that is cheaper. The kind of all other rules is the first of ``HINTS`` that every match holds.
KINDS = {
    "#tag": ("spdx-licen", None),
    "#grant": ("under", GRANT),
    "#cc": ("cc", r"\bcc[\s-]by"),
    "#base": ("", "|".join(SEPARATOR.join(p.split()) for p, _ in BASE)),
}
HINTS = (
    "licen", "copyright", "permi", "software", "public", "commons", "reserved", "condition", "warrant", ".org", "redistribut", "gpl", "distribut", "commercial", "source",
    "product", "documentation", "grant", "liab", "contribut", "program",
)

#: label, SPDX ids, keyword of the name, pattern of the name, keyword and pattern of a phrase of its own.
LICENSES = [
    ("mit", ["mit"], "mit", r"\bmit[\s-]+licen[cs]e\b", "permission is hereby granted", r"permission is hereby granted,?\s+free of charge,?\s+to any person obtaining\s+a copy"),
    ("mit-0", ["mit-0"], "no attribution", r"\bmit no attribution\b", "", ""),
    ("x11", ["x11"], "x11", r"\bx11 licen[cs]e\b", "x consortium", r"name of the x consortium shall not"),
    ("isc", ["isc"], "isc", r"\bisc licen[cs]e\b", "permission to use, copy", r"permission to use, copy, modify,? and/or distribute this software"),
    ("0bsd", ["0bsd"], "clause bsd", r"\bzero[\s-]clause bsd\b", "", ""),
    ("bsd-2-clause", ["bsd-2-clause"], "bsd", r"\b(?:2|two)[\s-]clause bsd\b|\bsimplified bsd\b|\bbsd[\s-]2[\s-]clause\b", "", ""),
    ("bsd-3-clause", ["bsd-3-clause"], "bsd", r"\b(?:3|three)[\s-]clause bsd\b|\bnew bsd\b|\bbsd[\s-]3[\s-]clause\b", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors"),
    ("bsd-4-clause", ["bsd-4-clause"], "bsd", r"\b(?:4|four)[\s-]clause bsd\b|\boriginal bsd\b", "advertising materials", r"all advertising materials mentioning features"),
    ("bsd", [], "bsd", r"\bbsd(?:[\s-]style)? licen[cs]e\b", "redistribution and use", r"redistribution and use in source and binary forms"),
    ("apache-1.0", ["apache-1.0"], "apache", r"\bapache(?: software)? licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.0\b", "", ""),
    ("apache-1.1", ["apache-1.1"], "apache", r"\bapache(?: software)? licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.1\b", "", ""),
    ("apache-2", ["apache-2.0"], "apache", r"\bapache(?: software)? licen[cs]e,?\s+(?:version\s+|v\.?\s*)?2(?:\.0)?\b", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("apache", [], "apache", r"\bapache(?: software)? licen[cs]e\b", "", ""),
    ("gpl-1", ["gpl-1.0", "gpl-1.0-only", "gpl-1.0-or-later"], "gpl", r"\bgpl[\s-]?v?1(?:\.0)?\b", "", ""),
    ("gpl-2", ["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"], "gpl", r"(?<![al])\bgpl[\s-]?v?2(?:\.0)?\b", "general public", r"(?<!lesser |library |affero )gnu general public licen[cs]e,?\s+(?:as published by the free software foundation[;,]?\s+(?:either\s+)?)?version\s+2\b"),
    ("gpl-3", ["gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"], "gpl", r"(?<![al])\bgpl[\s-]?v?3(?:\.0)?\b", "general public", r"gnu general public licen[cs]e,?\s+(?:as published by the free software foundation[;,]?\s+(?:either\s+)?)?version\s+3\b"),
    ("gpl", [], "general public", r"\bgnu general public licen[cs]e\b", "", ""),
    ("lgpl-2", ["lgpl-2.0", "lgpl-2.0-only", "lgpl-2.0-or-later"], "lgpl", r"\blgpl[\s-]?v?2(?:\.0)?(?!\.1)\b", "library general public", r"gnu library general public licen[cs]e"),
    ("lgpl-2.1", ["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"], "lgpl", r"\blgpl[\s-]?v?2\.1\b", "lesser general public", r"lesser general public licen[cs]e,?\s+(?:as published by the free software foundation[;,]?\s+(?:either\s+)?)?version\s+2\.1\b"),
    ("lgpl-3", ["lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"], "lgpl", r"\blgpl[\s-]?v?3(?:\.0)?\b", "lesser general public", r"lesser general public licen[cs]e,?\s+version\s+3\b"),
    ("lgpl", [], "lesser general public", r"\bgnu lesser general public licen[cs]e\b", "", ""),
    ("agpl-3", ["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], "agpl", r"\bagpl[\s-]?v?3(?:\.0)?\b", "affero", r"gnu affero general public licen[cs]e"),
    ("agpl-1", ["agpl-1.0"], "affero", r"\baffero general public licen[cs]e,?\s+version\s+1\b", "", ""),
    ("gfdl", ["gfdl-1.1", "gfdl-1.2", "gfdl-1.3"], "gfdl", r"\bgfdl\b", "free documentation", r"gnu free documentation licen[cs]e"),
    ("mpl-1.0", ["mpl-1.0"], "mozilla public", r"\bmozilla public licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.0\b", "", ""),
    ("mpl-1.1", ["mpl-1.1"], "mozilla public", r"\bmozilla public licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.1\b", "", ""),
    ("mpl-2.0", ["mpl-2.0"], "mozilla public", r"\bmozilla public licen[cs]e,?\s+(?:version\s+|v\.?\s*)?2\.0\b", "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", ["epl-1.0"], "eclipse public", r"\beclipse public licen[cs]e(?:,?\s+|\s*-\s*)(?:version\s+|v\.?\s*)?1\.0\b", "", ""),
    ("epl-2.0", ["epl-2.0"], "eclipse public", r"\beclipse public licen[cs]e(?:,?\s+|\s*-\s*)(?:version\s+|v\.?\s*)?2\.0\b", "", ""),
    ("cddl-1.0", ["cddl-1.0"], "cddl", r"\bcddl\b", "common development and distribution", r"common development and distribution licen[cs]e"),
    ("cddl-1.1", ["cddl-1.1"], "cddl", r"\bcddl[\s-]?(?:version\s+)?1\.1\b", "", ""),
    ("cpl-1.0", ["cpl-1.0"], "common public", r"\bcommon public licen[cs]e\b", "", ""),
    ("ibm-public", ["ipl-1.0"], "ibm public", r"\bibm public licen[cs]e\b", "", ""),
    ("eupl", ["eupl-1.0", "eupl-1.1", "eupl-1.2"], "eupl", r"\beupl\b", "european union public", r"european union public licen[cs]e"),
    ("artistic-1", ["artistic-1.0"], "artistic", r"\bartistic licen[cs]e(?! 2)\b", "", ""),
    ("artistic-2", ["artistic-2.0"], "artistic", r"\bartistic licen[cs]e,?\s+(?:version\s+)?2(?:\.0)?\b", "", ""),
    ("bsl-1.0", ["bsl-1.0"], "boost software", r"\bboost software licen[cs]e\b", "", ""),
    ("zlib", ["zlib"], "zlib", r"\bzlib licen[cs]e\b", "as-is", r"provided 'as-is', without any express or implied\s+warranty"),
    ("libpng", ["libpng", "libpng-2.0"], "libpng", r"\blibpng licen[cs]e\b", "", ""),
    ("unlicense", ["unlicense"], "unlicense", r"\bthe unlicense\b", "released into the public domain", r"free and unencumbered software released into the public domain"),
    ("wtfpl", ["wtfpl"], "wtfpl", r"\bwtfpl\b", "", ""),
    ("public-domain", [], "public domain", r"\b(?:in|into|to) the public domain\b", "", ""),
    ("cc0", ["cc0-1.0"], "cc0", r"\bcc0(?:[\s-]1\.0)?\b", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", ["cc-by-1.0", "cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0"], "by", r"\bcc[\s-]by(?:[\s-][1-4]\.[05])?\b(?![\s-](?:nc|sa|nd)\b)", "licenses/by/", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", ["cc-by-sa-1.0", "cc-by-sa-2.0", "cc-by-sa-2.5", "cc-by-sa-3.0", "cc-by-sa-4.0"], "sa", r"\bcc[\s-]by[\s-]sa\b", "licenses/by-sa/", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nd", ["cc-by-nd-3.0", "cc-by-nd-4.0"], "nd", r"\bcc[\s-]by[\s-]nd\b", "licenses/by-nd/", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc", ["cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0"], "nc", r"\bcc[\s-]by[\s-]nc\b(?![\s-](?:sa|nd)\b)", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc-sa", ["cc-by-nc-sa-3.0", "cc-by-nc-sa-4.0"], "nc", r"\bcc[\s-]by[\s-]nc[\s-]sa\b", "licenses/by-nc-sa/", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", ["cc-by-nc-nd-3.0", "cc-by-nc-nd-4.0"], "nc", r"\bcc[\s-]by[\s-]nc[\s-]nd\b", "licenses/by-nc-nd/", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("creative-commons", [], "creative commons", r"\bcreative commons licen[cs]e\b", "", ""),
    ("odbl", ["odbl-1.0"], "odbl", r"\bodbl\b", "open database", r"open database licen[cs]e"),
    ("odc-by", ["odc-by-1.0"], "odc-by", r"\bodc-by\b", "open data commons attribution", r"open data commons attribution licen[cs]e"),
    ("pddl", ["pddl-1.0"], "pddl", r"\bpddl\b", "", ""),
    ("ofl-1.1", ["ofl-1.0", "ofl-1.1"], "ofl", r"\bsil ofl\b", "open font", r"sil open font licen[cs]e"),
    ("python-2.0", ["python-2.0", "psf-2.0"], "python", r"\bpython software foundation licen[cs]e\b", "", ""),
    ("ruby", ["ruby"], "ruby", r"\bruby licen[cs]e\b", "", ""),
    ("php-3", ["php-3.0", "php-3.01"], "php", r"\bphp licen[cs]e\b", "", ""),
    ("perl", [], "perl", r"\bsame terms as perl\b", "", ""),
    ("openssl", ["openssl"], "openssl", r"\bopenssl licen[cs]e\b", "", ""),
    ("postgresql", ["postgresql"], "postgresql", r"\bpostgresql licen[cs]e\b", "", ""),
    ("sspl", ["sspl-1.0"], "server side public", r"\bserver side public licen[cs]e\b", "", ""),
    ("busl-1.1", ["busl-1.1"], "business source", r"\bbusiness source licen[cs]e\b", "", ""),
    ("elastic-2.0", ["elastic-2.0"], "elastic", r"\belastic licen[cs]e\b", "", ""),
    ("commons-clause", [], "commons clause", r"\bcommons clause\b", "", ""),
    ("ms-pl", ["ms-pl"], "microsoft public", r"\bmicrosoft public licen[cs]e\b", "", ""),
    ("ms-rl", ["ms-rl"], "microsoft reciprocal", r"\bmicrosoft reciprocal licen[cs]e\b", "", ""),
    ("vim", ["vim"], "vim", r"\bvim licen[cs]e\b", "", ""),
    ("ncsa", ["ncsa"], "ncsa", r"\buniversity of illinois/ncsa open source licen[cs]e\b", "", ""),
    ("osl-3.0", ["osl-3.0"], "open software", r"\bopen software licen[cs]e\b", "", ""),
    ("afl-3.0", ["afl-3.0"], "academic free", r"\bacademic free licen[cs]e\b", "", ""),
    ("upl-1.0", ["upl-1.0"], "universal permissive", r"\buniversal permissive licen[cs]e\b", "", ""),
    ("mulan", ["mulanpsl-2.0"], "mulan", r"\bmulan permissive software licen[cs]e\b", "", ""),
    ("cecill", ["cecill-2.1", "cecill-b", "cecill-c"], "cecill", r"\bcecill\b", "", ""),
    ("openrail", [], "openrail", r"\b(?:bigscience )?openrail(?:-m)?\b", "responsible ai", r"responsible ai licen[cs]es?\b"),
    ("proprietary", [], "all rights reserved", r"\ball rights reserved\b", "proprietary and confidential", r"proprietary and confidential"),
]


#: label, keyword and pattern of phrases in license texts; a space in the pattern is any white space.
TEXTS = [
    ("mit", "sublicense", r"use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies of the software"),
    ("mit", "permission", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", r"the software is provided \W{0,2}as is\W{0,2}, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", "liable", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("mit-0", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software .{1,200}?\. the software is provided"),
    ("isc", "permission", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", "permission", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted\."),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions"),
    ("bsd", "provided", r"this software is provided by the (?:copyright holders and contributors|regents and contributors|author) \W{0,2}as is"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "contributors", r"this product includes software developed by .{1,80}? and its contributors"),
    ("bsd-2-clause", "freebsd", r"the freebsd copyright"),
    ("bsd-3-clause", "regents", r"copyright .{1,40}?the regents of the university of california"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("apache-2", "apache", r"licensed under the apache license,? version 2\.0 \(the \W?license\W?\)"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", "applicable", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \W?as is\W? basis"),
    ("apache-2", "appendix", r"appendix: how to apply the apache license to your work"),
    ("apache-2", "foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", r"this program is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2", "option", r"gnu general public licen[cs]e as published by the free software foundation[;,] either version 2 of the licen[cs]e, or \(at your option\) any later version"),
    ("gpl-3", "option", r"gnu general public licen[cs]e as published by the free software foundation, either version 3 of the licen[cs]e, or \(at your option\) any later version"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public licen[cs]e"),
    ("gpl", "received", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", "gnu.org/licenses/gpl", r"gnu\.org/licenses/gpl(?:-[123]\.0)?(?:\.html|\.txt)?"),
    ("gpl-2", "gnu.org/licenses/old-licenses/gpl-2", r"gnu\.org/licenses/old-licenses/gpl-2\.0"),
    ("gpl-2-classpath", "classpath", r"gpl[\s-]?v?2(?:\.0)? with(?: the)? classpath exception"),
    ("gpl-2-classpath", "classpath", r"linking this library statically or dynamically with other modules .{1,200}?classpath"),
    ("gpl-3", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-2", "distribution", r"gnu general public license terms and conditions for copying, distribution and modification"),
    ("lgpl", "redistribute", r"this library is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "gnu.org/licenses/lgpl", r"gnu\.org/licenses/lgpl(?:-[23]\.[01])?"),
    ("lgpl-3", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3", "network", r"remote network interaction; use with the gnu general public license"),
    ("agpl-3", "gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("agpl-3", "affero", r"either version 3 of the licen[cs]e, or \(at your option\) any later version.{1,300}?affero general public licen[cs]e"),
    ("gfdl", "invariant", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", "document", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-1.0", "mozilla.org/npl", r"mozilla\.org/npl"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("mpl-1.1", "mozilla.org/mpl/mpl-1.1", r"mozilla\.org/mpl/mpl-1\.1"),
    ("mpl-2.0", "source", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0"),
    ("mpl-2.0", "incompatible", r"this source code form is \W?incompatible with secondary licenses\W?"),
    ("epl-1.0", "eclipse.org/legal/epl-v10", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse.org/legal/epl", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", r"\beclipse distribution licen[cs]e\b"),
    ("cddl-1.0", "common", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl-1.0", "opensource.org/licenses/cddl", r"opensource\.org/licenses/cddl-?1(?:\.0)?"),
    ("cpl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the common public licen[cs]e"),
    ("eupl", "eupl", r"licensed under the eupl,? version 1\.[012]"),
    ("artistic-1", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "artistic", r"everyone is permitted to copy and distribute verbatim copies of this license document.{1,200}?the artistic license 2\.0"),
    ("perl", "perl", r"(?:free software; )?you (?:can|may) (?:re)?distribute it and/or modify it under the same terms as perl itself"),
    ("bsl-1.0", "boost.org/licen", r"boost\.org/licen[cs]e_1_0\.txt"),
    ("bsl-1.0", "boost", r"distributed under the boost software licen[cs]e, version 1\.0"),
    ("bsl-1.0", "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "origin", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib", "granted", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("libpng", "png", r"\blibpng versions? .{1,60}?are copyright"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software"),
    ("unlicense", "dedicate", r"dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("cc0", "waived", r"to the extent possible under law, .{1,120}? (?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0", "cc0", r"cc0 1\.0 universal"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)? (?:public )?licen[cs]e"),
    ("cc-by-sa", "alike", r"creative commons attribution[\s-]+share\s?alike(?: [1-4]\.[05])?"),
    ("cc-by-sa", "share", r"creative commons attribution[\s-]+share[\s-]alike(?: [1-4]\.[05])?"),
    ("cc-by-nd", "deriv", r"creative commons attribution[\s-]+no[\s-]?deriv(?:ative)?s"),
    ("cc-by-nd", "derivatives", r"creative commons attribution[\s-]+no[\s-]?derivatives"),
    ("cc-by-nc", "commercial", r"creative commons attribution[\s-]+non[\s-]?commercial(?! ?-? ?(?:share|no))"),
    ("cc-by-nc-sa", "share", r"creative commons attribution[\s-]+non[\s-]?commercial[\s-]+share[\s-]?alike"),
    ("cc-by-nc-nd", "deriv", r"creative commons attribution[\s-]+non[\s-]?commercial[\s-]+no[\s-]?deriv"),
    ("creative-commons", "reserved", r"some rights reserved"),
    ("odbl", "opendatacommons.org/licenses/odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons.org/licenses/by", r"opendatacommons\.org/licenses/by"),
    ("pddl", "opendatacommons.org/licenses/pddl", r"opendatacommons\.org/licenses/pddl"),
    ("pddl", "dedication", r"public domain dedication and licen[cs]e"),
    ("ofl-1.1", "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    ("ofl-1.1", "reserved", r"with reserved font name"),
    ("python-2.0", "python", r"this licen[cs]e agreement is between the python software foundation"),
    ("ruby", "ruby", r"(?:under|on) the same terms as ruby(?: itself)?"),
    ("php-3", "php.net/license", r"php\.net/license/3_0"),
    ("php-3", "php", r"this product includes php(?: software)?, freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("postgresql", "permission", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("sspl", "mongodb.com/licensing", r"mongodb\.com/licensing/server-side-public-license"),
    ("sspl", "service", r"offering the program as a service"),
    ("busl-1.1", "change", r"change license: .{1,80}"),
    ("busl-1.1", "additional", r"additional use grant:"),
    ("elastic-2.0", "elastic.co/licensing", r"elastic\.co/licensing/elastic-license"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "sell", r"the grant of rights under the license will not include,? and the license does not grant to you,? the right to sell the software"),
    ("ms-pl", "contributor", r"each contributor grants you a non-exclusive, worldwide, royalty-free copyright license"),
    ("ncsa", "illinois", r"permission is hereby granted, free of charge, .{1,200}?the names of .{1,60}?university of illinois"),
    ("vim", "vim", r"there are no restrictions on (?:using, )?distributing unmodified copies of vim"),
    ("x11", "consortium", r"x consortium be liable for any claim"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("beerware", "beer", r"\bbeer-?ware licen[cs]e\b"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("curl", "curl", r"\bcurl licen[cs]e\b"),
    ("ftl", "freetype", r"\bfreetype (?:project )?licen[cs]e\b"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("icu", "icu", r"\bicu licen[cs]e\b"),
    ("unicode", "unicode.org/copyright", r"unicode\.org/copyright"),
    ("unicode", "unicode", r"unicode, inc\. licen[cs]e agreement"),
    ("w3c", "w3.org/consortium/legal", r"w3\.org/consortium/legal"),
    ("w3c", "w3c", r"\bw3c (?:software|document) (?:notice and )?licen[cs]e\b"),
    ("bittorrent", "bittorrent", r"\bbittorrent open source licen[cs]e\b"),
    ("ecl-2.0", "educational", r"\beducational community licen[cs]e\b"),
    ("sleepycat", "sleepycat", r"\bsleepycat licen[cs]e\b"),
    ("qpl", "public", r"\bq public licen[cs]e\b"),
    ("zpl", "zope", r"\bzope public licen[cs]e\b"),
    ("lppl", "latex", r"\blatex project public licen[cs]e\b"),
    ("nasa", "nasa", r"\bnasa open source agreement\b"),
    ("nposl", "non-profit open", r"\bnon-profit open software licen[cs]e\b"),
    ("etalab", "etalab", r"\b(?:licence ouverte|open licen[cs]e)\W+etalab\b"),
    ("ogl-uk", "government", r"\bopen government licen[cs]e\b"),
    ("ogl-uk", "nationalarchives.gov.uk/doc/open", r"nationalarchives\.gov\.uk/doc/open-government-licen[cs]e"),
    ("cdla", "community", r"\bcommunity data licen[cs]e agreement\b"),
    ("cdla", "cdla", r"\bcdla[\s-](?:permissive|sharing)\b"),
    ("openrail", "restrictions", r"use[\s-]based restrictions"),
    ("llama", "llama", r"\bllama [23](?:\.[0-9])? community licen[cs]e\b"),
    ("gemma", "gemma", r"\bgemma terms of use\b"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution) of (?:this|the) .{1,60}?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "evaluation", r"for evaluation purposes only"),
    ("non-commercial", "commercial", r"for (?:personal|academic|research|educational)(?:,| and| or)? non[\s-]?commercial use only"),
    ("non-commercial", "commercial", r"not for commercial use"),
    ("public-domain", "dedicated", r"(?:hereby )?dedicated to the public domain"),
    ("public-domain", "disclaim", r"the author(?:s)? (?:hereby )?disclaims? copyright to this source code"),
]


def _needed(pattern: str) -> list[str]:
    """For each alternative of a pattern the text that its matches hold for sure, other places blank."""
    while (plain := re.sub(r"\((?:[^()\\]|\\.)*\)(?:[?*+]|\{[\d,]*\})?\??", " ", pattern)) != pattern:
        pattern = plain
    pattern = re.sub(r"\[(?:[^\]\\]|\\.)*\]", " ", pattern)  # classes
    pattern = re.sub(r"(?:\\.|[^\\])(?:[?*]|\{[\d,]*\})", " ", pattern)  # what may be missing
    pattern = re.sub(r"\\[a-zA-Z]\+?", " ", pattern)
    return re.sub(r"\\(.)", r"\1", pattern).split("|")


def _kind(keyword: str, pattern: str) -> str:
    """The first literal of ``HINTS`` that every match of the pattern holds, else the keyword."""
    parts = _needed(pattern)
    return next((h for h in HINTS if all(h in x for x in parts)), keyword)


def rules() -> list[dict]:
    """The rules in order: label, kind, keyword, priority and pattern."""
    out = []
    for label, ids, key, name, own_key, own in LICENSES:
        for x in ids:
            out.append({"label": label, "kind": "#tag", "kw": x, "priority": 100, "rx": rf"spdx-licen[cs]e-identifier:\s*{x.replace('.', '[.]')}(?![\w.-])"})
        if own:
            out.append({"label": label, "kind": _kind(own_key, own), "kw": own_key, "priority": 90, "rx": own})
        out.append({"label": label, "kind": "#grant", "kw": key, "priority": 80, "rx": rf"{GRANT[:-2]}\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:gnu\s+)?(?:{name})"})
        out.append({"label": label, "kind": "#cc" if name.startswith(KINDS["#cc"][1]) else _kind(key, name), "kw": key, "priority": 60, "rx": name})
    for label, key, phrase in TEXTS:
        out.append({"label": label, "kind": _kind(key, phrase), "kw": key, "priority": 90, "rx": phrase.replace(" ", r"\s+")})
    for phrase, label in BASE:
        gap = "[^a-z0-9\\x80-\\x{10FFFF}]+"
        out.append({"label": label, "kind": "#base", "kw": phrase.split()[-2], "priority": 70, "rx": r"(?<![a-z0-9\x80-\x{10FFFF}])" + gap.join(phrase.split()) + r"(?![a-z0-9\x80-\x{10FFFF}])"})
    return out


def _standing(spans: Column, priorities: list[int]) -> Column:
    """Places (start, end, priority, rule, label) without those inside another one of at least their priority.

    In order of start, longest and highest first, whatever covers a place stands before it: it is covered if
    an earlier end of at least its priority reaches its own.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), (-s["priority"]).alias("low"), s["rule"].alias("rule"), s["label"].alias("label"))))

    def reach(s: Column) -> Column:
        ends = lambda p: F.transform(s, lambda x: F.when(-x["low"] >= p, -x["back"]).otherwise(-1))
        return F.struct(s.alias("s"), *(let(ends(p), lambda x: running(x, F.greatest)).alias(f"p{p}") for p in priorities))

    def kept(t: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            out = F.lit(-1)
            for p in priorities:
                out = F.when(-x["low"] == p, F.coalesce(F.get(t[f"p{p}"], i - 1), F.lit(-1))).otherwise(out)
            return out

        left = F.filter(t["s"], lambda x, i: before(x, i) < -x["back"])
        return F.transform(left, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), (-x["low"]).alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))

    return let(order, lambda s: let(reach(s), kept))


def _starts(words: Column, phrase: list[str], label: str) -> Column:
    """array<struct<word, label>>: where the words of ``phrase`` stand consecutively."""

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(phrase):
            same = same & (F.get(words, i + k) == word)
        return F.coalesce(same, F.lit(False))

    firsts = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull() & here(i))
    return F.transform(firsts, lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))


def _base_places(words: Column) -> Column:
    return F.array_sort(F.concat(*(_starts(words, phrase.split(), label) for phrase, label in BASE)))


def _all_places(low: Column, near: Column, listed: list[dict]) -> Column:
    """Places of all rules whose keyword and kind the text holds."""
    held = F.from_json(F.lit(json.dumps([r | {"rule": i} for i, r in enumerate(listed)])), "array<struct<label:string,kind:string,kw:string,priority:int,rx:string,rule:int>>")

    def met(t: Column, kind: str) -> Column:
        literal, rx = KINDS.get(kind, (kind, None))
        return F.when((t.contains(literal) if literal else F.lit(True)) & (t.rlike(rx) if rx and kind != "#base" else F.lit(True)), F.lit(kind))

    kinds = sorted({r["kind"] for r in listed} - {"#base"})
    known = lambda t: F.filter(F.array(*(met(t, k) for k in kinds), F.when(near, F.lit("#base"))), lambda k: k.isNotNull())
    one = lambda t: lambda r: matches(t["low"], r["rx"], lambda i, start, end, _: F.struct(start.alias("start"), end.alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))
    runs = lambda t: F.filter(held, lambda r: F.array_contains(t["kinds"], r["kind"]) & F.contains(t["low"], r["kw"]))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>")
    found = lambda t: F.when(F.size(t["kinds"]) > 0, F.flatten(F.transform(runs(t), one(t)))).otherwise(none)
    return let(F.struct(low.alias("low"), known(low).alias("kinds")), found)


def scan(docs: DataFrame, text: str = "text", listed: list[dict] | None = None) -> DataFrame:
    """``docs`` with n_words, places (base: array of (word, label)), spans and score; ``listed`` replaces ``rules()``."""
    listed = rules() if listed is None else listed
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = list(docs.columns)

    def name(x: str) -> str:
        taken.append(fresh(x, taken))
        return taken[-1]

    n_words, places, spans, score, low_, near_ = map(name, ("n_words", "places", "spans", "score", "low", "near"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(*own, F.when(whole.rlike(TO_ASCII), F.translate(whole, UPPER, LOWER)).otherwise(F.lower(whole)).alias(low_))
    low = F.col(low_)
    found = found.select("*", low.rlike(KINDS["#base"][1]).alias(near_))
    near = F.col(near_)
    found = found.select("*", _all_places(low, near, listed).alias(spans))
    standing = F.when(F.size(spans) > 1, _standing(F.col(spans), sorted({r["priority"] for r in listed}))).otherwise(F.col(spans))
    found = found.select(*own, low, near, standing.alias(spans))
    pieces = F.split(low, SEPARATOR, -1)
    words = F.filter(pieces, lambda w: w != "")
    # Only the first and the last piece can be empty.
    empty = lambda x: (F.get(x, F.lit(0)) == "").cast("int") + ((F.size(x) > 1) & (F.get(x, F.size(x) - 1) == "")).cast("int")
    none = F.array().cast("array<struct<word:bigint,label:string>>")
    return found.select(
        *own,
        let(pieces, lambda x: F.size(x) - empty(x)).cast("long").alias(n_words),
        F.when(near, let(words, _base_places)).otherwise(none).alias(places),
        F.col(spans),
        (F.coalesce(F.array_max(F.transform(spans, lambda s: s["priority"])), F.lit(0)) / 100.0).cast("double").alias(score),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.transform("places", lambda p: p["label"])
    both = F.concat(base, F.transform("spans", lambda s: s["label"]))
    word = F.transform("places", lambda p: p["word"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        listed(base).alias("base_labels"), listed(both).alias("labels"), "score",
    )
