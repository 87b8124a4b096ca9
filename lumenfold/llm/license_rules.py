"""Signature rules of the licence scan, in order: (label, priority, keyword, regex).

Regexes are Java's, for lower-case text on one line. Every match of a rule
contains its keyword, so a line without the keyword needs no matching. Priority:
90 an identifier or address that names one licence, 70 a name with its version,
50 a sentence of a licence's text, 30 a name without version, 10 a mere hint.
"""

RULES: tuple[tuple[str, int, str, str], ...] = (
    # identifiers in source headers
    ("spdx-expression", 20, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*[\w.+() -]{2,80}"),
    ("mit", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*mit\b(?!-)"),
    ("mit-0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*mit-0\b"),
    ("apache-2.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*apache-2\.0\b"),
    ("apache-1.1", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*apache-1\.1\b"),
    ("gpl-2.0-only", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*gpl-2\.0(?:-only)?(?![-+\w])"),
    ("gpl-2.0-or-later", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*gpl-2\.0(?:-or-later|\+)"),
    ("gpl-3.0-only", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*gpl-3\.0(?:-only)?(?![-+\w])"),
    ("gpl-3.0-or-later", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*gpl-3\.0(?:-or-later|\+)"),
    ("lgpl-2.1-only", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*lgpl-2\.1(?:-only)?(?![-+\w])"),
    ("lgpl-2.1-or-later", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*lgpl-2\.1(?:-or-later|\+)"),
    ("lgpl-3.0-only", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*lgpl-3\.0(?:-only)?(?![-+\w])"),
    ("lgpl-3.0-or-later", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*lgpl-3\.0(?:-or-later|\+)"),
    ("agpl-3.0-only", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*agpl-3\.0(?:-only)?(?![-+\w])"),
    ("agpl-3.0-or-later", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*agpl-3\.0(?:-or-later|\+)"),
    ("bsd-2-clause", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*bsd-2-clause\b(?!-)"),
    ("bsd-3-clause", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*bsd-3-clause\b(?!-)"),
    ("bsd-4-clause", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*bsd-4-clause\b(?!-)"),
    ("0bsd", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*0bsd\b"),
    ("isc", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*isc\b"),
    ("mpl-1.1", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*mpl-1\.1\b"),
    ("mpl-2.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*mpl-2\.0\b"),
    ("epl-1.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*epl-1\.0\b"),
    ("epl-2.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*epl-2\.0\b"),
    ("cddl-1.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*cddl-1\.0\b"),
    ("cddl-1.1", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*cddl-1\.1\b"),
    ("eupl-1.2", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*eupl-1\.2\b"),
    ("unlicense", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*unlicense\b"),
    ("zlib", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*zlib\b"),
    ("bsl-1.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*bsl-1\.0\b"),
    ("wtfpl", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*wtfpl\b"),
    ("cc0-1.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*cc0-1\.0\b"),
    ("cc-by-4.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*cc-by-4\.0\b"),
    ("cc-by-sa-4.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*cc-by-sa-4\.0\b"),
    ("artistic-2.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*artistic-2\.0\b"),
    ("ofl-1.1", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*ofl-1\.1\b"),
    ("blueoak-1.0.0", 90, "spdx-license-identifier", r"spdx-license-identifier\s*:\s*blueoak-1\.0\.0\b"),
    # addresses
    ("apache-2.0", 90, "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", 90, "apache.org/licenses", r"apache\.org/licenses/license-1\.1"),
    ("mit", 90, "opensource.org/licenses", r"opensource\.org/licenses/mit\b(?!-)"),
    ("bsd-2-clause", 90, "opensource.org/licenses", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", 90, "opensource.org/licenses", r"opensource\.org/licenses/bsd-3-clause"),
    ("isc", 90, "opensource.org/licenses", r"opensource\.org/licenses/isc\b"),
    ("artistic-2.0", 90, "opensource.org/licenses", r"opensource\.org/licenses/artistic-2\.0"),
    ("zlib", 90, "opensource.org/licenses", r"opensource\.org/licenses/zlib"),
    ("cpl-1.0", 90, "opensource.org/licenses", r"opensource\.org/licenses/cpl1?\.?0?\b"),
    ("ms-pl", 90, "opensource.org/licenses", r"opensource\.org/licenses/ms-pl"),
    ("gpl-2.0-only", 60, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0-only", 60, "gnu.org/licenses", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1-only", 60, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0-only", 60, "gnu.org/licenses", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0-only", 60, "gnu.org/licenses", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl-1.3", 60, "gnu.org/licenses", r"gnu\.org/licenses/fdl-1\.3"),
    ("gnu-unversioned", 10, "gnu.org/licenses", r"gnu\.org/licenses/?"),
    ("mpl-1.1", 90, "mozilla.org/mpl", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", 90, "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"),
    ("mpl", 30, "mozilla.org/mpl", r"mozilla\.org/mpl/?"),
    ("epl-1.0", 90, "eclipse.org/", r"eclipse\.org/(?:legal|org/documents)/epl-v10"),
    ("epl-2.0", 90, "eclipse.org/", r"eclipse\.org/(?:legal|org/documents)/epl-(?:v20|2\.0)"),
    ("unlicense", 90, "unlicense.org", r"(?:www\.)?unlicense\.org"),
    ("wtfpl", 90, "wtfpl.net", r"(?:www\.)?wtfpl\.net"),
    ("bsl-1.0", 90, "boost.org/license", r"boost\.org/license_1_0\.txt"),
    ("ofl-1.1", 90, "scripts.sil.org/ofl", r"scripts\.sil\.org/ofl"),
    ("cc0-1.0", 90, "creativecommons.org/publicdomain", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain-mark", 90, "creativecommons.org/publicdomain", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by-1.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by/1\.0"),
    ("cc-by-2.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by/2\.0"),
    ("cc-by-2.5", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by/2\.5"),
    ("cc-by-3.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-4.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa-2.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-sa/2\.0"),
    ("cc-by-sa-2.5", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-sa/2\.5"),
    ("cc-by-sa-3.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-sa-4.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-nd-3.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nd/3\.0"),
    ("cc-by-nd-4.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-2.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc/2\.0"),
    ("cc-by-nc-3.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("cc-by-nc-4.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc-sa-3.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc-sa/3\.0"),
    ("cc-by-nc-sa-4.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-3.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc-nd/3\.0"),
    ("cc-by-nc-nd-4.0", 90, "creativecommons.org/licenses", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    # names with a version
    ("apache-2.0", 70, "apache", r"apache(?: software)? licen[sc]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*2(?:\.0)?\b"),
    ("apache-1.1", 70, "apache", r"apache(?: software)? licen[sc]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*1\.1\b"),
    ("apache-1.0", 70, "apache", r"apache(?: software)? licen[sc]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*1\.0\b"),
    ("apache-2.0", 70, "apache", r"\bapache-2\.0\b"),
    ("apache-2.0", 70, "apache", r"\bapache 2(?:\.0)? licen[sc]e\b"),
    ("gpl-1.0", 70, "general public licen", r"(?<!lesser )(?<!library )(?<!affero )general public licen[sc]e,?\s*(?:as published by the free software foundation[;,]?\s*)?(?:either\s*)?(?:version|v\.?)\s*1(?:\.0)?\b"),
    ("gpl-2.0", 70, "general public licen", r"(?<!lesser )(?<!library )(?<!affero )general public licen[sc]e,?\s*(?:as published by the free software foundation[;,]?\s*)?(?:either\s*)?(?:version|v\.?)\s*2(?:\.0)?\b"),
    ("gpl-3.0", 70, "general public licen", r"(?<!lesser )(?<!library )(?<!affero )general public licen[sc]e,?\s*(?:as published by the free software foundation[;,]?\s*)?(?:either\s*)?(?:version|v\.?)\s*3(?:\.0)?\b"),
    ("lgpl-2.0", 70, "library general public licen", r"library general public licen[sc]e,?\s*(?:version|v\.?)\s*2(?:\.0)?\b"),
    ("lgpl-2.1", 70, "lesser general public licen", r"lesser general public licen[sc]e,?\s*(?:either\s*)?(?:version|v\.?)\s*2\.1\b"),
    ("lgpl-3.0", 70, "lesser general public licen", r"lesser general public licen[sc]e,?\s*(?:either\s*)?(?:version|v\.?)\s*3(?:\.0)?\b"),
    ("agpl-3.0", 70, "affero general public licen", r"affero general public licen[sc]e,?\s*(?:either\s*)?(?:version|v\.?)\s*3(?:\.0)?\b"),
    ("agpl-1.0", 70, "affero general public licen", r"affero general public licen[sc]e,?\s*(?:either\s*)?(?:version|v\.?)\s*1(?:\.0)?\b"),
    ("gpl-2.0", 70, "gpl", r"(?<![al])\bgpl[ -]?v?2(?:\.0)?\b"),
    ("gpl-3.0", 70, "gpl", r"(?<![al])\bgpl[ -]?v?3(?:\.0)?\b"),
    ("gpl-2.0-or-later", 75, "gpl", r"\bgpl[ -]?v?2(?:\.0)?(?:\+|-or-later| or later)"),
    ("gpl-3.0-or-later", 75, "gpl", r"\bgpl[ -]?v?3(?:\.0)?(?:\+|-or-later| or later)"),
    ("lgpl-2.1", 70, "lgpl", r"\blgpl[ -]?v?2\.1\b"),
    ("lgpl-3.0", 70, "lgpl", r"\blgpl[ -]?v?3(?:\.0)?\b"),
    ("lgpl-2.1-or-later", 75, "lgpl", r"\blgpl[ -]?v?2\.1(?:\+|-or-later| or later)"),
    ("lgpl-3.0-or-later", 75, "lgpl", r"\blgpl[ -]?v?3(?:\.0)?(?:\+|-or-later| or later)"),
    ("agpl-3.0", 70, "agpl", r"\bagpl[ -]?v?3(?:\.0)?\b"),
    ("agpl-3.0-or-later", 75, "agpl", r"\bagpl[ -]?v?3(?:\.0)?(?:\+|-or-later| or later)"),
    ("mpl-1.0", 70, "mozilla public licen", r"mozilla public licen[sc]e,?\s*\(?(?:version|v\.?)?\s*1\.0\b"),
    ("mpl-1.1", 70, "mozilla public licen", r"mozilla public licen[sc]e,?\s*\(?(?:version|v\.?)?\s*1\.1\b"),
    ("mpl-2.0", 70, "mozilla public licen", r"mozilla public licen[sc]e,?\s*\(?(?:version|v\.?)?\s*2\.0\b"),
    ("mpl-2.0", 70, "mpl", r"\bmpl[ -]?v?2\.0\b"),
    ("mpl-1.1", 70, "mpl", r"\bmpl[ -]?v?1\.1\b"),
    ("epl-1.0", 70, "eclipse public licen", r"eclipse public licen[sc]e,?\s*(?:-\s*)?(?:version|v\.?)?\s*1\.0\b"),
    ("epl-2.0", 70, "eclipse public licen", r"eclipse public licen[sc]e,?\s*(?:-\s*)?(?:version|v\.?)?\s*2\.0\b"),
    ("cddl-1.0", 70, "common development and distribution licen", r"common development and distribution licen[sc]e,?\s*(?:\(cddl\),?\s*)?(?:version|v\.?)?\s*1\.0\b"),
    ("cddl-1.1", 70, "common development and distribution licen", r"common development and distribution licen[sc]e,?\s*(?:\(cddl\),?\s*)?(?:version|v\.?)?\s*1\.1\b"),
    ("cpl-1.0", 70, "common public licen", r"common public licen[sc]e,?\s*(?:version|v\.?)?\s*1\.0\b"),
    ("eupl-1.1", 70, "european union public licen", r"european union public licen[sc]e,?\s*(?:\(eupl\),?\s*)?(?:version|v\.?)?\s*1\.1\b"),
    ("eupl-1.2", 70, "european union public licen", r"european union public licen[sc]e,?\s*(?:\(eupl\),?\s*)?(?:version|v\.?)?\s*1\.2\b"),
    ("eupl-1.2", 70, "eupl", r"\beupl[ -]?v?1\.2\b"),
    ("eupl-1.1", 70, "eupl", r"\beupl[ -]?v?1\.1\b"),
    ("osl-3.0", 70, "open software licen", r"open software licen[sc]e,?\s*(?:\(osl\),?\s*)?(?:version|v\.?)?\s*3\.0\b"),
    ("afl-2.1", 70, "academic free licen", r"academic free licen[sc]e,?\s*(?:version|v\.?)?\s*2\.1\b"),
    ("afl-3.0", 70, "academic free licen", r"academic free licen[sc]e,?\s*(?:version|v\.?)?\s*3\.0\b"),
    ("artistic-1.0", 70, "artistic licen", r"artistic licen[sc]e,?\s*(?:version|v\.?)?\s*1\.0\b"),
    ("artistic-2.0", 70, "artistic licen", r"artistic licen[sc]e,?\s*(?:version|v\.?)?\s*2\.0\b"),
    ("bsl-1.0", 70, "boost software licen", r"boost software licen[sc]e,?\s*(?:-\s*)?(?:version|v\.?)?\s*1\.0\b"),
    ("busl-1.1", 70, "business source licen", r"business source licen[sc]e,?\s*(?:version|v\.?)?\s*1\.1\b"),
    ("sspl-1.0", 70, "server side public licen", r"server side public licen[sc]e,?\s*(?:\(sspl\),?\s*)?(?:version|v\.?)?\s*1\b"),
    ("elastic-2.0", 70, "elastic licen", r"elastic licen[sc]e,?\s*(?:version|v\.?)?\s*2\.0\b"),
    ("gfdl-1.1", 70, "free documentation licen", r"free documentation licen[sc]e,?\s*(?:version|v\.?)?\s*1\.1\b"),
    ("gfdl-1.2", 70, "free documentation licen", r"free documentation licen[sc]e,?\s*(?:version|v\.?)?\s*1\.2\b"),
    ("gfdl-1.3", 70, "free documentation licen", r"free documentation licen[sc]e,?\s*(?:version|v\.?)?\s*1\.3\b"),
    ("ofl-1.1", 70, "open font licen", r"(?:sil )?open font licen[sc]e,?\s*(?:version|v\.?)?\s*1\.1\b"),
    ("odbl-1.0", 70, "open database licen", r"open database licen[sc]e,?\s*(?:\(odbl\),?\s*)?(?:version|v\.?)?\s*1\.0\b"),
    ("odc-by-1.0", 70, "open data commons attribution licen", r"open data commons attribution licen[sc]e,?\s*(?:version|v\.?)?\s*1\.0\b"),
    ("python-2.0", 70, "python software foundation licen", r"python software foundation licen[sc]e,?\s*(?:version|v\.?)?\s*2\b"),
    ("php-3.01", 70, "php licen", r"php licen[sc]e,?\s*(?:version|v\.?)?\s*3\.01\b"),
    ("zpl-2.1", 70, "zope public licen", r"zope public licen[sc]e,?\s*(?:\(zpl\),?\s*)?(?:version|v\.?)?\s*2\.1\b"),
    ("lppl-1.3c", 70, "latex project public licen", r"latex project public licen[sc]e,?\s*(?:version|v\.?)?\s*1\.3c?\b"),
    ("mulan-psl-2.0", 70, "mulan psl", r"mulan psl\s*v?2\b"),
    ("openssl", 70, "openssl", r"\bopenssl licen[sc]e\b"),
    ("openrail-m", 70, "openrail", r"\bopenrail(?:-m|\+\+)?\b"),
    ("llama-community", 70, "llama", r"\bllama \d(?:\.\d)? community licen[sc]e\b"),
    ("cc0-1.0", 70, "cc0", r"\bcc0(?:[ -]1\.0)?\b"),
    ("cc-by-2.0", 70, "cc", r"\bcc[ -]by[ -]2\.0\b"),
    ("cc-by-2.5", 70, "cc", r"\bcc[ -]by[ -]2\.5\b"),
    ("cc-by-3.0", 70, "cc", r"\bcc[ -]by[ -]3\.0\b"),
    ("cc-by-4.0", 70, "cc", r"\bcc[ -]by[ -]4\.0\b"),
    ("cc-by-sa-2.0", 70, "cc", r"\bcc[ -]by-sa[ -]2\.0\b"),
    ("cc-by-sa-2.5", 70, "cc", r"\bcc[ -]by-sa[ -]2\.5\b"),
    ("cc-by-sa-3.0", 70, "cc", r"\bcc[ -]by-sa[ -]3\.0\b"),
    ("cc-by-sa-4.0", 70, "cc", r"\bcc[ -]by-sa[ -]4\.0\b"),
    ("cc-by-nd-3.0", 70, "cc", r"\bcc[ -]by-nd[ -]3\.0\b"),
    ("cc-by-nd-4.0", 70, "cc", r"\bcc[ -]by-nd[ -]4\.0\b"),
    ("cc-by-nc-2.0", 70, "cc", r"\bcc[ -]by-nc[ -]2\.0\b"),
    ("cc-by-nc-3.0", 70, "cc", r"\bcc[ -]by-nc[ -]3\.0\b"),
    ("cc-by-nc-4.0", 70, "cc", r"\bcc[ -]by-nc[ -]4\.0\b"),
    ("cc-by-nc-sa-3.0", 70, "cc", r"\bcc[ -]by-nc-sa[ -]3\.0\b"),
    ("cc-by-nc-sa-4.0", 70, "cc", r"\bcc[ -]by-nc-sa[ -]4\.0\b"),
    ("cc-by-nc-nd-3.0", 70, "cc", r"\bcc[ -]by-nc-nd[ -]3\.0\b"),
    ("cc-by-nc-nd-4.0", 70, "cc", r"\bcc[ -]by-nc-nd[ -]4\.0\b"),
    ("cc-by-3.0", 70, "creative commons", r"creative commons attribution 3\.0(?: unported)?"),
    ("cc-by-4.0", 70, "creative commons", r"creative commons attribution 4\.0(?: international)?"),
    ("cc-by-sa-3.0", 70, "creative commons", r"creative commons attribution[ -]share-?alike 3\.0(?: unported)?"),
    ("cc-by-sa-4.0", 70, "creative commons", r"creative commons attribution[ -]share-?alike 4\.0(?: international)?"),
    ("cc-by-nc-4.0", 70, "creative commons", r"creative commons attribution[ -]non-?commercial 4\.0(?: international)?"),
    ("cc-by-nc-sa-4.0", 70, "creative commons", r"creative commons attribution[ -]non-?commercial[ -]share-?alike 4\.0(?: international)?"),
    ("cc-by-nd-4.0", 70, "creative commons", r"creative commons attribution[ -]no-?deriv(?:ative)?s 4\.0(?: international)?"),
    ("cc-by-nc-nd-4.0", 70, "creative commons", r"creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s 4\.0(?: international)?"),
    ("bsd-2-clause", 70, "bsd", r"\b(?:bsd[ -]2[ -]clause|2[ -]clause bsd|two[ -]clause bsd|simplified bsd)\b"),
    ("bsd-3-clause", 70, "bsd", r"\b(?:bsd[ -]3[ -]clause|3[ -]clause bsd|three[ -]clause bsd|new bsd|modified bsd|revised bsd)\b"),
    ("bsd-4-clause", 70, "bsd", r"\b(?:bsd[ -]4[ -]clause|4[ -]clause bsd|four[ -]clause bsd|original bsd)\b"),
    ("0bsd", 70, "bsd", r"\b(?:0bsd|zero[ -]clause bsd|0[ -]clause bsd)\b"),
    # sentences of licence texts
    ("mit", 50, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 50, "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", 50, "permission to use, copy, modify", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 50, "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", 50, "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 50, "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 55, "endorse or promote products", r"(?:names? of|nor the names of) .{0,80}may (?:not )?be used to endorse or promote products"),
    ("bsd-4-clause", 55, "advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 50, "licensed under the apache", r"licensed under the apache licen[sc]e, version 2\.0"),
    ("apache-2.0", 50, "may not use this file except in compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 50, "licensed to the apache software foundation", r"licensed to the apache software foundation \(asf\) under one or more contributor"),
    ("gpl-or-later", 55, "any later version", r"(?:version \d(?:\.\d)? of the licen[sc]e,? )?or \(?at your option\)? any later version"),
    ("gpl", 50, "is free software", r"is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu"),
    ("gpl", 50, "gnu general public licen", r"gnu general public licen[sc]e for more details"),
    ("gpl", 50, "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("lgpl", 50, "gnu lesser general public licen", r"gnu lesser general public licen[sc]e for more details"),
    ("agpl", 50, "gnu affero general public licen", r"gnu affero general public licen[sc]e for more details"),
    ("mpl-2.0", 50, "source code form is subject to", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-1.1", 50, "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1\.1"),
    ("epl", 50, "accompanying materials are made available", r"accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("unlicense", 50, "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 50, "provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty"),
    ("zlib", 50, "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such"),
    ("wtfpl", 50, "do what the fuck you want", r"do what the fuck you want to public licen[sc]e"),
    ("bsl-1.0", 50, "boost software license", r"distributed under the boost software license"),
    ("beerware", 50, "buy me a beer", r"you can buy me a beer in return"),
    ("x11", 50, "x consortium", r"except as contained in this notice, the name of the x consortium"),
    ("cc0-1.0", 50, "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("ofl-1.1", 50, "reserved font name", r"with reserved font name"),
    ("json", 50, "used for good, not evil", r"shall be used for good, not evil"),
    ("no-warranty", 10, "without warranty of any kind", r"without warranty of any kind, express or implied"),
    ("no-warranty", 10, "as is", r"(?:provided|distributed)[^.]{0,60} \W{0,2}as is\W{0,2}"),
    # names without a version
    ("mit", 30, "mit licen", r"\bmit licen[sc]ed?\b"),
    ("mit", 30, "licen", r"\blicen[sc]ed? under (?:the )?mit\b"),
    ("mit", 30, "expat licen", r"\bexpat licen[sc]e\b"),
    ("apache", 30, "apache", r"\bapache(?: software)? licen[sc]ed?\b"),
    ("gpl", 30, "general public licen", r"\b(?:gnu )?general public licen[sc]e\b"),
    ("lgpl", 35, "lesser general public licen", r"\b(?:gnu )?lesser general public licen[sc]e\b"),
    ("lgpl", 35, "library general public licen", r"\b(?:gnu )?library general public licen[sc]e\b"),
    ("agpl", 35, "affero general public licen", r"\b(?:gnu )?affero general public licen[sc]e\b"),
    ("gpl", 30, "gpl", r"\b(?:gnu )?gpl\b"),
    ("lgpl", 30, "lgpl", r"\b(?:gnu )?lgpl\b"),
    ("agpl", 30, "agpl", r"\b(?:gnu )?agpl\b"),
    ("gfdl", 30, "free documentation licen", r"\b(?:gnu )?free documentation licen[sc]e\b"),
    ("bsd", 30, "bsd", r"\bbsd(?:[ -]style)? licen[sc]ed?\b"),
    ("isc", 30, "isc licen", r"\bisc licen[sc]ed?\b"),
    ("mpl", 30, "mozilla public licen", r"\bmozilla public licen[sc]e\b"),
    ("epl", 30, "eclipse public licen", r"\beclipse public licen[sc]e\b"),
    ("cddl", 30, "common development and distribution licen", r"\bcommon development and distribution licen[sc]e\b"),
    ("cddl", 30, "cddl", r"\bcddl\b"),
    ("eupl", 30, "european union public licen", r"\beuropean union public licen[sc]e\b"),
    ("zlib", 30, "zlib", r"\bzlib(?:/libpng)? licen[sc]e\b"),
    ("artistic", 30, "artistic licen", r"\bartistic licen[sc]e\b"),
    ("ms-pl", 30, "microsoft public licen", r"\bmicrosoft public licen[sc]e\b"),
    ("ms-rl", 30, "microsoft reciprocal licen", r"\bmicrosoft reciprocal licen[sc]e\b"),
    ("odbl", 30, "open database licen", r"\bopen database licen[sc]e\b"),
    ("ofl", 30, "open font licen", r"\bopen font licen[sc]e\b"),
    ("wtfpl", 30, "wtfpl", r"\bwtfpl\b"),
    ("unlicense", 30, "unlicense", r"\bthe unlicense\b"),
    ("sspl", 30, "sspl", r"\bsspl\b"),
    ("postgresql", 30, "postgresql licen", r"\bpostgresql licen[sc]e\b"),
    ("vim", 30, "vim licen", r"\bvim licen[sc]e\b"),
    ("ruby", 30, "ruby licen", r"\bruby licen[sc]e\b"),
    ("curl", 30, "curl licen", r"\bcurl licen[sc]e\b"),
    ("ncsa", 30, "ncsa", r"\b(?:university of illinois/)?ncsa(?: open source)? licen[sc]e\b"),
    ("w3c", 30, "w3c", r"\bw3c (?:software )?(?:notice and )?licen[sc]e\b"),
    ("unicode", 30, "unicode", r"\bunicode licen[sc]e(?: agreement)?\b"),
    ("cecill", 30, "cecill", r"\bcecill(?:-[bc])?\b"),
    ("cc-by-nc-nd", 34, "cc", r"\bcc[ -]by-nc-nd\b"),
    ("cc-by-nc-sa", 34, "cc", r"\bcc[ -]by-nc-sa\b"),
    ("cc-by-nc", 33, "cc", r"\bcc[ -]by-nc\b"),
    ("cc-by-nd", 33, "cc", r"\bcc[ -]by-nd\b"),
    ("cc-by-sa", 33, "cc", r"\bcc[ -]by-sa\b"),
    ("cc-by", 31, "cc", r"\bcc[ -]by\b(?!-)"),
    ("creative-commons", 20, "creative commons", r"\bcreative commons(?: licen[sc]e)?\b"),
    ("public-domain", 30, "public domain", r"\b(?:in|into|to) the public domain\b"),
    ("proprietary", 30, "all rights reserved", r"\ball rights reserved\b"),
    ("proprietary", 30, "proprietary", r"\bproprietary (?:and confidential|licen[sc]e|software)\b"),
    ("copyleft", 10, "copyleft", r"\bcopyleft(?:ed)?\b"),
    ("licence-file", 10, "licen", r"\bsee (?:the )?(?:file )?licen[sc]e(?:\.txt|\.md)?(?: file)?\b"),
    ("licence-mention", 10, "licensed under", r"\blicensed under (?:the )?[\w.-]+(?: [\w.-]+){0,3}"),
)
