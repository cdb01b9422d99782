"""License scans by ordered signature rules, in DataFrame functions only.

Texts become lower-cased words, one blank apart. A rule is a regex over words with a keyword that every match holds,
a label and a priority. Rules are hand-written signatures of license bodies and addresses, and forms of the names of
licenses. Only texts with a trace of any keyword are looked into, and only rules whose keyword a text holds are run on
it. They are run on numbered words ("12:under 13:the"), so that a match tells its own place and nothing has to be
counted up to it. A detection is dropped if one of the same or a higher priority contains it: "licensed under the apache
license version 2" silences the bare name within.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import carried

#: Phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DELIMITERS = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"

#: Label: the keyword, the forms of the name, the identifiers of the short form.
#: What stands before a version, its blank included: "v2" is one word.
_V = r"(?: version)?(?: v ?| )"
NAMES: dict[str, tuple[str, list[str], list[str]]] = {
    "mit": ("mit", ["mit licen[cs]e", "expat licen[cs]e mit", "mit x11 licen[cs]e"], ["mit"]),
    "mit-0": ("mit", ["mit no attribution(?: licen[cs]e)?", "mit 0 licen[cs]e"], ["mit 0"]),
    "apache-1.1": ("apache", [rf"apache(?: software)? licen[cs]e{_V}1 1"], ["apache 1 1"]),
    "apache-2": ("apache", [rf"apache(?: software)? licen[cs]e{_V}2(?: 0)?"], ["apache 2(?: 0)?"]),
    "bsd-2": ("bsd", ["(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd (?:2|two) clause(?: simplified)? licen[cs]e"], ["bsd 2 clause"]),
    "bsd-3": ("bsd", ["(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd (?:3|three) clause licen[cs]e"], ["bsd 3 clause"]),
    "bsd-4": ("bsd", ["(?:original|4 clause|four clause) bsd licen[cs]e"], ["bsd 4 clause"]),
    "bsd": ("bsd", ["bsd(?: style)? licen[cs]e"], ["bsd"]),
    "isc": ("isc", ["isc licen[cs]e"], ["isc"]),
    "zlib": ("zlib", ["zlib(?: libpng)? licen[cs]e"], ["zlib"]),
    "boost-1": ("boost", [rf"boost software licen[cs]e(?:{_V}1(?: 0)?)?"], ["bsl 1 0"]),
    "unlicense": ("unlicense", ["the unlicense", "unlicense"], ["unlicense"]),
    "wtfpl": ("wtfpl", ["wtfpl(?: licen[cs]e)?"], ["wtfpl"]),
    "cc0": ("cc0", ["cc0(?: 1 0)?(?: universal)?"], ["cc0 1 0"]),
    "public-domain": ("public domain", ["(?:dedicated to|placed in(?:to)?|released (?:in)?to) the public domain"], ["pddl 1 0"]),
    "all-rights-reserved": ("rights reserved", ["all rights reserved", "all other rights reserved"], []),
    "proprietary": ("proprietary", ["proprietary and confidential", "proprietary licen[cs]e"], []),
    "artistic-2": ("artistic", [rf"artistic licen[cs]e{_V}2(?: 0)?"], ["artistic 2 0"]),
    "psf-2": ("python", [rf"python software foundation licen[cs]e(?:{_V}2)?"], ["psf 2 0"]),
    "ofl-1.1": ("font", [rf"open font licen[cs]e(?:{_V}1 1)?"], ["ofl 1 1"]),
    "ms-pl": ("microsoft", ["microsoft public licen[cs]e"], ["ms pl"]),
    "odbl": ("database", ["open database licen[cs]e"], ["odbl 1 0"]),
}


def _versioned() -> None:
    """Families whose members differ by version or by terms."""
    for short, long, versions in (
        ("gpl", "general public licen[cs]e", ("1", "2", "3")),
        ("lgpl", "(?:lesser|library) general public licen[cs]e", ("2", "2.1", "3")),
        ("agpl", "affero general public licen[cs]e", ("1", "3")),
        ("mpl", "mozilla public licen[cs]e", ("1", "1.1", "2")),
        ("epl", "eclipse public licen[cs]e", ("1", "2")),
        ("cddl", "common development and distribution licen[cs]e", ("1", "1.1")),
        ("eupl", "european union public licen[cs]e", ("1.1", "1.2")),
        ("fdl", "free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
    ):
        word = long.split(" licen")[0].split(" ")[-2 if short in ("gpl", "agpl", "mpl", "epl") else -1]
        word = {"lgpl": "general", "cddl": "distribution", "eupl": "public", "fdl": "documentation"}.get(short, word)
        for v in versions:
            spelt = v.replace(".", " ") + ("(?: 0)?" if "." not in v else "")
            NAMES[f"{short}-{v}"] = (word, [rf"(?:gnu )?{long}(?: {short})?{_V}{spelt}(?! [0-9])"], [])
            NAMES[f"{short}-{v} "] = (short, [rf"(?:gnu )?{short}(?: version)?(?: ?v ?| ?){spelt}(?! [0-9])"], [rf"{'gfdl' if short == 'fdl' else short} {spelt}(?: only| or later)?(?! [0-9])"])
        NAMES[short] = (word, [rf"(?:gnu )?{long}"], [])
    for terms in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = "cc-" + terms.replace(" ", "-")
        said = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderiv(?:ative)?s"}
        NAMES[label] = ("creative commons", [f"creative commons {' '.join(said[t] for t in terms.split())}(?! (?:sharealike|noncommercial|noderiv))"], [])
        NAMES[f"{label} "] = ("cc by", [rf"cc {terms}(?! (?:sa|nc|nd)(?= ))"], [])
        for v in ("2 0", "3 0", "4 0"):
            NAMES[f"{label}-{v[0]}"] = ("creative commons", [f"creative commons {' '.join(said[t] for t in terms.split())} {v}"], [])
            NAMES[f"{label}-{v[0]} "] = ("cc by", [rf"cc {terms} {v}"], [rf"cc {terms} {v}"])


_versioned()


#: Signatures of bodies: label, keyword, the words that give the license away without its name.
BODIES: list[tuple[str, str, str]] = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", "without prior", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("isc", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("mit-0", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", "author disclaims", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd", "source and binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form must", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "endorse or promote", "neither the name of(?: the)?(?: [^ ]+)(?: [^ ]+)?(?: [^ ]+)? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following (?:acknowledgement|acknowledgment)"),
    ("bsd", "copyright holders", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "held liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost-1", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "what the fuck", "you just do what the fuck you want to"),
    ("cc0", "associated claims", "waive all copyright and related or neighboring rights together with all associated claims and causes of action"),
    ("cc0", "extent possible", "to the extent possible under law(?: the)?(?: [^ ]+)? has waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", "this (?:work|file|software|document) is (?:hereby )?(?:dedicated to|placed in|in|released into) the public domain"),
    ("public-domain", "no rights reserved", "no rights reserved"),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "basis without", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "grant of patent", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-1.1", "includes software developed", "this product includes software developed by the apache software foundation"),
    ("gpl", "free software you can", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gpl", "will be useful", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "will be useful", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "along with this program", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2", "freedom to share", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "practical works", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("agpl-3", "remote network", "remote network interaction use with the gnu general public license"),
    ("agpl", "users interacting", "an opportunity to receive the corresponding source of your version all users interacting with it remotely through a computer network"),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public license"),
    ("mpl-2", "was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "european", "licensed under the eupl version 1 (?:1|2) or as soon they will be approved by the european commission"),
    ("fdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("fdl", "copy distribute and or modify", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("artistic-2", "this package", "this package may be distributed and modified under the terms of the artistic license"),
    ("artistic", "copyright holder", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("psf-2", "psf hereby", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ofl-1.1", "font software", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license"),
    ("ms-pl", "patent claim", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license from such contributor"),
    ("cc-by", "attribution you must", "attribution you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "noncommercial you may", "noncommercial you may not use the material for commercial purposes"),
    ("cc-by-sa", "sharealike if you", "sharealike if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "noderivatives if you", "noderivatives if you remix transform or build upon the material you may not distribute the modified material"),
    ("permissive", "copying and distribution", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "not evil", "the software shall be used for good not evil"),
    ("ntp", "supporting documentation", "provided that the above copyright notice appears in all copies and that both the(?: above)? copyright notice and this permission notice (?:appears|appear) in supporting documentation"),
    ("proprietary", "strictly prohibited", "(?:unauthorized|unauthorised) copying of this file via any medium is strictly prohibited"),
    ("proprietary", "trade secret", "contains (?:confidential information and )?trade secrets of"),
    ("warranty-disclaimer", "warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
    ("warranty-disclaimer", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", "consequential damages", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    # MIT and its kin
    ("mit", "no event shall", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "released under", "(?:is )?released under (?:the )?mit(?: licen[cs]e)?(?: see licen[cs]e| licen[cs]e)"),
    ("mit", "mit", "distributed under the mit licen[cs]e see (?:the )?(?:accompanying )?(?:file )?(?:licen[cs]e|copying)"),
    ("mit", "mit", "(?:use of this source code is governed by|licensed under) an mit style licen[cs]e"),
    ("mit", "mit", "dual licensed under (?:the )?mit (?:and|or) (?:the )?(?:gpl|bsd|apache)"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "in advertising", "except as contained in this notice the name(?:s)? of the(?: above)? (?:authors or )?copyright holder(?:s)? shall not be used in advertising"),
    ("isc", "consortium disclaims", "the internet (?:software|systems) consortium disclaims all warranties"),
    ("isc", "action of contract", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software provided that the above copyright"),
    ("curl", "daniel stenberg", "copyright(?: c)? [0-9][0-9][0-9][0-9](?: [0-9][0-9][0-9][0-9])? daniel stenberg"),
    ("curl", "above copyright", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer"),
    ("hpnd", "distribute this software", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
    ("hpnd", "publicity pertaining", "not be used in advertising or publicity pertaining to distribution of the software without specific(?: written)? prior(?: written)? permission"),
    ("postgresql", "written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", "california specifically", "the university of california specifically disclaims any warranties"),
    ("tcl", "authors hereby grant", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("tcl", "verbatim in any", "provided that existing copyright notices are retained in all copies and that this notice is included verbatim in any distributions"),
    ("ncsa", "illinois", "university of illinois ncsa open source licen[cs]e"),
    ("unicode", "unicode", "unicode (?:inc )?licen[cs]e agreement data files and software"),
    ("icu", "icu licen", "icu licen[cs]e icu 1 8 1 and later"),
    ("libpng", "png reference", "the png reference library is supplied as is the contributing authors and group 42 inc disclaim all warranties"),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group the copyright"),
    ("ijg", "thomas g", "this software is copyright c [0-9][0-9][0-9][0-9](?: [0-9][0-9][0-9][0-9])? thomas g lane"),
    ("libtiff", "sam leffler", "the name(?:s)? of sam leffler and silicon graphics may not be used in any advertising"),
    ("ftl", "freetype", "the freetype project licen[cs]e"),
    ("ftl", "freetype", "portions of this software are copyright the freetype project"),
    ("bzip2", "associated library", "this program bzip2 the associated library libbzip2 and all documentation are copyright"),
    ("info-zip", "info zip", "info zip licen[cs]e"),
    ("info-zip", "info zip", "copyright c [0-9][0-9][0-9][0-9](?: [0-9][0-9][0-9][0-9])? info zip all rights reserved"),
    ("openssl", "openssl", "redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the openssl project"),
    ("openssl", "eric young", "copyright remains eric young s and as such any copyright notices in the code are not to be removed"),
    ("openldap", "openldap", "the openldap public licen[cs]e"),
    ("openldap", "verbatim copy", "redistributions must contain a verbatim copy of this document"),
    # BSD
    ("bsd", "governed by a bsd", "use of this source code is governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ("bsd", "documentation and or", "redistributions in binary form must reproduce the above copyright notice in the documentation and or other materials"),
    ("bsd", "regents", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", "by the author", "this software is provided by the author(?:s)? (?:and contributors )?as is and any express or implied warranties"),
    ("bsd-2", "reserved redistribution", "all rights reserved redistribution and use in source and binary forms with or without modification are permitted provided that the following two conditions"),
    ("bsd-3", "university nor", "neither the name of the university nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3", "may not be used", "the name(?:s)? of the (?:author|authors|copyright holder|copyright holders) may not be used to endorse or promote products derived from this software"),
    ("bsd-3", "google inc", "neither the name of google inc nor the names of its contributors may be used to endorse"),
    ("bsd-4", "university of california", "this product includes software developed by the university of california berkeley and its contributors 4 neither the name of the university nor the names of its contributors may be used to endorse"),
    ("bsd-3-clear", "patent rights", "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e"),
    ("0bsd", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims"),
    ("bsd-patent", "perpetual worldwide", "subject to the terms and conditions of this licen[cs]e each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual worldwide"),
    # Apache
    ("apache-2", "grant of copyright", "grant of copyright licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants"),
    ("apache-2", "distribution 1", "terms and conditions for use reproduction and distribution 1 definitions licen[cs]e shall mean"),
    ("apache-2", "apache licen", "apache licen[cs]e version 2 0 january 2004"),
    ("apache-2", "attribution notices", "you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices"),
    ("apache-2", "additional attribution", "attribution notices within derivative works that you distribute alongside or as an addendum to the notice text from the work provided that such additional attribution notices cannot be construed as modifying the licen[cs]e"),
    ("apache-2", "more contributor", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-2", "licenses this file", "the asf licenses this file to you under the apache licen[cs]e"),
    ("apache-2", "limitations under", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache-2", "applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("apache-1.1", "apache software foundation", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.1", "may not be called apache", "endorse or promote products derived from this software without prior written permission products derived from this software may not be called apache"),
    # GNU
    ("gpl-2", "version 2 of the", "gnu general public licen[cs]e as published by the free software foundation(?: either)? version 2 of the licen[cs]e"),
    ("gpl-2-only", "version 2 as", "under the terms of the gnu general public licen[cs]e version 2 as published by the free software foundation"),
    ("gpl-3", "version 3 of the", "gnu general public licen[cs]e as published by the free software foundation(?: either)? version 3 of the licen[cs]e"),
    ("gpl", "any later version", "of the licen[cs]e or at your option any later version"),
    ("lgpl-2.1", "version 2 1 of the", "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e"),
    ("lgpl-3", "version 3 of the", "gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e"),
    ("lgpl-2", "library general public", "gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e"),
    ("agpl-3", "affero general public", "gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e"),
    ("lgpl", "general public", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)"),
    ("agpl", "affero general public", "you should have received a copy of the gnu affero general public licen[cs]e along with this program"),
    ("gpl", "franklin", "gnu general public licen[cs]e along with this program if not write to the free software foundation inc 51 franklin"),
    ("gpl-2", "activities other than", "activities other than copying distribution and modification are not covered by this licen[cs]e they are outside its scope"),
    ("gpl-2", "accept this license", "you are not required to accept this license since you have not signed it"),
    ("gpl-2", "work based on the program", "a work based on the program means either the program or any derivative work under copyright law"),
    ("gpl-3", "propagate or modify", "you may not propagate or modify a covered work except as expressly provided under this licen[cs]e"),
    ("gpl-3", "unlimited permission", "this licen[cs]e explicitly affirms your unlimited permission to run the unmodified program"),
    ("gpl-3", "are irrevocable", "all rights granted under this licen[cs]e are granted for the term of copyright on the program and are irrevocable"),
    ("gpl-3", "technological measure", "no covered work shall be deemed part of an effective technological measure under any applicable law fulfilling obligations under article 11 of the wipo copyright treaty"),
    ("gpl-3", "installation information", "a requirement to provide installation information does not include a requirement to continue to provide support service warranty or updates"),
    ("gpl-classpath", "special exception", "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gpl-exception", "special exception", "as a special exception to the gnu general public licen[cs]e"),
    ("lgpl-2.1", "derivative work", "such a work in isolation is not a derivative work of the library and therefore falls outside the scope of this licen[cs]e"),
    ("lgpl-3", "lesser general", "this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e"),
    ("fdl", "other functional", "the purpose of this licen[cs]e is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("fdl", "document numbering", "if you publish printed copies of the document numbering more than 100 and the document s licen[cs]e notice requires cover texts"),
    # Mozilla, Eclipse, Sun, IBM, CPL, OSL
    ("mpl-1.1", "alternatively the contents", "alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e"),
    ("mpl-1.1", "software distributed under", "software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[cs]e for the specific language governing rights"),
    ("mpl-2", "incompatible with secondary", "this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e"),
    ("mpl-2", "covered software", "covered software is provided under this licen[cs]e on an as is basis without warranty of any kind"),
    ("mpl-2", "modifications", "all distribution of covered software in source code form including any modifications that you create or to which you contribute must be under the terms of this licen[cs]e"),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public licen[cs]e"),
    ("epl-2", "following secondary", "this source code may also be made available under the following secondary licen[cs]es when the conditions for such availability set forth in the eclipse public licen[cs]e"),
    ("epl-1", "accompanying program", "the accompanying program is provided under the terms of this eclipse public licen[cs]e"),
    ("edl-1", "eclipse distribution", "eclipse distribution licen[cs]e(?: v(?:ersion)?)? 1 0"),
    ("cpl-1", "common public", "the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("cpl-1", "common public", "common public licen[cs]e(?: version| v)? ?(?:1 0|0 5)"),
    ("ipl-1", "ibm public", "ibm public licen[cs]e(?: version)? 1 0"),
    ("cddl", "covered software", "covered software is provided under this licen[cs]e on an as is basis without warranty of any kind either expressed or implied including without limitation warranties that the covered software is free of defects"),
    ("cddl", "cddl header", "cddl header start the contents of this file are subject to the terms"),
    ("sissl", "sun industry", "sun industry standards source licen[cs]e"),
    ("osl-3", "open software licen", "licensed under the open software licen[cs]e version 3 0"),
    ("afl-3", "academic free", "licensed under the academic free licen[cs]e version 3 0"),
    ("afl", "academic free", "academic free licen[cs]e(?: v(?:ersion)? ?| )?(?:1 1|1 2|2 0|2 1)"),
    ("qpl-1", "q public", "the q public licen[cs]e version 1 0"),
    ("sleepycat", "redistributions in", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("rpl", "reciprocal public", "reciprocal public licen[cs]e(?: version)?(?: 1 [15])?"),
    ("apsl-2", "apple public source", "apple public source licen[cs]e(?: version)?(?: 2 0)?"),
    ("ncgl", "information licensed", "contains public sector information licensed under the open government licen[cs]e"),
    ("ogl-uk", "open government", "open government licen[cs]e(?: v(?:ersion)? ?)?(?:[123] 0)?"),
    ("etalab", "licence ouverte", "licence ouverte open licence(?: etalab)?"),
    ("eupl", "european union public", "this european union public licen[cs]e the eupl applies to the work"),
    ("cecill", "cecill", "this software is governed by the cecill(?: b| c)? licen[cs]e under french law"),
    # languages and projects
    ("psf-2", "python software", "this licen[cs]e agreement is between the python software foundation"),
    ("psf-2", "licensee hereby", "licensee hereby agrees to include in any such work a brief summary of the changes made to python"),
    ("psf-2", "cnri", "cnri licen[cs]e agreement for python"),
    ("ruby", "redistribute it", "you (?:can|may) redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl version 2) (?:see the file|or the conditions below)"),
    ("ruby", "same terms as ruby", "licensed under the same terms as ruby"),
    ("perl", "same terms as perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-1", "restriction provided", "you may make and give away verbatim copies of the source form of the standard version of this package without restriction provided that you duplicate all of the original copyright notices"),
    ("artistic-2", "distribute verbatim", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed preamble this licen[cs]e establishes the terms under which a given free software package"),
    ("php-3", "promote products", "the name php must not be used to endorse or promote products derived from this software"),
    ("vim", "vim licen", "the vim licen[cs]e applies to"),
    ("vim", "vim licen", "vim licen[cs]e"),
    ("zpl-2", "zope public", "this software is subject to the provisions of the zope public licen[cs]e"),
    ("lppl", "latex project public", "latex project public licen[cs]e"),
    ("w3c", "w3c", "w3c software(?: and document)? notice and licen[cs]e"),
    ("nvidia", "nvidia corporation", "nvidia corporation and its licensors retain all intellectual property and proprietary rights in and to this software"),
    ("ms-rl", "reciprocal licen", "microsoft reciprocal licen[cs]e"),
    ("ms-pl", "contributors name", "this licen[cs]e does not grant you rights to use any contributors name logo or trademarks"),
    ("ms-pl", "you accept", "if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software"),
    ("oracle-bcl", "oracle", "oracle binary code licen[cs]e agreement"),
    ("otn", "technology network", "oracle technology network licen[cs]e agreement"),
    # fonts, data and content
    ("ofl-1.1", "collaborative font", "the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects"),
    ("gust-font", "gust font", "gust font licen[cs]e"),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[cs]e(?: version)?(?: 1 0)?"),
    ("odc-by", "attribution licen", "open data commons attribution licen[cs]e"),
    ("pddl", "public domain dedication", "open data commons public domain dedication and licen[cs]e"),
    ("cdla", "community data", "community data licen[cs]e agreement (?:permissive|sharing)"),
    ("cc-by-4", "attribution 4 0", "creative commons attribution 4 0 international (?:public )?licen[cs]e"),
    ("cc-by-sa-4", "sharealike 4 0", "creative commons attribution sharealike 4 0 international (?:public )?licen[cs]e"),
    ("cc-by-nc-4", "noncommercial 4 0", "creative commons attribution noncommercial 4 0 international (?:public )?licen[cs]e"),
    ("cc-by-nd-4", "noderivatives 4 0", "creative commons attribution noderivatives 4 0 international (?:public )?licen[cs]e"),
    ("cc-by-sa-3", "unported", "creative commons attribution share ?alike 3 0 unported(?: licen[cs]e)?"),
    ("cc-by-3", "unported", "creative commons attribution 3 0 unported(?: licen[cs]e)?"),
    ("cc", "exercising any rights", "by exercising any rights to the work provided here you accept and agree to be bound by the terms of this licen[cs]e"),
    ("cc", "creative commons", "the work as defined below is provided under the terms of this creative commons public licen[cs]e"),
    ("cc", "creative commons", "creative commons corporation is not a law firm and does not provide legal (?:services or legal advice|advice)"),
    ("cc", "licensed rights", "the licensor hereby grants you a worldwide royalty free non sublicensable non exclusive irrevocable licen[cs]e to exercise the licensed rights"),
    ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cc0", "public domain", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("public-domain", "source code", "the author(?:s)? (?:hereby )?disclaim(?:s)? copyright to this source code"),
    ("sqlite-blessing", "author disclaims copyright", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("gutenberg", "project gutenberg", "under the terms of the project gutenberg licen[cs]e included with this ebook"),
    ("wikipedia", "text is available", "text is available under the creative commons attribution share ?alike licen[cs]e"),
    # source available and models
    ("sspl-1", "server side public", "server side public licen[cs]e(?: version 1)?"),
    ("busl-1.1", "business source", "business source licen[cs]e(?: 1 1)?"),
    ("busl-1.1", "change date", "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work"),
    ("elastic-2", "elastic licen", "elastic licen[cs]e(?: 2 0| v2)?"),
    ("commons-clause", "commons clause", "commons clause licen[cs]e condition"),
    ("commons-clause", "right to sell", "the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) licen[cs]e"),
    ("openrail", "rail", "(?:creativeml|bigscience|bigcode)(?: open)? ?(?:open )?rail (?:m )?(?:m )?licen[cs]e"),
    ("llama", "llama", "llama [0-9](?: [0-9])? community licen[cs]e(?: agreement)?"),
    ("gemma", "gemma", "use of gemma is subject to the gemma licen[cs]e"),
    ("ai2-impact", "impact licen", "ai2 impact licen[cs]e (?:low|medium|high) risk"),
    # proprietary notices
    ("proprietary", "licensed not sold", "(?:the software|this software|the program) is licensed not sold"),
    ("proprietary", "agreement", "end user licen[cs]e agreement"),
    ("proprietary", "not for redistribution", "for (?:internal|evaluation|personal) use only not for redistribution"),
    ("proprietary", "unpublished", "unpublished rights reserved under the copyright laws of the united states"),
    ("evaluation", "evaluation licen", "evaluation licen[cs]e agreement"),
    # words of notices that many licenses share
    ("warranty-disclaimer", "implied warranties", "disclaim(?:s)? all (?:express or implied )?warranties (?:with regard to this software )?including(?: without limitation| but not limited to)?(?: all| any)? (?:the )?implied warranties"),
    ("warranty-disclaimer", "no warranty", "(?:comes with|there is) (?:absolutely )?no warranty(?: for the program)? (?:to the extent permitted by applicable law|for details)"),
    ("permissive", "any purpose", "permission is (?:hereby )?granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("non-commercial", "commercial use", "(?:any )?commercial use (?:of this (?:software|work|data) )?is (?:strictly )?prohibited(?: without (?:prior )?(?:written )?(?:permission|consent|a licen[cs]e))?"),
]
#: Addresses of licenses as words: label, keyword, the address.
ADDRESSES: list[tuple[str, str, str]] = [
    ("apache-2", "apache org", "apache org licenses license 2 0"),
    ("mit", "opensource org", "opensource org (?:licenses|licence) mit"),
    ("bsd-2", "opensource org", "opensource org (?:licenses|licence) bsd 2 clause"),
    ("bsd-3", "opensource org", "opensource org (?:licenses|licence) bsd 3 clause"),
    ("isc", "opensource org", "opensource org (?:licenses|licence) isc"),
    ("gpl-2", "gnu org", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", "gnu org", "gnu org licenses gpl 3 0"),
    ("lgpl-3", "gnu org", "gnu org licenses lgpl 3 0"),
    ("agpl-3", "gnu org", "gnu org licenses agpl 3 0"),
    ("fdl-1.3", "gnu org", "gnu org licenses fdl 1 3"),
    ("mpl-2", "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org", "mozilla org mpl mpl 1 1"),
    ("epl-1", "eclipse org", "eclipse org legal epl v10"),
    ("epl-2", "eclipse org", "eclipse org legal epl 2 0"),
    ("boost-1", "boost org", "boost org license 1 0 txt"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "wtfpl net"),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0"),
    ("ofl-1.1", "sil org", "scripts sil org ofl"),
    ("odbl", "opendatacommons org", "opendatacommons org licenses odbl"),
    *((f"cc-{terms.replace(' ', '-')}-{v[0]}", "creativecommons org", f"creativecommons org licenses {terms} {v}") for terms in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("2 0", "3 0", "4 0")),
]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    regex: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules, the first of equals first: identifiers, addresses, bodies, notices, references, bare names."""
    out = []
    for kind, priority, weight in (("identifier", 4, 1.0), ("address", 4, 0.95), ("body", 3, 0.95), ("notice", 3, 0.95), ("terms", 2, 0.9), ("name", 1, 0.6)):
        if kind in ("address", "body"):
            out += [Rule(f"{label}:{kind}:{i}", label, keyword, rf" {x}(?= )", priority, weight) for i, (label, keyword, x) in enumerate(ADDRESSES if kind == "address" else BODIES)]
            continue
        for key, (word, names, ids) in NAMES.items():
            keyword = "spdx" if kind == "identifier" else word
            forms = {
                "identifier": [f"spdx license identifier {x}" for x in ids],
                "notice": [rf"(?:licen[cs]ed|released|distributed|published|available|provided|redistributed) under(?: the)?(?: terms(?: and conditions)? of)?(?: the)? {x}" for x in names],
                "terms": [rf"(?:subject to|terms of|governed by|a copy of|according to|compliance with)(?: the)? {x}" for x in names],
                "name": names,
            }[kind]
            out += [Rule(f"{key.strip()}:{kind}:{word}:{i}", key.strip(), keyword, rf" {x}(?= )", priority, weight) for i, x in enumerate(forms)]
    return out


#: Beginnings of words of which every match of a rule or a base phrase holds one; "_" stands for what lies between words.
TRACES = """licen sublicen unlicen spdx proprietary reserved gpl agpl lgpl mpl epl cddl eupl fdl gfdl wtfpl cc0 cc_by mit_no mit_0 public_domain
hereby copyright advertising disclaim redistribut endors misrepresented liable unencumbered compile fuck waive apache warrant verbatim gnu
interacting mozilla eclipse boost creative opensource opendatacommons scripts_sil invariant semblance typefaces noncommercial sharealike noderiv
a_beer evil prohibited secret merchantab damages""".split()


def trace() -> str:
    """A pattern for blank-joined lower-cased words, a blank first, that fits every text in which a rule or a base phrase
    can be found."""
    by_letter: dict[str, list[str]] = {}
    for t in TRACES:
        by_letter.setdefault(t[0], []).append(t[1:].replace("_", " "))
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(doubled: Column, n_words: Column) -> list[Column]:
    """For each base phrase: places, first word and last word (null without a place).

    In the doubled text every word has blanks of its own, so places next to each other are all counted.
    """
    out = []
    for phrase in BASE:
        own = " " + phrase.replace(" ", "  ") + " "
        n = ((F.length(doubled) - F.length(F.replace(doubled, F.lit(own), F.lit("")))) / len(own)).cast("long")
        before = (_blanks(F.substring_index(doubled, own, 1)) / 2).cast("long")
        after = (_blanks(F.substring_index(doubled, own, -1)) / 2).cast("long")
        out.append(F.struct(n.alias("n"), F.when(n > 0, before).alias("first"), F.when(n > 0, n_words - after - len(phrase.split())).alias("last")))
    return out


_FIELDS = "start:bigint,end:bigint,rule:string,label:string,priority:int,weight:double"
_DETECTION = f"struct<{_FIELDS}>"
_LEVELS = (1, 2, 3, 4)
_OWN = ("__traced", "__words", "__low", "__found")


def _lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def numbered(regex: str) -> str:
    """A rule's regex over words as one over numbered words: every blank that it matches is followed by a number. The
    lookahead for the blank behind the last word stays."""
    marks = {"(?= )": "\0", " ?": "\1"}
    for what, mark in marks.items():
        regex = regex.replace(what, mark)
    return regex.replace(" ", " [0-9]++:").replace("\0", "(?= )").replace("\1", "(?: [0-9]++:)?")


_RULES = "array<struct<keyword:string,rules:array<struct<regex:string,at:int,rule:string,label:string,priority:int,weight:double>>>>"


def detections(words: str = "__low", places: str = "x") -> str:
    """SQL of the matches of all rules as word spans, in order of start, longer and higher ones first. words: SQL of the
    blank-joined words, places: of the numbered ones. Rules are one constant, by keyword."""
    by_word: dict[str, list[dict]] = {}
    for i, r in enumerate(rules()):
        by_word.setdefault(r.keyword, []).append({"regex": numbered(r.regex), "at": i, "rule": r.name, "label": r.label, "priority": r.priority, "weight": r.weight})
    known = f"from_json({_lit(json.dumps([{'keyword': k, 'rules': own} for k, own in by_word.items()]))}, '{_RULES}')"
    start, end = "cast(substring_index(substr(h, 2), ':', 1) AS bigint)", "cast(substring_index(substring_index(h, ' ', -1), ':', 1) AS bigint) + 1"
    one = f"named_struct('start', {start}, 'back', -({end}), 'lower', -r.priority, 'at', r.at, 'end', {end}, 'rule', r.rule, 'label', r.label, 'priority', r.priority, 'weight', r.weight)"
    run = f"transform(regexp_extract_all({places}, r.regex, 0), h -> {one})"
    return f"array_sort(flatten(transform(filter({known}, g -> contains({words}, g.keyword)), g -> flatten(transform(g.rules, r -> {run})))))"


def unsuppressed(found: str) -> str:
    """SQL of what no detection before it, of its priority or a higher one, contains. Whatever contains a span stands
    before it in order, so the furthest end so far of each priority is all there is to remember. Detections are gone
    through in blocks of about the square root of their number, as appending copies what is already there."""
    ends = ", ".join(f"'e{k}', {{}}" for k in _LEVELS)
    state = lambda kept, of: f"named_struct('kept', {kept}, {ends.format(*(of(k) for k in _LEVELS))})"
    covered = f"greatest({', '.join(f'IF({k} >= d.priority, a.e{k}, -1L)' for k in _LEVELS)}) >= d.end"
    own = f"named_struct({', '.join(f"'{f.split(':')[0]}', d.{f.split(':')[0]}" for f in _FIELDS.split(','))})"
    step = state(f"IF({covered}, a.kept, array_append(a.kept, {own}))", lambda k: f"IF(d.priority = {k}, greatest(a.e{k}, d.end), a.e{k})")
    block = f"aggregate(c, {state(f'cast(array() AS array<{_DETECTION}>)', lambda k: f't.e{k}')}, (a, d) -> {step})"
    total = f"(t, c) -> {_let(block, 'b', state('array_append(t.kept, b.kept)', lambda k: f'b.e{k}'))}"
    blocks = "transform(sequence(0, (size(f) - 1) DIV n), i -> slice(f, i * n + 1, n))"
    ran = f"aggregate({blocks}, {state(f'cast(array() AS array<array<{_DETECTION}>>)', lambda _: '-1L')}, {total}, t -> flatten(t.kept))"
    return _let(found, "f", _let("cast(ceil(sqrt(size(f))) AS int)", "n", f"IF(n = 0, cast(array() AS array<{_DETECTION}>), {ran})"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, base (places, first and last word of each base phrase) and detections (word spans).

    A-Z alone are lower-cased. A null text is empty: no words, no detections. Rows, repeated ones too, and other columns
    pass as they are; columns of these three names are replaced, and names in _OWN are refused. An empty table gives
    none. Every match of every text is kept, and texts of any length are read whole.
    """
    carried(docs.columns, *_OWN)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.withColumn("__words", F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _DELIMITERS, " ")), F.lit(" ")))
    n_words = F.when(F.length("__words") == 2, 0).otherwise(_blanks(F.col("__words")) - 1).cast("long")
    marked = words.withColumns({"n_words": n_words, "__traced": F.lower("__words").rlike(trace())})
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    base = F.transform(F.array("__low"), lambda w: F.array(*_base(F.replace(w, F.lit(" "), F.lit("  ")), F.col("n_words"))))[0]
    empty = F.array(*(none for _ in BASE))
    places = "concat(' ', array_join(transform(split(trim(__low), ' '), (v, i) -> concat(i, ':', v)), ' '), ' ')"
    low = marked.withColumn("__low", F.when(F.col("__traced"), F.translate("__words", _UPPER, _UPPER.lower())))
    # The numbered words are bound outside of the loop over rules, where they would be made anew for each.
    looked = low.withColumn("__found", F.when(F.col("__traced"), F.expr(_let(places, "x", detections()))))
    kept = F.when(F.col("__traced"), F.expr(unsuppressed("__found"))).otherwise(F.array().cast(f"array<{_DETECTION}>"))
    return looked.withColumns({"base": F.when(F.col("__traced"), base).otherwise(empty), "detections": kept}).drop(*_OWN)


def summary(found: DataFrame) -> DataFrame:
    """scan()'s findings as counts, ends, labels and a score: the greatest weight of what was found."""
    labels = F.filter(F.array(*(F.when(F.col("base")[i]["n"] > 0, F.lit(label)) for i, label in enumerate(BASE.values()))), lambda x: x.isNotNull())
    places = lambda name: F.transform("base", lambda b: b[name])
    weight = F.array_max(F.transform("detections", lambda d: d["weight"]))
    return found.withColumns({
        "n_base": F.aggregate(places("n"), F.lit(0).cast("long"), lambda a, x: a + x),
        "first_word": F.array_min(places("first")),
        "last_word": F.array_max(places("last")),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(labels)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.transform("detections", lambda d: d["label"])))), ","),
        "score": F.coalesce(F.greatest(weight, F.when(F.size(labels) > 0, 0.9)), F.lit(0.0)),
    })
