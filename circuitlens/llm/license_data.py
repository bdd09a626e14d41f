"""Notices by which licences are known: plain data, from which sentences and rules are derived."""

from __future__ import annotations

#: Licence, name, and the sentences of its notice that must come in this order (others may stand between).
NOTICES = (
    ("Apache-2.0", "apache_header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\n\nSee the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "apache_the", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", "apache_under", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "mit_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT-0", "mit0_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("MIT", "mit_title", "MIT License"),
    ("MIT", "mit_title_the", "The MIT License"),
    ("MIT", "mit_title_x", "The MIT License (MIT)"),
    ("BSD-3-Clause", "bsd3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "bsd2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "isc_grant_and", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "bsd0_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("GPL-3.0", "gpl3_work", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "gpl2_work", "This work is licensed under the GNU General Public License, version 2"),
    ("MPL-2.0", "mpl_subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "mpl11_subject", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("EPL-2.0", "epl2_made", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "epl1_made", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("CDDL-1.0", "cddl_subject", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\nThe origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("BSL-1.0", "boost_header", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "boost_grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Artistic-2.0", "artistic_title", "The Artistic License 2.0"),
    ("Artistic-2.0", "artistic_terms", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)."),
    ("Artistic-1.0-Perl", "perl_terms", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."),
    ("CC0-1.0", "cc0_dedicated", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.\n\nThis software is distributed without any warranty."),
    ("CC0-1.0", "cc0_deed", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("CC0-1.0", "cc0_title", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "cc0_under", "Licensed under CC0 1.0"),
    ("WTFPL", "wtfpl_permitted", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("PostgreSQL", "postgres_grant", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("OFL-1.1", "ofl_licensed", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("BSD-3-Clause", "bsd3_under", "Licensed under the BSD 3-Clause License"),
)

#: Sentences that belong to notices but that no rule asks for.
OTHERS = {
    "apache_use": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "mit_asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit_liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd_asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd_liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}

#: GNU licences by name, version and what they cover, in the words of their headers.
GNU = (
    ("GPL", "GNU General Public License", ("2", "3"), ("program", "library", "file", "software")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3"), ("program", "library", "file", "software")),
    ("LGPL", "GNU Library General Public License", ("2",), ("library",)),
    ("AGPL", "GNU Affero General Public License", ("3",), ("program", "library", "file", "software")),
)
#: Creative Commons licences.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: How short notices call licences, and what they say.
CALLED = {"MIT": ("MIT",), "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD"), "ISC": ("ISC",), "Apache-2.0": ("Apache 2.0",), "Zlib": ("zlib",), "BSL-1.0": ("Boost Software",)}
SAID = ("Released under the {} License", "Licensed under the {} License", "Distributed under the {} License", "This project is licensed under the {} License", "This software is released under the {} License")
#: Identifiers in tags.
TAGS = ("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "BSL-1.0", "Unlicense", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "WTFPL", "PostgreSQL", "OFL-1.1")


def all_notices() -> list[tuple[str, str, str]]:
    """(licence, name, notice) of every notice, in order of precedence: those above, then those that the tables build."""
    found = list(NOTICES)
    for short, name, versions, things in GNU:
        for version in versions:
            full = f"{short}-{version if '.' in version else version + '.0'}"
            for thing in things:
                start = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {name}"
                key = f"{short}{version}_{thing}" + "_library" * (name.split()[1] == "Library")
                found.append((f"{full}-or-later", f"{key}_later", f"{start} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."))
                found.append((f"{full}-only", f"{key}_only", f"{start} version {version} as published by the Free Software Foundation."))
                found.append((f"{full}-only", f"{key}_this", f"{start} as published by the Free Software Foundation; version {version} of the License."))
    for licence, names in CALLED.items():
        for k, name in enumerate(names):
            for said in SAID:
                found.append((licence, f"{licence}_{said.split()[0] if said[0] != 'T' else said.split()[1]}" + str(k or ""), said.format(name)))
    for code, name in CC.items():
        for version, place in (("4.0", "International"), ("3.0", "Unported")):
            licence, key = f"CC-{code}-{version}", f"cc{code.replace('-', '').lower()}" + "3" * (version == "3.0")
            found.append((licence, f"{key}_work", f"This work is licensed under a Creative Commons {name} {version} {place} License"))
            found.append((licence, f"{key}_under", f"Licensed under CC {code} {version}"))
    for tag in TAGS:
        found.append((tag, f"spdx_{tag}", f"SPDX-License-Identifier: {tag}"))
    for a, b in (("MIT", "Apache-2.0"), ("Apache-2.0", "MIT")):
        found += [(one, f"spdx_{a}_or_{b}", f"SPDX-License-Identifier: {a} OR {b}") for one in (a, b)]
    return [*found, ("proprietary", "rights", "All rights reserved.")]
