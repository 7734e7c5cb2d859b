"""Licence templates: public licence texts, standard notices and short statements.

Fixed values. Several templates may stand for one licence. Full terms stand in ``licence_terms``.
"""

from importlib.resources import files

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution."""

BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will
the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""

GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms
of the GNU {name} as published by the Free Software Foundation, either version {version} of the
License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for
more details.
You should have received a copy of the GNU {name} along with this program. If not, see
<https://www.gnu.org/licenses/>."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If
a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""

CREATIVE_COMMONS = (
    ("CC-BY-4.0", "CC BY 4.0", "Attribution 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Attribution-ShareAlike 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Attribution-NonCommercial 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Attribution-NoDerivatives 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0"),
)
CC0_NOTICE = """To the extent possible under law, the author has waived all copyright and related or
neighboring rights to this work."""

EPL_NOTICE = """This program and the accompanying materials are made available under the terms of the
Eclipse Public License {version} which is available at https://www.eclipse.org/legal/epl-{url}"""

# Licences whose whole terms are templates.
TERMS = tuple(
    (path.name.removesuffix(".txt"), path.read_text(encoding="utf-8"))
    for path in sorted((files("hearsay.llm") / "licence_terms").iterdir(), key=lambda p: p.name)
)

GNU = (
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
)
SHORT = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    *((name, f"GNU {title}, version {version}") for name, title, version in GNU),
    *((name, short) for name, short, _ in CREATIVE_COMMONS),
    ("Apache-2.0", "Apache 2.0 License"),
    ("BSD-3-Clause", "3-Clause BSD License"),
    ("BSD-2-Clause", "2-Clause BSD License"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"),
    ("GPL-2.0", "GPLv2"),
    ("GPL-3.0", "GPLv3"),
    ("LGPL-2.1", "LGPLv2.1"),
    ("LGPL-3.0", "LGPLv3"),
    ("AGPL-3.0", "AGPLv3"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0"),
    ("EPL-1.0", "Eclipse Public License, Version 1.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("Zlib", "zlib License"),
)
SPDX = (
    *((name, name) for name in (
        "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-1.1", "MPL-2.0",
        "Unlicense", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0",
        "AGPL-3.0",
    )),
    *((name, name) for name, _, _ in CREATIVE_COMMONS),
    *((name, f"{name}-{form}") for name, _, _ in GNU for form in ("only", "or-later")),
)

TEMPLATES = [
    ("MIT", MIT),
    ("BSD-2-Clause", f"{BSD_CONDITIONS}\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_CONDITIONS}\n{BSD_NAMES}\n{BSD_DISCLAIMER}"),
    ("ISC", ISC),
    ("Zlib", ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    *((name, GPL_NOTICE.format(name=title, version=version)) for name, title, version in GNU),
    ("MPL-2.0", MPL_NOTICE),
    ("Unlicense", UNLICENSE),
    ("CC0-1.0", CC0_NOTICE),
    ("EPL-1.0", EPL_NOTICE.format(version="1.0", url="v10.html")),
    ("EPL-2.0", EPL_NOTICE.format(version="2.0", url="2.0/")),
    *TERMS,
    *((name, f"SPDX-License-Identifier: {tag}") for name, tag in SPDX),
    *(
        (name, f"This work is licensed under a Creative Commons {title} International License.")
        for name, _, title in CREATIVE_COMMONS
    ),
    *(
        (name, f"{start} {title}.")
        for start in ("Licensed under the", "Released under the", "Licensed under",
                      "This work is licensed under the", "Distributed under the terms of the",
                      "Available under the", "Distributed under the")
        for name, title in SHORT
    ),
]
