"""Wordings of licences: short notices, standard headers and the texts themselves (of very long ones, how they begin)."""

from __future__ import annotations

_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_MIT_REST = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
    "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu_header(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _gnu_grant(kind: str, version: str, later: bool) -> str:
    """The header's first sentence, which often stands alone."""
    terms = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; {terms}."


def _gnu_notice(kind: str, version: str) -> list[str]:
    return [
        f"This work is licensed under the GNU {kind} Public License, version {version}.",
        f"licensed under the terms of the GNU {kind} Public License v{version}",
        f"GNU {kind} Public License v{version}",
    ]


def _gnu_body(kind: str, version: str, date: str) -> str:
    return (
        f"GNU {kind.upper()} PUBLIC LICENSE Version {version}, {date} Copyright (C) Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


_GNU = [
    ("GPL-2.0", "General", "2", "June 1991"), ("GPL-3.0", "General", "3", "29 June 2007"), ("LGPL-2.1", "Lesser General", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007"), ("AGPL-3.0", "Affero General", "3", "19 November 2007"),
]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]

#: (licence, wording). Case, white space and punctuation don't count.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_REST + _MIT_WARRANTY),
    ("MIT-0", _MIT_GRANT + ". " + _MIT_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
        "under the License.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ),
    *[(f"{name}", t) for name, kind, v, _ in _GNU for t in _gnu_notice(kind, v)],
    *[(f"{name}-or-later", _gnu_header(kind, v)) for name, kind, v, _ in _GNU],
    *[(f"{name}-or-later", _gnu_grant(kind, v, True)) for name, kind, v, _ in _GNU],
    *[(f"{name}-only", _gnu_grant(kind, v, False)) for name, kind, v, _ in _GNU],
    *[(name, _gnu_body(kind, v, date)) for name, kind, v, date in _GNU],
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _WARRANTY_BSD),
    ("BSD-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ". " + _ISC_WARRANTY),
    *[(f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k, _ in _CC],
    *[(f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {n} 4.0 International License.") for k, n in _CC],
    *[(f"CC-{k}-4.0", f"Creative Commons {n} 4.0 International License") for k, n in _CC],
    *[(f"CC-{k}-3.0", f"This work is licensed under a Creative Commons {n} 3.0 Unported License.") for k, n in _CC],
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal public domain dedication"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works '
        "of the Software",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("All-rights-reserved", "All rights reserved."),
]

#: Names of the identifier lines.
SPDX = [
    "MIT", "MIT-0", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-3.0", "CC-BY-SA-3.0", "Unlicense", "BSL-1.0", "Zlib", "EPL-2.0", "WTFPL",
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
