"""Known licence texts and one-line notices, each with the licence it stands for.

The long texts lie in ``licenses/``, named by their licence; they are read where the table is made, on the driver.
"""

from __future__ import annotations

from pathlib import Path

# Licences by the names that notices use.
NAMES = (
    ("MIT", ("the MIT License", "the MIT license (MIT)", "MIT")),
    ("ISC", ("the ISC License", "ISC")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2", "GPL-2.0")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3", "GPL-3.0")),
    ("LGPL-2.1", ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the LGPLv2.1", "LGPL-2.1")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the LGPLv3", "LGPL-3.0")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the AGPLv3", "AGPL-3.0")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0")),
    ("Unlicense", ("the Unlicense", "Unlicense")),
    ("EPL-2.0", ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "EPL-2.0")),
    ("BSL-1.0", ("the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0")),
    ("Zlib", ("the zlib License", "the zlib/libpng License", "Zlib")),
    ("0BSD", ("the BSD Zero Clause License", "the Zero-Clause BSD License", "0BSD")),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    ("CC-BY-NC-ND-4.0", ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License")),
)
SAYINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This program is licensed under", "This software is released under", "This project is released under", "This work is released under", "This program is distributed under", "This software is distributed under", "Available under", "This code is licensed under", "This package is licensed under")

# Short licence texts.
_SHORT = {
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
        'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
        "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
        "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        'generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}
# What may stand before a short text, and for one of them after it.
_SHORT_HEADS = {
    "Unlicense": ("", "The Unlicense ", "Unlicense "),
    "BSL-1.0": ("",),
    "Zlib": ("", "zlib License ", "The zlib License ", "zlib/libpng License ", "The zlib/libpng License "),
    "0BSD": ("", "BSD Zero Clause License ", "Zero-Clause BSD ", "Zero Clause BSD License ", "0BSD "),
}
_UNLICENSE_END = (" For more information, please refer to <https://unlicense.org>", " For more information, please refer to <http://unlicense.org/>", " For more information, please refer to <https://unlicense.org/>")

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
# In a text whose copyright line goes, the words that stand before the grant.
_BSD_HEADS = {
    "BSD-2-Clause": ("", "BSD 2-Clause License ", "The BSD 2-Clause License ", "Simplified BSD License "),
    "BSD-3-Clause": ("", "BSD 3-Clause License ", "The BSD 3-Clause License ", "New BSD License "),
}


def _bsd() -> list[tuple[str, str]]:
    out = []
    for name, heads in _BSD_HEADS.items():
        for head in heads:
            for rights in ("", "All rights reserved. "):
                for numbered in (True, False):
                    grant = _BSD + ("" if name == "BSD-2-Clause" else "3. " + _THIRD)
                    text = grant if numbered else grant.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
                    out.append((name, head + rights + text + _BSD_END))
    return out


def _long() -> list[tuple[str, str]]:
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        end = text.find("END OF TERMS AND CONDITIONS")
        if end > 0:  # often copied without the appendix on how to apply it
            out += [(path.stem, text[:end]), (path.stem, text[:end] + "END OF TERMS AND CONDITIONS")]
    return out


def _notices() -> list[tuple[str, str]]:
    out = [(name, f"{say} {title}.") for name, titles in NAMES for title in titles for say in SAYINGS]
    return out + [(name, f"SPDX-License-Identifier: {name}{more}") for name, _ in NAMES for more in ("", *(("-only", "-or-later") if "GPL" in name else ()))]


def _short() -> list[tuple[str, str]]:
    out = [(name, head + text) for name, text in _SHORT.items() for head in _SHORT_HEADS[name]]
    return out + [(name, text + end) for name, text in out if name == "Unlicense" for end in _UNLICENSE_END]


def known_licenses() -> tuple[tuple[str, str], ...]:
    """(license, text) of all of them."""
    return tuple(_notices() + _bsd() + _short() + _long())
