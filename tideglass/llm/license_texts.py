"""Templates of public licenses and of the notices that name them.

Fixed values: the wordings. ``[[...]]`` is optional, ``{{n}}`` stands for up to n words of any kind; the rest
must stand word for word. Case and signs don't count. Labels ending in ``-text`` are of whole licenses, those
ending in ``-notice`` of the notices that longer ones prescribe. What follows a ``#`` tells wordings of one label apart.
Versions and variants are mandatory words: a notice that states one is never taken for another's.
"""

from __future__ import annotations

_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE {{2}} NONINFRINGEMENT. IN NO EVENT SHALL THE {{12}} BE LIABLE FOR ANY {{3}} DAMAGES OR
OTHER LIABILITY, WHETHER IN {{3}} CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.
"""
_BSD = """
Redistribution and use [[of this software]] in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [[{{1}}]] Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. [[{{1}}]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_NO_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_GNU = "under the [[terms of the]] gnu {kind} [[as published by the free software foundation]] [[either]] version {version}"

TEMPLATES: dict[str, str] = {
    "mit": "permission is hereby granted [[free of charge]] to any person obtaining a copy of this {{3}} and associated documentation files {{3}} to deal in the {{3}} without restriction",
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this {{3}} and associated documentation files [[(the
        {{1}})]], to deal in the {{2}} without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the {{2}}, and to permit persons to whom the {{2}} is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in
        all copies or substantial portions of the Software.
        """ + _AS_IS,
    "apache-2": "licensed under the apache license version 2 [[0]] the license {{2}} you may not use this file except in compliance with the license",
    "apache-2-notice": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at {{8}} Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.
        """,
    "gpl-3": "licensed " + _GNU.format(kind="general public license", version="3"),
    "gpl-2": "licensed " + _GNU.format(kind="general public license", version="2"),
    "mit#terms": "under the terms of the mit license",
    "apache-2#version": "under the [[terms of the]] apache license [[version]] 2 0",
    "apache-2#v2": "under the [[terms of the]] apache license v2 [[0]]",
    "gpl-3#v3": "under the [[terms of the]] gnu general public license v3 [[0]]",
    "gpl-2#v2": "under the [[terms of the]] gnu general public license v2 [[0]]",
    "agpl-3#v3": "under the [[terms of the]] gnu affero general public license v3 [[0]]",
    "lgpl-3": _GNU.format(kind="lesser general public license", version="3"),
    "lgpl-3#v3": "under the [[terms of the]] gnu lesser general public license v3 [[0]]",
    "lgpl-2.1": _GNU.format(kind="lesser general public license", version="2 1"),
    "lgpl-2.1#v2": "under the [[terms of the]] gnu lesser general public license v2 1",
    "gpl-notice": """
        This program is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation[[;]] {{3}} version {{2}} of the License [[, or (at your option) any later version]]. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        """,
    "lgpl": "licensed under the [[terms of the]] gnu lesser general public license",
    "agpl-3": "licensed " + _GNU.format(kind="affero general public license", version="3"),
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-text": _BSD + _BSD_AS_IS,
    "bsd-3-text": _BSD + "[[{{1}}]] Neither the name of {{12}} nor the names of {{8}} may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_AS_IS,
    "isc": "permission to use copy modify and [[or]] distribute this software [[and its documentation]] for any purpose with or without fee is hereby granted",
    "isc-text": """
        Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.
        """ + _NO_WARRANTY,
    "0bsd-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        """ + _NO_WARRANTY,
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: [[{{1}}]] The origin of this software must
        not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
        in the product documentation would be appreciated but is not required. [[{{1}}]] Altered source versions must be plainly marked as such, and
        must not be misrepresented as being the original software. [[{{1}}]] This notice may not be removed or altered from any source distribution.
        """,
    "bsl-1-text": """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
        following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
        following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
        DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        """,
    "wtfpl": """
        Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as
        the name is changed.
        """,
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license [[v]] [[version]] 2 0",
    "cc0": "to the extent possible under law {{12}} has waived all copyright and related or neighboring rights to",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-text": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
        the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law.
        """ + _AS_IS,
    "all-rights-reserved": "copyright {{6}} all rights reserved",
}

#: The Creative Commons licenses: what their names say, in the spellings in use, and the versions that were published.
_CC = {
    "cc-by": ("attribution",),
    "cc-by-sa": ("attribution sharealike", "attribution share alike"),
    "cc-by-nd": ("attribution noderivatives", "attribution noderivs", "attribution no derivatives", "attribution no derivs"),
    "cc-by-nc": ("attribution noncommercial", "attribution non commercial"),
    "cc-by-nc-sa": ("attribution noncommercial sharealike", "attribution non commercial share alike", "attribution non commercial sharealike", "attribution noncommercial share alike"),
    "cc-by-nc-nd": ("attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution non commercial no derivatives", "attribution non commercial no derivs"),
}
_CC_VERSIONS = {"4.0": "4 0 [[international]]", "3.0": "3 0 [[unported]]", "2.5": "2 5 [[generic]]", "2.0": "2 0 [[generic]]", "1.0": "1 0 [[generic]]"}
for _label, _names in _CC.items():
    for _name in _names:
        _under = f"licensed under [[a]] [[the]] [[terms of the]] creative commons {_name}"
        TEMPLATES[f"{_label}#{_name}"] = f"{_under} license"
        TEMPLATES |= {f"{_label}-{_v}#{_name}": f"{_under} {_words} license" for _v, _words in _CC_VERSIONS.items()}
