"""License wording as templates, in the markup of matching templates.

``<<beginOptional>>`` and ``<<endOptional>>`` enclose wording that may be absent; they may be nested.
``<<var;name=...;words=a-b>>`` stands for a to b words of any kind. Everything else is mandatory. Only words of letters
and digits count, without regard to case; punctuation and line breaks do not matter.
"""

from __future__ import annotations

_HOLDER = "<<var;name=holder;words=0-24>>"

_AS_IS = f"""
THIS SOFTWARE IS PROVIDED BY {_HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_BSD_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_GNU_NOTICE = """
<<beginOptional>>This program is free software<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
"""

#: (label, template)
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License"),
    ("mit", "<<beginOptional>>This <<var;name=work;words=1-3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    (
        "mit",
        f"""
        <<beginOptional>>MIT License<<endOptional>>
        <<beginOptional>>Copyright {_HOLDER}<<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.
        """,
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;name=thing;words=1-4>> except in compliance
        with the License. You may obtain a copy of the License at <<var;name=address;words=1-12>> Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.
        """,
    ),
    ("gpl-2.0", "<<beginOptional>>This <<var;name=work;words=1-3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 2"),
    ("gpl-3.0", "<<beginOptional>>This <<var;name=work;words=1-3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 3"),
    ("gpl-2.0-or-later", _GNU_NOTICE.format(kind="", version="2")),
    ("gpl-3.0-or-later", _GNU_NOTICE.format(kind="", version="3")),
    ("lgpl-2.1-or-later", _GNU_NOTICE.format(kind="Lesser ", version="2.1")),
    ("lgpl-3.0-or-later", _GNU_NOTICE.format(kind="Lesser ", version="3")),
    ("agpl-3.0-or-later", _GNU_NOTICE.format(kind="Affero ", version="3")),
    ("bsd-2-clause", f"{_BSD_CLAUSES} {_AS_IS}"),
    (
        "bsd-3-clause",
        f"""{_BSD_CLAUSES} <<beginOptional>>3.<<endOptional>> Neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. {_AS_IS}""",
    ),
    (
        "isc",
        f"""
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND {_HOLDER} DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        """,
    ),
    (
        "0bsd",
        f"""
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
        PROVIDED "AS IS" AND {_HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.
        """,
    ),
    (
        "mpl-2.0",
        """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at <<var;name=address;words=1-12>>
        """,
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "zlib",
        """
        This software is provided 'as-is', without any express or implied warranty. In no event will the <<beginOptional>>author or<<endOptional>>
        authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions
        """,
    ),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution 4.0 <<beginOptional>>International<<endOptional>> License"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution-ShareAlike 4.0 <<beginOptional>>International<<endOptional>> License"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> Creative Commons Attribution-NonCommercial 4.0 <<beginOptional>>International<<endOptional>> License"),
]

#: (label, words that stand consecutively)
PHRASES: list[tuple[str, str]] = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
