"""Texts of licences and of the notices that files carry, with their labels.

Fixed values, from the public texts of the licences.
"""

from importlib import resources

#: Labels of the whole licence texts in the folder licences, which are kept as their stewards publish them.
WHOLE = {
    "Apache-2.0": "apache-2",
    "Artistic": "artistic-1",
    "CC0-1.0": "cc0",
    "GFDL-1.3": "gfdl-1.3",
    "GPL-2": "gpl-2",
    "GPL-3": "gpl-3",
    "LGPL-2.1": "lgpl-2.1",
    "LGPL-3": "lgpl-3",
    "MPL-2.0": "mpl-2",
}


def whole_texts() -> list[tuple[str, str]]:
    folder = resources.files("tracelake.llm.licences")
    return [(label, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name, label in WHOLE.items()]


MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software
"""

ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

ISC_GRANT = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies
"""

BSD_TWO_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_THIRD_CLAUSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""

BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE.
"""

BSD_GRANT = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met
"""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.
"""

APACHE_GRANT = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at
"""

APACHE_COPYRIGHT = """
Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly
display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.
"""

#: {subject}: what the notice calls the work; {name} and {version}: of its licence.
GNU_NOTICE = """
{subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version. {subject} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
"""

GNU_GRANT = """
{subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version
"""

GNU_SHORT = "licensed under the {name} version {version}"

#: Label, name, version, what it calls the work.
GNU = [
    ("gpl-2", "GNU General Public License", "2", "This program"),
    ("gpl-3", "GNU General Public License", "3", "This program"),
    ("lgpl-2.1", "GNU Lesser General Public License", "2.1", "This library"),
    ("lgpl-3", "GNU Lesser General Public License", "3", "This library"),
    ("lgpl-3", "GNU Lesser General Public License", "3", "This program"),
    ("agpl-3", "GNU Affero General Public License", "3", "This program"),
]

MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at
"""

EPL_NOTICE = """
This program and the accompanying materials are made available under the terms of the Eclipse Public License {version}
which is available at
"""

EPL_OLDER_NOTICE = """
All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public
License v1.0 which accompanies this distribution, and is available at
"""

UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means.
"""

ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
notice may not be removed or altered from any source distribution.
"""

BOOST_NOTICE = "Distributed under the Boost Software License, Version 1.0."

CC_ZERO = """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work
"""

#: Label, name and short name of the Creative Commons licences.
CREATIVE_COMMONS = [
    ("cc-by", "Attribution", "BY"),
    ("cc-by-sa", "Attribution-ShareAlike", "BY-SA"),
    ("cc-by-nd", "Attribution-NoDerivatives", "BY-ND"),
    ("cc-by-nc", "Attribution-NonCommercial", "BY-NC"),
    ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
]

TEMPLATES: list[tuple[str, str]] = [
    ("mit", MIT),
    ("mit", MIT_GRANT),
    ("mit", "Released under the MIT License"),
    ("isc", ISC),
    ("isc", ISC_GRANT),
    ("bsd-2", BSD_TWO_CLAUSES + BSD_DISCLAIMER),
    ("bsd-3", BSD_TWO_CLAUSES + BSD_THIRD_CLAUSE + BSD_DISCLAIMER),
    ("bsd", BSD_GRANT),
    ("apache-2", APACHE_NOTICE),
    ("apache-2", APACHE_GRANT),
    ("apache-2", APACHE_COPYRIGHT),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    *((label, form.format(name=name, version=version, subject=subject)) for label, name, version, subject in GNU for form in (GNU_NOTICE, GNU_GRANT, GNU_SHORT)),
    ("mpl-2", MPL_NOTICE),
    ("epl-1", EPL_OLDER_NOTICE),
    ("epl-2", EPL_NOTICE.format(version="2.0")),
    ("unlicense", UNLICENSE),
    ("zlib", ZLIB),
    ("boost-1", BOOST_NOTICE),
    ("cc0", CC_ZERO),
    *((label, f"This work is licensed under a Creative Commons {name} 4.0 International License") for label, name, _ in CREATIVE_COMMONS),
    *((label, f"Licensed under CC {short} 4.0") for label, _, short in CREATIVE_COMMONS),
    *whole_texts(),
]
