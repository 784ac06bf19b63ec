"""Known licence texts and notices: fixed values, public texts in their usual wording."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: (licence, title line or empty, text)
TEXTS = [
    ("MIT", "MIT License", _MIT),
    ("ISC", "ISC License", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_REST}"),
    ("0BSD", "BSD Zero Clause License", f"{_ISC_GRANT}.{_ISC_REST}"),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("Zlib", "zlib License", _ZLIB),
]

#: (licence, notice of one line)
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]

#: Licences that usual one-line notices name, by identifier and by name; see SENTENCES.
NAMES = [
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"), ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), ("Zlib", "zlib License"),
]
SENTENCES = ["Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}."]
IDENTIFIERS = [*dict.fromkeys(i for i, _ in NAMES), "0BSD", "CC0-1.0", "Unlicense"]
NOTICES += [(i, s.format(n)) for i, n in NAMES for s in SENTENCES]
NOTICES += [(i, f"SPDX-License-Identifier: {i}{end}") for i in IDENTIFIERS for end in ("", "-only", "-or-later") if not end or "GPL" in i]
NOTICES += [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]

#: (digest of the canonical form, licence) of long texts, as distributions ship them.
DIGESTS = [
    ("e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "Apache-2.0"),
    ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2", "Artistic-1.0"),
    ("4dd2d8faa991a43111f73718974d1a9133ba1453cd76d174da75d163e35fa974", "CC-BY-SA-4.0"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71", "GFDL-1.2"),
    ("93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6", "GFDL-1.3"),
    ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "GPL-1.0"),
    ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "GPL-2.0"),
    ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "GPL-3.0"),
    ("78d12b012407f04494ad9447817157c702f9bc389600604ae4e0d6a025f6d32f", "ISC"),
    ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "LGPL-2.0"),
    ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "LGPL-2.1"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0"),
    ("3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1", "MPL-1.1"),
    ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", "MPL-2.0"),
    ("bb6c44416437f5ab412ca9d762d4bdae1dc4e6a9c5afc9ac0965eb5e57b4e055", "NCSA"),
    ("a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a", "OFL-1.1"),
    ("53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8", "Unicode-3.0"),
    ("7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd", "Unlicense"),
]

#: Spellings that count as the second of each pair.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencee": "licensee", "sublicence": "sublicense",
    "favour": "favor", "favourable": "favorable", "merchantibility": "merchantability", "acknowledgement": "acknowledgment",
    "organisation": "organization", "authorised": "authorized", "recognised": "recognized", "whilst": "while", "analyse": "analyze",
}
