"""Texts of known licences and notices (fixed values) for the licence scan.

Short licences stand here whole, long ones as digests of their canonical form;
one-sentence notices are built by a rule from licence names and the sentences
that notices use.
"""

from __future__ import annotations

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = _BSD_HEAD + _BSD_THIRD + _BSD_TAIL

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""


def _gnu_notice(thing: str, name: str, version: str) -> str:
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version.

This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."""


MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

# names that one-sentence notices use
NAMES = (
    ("MIT", ("the MIT License", "the MIT license terms", "MIT")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "Apache-2.0")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2", "GPL-2.0")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3", "GPL-3.0")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "LGPLv3")),
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "AGPLv3")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the Simplified BSD License")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the New BSD License", "the BSD License")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "MPL 2.0")),
    ("CC0-1.0", ("CC0 1.0", "the Creative Commons CC0 license")),
)
SENTENCES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under {}.",
             "This software is released under {}.")


def _notices() -> list[tuple[str, str]]:
    names = [(key, spelling) for key, spellings in NAMES for spelling in spellings]
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        names += [(f"CC-{kind}-{v}", f"CC {kind} {v}") for v in ("2.0", "2.5", "3.0", "4.0")]
    out = [(key, s.format(name)) for key, name in names for s in SENTENCES]
    return [*out, *((key, f"SPDX-License-Identifier: {key}") for key in dict.fromkeys(k for k, _ in names)),
            ("public-domain", "This work is in the public domain."),
            ("public-domain", "This work has been released into the public domain by its author.")]


TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Apache-2.0", APACHE_NOTICE), ("MPL-2.0", MPL_NOTICE),
    *((f"{short}-{v}.0", _gnu_notice(thing, name, v)) for short, name, versions in (
        ("GPL", "General Public License", "23"), ("LGPL", "Lesser General Public License", "3"),
        ("AGPL", "Affero General Public License", "3")) for v in versions for thing in ("program", "library", "file")),
    *_notices(),
)

# (licence, digest of its first paragraph, paragraphs, digest of the whole text), by the expressions of the scan;
# texts with and without their appendix of instructions
WHOLE: tuple[tuple[str, str, int, str], ...] = (
    ("Apache-2.0", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 33,
     "d2e9c305255414867367e0f0a8f87c28057193ce4d8d46e6a7d12ee0c3cb142b"),
    ("Apache-2.0", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 27,
     "408d79782772308fe7ec4aeb2f0b2f9a28dcf9246ddcf0755c43e4d3fb4efa11"),
    ("Apache-2.0", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 26,
     "cb0c3bd3124478210522e8c821ca588654ce01e22f49f7da61cfbc25668b8487"),
    ("Apache-2.0", "8f9a07cfc74f13faacedb4ef5f66671824f4db35b0becf50739f877003b330a7", 32,
     "b86cc8f4ca3b78dc6187c66567d6089a5911bbe4537e1fa0d5d9c38ce1b3749e"),
    ("GPL-1.0", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 50,
     "6e96a68ec7c6417d2040ed977d08017fa4fb477dd7770f2602ed60f1499d5fc1"),
    ("GPL-1.0", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 35,
     "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "82397a16c2231c372bdd0ef728bd88bf794e7b7858a5ee5e95a390556acb8081", 34,
     "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 59,
     "fca9d0597eee5ef85465916ba61b41fd1ec4ba0a53efd599baa65c1a5b426a9b"),
    ("GPL-2.0", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 44,
     "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "800704d54279141c14d2b5236cc50e7ea885fc8220e3bdaa410f2b54971d7522", 43,
     "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 122,
     "ae4b99738073ffde61412ab13252e0ed47e0d29b0cd510ed5c8d9a494f7c159d"),
    ("GPL-3.0", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 109,
     "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "10c3854c70c10808f2f455ff7ae311088ab9dd94c2c06693fb750f4c9e482943", 108,
     "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 83,
     "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 71,
     "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "6ed1731e87010ecac4542e62634534a81feb95b467f42e6140f554e77f81aaf9", 70,
     "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 85,
     "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 73,
     "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4de811fed3402b35cc931316356c984d20ec54d660630f4064c708984b91f51a", 72,
     "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "b1dddaf7ef2e30067896bb2f11cf3c9defcf11564304f448a9257f49502a9e85", 37,
     "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", 83,
     "4cabe7a78fd77da2d52b1a2929bf10219e45cfc14279d76a49774370a74b3d17"),
    ("MPL-2.0", "58c9a1c62b739e4bead89c80c6af62cd77999c648016e24ba011e53180a5cc15", 77,
     "da79d8c581c2a42b486948b54a56ee2dd7a105d8eceaa4203dfe5e0433d433b3"),
    ("MPL-1.1", "e8d78c7ef0b7fb5f931ba9501977c8ca266cc1ab4b95b40fea21f3a7867310ca", 73,
     "a6aeacc782727e13c8f18dbf840e981706554bbe5b6bc1afb2b5a6b62426fedc"),
    ("CC0-1.0", "021f3f319970fcf1f6e1d478e5367d797699877f3434ad73ee1ef815fdc7cd63", 13,
     "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "8d2eae4d251844e9a73f0504efb40de0122c63022a833e6e0f5caafcd8f04324", 57,
     "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "f42b2e6807623175c74cf8ca228746283c01775b536214b79d00df84c9a65ffa", 67,
     "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("Unlicense", "c933e7afa5abf4f2ac1fe841a7716f9501b9882b5a4565611f8e066d58c9470c", 5,
     "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("Unlicense", "c933e7afa5abf4f2ac1fe841a7716f9501b9882b5a4565611f8e066d58c9470c", 4,
     "f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5"),
    ("BSL-1.0", "c4bb155b9ba7020719676712b51dcf58dc86097a7bf2914fcdf9677c7d2bc2b8", 4,
     "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),
    ("BSL-1.0", "0c7cd6eb57a8cc32afefc19ad7e6e498cdfe75e64795f8bcc878a97a19391c30", 3,
     "4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85"),
    ("Zlib", "06c8d0474056a7da97d53c30ed161bcd500f2aec91b00ecb2a8a6192438b8fdd", 5,
     "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "c45c1816fdb6988a579a27d4dc86cbfb4640b35f380134a96b714de8d663bf69", 6,
     "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
)
