"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Text is normalised byte by byte: ASCII letters in lower case, other ASCII but letters and digits to blanks. Any stretch of a
document is a window, whatever lines and blank lines it crosses and whatever stands around it in a line. A window of a
distinct bigrams that shares h with a template of b has a Dice of 2 h / (a + b), so DICE needs h >= DICE b / (2 - DICE) and
a <= b (2 - DICE) / DICE. Documents with fewer of a template's bigrams are not compared with it; in others the most similar
window from each of the template's bigrams on is found exactly. Of windows that overlap, the one that shares the most bigrams
(then that of the highest Dice) names the licence: a text of BSD-3-Clause holds all of BSD-2-Clause. A licence's Dice is the
highest of its windows.

Templates are 38 licences: whole texts of the short ones, with and without their warranty paragraphs, and the notices that refer to
the long ones (Apache, CC, CDDL, EPL, EUPL, GNU, MPL, OFL), whose own texts are not among them.

Defined cases: null and empty texts and texts of a single word match nothing; rows that repeat an id are separate documents;
templates that tie are both reported, best names the first by id; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts

DICE = 0.8
FILTER_BITS = 20

# Notices and short texts of public licences.
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

_BSD_1 = _BSD_2[: _BSD_2.index(" 2. Redist")]
_BSD_4 = _BSD_2 + " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization." + _BSD_3[len(_BSD_2) :].replace(" 3. ", " 4. ")
_MIT_GRANT = _MIT[: _MIT.index(", subject to")]
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_REST = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
_BOOST_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_X11 = "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."
_NCSA = "subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution. Neither the names of the developers nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission."
_POSTGRESQL = "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."
_HPND = "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation."
_WTFPL = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
_BEER = "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return."
_EUPL = "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at: https://joinup.ec.europa.eu/software/page/eupl Unless required by applicable law or agreed to in writing, software distributed under the Licence is distributed on an \"AS IS\" basis, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the Licence for the specific language governing permissions and limitations under the Licence."


def _cc(short: str, full: str) -> tuple[str, str]:
    return f"Licensed under CC {short}.", f"This work is licensed under a Creative Commons {full} International License."


def _gnu(kind: str, version: str, what: str = "program") -> tuple[str, str]:
    """The first paragraph of the notice and the whole notice."""
    one = f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    two = f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
    return one, f"{one} {two} You should have received a copy of the GNU {kind} along with this {what}. If not, see <https://www.gnu.org/licenses/>."


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (_BSD_2, f"{_BSD_2} {_BSD_WARRANTY}", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD_3, f"{_BSD_3} {_BSD_WARRANTY}"),
    "CC-BY-4.0": _cc("BY 4.0", "Attribution 4.0"),
    "CC-BY-NC-4.0": _cc("BY-NC 4.0", "Attribution-NonCommercial 4.0"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives 4.0"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0"),
    "CC-BY-ND-4.0": _cc("BY-ND 4.0", "Attribution-NoDerivatives 4.0"),
    "CC-BY-SA-4.0": _cc("BY-SA 4.0", "Attribution-ShareAlike 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("General Public License", "3")),
    "ISC": (_ISC, f"{_ISC} {_ISC_WARRANTY}"),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser General Public License", "2.1"), *_gnu("Lesser General Public License", "2.1", "library")),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3"), *_gnu("Lesser General Public License", "3", "library")),
    "MIT": ("Released under the MIT License.", _MIT, f"{_MIT} {_MIT_WARRANTY}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": (_UNLICENSE, f"{_UNLICENSE} {_UNLICENSE_REST} {_MIT_WARRANTY} For more information, please refer to <https://unlicense.org/>"),
    "0BSD": (f"{_ISC[: _ISC.index(', provided')]}. {_ISC_WARRANTY}",),
    "Artistic-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0).",),
    "Beerware": (_BEER,),
    "BSD-1-Clause": (f"{_BSD_1} {_BSD_WARRANTY}",),
    "BSD-4-Clause": (_BSD_4, f"{_BSD_4} {_BSD_WARRANTY}"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", _BOOST, f"{_BOOST} {_BOOST_WARRANTY}"),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "EUPL-1.2": (_EUPL,),
    "GFDL-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",),
    "HPND": (_HPND,),
    "MIT-0": (f"{_MIT_GRANT}. {_MIT_WARRANTY}",),
    "NCSA": (f"{_MIT_GRANT.replace('to deal in', 'to deal with')}, {_NCSA}", f"{_MIT_GRANT.replace('to deal in', 'to deal with')}, {_NCSA} {_MIT_WARRANTY}"),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://scripts.sil.org/OFL",),
    "PostgreSQL": (_POSTGRESQL,),
    "WTFPL": (_WTFPL,),
    "X11": (f"{_MIT} {_MIT_WARRANTY} {_X11}",),
    "Zlib": (_ZLIB,),
}

NORMAL = np.full(256, 32, np.uint8)
NORMAL[10] = 10
NORMAL[48:58], NORMAL[97:123], NORMAL[65:91], NORMAL[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def bigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each two words in a row."""
    text = NORMAL[data]
    s, e, upto = ts.words(text, offs)
    h = ts.word_hashes(text, s, e)
    row = ts.owners(upto)
    pair = np.flatnonzero(row[1:] == row[:-1])
    return ts.gram_hashes(h, 2, ts.FIRST)[pair], row[pair]


def neighbours(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands the time before (-1: never) and the next time (len(h): never)."""
    order = np.argsort(h, kind="stable")
    same = ~ts.new_group(h[order])[1:]
    before, after = np.full(len(h), -1, np.int64), np.full(len(h), len(h), np.int64)
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    return before, after


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]], dice: float):
        self.dice = dice
        self.sets: list[tuple[str, np.ndarray]] = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                raw = np.frombuffer(text.encode(), np.uint8)
                self.sets.append((name, np.unique(bigrams(raw, np.array([0, len(raw)]))[0])))
        g = np.concatenate([np.zeros(0, np.uint64), *[s for _, s in self.sets]])
        order = np.argsort(g, kind="stable")
        self.grams, self.who = g[order], np.repeat(np.arange(len(self.sets)), [len(s) for _, s in self.sets])[order]
        # a window shares all its bigrams at best, and a template all of its own
        self.least = np.array([max(1, int(np.ceil(dice * len(s) / (2 - dice) - 1e-9))) for _, s in self.sets], np.int64)
        self.most = [int(len(s) * (2 - dice) / dice + 1e-9) for _, s in self.sets]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def windows(self, k: int, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, float, int, int, str]]:
        """(bigrams shared, Dice, first, last, licence): for each first place the window most similar to template k, whose
        bigrams stand at the places at. A window whose first bigram comes again is no better than the one without it."""
        (name, own), least, most, out = self.sets[k], int(self.least[k]), self.most[k], []
        far = np.append(at[least - 1 :], np.full(least - 1, len(before)))[: len(at)]
        for i in np.flatnonzero(far < after[at]).tolist():
            s, stop, wide = int(at[i]), int(after[at[i]]), 2 * most
            while True:
                distinct = np.cumsum(before[s : min(s + wide, stop)] < s)
                if distinct[-1] > most or s + wide >= stop:
                    break
                wide *= 2
            ends = at[i : np.searchsorted(at, s + np.searchsorted(distinct, most, "right"))]
            if len(ends) < least:
                continue
            shared = np.cumsum(before[ends] < s)
            dice = 2 * shared / (distinct[ends - s] + len(own))
            j = len(dice) - 1 - int(np.argmax(dice[::-1]))
            if dice[j] >= self.dice:
                out.append((int(shared[j]), float(dice[j]), s, int(ends[j]), name))
        return out

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[dict[str, float]]:
        out: list[dict[str, float]] = [{} for _ in range(len(offs) - 1)]
        h, row = bigrams(data, offs)
        hits = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.grams, h[hits], "left"), np.searchsorted(self.grams, h[hits], "right")
        n = hi - lo
        who = self.who[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(hits, n)
        order = np.lexsort((at, who, row[at]))
        at, who = at[order], who[order]
        cut = np.flatnonzero(ts.new_group(row[at], who))
        ends = np.append(cut[1:], len(at))
        enough = ends - cut >= self.least[who[cut]]
        found: dict[int, list] = {}
        cuts = np.searchsorted(row, np.arange(len(offs)))
        for a, b in zip(cut[enough].tolist(), ends[enough].tolist(), strict=True):
            d, k = int(row[at[a]]), int(who[a])
            if len(np.unique(h[at[a:b]])) >= self.least[k]:
                found.setdefault(d, []).append((k, at[a:b] - cuts[d]))
        for d, some in found.items():
            places = neighbours(h[cuts[d] : cuts[d + 1]])
            every = sorted((w for k, p in some for w in self.windows(k, p, *places)), reverse=True)
            held = np.zeros(cuts[d + 1] - cuts[d], bool)  # by windows that share more, or as much at a higher Dice
            names, tied = set(), []
            for i, (shared, dice, s, e, name) in enumerate(every):
                if not held[s : e + 1].any():
                    names.add(name)
                    tied.append((s, e))
                if i + 1 == len(every) or every[i + 1][:2] != (shared, dice):
                    for s, e in tied:
                        held[s : e + 1] = True
                    tied = []
            for _, dice, _, _, name in every:
                if name in names:
                    out[d][name] = max(dice, out[d].get(name, 0.0))
        return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, licenses, dices, best), one row per input row; licences in order of their ids."""
    templates = TEMPLATES if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(pa.string())), ("dices", pa.list_(pa.float64())), ("best", pa.string())])

    def run(it):
        known = Templates(templates, dice)
        for batch in it:
            got = []
            for _, _, data, offs in ts.chunks(batch.column(1)):
                got += [sorted(x.items()) for x in known.scan(data, offs)]
            best = [max(x, key=lambda y: y[1])[0] if x else None for x in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[n for n, _ in x] for x in got], schema.field(1).type), pa.array([[v for _, v in x] for x in got], schema.field(2).type), pa.array(best, pa.string())], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, licenses array<string>, dices array<double>, best string")
