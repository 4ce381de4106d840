"""License recognition by sentence rules.

A text is cut into pieces at stops and line ends, each normalised (lower case,
punctuation and blanks folded, list marks dropped, years and holders of copyright
lines replaced). The longest run of pieces that is a known licence sentence is one
sentence, so wrapped lines, comment marks and stops inside a sentence don't hide it;
every other piece is a sentence of its own. The sequence of identifiers is then matched against licence
rules, ordered sequences of identifiers: at each place the longest rule that fits
names the licence. Identifiers that no rule takes are reported as unmatched, so a
changed or partial licence shows.

Texts are scanned whole, row by row, and nothing is shuffled.

Defined cases: null and empty texts have no sentences; sentences that no
identifier has are counted and passed over, but they do not break a rule (other
text may stand between licence sentences); repeated rows each get their result;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A piece ends at a stop before a blank, or with its line.
END = re.compile(r"(?<=[.!?;:])\s+|\n+")
FOLD = re.compile(r"[^a-z0-9.]+")
#: A number or letter that counts the items of a list.
MARK = re.compile(r"^[^a-z0-9]*(?:\(?(?:[0-9]{1,2}|[a-z])\)|(?:[0-9]{1,2}|[a-z])\.)\s+")
COPYRIGHT = re.compile(r"^(?:c )?copyright (?:c )?.*$")

# Sentences of published licences and notices.
SENTENCES: dict[str, str] = {
    "Released under the MIT License.": "mit-notice",
    "Licensed under the MIT License.": "mit-notice",
    "This project is licensed under the MIT License.": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit-condition",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.": "mit-warranty",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit-liability",
    "Licensed under the Apache License, Version 2.0.": "apache-notice",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "apache-grant",
    "you may not use this file except in compliance with the License.": "apache-use",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache-warranty",
    "See the License for the specific language governing permissions and limitations under the License.": "apache-see",
    "This work is licensed under the GNU General Public License, version 3.": "gpl3-notice",
    "Licensed under the GNU General Public License, version 2.": "gpl2-notice",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3-grant",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;": "gpl-hope",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-warranty",
    "See the GNU General Public License for more details.": "gpl-see",
    "Licensed under CC BY 4.0.": "cc-by-notice",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa-notice",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-notice",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by-notice",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-names",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-notice",
    "All rights reserved.": "rights-reserved",
}

# Licences by their sentences, in order.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-notice",)),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-hope", "gpl-warranty", "gpl-see")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("all-rights-reserved", ("copyright", "rights-reserved")),
]


def folded(sentence: str) -> str:
    return FOLD.sub(" ", MARK.sub("", sentence.lower(), count=1)).strip(" .")


def normalised(sentence: str) -> str:
    text = folded(sentence)
    return "copyright" if COPYRIGHT.match(text) else text


class LicenseRules:
    """Sentence identifiers and the rules that order them."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES):
        self.known = {normalised(s): name for s, name in sentences.items()} | {"copyright": "copyright"}
        self.rules = sorted(rules, key=lambda r: -len(r[1]))
        # most pieces begin like no known sentence
        self.heads: dict[str, list[str]] = {}
        for sentence in self.known:
            self.heads.setdefault(sentence.split(" ", 1)[0], []).append(sentence)

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, str | None]]:
        """(start, end, identifier or None) of every sentence with letters or digits."""
        at, text, pieces = 0, text or "", []
        for stop in END.finditer(text):
            pieces.append((at, stop.start()))
            at = stop.end()
        pieces.append((at, len(text)))
        k = 0
        while k < len(pieces):
            start, end = pieces[k]
            taken = 1
            if any(c.isalnum() for c in text[start:end]):
                taken, name = self.identify(text, pieces, k)
                yield start, pieces[k + taken - 1][1], name
            k += taken

    def identify(self, text: str, pieces: list[tuple[int, int]], k: int) -> tuple[int, str | None]:
        """Number of pieces from the k-th on that make the longest known sentence, and its identifier."""
        start, end = pieces[k]
        head = folded(text[start : min(end, start + 60)]).split(" ", 1)[0]
        if head not in self.heads and head not in ("c", "copyright"):
            return 1, None
        found = (1, self.known.get(normalised(text[start:end])))
        for last in range(k, len(pieces)):
            run = folded(text[start : pieces[last][1]])
            if run in self.known and run != "copyright":
                found = (last - k + 1, self.known[run])
            if not any(s.startswith(run) for s in self.heads.get(head, ())):
                break
        return found

    def match(self, names: list[str]) -> tuple[list[tuple[str, int, int]], list[str]]:
        """Licences with their places in the sequence, and the identifiers left."""
        found, left, at = [], [], 0
        while at < len(names):
            for licence, rule in self.rules:
                if tuple(names[at : at + len(rule)]) == rule:
                    found.append((licence, at, at + len(rule)))
                    at += len(rule)
                    break
            else:
                left.append(names[at])
                at += 1
        return found, left


def scan_licenses(docs: DataFrame, rules: LicenseRules | None = None) -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids, licenses, unmatched, spans of the licences."""
    shared = docs.sparkSession.sparkContext.broadcast(rules or LicenseRules())

    @F.pandas_udf("n_sentences long, sentence_ids string, licenses string, unmatched string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            pieces = list(shared.value.sentences(text))
            named = [p for p in pieces if p[2]]
            found, left = shared.value.match([p[2] for p in named])
            spans = ",".join(f"{licence}:{named[a][0]}:{named[b - 1][1]}" for licence, a, b in found)
            rows.append((len(pieces), ",".join(p[2] for p in named), ",".join(sorted({f[0] for f in found})), ",".join(left), spans))
        return pd.DataFrame(rows, columns=["n_sentences", "sentence_ids", "licenses", "unmatched", "spans"])

    return docs.select("doc_id", scan("text").alias("_s")).select("doc_id", "_s.*")
