"""Toxicity, secrets, language and licence recognition."""

import hashlib
import math
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id, license, secrets, toxicity

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def plain_segments(scores):
    """All maximal segments by definition: the best segment, then both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best = max(((sum(scores[a:b]), a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (x[0], x[1], x[2]))
    *_, a, b = best
    return [*plain_segments(scores[:a]), (a, b, best[0]), *((x + b, y + b, s) for x, y, s in plain_segments(scores[b:]))]


@pytest.mark.parametrize("seed", range(40))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-5, -3, -2, -1, 1, 2, 4, 7]) + rng.random() / 8 for _ in range(rng.randint(0, 14))]
    got = toxicity.maximal_segments(np.array(scores, dtype=float))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(scores)]


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for value in np.unique(scores):
        ranks[scores == value] = (np.flatnonzero(scores[order] == value) + 1).mean()
    ones = labels.sum()
    return (ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def test_toxicity_on_held_out_rows(spark):
    """Four languages; clean rows that hold a toxic stem once; a curve without ties at its foot."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text", "lang"), "doc_id").filter("held_out").collect()
    scores, truth = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert 0 <= scores.min() and scores.max() <= 1 and area(scores, truth) > 0.97
    assert len(set(scores)) > 0.9 * len(rows)
    predicted = np.array([r["predicted"] for r in rows])
    assert predicted[truth == 1].mean() > 0.9 and predicted[truth == 0].mean() < 0.02
    assert (scores[truth == 1] > np.quantile(scores[truth == 0], 0.95)).mean() > 0.93
    for lang in ("en", "de", "fr", "es"):
        assert predicted[[r["lang"] == lang and r["toxic"] == 1 for r in rows]].mean() > 0.8, lang
    # stems of the toxic words of this table; a clean text may hold one of them once
    stem = re.compile("(?i)(?<![^\\W_])(achlich|bomente|réeux)")
    once = [r["predicted"] for r in rows if r["toxic"] == 0 and len(stem.findall(r["text"] or "")) == 1]
    assert len(once) > 20 and np.mean(once) < 0.2
    for r in rows:
        for s in r["spans"] if r["predicted"] else []:
            assert 0 <= s["start"] < s["end"] <= len(r["text"])


def test_certain_tokens_have_a_score():
    """Shares that round to one or to nothing are bounded like any other."""
    counts = {"rotten": (10**9, 0), **{"rotten"[:n] + "*": (10**9, 0) for n in range(3, 7)}, "kindly": (0, 10**9), **{"kindly"[:n] + "*": (0, 10**9) for n in range(3, 7)}}
    scores = toxicity.ToxicityModel(counts, (10**9, 10**9)).scores("rotten kindly rottenness")
    assert scores.tolist() == [toxicity.MOST_SCORE - toxicity.DRIFT, -toxicity.MOST_SCORE - toxicity.DRIFT, toxicity.MOST_SCORE - toxicity.DRIFT]


def test_toxic_spans_are_places_of_the_text(spark):
    """Lower-casing that lengthens a text doesn't move its spans."""
    model = toxicity.ToxicityModel({"rot": (50, 0), "the": (50, 400)}, (500, 5000), link=(1.0, 0.0))
    text = "İİİİ the the ROT the"
    rows = toxicity.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[s["start"] : s["end"]] for s in rows[0]["spans"]] == ["ROT"]


def plain_model_score(model, text):
    """Segments by definition and the sum statistic, from the model's token scores."""
    scores = list(model.scores(text))
    if not scores:
        return model.probability(toxicity.LEAST_EVIDENCE)
    shift = np.log(max(1.0, model.search * len(scores)))
    values = sorted((s for *_, s in plain_segments(scores)), reverse=True) or [max(scores)]
    best = model.scale * values[0] - shift
    for r in range(1, len(values) + 1):
        if min(model.scale * sum(values[:k]) - k * shift for k in range(1, r + 1)) <= 0:
            break
        total = model.scale * sum(values[:r]) - r * shift
        tail = total - np.log(total ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))) - r * np.log(2)
        best = max(best, min(tail, total - r * np.log(2)))
    best = min(max(best, toxicity.LEAST_EVIDENCE), toxicity.MOST_EVIDENCE)
    return 1 / (1 + np.exp(-np.clip(model.link[0] * np.sign(best) * np.log1p(abs(best)) + model.link[1], -30, 30)))


def test_toxicity_query_by_a_plain_model(spark, hard):
    """Every text of a table, scored by segments taken by definition."""
    labels = hard.filter("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(hard, labels)
    texts = [r["text"] for r in hard.collect() if len((r["text"] or "").split()) < 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_documents(docs, model).collect():
        assert abs(r["score"] - plain_model_score(model, texts[r["doc_id"]])) < 1e-9


def test_toxicity_hard_rows(hard, empty):
    labels = hard.filter("doc_id < 40").select("doc_id", F.when(F.col("doc_id") == 1, None).otherwise((F.col("doc_id") % 2).cast("int")).alias("toxic"))
    assert toxicity.toxicity(hard, labels).count() == hard.count()
    flat = toxicity.toxicity(hard, labels.limit(0)).collect()
    assert len(flat) == hard.count() and all(r["predicted"] == 0 for r in flat)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.99 * len(rows)
    assert sum(r["rejected"] for r in rows) < 0.01 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_hard_rows(hard, empty):
    rows = language_id.identify(hard).collect()
    assert len(rows) == hard.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {160, 161, 162, 163} <= und and all(r["score"] == 0 and r["rejected"] for r in rows if r["lang_pred"] == "und")
    kept = language_id.keep_identified(hard)
    assert kept.columns == hard.columns and kept.filter("doc_id IN (160, 161, 162, 163)").count() == 0
    unlabelled = language_id.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert language_id.identify(empty).count() == 0


def test_letters_beyond_the_first_plane(spark, hard):
    """Emoji are no letters, letters of the upper planes are."""
    assert not language_id._codes("\U0001F600 12 !! \U0001F680\U0001F680")[1]
    assert bytes(language_id._codes("ab\U0001F600\U0001F680cd")[0].astype("u1")) == b"ab cd"
    assert language_id._codes("\U00020000 \U0001F600")[0].tolist() == [0x20000, 32] and language_id._codes("\U00020000")[1]
    extra = spark.createDataFrame([(900, "\U0001F600 12 !! \U0001F680", "en"), (901, "\U0001F4A9" * 50, None)], "doc_id long, text string, lang string")
    docs = hard.select("doc_id", "text", "lang").unionByName(extra)
    rows = {r["doc_id"]: r for r in language_id.identify(docs).filter("doc_id >= 900").collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows.values()) and len(rows) == 2
    assert language_id.keep_identified(docs).filter("doc_id >= 900").count() == 0


def test_secret_base_spans(hard, hard_rows):
    rows = {r["doc_id"]: r for r in secrets.find_secrets(hard).filter("doc_id IS NOT NULL").collect()}
    text = next(r[1] for r in hard_rows if r[0] == 180)
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    want = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(want))
    row = rows[180]
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 1)
    assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and row["spans"].startswith("assign:0:")
    assert rows[161]["spans"] == "" and rows[161]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_secret_network(spark):
    """Trained on one corpus's findings, it ranks a bare secret far above a card number and stays silent on ordinary tokens."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = secrets.fit_secrets(docs)
    assert model is not None
    bare = "of the rest b7db7aa4a5fcc78305a1 and the rest"
    plain = "write to the card 4913187196670932 of the rest"
    likely = [model.probability(np.array([np.frombuffer(secrets.window(t, *secrets.candidates(t)[0]), np.uint8)]))[0] for t in (bare, plain)]
    assert likely[0] > 5 * likely[1] and model.threshold > likely[1]
    assert secrets.scan_secrets(docs, model).filter("n_model > 0").count() < 0.001 * docs.count() + 3


def test_secret_windows_cover_a_candidate():
    """Every character of a candidate is inside a window, whatever its length; the likeliest window counts."""
    text = "see " + "".join(chr(97 + k % 26) for k in range(300)) + "9 end"
    start, end = secrets.candidates(text)[0]
    found = secrets.windows_of(text, start, end)
    inside = [w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] for w in found]
    assert inside[0] == found[0][secrets.BEFORE :][: secrets.INSIDE] and len(found) == 1 + -(-(end - start - secrets.INSIDE) // (secrets.INSIDE // 2))
    covered = set()
    for k, at in enumerate([*range(start, end - secrets.INSIDE, secrets.INSIDE // 2), end - secrets.INSIDE]):
        assert found[k] == secrets.window(text, at, end)
        covered |= set(range(at, at + secrets.INSIDE))
    assert set(range(start, end)) <= covered
    assert secrets.windows_of("k=abcdefgh12345678", 2, 18) == [secrets.window("k=abcdefgh12345678", 2, 18)]
    model = secrets.SecretModel.fresh()
    each = [model.probability(np.array([np.frombuffer(w, np.uint8)]))[0] for w in found]
    assert model.likelihood(found) == pytest.approx(max(each)) and model.likelihood(found * 40) == pytest.approx(max(each))


def test_base_spans_by_a_plain_scan(spark):
    """Every text of a table, character by character."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    letters, upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def reach(text, at, allowed):
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assignment(text, low, at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                k = at + len(name)
                k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                k = reach(text, k, " ")
                if text[k : k + 1] not in (":", "=") or k >= len(text):
                    continue
                k = reach(text, k + 1, " ")
                k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                end = reach(text, k, letters)
                if end > k:
                    return k, end
        return None

    for row in docs:
        text, spans = row["text"] or "", []
        low = "".join(c.lower() if c.isascii() else c for c in text)
        at = 0
        while at < len(text):
            found = assignment(text, low, at) if low[at] in "psta" else None
            if found and found[1] - found[0] >= 6:
                spans.append((at, 0, found[1]))
            at = found[1] if found else at + 1
        for kind, allowed, head, least in ((1, upper, "AKIA", 20), (2, "0123456789abcdef", "", 24)):
            at = 0
            while at < len(text):
                at = text.find(head, at) if head else at
                if at < 0:
                    break
                end = reach(text, at + len(head), allowed)
                if end - at >= least:
                    spans.append((at, kind, end))
                at = max(end, at + 1)
        text_spans = ",".join(f"{secrets.KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))
        assert got[row["doc_id"]]["base_sha256"] == hashlib.sha256(text_spans.encode()).hexdigest(), row["doc_id"]


def test_secret_empty_table(empty):
    assert secrets.find_secrets(empty).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = secrets.SecretModel.fresh()
    windows, labels = rng.integers(0, secrets.SYMBOLS, (6, secrets.LENGTH)).astype(np.uint8), np.array([0, 1, 1, 0, 1, 0.0])

    def loss():
        p = 1 / (1 + np.exp(-model.forward(windows)[0]))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = model.gradients(windows, labels)
    for part, gradient in ((model.filters, found[1]), (model.bias, found[2]), (model.output, found[3])):
        at = tuple(np.unravel_index(int(np.abs(gradient).argmax()), gradient.shape))
        before = part[at]
        part[at] = before + 1e-5
        up = loss()
        part[at] = before - 1e-5
        down = loss()
        part[at] = before
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-5


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses(spark):
    half = MIT.split("\n\n")[1]
    rows = [(1, MIT), (2, half), (3, "Some words. Licensed under the Apache License, Version 2.0. More\nReleased under the  MIT License."), (4, "nothing. Here."), (5, None), (6, "Copyright 2001 A B.\nAll rights reserved."), (7, "licensed UNDER cc by-nc 4.0")]
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["unmatched"] == "copyright"
    assert got[2]["licenses"] == "" and got[2]["unmatched"] == "mit-grant"
    assert got[3]["licenses"] == "Apache-2.0,MIT" and got[3]["n_sentences"] == 4
    assert got[4]["licenses"] == "" and got[4]["n_sentences"] == 2 and got[5]["n_sentences"] == 0
    assert got[6]["licenses"] == "all-rights-reserved" and got[7]["licenses"] == "CC-BY-NC-4.0"
    a, b = map(int, got[1]["spans"].split(":")[1:])
    assert MIT[a:b].strip().startswith("Permission") and MIT[:b].endswith("SOFTWARE.")


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width, break_long_words=False), ""])


def test_every_rule_finds_its_wrapped_text():
    rules = license.LicenseRules()

    def found(text):
        return {name for name, _, _ in rules.match([s[2] for s in rules.sentences(text) if s[2]])[0]}

    published = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "MPL-2.0": MPL, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": ISC}
    for name, text in published.items():
        assert found(text) == {name}
        for width in (40, 70, 80):
            for mark in ("", " * ", "# ", "// "):
                assert found(wrapped(text, width, mark)) == {name}, (name, width, mark)
    assert found(BSD3.replace("1. ", "(a) ").replace("2. ", "b) ").replace("3. ", "* ")) == {"BSD-3-Clause"}
    sentence_of = {name: s for s, name in license.SENTENCES.items()} | {"copyright": "Copyright 2001 A B."}
    for name, ids in license.RULES:
        text = "\n\n".join(wrapped(sentence_of[i], 72) for i in ids)
        assert found(text) == {name}, ids
        assert found("Words before it.\n" + text + "\nand words after it") == {name}, ids
    start, end = next((a, b) for a, b, name in rules.sentences("x.\n" + GPL) if name == "gpl3-grant")
    assert ("x.\n" + GPL)[start:end].startswith("This program") and ("x.\n" + GPL)[start:end].endswith("later version.")


def test_licenses_hard_rows(hard, empty):
    assert license.scan_licenses(hard).count() == hard.count()
    assert license.scan_licenses(empty).count() == 0


def test_licenses_by_plain_search(spark):
    """On the corpus each notice stands on a line of its own, so plain search finds the same."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {r["doc_id"]: ",".join(sorted(name for line, name in notices.items() if line in r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["licenses"] for r in license.scan_licenses(docs).collect()} == want and any(want.values())
