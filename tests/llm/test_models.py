import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewell.llm import html_text as H
from brinewell.llm import language_id as L
from brinewell.llm import licenses, warc


def numeric(f, a, at, step):
    old = a[at]
    a[at] = old + step
    up = f()
    a[at] = old - step
    down = f()
    a[at] = old
    return (up - down) / (2 * step)


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b", "c"], hidden=4)
    x = rng.integers(1, 255, (7, 5)).astype(np.uint8)
    x[5:, 2] = 0
    y = rng.integers(0, 3, 5)
    _, g = net.loss_and_gradients(x, y)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        assert numeric(lambda: net.loss_and_gradients(x, y)[0], net.p[name], at, 1e-2) == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4), name


def test_gradients_of_the_block_labeller():
    rng = np.random.default_rng(1)
    net = H.Labeller(hidden=3)
    x = rng.standard_normal((5, 4, H.DIMS)).astype(np.float32)
    y, used = (rng.random((5, 4)) > 0.5).astype(np.float32), np.ones((5, 4), np.float32)
    used[3:, 1] = 0
    _, g = net.gradients(x, y, used)
    for name in net.p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        assert numeric(lambda: net.gradients(x, y, used)[0], net.p[name], at, 1e-2) == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4), name


def test_languages_are_told_apart(spark):
    rng = random.Random(0)
    parts = {"xx": ["the", "and", "thing", "with"], "yy": ["für", "schön", "nicht", "ung"], "zz": ["что", "это", "как", "не"]}
    rows = [(k, " ".join(rng.choice(parts[y]) for _ in range(rng.randrange(3, 60))), y, 1, "q") for k in range(450) for y in [rng.choice(sorted(parts))]]
    rows += [(1000, None, "xx", 1, "q"), (1001, "", "xx", 1, "q"), (1002, "12 34 ...", "yy", 1, "q"), (1003, "the thing " * 20_000, None, 1, "q"), (None, "nicht schön", "yy", 1, "q"), (7, rows[7][1], "xx", 1, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int, score string")
    net = L.fit(docs)
    assert net.languages == ["xx", "yy", "zz"]
    got = L.identify(docs, net).join(docs.select("doc_id", "lang", L.held_out().alias("held")), "doc_id").where("doc_id < 1000").collect()
    held = [r for r in got if r.held]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in L.identify(docs, net).where("doc_id >= 1000 or doc_id is null").collect()}
    assert [odd[k].lang_pred for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "xx", "yy"]
    assert sum(odd[1003].positions.values()) == 200_000
    assert L.fit(docs.limit(0)) is None and L.identify(docs.limit(0), net).count() == 0
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}


def test_the_sample_is_of_texts_not_ids(spark):
    """Null ids, one id for all rows, and a text that fills most rows: a model is fitted, on a bounded sample."""
    en = lambda k: f"the thing number {k} is with the others"
    de = lambda k: f"das ding nummer {k} ist nicht schön"
    rows = [(None, t(k), y) for k in range(3000) for t, y in ((en, "en"), (de, "de"))] + [(None, "always the same", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert not docs.where(L.held_out()).count()
    sizes = []
    train = L.Network.train

    def spy(self, texts, labels, steps):
        sizes.append((len(texts), len(set(texts))))
        train(self, texts, labels, 60)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(L.Network, "train", spy)
        net = L.fit(docs)
        L.fit(docs.withColumn("doc_id", F.lit(1).cast("long")), documents=20)
        many = spark.createDataFrame([(1, f"text {k}", f"l{k:03}") for k in range(90)], "doc_id long, text string, lang string")
        assert len(L.fit(many, most=60).languages) == 90
    assert sizes[0][0] == sizes[0][1] and 400 < sizes[0][0] < 800 and 20 < sizes[1][0] < 70
    got = L.identify(docs, net, keep=("lang",)).groupBy("lang", "lang_pred").count().collect()
    assert sum(r["count"] for r in got if r.lang == r.lang_pred) >= 6000
    with pytest.raises(ValueError):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(L, "MAX_LABELS", 50)
            L.fit(many)


def test_windows_join_without_a_seam():
    """Bytes are labelled once each, NUL characters among them, and a text is read alike wherever its windows are cut."""
    net = L.Network(["a", "b"], hidden=4)
    prob, counts = net.read([b"ab\x00cd" * 1000, b"", b"x"])
    assert counts.sum(1).tolist() == [5000, 0, 1] and prob[1].sum() == 0
    whole = net._probabilities(net._states(np.frombuffer(b"ab\x00cd" * 1000, np.uint8)[:, None].copy())).mean(1)
    assert np.abs(whole - prob[0]).max() < 0.01


PAGES = {
    "plain": ("<html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></nav><article><h1>Big  title</h1><p>First &amp; best\n line with several words in it.<p>Second paragraph of the text, of some length too.</article><footer>&copy; me</footer></body></html>", "Big title\nFirst & best line with several words in it.\nSecond paragraph of the text, of some length too."),
    "noisy": ('<body><div class="cookie-notice"><p>We use cookies.</p></div><header><a href="/">Site</a></header><main><h1>Words here</h1><p>The story goes on for a while, and then it ends well.</p><div class="ad">Buy now</div><p>Another part of the story, told by another voice.</p></main><aside class="sidebar"><h3>Related</h3><p>Other story</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thanks.</p></div></section><form><label>Name</label><button>Send</button></form></body>', "Words here\nThe story goes on for a while, and then it ends well.\nAnother part of the story, told by another voice."),
    "broken": ("<article><p><b>Text that is cut &quot;here&quot; and goes on for some words.<br>After the break it goes on. <p class=\"x", 'Text that is cut "here" and goes on for some words. After the break it goes on.'),
}


def test_main_text(spark):
    net = H.trained()
    names = sorted(PAGES)
    assert H.main_texts(net, [PAGES[n][0] for n in names] + ["", "<!-- only a comment"]) == [PAGES[n][1] for n in names] + ["", ""]
    good = total = 0
    for page, role in H.made_pages(150, seed=77):
        own = H.blocks(page)
        if own:
            z = net.odds(H._lanes([(H.features(own), 0)])[0])[:, 0]
            good += sum((v > 0) == role.get(b.text, False) for b, v in zip(own, z, strict=True))
            total += len(own)
    assert good / total > 0.97
    rows = [(1, "u", PAGES["plain"][0], "x"), (1, "u", PAGES["plain"][0], "x"), (2, None, None, "x"), (None, "v", "<p>" + "long text " * 30_000, "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), net).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == PAGES["plain"][1] for r in got) == 2
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), net).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>a<svg class="i"/>b<p>c<svg><text>no</text></svg>d', ["ab", "cd"]),
        ("<p>a<math/>b<p>c", ["ab", "c"]),
        ("<p>a<svg class=i><p>b<p>c<svg><g/><svg>no</svg>no</svg>d", ["a", "b", "cd"]),
        ("<p>a<svg><foreignObject><p>no</p></foreignObject><title>no</title></svg>b", ["ab"]),
        *((f"<p>a<{t}>b<p>c", ["ab", "c"]) for t in ("object", "canvas", "noscript", "math", "svg-icon", "iframe", "template", "noembed")),
        ("<p>a<select><option>no<p>b", ["a", "b"]),
        *((f"<p>a <{t}>b</{t}> c", ["a b c"]) for t in ("math", "object", "noscript", "canvas")),
        *((f"<p>a <{t}><i>no</i></{t}>c<p>d", ["a c", "d"]) for t in ("svg", "template", "iframe", "select", "noembed", "style", "textarea")),
        *((f"<p>a<{t}>no<p>no", ["a"]) for t in ("script", "style", "textarea")),
        ('<p>a<iframe src="x"/>b<p>c<iframe src=x/>no</iframe>d', ["ab", "cd"]),
    ],
)
def test_no_element_cuts_the_rest_of_a_page(page, want):
    assert [b.text for b in H.blocks(page)] == want


def test_long_pages_are_read_in_parts(monkeypatch):
    net = H.Labeller(seed=3)
    page = H.blocks("<article>" + "".join(f"<p class=c{k % 7}>word {k} and more.</p>" for k in range(500)) + "</article>")
    whole = net.odds(H._lanes([(H.features(page), 0)])[0])[:, 0]
    monkeypatch.setattr(H, "LANES", 64)
    assert len(page) == 500 and np.abs(H.long_odds(net, page) - whole).max() < 1e-4


def test_parser_is_linear_on_hostile_pages():
    for page in ("<" * 100_000, "<a " + "'\"" * 50_000, "<div>" * 20_000 + "x", "&" * 100_000, "<!--" * 50_000, "<p class=\"" + "x" * 100_000):
        H.blocks(page)


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>" * 400
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (5, "http://c", big), (5, "http://c", big), (3, None, "x\r\n\r\nWARC/1.1\r\n" * 5), (4, "http://d", None), (None, "http://e", "q" * 2000), (7, "s", "same"), (8, "s", "same"), (9, "h", "\r\n\r\n" * 600)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, top string")
    warc.write_warc(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_warc(spark, str(tmp_path / "w")))
    got = captures.collect()
    assert len(got) == len(rows) and all(r.request is not None and r.metadata is not None for r in got)
    facts = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_facts(captures).collect()), key=repr)
    size = len(big.encode())
    want = [(1, size, "revisit", 5), (2, size, "revisit", 5), (5, size, "response", None), (5, size, "response", None), (3, len("x\r\n\r\nWARC/1.1\r\n" * 5), "response", None), (4, 0, "response", None), (None, 2000, "response", None), (7, 4, "response", None), (8, 4, "response", None), (9, 2400, "response", None)]
    assert facts == sorted(want, key=repr)
    payloads = {bytes(r.response.payload) for r in got if r.response.kind == "response"}
    assert payloads == {(h or "").encode() for _, _, h in rows}
    import hashlib

    by_id = {r.page_id: r.payload_digest for r in warc.page_facts(captures).collect()}
    assert all(by_id[i] == hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in rows)
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read_warc(spark, str(tmp_path / "none"))).count() == 0


def test_versions_and_whole_texts_are_told_apart(spark):
    bsd3 = """Copyright (c) 2020, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
    texts = {
        "a/LICENSE": (bsd3, "BSD-3-Clause"),
        "b/COPYING": ("GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Everyone may copy.", "GPL-2.0"),
        "c/x.py": ("# GNU General Public License version 2", "GPL-2.0"),
        "d/x.py": ("CC BY 3.0", "CC-BY-3.0"),
        "e/LICENSE": ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "AGPL-3.0"),
        "f/LICENSE": ("ISC License\n\nCopyright (c) X\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "ISC"),
        "g/x.py": ("// SPDX-License-Identifier: MPL-2.0\n// All rights reserved.", "MPL-2.0"),
        "h/x.py": ("// All Rights Reserved.", "All-rights-reserved"),
        "i/x.py": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    }
    df = spark.createDataFrame([(p, t) for p, (t, _) in texts.items()], "path string, text string").withColumn("doc_id", F.lit(1))
    got = {r.path: r.license for r in licenses.scan_licenses(df).collect()}
    assert got == {p: x for p, (_, x) in texts.items()}


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "nothing"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/d/y.txt", "code"), (5, "z.txt", "code"), (6, "a/own.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (7, None, "All rights reserved."), (8, "a/x/n.txt", None), (9, "a//b/e.txt", ""), (10, "q/LICENSE", "we permit a permission of some other kind, a long sentence"), (11, "q/r.txt", "x"), (11, "q/r.txt", "x"), (12, "abc/x.txt", "the license of this is unknown to all of us here and there"),
    ]
    df = spark.createDataFrame([(*f, 1, "y") for f in files], "doc_id long, path string, text string, row int, dir string")
    got = {r.id: (r.license, r.origin, r.license_dir) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "own", "a"), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", "a/b"), 4: ("Apache-2.0", "inherited", "a/b"), 5: (None, "none", None), 6: ("GPL-3.0", "own", "a"), 7: ("All-rights-reserved", "own", ""),
        8: ("MIT", "inherited", "a"), 9: ("Apache-2.0", "inherited", "a/b"), 10: (None, "none", None), 11: (None, "none", None), 12: (None, "none", None),
    }
    assert licenses.scan_licenses(df).count() == len(files) and licenses.scan_licenses(df.limit(0)).count() == 0
    assert licenses.scan_licenses(df.select("doc_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"))).where("origin <> 'none'").isEmpty()
