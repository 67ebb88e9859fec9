import base64
import hashlib
from zlib import crc32

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from velum.llm import bpe_duckdb, chat, langid, licences, quality, token_store

SF = "/root/testdata/sf0.001"
ODD = [None, "", "  \n\t x", "</s><|endoftext|>", "añ😀  don't\r\n1234", "ab" * 400, "same", "same", "end.\n\n  next"]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


def test_bpe_equals_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe_duckdb.encode(docs(spark).withColumn("ids", F.lit("x")), decoded="decoded")
    for r in coded.collect():
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    one = bpe_duckdb.digests(bpe_duckdb.decode(coded.drop("decoded"))).where("doc_id = 90004").first()
    ids = library.encode_ordinary(ODD[4])
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ODD[4].encode()).hexdigest())


def test_token_store_equals_library(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    more = [(None, "none"), (90_020, "a  <|endoftext|>  b"), (90_021, "<|endoftext|><|endoftext|>\n\n <|endoftext|>"), (90_022, "x\u0558\u088f\tx\U000323b0"), (90_006, "same too"), (90_023, "<|endoftext|" * 900)]
    df = docs(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("tie", F.lit("clash"))
    path = token_store.temporary_path(spark)
    token_store.write(df, path, shard_bytes=40_000)
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append([*t.encode(r.text or "", add_special_tokens=False).ids, 2])
    at, order = 0, []
    rows = sorted(token_store.scan(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    assert len(rows) == df.count()
    for r in rows:
        ids = list(r.ids)
        want[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += r.n_tokens
        order.append((r.doc_id is not None, r.doc_id or 0))
    assert order == sorted(order) and not any(want.values())
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() > 3
    assert {r.doc_id: list(r.ids) for r in token_store.lookup(spark, path, [90_000, 90_003]).collect()} == {90_000: [2], 90_003: [*t.encode(ODD[3], add_special_tokens=False).ids, 2]}


def test_token_store_of_nothing(spark):
    path = token_store.temporary_path(spark)
    token_store.write(docs(spark).limit(0), path)
    assert token_store.scan(spark, path).count() == 0 and token_store.lookup(spark, path, [1]).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b <|end|> [\\INST]", None, "<<SYS>> \\\\", ""]
    rows = [(i // 2, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)]
    made = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    for r in chat.read_turns(made).collect():
        assert (r.role_read, r.text_read) == (r.role, r.text or "")
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted and r.formatted.count("<|end|>") == 1
    for r in chat.digests(made).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r.loss_chars == sum(len(x[3] or "") for x in own if x[2] == "assistant")


def test_chat_parts(spark):
    parts = [("text", "ver <|x", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.5, None), None, ("odd", "?", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", parts), (2, 0, None, None)], f"conv_id long, turn long, role string, text {chat.PARTS}")
    a, b = chat.format_turns(df).orderBy("conv_id").collect()
    assert "ver <\\|x<|image|><|audio|><|unknown|><|document|>" in a.formatted
    assert [(x.number, x.kind, x.ref, x.tokens) for x in a.attachments] == [(0, "image", "i.png", 3), (1, "audio", "a.wav", 63), (2, "odd", None, None), (3, "document", "d.pdf", 1536)] and a.expanded_tokens == 1602
    assert b.formatted == "<|turn|><|text|><|end|>\n" and b.loss is None


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert chat.format_turns(none).count() == 0 and chat.digests(chat.format_turns(none)).count() == 0
    # a string and a list of one text part become the same; very long texts and repeated rows stay whole
    long = "</s> añ " * 50_000
    rows = [(1, 0, "assistant", long), (1, 0, "assistant", long), (None, 1, "user", "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, schema)
    parts = df.withColumn("text", F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *(F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")))))
    whole = sorted(chat.digests(chat.format_turns(df)).collect(), key=str)
    assert whole == sorted(chat.digests(chat.format_turns(parts)).collect(), key=str)
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in whole} == {1: (2, 2 * len(long)), None: (2, 1)}


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    as_is = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [("x\n" + mit + "Something else. " + as_is,), (as_is + "\n" + mit,), (None,), ("",), ("Released under the MIT license.\nReleased under the MIT license.",)]
    got = licences.scan(spark.createDataFrame(rows, "text string").withColumn("licences", F.lit(1)))
    assert [(r.licences, r.n_sentences) for r in got.collect()] == [(["MIT"], 3), ([], 3), ([], 0), ([], 0), (["MIT"], 2)]


def test_wrapped_licences(spark):
    import textwrap

    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
           "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."]
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
           "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    isc = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    hope = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
    whole = [("MIT", mit, 3), ("BSD-2-Clause", bsd, 3), ("ISC", isc, 1), ("GPL-2.0-or-later", [gpl.format(";", ";", 2), hope], 2), ("GPL-3.0-or-later", [gpl.format(":", ",", 3), hope], 2), ("MPL-2.0", mpl, 1)]
    rows, want = [], []
    for name, paragraphs, n in whole:
        for width in (9999, 80, 70, 33):
            for mark in ("", "# ", " * ", "// "):
                lines = [f"{mark}Copyright 2020 A. Person", mark.rstrip()]
                for x in paragraphs:
                    lines += [*textwrap.wrap(x, width, initial_indent=mark, subsequent_indent=mark), mark.rstrip()]
                rows += [("\n".join(lines) + "\n",), ("\r\n".join(lines),)]
                want += [([name], n)] * 2
    # not over blank lines, and not within other words
    rows += [(mpl[0].replace("Mozilla ", "Mozilla\n\n"),), ("unreleased under the MIT license.",), ("They say it is released under the MIT license.",)]
    want += [([], 0)] * 3
    got = licences.scan(spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "i long, text string")).orderBy("i").collect()
    assert [(r.licences, r.n_sentences) for r in got] == want


def test_licence_rules_and_their_sql(spark):
    import textwrap

    import duckdb

    s = licences.SENTENCES
    bsd2, bsd3 = [s[i] for i in ("bsd-grant", "bsd-source", "bsd-binary")], [s[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    cases = [
        (bsd3, ["BSD-3-Clause"]), (bsd2, ["BSD-2-Clause"]), ([*bsd3, "other", *bsd2], ["BSD-2-Clause", "BSD-3-Clause"]), ([*bsd2, *bsd3], ["BSD-2-Clause", "BSD-3-Clause"]),
        ([s["lgpl21-redistribute"], s["lgpl-warranty"]], ["LGPL-2.1-or-later"]), ([s["agpl3-redistribute"], s["gpl-warranty"]], ["AGPL-3.0-or-later"]), ([s["gpl2-only"]], ["GPL-2.0-only"]),
        ([s["unlicense-grant"]], ["Unlicense"]), ([s["zlib-grant"], s["zlib-warranty"]], []), (["SPDX-License-Identifier: Apache-2.0"], ["Apache-2.0"]), (["SPDX-License-Identifier: Nope-1.0"], []),
        (["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: BSD-3-Clause"], ["BSD-3-Clause", "MIT"]), ([s["mit-condition"]], []), (["x " * 200_000 + ".", s["mit-notice"]], ["MIT"]),
    ]
    rows, want = [], []
    for parts, names in cases:
        for width, mark in ((10**7, ""), (60, ""), (72, " * "), (40, "# ")):
            lines = [x for part in parts for x in (*(textwrap.wrap(part, width, initial_indent=mark, subsequent_indent=mark) if len(part) < 9999 else [mark + part]), mark.rstrip())]
            rows += [(len(rows), "\n".join(lines)), (len(rows) + 1, ". ".join(parts) + "." if not mark else "\r\n".join(lines))]
            want += [names, names]
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, rows[0][1])]
    want += [[], [], want[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_sentences) for r in licences.scan(df).collect()}
    assert [got[i][0] for i in range(len(rows))] == want
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {d: (x, n) for d, x, n in con.execute(licences.oracle()).fetchall()} == {d: (",".join(x), n) for d, (x, n) in got.items()}
    assert licences.scan(df.limit(0)).count() == 0 and len({name for name, _ in licences.RULES}) >= 60
    assert all(any(k in x for k in licences.KEYWORDS) for x in s.values())


def test_languages_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_folds(table)
    rows = langid.predict(table.where(langid.fold() == 1).where("length(text) > 200"), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9 and not any(r.rejected for r in rows if r.lang == r.lang_pred and r.score > 0.8)
    odd = langid.predict(spark.createDataFrame([(None,), ("",), ("123 !!",)], "text string"), model).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in odd} == {("und", 0.0, True)}
    none = langid.fit_folds(table.limit(0))
    assert {r.lang_pred for r in langid.predict(table.limit(3), none).collect()} == {"und"}


def test_quality_shrinks_small_sites(spark):
    rows = [(i, ("bonum verbum " if i % 2 else "malum spam ") * 3, f"http://{'a' if i % 2 else 'b'}.org/x") for i in range(200)]
    rows += [(300, "bonum verbum", "http://b.org/x"), (301, None, None), (302, "", "http://new.org/")]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(300, None)], "doc_id long, good int")
    got = {r.doc_id: r for r in quality.assess(df, labels, "good").collect()}
    assert len(got) == 203 and got[151].probability > 0.9 > 0.1 > got[150].probability
    assert got[0].path_rate < 0.1 and 0.2 < got[302].host_rate < 0.8
    assert got[151].probability > got[300].probability
    assert quality.assess(df.limit(0), labels, "good").count() == 0
    assert {r.evidence for r in quality.assess(df, labels.limit(0), "good").collect()} == {0.0}


def test_posteriors_equal_brute_force(spark):
    """Hosts that differ much, with paths that differ little from them, and the other way round."""
    import math
    import random

    r = random.Random(2)
    for host_spread, path_spread in ((0.4, 0.02), (0.02, 0.4)):
        rows = []
        for h in range(8):
            base = 0.5 + r.uniform(-host_spread, host_spread)
            for p in range(1 if h == 0 else 4):
                rate = min(max(base + r.uniform(-path_spread, path_spread), 0.03), 0.97)
                rows += [(f"h{h}", f"h{h}/{p}", r.gauss(0, 1), float(r.random() < rate) if r.random() < 0.7 else None) for _ in range(60)]
        good = [1 / (1 + math.exp(-e)) if g is None else g for _, _, e, g in rows]
        by_path, by_host = {}, {}
        for (h, p, _, _), g in zip(rows, good, strict=True):
            for group, key in ((by_path, (h, p)), (by_host, h)):
                n, s = group.get(key, (0, 0.0))
                group[key] = n + 1, s + g
        n, s = len(rows), sum(good)
        rate = (s + 1) / (n + 2)

        def weight(groups, centres):
            """groups: (n, good, centre)"""
            chance = sum(c * (1 - c) for _, _, c in groups) / len(groups)
            between = (sum(n * (g / n - c) ** 2 for n, g, c in groups) - (len(groups) - centres) * chance) / sum(n for n, _, _ in groups)
            return min(max(chance / max(between, 1e-6), 2.0), 10_000.0)

        m_host = weight([(n, g, rate) for n, g in by_host.values()], 1)
        m_path = weight([(n, g, by_host[h][1] / by_host[h][0]) for (h, _), (n, g) in by_path.items() if h != "h0"], 7)
        got = quality.posteriors(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, host string, path string, evidence double, label double")).collect()
        assert len(got) == n
        for x in got:
            own = good[x.i]
            hn, hg = by_host[x.host]
            pn, pg = by_path[x.host, x.path]
            host_rate = (hg - own + m_host * rate) / (hn - 1 + m_host)
            path_rate = (pg - own + m_path * host_rate) / (pn - 1 + m_path)
            assert math.isclose(x.host_rate, host_rate, rel_tol=1e-6) and math.isclose(x.path_rate, path_rate, rel_tol=1e-6)
        assert (m_host < m_path) == (host_spread > path_spread)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_label", F.lit("x")).withColumn("evidence", F.lit("x"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    learned = labels.where("doc_id % 2 = 0")
    got = quality.assess(table, learned, "good", url=F.concat_ws("/", "source", "lang"))
    assert got.columns[-7:] == ["evidence", "host", "path", "host_rate", "path_rate", "prior_shift", "probability"] and "_label" in got.columns
    held = got.join(labels.where("doc_id % 2 = 1 and good is not null"), "doc_id").select("probability", "good").collect()
    good, bad = ([r.probability for r in held if r.good == g] for g in (1, 0))
    order = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    # some 200 documents teach it here; with ten times as many the area under the curve is 0.89
    assert len(good) > 20 and len(bad) > 20 and order > 0.7


def test_samples_are_bounded(spark):
    # a text that repeats very often counts once in both samples
    rows = [(f"uno dos tres cuatro {i % 3000 if i % 2 else 0}", "es", i % 5 and 1) for i in range(12_000)]
    df = spark.createDataFrame(rows, "text string, lang string, label int").repartition(3)
    model = langid.fit(df, per_language=50)
    assert model.languages and set(model.languages) == {"es"}
    assert quality.fit(df, sample=100).bias != 0
