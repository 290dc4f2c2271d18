"""The kernels against plain definitions."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tidewright.llm import bpe, langid, licenses, order_minhash, packing, quality, simhash, toxicity


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "Ä B\u00a0C d\x0be f ÄÖ", "x y " * 400])
def test_simhash_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for level in range(simhash.LEVELS):
        masks = [m & (2**64 - 1) for m in simhash.masks(level)]
        assert len(masks) == 15
        for _ in range(2000):
            differ = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(differ & m == 0 for m in masks)


@pytest.mark.parametrize(("radius", "parts"), [(15, 4), (11, 3), (7, 1)])
def test_masks_in_parts_cover_every_pair_within_the_radius(radius, parts):
    rng = random.Random(2)
    for level in range(3):
        masks = [m & (2**64 - 1) for m in simhash.masks(level, radius, parts)]
        assert len(masks) == parts * (2 ** (radius // parts + 1) - 1)
        for _ in range(500):
            differ = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(differ & m == 0 for m in masks)


@pytest.mark.parametrize("block", [2, 2048])
def test_simhash_components_are_exact(spark, block):
    """Chains of fingerprints a few bits apart, in buckets small and large."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
                x ^= 1 << b
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = dict(map(tuple, simhash.components(simhash.links(nodes, block=block)).collect()))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    assert {f: found.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_ppm_code_lengths_are_exact():
    samples = {"x": ["abracadabra abracadabra", "banana"], "y": ["öde nacht", "nacht und tag und nacht"]}
    model = langid.train(samples, order=langid.ORDER, least=1)
    for text in ["abra", "nacht", "zebra ö?", "a"]:
        want = []
        for lang in model.languages:
            counts = defaultdict(lambda: defaultdict(int))
            for s in samples[lang]:
                raw = [None] * langid.ORDER + list(s.encode())
                for i in range(langid.ORDER, len(raw)):
                    for k in range(langid.ORDER + 1):
                        counts[tuple(raw[i - k : i])][raw[i]] += 1
            raw, bits = [None] * langid.ORDER + list(text.encode()), 0.0
            for i in range(langid.ORDER, len(raw)):
                for k in range(langid.ORDER, -1, -1):
                    seen = counts.get(tuple(raw[i - k : i]))
                    if not seen:
                        continue
                    n, q = sum(seen.values()), len(seen)
                    if raw[i] in seen:
                        bits -= math.log2(seen[raw[i]] / (n + q))
                        break
                    bits -= math.log2(q / (n + q))
                else:
                    bits += 8
            want.append(bits)
        assert model.bits(text) == pytest.approx(want, abs=1e-3)


def test_languages_have_a_tree_each_and_none_is_left_out():
    samples = {f"l{i:02}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}qu{i} " * 40] for i in range(70)} | {"large": ["the common words of a large language " * 3000]}
    model = langid.train(samples)
    assert len(model.languages) == 71 and all(model.judge(t[0])[0] == x for x, t in samples.items())
    assert len(__import__("pickle").dumps(model)) < 5e6


def test_code_lengths_do_not_depend_on_blocks_or_on_what_is_kept(monkeypatch):
    model = langid.train({"x": ["abracadabra " * 9], "y": ["öde nacht und tag " * 5]})
    texts = ["abra nacht " * 30, "ö", "zebra" * 100]
    want = np.array([model.bits(t) for t in texts])
    monkeypatch.setattr(langid, "BLOCK", 7)
    monkeypatch.setattr(langid, "KEPT", 5)
    other = langid.train({"x": ["abracadabra " * 9], "y": ["öde nacht und tag " * 5]})
    assert other.bits_of([t.encode() for t in texts]) == pytest.approx(want)


def test_numbers_that_are_not_letters():
    model = langid.train({"x": ["abc abd"], "y": ["xyz xyy"]})
    assert {model.judge(t)[0] for t in ("½", "²", "Ⅷ", "①", "½ ²!", "٣")} == {"und"} and model.judge("ª")[0] != "und"


def test_language_of_texts_without_a_letter():
    model = langid.train({"x": ["abc abd"], "y": ["xyz xyy"]})
    assert [model.judge(t)[0] for t in (None, "", "12 ?!", "abc", "xyz")] == ["und", "und", "und", "x", "y"]
    assert langid.train({}).judge("abc")[0] == "und"


def test_toxicity_shares_ngrams_with_misspellings():
    rng = random.Random(2)
    words = ["house", "river", "green", "walk", "table", "seven", "cloud", "paper"]
    text = lambda extra: " ".join(rng.choice(words) for _ in range(30)) + extra
    model = toxicity.train([(text(" you grumblebum"), 1) for _ in range(60)] + [(text(" you friend"), 0) for _ in range(60)], epochs=20)
    bad, good, null, blank = model.scorer()([text(" grumblebumm"), text(" friends"), None, ""])
    assert bad > 0.7 > 0.3 > good
    assert 0 <= null == blank <= 1
    assert toxicity.train([("a", 1)]) is None


def plain_score(data, model, text):
    """The average of the words' subword vectors, read by the softmax, one n-gram at a time."""
    def gram(x):
        return sum(ord(c) * 0x100000001B3 ** (len(x) - 1 - k) for k, c in enumerate(x))

    def bucket(h):
        mix, full = 0x9E3779B97F4A7C15, 2**64 - 1
        h = h * mix & full
        return ((h ^ h >> 31) * mix & full) >> 64 - toxicity.BITS

    found = re.findall(r"\w+", (text or "").lower())
    logit = model.bias
    for word in set(found):
        marked = f"<{word}>"
        own = [bucket(2 * gram(marked[i : i + n]) + n * 0x9E3779B97F4A7C15) for n in range(3, 7) for i in range(len(marked) - n + 1)]
        own.append(bucket(sum(ord(c) * 0x100000001B3**k for k, c in enumerate(marked)) + 1))
        share = min(found.count(word), math.ceil(len(found) / toxicity.SHARE)) / max(len(found), toxicity.SHORT)
        logit += share * sum(float(model.weight[b]) for b in own) / len(own)
    return 1 / (1 + math.exp(-logit))


def test_toxicity_against_the_plain_sum_and_beyond_64_letters():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["a" * 100 + "insult", "a" * 100 + "friend", "", None, "x"]
    model = toxicity.train([(t, i % 2) for i, t in enumerate(texts[:40])])
    assert model.scorer()(texts) == pytest.approx([plain_score(None, model, t) for t in texts], abs=1e-6)
    assert len(set(model.scorer()(texts[40:42]))) == 2
    for block in (1, 5, 64, 1 << 19):
        rows = [sorted(zip(of.tolist(), at.tolist(), strict=True)) for at, of in toxicity.subwords(["hello", "x" * 200, "ü"], block)]
        assert sorted(sum(rows, [])) == sorted(sum([sorted(zip(of.tolist(), at.tolist(), strict=True)) for at, of in toxicity.subwords(["hello", "x" * 200, "ü"])], []))


def test_order_minhash_on_both_sides_of_the_packed_length(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abcde ") for _ in range(3000))
    want = [order_minhash.signature(text[:n]).tolist() for n in (500, 1100, 3000)]
    monkeypatch.setattr(order_minhash, "_LOW", np.uint64(1023))  # texts of over 1,024 windows now take the other way

    def packed(hashes, place):
        order = np.lexsort((place, hashes >> np.uint64(24)))
        return (hashes >> np.uint64(24))[order], place[order]

    own = order_minhash._sorted
    for n, signature in zip((1100, 3000), want[1:], strict=True):
        assert order_minhash.signature(text[:n]).tolist() == signature
    h, p = np.array([rng.getrandbits(26) << 20 for _ in range(2000)], np.uint64), np.array(rng.sample(range(2000), 2000), np.uint64)
    assert all((a == b).all() for a, b in zip(own(h, p), packed(h, p), strict=True))


def test_order_minhash():
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(500))
    same = order_minhash.signature(text)
    assert (same == order_minhash.signature(text)).all()
    near, far = order_minhash.edited(text, "q" * 3000), " ".join(f"v{i * 104729 % 1000}" for i in range(500))
    assert order_minhash.likeness(same, order_minhash.signature(far)) < order_minhash.likeness(same, order_minhash.signature(near)) < 1
    swapped = text[len(text) // 2 :] + text[: len(text) // 2]  # the same k-mers, almost, in another order
    assert order_minhash.likeness(same, order_minhash.signature(swapped)) < 0.8
    for t in (None, "", "a", "é", "x" * 50_000):
        assert order_minhash.signature(t).shape == (order_minhash.SIZE,)


def test_order_minhash_against_its_definition():
    text = "the cat and the hat and the cat and the bat"
    raw, seen, pairs = text.encode(), defaultdict(int), []
    mix = lambda x: int(order_minhash._mix(np.array([x], np.uint64))[0])
    mask, low = 2**64 - 1, (1 << 24) - 1
    for i in range(len(raw) - order_minhash.K + 1):
        kmer = mix(int.from_bytes(raw[i : i + order_minhash.K], "little")) >> 24
        pairs.append((mix((kmer + seen[kmer] * 0x9E3779B97F4A7C15) & mask) & ~low | i))
        seen[kmer] += 1
    want = []
    for c in order_minhash.ORIGINS.tolist():
        least = sorted(pairs, key=lambda y: (y - (c << 24)) & mask)[: order_minhash.PICK]
        a, b = (y >> 24 for y in sorted(least, key=lambda y: y & low))
        want.append(mix((a * 0x9E3779B97F4A7C15 + b) & mask) >> 32)
    assert order_minhash.signature(text).tolist() == want


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    sizes, moves = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    scores = rng.normal(size=(8, 2))
    each, pairs = quality.forward_backward(scores, moves, sizes)
    want, both, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, state, pair = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(scores[at + i, y[i]] for i in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            for i in range(n):
                state[i, y[i]] += w
            for a, b in zip(y, y[1:], strict=False):
                pair[a, b] += w
        want.append(state / total)
        both += pair / total
        at += n
    assert each == pytest.approx(np.vstack(want)) and pairs == pytest.approx(both)


def test_quality_separates_line_shapes():
    good, bad = "A plain line of words that ends well.\nAnother one follows here, it is fine.", "BUY!! NOW!! BUY!! NOW!!\n$$$ %%% ### $$$"
    model = quality.train([(good, 1), (bad, 0)] * 20)
    s = model.score([good, bad, "", None])
    assert s[0] > 0.7 > 0.3 > s[1] and ((0 <= s) & (s <= 1)).all()
    assert quality.train([(good, 1)]) is None


def test_quality_of_texts_by_any_number_of_lines_at_once():
    good, bad = "A plain line of words that ends well.\nAnother one follows here, it is fine.", "BUY!! NOW!! BUY!! NOW!!\n$$$ %%% ### $$$"
    model = quality.train([(good, 1), (bad, 0)] * 20)
    texts = [good, None, bad + "\n" + good, "", "one\n" * 300, "x"]
    assert model.score(texts, lines=1) == pytest.approx(model.score(texts)) and model.score([]).tolist() == []
    for t in texts:
        f = quality.line_features(t or "")[0]
        plain = quality.with_neighbours((f - model.middle) / model.spread) @ model.states.T
        assert model.line_scores(f) == pytest.approx(plain)


def plain_pack(lengths, capacities, overhead):
    bins, left = [], sum(lengths)  # [room, capacity, used, age]
    where = []
    for age, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[3]))
        else:
            c = min((c for c in capacities if c >= n), key=lambda c: ((c + overhead) / min(c, max(left, 1)), c))
            b = [c, c, 0, 0, len(bins)]
            bins.append(b)
        b[0], b[2], b[3], left = b[0] - n, b[2] + n, age, left - n
        where.append(b[4])
    return where, [min(c for c in capacities if c >= b[2]) for b in bins]


def test_packing_equals_the_plain_algorithm():
    rng = random.Random(4)
    for _ in range(50):
        lengths = sorted((rng.choice([0, 1, 5, rng.randint(1, 64), 64]) for _ in range(rng.randint(0, 60))), reverse=True)
        assert packing.pack(lengths, (8, 16, 64), 2) == plain_pack(lengths, (8, 16, 64), 2)


RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_perfect_hash():
    keys = list(RANKS)[:5000]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(5000))
    assert table.slot(b"no such key at all") == -1 and bpe.PerfectHash([]).slot(b"x") == -1


def test_bpe_equals_tiktoken():
    own = bpe.Tokenizer(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encode, rng = own.encoder(), random.Random(5)
    signs = [chr(c) for c in [*range(0x250), 0x85, 0x2028, 0x3000, 0x1F600, 0x4E2D, 0x301]] + [" ", "\n", "'", "s", "a", "the"] * 60
    texts = ["", "<|endoftext|>", "a" * 5000, "hello   world\n\n  it's 2024"] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for t in texts:
        ids = encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_licence_findings():
    model = licenses.train(["the river runs through the green valley and on", "open the door, said the person of the house", "a version of the story was told"])
    text = "Once upon a time.\nReleased under the MIT License.\nno rights\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."
    assert [(x[0], x[1], x[4]) for x in model.findings(text)] == [(1, "MIT", True), (3, "CC-BY-NC", True), (4, "GPL-3.0", True)]
    assert model.findings(None) == model.findings("") == model.findings("The public library of the city.") == []


HELD_OUT = [
    ("GPL-2.0", True, "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", False, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", True, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License."),
    ("AGPL-3.0", False, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation."),
    ("Apache-2.0", True, 'Licensed to the Foundation under one or more agreements. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy at'),
    ("MIT", True, 'Copyright (c) 2020 A. Person. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use'),
    ("BSD", True, "Copyright 2018 The Authors. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file in the root of the source tree."),
    ("GPL-2.0", False, "GNU General Public License, version 2."),
]


def test_licence_versions_of_wordings_that_are_no_templates():
    model = licenses.train(["the river runs through the green valley and on", "open the door, said the person of the house", "a version of the story was told"])
    for family, sure, text in HELD_OUT:
        for layout in (text, "\n".join(__import__("textwrap").wrap(text, 72))):
            assert [(x[1], x[4]) for x in model.findings(layout)] == [(family, sure)], layout
    assert not any(x[4] for x in model.findings("GNU General Public License, version 1."))
    for text in ("A version of the license for the public library was published by the foundation.", "All rights reserved by the general public.", "Permission is hereby refused."):
        assert not any(x[4] for x in model.findings(text))


def test_licence_probabilities_against_the_plain_softmax():
    model = licenses.train(["the river runs through the green valley and on"] * 3)
    for text in ("Released under the MIT License.", "This work is licensed under the terms", "river"):
        words = re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", text.lower())
        have = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        z = [sum(float(model.weight[r, c]) for g, r in model.row.items() if g in have) + float(model.bias[c]) for c in range(len(model.classes))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        assert model.probabilities(words) == pytest.approx([x / sum(e) for x in e], rel=1e-3, abs=1e-6)


def test_digests_are_of_the_whole_text(spark, folder):
    from tidewright.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op10_byte_bpe"](spark, folder).where("doc_id is not null").collect():
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
