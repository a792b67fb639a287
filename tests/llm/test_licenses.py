import random
import re

from verdikt.llm import license_rules, licenses
from verdikt.llm.license_rules import keywords, rules

from .fixtures import frame, prose
from .test_decontam import words


def run(spark, rows, **kw):
    return {r["doc_id"]: r for r in licenses.digest(licenses.scan(frame(spark, rows, **kw))).collect()}


def brute(text):
    w, found = words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x[1] for x in found}))


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0. ALL Rights\n\nReserved. all rights reserved",
    "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: BSD-3-Clause",
    "cc by cc by cc_by",
    "Redistribution and use in source and binary forms, with or without modification",
    prose(1, 50) + " Mozilla Public License 2.0 " + prose(2, 9),
    "ich gehe mit dir",
    "über all rights reservéd all-rights-reserved",
]


def test_base_places_equal_brute_force(spark):
    rows = [*enumerate(TEXTS), (100, None), (101, ""), (102, "... !"), (103, prose(3, 20_000) + " all rights reserved"), (103, prose(3, 20_000) + " all rights reserved"), (None, "cc by")]
    got = run(spark, rows, clash=True)
    for d, t in rows:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_labels(spark):
    got = run(spark, list(enumerate(TEXTS)))
    want = ["gpl,gpl-3.0", "apache-2.0,reserved", "mit", "cc-by,cc-by-nc", "bsd-3-clause", "cc-by", "bsd", "mpl-2.0", "", "reserved"]
    assert [got[i]["labels"] for i in range(len(TEXTS))] == want


RULES = [(label, priority, confidence, re.compile(licenses.whole(pattern))) for label, priority, confidence, pattern in rules()]


def naive(text):
    """All rules on all texts, without keywords, resolved over the whole text."""
    canon = " ".join(words(text))
    hits = []
    for k, (label, priority, _, regex) in enumerate(RULES):
        for m in regex.finditer(canon):
            start = canon[: m.start()].count(" ")
            hits.append((priority, -(m.group().count(" ") + 1), start, k, label))
    kept = []
    for h in sorted(hits):
        if all(h[2] >= g[2] - g[1] or g[2] >= h[2] - h[1] for g in kept):
            kept.append(h)
    return sorted((h[2], -h[1], h[4]) for h in kept)


def examples(pattern, rng, n):
    """Texts that the pattern matches: each alternative of each group is taken in turn, then random ones."""
    tree, _ = license_rules._parse(pattern)
    choices, out = {}, []

    def write(groups, path, forced):
        i = forced.get(path, rng.randrange(len(groups)))
        choices[path] = len(groups)
        text = ""
        for j, (node, least, most) in enumerate(groups[i]):
            at = (*path, i, j)
            upto = least + 2 if most is None else min(most, least + 1)
            choices[(*at, "n")] = upto - least + 1
            for _ in range(least + forced.get((*at, "n"), rng.randrange(upto - least + 1))):
                text += "zz"[: rng.randint(1, 2)] if node is None else write(node, at, forced) if isinstance(node, list) else rng.choice(sorted(node))
        return text

    done = set()
    for _ in range(n):
        out.append(write(tree, (), {}))
        for path, many in list(choices.items()):
            if path not in done:
                done.add(path)
                out += [write(tree, (), {path: i}) for i in range(many)]
    return out


def test_every_alternative_of_every_rule_passes_its_keywords():
    rng, seen = random.Random(1), 0
    for label, _, _, pattern in rules():
        regex, needs = re.compile(licenses.whole(pattern)), keywords(pattern)
        for text in examples(pattern, rng, 12):
            text = " ".join(text.split())
            for m in regex.finditer(text):
                seen += 1
                assert all(set(s) & set(text.split()) for s in needs), (label, pattern, m.group(), needs)
    assert seen > 10_000


def test_joined_spellings(spark):
    texts = ["licensed under the lgplv3", "licensed under the agplv3", "licensed under the mplv2", "licensed under apache2", "creative commons zero license", "freebsd license", "blueoak model license", "without warranties of any kind", "noncommercial use only", "bsd zero clause license"]
    want = ["lgpl-3.0", "agpl-3.0", "mpl-2.0", "apache-2.0", "cc0-1.0", "bsd-2-clause", "blueoak-1.0.0", "warranty-disclaimer", "non-commercial", "0bsd"]
    got = run(spark, list(enumerate(texts)))
    assert [got[i]["labels"] for i in range(len(texts))] == want


def test_gated_rules_find_what_all_rules_find(spark):
    """One text for each rule, and all of them in one."""
    rng = random.Random(2)
    texts = [" ".join(examples(pattern, rng, 1)[:4]) for _, _, _, pattern in rules()]
    texts += [" xx ".join(texts[i : i + 40]) for i in range(0, len(texts), 40)]
    got = {r["doc_id"]: sorted((x["word"], x["words"], x["label"]) for x in r["detections"]) for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == naive(t), t


def test_what_has_gone_pushes_nothing_aside(spark):
    """tag over grant over name: the grant overlaps the tag and goes, the name overlaps only the grant and stays."""
    text = "spdx license identifier mit licensed under the mit license"
    got = licenses.scan(frame(spark, [(1, text)])).first()["detections"]
    assert sorted((x["word"], x["words"], x["label"]) for x in got) == naive(text)


def test_no_python_workers(spark, data):
    plan = licenses.digest(licenses.scan(spark.read.parquet(f"{data}/documents.parquet")))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_detections_equal_naive_resolution(spark):
    texts = [*TEXTS, " ".join(TEXTS), "Copyright (c) 2020 2021 some rights reserved. Provided under the Apache License 2.0 and the Boost Software License; no copyright restrictions; dual licensed under the terms of the MIT license or the ISC license"]
    got = {r["doc_id"]: sorted((x["word"], x["words"], x["label"]) for x in r["detections"]) for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: naive(t) for i, t in enumerate(texts)}


def test_rules_are_hundreds_written_by_hand(spark):
    assert len(license_rules.SIGNATURES) >= 250 and len(license_rules.NAMES) >= 100
    assert run(spark, []) == {}
