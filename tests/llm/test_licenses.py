import re

import pytest

from hydrospark.llm import licenses as lic

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in lic.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(places)


TEXTS = [
    None, "", "...", "Released under the MIT License.", "under the mit\nlicense under THE MIT LICENSE, cc-by-nc",
    "Licensed under the Apache License, Version 2.0.", "under the mit licenses", "xunder the mit license",
    "é under the mit license ü", "Licensed under CC BY-NC 4.0.", "cc by cc by nc nc",
    "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */\ncode", "word " * 30_000 + "under the mit license",
    "/* SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: AND OR",
]


def test_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in lic.scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        n, places = brute(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert r["first_word"] == (places[0][0] if places else None)
        assert r["last_word"] == (places[-1][0] if places else None)
        base = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(base)
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r["score"] <= 1
    assert got[11]["expressions"] == ["(MIT OR GPL-2.0-only) AND Apache-2.0"] and got[11]["allowed"] is True
    assert got[13]["allowed"] is True and got[14]["expressions"] == [] and got[14]["allowed"] is None
    assert lic.scan_licenses(df.where("false")).count() == 0


@pytest.mark.parametrize("text,postfix,ok", [
    ("MIT", ["MIT"], True), ("MIT and GPL-3.0", ["MIT", "GPL-3.0", "AND"], False),
    ("GPL-3.0 OR MIT AND ISC", ["GPL-3.0", "MIT", "ISC", "AND", "OR"], True),
    ("(GPL-3.0 OR MIT) AND X", ["GPL-3.0", "MIT", "OR", "X", "AND"], False),
    ("A WITH LLVM-exception OR B", ["A", "LLVM-exception", "WITH", "B", "OR"], True),
])
def test_expressions(text, postfix, ok):
    assert lic.to_postfix(text) == postfix and lic.evaluate(postfix) is ok


@pytest.mark.parametrize("bad", ["", "AND", "MIT OR", "(MIT", "MIT)", "MIT ISC", "MIT (ISC)", "()"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        lic.to_postfix(bad)


BSD = "Copyright X. All rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted"
END = "Neither the name of X may be used to endorse or promote products derived from this software without permission."
ADV = "All advertising materials mentioning features or use of this software must display"


@pytest.mark.parametrize("text,labels", [
    (BSD, "id:BSD-2-Clause,policy:allowed"), (f"{BSD} {END}", "id:BSD-3-Clause,policy:allowed"),
    (f"{BSD} {ADV} {END}", "id:BSD-4-Clause,policy:restricted"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy. All rights reserved.", "id:MIT,policy:allowed"),
    ("All rights reserved.", "id:LicenseRef-Proprietary,policy:restricted"),
    ("SPDX-License-Identifier: mit", "id:MIT,policy:allowed"), ("SPDX-License-Identifier: Apache-2.0+", "id:Apache-2.0+,policy:allowed"),
    ("SPDX-License-Identifier: gpl-2.0-ONLY or bsd-3-clause", "id:BSD-3-Clause,id:GPL-2.0-only,policy:allowed"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "id:LGPL-3.0-or-later,policy:restricted"),
    ("SPDX-License-Identifier: MIT and this file is proprietary", "id:MIT,policy:allowed"),
    ("SPDX-License-Identifier: MIT This file", "id:MIT,policy:allowed"),
    ("SPDX-License-Identifier: MIT AND LicenseRef-Own", "id:LicenseRef-Own,id:MIT,policy:restricted"),
    ("SPDX-License-Identifier: the usual", ""), ("cc by nc only", "cc-by-nc,id:CC-BY-NC-4.0,policy:restricted"),
    ("used under the MIT license here", "id:MIT,mit,policy:allowed"),
    ("Apache License, Version 2", "apache-2,id:Apache-2.0,policy:allowed"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH classpath-Exception-2.0", "id:Classpath-exception-2.0,id:GPL-2.0-only,policy:allowed"),
])
def test_policy(text, labels):
    assert ",".join(sorted(lic.scan_text(text.encode())["labels"])) == labels


def brute_meets(expression):
    """Recursive descent over the grammar, as a check of the shunting-yard."""
    tokens = re.findall(r"[()]|[^\s()]+", expression)

    def bare(t):
        return re.sub(r"(?i)(\+|-only|-or-later)$", "", t).lower()

    def factor():
        t = tokens.pop(0)
        if t == "(":
            v = either()
            assert tokens.pop(0) == ")"
        else:
            v = bare(t) in {x.lower() for x in lic.PERMISSIVE}
        while tokens and tokens[0].upper() == "WITH":
            tokens.pop(0)
            v = tokens.pop(0).lower() in {x.lower() for x in lic.EXCEPTIONS} or v
        return v

    def both():
        v = factor()
        while tokens and tokens[0].upper() == "AND":
            tokens.pop(0)
            v = factor() and v
        return v

    def either():
        v = both()
        while tokens and tokens[0].upper() == "OR":
            tokens.pop(0)
            v = both() or v
        return v
    out = either()
    assert not tokens
    return out


def test_labels_match_brute_force():
    """Phrases by word search, expressions by recursive descent, over random texts."""
    import random
    r = random.Random(6)
    ids = ["MIT", "mit", "GPL-3.0-or-later", "Apache-2.0+", "X-1", "isc", "LicenseRef-a", "BSD-4-Clause"]

    def expression(depth):
        k = r.random()
        if depth == 0 or k < 0.4:
            return r.choice(ids) + (" WITH LLVM-exception" if r.random() < 0.15 else "")
        if k < 0.6:
            return f"({expression(depth - 1)})"
        return f"{expression(depth - 1)} {r.choice(['AND', 'OR', 'and', 'or'])} {expression(depth - 1)}"

    phrases = [*lic.BASE_PHRASES, *lic.NOTICES, lic.BSD_GRANT, lic.BSD_ADVERTISING, lic.BSD_ENDORSE, lic.RESERVED]
    for _ in range(400):
        said = [r.choice(phrases) for _ in range(r.randint(0, 3))]
        tags = [expression(2) for _ in range(r.choice([0, 0, 1, 2]))]
        lines = [r.choice(["", "x "]) + p.replace(" ", r.choice([" ", ", ", "\n"])).title() + r.choice(["", " y", "s"]) for p in said]
        lines += [f"SPDX-License-Identifier: {e}\n" for e in tags]
        r.shuffle(lines)
        text = "\n# ".join(lines)
        words = WORD.findall(text.lower())
        has = lambda p: any(words[i:i + len(p.split())] == p.split() for i in range(len(words)))
        found = {lic.NOTICES[p] for p in lic.NOTICES if has(p)}
        if has(lic.BSD_GRANT):
            found.add("BSD-4-Clause" if has(lic.BSD_ADVERTISING) else "BSD-3-Clause" if has(lic.BSD_ENDORSE) else "BSD-2-Clause")
        base = {lic.BASE_PHRASES[p] for p in lic.BASE_PHRASES if has(p)}
        found |= {lic.BASE_IDS[x] for x in base}
        if has(lic.RESERVED) and not found and not tags:
            found.add(lic.PROPRIETARY)
        allowed = {x.lower() for x in lic.PERMISSIVE}
        verdicts = [re.sub("-only$", "", x).lower() in allowed for x in found] + [brute_meets(e) for e in tags]
        got = lic.scan_text(text.encode())
        assert {x for x in got["labels"] if ":" not in x} == base
        assert got["allowed"] is (all(verdicts) if verdicts else None), text
        ids_said = {t.lower() for e in tags for t in re.findall(r"[^\s()]+", e) if t.upper() not in ("AND", "OR", "WITH")}
        assert {x[3:].lower() for x in got["labels"] if x.startswith("id:")} == ids_said | {x.lower() for x in found}
