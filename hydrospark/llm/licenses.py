"""Licence scan: phrases and identifier tags by Aho-Corasick, licence
expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import alnum_words, byte_slices

# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# The licence that a base phrase states, for the policy.
BASE_IDS = {"mit": "MIT", "apache-2": "Apache-2.0", "cc-by-nc": "CC-BY-NC-4.0"}
# Notice phrases (as words) and the licence that each one names.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "MIT",
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "permission to use copy modify and or distribute this software for any purpose": "ISC",
    "licensed under the apache license version 2 0": "Apache-2.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu affero general public license": "AGPL-3.0-only",
    "gnu lesser general public license": "LGPL-3.0-only",
    "boost software license version 1 0": "BSL-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "cc0 1 0 universal": "CC0-1.0",
    "licensed under cc by nc 4 0": "CC-BY-NC-4.0",
    "licensed under cc by 4 0": "CC-BY-4.0",
    "licensed under cc by sa 4 0": "CC-BY-SA-4.0",
    "creative commons attribution 4 0 international": "CC-BY-4.0",
    "creative commons attribution noncommercial": "CC-BY-NC-4.0",
    "creative commons attribution sharealike": "CC-BY-SA-4.0",
}
# The family of redistribution notices is told apart by its further clauses.
BSD_GRANT = "redistribution and use in source and binary forms"
BSD_ADVERTISING = "all advertising materials mentioning features or use of this software"
BSD_ENDORSE = "to endorse or promote products derived from this software"
# Names a restriction only where no licence is granted beside it.
RESERVED, PROPRIETARY = "all rights reserved", "LicenseRef-Proprietary"
TAGS = ("spdx license identifier",)
PERMISSIVE = frozenset(("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0",
                        "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-3.0", "PostgreSQL", "Python-2.0", "NCSA", "X11", "WTFPL",
                        "BlueOak-1.0.0", "Unicode-3.0", "HPND"))
# Known ids that the policy does not allow.
RESTRICTED = frozenset(("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0",
                        "BSD-4-Clause", "CDDL-1.0", "EUPL-1.2", "OSL-3.0", "SSPL-1.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
                        "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"))
EXCEPTIONS = frozenset(("Classpath-exception-2.0", "LLVM-exception", "GCC-exception-3.1", "Autoconf-exception-3.0",
                        "Bison-exception-2.2", "Linux-syscall-note"))
_KNOWN = {x.lower(): x for x in (*PERMISSIVE, *RESTRICTED, *EXCEPTIONS)}
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_VERSIONS = re.compile(r"(?i)(\+|-only|-or-later)$")


def canonical(token: str) -> str:
    """An identifier in its usual letter case; its version suffix (``+``,
    ``-only``, ``-or-later``) stays. Unknown identifiers are left as they are."""
    bare = _VERSIONS.sub("", token)
    suffix = token[len(bare):].lower()
    return _KNOWN.get(token.lower()) or (_KNOWN[bare.lower()] + suffix if bare.lower() in _KNOWN else token)


def is_identifier(token: str) -> bool:
    """Known in any letter case, or shaped like an identifier: with a digit, a
    hyphen or a colon, or all capitals. Prose behind an expression is neither."""
    bare = _VERSIONS.sub("", token).lower()
    return (bare in _KNOWN or token.lower() in _KNOWN or bool(re.search(r"[0-9:]|[A-Za-z0-9]-[A-Za-z0-9]", token))
            or (len(token) > 1 and token.isupper()))


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard over ids, AND, OR, WITH (any letter case) and brackets.
    Raises ValueError on an expression that does not parse."""
    out, ops, want_id = [], [], True
    for token in _TOKEN.findall(expression):
        op = token.upper()
        if token == "(":
            if not want_id:
                raise ValueError("operator expected")
            ops.append(token)
        elif token == ")":
            if want_id:
                raise ValueError("identifier expected")
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError("unbalanced bracket")
            ops.pop()
        elif op in _PRECEDENCE:
            if want_id:
                raise ValueError("identifier expected")
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[op]:
                out.append(ops.pop())
            ops.append(op)
            want_id = True
        else:
            if not want_id:
                raise ValueError("operator expected")
            out.append(token)
            want_id = False
    if want_id or "(" in ops:
        raise ValueError("incomplete expression")
    return out + ops[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool:
    """Whether the expression can be met by allowed licences: AND needs both
    sides, OR one, WITH its licence (allowed itself, or relaxed by a known
    exception)."""
    stack: list = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "WITH":
            stack.append(_holds(left, allowed) or canonical(right) in EXCEPTIONS)
        else:
            a, b = _holds(left, allowed), _holds(right, allowed)
            stack.append(a and b if token == "AND" else a or b)
    return _holds(stack.pop(), allowed)


def _holds(x, allowed) -> bool:
    """An identifier is allowed if it is on the list, whatever its letter case
    and version suffix."""
    return x if isinstance(x, bool) else canonical(_VERSIONS.sub("", x)) in allowed


def tag_expressions(text: str) -> list[str]:
    """The expression after each identifier tag, to the end of its line or
    comment; tokens from the first that is no identifier, operator or bracket
    on, and trailing ones that break the expression, are cut off."""
    out = []
    for m in re.finditer(r"spdx-license-identifier:[ \t]*([^\r\n]*)", text, re.IGNORECASE):
        tokens = _TOKEN.findall(re.split(r"\*/|-->|[\"'`;,]", m[1])[0])
        prose = next((i for i, t in enumerate(tokens) if t not in "()" and t.upper() not in _PRECEDENCE
                      and not is_identifier(t)), len(tokens))
        tokens = [t if t in "()" or t.upper() in _PRECEDENCE else canonical(t) for t in tokens[:prose]]
        for n in range(len(tokens), 0, -1):
            try:
                to_postfix(" ".join(tokens[:n]))
            except ValueError:
                continue
            out.append(" ".join(tokens[:n]).replace("( ", "(").replace(" )", ")"))
            break
    return out


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def scan_text(data: bytes | None) -> dict:
    """Everything found in one text; see ``scan_licenses``."""
    words = alnum_words(data) if data else []
    out = {"n_words": len(words), "places": [], "ids": set(), "labels": set(), "expressions": [], "allowed": None}
    if not words:
        return out
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    seen, at = 0, 0
    phrases = (*BASE_PHRASES, *NOTICES, *TAGS, BSD_GRANT, BSD_ADVERTISING, BSD_ENDORSE, RESERVED)
    hits = sorted((end - len(p) - 1, p) for end, p in _automaton(phrases).iter(joined))
    met = set()
    for start, phrase in hits:
        seen += joined.count(" ", at, start)  # separators before a word are its number
        at = start
        if phrase in BASE_PHRASES:
            out["places"].append((seen, BASE_PHRASES[phrase]))
        met.add(phrase)
    notices = {NOTICES[p] for p in met if p in NOTICES}
    if BSD_GRANT in met:
        notices.add("BSD-4-Clause" if BSD_ADVERTISING in met else "BSD-3-Clause" if BSD_ENDORSE in met else "BSD-2-Clause")
    base = {x for _, x in out["places"]}
    notices |= {BASE_IDS[x] for x in base}
    if met & set(TAGS):
        out["expressions"] = tag_expressions(data.decode("utf-8", "replace"))
    if RESERVED in met and not notices and not out["expressions"]:
        notices.add(PROPRIETARY)
    verdicts = []
    for e in out["expressions"]:
        postfix = to_postfix(e)
        out["ids"].update(t for t in postfix if t not in _PRECEDENCE)
        verdicts.append(evaluate(postfix))
    verdicts.extend(_holds(n, PERMISSIVE) for n in notices)
    out["ids"] |= notices
    out["labels"] = base | {f"id:{x}" for x in out["ids"]}
    if verdicts:
        out["allowed"] = all(verdicts)
        out["labels"].add("policy:allowed" if out["allowed"] else "policy:restricted")
    return out


def _score(found: dict) -> float:
    """Evidence that the text states a licence: tags count most, then notices, then base phrases."""
    miss = 1.0
    for n, w in ((len(found["expressions"]), 0.9), (len(found["ids"]), 0.6), (len(found["places"]), 0.5)):
        miss *= (1 - w) ** min(n, 20)
    return 1.0 - miss


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions array<string>, allowed boolean")


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the id, the word count, the places of the
    base phrases (all, overlapping ones too), labels, the licence expressions
    of identifier tags, ``allowed`` (null: no licence named) and a score.

    Every licence that a tag, a notice or a base phrase names is judged, and the
    text is allowed if all of them are. "All rights reserved" is a verdict only
    where nothing else is named.

    A null text is empty: no words, empty label strings, score 0. Whole texts
    are scanned, each alone; repeated rows give repeated results. Other columns
    are ignored. An empty table gives an empty result.
    """
    import pyarrow as pa

    base = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for b in batches:
            for start, texts in byte_slices(b.column(1)):
                found = [scan_text(t) for t in texts]
                places = [f["places"] for f in found]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(start, len(texts)),
                    pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([len(p) for p in places], pa.int64()),
                    pa.array([p[0][0] if p else None for p in places], pa.int64()),
                    pa.array([p[-1][0] if p else None for p in places], pa.int64()),
                    pa.array([",".join(sorted({x for _, x in p})) for p in places], pa.string()),
                    pa.array([",".join(sorted(f["labels"])) for f in found], pa.string()),
                    pa.array([_score(f) for f in found], pa.float64()),
                    pa.array([f["expressions"] for f in found], pa.list_(pa.string())),
                    pa.array([f["allowed"] for f in found], pa.bool_()),
                ], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                          "expressions", "allowed"])

    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
