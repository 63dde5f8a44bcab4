import hashlib
import json
import random
from collections import Counter

import public_tokenizers as public
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrospark.llm import alignment, registered

ODD = [None, "", " ", "  two  spaces ", "plain words here", "tab\there\n\nline", "<|endoftext|> </s> <s> <unk>", "▁x", "x▁",
       "é́ naïve 中文字 🙂👍🏽", "ﬁ 　 wide", "a" * 3000, "word " * 4000, "x" * 70 + " yz" * 50, "\x00\x01", "don't we'll I'VE",
       "1234567 89,0.1", "​ a", "\U0001f600" * 50]


def _random_texts(n):
    r = random.Random(7)
    pool = list("abcdefgh ijk lmn  \n\té中🙂.,'0123") + ["the ", " and", "tion", " ", "<s>"]
    return ["".join(r.choices(pool, k=r.randint(0, 200))) for _ in range(n)]


def brute(texts):
    """Straight from the contract, with the libraries' own encoders and token tables."""
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def a_bytes(i):
        return bytes(byte[c] for c in tok.id_to_token(i))

    def b_bytes(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and sp.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        a = b = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            want = (" " + text).encode()
            if b"".join(map(a_bytes, a)) != want or b"".join(map(b_bytes, b)) != want:
                a = b = []
        ends_a, ends_b, at = {}, {}, 0
        for i in a:
            at += len(a_bytes(i))
            ends_a.setdefault(at, []).append(i)
        at = 0
        for i in b:
            at += len(b_bytes(i))
            ends_b.setdefault(at, []).append(i)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for e in sorted(ends_a) if before < e <= c for i in ends_a[e]) + "|"
                          + ",".join(str(i) for e in sorted(ends_b) if before < e <= c for i in ends_b[e]))
            before = c
        links = [(x, y) for c in cuts for x in ends_a[c] for y in ends_b[c]]
        docs.append((len(a), len(b), ";".join(groups), len(cuts), links))
    counts = Counter(p for d in docs for p in d[4])
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(na, nb, ng, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), text)
            for na, nb, text, ng, links in docs]


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
            .orderBy("doc_id").collect()]


def test_brute_force(spark):
    texts = [t for t in ODD if t is None or len(t) < 1500] + _random_texts(150) + ["same text"] * 5
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs string")
    want = [(i, *w) for i, w in enumerate(brute(texts))]
    assert _rows(alignment.align_corpus(df)) == want
    # More slices than one, other partitions.
    assert _rows(alignment.align_corpus(df.repartition(5), slice_pairs=50)) == want


def test_long_texts_rows_and_digest(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else i // 2, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = alignment.align_corpus(df, digest=True).collect()
    plain = alignment.align_corpus(df).collect()
    key = lambda r: (str(r["doc_id"]), r["n_a"], r["n_b"], r["count_sum"])
    assert len(got) == len(ODD)
    for x, y in zip(sorted(got, key=key), sorted(plain, key=key)):
        assert key(x) == key(y)
        assert x["groups"] == (hashlib.sha256(y["groups"].encode()).hexdigest() if y["groups"] else "")
        assert y["n_groups"] == (y["groups"].count(";") + 1 if y["groups"] else 0)
    long = [r for r in plain if r["n_a"] > 300]
    assert len(long) == 2
    assert alignment.align_corpus(df.where("false")).count() == 0


def test_encoders_agree_with_the_library():
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    a, b = alignment.public_tokenizers_a_b()
    texts = [t for t in ODD if t] + _random_texts(2000)
    # A character of each of 2,000 places of Unicode between others.
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}." for c in range(0x80, 0x30000, 97) if not 0xD800 <= c < 0xE000]
    assert a.encode(texts) == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert all(len(x) for i, x in enumerate(a.bytes_of) if i != 50256) and all(len(x) for x in b.bytes_of[3:])
    vocab = json.load(open(public.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"]
    assert len(a.bytes_of) == len(vocab) or len(a.bytes_of) == len(vocab) + 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = registered.QUERIES["op12_alignment"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    small = [r for r in docs if r["text"] is None or len(r["text"]) < 3000]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs)
    for r, w in zip(small, brute([r["text"] for r in small])):
        g = got[r["doc_id"]]
        assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"]) == w[:4]
        assert g["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
