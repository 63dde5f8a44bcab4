"""Cross-tokenizer alignment over whitespace-token anchors.

A text is encoded whole by two tokenizers. A byte offset where tokens of both
end, verified on both sides, and before which both go on with a token that
starts with a space, is an anchor. Anchors cut a document into windows of token
ids; a window's alignment depends on its two id tuples only and is kept in a
bounded memo, so frequent words are aligned once a worker. Inside a window the
offsets where tokens of both sides end cut the ids into groups, and the two
tokens that end there are linked.

Link counts of the whole corpus are an aggregate over (pair, multiplicity) rows;
they come back to the documents in slices of bounded size, each broadcast, so no
frequent pair gathers its documents in one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import byte_slices, cut_lineage, drop_folder
from hydrospark.session import checkpoint_dir

# Windows of more ids than this on average of both sides are aligned without the memo.
MEMO_WINDOW = 64
MEMO_ENTRIES = 300_000

PASS_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
               "pairs array<long>, times array<int>")


class ByteBpe:
    """A byte-level BPE vocabulary in a tokenizers JSON file, encoded as ranks.

    Merges must stand in the order of their ids (checked), which makes ranks and
    merges the same rule. Special tokens are left out, so their strings in a
    text are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if spec["model"]["type"] != "BPE" or any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("merges are not in the order of their ids")
        # Printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(t) for t in texts]


class PieceBpe:
    """A sentencepiece model; ids as the library gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            if self._model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif self._model.is_control(i) or self._model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def public_tokenizers_a_b(folder: str | None = None):
    """The pair of the contract, loaded from the folder of vocabulary files
    (the installed one unless given): byte_bpe_50k.json and piece_bpe_32k.model."""
    import os

    import public_tokenizers as public

    at = public.path if folder is None else lambda name: os.path.join(folder, name)
    return ByteBpe(at("byte_bpe_50k.json"), public.PATTERN), PieceBpe(at("piece_bpe_32k.model"))


@lru_cache(maxsize=1)
def _worker_aligner(load):
    """One aligner per worker process: the next task finds the vocabularies and
    the memo, and their memory is not taken twice."""
    return Aligner(*load())


class Aligner:
    """Aligns texts one by one; holds the vocabularies and the memo."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self._len_a, self._len_b = (np.array([len(x) for x in t.bytes_of]) for t in (a, b))
        self._space_a, self._space_b = (np.array([x[:1] == b" " for x in t.bytes_of]) for t in (a, b))
        self._name_a, self._name_b = ([str(i) for i in range(len(t.bytes_of))] for t in (a, b))
        self._flat_a, self._flat_b = (np.frombuffer(b"".join(t.bytes_of), dtype=np.uint8) for t in (a, b))
        self._at_a, self._at_b = (np.concatenate([[0], n.cumsum()[:-1]]) for n in (self._len_a, self._len_b))
        # Ids of the two sides never are the same number in a key.
        self._apart = len(a.bytes_of)
        self._memo: dict[bytes, str] = {}

    def _groups(self, a: list[int], b: list[int], i: int, j: int, ends_a: list[int], ends_b: list[int]) -> str:
        """The groups (`a1,a2|b1;a3|b2,b3`) of the window that begins at ids i and
        j and whose shared ends lie after these numbers of ids."""
        name_a, name_b = self._name_a, self._name_b
        out = []
        for x, y in zip(ends_a, ends_b):
            if x - i == 1 and y - j == 1:
                out.append(f"{name_a[a[i]]}|{name_b[b[j]]}")
            else:
                out.append(f"{','.join([name_a[t] for t in a[i:x]])}|{','.join([name_b[t] for t in b[j:y]])}")
            i, j = x, y
        return ";".join(out)

    @staticmethod
    def _ends(raw: np.ndarray, ids: np.ndarray, lengths: np.ndarray, at: np.ndarray, flat: np.ndarray):
        """Where each token ends, None if the joined tokens are not ``raw``."""
        sizes = lengths[ids]
        ends = sizes.cumsum()
        if ends[-1] != len(raw):
            return None
        joined = flat[np.repeat(at[ids] - ends + sizes, sizes) + np.arange(len(raw))]
        return ends if np.array_equal(joined, raw) else None

    def align(self, data: bytes, a: list[int], b: list[int]):
        """(groups, n_groups, linked pairs as ``a << 32 | b``) of a text (with its
        leading space) and its ids; None where the joined bytes of either side
        are not the text's. A window's key are its ids on both sides, packed: the
        ids of all windows stand in one buffer, each side of a window in turn."""
        if not a or not b:
            return None
        raw = np.frombuffer(data, dtype=np.uint8)
        ids_a, ids_b = np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)
        ends_a = self._ends(raw, ids_a, self._len_a, self._at_a, self._flat_a)
        ends_b = self._ends(raw, ids_b, self._len_b, self._at_b, self._flat_b)
        if ends_a is None or ends_b is None:
            return None
        # No token is without bytes, so at most one token of a side ends at a place.
        marks = np.zeros(len(data) + 1, dtype=bool)
        marks[ends_a] = True
        last_b = np.flatnonzero(marks[ends_b])
        last_a = np.searchsorted(ends_a, ends_b[last_b])
        pairs = ids_a[last_a].astype(np.int64) << 32 | ids_b[last_b]
        after_a, after_b = last_a[:-1] + 1, last_b[:-1] + 1  # the last one is the end of the text
        anchors = np.flatnonzero(self._space_a[ids_a[after_a]] & self._space_b[ids_b[after_b]])
        cut_a, cut_b = after_a[anchors], after_b[anchors]
        size_a, size_b = np.diff(cut_a, prepend=0, append=len(a)), np.diff(cut_b, prepend=0, append=len(b))
        packed = np.empty(len(a) + len(b), dtype=np.int32)
        packed[np.arange(len(a)) + np.repeat(np.concatenate([[0], cut_b]), size_a)] = ids_a
        packed[np.arange(len(b)) + np.repeat(np.concatenate([cut_a, [len(a)]]), size_b)] = ids_b + self._apart
        data_of = packed.tobytes()
        ends = (4 * (size_a + size_b).cumsum()).tolist()
        memo, found = self._memo, self._memo.get
        texts, at = [], 0
        for end in ends:
            texts.append(found(data_of[at:end]))
            at = end
        if None in texts:
            cut_a, cut_b = [0, *cut_a.tolist(), len(a)], [0, *cut_b.tolist(), len(b)]
            cut_k = [0, *(anchors + 1).tolist(), len(last_b)]
            shared_a, shared_b = (last_a + 1).tolist(), (last_b + 1).tolist()
            for n, text in enumerate(texts):
                if text is None:
                    key = data_of[ends[n - 1] if n else 0:ends[n]]
                    text = found(key)  # an earlier window of this text may be the same
                    if text is None:
                        k, kc = cut_k[n], cut_k[n + 1]
                        text = self._groups(a, b, cut_a[n], cut_b[n], shared_a[k:kc], shared_b[k:kc])
                        if len(key) <= 8 * MEMO_WINDOW:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            memo[key] = text
                    texts[n] = text
        return ";".join(texts), len(last_b), pairs


def align_rows(docs: DataFrame, load=public_tokenizers_a_b, digest: bool = False, text_col: str = "text",
               id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, the numbers of tokens, groups and links, the
    groups as text (with ``digest`` the SHA-256 hex of it instead, empty without
    tokens), and its different linked pairs with their multiplicities.

    Null and empty texts, and texts that a tokenizer changes, have no tokens:
    zeros and empty lists. Repeated rows and null ids are rows like others; very
    long texts are encoded whole. An empty table gives an empty result. Other
    columns are not read.
    """
    def run(batches):
        import pyarrow as pa

        aligner = _worker_aligner(load)
        for batch in batches:
            ids = batch.column(0)
            for start, values in byte_slices(batch.column(1)):
                texts = [None if not v else v.decode("utf-8", "replace") for v in values]
                full = [k for k, t in enumerate(texts) if t is not None]
                enc_a = aligner.a.encode([" " + texts[k] for k in full])
                enc_b = aligner.b.encode([texts[k] for k in full])
                out = [[0] * len(values) for _ in range(4)] + [[""] * len(values)] + [[[]] * len(values) for _ in range(2)]
                for k, a, b in zip(full, enc_a, enc_b, strict=True):
                    found = aligner.align(b" " + values[k], a, b)
                    if found is None:
                        continue
                    groups, n_groups, linked = found
                    pairs, times = np.unique(linked, return_counts=True)
                    row = (len(a), len(b), n_groups, len(linked),
                           hashlib.sha256(groups.encode()).hexdigest() if digest else groups, pairs, times)
                    for column, value in zip(out, row):
                        column[k] = value
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                arrays = [ids.slice(start, len(values))] + [pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups",
                                                          "pairs", "times"])

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return named.mapInArrow(run, PASS_SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair corpus-wide, and whether no pair with
    the same B id has more. Counted with partial sums."""
    links = rows.select(F.inline(F.arrays_zip("pairs", "times")).alias("pair", "k"))
    counts = cut_lineage(links.groupBy("pair").agg(F.sum("k").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counts.join(top, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_corpus(docs: DataFrame, load=public_tokenizers_a_b, digest: bool = False, text_col: str = "text",
                 id_col: str = "doc_id", slice_pairs: int = 1_000_000) -> DataFrame:
    """``align_rows`` without the pairs, with ``n_best`` (links whose pair is the
    most frequent of its B id, ties included) and ``count_sum`` (the counts of
    all links).

    The first pass over the texts is written to the shared checkpoint folder and
    read by the counting and by the scoring, then deleted. The counts are joined in slices of
    about ``slice_pairs`` pairs, broadcast one by one: exact at any size. Rows
    behave as in ``align_rows``.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    align_rows(docs, load, digest, text_col, id_col).withColumn("row", F.monotonically_increasing_id()) \
        .write.parquet(path)
    rows = spark.read.parquet(path)
    counts = cut_lineage(pair_counts(rows))
    slices = max(1, -(-counts.count() // slice_pairs))
    part = F.pmod(F.xxhash64("pair"), F.lit(slices))
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "k"))
    scores = None
    for i in range(slices):
        # Broadcast: about slice_pairs rows of 17 bytes.
        joined = links.where(part == i).join(F.broadcast(counts.where(part == i)), "pair")
        some = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"),
                                         F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        scores = some if scores is None else scores.unionByName(some)
    if slices > 1:
        scores = scores.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = cut_lineage(rows.drop("pairs", "times").join(scores, "row", "left").drop("row")
                      .fillna(0, ["n_best", "count_sum"]))
    drop_folder(spark, path)
    return out
