"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found per text; their value hashes are aggregated over the
corpus by distinct repositories and owners. A value that many owners share is
a widely copied example, one that few owners hold and that looks random is a
live-looking credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import broadcast_if_small, cut_lineage, text_key, without

# The kinds in order, with their patterns.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",  # greedy runs, so the length can stand in the pattern
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_MIN = 6
KINDS = ("assign", "access", "hex", "copied", "live")
_ANY = "|".join(PATTERNS.values())
_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _blocks(items: Column) -> Column:
    """``items`` cut into about sqrt(n) blocks of sqrt(n): running values are
    carried over the blocks, then within each, so that a text with very many
    matches costs n * sqrt(n) copies instead of n * n."""
    k = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    last = F.greatest(F.ceil(F.size(items) / k).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * k + 1, k))


def _running(blocks: Column, step) -> Column:
    """``step(value, block)`` folded over the blocks from 0: the value before each block."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(blocks, zero, lambda acc, b: F.struct(
        step(acc["at"], b).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind, leftmost non-overlapping: the text is cut at the
    matches, and running lengths of cuts and matches give the positions."""
    pattern, rank = F.lit(PATTERNS[kind]), KINDS.index(kind)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    gaps = F.split(text, PATTERNS[kind], -1)
    steps = F.transform(F.arrays_zip(gaps, found, values).cast("array<struct<gap:string,hit:string,value:string>>"),
                        lambda s: F.struct(F.length(s["gap"]).alias("gap"), F.length(s["hit"]).alias("hit"),
                                           s["value"].alias("value")))

    def after(at, s):
        return at + s["gap"] + F.coalesce(s["hit"], F.lit(0))

    def add(acc, s):
        start, end = acc["at"] + s["gap"], after(acc["at"], s)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), s["value"].alias("value"))
        long_enough = F.length(s["value"]) >= (ASSIGN_MIN if kind == "assign" else 1)
        return F.struct(end.alias("at"),
                        F.when(s["hit"].isNotNull() & long_enough, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    def spans(z):
        zero = F.struct(z["at"].alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
        return F.aggregate(z["block"], zero, add, lambda acc: acc["out"])

    # Bound once, as elements of one-element arrays: a lambda evaluates what it captures for every element.
    cut = F.transform(F.array(steps), _blocks)
    placed = F.transform(cut, lambda bs: F.arrays_zip(
        bs.alias("block"), _running(bs, lambda at, b: F.aggregate(b, at, after)).alias("at")))
    named = placed.cast("array<array<struct<block:array<struct<gap:int,hit:int,value:string>>,at:int>>>")
    return F.flatten(F.transform(F.flatten(named), spans))


def base_spans(text: Column) -> Column:
    """All spans by the fixed patterns (start, kind rank, end, value), in order."""
    some = F.concat(*[_kind_spans(text, k) for k in PATTERNS])
    return F.when(text.rlike(_ANY), F.array_sort(some)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _live_looking(value: Column) -> Column:
    """Has a digit and at least 8 different characters."""
    return value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def _secret_shaped(value: Column, rank: Column) -> Column:
    """Access keys and hex runs by their shape alone; an assigned value if its
    characters have at least half the entropy that its length allows."""
    n = F.length(value)

    def entropy(chars):
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (
            F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))

    # Bound once, as the element of a one-element array.
    bits = F.get(F.transform(F.array(F.split(value, "")), entropy), F.lit(0))
    return (rank != KINDS.index("assign")) | (bits >= F.log2(n) / 2)


def ownership(candidates: DataFrame) -> DataFrame:
    """``n_owners`` and ``n_repos`` per ``hash`` from rows (hash, owner, repo).

    Distinct counting in three steps of partial aggregates, so a value copied
    into a third of all rows is summed map-side and never gathered."""
    return (candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"))
            .groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repos")))


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source",
                 repo_col: str | None = None, min_owners: int = 3, min_repos: int = 3,
                 by_text: bool = False, thorough: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``_text_hash``/``_text_bytes``,
    ``found``: array of (start, rank, end, value, n_owners, n_repos, class),
    by start, then kind, and ``marks``: the different (start, rank, end) of
    values with a class. Positions are code points, ends exclusive.

    ``class`` is ``copied`` for a value with at least ``min_owners`` owners in
    at least ``min_repos`` repositories, else ``live`` if it looks random, else
    null. A repository is (owner, ``repo_col``), by default the document. With
    ``by_text`` (and ``thorough``) all texts that are equal are one repository,
    whatever their owners, so copies of one document make nothing an example.
    With ``thorough`` a value looks random by its kind (``_secret_shaped``).

    Null texts count as empty. A null owner is an owner of its own, and so is a
    null repository. Repeated rows are scanned each; equal (owner, repository)
    pairs count once. Very long texts are scanned whole. Other columns are
    ignored. An empty table gives an empty result. Only rows with candidates
    are joined; the texts themselves are never shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), *text_key(F.col(f"`{text_col}`")),
                       F.col(f"`{owner_col}`").cast("string").alias("owner"),
                       F.col(f"`{repo_col or id_col}`").cast("string").alias("repo"), base_spans(text).alias("spans"))
    base = cut_lineage(base.withColumn("_row", F.monotonically_increasing_id()))
    content = F.concat_ws(":", "_text_hash", "_text_bytes")
    hits = base.select("_row", "owner", "repo", content.alias("content"), F.explode("spans").alias("s")).select(
        "_row", "owner", "repo", "content", "s.*", F.sha2("s.value", 256).alias("hash"))
    seen = ownership(hits)
    if by_text or thorough:
        texts = hits.select("hash", F.col("content").alias("owner"), F.lit("").alias("repo"))
        seen = seen.drop("n_repos").join(ownership(texts).select("hash", F.col("n_owners").alias("n_repos")), "hash")
    random = _secret_shaped(F.col("value"), F.col("rank")) if thorough else _live_looking(F.col("value"))
    cls = (F.when((F.col("n_owners") >= min_owners) & (F.col("n_repos") >= min_repos), "copied")
           .when(random, "live"))
    mark = F.when(F.col("class").isNotNull(), F.struct(
        (F.col("end") - F.length("value")).alias("start"),
        F.when(F.col("class") == "copied", KINDS.index("copied")).otherwise(KINDS.index("live")).alias("rank"),
        F.col("end")))
    found = (hits.join(seen, "hash").withColumn("class", cls).groupBy("_row")
             .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "value", "n_owners", "n_repos", "class")))
                  .alias("found"), F.array_sort(F.collect_set(mark)).alias("marks")))
    none = [F.coalesce(c, F.expr(f"cast(array() as {found.schema[c].dataType.simpleString()})")).alias(c)
            for c in ("found", "marks")]
    return (base.join(found, "_row", "left")
            .select(F.col("_id").alias(id_col), "_text_hash", "_text_bytes", *none))


def is_kind(kind: str):
    """Predicate on (start, rank, ...) structs."""
    return lambda s: s["rank"] == KINDS.index(kind)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of (start, rank, end) structs, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(found: Column, marks: Column) -> Column:
    """The base spans and, over each value, a span that names its class."""
    base = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"),
                                                 s["end"].alias("end")))
    return F.array_sort(F.concat(base, marks))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source",
           length_col: str | None = "n_chars", mark: str = "[SECRET]", small_rows: int = 1_000_000, **limits) -> DataFrame:
    """``docs`` with every live-looking value replaced by ``mark``; copied
    examples and all other text stay, as do all rows and columns.

    ``length_col``, if the table has it, gets the new length of changed texts.
    Rows of equal id and text are changed alike. Null and empty texts stay.
    """
    scanned = scan_secrets(docs, text_col, id_col, owner_col, **limits)
    live = F.filter("marks", is_kind("live"))
    cuts = cut_lineage(scanned.withColumn("_cuts", live).where("size(_cuts) > 0")
                       .select(F.col(f"`{id_col}`").alias("_cut_id"), F.col("_text_hash").alias("_cut_hash"),
                               F.col("_text_bytes").alias("_cut_bytes"), "_cuts")
                       .dropDuplicates(["_cut_id", "_cut_hash", "_cut_bytes"]))
    cuts = broadcast_if_small(cuts, small_rows)
    text = F.col(f"`{text_col}`")
    h, n = text_key(text)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_cut_id")) & (h == F.col("_cut_hash")) & (n == F.col("_cut_bytes"))
    joined = docs.join(cuts, same, "left").drop("_cut_id", "_cut_hash", "_cut_bytes")

    def end_of(at, block):
        return F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))

    # Spans may overlap (a hex run inside an assignment): each adds what lies beyond the last end.
    def masked(z):
        def add(acc, s):
            gap = F.greatest(s["start"] - acc["at"], F.lit(0))
            return F.struct(F.concat(acc["out"], F.substring(z["part"], acc["at"] - z["at"] + 1, gap),
                                     F.when(s["start"] >= acc["at"], mark).otherwise("")).alias("out"),
                            F.greatest(s["end"], acc["at"]).alias("at"))

        zero = F.struct(F.lit("").alias("out"), z["at"].alias("at"))
        return F.aggregate(z["block"], zero, add, lambda acc: acc["out"])

    # The text is cut by blocks of spans first, so no span searches the whole text.
    placed = F.transform(F.transform(F.array("_cuts"), _blocks), lambda bs: F.arrays_zip(
        bs.alias("block"), _running(bs, end_of).alias("at")))
    placed = F.flatten(placed.cast("array<array<struct<block:array<struct<start:int,rank:int,end:int>>,at:int>>>"))
    parts = F.transform(placed, lambda z: F.struct(
        z["block"].alias("block"), z["at"].alias("at"),
        F.substring(text, z["at"] + 1, end_of(z["at"], z["block"]) - z["at"]).alias("part")))
    rest = F.array_max(F.transform("_cuts", lambda s: s["end"]))
    cut = F.concat(F.array_join(F.transform(parts, masked), ""), F.substring(text, rest + 1, F.length(text)))
    changed = F.when(F.col("_cuts").isNotNull(), cut).otherwise(text)
    out = joined.withColumn("_new", changed)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("_new").alias(c))
        elif length_col and c.lower() == length_col.lower():
            cols.append(F.when(F.col("_cuts").isNotNull(), F.length("_new").cast(docs.schema[c].dataType))
                        .otherwise(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return without(out.select(*cols))
