import random

from pyspark.sql import functions as F

from hydrospark.llm import chat


def test_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>\n", "\\", "\\\\<|", "<\\|", "<|>", None, "", "é𝄞\n\nline", "[[INST]]",
             "a" * 200_000]
    rows = [(c, t, r, x) for c, (r, x) in enumerate((r, x) for r in ("user", "assistant") for x in nasty) for t in (0, 1)]
    rows += [(99, i, ("user", "assistant", "system", None)[i % 4], nasty[i % len(nasty)]) for i in range(70)]
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (98, 1, "user", "same"), (98, 1, "user", "same")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    got = chat.format_conversations(df).select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    assert sorted(str(r["conv_id"]) for r in got) == sorted(map(str, by))
    for r in got:
        want = sorted(by[r["conv_id"]])
        assert [tuple(t) for t in r["turns"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(x for _, ro, x in want if ro == "assistant")
        bodies = r["formatted"].replace(chat.OPEN, "").replace(chat.CLOSE, "")
        assert not any(c in bodies for c in chat.CONTROLS)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_branches_match_brute_force(spark):
    r = random.Random(4)
    rows = []
    for tree in range(15):
        n = r.choice([1, 2, 9, 40])
        for i in range(n):
            parent = None if i == 0 else (i - 1 if r.random() < 0.6 else r.randrange(i))
            rows.append((f"t{tree}", i, parent, r.choice([None, 0.5, 1.0, 2.0])))
    rows.append(("t0", 500, 499, 9.0))  # its parent is missing: a root
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double")
    got = {}
    for x in chat.branches(df, best=2).collect():
        got.setdefault((x["tree"], x["leaf"]), []).append((x["depth"], x["id"]))
    want = {}
    for tree in {x[0] for x in rows}:
        node = {i: (p, s or 0.0) for t, i, p, s in rows if t == tree}
        paths = []
        for leaf in set(node) - {p for p, _ in node.values()}:
            path, at = [], leaf
            while at in node:
                path.append(at)
                at = node[at][0]
            paths.append((-sum(node[i][1] for i in path) / len(path), -len(path), leaf, path[::-1]))
        for _, _, leaf, path in sorted(paths)[:2]:
            want[tree, leaf] = list(enumerate(path))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_roles_are_reversible(spark):
    roles = ["us\ner", "\n", "\\n", "\\", "\\\n", "a\\\\\nb", "<|turn|>\n", "[INST]\n[/INST]", "n", "<\\n|", "<s>\\\n</s>", "", None]
    df = spark.createDataFrame([(i, 0, r, f"text {i}", 1, 2) for i, r in enumerate(roles)],
                               "conv_id long, turn long, role string, text string, formatted int, depth int")
    got = chat.format_conversations(df).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [tuple(x) for x in r["t"]] for r in got} == {i: [(r or "", f"text {i}")] for i, r in enumerate(roles)}
    assert all(r["formatted"].count("\n") == 2 for r in got)


def test_repeated_messages_count_once(spark):
    rows = [("t", 0, None, 0.0), ("t", 1, 0, 2.0), ("t", 1, 0, 1.0), ("t", 2, 0, 1.5), ("t", 2, 0, 1.5)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double")
    got = sorted(tuple(r) for r in chat.branches(df, best=2).collect())
    assert got == [("t", 1, 0, 0), ("t", 1, 1, 1), ("t", 2, 0, 0), ("t", 2, 2, 1)]
