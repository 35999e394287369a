import hashlib
import random

from pyspark.sql import functions as F

from loomspan.llm import chat as C

BITS = ["a", "é", "\\", "<", "|", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "[INST]", "<<SYS>>", "<\\|im_start|>", "\n", "[", "INST]", "<s", ">", "漢"]


def weird(rng, n=12):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, n)))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_linear_conversations_come_back(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<|im_sep|>b"]), rng.choice([None, "", weird(rng), weird(rng)]), "x") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "q", ""), (None, 1, "assistant", "r", ""), (77, None, "assistant", "first", ""), (77, 0, "user", "tie b", ""), (77, 0, "user", "tie a", ""), (78, 5, "assistant", "y" * 200_000, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.digest(df).collect()}
    convs = {}
    for c, t, role, text, _ in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        r = got[c]
        said = "".join(role + "\n" + text + "\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(said), len(loss), sha(loss))
    assert C.digest(df.limit(0)).count() == 0


def test_escape_is_exact_and_hides_control_strings(spark):
    rng = random.Random(4)
    texts = [weird(rng, 30) for _ in range(400)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect()
    for r in out:
        assert r.t == r.u and not any(s in r.e for s in C.CONTROL)


def brute(nodes):
    by = {n[1]: n for n in nodes}
    children = {n[2] for n in nodes}
    out = {}
    for tree, leaf, *_ in nodes:
        if leaf in children:
            continue
        path, at = [], leaf
        while at in by and at not in path:
            path.append(at)
            at = by[at][2]
        if at not in path:
            out[leaf] = (tree, [by[p] for p in reversed(path)])
    return out


def test_reply_trees(spark):
    rng = random.Random(5)
    nodes = []
    for tree in range(12):
        own = []
        for i in range(rng.randint(1, 40)):
            parent = rng.choice(own)[1] if own and rng.random() < 0.95 else None
            own.append((tree, f"{tree}-{i}", parent, rng.choice(["user", "assistant"]), weird(rng), rng.choice([None, 0.5, 1.0, -2.0])))
        nodes += own
    nodes += [(50, f"long-{i}", f"long-{i - 1}" if i else None, "user", str(i), 1.0) for i in range(70)]  # 70 in a chain
    nodes += [(51, "c1", "c2", "user", "x", 0.0), (51, "c2", "c1", "user", "x", 0.0), (51, "tail", "c1", "user", "x", 0.0), (52, "orphan", "gone", "user", "x", 0.0)]
    got = {r.leaf: r for r in C.format_trees(spark.createDataFrame(nodes, "tree long, node string, parent string, role string, text string, score double")).collect()}
    want = brute(nodes)
    assert set(got) == set(want) and "orphan" in got and "tail" not in got
    for leaf, (tree, path) in want.items():
        r = got[leaf]
        assert (r.tree, r.n_turns, r.score) == (tree, len(path), sum(p[5] or 0.0 for p in path))
        masked = [r.formatted[s.start : s.end] for s in r.loss]
        assert len(masked) == sum(p[3] == "assistant" for p in path)
        assert r.formatted.count(C.START) == len(path)
    for tree in {t for t, _ in want.values()}:
        order = sorted((-got[x].score, x) for x, (t, _) in want.items() if t == tree)
        assert [got[x].rank for _, x in order] == list(range(1, len(order) + 1))


def test_main_path_has_no_python(spark):
    plan = C.digest(C.probe(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
