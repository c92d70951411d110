import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from larder.llm import chat

TRICKY = st.text(alphabet="\\#</>turn: \nAa:ä", max_size=40)


@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_round_trip(turns):
    role = turns[0][0] if turns else "x"
    text, mask = chat.format_turns(turns, role)
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == role]
    assert text.count("</turn>") == len(turns)


def plain_paths(nodes, n_best):
    """Best root-to-leaf paths of every tree by walking up from each leaf."""
    trees = {}
    for tree, node, parent, role, text, score in nodes:
        trees.setdefault(tree, {})[node] = (parent, role, text, score)
    out = {}
    for tree, at in trees.items():
        parents = {p for p, *_ in at.values()}
        found = []
        for leaf in at:
            if leaf in parents:
                continue
            path, n = [], leaf
            while n in at and n not in path:
                path.append(n)
                n = at[n][0]
            if n in path:
                continue
            found.append((-sum(at[x][3] for x in path), -len(path), leaf, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(found)[:n_best], 1):
            out[tree, rank] = [(at[x][1] or "", at[x][2] or "") for x in path]
    return out


@pytest.mark.parametrize("n_best", [1, 3])
def test_trees_equal_walks(spark, n_best):
    rng = random.Random(n_best)
    nodes = []
    for tree in range(12):
        for node in range(rng.randint(1, 40)):
            parent = rng.choice([None, 999, *range(node)]) if rng.random() < 0.4 else max(0, node - 1) if node else None
            nodes.append((tree, node * 7, None if parent is None else parent * 7, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a </turn> #", "### user: x"]), float(rng.randint(0, 3))))
    nodes += [(50, 1, 2, "user", "cycle", 1.0), (50, 2, 1, "user", "cycle", 1.0)]
    nodes += [(51, i, i - 1, "assistant", f"t{i}", 1.0) for i in range(300)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double").repartition(3)
    got = {(r.tree, r["rank"]): chat.read_turns(r.formatted) for r in chat.format_trees(frame, n_best=n_best).collect()}
    assert got == plain_paths(nodes, n_best)


def test_digests_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (None, 0, None, "x"), (2, None, "assistant", "long " * 50_000), (2, 0, "user", "")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, node int")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.chains(frame))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1][1:5] == (3, sha("user\n\nassistant\nb\nassistant\nb\n"), 2, sha("bb"))
    assert got[None][1:5] == (1, sha("\nx\n"), 0, sha(""))
    assert got[2].loss_chars == 250_000 and len(got) == 3
    assert chat.digests(chat.format_trees(chat.chains(frame.limit(0)))).count() == 0
