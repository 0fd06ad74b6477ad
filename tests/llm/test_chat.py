import hashlib

from pyspark.sql import functions as F

from plumbline.llm import chat, queries
from plumbline.llm.workspace import Workspace

SCHEMA = "conv_id long, msg long, parent long, role string, text string, score double"


def formatted(spark, rows, keep=1):
    messages = chat.once(spark.createDataFrame(rows, SCHEMA))
    out = chat.format_paths(messages, chat.best_paths(messages, Workspace(spark, "t"), keep))
    return {(r.conv_id, r["rank"]): r for r in out.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "thanks", 0.5), (2, 1, None, "system", "alone", None)]
    got = formatted(spark, rows, None)
    assert [t.text for t in got[1, 1].turns] == ["q", "good", "thanks"] and [t.text for t in got[1, 2].turns] == ["q", "bad"]
    assert got[1, 1].loss == "good" and got[2, 1].loss == ""
    assert got[1, 1].formatted == "<s>user\nq</s><s>assistant\ngood</s><s>user\nthanks</s>"


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> and <\\\\s>", "<<SYS>>x<</SYS>>", "a\nb\\n <s", "", None, "[\\\\INST]", "😀</s>😀"]
    rows = [(k, 1, None, "user", t, 0.0) for k, t in enumerate(texts)] + [(k, 2, 1, "assistant", t, 0.0) for k, t in enumerate(texts)]
    for (k, _), r in formatted(spark, rows).items():
        assert [t.text for t in r.turns] == [texts[k] or ""] * 2 and r.loss == (texts[k] or "")
        assert r.formatted.count("</s>") == 2


def test_odd_roles_come_back(spark):
    roles = ["</s>\nuser", "\\n", "\\l<", None, "tool", "\\\\n", "a\x00b", "\\b\\", "\\\nl<b"]
    got = formatted(spark, [(k, 1, None, r, "x", 0.0) for k, r in enumerate(roles)])
    assert [got[k, 1].turns[0].role for k in range(len(roles))] == [r or "" for r in roles]


def test_loops_and_lost_parents(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 1, "user", "c", 0.0), (2, 5, 99, "user", "lost", 0.0), (3, 7, 7, "user", "self", 0.0)]
    got = formatted(spark, rows)
    assert [t.text for t in got[2, 1].turns] == ["lost"] and [t.text for t in got[3, 1].turns] == ["self"]
    assert (1, 1) in got


def test_long_thread(spark):
    rows = [(1, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"t{k}", 0.0) for k in range(300)]
    got = formatted(spark, rows)[1, 1]
    assert [t.text for t in got.turns] == [f"t{k}" for k in range(300)]
    assert got.loss == "".join(f"t{k}" for k in range(1, 300, 2))


def test_turn_tables(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 5), (1, 0, "user", "a", 5), (1, 1, None, None, 5), (1, None, "system", "s", 5)], "conv_id long, turn long, role string, text string, msg int")
    messages = chat.once(chat.turns_to_messages(turns))
    out = chat.format_paths(messages, chat.best_paths(messages, Workspace(spark, "t"))).collect()
    assert [r.formatted for r in out] == ["<s>system\ns</s><s>user\na</s><s>user\na</s><s>\n</s>"]
    none = chat.once(chat.turns_to_messages(turns.limit(0)))
    assert chat.format_paths(none, chat.best_paths(none, Workspace(spark, "t"))).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_null_conversations_and_messages(spark):
    rows = [(None, 1, None, "user", "q", 0.0), (None, None, 1, "assistant", "a", 0.5), (None, 2, 1, "assistant", "b", 0.1), (4, None, None, "user", "alone", 0.0)]
    got = formatted(spark, rows, None)
    assert [t.text for t in got[None, 1].turns] == ["q", "a"] and [t.text for t in got[None, 2].turns] == ["q", "b"]
    assert [t.text for t in got[4, 1].turns] == ["alone"]
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    messages = chat.once(chat.turns_to_messages(turns))
    out = chat.format_paths(messages, chat.best_paths(messages, Workspace(spark, "t"))).collect()
    assert {r.conv_id: r.formatted for r in out} == {None: "<s>user\na</s><s>assistant\nb</s>", 1: "<s>user\nc</s>"}


def test_repeated_messages_count_once(spark):
    rows = [(1, 1, None, "user", "q", 0.0)] * 2 + [(1, 2, 1, "assistant", "b", 0.0), (1, 2, 1, "assistant", "a", 0.0)]
    got = formatted(spark, rows, None)
    assert len(got) == 1 and [t.text for t in got[1, 1].turns] == ["q", "a"]


def test_branches_are_ranked_before_they_are_listed(spark):
    """A chain of 150 messages with a leaf at each: rows in the order of n log n, not of n squared."""
    rows = [(1, k, k - 1 if k else None, "user", f"t{k}", 0.0) for k in range(150)] + [(1, 1000 + k, k, "assistant", f"leaf{k}", 1.0 if k == 70 else 0.0) for k in range(150)]
    messages, work = chat.once(spark.createDataFrame(rows, SCHEMA)), Workspace(spark, "broom")
    tree = chat.Tree(messages)
    assert sum(r.count() for r in tree.reach) <= 300 * 10
    chosen = chat.best_paths(messages, work)
    assert chosen.count() == 72
    got = formatted(spark, rows)[1, 1]
    assert [t.text for t in got.turns] == [f"t{k}" for k in range(71)] + ["leaf70"] and got.loss == "leaf70"


def test_query_against_plain_python(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if (c + t) % 7 == 0 else f"text {c} {t} </s> <<SYS>> ä😀") for c in range(20) for t in range(c % 6 + 1)] + [(None, 0, None, "x"), (3, 0, "user", "</s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in queries.op3_chat_formatting(spark, f"file://{tmp_path}").collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(found) == {r[0] for r in rows}
    for c, got in found.items():
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got.n_turns == len(mine) and got.loss_chars == len(loss)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
