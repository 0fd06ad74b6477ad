"""Chat formatting from reply trees.

Messages with a parent form trees. Iterative self-joins that double the reach of each ancestor
pointer give every message its depth and the sum of scores up to its root in log2(depth) rounds. Leaves are
ranked by the mean score of their branch from these two numbers alone; only the branches that stay
are then listed message by message, by the kept pointers of the rounds, and each is formatted as one
conversation. So a tree of n messages takes rows in the order of n log n and of what is formatted.

Template, for each turn: `<s>` role `\\n` text `</s>`. A control string in a text (`<s>`, `</s>`, `[INST]`,
`[/INST]`, `<<SYS>>`, `<</SYS>>`) gets a backslash after its first character, one more than it had, which
unescaping takes off again. In a role, backslash, newline and `<` are written `\\b`, `\\n` and `\\l`.

Defined cases: null text or role is empty. A null conversation is one of its own, and a null message id is an
id like others, but nothing can reply to it, as a null parent is none. A message whose parent doesn't exist is a root, and so is
each message on a loop of replies. Messages that share (conversation, id) count once: the one that comes first by
parent, role, text and score. Rows of a turn table that share a turn, repeated ones too, are turns of their own and
follow each other by role and text. A null score counts as 0. Ties of score go to the smaller leaf id. An empty
table gives no rows. Texts of any length are read whole; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.workspace import Workspace, files_of

CONTROL = r"(/?s>|/?INST\]|<SYS>>|</SYS>>)"
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) where null equals null."""
    named = right.select(*[F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return left.join(named, same, how).drop(*[f"__{c}" for c in keys])


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as chains: each row replies to the row before it."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg", rank.cast("long"))
    return rows.select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def once(messages: DataFrame) -> DataFrame:
    """One row (conv_id, msg, parent, role, text, score) for each message."""
    row = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    return messages.groupBy("conv_id", "msg").agg(F.min(row).alias("m")).select("conv_id", "msg", "m.*")


class Tree:
    """Depth and sum of scores of each message (`ends`), and pointers that reach 1, 2, 4, ... messages up
    (`reach`, a table a round)."""

    def __init__(self, messages: DataFrame):
        self.work = Workspace(messages.sparkSession, "tree")
        there = messages.select("conv_id", F.col("msg").alias("parent"), F.lit(True).alias("known"))
        keys = messages.select("conv_id", "msg", "parent", "score")
        known = joined(keys, there, ["conv_id", "parent"], "left")
        tree = known.select("conv_id", "msg", F.when(F.col("known") & ~F.col("parent").eqNullSafe(F.col("msg")), F.col("parent")).alias("parent"), "score")
        self.files = files_of(messages.count())
        self.tree = self.work.save(tree, "tree", files=self.files)
        while not self._double():
            pass

    def _double(self) -> bool:
        """False where a loop was cut, and all has to be done again."""
        self.reach: list[DataFrame] = []
        state = self.tree.select("conv_id", "msg", F.col("parent").alias("to"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
        longest = self.tree.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        done = state.where("to is null")
        state = state.where("to is not null")
        for n in range(longest.bit_length() + 2):
            if state.isEmpty():
                self.ends = done.select("conv_id", "msg", "depth", "total")
                return True
            self.reach.append(state.select("conv_id", "msg", "to"))
            over = state.unionByName(done).select("conv_id", F.col("msg").alias("to"), F.col("to").alias("over"), F.col("depth").alias("more"), F.col("total").alias("above"))
            further = self.work.save(joined(state, over, ["conv_id", "to"]).select("conv_id", "msg", F.col("over").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("above")).alias("total")), f"state{n}", small=True, files=self.files)
            done, state = done.unionByName(further.where("to is null")), further.where("to is not null")
        # No path is so long: what still points somewhere points into a loop.
        loop = state.select("conv_id", F.col("to").alias("msg")).distinct().withColumn("loop", F.lit(True))
        cut = joined(self.tree, loop, ["conv_id", "msg"], "left")
        self.work = Workspace(self.work.spark, "loops")
        self.tree = self.work.save(cut.withColumn("parent", F.when(F.col("loop").isNull(), F.col("parent"))).drop("loop"), "tree", files=self.files)
        return False


def best_paths(messages: DataFrame, work: Workspace, keep: int | None = 1) -> DataFrame:
    """(conv_id, leaf, rank, msg, turn) of the `keep` best branches by mean score (None: all). messages: as from once."""
    tree = Tree(messages)
    used = tree.tree.where("parent is not null").select("conv_id", F.col("parent").alias("msg")).distinct()
    leaves = joined(tree.ends, used, ["conv_id", "msg"], "left_anti")
    # Scores are added up in another order for each depth: sums are told apart to nine digits.
    mean = F.round(F.col("total") / F.col("depth"), 9)
    branch = leaves.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(mean.desc(), F.col("msg").asc_nulls_first())))
    if keep is not None:
        branch = branch.where(F.col("rank") <= keep)
    found = work.save(branch.select("conv_id", F.col("msg").alias("leaf"), "rank", "msg", (F.col("depth") - 1).alias("turn")), "leaves", small=True, files=tree.files)
    for n, reach in enumerate(tree.reach):
        further = joined(found, reach, ["conv_id", "msg"]).select("conv_id", "leaf", "rank", F.col("to").alias("msg"), (F.col("turn") - (1 << n)).alias("turn"))
        found = work.save(found.unionByName(further), f"paths{n}", small=True, files=tree.files)
    return found


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, formatted, mask): mask lists (start, length) in code points, from 0, of
    the assistant texts as they stand in formatted."""
    rows = joined(chosen, messages.select("conv_id", "msg", "role", "text"), ["conv_id", "msg"])
    rows = rows.select("conv_id", "leaf", "rank", "turn", "role", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    whole = len(OPEN) + F.length("r") + 1 + F.length("t") + len(CLOSE)
    end = F.sum(whole).over(W.partitionBy("conv_id", "leaf", "rank").orderBy("turn"))
    rows = rows.withColumn("start", end - len(CLOSE) - F.length("t"))
    x = F.struct("turn", F.concat(F.lit(OPEN), "r", F.lit("\n"), "t", F.lit(CLOSE)).alias("line"), (F.col("role") == "assistant").alias("masked"), F.col("start").cast("long").alias("start"), F.length("t").cast("long").alias("length"))
    rows = rows.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(x)).alias("x"))
    spans = F.transform(F.filter("x", lambda x: x["masked"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return rows.select("conv_id", "leaf", "rank", F.array_join(F.transform("x", lambda x: x["line"]), "").alias("formatted"), spans.alias("mask"))


def parse_turns(formatted: Column) -> Column:
    """The turns read back from the output: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"</s>"), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substr(body(p), F.lit(1), F.locate("\n", body(p)) - 1)).alias("role"), unescape(F.substr(body(p), F.locate("\n", body(p)) + 1)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"].cast("int") + 1, m["length"].cast("int")))), "")
