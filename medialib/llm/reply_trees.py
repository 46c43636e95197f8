"""Reply trees: every path from a first message to a last reply is a conversation.

Messages name the message they answer. Links are doubled by self-joins: after round k a message knows the one 2^k above
it and the score of the stretch between, so trees of any depth take a logarithm of rounds. What the last round leaves is
each leaf's root, depth and score; branches are ranked by it. The chosen paths are then laid out by the same links from
the longest to the shortest, which names each message of a path once. Texts take no part in this: they are joined to the
finished paths.

A turn is written as ``<turn role>`` text ``</turn>``. Inside texts and roles the backslash and the two marks are
escaped, so no text holds a mark; all escapes start with a backslash, and every backslash starts one, so replacing them
in any order that does the backslash last reads the text back.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialib.functions.ranking import top_k
from medialib.llm.steps import Steps

#: Text and its escape, in the order of escaping; reading back goes the other way.
TURN, END = "<turn ", "</turn>"
ESCAPES = (("\\", "\\b"), (TURN, "\\t"), (END, "\\e"))
ROLE_ESCAPES = (*ESCAPES, (">", "\\g"))
LEARNED = "assistant"


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, escaped in escapes:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, escaped in reversed(escapes):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _links(nodes: DataFrame, steps: Steps) -> tuple[list[DataFrame], DataFrame]:
    """Links to the message 1, 2, 4, ... above, and ``(tree, id, root, depth, total)`` of messages with a root.

    Messages under a circle of replies never end; they have no root.
    """
    # ``up``: the message 2^k above, or null once ``root`` is known; ``depth`` and ``total`` count what lies between.
    known = nodes.select("tree", F.col("id").alias("up")).withColumn("_there", F.lit(True))
    asks = nodes.where("parent is not null").select("tree", "id", F.col("parent").alias("up"), "score")
    tops = nodes.where("parent is null").select("tree", "id", F.lit(None).cast("bigint").alias("up"), "score")
    held = _same(asks, known, "up").select("tree", "id", F.when(F.col("_there"), F.col("up")).alias("up"), "score")
    now = steps.settle(held.unionByName(tops).select(
        "tree", "id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), F.lit(1).cast("bigint").alias("depth"),
        F.col("score").alias("total")), "links-0")
    size = now.count()
    levels = []
    # Without a circle, a message less than 2^k deep has its root after round k.
    while 2 ** len(levels) <= max(size, 1):
        open_ = now.where("up is not null")
        if open_.isEmpty():
            break
        levels.append(open_.select("tree", "id", "up"))
        above = now.select("tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"),
                           F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        longer = _same(open_, above, "up").select(
            "tree", "id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("total") + F.col("_total")).alias("total"))
        now = steps.settle(now.where("up is null").unionByName(longer), f"links-{len(levels)}")
    return levels, now.where("root is not null").drop("up")


def _same(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on ``tree`` (null equals null) and ``key``."""
    right = right.withColumnsRenamed({"tree": "_tree", key: "_key"})
    return left.join(right, left["tree"].eqNullSafe(right["_tree"]) & (left[key] == right["_key"]), how).drop("_tree", "_key")


def branches(nodes: DataFrame, steps: Steps, keep: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``(tree, leaf, root, depth, score)`` of the paths from root to leaf, and the links they are laid out by.

    ``nodes``: ``(tree, id, parent, score)`` with one row an id. The score of a path is the mean of its messages';
    ``keep``: only so many paths a tree, best first (ties: smallest leaf).
    """
    levels, rooted = _links(nodes, steps)
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct().withColumn("_used", F.lit(True))
    paths = _same(rooted, parents, "id").where("_used is null").select(
        "tree", F.col("id").alias("leaf"), "root", "depth", (F.col("total") / F.col("depth")).alias("score"))
    if keep is not None:
        paths = top_k(paths, ["tree"], [F.desc("score"), F.asc("leaf")], keep)
    return paths, levels


def layout(paths: DataFrame, levels: list[DataFrame], steps: Steps) -> DataFrame:
    """``(tree, leaf, id, above)``: every message of every path, ``above`` steps over its leaf."""
    rows = paths.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("bigint").alias("above"))
    # A distance is a sum of powers of two in one way only, so largest steps first reach each message once.
    for k in range(len(levels) - 1, -1, -1):
        more = _same(rows, levels[k], "id", "inner").select("tree", "leaf", F.col("up").alias("id"), (F.col("above") + 2 ** k).alias("above"))
        rows = steps.settle(rows.unionByName(more), f"layout-{k}")
    return rows


def format_trees(messages: DataFrame, tree: str = "tree", id_col: str = "id", parent: str = "parent", role: str = "role",
                 text: str = "text", score: str | None = None, keep: int | None = None) -> DataFrame:
    """``(tree, leaf, score, formatted, turns)``, one row per chosen path from a root to a leaf.

    ``turns``: per turn the bounds of its text in ``formatted`` (code points, end not included) and whether loss is
    taken on it, which it is on ``assistant`` texts. Without ``score`` all messages score 0. ``keep``: the best paths of
    each tree by mean score (ties: smallest leaf); None: all.

    A parent that is null or not in the tree makes a root. Null text or role: empty; null score: 0; null tree: a tree
    of its own. Rows without an id are left out. Of rows with the same tree and id one counts: best score, then
    smallest role, then text. Messages that answer each other in a circle, and those below them, are on no path. An
    empty table: no rows. Other columns are not looked at, whatever their names. A path must fit a row.
    """
    steps = Steps(messages.sparkSession, "reply-trees")
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(
        F.col(tree).alias("tree"), F.col(id_col).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent"),
        value.alias("score"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .where("id is not null")
    rows = steps.settle(rows.groupBy("tree", "id").agg(F.min(F.struct(
        (-F.col("score")).alias("less"), "role", "text", "parent")).alias("m")).select(
            "tree", "id", "m.parent", (-F.col("m.less")).alias("score"), "m.role", "m.text"), "messages")
    paths, levels = branches(rows.select("tree", "id", "parent", "score"), steps, keep)
    paths = steps.settle(paths, "paths")
    turns = _same(layout(paths, levels, steps), rows.select("tree", "id", "role", "text"), "id", "inner")
    head = F.concat(F.lit(TURN), escape(F.col("role"), ROLE_ESCAPES), F.lit(">"))
    said = escape(F.col("text"))
    pieces = turns.select("tree", "leaf", "above", head.alias("head"), said.alias("said"),
                          (F.col("role") == LEARNED).alias("loss"))
    size = F.length("head") + F.length("said") + len(END)
    so_far = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    end = F.sum(size.cast("bigint")).over(so_far) - len(END)
    placed = pieces.withColumn("end", end).select(
        "tree", "leaf", F.struct((-F.col("above")).alias("at"), F.concat("head", "said", F.lit(END)).alias("piece"),
                                 (F.col("end") - F.length("said")).alias("start"), "end", "loss").alias("turn"))
    whole = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    formatted = whole.select("tree", "leaf", F.array_join(F.col("t.piece"), "").alias("formatted"),
                             F.arrays_zip(F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.loss").alias("loss")).alias("turns"))
    return _same(formatted, paths.select("tree", "leaf", "score"), "leaf", "inner") \
        .select("tree", "leaf", "score", "formatted", "turns")


def read_back(formatted: DataFrame, text: str = "formatted", turns: str = "turns") -> DataFrame:
    """``said`` and ``mask_fits`` added: turns as ``(role, text, loss)`` read from the formatted text and its mask.

    The mask fits if each of its bounds is where the text between two marks lies. An unreadable mask is an error of the
    caller's; bounds elsewhere give texts cut there.
    """
    pieces = F.split(F.col(text), END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    both = F.arrays_zip(pieces.alias("piece"), F.col(turns).alias("mask"))

    def said(p):
        body = F.right(p["piece"], (p["mask"]["end"] - p["mask"]["start"]).cast("int"))
        role = F.substring_index(p["piece"], ">", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(TURN) + 1)), ROLE_ESCAPES).alias("role"),
                        unescape(body).alias("text"), p["mask"]["loss"].alias("loss"))

    def fits(state, p):
        head = F.length(F.substring_index(p["piece"], ">", 1)) + 1
        after = state["at"] + F.length(p["piece"]) + len(END)
        right = (p["mask"]["start"] == state["at"] + head) & (p["mask"]["end"] == after - len(END))
        return F.struct(after.cast("bigint").alias("at"), (state["ok"] & F.coalesce(right, F.lit(False))).alias("ok"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(True).alias("ok"))
    return formatted.withColumn("_both", both).withColumns({
        "said": F.transform("_both", said), "mask_fits": F.aggregate("_both", zero, fits, lambda s: s["ok"])}).drop("_both")


def chain(turns: DataFrame, tree: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations told in turns: each answers the one before (equal turns: by role, then text)."""
    told = turns.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = told.withColumn("id", (F.row_number().over(order) - 1).cast("bigint")).drop("turn")
    return rows.withColumn("parent", F.when(F.col("id") > 0, F.col("id") - 1))


def digest(read: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, mask_fits)`` of what was read back."""
    told = F.array_join(F.transform("said", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("said", lambda s: s["loss"]), lambda s: s["text"]), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("said").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "mask_fits")
