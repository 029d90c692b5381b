"""Chat formatting by quotation linking, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.session import discard, small_side, store

MARKS = r"^([ \t]*>)+"  # quote marks at the start of a line
ATTRIBUTION = r"(?i)\b(wrote|writes|said|a écrit|schrieb|escribió)\s*:\s*$"  # the line before a quote
PARAGRAPH = r"\n[ \t\r]*\n"  # blank lines between paragraphs
SPAN = 4096  # turns in a chunk of the search for the latest earlier message


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``own`` (the text without quotes), ``passages`` (level, text) and ``n_quoted`` lines.

    A passage is a run of lines of one quote level. A line that only names whom the quote below is from goes with
    it. Text without quotes is left as it is; null counts as empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
    frame = messages.withColumn("_lines", F.split(body, r"\r?\n")).withColumn("_levels", F.transform("_lines", level))
    frame = frame.withColumn("n_quoted", F.size(F.filter("_levels", lambda x: x > 0)))
    named = lambda x, i: x.rlike(ATTRIBUTION) & (F.coalesce(F.get("_levels", i + 1), F.lit(0)) > 0)
    kept = F.filter("_lines", lambda x, i: (F.get("_levels", i) == 0) & ~named(x, i))
    own = F.when(F.col("n_quoted") == 0, body).otherwise(F.trim(F.array_join(kept, "\n"), F.lit(" \t\r\n")))
    frame = frame.withColumn("own", own)
    bare = F.transform("_lines", lambda x: F.regexp_replace(x, MARKS + r"[ \t]?", ""))
    frame = frame.withColumn("_bare", F.when(F.col("n_quoted") > 0, bare))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_levels") - 1),
        lambda i: (i == 0) | (F.get("_levels", i) != F.get("_levels", F.greatest(i - 1, F.lit(0)))),
    )
    frame = frame.withColumn("_starts", F.when(F.col("n_quoted") > 0, starts))
    runs = F.transform(
        "_starts",
        lambda s, k: F.struct(
            F.get("_levels", s).alias("level"),
            F.slice("_bare", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_levels")) - s).alias("lines"),
        ),
    )
    passages = F.filter(runs, lambda r: r["level"] > 0)
    return frame.withColumn("passages", passages).drop("_lines", "_levels", "_bare", "_starts")


def _keys(lines: Column, wholes: Column) -> Column:
    """Normalised texts to look up: whole passages, their paragraphs, and single lines of any length."""
    texts = F.transform(F.concat(wholes, lines), normalised)
    return F.array_distinct(F.filter(texts, lambda x: F.length(x) > 0))


def _latest_earlier(asked: DataFrame, given: DataFrame) -> DataFrame:
    """``asked`` (conv_id, key, turn, ...) with ``parent``: the latest smaller turn of ``given`` with its key.

    Turns are cut into chunks: windows run inside a chunk, and chunk maxima carry over. So a line that
    fills a conversation is spread over tasks, and no pairs are made.
    """
    chunk = F.floor(F.col("turn") / SPAN)
    a = asked.withColumn("_chunk", chunk).withColumn("_given", F.lit(None).cast("long"))
    g = given.withColumn("_chunk", chunk).withColumn("_given", F.col("turn"))
    both = a.unionByName(g, allowMissingColumns=True)
    inside = Window.partitionBy("conv_id", "key", "_chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("conv_id", "key", "_chunk").agg(F.max("_given").alias("_max"))
    ends = ends.withColumn("_carry", F.max("_max").over(before)).select(
        F.col("conv_id").alias("_c"), F.col("key").alias("_k"), F.col("_chunk").alias("_h"), "_carry"
    )
    near = both.withColumn("_near", F.max("_given").over(inside)).filter("_given is null")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")) & (F.col("_chunk") == F.col("_h"))
    found = near.join(ends, same).withColumn("parent", F.coalesce("_near", "_carry"))
    return found.select(*asked.columns, "parent").filter("parent is not null")


def link_replies(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to`` of the messages ``conv_id, turn, own, passages`` that quote an earlier one.

    A quoted passage, paragraph or line names the latest earlier message of its conversation that holds the same
    normalised text outside quotes. The outermost quotes decide; of several messages the one with most quoted
    characters, then the latest. Messages without a turn neither quote nor are quoted.
    """
    placed = messages.filter("turn is not null")
    runs = placed.filter("n_quoted > 0").select("conv_id", "turn", F.explode("passages").alias("p"))
    passage = F.array_join("p.lines", "\n")
    keys = _keys(F.col("p.lines"), F.concat(F.array(passage), F.split(passage, PARAGRAPH)))
    asked = runs.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(keys).alias("_t"))
    asked = asked.select("conv_id", F.md5("_t").alias("key"), "turn", "level", F.length("_t").alias("chars")).distinct()
    # Few conversations quote: their ids go to the messages, whose texts then stay where they lie.
    quoting = small_side(runs.select(F.col("conv_id").alias("_conv")).distinct(), "quoting")
    sources = placed.select("conv_id", "turn", "own").join(quoting, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    wholes = F.concat(F.array("own"), F.split("own", PARAGRAPH))
    given = sources.select("conv_id", "turn", F.explode(_keys(F.split("own", r"\n"), wholes)).alias("_t"))
    given = given.select("conv_id", F.md5("_t").alias("key"), "turn").distinct()
    found = _latest_earlier(asked, given)
    votes = found.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("chars").alias("chars"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "parent")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.parent").alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, root, depth`` of replies: each round doubles how far a reply has looked back."""
    spark = replies.sparkSession
    state = replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth"))
    state, path = store(state, "threads")
    while True:
        up = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        step = state.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("root") == F.col("_t")), "left")
        step = step.select(
            "conv_id", "turn", "reply_to", F.coalesce("_root", "root").alias("root"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_t").isNotNull().alias("moved"),
        )
        stepped, new_path = store(step, "threads")
        moved = not stepped.filter("moved").isEmpty()
        discard(spark, path)
        state, path = stepped.drop("moved"), new_path
        if not moved:
            return state


def format_chats(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n_quoted, reply_to, root, depth``: one row per row of ``messages``.

    ``text`` has no quotes. Ordered by ``conv_id, root, depth, turn`` a conversation has every reply behind the
    message that it answers. A message that quotes nothing known is its own root at depth 0. Null texts
    are empty; rows that share conversation and turn each stay; a null conversation is one of its own;
    other columns are not carried. Messages are parsed once and stored.
    """
    parsed = parse(messages.select("conv_id", "turn", "role", "text"))
    parsed, _ = store(parsed.select("conv_id", "turn", "role", "own", "n_quoted", "passages"), "parsed")
    linked = threads(link_replies(parsed))
    linked = linked.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "reply_to", "root", "depth")
    linked = small_side(linked, "replies")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t"))
    return parsed.join(linked, same, "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "n_quoted", "reply_to",
        F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
