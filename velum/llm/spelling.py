"""Words that differ by one edit, found by walking a trie as a table.

The trie is an edge table: its nodes are the prefixes where words part or end, each edge
bears the letters up to the next node. A frontier of states (word, rest of the word, node,
edited) is joined with the edges of one level after the other. A word follows its own
edges; at each node it may leave them once, by a replaced or a dropped letter, and must
then meet its rest letter by letter. Edited states whose rest ends at a word's node are
pairs. Leaving is tried in one direction only (to the smaller letter, or to the shorter
word), as a pair is near from both sides.

Edges carry bitmaps of what lies below them, so states that cannot end are not written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from velum.llm.common import lower_ascii, stage

LETTER = "a-zÀ-ÿ"
#: Prefixes up to this length name their node themselves, longer ones by a digest.
PLAIN = 24
#: Lengths of the openings of the rests below a node that bitmaps are kept of; 0 is the whole rest.
LOOKS = (2, 4, 0)


def runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 1) -> DataFrame:
    """(key, run): every maximal run of letters that is so long, A-Z lower-cased; a text without one gives a NULL run."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), lower_ascii(F.col(f"`{text}`")).alias("text"))
    found = F.regexp_extract_all("text", F.lit(f"[{LETTER}]{{{least_length},}}"), F.lit(0))
    # outer: an inner explode is given a test for emptiness that searches the text a second time
    return rows.select("key", F.explode_outer(found).alias("run"))


def damaged(key: Column, run: Column, every: int = 199) -> Column:
    """``run`` without one letter where ``every`` divides the crc32 of ``<key>:<run>``; a NULL key counts as empty."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(found: DataFrame, *, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the ``word`` rows that are long and frequent enough, written once."""
    counts = found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return stage(stage(counts, "counts").where(F.length("word") >= least_length), "words")


def node(prefix: Column) -> Column:
    return F.when(F.length(prefix) <= PLAIN, prefix).otherwise(F.concat(F.lit("#"), F.sha2(prefix, 256)))


def bit(rest: Column, look: int) -> Column:
    part = rest if look == 0 else F.substring(rest, 1, look)
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(part), F.lit(64)).cast("int"))


def edges(words: DataFrame) -> DataFrame:
    """(level, node, first, label, child, ends, below_*), written once.

    ``level`` counts the edges from the root, ``ends`` is the word that ends at ``child``,
    ``below_*`` are bitmaps of the rests below it.
    """
    steps = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    rest = F.substring(F.col("word"), F.col("at") + 1, F.length("word"))
    steps = steps.select("word", "at", node(F.substring("word", F.lit(1), F.col("at"))).alias("node"), rest.alias("rest"))
    letter = F.substring("rest", 1, 1)  # empty where the word ends
    nodes = steps.groupBy("node").agg(
        F.min(letter).alias("low"), F.max(letter).alias("high"), F.max(F.when(F.col("rest") == "", F.col("word"))).alias("ends"),
        *[F.bit_or(bit(F.col("rest"), look)).alias(f"below_{look}") for look in LOOKS],
    )
    nodes = stage(nodes.where("low = '' OR low <> high").drop("low", "high"), "nodes")
    kept = steps.select("word", "at", "node").join(nodes, "node")
    chain = Window.partitionBy("word").orderBy("at")  # one word's letters
    before = F.coalesce(F.lag("at").over(chain), F.lit(0))
    kept = kept.withColumns({"from": before, "node": F.coalesce(F.lag("node").over(chain), F.lit("")), "child": F.col("node"), "level": F.row_number().over(chain) - 1})
    label = F.substring(F.col("word"), F.col("from") + 1, F.col("at") - F.col("from"))
    kept = kept.select("level", "node", F.substring(label, 1, 1).alias("first"), label.alias("label"), "child", "ends", *[f"below_{look}" for look in LOOKS])
    return stage(kept.dropDuplicates(["node", "first"]), "edges")


def pairs(words: DataFrame) -> DataFrame:
    """(a, b): every ordered pair of words that differ by exactly one inserted, dropped or replaced letter."""
    trie = edges(words)
    looks = [f"below_{look}" for look in LOOKS]
    frontier = words.select("word", F.col("word").alias("rest"), F.lit("").alias("node"), F.lit(False).alias("edited"))
    frontier = stage(frontier, "frontier")  # a written column: a literal would make the join a product
    found, level = None, 0
    while True:
        at = trie.where(F.col("level") == level).drop("level")
        if level < 2:  # all words meet at the root: its edges, and those of the next nodes, are as few as letters and their pairs
            at = F.broadcast(at)
        own = frontier.where("not edited").join(at, "node")
        c, rest, label = F.col("first"), F.col("rest"), F.col("label")
        n = F.length("label")

        def state(rest_: Column, edited: bool) -> Column:
            return F.struct(rest_.alias("rest"), F.lit(edited).alias("edited"))

        def after(k: Column) -> Column:
            return F.substring(rest, k + 1, F.length(rest))

        opening = F.substring(rest, 1, 1)
        tail, dropped = F.substring(label, F.lit(2), n), F.substring(rest, F.lit(2), F.length(rest))
        straight = F.when(c == opening, F.array(state(after(n), False)))
        replaced = F.when((c < opening) & F.startswith(dropped, tail), state(after(n), True))
        shorter = F.when((c != opening) & (c == F.substring(rest, 2, 1)) & F.startswith(dropped, label), state(after(n + 1), True))
        moves = F.coalesce(straight, F.filter(F.array(replaced, shorter), lambda s: s.isNotNull()))
        own = own.select("word", "child", "ends", *looks, F.inline(moves))
        edited = frontier.where("edited").withColumn("first", opening).join(at, ["node", "first"]).where(F.startswith(rest, label))
        edited = edited.select("word", "child", "ends", *looks, after(n).alias("rest"), "edited")
        moved = own.unionByName(edited)
        ended = F.when(F.col("edited"), rest == "").otherwise(F.length("rest") == 1)  # the last letter dropped
        below = F.lit(True)
        for look in LOOKS:
            below = below & (F.col(f"below_{look}").bitwiseAND(bit(rest, look)) != 0)
        goes_on = (rest != "") & (~F.col("edited") | below)
        moved = moved.select("word", "rest", F.col("child").alias("node"), "edited", F.when(ended, F.col("ends")).alias("other"), goes_on.alias("goes_on"))
        moved = stage(moved.where("goes_on OR other IS NOT NULL"), "frontier")
        new = moved.where("other IS NOT NULL").select(F.col("word").alias("a"), F.col("other").alias("b"))
        found = new if found is None else found.union(new)
        frontier = moved.where("goes_on").select("word", "rest", "node", "edited")
        level += 1
        if not frontier.limit(1).count():
            return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def forms(words: DataFrame, near: DataFrame, *, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, where it is ``ratio`` times as frequent.

    Ties go to the smallest word in code-point order.
    """
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = near.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "b")).alias("best"))
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    clear = -F.col("best.m") >= ratio * F.col("n")
    return stage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(clear, F.col("best.b")).alias("form"), F.when(clear, -F.col("best.m")).alias("form_n")), "forms")


def roots(rows: DataFrame) -> DataFrame:
    """``rows`` of ``forms`` with ``root``: the last word that forms lead to. Each round doubles the steps taken."""
    step = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not step.where("moved").limit(1).count():
            break
        step = step.select("word", "root")
    return rows.join(step.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5,
             ratio: int = 5, damage: int | None = None) -> DataFrame:
    """One row per word: word, n, form, root, form_n, n_near.

    Words are the runs of letters of all texts that have ``least_length`` letters and
    ``least_count`` occurrences; ``damage`` drops a letter of every so manieth run first.
    NULL and empty texts hold no word, repeated rows count each time, an empty table gives
    no row, and other columns are ignored. A run is read whole however long it is; the
    trie costs the square of a word's length.
    """
    found = runs(docs, key=key, text=text, least_length=least_length)
    word = F.col("run") if damage is None else damaged(F.col("key"), F.col("run"), damage)
    words = vocabulary(found.select(word.alias("word")), least_length=least_length, least_count=least_count)
    rows = roots(forms(words, pairs(words), ratio=ratio))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
