"""Snippets: the window of a text that shows most of a query's phrases, hits in brackets.

A text's words become rows, so that windows over them count the phrases that begin in the next `size` words. Every
hit proposes the window that begins with it, and every sentence with a hit the one that begins with the sentence; a
phrase's first hit in a window weighs 1000, further ones 1, a sentence's beginning 100 and the text's 120. The first
window of the largest weight is shown; one that begins with a hit is moved back, so that its hits stand in its middle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.folding import MARKS, folded, phrases

SIZE = 12
# Brackets of a hit, the sign of text left out, weights.
OPEN, CLOSE, CUT = "[", "]", "…"
FIRST, AGAIN, SENTENCE, BEGINNING = 1000, 1, 100, 120
#: A word as it stands: letters, digits and private characters, with the marks that folding drops.
WORD = rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{MARKS}]*"
_GAP = r"[.:][ \t\n\r]+$"


def _begins(phrase: list[str], order) -> Column:
    """Whether the phrase begins at a word; `order` is the window of a text's words."""
    return reduce(lambda a, b: a & b, [(F.lead("token", i).over(order) if i else F.col("token")).eqNullSafe(w) for i, w in enumerate(phrase)])


def word_rows(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, gap, word, token, n, rest) of each word: what stands before it, itself, folded, the number of words, and
    behind the last one what follows it."""
    text = F.col(text_col)
    split = rows.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.split(text, WORD, -1).alias("gaps"))
    each = split.select("id", F.size("words").alias("n"), F.posexplode(F.transform("words", lambda w, i: F.struct(
        F.get("gaps", i).alias("gap"), w.alias("word"), F.when(i == F.size("words") - 1, F.get("gaps", i + 1)).alias("rest")))).alias("pos", "w"))
    return each.select("id", "pos", "n", "w.gap", "w.word", "w.rest", folded(F.col("w.word")).alias("token"))


def windows(words: DataFrame, query: str, size: int = SIZE) -> DataFrame:
    """(id, begin): the first word of each text's window; texts without a hit have none."""
    wanted = phrases(query)
    order = Window.partitionBy("id").orderBy("pos")
    ahead = order.rowsBetween(0, size - 1)
    starts = (F.col("pos") == 0) | F.col("gap").rlike(_GAP)
    marked = words.select("id", "pos", "n", starts.alias("starts"), *[_begins(p, order).cast("int").alias(f"h{i}") for i, p in enumerate(wanted)])
    places = range(len(wanted))
    weight = reduce(lambda a, b: a + b, [F.sum(f"h{i}").over(ahead) * AGAIN + F.max(f"h{i}").over(ahead) * (FIRST - AGAIN) for i in places])
    # where the last hit of the window ends, of hits of one place the last phrase's
    ends = [F.when(F.col(f"h{i}") == 1, F.struct("pos", F.lit(i).alias("phrase"), (F.col("pos") + len(p)).alias("end"))) for i, p in enumerate(wanted)]
    last = F.max(F.greatest(*ends, F.lit(None))).over(ahead)
    weighed = marked.select("id", "pos", "n", "starts", F.greatest(F.lit(0), *[F.col(f"h{i}") for i in places]).alias("hit"), weight.alias("weight"), last["end"].alias("end"))
    sentence = F.last(F.when(F.col("starts"), F.struct("pos", "weight")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    hits = weighed.withColumn("sentence", sentence).where("hit = 1")
    middle = F.col("pos") - F.expr(f"cast(({size} - (end - pos)) / 2 as int)")
    middle = F.greatest(F.lit(0), F.when(middle + size > F.col("n"), F.col("n") - size).otherwise(middle))
    own = F.struct(F.col("weight").alias("weight"), (-2 * F.col("pos")).alias("early"), middle.alias("begin"))
    whole = F.struct((F.col("sentence.weight") + F.when(F.col("sentence.pos") == 0, BEGINNING).otherwise(SENTENCE)).alias("weight"), (-2 * F.col("pos") - 1).alias("early"), F.col("sentence.pos").alias("begin"))
    best = F.when((F.col("n") > size) & (F.col("sentence.pos") < F.col("pos")), F.greatest(own, whole)).otherwise(own)
    return hits.groupBy("id").agg(F.max(best)["begin"].alias("begin"))


def snippets(rows: DataFrame, query: str, id_col: str = "id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, snippet) of each row; ids are unique.

    Text outside of the window is left out with an ellipsis; hits that touch no other hit have brackets of their own,
    those that overlap share them, and a hit cut by the window's end is closed there (one cut by its beginning isn't
    marked). A text without a hit, or a query without a word, shows its first words; null and empty texts show ''; a
    text without a word shows as it is. A text's words are ordered in one task, different texts in many.
    """
    wanted = phrases(query)
    texts = rows.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    words = word_rows(texts, "id", "text")
    begins = windows(words, query, size) if wanted else words.select("id", F.lit(0).alias("begin")).where("false")
    order = Window.partitionBy("id").orderBy("pos")
    reach = F.greatest(F.lit(-1), *[F.when(_begins(p, order), F.col("pos") + len(p) - 1) for p in wanted], F.lit(-1))
    reached = words.withColumn("reach", reach)
    # words up to the one before were marked to `before`
    before = F.coalesce(F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = reached.withColumn("before", before).withColumn("opens", (F.col("reach") >= 0) & (F.col("before") < F.col("pos")))
    held = marked.withColumn("run", F.when(F.greatest("reach", "before") >= F.col("pos"), F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(order)))
    ended = held.withColumn("closes", F.col("run").isNotNull() & (F.coalesce(F.lead("opens").over(order), F.lit(True)) | F.lead("run").over(order).isNull()))
    shown = ended.join(begins, "id", "left").withColumn("begin", F.coalesce("begin", F.lit(0))).where(f"pos between begin and begin + {size - 1}")
    end = F.col("pos") == F.col("begin") + size - 1
    inside = F.col("run") >= F.col("begin")
    piece = F.concat(F.when((F.col("pos") == F.col("begin")) & (F.col("begin") > 0), F.lit(CUT)).otherwise(F.col("gap")), F.when(F.col("opens"), OPEN).otherwise(""), F.col("word"),
                     F.when(inside & (F.col("closes") | end), CLOSE).otherwise(""), F.when(F.col("rest").isNotNull(), F.col("rest")).when(end, CUT).otherwise(""))
    made = shown.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"))
    return texts.join(made, "id", "left").select("id", F.coalesce(F.array_join(F.col("pieces.piece"), ""), F.col("text")).alias("snippet"))
