"""Units of texts: tokens with character ends, sentence ends mapped to tokens, means over spans."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerroutes.functions.arrays import let
from layerroutes.functions.hashing import uniform

#: A sentence ends after . ! ? before white space or the end, after 。！？, and
#: after a run of newlines. Written as the empty places at which such a match ends.
ENDS = r"(?<=[.!?])(?=\s|\z)|(?<=[。！？])|(?<=\n)(?!\n)"


def spaced_tokens(docs: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, pos, token, char_end): pieces between single spaces, pos from 1, char_end the
    number of characters up to the end of the piece. Empty pieces count as tokens without
    characters."""
    pieces = F.split(F.coalesce(text, F.lit("")), " ")
    t = docs.select(ident, F.posexplode(pieces).alias("at", "token"))
    w = Window.partitionBy(ident).orderBy("at")  # one text
    return t.select(ident, (F.col("at") + 1).alias("pos"), "token", (F.sum(F.length("token")).over(w) + F.col("at")).alias("char_end"))


def match_ends(docs: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, end): characters up to the end of each sentence mark, from the lengths of the
    pieces between these places."""
    pieces = F.split(F.coalesce(text, F.lit("")), ENDS, -1)
    marked = let(pieces, lambda p: F.slice(p, 1, F.size(p) - 1))  # no mark ends the last piece
    p = docs.select(ident, F.posexplode(F.transform(marked, F.length)).alias("at", "n"))
    w = Window.partitionBy(ident).orderBy("at")  # one text
    return p.select(ident, F.sum("n").over(w).cast("long").alias("end"))


def sentence_ends(docs: DataFrame, tokens: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """(ident, token_end): for each sentence mark the first token whose characters end at or
    after it, and the last token; each once. Tokens without characters end no sentence.

    Marks and token ends of a text are one stream sorted by place, tokens after marks; a mark
    takes the next token, a running minimum over the stream from its end on, so that each row is
    met once. No mark meets more than its text."""
    at = tokens.where(F.length("token") > 0).select(ident, F.col("char_end").alias("place"), F.lit(1).alias("kind"), "pos")
    marks = match_ends(docs, ident, text).select(ident, F.col("end").alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("pos"))
    w = Window.partitionBy(ident).orderBy(F.desc("place"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    near = at.unionByName(marks).withColumn("token_end", F.min("pos").over(w)).where("kind = 0 and token_end is not null")
    last = tokens.groupBy(ident).agg(F.max("pos").alias("token_end"))
    return near.select(ident, "token_end").unionByName(last).distinct()


def span_means(vectors: DataFrame, ends: DataFrame, ident: str) -> DataFrame:
    """(ident, token_end, n, x): the mean of ``vectors(ident, pos, x)`` over each span of tokens
    from one end (exclusive) to the next (inclusive).

    Tokens and ends are one stream by place; a token belongs to the next end, so that spans are
    groups and their sums combine before they are shuffled."""
    rows = vectors.select(ident, "pos", F.lit(0).alias("kind"), "x")
    stops = ends.select(ident, F.col("token_end").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast(vectors.schema["x"].dataType).alias("x"))
    w = Window.partitionBy(ident).orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)  # from the end on
    stop = F.min(F.when(F.col("kind") == 1, F.col("pos"))).over(w)
    each = rows.unionByName(stops).withColumn("token_end", stop).where("kind = 0 and token_end is not null")
    sums = each.select(ident, "token_end", F.posexplode("x").alias("i", "v")).groupBy(ident, "token_end", "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    x = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])  # one vector
    return sums.groupBy(ident, "token_end").agg(F.max("n").alias("n"), x.alias("x"))


def last_vectors(vectors: DataFrame, ident: str, prompt: str | None = None) -> DataFrame:
    """(ident, x): the vector of the last unit, or of the last where boolean ``prompt`` is true."""
    rows = vectors.where(prompt) if prompt else vectors
    return rows.groupBy(ident).agg(F.max_by("x", "pos").alias("x"))


def drawn_positions(samples: DataFrame, ident: str, n: str, count: int, salt: str) -> DataFrame:
    """(ident, draw, pos): exactly ``count`` positions 1 to ``n`` a sample: different ones, first in
    a hash order, where there are so many, else draws that may repeat. Samples without positions
    have none."""
    draw = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw")
    short = samples.where(F.col(n).between(1, count - 1)).select(ident, n, draw)
    again = short.select(ident, "draw", (1 + F.floor(uniform(f"{salt}|again", F.col(ident), F.col("draw")) * F.col(n))).cast("int").alias("pos"))
    each = samples.where(F.col(n) >= count).select(ident, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("pos"))
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(uniform(salt, F.col(ident), F.col("pos")), "pos"))  # one sample
    return each.withColumn("draw", rank).where(F.col("draw") <= count).select(ident, "draw", "pos").unionByName(again)


def drawn_pairs(samples: DataFrame, ident: str, n: str, count: int, salt: str) -> DataFrame:
    """(ident, pos): up to ``count`` different adjacent pairs (pos, pos + 1) a sample; a sample of
    one position has none."""
    each = samples.where(F.col(n) >= 2).select(ident, F.explode(F.sequence(F.lit(1), F.col(n).cast("int") - 1)).alias("pos"))
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(uniform(salt, F.col(ident), F.col("pos")), "pos"))  # one sample
    return each.withColumn("_i", rank).where(F.col("_i") <= count).select(ident, "pos")


def token_kind(t: Column, special: Column) -> Column:
    """special, newline, whitespace, number (has a digit), text (has a letter) or symbol."""
    kind = F.when(special, "special").when(t.contains("\n"), "newline").when(~t.rlike(r"\S"), "whitespace")
    return kind.when(t.rlike(r"\p{Nd}"), "number").when(t.rlike(r"\p{L}"), "text").otherwise("symbol")


def fragment_category(t: Column, special: Column) -> Column:
    """What a piece of text is made of, white space around it aside."""
    s = F.regexp_replace(t, r"^\s+|\s+$", "")
    kind = F.when(special, "special_token").when(s == "", "whitespace")
    kind = kind.when(s.rlike(r"^[+−-]?\p{Nd}+([.,]\p{Nd}+)*$"), "number_fragment").when(s.rlike(r"^[+−*/=<>^%×÷≤≥≈±]+$"), "operator_fragment")
    kind = kind.when(s.contains("\\") | s.contains("$"), "latex_or_dollar_fragment").when(s.rlike(r"^\p{L}+$"), "alphabetic_fragment")
    return kind.when(~s.rlike(r"[\p{L}\p{N}]"), "punctuation_fragment").otherwise("mixed_or_other_fragment")
