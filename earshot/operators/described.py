"""Described sound: free text to feature weights and a tempo window, for a whole column of queries.

The lexicon is the caller's, as three tables of any size. Triggers of a hundred or so words are the usual case.
  terms     term (order of precedence), label, bpm_min, bpm_max (null is open)
  triggers  term, place (order within the term), word
  pushes    term, feature, weight
Synonyms are pairs word, trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that turn, strengthen or weaken what follows, endings that stems go without, and words that mean nothing here.
NEGATE = ["not ", "no ", "less ", "without ", "anti ", "non ", "never ", "minus ", "isn't ", "aint "]
INTENSIFY = ["very ", "super ", "really ", "so ", "extremely ", "mega ", "ultra ", "mad ", "insanely ", "hella "]
SOFTEN = ["slightly ", "kinda ", "kind of ", "a bit ", "bit ", "somewhat ", "lightly ", "a little ", "semi ", "mildly "]
ENDINGS = r"(?i)(iness|ness|ising|izing|ation|ing|ed|ly|ous|y|s)$"
STOP = "the and for with some that this music song songs tracks track play want need like feel feeling vibe vibes mood moods something anything stuff give make into from more really very kinda bit".split()
LIMIT = 2.0


def stem(c):
    return F.regexp_replace(c, ENDINGS, "")


def tempo_window(c):
    """Struct lo, hi of an explicit tempo, null without one; hi 0 is open."""
    n = lambda rule, k: F.regexp_extract(c, rule, k).try_cast("int")
    span, about = r"(\d{2,3})\s*[-–to]+\s*(\d{2,3})\s*bpm", r"(\d{2,3})\s*bpm"
    a, b, x = n(span, 1), n(span, 2), n(about, 1)
    window = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.when(a.isNotNull(), window(F.least(a, b), F.greatest(a, b))).when(x.isNotNull(), window(x - 6, x + 6))


def _deletions(c):
    """A word, and all it can become by leaving out one letter or two."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(c), less(c), F.flatten(F.transform(less(c), less))))


def bounded(row: DataFrame, c: str, most: int = 100_000) -> DataFrame:
    """A lexicon as one row for every task; one of more than most entries is an error."""
    return row.withColumn(c, F.when(F.size(c) <= most, F.col(c)).otherwise(F.raise_error(F.lit("the lexicon is too large"))))


def expanded(queries: DataFrame, triggers: DataFrame, synonyms: DataFrame) -> DataFrame:
    """id, q (lower case), said: q followed by the triggers its synonyms stand for, and by those that unknown words come close to.

    A word of four letters or more that is neither known nor a stop word takes the known word with its stem, or the nearest within one edit
    (two from six letters on). Candidates meet on stems and on what is left of words without a letter or two, so no text meets the whole lexicon.
    """
    q = queries.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("q"))
    meant = synonyms.groupBy().agg(F.sort_array(F.collect_list(F.struct("word", "trigger"))).alias("syn"))
    vocab = triggers.where("not contains(word, ' ')").select("word", F.col("word").alias("means")).union(synonyms.select("word", F.col("trigger").alias("means")))
    known = vocab.groupBy("word").agg(F.max("means").alias("means"))
    tokens = q.select(F.explode(F.split("q", "[^a-z0-9]+")).alias("tok")).distinct().where((F.length("tok") >= 4) & ~F.col("tok").isin(*STOP))
    unknown = tokens.join(known.select(F.col("word").alias("tok")), "tok", "left_anti")
    most = F.when(F.length("tok") <= 5, 1).otherwise(2)
    # Words of one stem, or within two edits of one another, share a key: the stem, or a word less two letters or fewer.
    keys = lambda c: F.concat(F.array(F.concat(F.lit("="), stem(c))), _deletions(c))
    words = unknown.select("tok", F.explode(keys(F.col("tok"))).alias("k")).join(known.select("word", "means", F.explode(keys(F.col("word"))).alias("k")), "k").select("tok", "word", "means").distinct()
    near = words.where((stem("tok") == stem("word")) | (F.levenshtein("tok", "word", 2) >= 0))
    near = near.withColumn("d", F.when(stem("tok") == stem("word"), 0).otherwise(F.levenshtein("tok", "word", 2))).where(F.col("d") <= most)
    best = near.groupBy("tok").agg(F.min(F.struct("d", "word", "means")).alias("b")).select("tok", F.col("b.means").alias("means"))
    found = q.select("id", F.explode(F.array_distinct(F.split("q", "[^a-z0-9]+"))).alias("tok")).join(best, "tok").groupBy("id").agg(F.sort_array(F.collect_list("means")).alias("fuzzy"))
    t = q.join(F.broadcast(bounded(meant, "syn")), F.lit(True)).join(found, "id", "left")
    more = F.transform(F.filter("syn", lambda s: F.contains(F.col("q"), s["word"])), lambda s: s["trigger"])
    return t.select("id", "q", F.array_join(F.concat(F.array("q"), more, F.coalesce("fuzzy", F.array().cast("array<string>"))), " ").alias("said"))


def matches(said: DataFrame, terms: DataFrame, triggers: DataFrame) -> DataFrame:
    """id, q, term, label, strength, bpm_min, bpm_max of the terms a text names: by their first trigger in it, turned, strengthened or weakened by the words before."""
    words = triggers.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("words"))
    lexicon = bounded(terms.join(words, "term").agg(F.collect_list(F.struct("term", "label", "bpm_min", "bpm_max", "words")).alias("all")), "all")
    named = F.filter("all", lambda x: F.exists(x["words"], lambda w: F.contains(F.col("said"), w)))
    t = said.join(F.broadcast(lexicon), F.lit(True)).select(*said.columns, F.explode(named).alias("x")).select(*said.columns, "x.*")
    t = t.withColumn("hit", F.get(F.filter("words", lambda w: F.contains(F.col("said"), w)), F.lit(0))).withColumn("at", F.instr("said", F.col("hit")))
    before = F.substr("said", F.greatest(F.lit(1), F.col("at") - 16), F.least(F.lit(16), F.col("at") - 1))
    ends = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.endswith(before, w))
    strength = F.when(F.col("at") <= 1, 1.0).when(ends(NEGATE), -1.0).when(ends(INTENSIFY), 1.6).when(ends(SOFTEN), 0.5).otherwise(1.0)
    return t.withColumn("strength", strength).select("id", "q", "term", F.concat(F.when(strength < 0, "not ").when(strength > 1, "very ").when(strength < 1, "slightly ").otherwise(""), F.col("label")).alias("label"), "strength", "bpm_min", "bpm_max")


def weights(named: DataFrame, pushes: DataFrame) -> DataFrame:
    """id, feature, weight: pushes of the named terms added up, between -2 and 2; those that cancel are left out."""
    w = named.join(pushes, "term").groupBy("id", "feature").agg(F.sum(F.col("weight") * F.col("strength")).alias("w"))
    return w.select("id", "feature", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("w"))).alias("weight")).where("weight <> 0")


def windows(named: DataFrame) -> DataFrame:
    """id, lo, hi (0 is open): the narrowest window of the terms that aren't negated, unless the text states a tempo; a window with nothing in it is open."""
    up = F.col("strength") > 0
    w = named.groupBy("id").agg(F.first("q").alias("q"), F.coalesce(F.max(F.when(up, F.col("bpm_min"))), F.lit(0)).alias("lo"), F.coalesce(F.min(F.when(up, F.col("bpm_max"))), F.lit(0)).alias("hi"))
    w = w.withColumn("said", tempo_window(F.col("q"))).select("id", F.coalesce("said.lo", "lo").alias("lo"), F.coalesce("said.hi", "hi").alias("hi"))
    void = (F.col("lo") > 0) & (F.col("hi") > 0) & (F.col("lo") > F.col("hi"))
    return w.select("id", *[F.when(void, 0).otherwise(F.col(c)).cast("int").alias(c) for c in ("lo", "hi")])


def suggestions(adjectives: DataFrame, scenes: DataFrame) -> DataFrame:
    """phrase: scenes alone and with every adjective (word, mood low, high or null) that doesn't clash with their mood. Both are short lists."""
    pairs = adjectives.select("word", F.col("mood").alias("m")).join(scenes.select("scene", "mood"), F.coalesce(F.col("m") == F.col("mood"), F.lit(True)))
    return scenes.select(F.initcap(F.substr("scene", F.lit(1), F.lit(1))).alias("a"), F.substr("scene", F.lit(2)).alias("b")).select(F.concat("a", "b").alias("phrase")).union(pairs.select(F.concat_ws(" ", "word", "scene"))).distinct()
