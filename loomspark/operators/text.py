"""Text statistics as column expressions; classes of characters are those of ASCII unless letters are meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from ..storage import materialize

#: English words that say little.
STOP_WORDS = tuple("a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split())
#: What marks an email address, a link, a phone number, a date, a time and an amount of money.
PATTERNS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "url": r"(?i)(https?://|www\.)[^ \t\n]+",
    "phone": r"(?<![A-Za-z0-9_])[0-9]{3}[-. ]?[0-9]{3}[-. ]?[0-9]{4}(?![A-Za-z0-9_])",
    "date": r"(?<![A-Za-z0-9_])([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![A-Za-z0-9_])",
    "time": r"(?<![A-Za-z0-9_])[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?(?![A-Za-z0-9_])",
    "currency": r"(?i)[$€£¥][ ]?[0-9]|[0-9] ?(usd|eur|gbp)",
}


#: What a text with such a pattern has for certain.
MARKS = {"email": "@", "time": ":"}


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class (as in a regular expression's brackets) a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def count_each(text: Column, chars: str) -> Column:
    """How many of these ASCII characters a text has."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t\n\r\f\x0B]+"), "")


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits: each different character, from the first on, is taken out of what is left and counted by the bytes that go with it."""
    n = F.length(text).cast("double")
    start = F.struct(text.alias("left"), F.octet_length(text).alias("bytes"), F.lit(1).alias("width"), F.lit(0.0).alias("part"))  # bytes: before the last character, of this width, went

    def part(acc):
        k = (acc["bytes"] - F.octet_length(acc["left"])) / acc["width"]
        return acc["part"] + F.when(k > 0, k * F.log2(k)).otherwise(0.0)

    take = lambda acc, c: F.struct(F.replace(acc["left"], c, F.lit("")).alias("left"), F.octet_length(acc["left"]).alias("bytes"), F.octet_length(c).alias("width"), part(acc).alias("part"))
    chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
    return F.when(n > 0, F.log2(n) - F.aggregate(chars, start, take, part) / n).otherwise(0.0)


def text_features(df: DataFrame, col: str, patterns: bool = True, complexity: bool = True) -> DataFrame:
    """Lengths, counts and shares of kinds of characters, flags, patterns, sentences and vocabulary of a text column; null counts as empty."""
    df = df.withColumns({"_s": F.coalesce(F.col(col), F.lit("")), "_ws": words(F.coalesce(F.col(col), F.lit("")))})  # cut once
    s, ws = F.col("_s"), F.col("_ws")
    n, count = F.length(s), F.size(ws)
    per = F.greatest(n, F.lit(1))
    new = {"length": n, "word_count": count, "avg_word_length": F.when(count > 0, (n - count_of(s, r" \t\n\r\f\x0B")) / F.greatest(count, F.lit(1))).otherwise(0.0)}
    counts = {k: count_of(s, v) for k, v in {"digit": "0-9", "upper": "A-Z", "lower": "a-z", "space": r" \t\n\r\f\x0B"}.items()}
    counts["special_char"] = n - counts["digit"] - counts["upper"] - counts["lower"] - counts["space"]
    counts["punctuation"] = counts["special_char"] - count_each(s, "_")
    new |= {f"{k}_count": v for k, v in counts.items()}
    new |= {f"{k}_ratio": counts[k] / per for k in ("digit", "upper", "lower", "punctuation", "space")}
    new |= {"is_empty": n == 0, "is_numeric": s.rlike(r"^[0-9]+$"), "is_alpha": s.rlike(r"^\p{L}+$"), "is_alphanumeric": s.rlike(r"^[\p{L}\p{N}]+$"), "starts_with_capital": s.rlike(r"^\p{Lu}")}
    new |= {"is_all_caps": (F.upper(s) == s) & (F.lower(s) != s), "is_all_lower": (F.lower(s) == s) & (F.upper(s) != s)}
    if patterns:
        new |= {f"has_{k}": s.contains(MARKS[k]) & s.rlike(v) if k in MARKS else s.rlike(v) for k, v in PATTERNS.items()}
        new |= {"hashtag_count": F.size(F.split(s, "#[A-Za-z0-9_]")) - 1, "mention_count": F.size(F.split(s, "@[A-Za-z0-9_]")) - 1}
    if complexity:
        sentences = F.size(F.split(s, "[.!?]+")) - 1
        unique = F.size(F.array_distinct(F.transform(ws, F.lower)))
        new |= {"sentence_count": sentences, "question_count": count_each(s, "?"), "exclamation_count": count_each(s, "!"), "has_question": s.contains("?"), "parentheses_count": count_each(s, "()"), "quote_count": count_each(s, "\"'")}
        new |= {"unique_word_count": unique, "vocabulary_richness": unique / F.greatest(count, F.lit(1)), "avg_sentence_length": count / F.greatest(sentences, F.lit(1)), "char_entropy": char_entropy(s)}
    return df.withColumns({f"{col}_{k}": v.cast("int") if k.startswith(("is_", "has_", "starts_")) else v for k, v in new.items()}).drop("_s", "_ws")


def char_codes(df: DataFrame, col: str) -> DataFrame:
    """{col}_char_mean and {col}_char_std (population) of the code points; 0 for empty and null texts."""
    s = F.coalesce(F.col(col), F.lit(""))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    code = lambda c: F.ascii(c).cast("double")
    sums = F.aggregate(F.split(s, ""), start, lambda a, c: F.struct((a["s"] + code(c)).alias("s"), (a["q"] + code(c) * code(c)).alias("q")))
    n = F.greatest(F.length(s), F.lit(1))
    out = df.withColumn("_c", sums)
    mean = F.col("_c.s") / n
    return out.withColumns({f"{col}_char_mean": mean, f"{col}_char_std": F.sqrt(F.greatest(F.col("_c.q") / n - mean * mean, F.lit(0.0)))}).drop("_c")


#: Words that pairs are looked for among, at most; beyond, all pairs are counted.
MOST_WORDS = 5_000


def tf_idf(df: DataFrame, id_col: str, col: str, top: int = 100, min_docs: int = 2, max_share: float = 0.95, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term, weight): term counts times ln((1 + N) / (1 + df)) + 1, each text scaled to length 1.

    Terms are one word of two letters or digits at least, or two such in a row, stop words left out; of those in min_docs texts at
    least and in max_share of them at most, the `top` most frequent count (ties by name). Ids are taken to be unique.
    """
    ws = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    docs = materialize(spread(df.select(F.col(id_col).alias("id"), F.col(col).alias("text"))).select("id", ws.alias("ws")), "words")
    total = docs.count()
    fits = (F.col("docs") >= min_docs) & (F.col("docs") <= max_share * total)
    ones = materialize(_uses(docs, F.col("ws")), "word-uses")
    # a pair is used no more often than either word: below the last of the best words, no pair can be among the best terms
    least = ones.where(fits).orderBy(F.desc("uses")).limit(top).agg(F.min("uses").alias("u"), F.count("*").alias("n")).first()
    bar = least["u"] if least["n"] == top else 0
    often = [r[0] for r in ones.where(F.col("uses") >= bar).select("term").limit(MOST_WORDS + 1).collect()]
    first, second = (F.slice("ws", i, F.greatest(F.size("ws") - 1, F.lit(0))) for i in (1, 2))
    words, pairs = F.col("ws"), F.arrays_zip(first.alias("a"), second.alias("b"))
    if len(often) <= MOST_WORDS:
        words, pairs = F.filter(words, lambda w: w.isin(*often)), F.filter(pairs, lambda p: p["a"].isin(*often) & p["b"].isin(*often))
    kept = materialize(docs.select("id", F.concat(words, F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))).alias("terms")), "kept-terms")
    terms = _uses(kept, F.col("terms")).where(fits).orderBy(F.desc("uses"), "term").limit(top)
    terms = materialize(terms, "terms")  # a report's length, so it may be broadcast
    counts = kept.select("id", F.explode("terms").alias("term")).join(F.broadcast(terms.select("term")), "term").groupBy("id", "term").agg(F.count("*").alias("n"))
    idf = F.log((1 + F.lit(total)) / (1 + F.col("docs"))) + 1
    raw = counts.join(F.broadcast(terms), "term").withColumn("w", F.col("n") * idf)
    return raw.select(F.col("id").alias(id_col), "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("weight"))


def _uses(docs: DataFrame, terms: Column) -> DataFrame:
    """(term, uses, docs): how often terms occur, and in how many texts; tasks count first, and no text's terms are shuffled."""
    each = docs.select(F.explode(terms).alias("term"), F.lit(1).alias("u"), F.lit(0).alias("d")).unionByName(docs.select(F.explode(F.array_distinct(terms)).alias("term"), F.lit(0).alias("u"), F.lit(1).alias("d")))
    return each.groupBy("term").agg(F.sum("u").alias("uses"), F.sum("d").alias("docs"))
