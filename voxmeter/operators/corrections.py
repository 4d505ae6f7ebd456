"""Corrections of transcripts by vocabularies: spans one character away from a word become the word, longest spans first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.functions.text import grams

#: Lengths of the spans that a correction tries, longest first.
SPANS = (4, 3, 2)


def _forms(c: Column) -> Column:
    """A word's forms with one character left open, with the place and the character of each."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.struct(F.concat(F.substr(c, F.lit(1), i - 1), F.lit("*"), F.substr(c, i + 1)).alias("form"), i.alias("place"), F.substr(c, i, F.lit(1)).alias("char")))


def span_words(spans: DataFrame, span: str, vocabulary: DataFrame, word: str, pairs: DataFrame, sounds: dict[str, str] | None = None) -> DataFrame:
    """span, word: the word that each span becomes, if a word differs from it in one character and the pair (wrong, right) is known.

    Words with a pair of equal sound come first, then those that differ later, then the smaller ones. Spans and words meet by
    their forms with one character left open, so none meets a word that isn't near.
    """
    have = spans.select(span).distinct().select(span, F.inline(_forms(F.col(span)))).select(span, "form", "place", F.col("char").alias("wrong"))
    want = vocabulary.where(F.length(word).between(min(SPANS), max(SPANS))).select(word).distinct().select(word, F.inline(_forms(F.col(word)))).select(word, "form", "place", F.col("char").alias("right"))
    near = have.join(want, ["form", "place"]).where("wrong <> right").join(pairs.select("wrong", "right").distinct(), ["wrong", "right"])
    of = F.create_map(*[F.lit(x) for kv in (sounds or {"": ""}).items() for x in kv])
    alike = F.coalesce(F.try_element_at(of, F.col("wrong")) == F.try_element_at(of, F.col("right")), F.lit(False))
    return near.groupBy(span).agg(F.min_by(word, F.struct(~alike, -F.col("place"), F.col(word))).alias(word))


def replaced(text: Column, found: Column) -> Column:
    """A text with spans (place from 1, size, word) replaced: from left to right, at a place the longest, none over another."""
    start = F.struct(F.lit(1).alias("free"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fits = s["place"] >= a["free"]
        out = F.concat(a["out"], F.substr(text, a["free"], s["place"] - a["free"]), s["word"])
        return F.struct(F.when(fits, s["place"] + s["size"]).otherwise(a["free"]).cast("int").alias("free"), F.when(fits, out).otherwise(a["out"]).alias("out"))

    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["place"].cast("int").alias("place"), (-s["size"]).cast("int").alias("_k"), s["size"].cast("int").alias("size"), s["word"].alias("word"))))
    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substr(text, a["free"])))


def fuzzy_corrected(df: DataFrame, key: str, text: str, vocabulary: DataFrame, word: str, pairs: DataFrame, sounds: dict[str, str] | None = None) -> DataFrame:
    """key, before, after, changes (place, word): texts with spans of 4 to 2 characters put right (see span_words and replaced).

    Null texts are empty. Distinct spans are looked up once, whatever number of texts hold them; a text's own spans, at most
    three for each of its characters, come back together.
    """
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("before"))
    spans = None
    for n in SPANS:
        each = rows.select(key, F.posexplode(grams(F.col("before"), n)).alias("place", "span")).withColumn("size", F.lit(n))
        spans = each if spans is None else spans.unionByName(each)
    told = spans.join(span_words(spans, "span", vocabulary, word, pairs, sounds).withColumnRenamed(word, "word"), "span")
    found = told.groupBy(key).agg(F.collect_list(F.struct((F.col("place") + 1).alias("place"), "size", "word")).alias("found"))
    none = F.array().cast("array<struct<place:int,size:int,word:string>>")
    held = rows.join(found, key, "left").withColumn("found", F.coalesce("found", none))
    after = replaced(F.col("before"), F.col("found"))
    changes = F.filter(F.transform(F.sequence(F.lit(1), F.length("before")), lambda i: F.struct(i.alias("place"), F.substr("before", i, F.lit(1)).alias("was"), F.substr("after", i, F.lit(1)).alias("is"))), lambda c: c["was"] != c["is"])
    return held.withColumn("after", after).select(key, "before", "after", F.when(F.length("before") > 0, changes).otherwise(F.array().cast("array<struct<place:int,was:string,is:string>>")).alias("changes"))
