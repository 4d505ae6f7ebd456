"""Phrases that may go on: which tokens continue an open beginning of a phrase, and scores raised for them among the best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmeter.sources.session import written


def _longest(sequence: Column, phrase: Column) -> Column:
    """How many of a phrase's tokens, not all, the sequence ends with; null for none."""
    most = F.least(F.size(sequence), F.size(phrase) - 1)
    fits = F.filter(F.sequence(F.lit(1), most), lambda n: F.slice(sequence, -n, n) == F.slice(phrase, F.lit(1), n))
    return F.when(most >= 1, F.array_max(fits))


def candidates(sequence: Column, phrases: Column) -> Column:
    """Tokens that begin a phrase, or continue the longest beginning of one that the sequence ends with; in ascending order.

    For lists of phrases that fit a row; next_tokens() joins with a table of phrases.
    """
    firsts = F.transform(phrases, lambda p: F.get(p, F.lit(0)))
    later = F.transform(phrases, lambda p: F.get(p, _longest(sequence, p)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(firsts, later), lambda t: t.isNotNull())))


def open_states(sequence: Column, phrases: Column) -> Column:
    """array<array<struct<phrase, length>>>: after each token, the beginnings of phrases that are open, as an automaton's state."""
    kind = "array<struct<phrase:int,length:int>>"
    fresh = F.transform(phrases, lambda p, i: F.struct(i.cast("int").alias("phrase"), F.lit(0).alias("length")))

    def step(states: Column, token: Column) -> Column:
        last = F.coalesce(F.try_element_at(states, F.lit(-1)), F.array().cast(kind))
        goes_on = F.filter(F.concat(last, fresh), lambda s: F.get(F.get(phrases, s["phrase"]), s["length"]) == token)
        grown = F.transform(goes_on, lambda s: F.struct(s["phrase"].alias("phrase"), (s["length"] + 1).cast("int").alias("length")))
        unfinished = F.filter(grown, lambda s: s["length"] < F.size(F.get(phrases, s["phrase"])))
        return F.concat(states, F.array(F.array_sort(unfinished).cast(kind)))

    return F.aggregate(sequence, F.array().cast(f"array<{kind}>"), step)


def expected(state: Column, phrases: Column) -> Column:
    """The candidates of a state: each phrase's first token, and what follows its longest open beginning."""
    kept = F.filter(state, lambda s: ~F.exists(state, lambda o: (o["phrase"] == s["phrase"]) & (o["length"] > s["length"])))
    later = F.transform(kept, lambda s: F.get(F.get(phrases, s["phrase"]), s["length"]))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.transform(phrases, lambda p: F.get(p, F.lit(0))), later), lambda t: t.isNotNull())))


def best_tokens(scores: Column, k: int) -> Column:
    """Token ids (places from 0) of the k highest scores, of equal ones the smaller ids."""
    if k <= 0:
        raise ValueError("k must be above 0")
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])


def boosted(scores: Column, tokens: Column, bias: float = 0.8, k: int = 20) -> Column:
    """The scores, with `bias` added for those of the tokens that are among the k best; no other token is brought up."""
    if bias <= 0:
        raise ValueError("bias must be above 0")
    top = best_tokens(scores, k)
    return F.transform(scores, lambda x, i: x + F.when(F.array_contains(tokens, i) & F.array_contains(top, i), bias).otherwise(0.0))


def prefixes(phrases: DataFrame, phrase: str, tokens: str) -> DataFrame:
    """phrase, n, prefix, next: the edges of the phrases' trie, each beginning (also the empty one) with the token after it."""
    at = F.explode(F.sequence(F.lit(0), F.size(tokens) - 1)).alias("n")
    return phrases.where(F.size(tokens) > 0).select(phrase, tokens, at).select(phrase, "n", F.slice(tokens, F.lit(1), F.col("n")).alias("prefix"), F.get(tokens, F.col("n")).alias("next"))


def _border(beginning: Column) -> Column:
    """How long the longest beginning of a beginning is, not all of it, that it also ends with; null for none."""
    return _longest(beginning, beginning)


def _ends(df: DataFrame, col: str) -> DataFrame:
    """col, n, prefix: each end of the sequences, from one token to all."""
    at = df.where(F.size(col) > 0).select(col, F.explode(F.sequence(F.lit(1), F.size(col))).alias("n"))
    return at.select(col, "n", F.slice(col, -F.col("n"), F.col("n")).alias("prefix"))


def _followers(nodes: DataFrame, trie: DataFrame, totals: DataFrame) -> DataFrame:
    """node, later: the tokens that go on after a node of the trie (a beginning), each phrase counted at its longest open beginning.

    The beginnings that a node ends with are open. A token goes on after one of them if more phrases go through both than through
    the longer open beginnings right above it: those whose longest border it is, which share no phrase. So counts of phrases
    do, and no phrase meets a sequence by itself.
    """
    open_ = _ends(nodes, "node").join(totals, ["n", "prefix"])
    through = open_.select("node", "n", "prefix").join(trie, ["n", "prefix"]).select("node", "n", "next", "c")
    longer = open_.select("node", "prefix", (-F.col("c")).alias("c"), _border(F.col("prefix")).alias("n")).where("n is not null").select("node", "n", F.get("prefix", F.col("n")).alias("next"), "c")
    left = through.unionByName(longer).groupBy("node", "n", "next").agg(F.sum("c").alias("c")).where("c > 0")
    return left.groupBy("node").agg(F.collect_set("next").alias("later"))


def next_tokens(df: DataFrame, key: str, sequence: str, phrases: DataFrame, phrase: str, tokens: str) -> DataFrame:
    """key, candidates of each row, for a table of phrases of any size: ends of sequences meet the trie's beginnings by equality.

    What may follow depends on the longest beginning of a phrase that a sequence ends with alone, so each distinct end
    is looked up once, whatever rows and phrases share it.
    """
    trie = written(prefixes(phrases, phrase, tokens).groupBy("n", "prefix", "next").agg(F.count(F.lit(1)).alias("c")), "trie")
    inner = trie.where("n > 0")
    totals = inner.groupBy("n", "prefix").agg(F.sum("c").alias("c"))
    # The most tokens of a beginning: one row.
    longest = trie.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    kept = F.least(F.size(sequence), F.col("most"))
    rows = df.select(key, sequence).crossJoin(F.broadcast(longest)).select(key, F.when(kept > 0, F.slice(sequence, -kept, kept)).alias("tail"))
    reached = _ends(rows.select("tail").distinct(), "tail").join(totals.select("n", "prefix"), ["n", "prefix"])
    reached = written(reached.groupBy("tail").agg(F.max_by("prefix", "n").alias("node")), "reached")
    later = reached.join(_followers(reached.select("node").distinct(), inner, totals), "node").select("tail", "later")
    firsts = trie.where("n = 0").agg(F.collect_set("next").alias("firsts"))
    return rows.join(later, "tail", "left").crossJoin(F.broadcast(firsts)).select(key, F.array_sort(F.array_union(F.coalesce("later", F.slice("firsts", 1, 0)), "firsts")).alias("candidates"))
