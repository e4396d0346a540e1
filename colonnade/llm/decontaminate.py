"""Benchmark decontamination by a distributed positional inverted index. DataFrame and SQL functions only.

The frequencies of all benchmark terms in the training documents are counted first; of each window of an item only the
two rarest terms get postings (term, document, position). A phrase is looked up by intersecting the two lists, moved
back by the terms' places in the window; a proximity match by intersecting them within a reach. Only at the places that
are left the other words are read and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Spool, cut, keyed, small

#: Separators in the text before it is lower-cased: the complement of digits, letters and all beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE = 10
#: Other words that may stand among those of a window for a proximity match.
SLOP = 5


def _split(text: Column | str) -> Column:
    """Words of a text, with an empty first or last element where it begins or ends with separators."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SEPARATORS, -1)


def _lower(word: str) -> Column:
    """A-Z in lower case, other letters as they are."""
    w = F.col(word)
    return F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))


def n_words(text: Column | str) -> Column:
    p = _split(text)
    n = F.size(p) - (F.element_at(p, 1) == "").cast("int") - (F.element_at(p, -1) == "").cast("int")
    return F.greatest(n, F.lit(0)).cast("long")


def words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word) of all words, positions from 0."""
    parts = rows.select(key, _split(text).alias("__p"))
    out = parts.select(key, (F.element_at("__p", 1) == "").cast("int").alias("__lead"), F.posexplode("__p").alias("__i", "__w"))
    return out.filter("__w <> ''").select(key, (F.col("__i") - F.col("__lead")).alias("pos"), _lower("__w").alias("word"))


class Index:
    """Postings of the two rarest terms of each window of a benchmark in the training documents, in the shared folder until ``drop()``."""

    #: Copies of a list of windows by term that is too large to be broadcast: the postings of one term go to so many tasks.
    SALTS = 32
    #: Words that stand in one row of the join that reads the words around a place.
    STRETCH = 32

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = PHRASE, text: str = "text"):
        """``docs`` and ``items`` have a key column ``__row`` and a text."""
        self.texts = docs.select("__row", text)
        item_words = cut(words(items, "__row", text).withColumnRenamed("__row", "item"))
        self.terms = cut(item_words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")))
        self.windows = cut(self._windows(item_words, size))
        pivots = self.windows.groupBy("item", "p1", "p2").agg(F.first("t1").alias("t1"), F.first("t2").alias("t2"))
        self.pivots = cut(pivots.withColumn("pivot", F.monotonically_increasing_id()))
        wanted = self.pivots.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null").distinct()
        self._spool = Spool(self._tokens(self.texts).join(small(cut(wanted)), "term", "left_semi"), "postings")
        self.postings = self._spool.read()

    def drop(self) -> None:
        self._spool.drop()

    def _tokens(self, texts: DataFrame) -> DataFrame:
        """(row, pos, term) of the words of texts that some item has."""
        found = words(texts, "__row", texts.columns[-1]).withColumnRenamed("__row", "row")
        return found.join(small(self.terms, 80), "word").select("row", "pos", "term")

    def _windows(self, item_words: DataFrame, size: int) -> DataFrame:
        """(item, start, size, terms in order, t1 and t2: the rarest terms, p1 and p2: their places in the item) of each run of
        ``size`` words of an item, or of a shorter item as a whole; without those that have a term that no document has."""
        frequencies = cut(self._tokens(self.texts).groupBy("term").agg(F.count("*").alias("n")))
        known = item_words.join(self.terms, "word").join(frequencies, "term", "left").select("item", "pos", "term", "n")
        lengths = known.groupBy("item").agg(F.count("*").alias("length"))
        starts = known.join(lengths, "item").selectExpr("item", "pos", "term", "n", f"least(length, {size}) as size", "length")
        # the windows that a word is in
        each = starts.withColumn("start", F.explode(F.expr("sequence(greatest(0, pos - size + 1), least(pos, length - size))")))
        out = each.groupBy("item", "start").agg(F.first("size").alias("size"), F.count("n").alias("known"), F.array_sort(F.collect_list(F.struct("pos", "term", "n"))).alias("words"))
        out = out.filter("known = size").withColumn("ranked", F.array_sort(F.transform("words", lambda w: F.struct(w["n"], w["pos"], w["term"]))))
        return out.selectExpr("item", "start", "size", "words.term as terms", "ranked[0].term as t1", "ranked[0].pos as p1", "get(ranked, 1).term as t2", "get(ranked, 1).pos as p2")

    def _places(self, which: str) -> DataFrame:
        """(row, pivot, p1, p2, pos) of the postings of a pivot's first or second term."""
        pivots = self.pivots.filter(f"{which} is not null")
        if pivots.count() * 60 <= common.BROADCAST_BYTES:
            found = self.postings.join(F.broadcast(pivots), F.col("term") == F.col(which))
        else:
            salted = pivots.withColumn("salt", F.explode(F.expr(f"sequence(0, {self.SALTS - 1})")))
            postings = self.postings.withColumn("__salt", F.pmod(F.xxhash64("row", "pos"), F.lit(self.SALTS)).cast("int"))
            found = postings.join(salted, (F.col("term") == F.col(which)) & (F.col("__salt") == F.col("salt")))
        return found.select("row", "pivot", "p1", "p2", "pos")

    def matches(self, slop: int | None = None) -> DataFrame:
        """(row, item, start, size, at, exact, near) of windows at places of their rarest terms.

        ``exact``: the window's words stand at ``at`` and on. ``near``, where ``slop`` is given: all words of the window,
        as often as it has them, stand in any order within some stretch of size + slop words with the two rarest in it.
        """
        first = self._places("t1").withColumnRenamed("pos", "a")
        second = self._places("t2").selectExpr("row", "pivot", "p1", "p2", "pos as b")
        alone = first.filter("p2 is null").selectExpr("row", "pivot", "a", "a as b", "a - p1 as diagonal")
        if slop is None:
            pairs = first.selectExpr("row", "pivot", "a", "a - p1 as diagonal").join(second.selectExpr("row", "pivot", "b", "b - p2 as diagonal"), ["row", "pivot", "diagonal"]).select("row", "pivot", "a", "b", "diagonal")
        else:
            # places less than a reach apart are in the same stretch of that many words or in neighbouring ones
            reach = self.windows.agg(F.max("size")).first()[0] or 0
            reach += slop
            left = first.withColumn("g", F.explode(F.expr(f"sequence(a div {reach} - 1, a div {reach} + 1)")) if reach else F.lit(0))
            right = second.selectExpr("row", "pivot", "b", f"b div {max(reach, 1)} as g", "p2 as q2")
            pairs = left.join(right, ["row", "pivot", "g"]).filter(f"a <> b and abs(a - b) < {max(reach, 1)}")
            pairs = pairs.selectExpr("row", "pivot", "a", "b", "if(a - p1 = b - q2, a - p1, null) as diagonal")
        pairs = cut(pairs.unionByName(alone))
        windows = self.windows.join(self.pivots.select("item", "p1", "p2", "pivot"), (self.windows["item"] == self.pivots["item"]) & (self.windows["p1"] == self.pivots["p1"]) & self.windows["p2"].eqNullSafe(self.pivots["p2"]))
        windows = windows.select("pivot", self.windows["item"], "start", "size", "terms")
        width = "size" if slop is None else f"(size + {slop})"
        places = pairs.join(windows, "pivot").filter(f"abs(a - b) < {width}").withColumn("at", F.expr("diagonal + start"))
        # the words that can be in one stretch with both places
        region = ("at as lo", "at + size - 1 as hi") if slop is None else (f"greatest(a, b) - {width} + 1 as lo", f"least(a, b) + {width} - 1 as hi")
        places = places.filter("at >= 0") if slop is None else places
        places = cut(places.selectExpr("row", "item", "start", "size", "terms", "a", "b", "at", *region))
        rows = cut(places.select(F.col("row").alias("__row")).distinct())
        tokens = self._tokens(self.texts.join(small(rows, 8), "__row", "left_semi")).withColumn("g", F.expr(f"pos div {self.STRETCH}"))
        spread = places.withColumn("g", F.explode(F.expr(f"sequence(greatest(lo, 0) div {self.STRETCH}, hi div {self.STRETCH})")))
        met = spread.join(tokens, ["row", "g"]).filter("pos between lo and hi and array_contains(terms, term)")
        found = met.groupBy("row", "item", "start", "size", "terms", "a", "b", "at").agg(F.collect_list(F.struct("pos", "term")).alias("found"))
        exact = "at is not null and forall(sequence(0, size - 1), i -> exists(found, x -> x.pos = at + i and x.term = terms[i]))"
        near = f"""exists(found, x -> forall(terms, t -> size(filter(found, y -> y.term = t and y.pos >= x.pos and y.pos < x.pos + {width}))
          >= size(filter(terms, u -> u = t))))"""
        out = found.selectExpr("row", "item", "start", "size", "at", f"{exact} as exact", f"{'false' if slop is None else near} as near")
        return out.filter("exact or near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", slop: int | None = None) -> DataFrame:
    """One row per row of ``docs``: __row, doc_id, n_words, n_hit (words inside an occurrence of a window), items (their ids as sorted strings).

    A window is ``size`` consecutive words of an item, or all words of a shorter one that has any; null texts and
    texts of separators have no words and no windows. With ``slop``, ``near`` has the ids of the items with a window
    whose words all stand in some stretch of size + slop words, in any order; where a window occurs it is near, too.
    Rows of the benchmark with equal ids are one item in ``items``, a null id is the empty string; repeated documents
    are rows of their own; very long texts are rows of words like others; empty tables give no rows or no hits; other
    columns, whatever their names, are not read.
    """
    rows = keyed(docs, F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    items = cut(keyed(benchmark, F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")))
    index = Index(rows.select("__row", "text"), items.select("__row", "text"), size)
    named = cut(index.matches(slop).join(items.select(F.col("__row").alias("item"), "id"), "item"))
    index.drop()
    exact = named.filter("exact")
    # distinct positions and items first: a document is one row per word or item before it is one row
    covered = exact.select("row", F.explode(F.expr("sequence(at, at + size - 1)")).alias("pos")).distinct()
    covered = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    none = F.expr("cast(array() as array<string>)")

    def listed(found: DataFrame, name: str) -> DataFrame:
        return found.select("row", "id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("id")).alias(name))

    hits = covered.join(listed(exact, "items"), "row")
    if slop is not None:
        hits = listed(named, "near").join(hits, "row", "left")
    hits = cut(hits)
    out = rows.select("__row", "__id", n_words("text").alias("n_words")).join(small(hits, 200), F.col("__row") == F.col("row"), "left")
    lists = [F.coalesce(x, none).alias(x) for x in ("items", "near") if x in hits.columns]
    return out.select("__row", F.col("__id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), *lists)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    names = docs.columns
    bad = cut(decontaminate(docs, benchmark, size, doc_id, text).filter("n_hit > 0").select("__row"))
    return keyed(docs, *[f"`{c}`" for c in names]).join(small(bad, 8), "__row", "left_anti").select([f"`{c}`" for c in names])
