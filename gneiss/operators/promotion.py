"""Documents that a query names come first: those that hold its text, or elements whose reference it gives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items of an automaton, characters of each that make it up, and characters that are compared in place: at most 2**23 characters are sent.
PACK, ANCHOR, SHOWN = 1 << 14, 64, 512

# Fixed patterns of references in a query.
CODE = r"(?:[A-Z]{1,5}-\d+(?:\.\d+)?(?:-\d+)?(?:\([a-z0-9]+\))?|[0-9]{1,2}-[0-9]+(?:\.\d+)?(?:\([a-z]\))?)"
TABLE_REF, ANY_REF = rf"(?i)\bTable\s+({CODE})\b", rf"(?i)\b({CODE})\b"


def _packs(asked: DataFrame, size: int) -> list[list[tuple[int, str, bool]]]:
    """The items' first characters in lists of at most ``size``, each fetched by itself; twice as many lists where one is too long."""
    rows, n = asked.count(), 1
    while rows:
        n = max(n, -(-rows // size))
        dealt = asked.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))
        largest = dealt.groupBy("pack").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0]
        if largest <= size:
            shown = dealt.select("pack", "query_id", F.substring("item", 1, SHOWN).alias("shown"), (F.length("item") <= SHOWN).alias("whole"))
            packs = ([(r["query_id"], r["shown"], r["whole"]) for r in shown.filter(F.col("pack") == i).collect()] for i in range(n))
            return [pack for pack in packs if pack]
        n *= 2
    return []


def holders(docs: DataFrame, queries: DataFrame, size: int = PACK) -> DataFrame:
    """``query_id, doc_id``: all documents whose text holds the query's text character by character.

    ``docs``: doc_id, text; ``queries``: query_id, text; an empty or null query is held by none.  One pass over the texts finds all
    items of a pack: an automaton over their first ``ANCHOR`` characters runs along each text and tells where one may begin.  What is sent has a
    bound: a pack has at most ``size`` items and ``SHOWN`` characters of each; more items are more packs, each a pass over the texts.
    Items that are longer meet the texts in which their first characters were found, in a join.
    """
    spark = docs.sparkSession
    asked = queries.filter("text <> ''").select(F.col("query_id").cast("long").alias("query_id"), F.col("text").alias("item"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    out = None
    for pack in _packs(asked, size):
        sent = spark.sparkContext.broadcast(pack)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            begins: dict[str, list[tuple[int, str, bool]]] = {}
            for query_id, shown, whole in sent.value:
                begins.setdefault(shown[:ANCHOR], []).append((query_id, shown, whole))
            automaton = ahocorasick.Automaton()
            for anchor, items in begins.items():
                automaton.add_word(anchor, (len(anchor), items))
            automaton.make_automaton()
            for b in batches:
                found = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    text, met = text.as_py(), {}
                    for end, (length, items) in automaton.iter(text):
                        for query_id, shown, whole in items:
                            if query_id not in met and text.startswith(shown, end + 1 - length):
                                met[query_id] = whole
                    found += [(q, doc_id, whole) for q, whole in met.items()]
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["query_id", "doc_id", "whole"])

        one = rows.mapInArrow(find, "query_id long, doc_id long, whole boolean")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.select(F.lit(0).cast("long").alias("query_id"), "doc_id").limit(0)
    if asked.filter(F.length("item") > SHOWN).isEmpty():
        return out.select("query_id", "doc_id").distinct()
    begun = out.filter("not whole").join(asked, "query_id").join(rows, "doc_id").filter("contains(text, item)")
    return out.filter("whole").select("query_id", "doc_id").unionByName(begun.select("query_id", "doc_id")).distinct()


def named_references(queries: DataFrame, *keys: str) -> DataFrame:
    """``query_id, keys, ref, as_table``: the references that a query gives, in upper case, each once; ``as_table``: after the word "Table"."""
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1)), F.upper))
    told = lambda as_table: lambda ref: F.struct(ref.alias("ref"), F.lit(as_table).alias("as_table"))
    each = F.concat(F.transform(found(TABLE_REF), told(True)), F.transform(found(ANY_REF), told(False)))
    return queries.select("query_id", *keys, F.inline(each))


def by_reference(queries: DataFrame, elements: DataFrame, *keys: str) -> DataFrame:
    """``query_id, keys, doc_id, priority, place``: the elements that a query names: tables by their id first, then sections by their reference, each in the order of the corpus.

    ``queries``: query_id, text; ``elements``: element_id, element_type, table_id, paragraph_ref, ord.  With ``keys``, columns of both in
    which they must agree: a query then names elements of its own corpus.  One equi-join on the reference; the index is a row for each element that can be named.
    """
    one = lambda col, t: F.struct(F.upper(col).alias("ref"), F.lit(t).alias("as_table"), F.lit(0 if t else 1).alias("priority"))
    # An element can be named in both ways; elements are read once.
    ways = F.array(F.when(F.col("table_id").isNotNull(), one("table_id", True)), F.when((F.col("element_type") == "section") & F.col("paragraph_ref").isNotNull(), one("paragraph_ref", False)))
    index = elements.select(*keys, F.col("element_id").alias("doc_id"), F.col("ord").alias("place"), F.inline(F.array_compact(ways)))
    met = named_references(queries, *keys).join(index, [*keys, "ref", "as_table"])
    return met.groupBy("query_id", *keys, "doc_id").agg(F.min("priority").alias("priority"), F.min("place").alias("place"))


def promote(ranked: DataFrame, named: DataFrame) -> DataFrame:
    """``query_id, doc_id, score, origin, rank``: the documents a query names (``query_id, doc_id, priority, place``) first, each with at least score 1, then the ranking."""
    told = ranked.select("query_id", "doc_id", "score", F.lit(99).alias("priority"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("named"))
    told = told.unionByName(named.select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), "priority", "place", F.lit(True).alias("named")))
    # Rows meet by their query, in one shuffle for all three windows; the first two share an order.
    told = told.repartition("query_id").withColumn("by_name", F.max("named").over(W.partitionBy("query_id", "doc_id"))).withColumn("high", F.max("score").over(W.partitionBy("query_id")))
    told = told.filter("named or not by_name")
    score = F.when(F.col("named"), F.greatest(F.coalesce("high", F.lit(1.0)), F.lit(1.0))).otherwise(F.col("score"))
    out = told.select("query_id", "doc_id", score.alias("score"), "priority", "place", F.when(F.col("named"), "exact_ref").otherwise("hybrid").alias("origin"))
    order = W.partitionBy("query_id").orderBy("priority", "place", F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).drop("priority", "place")
