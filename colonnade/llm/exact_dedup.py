"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each task hashes its normalised texts to 48 bits and sends, to the owner of each hash range, the sorted distinct
   hashes of each file that it reads as a Golomb (Rice) code of their gaps, with a mark at those that it has twice.
2. An owner answers each message with a bitmap: which of its hashes another message has too, or this one twice. The
   answers stand by file in the shared folder.
3. The documents are read once more, a batch at a time. Each task looks up the answers of the files that it reads and
   sends on only suspects, one row per distinct text and batch. Grouping those rows by the text itself is the byte
   verification.

Files and rows are named by ``keyed``, so the two readings need not be cut into the same tasks. Equal texts meet as
one row per batch, so a group with a third of all rows is no load on one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PLACE_BITS, SPACE, cut, keyed, tune
from .exchange import HASH_BITS, among, exchange


def normalise(text: bytes | None) -> bytes:
    return bytes(text or b"").translate(None, SPACE)


def _fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[: HASH_BITS // 8], "big")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after ASCII white space is deleted; null counts as empty, and all empty texts
    are one group. Of a group the row with the most code points stays, then the smallest id (null last), then the
    first of repeated rows: exactly one row of a group has ``kept``. Very long texts move only where another text has
    their hash. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    id_type = docs.schema[doc_id].dataType
    rows = keyed(docs, F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text")).select("__row", "__id", "__text")

    def hashes(b):
        return b.column(0).to_numpy(), np.fromiter((_fingerprint(hashlib.sha256(normalise(x)).digest()) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)

    spool, answers = exchange(rows.select("__row", "__text"), hashes, rows.count())

    def mark(parts):
        for b in parts:
            keys, ids = b.column(0).to_numpy(), b.column(1)
            texts: dict[bytes, list] = {}
            for at, x in enumerate(b.column(2).to_pylist()):
                raw = bytes(x or b"")
                texts.setdefault(normalise(raw), []).append((len(raw.decode("utf-8", "replace")), at))
            plain, places = ids.to_pylist(), keys.tolist()
            out, found, file = [], [], []
            for x, members in texts.items():
                n, at = min(members, key=lambda m: (-m[0], plain[m[1]] is None, plain[m[1]] if plain[m[1]] is not None else 0, places[m[1]]))
                digest = hashlib.sha256(x)
                found.append(_fingerprint(digest.digest()))
                file.append(places[at] >> PLACE_BITS)
                out.append((digest.hexdigest(), x, n, at, places[at], [{"id": plain[m[1]], "key": places[m[1]]} for m in members]))
            sha, body, n, at, key, members = zip(*out) if out else ((),) * 6
            found, file = np.array(found, np.uint64), np.array(file, np.int64)
            suspect = np.array([len(m) > 1 for m in members], bool)
            for f in np.unique(file).tolist():
                suspect |= (file == f) & among(found, answers.of(f)[0])
            kind = pa.list_(pa.struct([("id", ids.type), ("key", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sha, pa.string()), pa.array(body, pa.binary(), mask=~suspect), pa.array(n, pa.int64()), ids.take(pa.array(at, pa.int64())), pa.array(key, pa.int64()), pa.array(members, kind)],
                ["text_sha256", "body", "n", "best_id", "best_key", "members"],
            )

    schema = T.StructType([
        T.StructField("text_sha256", T.StringType()), T.StructField("body", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("best_id", id_type), T.StructField("best_key", T.LongType()),
        T.StructField("members", T.ArrayType(T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType())]))),
    ])
    marked = cut(rows.mapInArrow(mark, schema))
    spool.drop()

    suspect = marked.filter("body is not null")
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("best_id").isNull().alias("no_id"), "best_id", "best_key"))
    verified = suspect.groupBy("text_sha256", "body").agg(F.sum(F.size("members")).alias("group_size"), first.alias("first"))
    verified = verified.groupBy("text_sha256").agg(F.count("*").alias("texts"), F.max("group_size").alias("group_size"), F.max("first").alias("first"))
    one_text = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("group_size"))
    verified = verified.select("text_sha256", one_text.alias("group_size"), "first")

    lone = marked.filter("body is null").select(
        F.col("best_id").alias(doc_id), F.col("best_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    grouped = suspect.drop("body", "n").join(verified, "text_sha256").withColumn("m", F.explode("members"))
    grouped = grouped.select(F.col("m.id").alias(doc_id), F.col("first.best_id").alias("keep_id"), "group_size", (F.col("m.key") == F.col("first.best_key")).alias("kept"), "text_sha256")
    return lone.unionByName(grouped)
