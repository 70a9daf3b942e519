"""Exact deduplication by skew-safe combining.

Copies are merged three times, on the full content each time: inside every map
task (the partial aggregate), per salted digest group, and once more over the
winners of the salts. A group of copies, however large, reaches a reducer as at
most one row per map task and salt, and the last stage as one row per salt.
The class of a document is then looked up per (digest, salt), so a hot group is
spread over its salts there as well. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brickledger.llm.support import whole_text

SALTS = 32


def _salt(id_col: str, salts: int):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; null reads as empty. The largest id of a
    group stays. A row repeated with the same id counts each time in
    ``group_size`` and all its repetitions carry ``kept`` (``survivors`` returns
    one of them). Rows with a null id are members like any other and stay only
    when their group has no other id. An empty table gives an empty result.
    Other columns are not read, so their names do not matter.

    The three combines compare whole texts. The last lookup compares SHA-256,
    length and a second 64-bit hash, the texts themselves having been compared
    by then.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must be between 1 and 62")
    docs = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"),
                     _salt(id_col, salts).alias("salt"))
    keyed = docs.withColumn("text_sha256", F.sha2("text", 256))
    per_salt = keyed.groupBy("text_sha256", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    overall = per_salt.groupBy("text_sha256", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("held"))
    found = overall.select(
        "text_sha256", F.length("text").alias("chars"), F.xxhash64("text").alias("second"), "keep_id", "group_size",
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (held & shiftleft(1L, s)) != 0)")).alias("salt"))
    narrow = keyed.select("doc_id", "salt", "text_sha256", F.length("text").alias("chars"),
                          F.xxhash64("text").alias("second"))
    return narrow.join(found, ["text_sha256", "salt", "chars", "second"]).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, one per distinct text, with all columns of ``df`` in their order.

    Same stages as ``classes``, but the winning row itself travels: no join. Of
    rows with equal id and text the greatest by the other columns stays, so the
    result does not depend on how the input is split. A null text comes back as
    it was. The columns must be orderable (no maps).
    """
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("has"),
                   *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    keyed = df.select(whole_text(text_col).alias("text"), row.alias("row"), _salt(id_col, salts).alias("salt"))
    per_salt = keyed.groupBy(F.sha2("text", 256).alias("digest"), "salt", "text").agg(F.max("row").alias("row"))
    overall = per_salt.groupBy("digest", "text").agg(F.max("row").alias("row"))
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    place[id_col] = F.col("row.id")
    place[text_col] = F.when(F.col("row.has"), F.col("text"))
    return overall.select(*[place[c].alias(c) for c in df.columns])
