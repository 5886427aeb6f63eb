"""Cross-site boilerplate lines, found by how many distinct sites carry a line.

Built-in Spark functions only. Per line (two 64-bit hashes of the trimmed text)
one aggregation counts occurrences, merges HyperLogLog sketches of the sites and
keeps the first place. A line whose estimate lies clearly above the threshold is
boilerplate, one clearly below is not; lines near it get an exact distinct count.
Every occurrence of a boilerplate line but its first (smallest doc_id, then
position) goes, so that no text vanishes from the corpus altogether. Rows of null
doc_id lose lines like all others, and hold the first place of a line only if no
row of known doc_id has it (then by position and hash of the text).

Documents without a boilerplate line are told by a table of bits of the lines'
hashes, of bounded size, and pass by; only the others are joined with what they lose.

Lines of fewer than ``min_chars`` trimmed characters and null sites do not count.
Null texts stay null, and empty texts empty; a text may become empty. Rows that
repeat (same doc_id and text) are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import stored

KEY = ["__h1", "__h2"]
SLOTS = 1 << 17
# Tasks that share the rows of one common line in a join.
SALTS = 16


def _place():
    """Where a line stands, in order; null doc_ids come last and are told apart by their texts."""
    lost = F.col("__doc").isNull()
    return F.struct(lost.alias("lost"), "__doc", "__pos", F.when(lost, F.col("__row")).alias("row"))


def _lines(docs: DataFrame, text: str, site: str, min_chars: int) -> DataFrame:
    line = F.trim("__line")
    split = docs.select(
        F.col("doc_id").alias("__doc"),
        F.col(site).alias("__site"),
        F.xxhash64(text).alias("__row"),
        F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"),
    )
    return split.where(F.length(line) >= min_chars).select("__doc", "__site", "__row", "__pos", F.xxhash64(line).alias(KEY[0]), F.xxhash64(F.lit(1), line).alias(KEY[1]))


def _of_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` joined with ``found`` by line, the rows of a line dealt to ``SALTS`` tasks."""
    dealt = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("__doc", "__row", "__pos"), F.lit(SALTS)).cast("int")
    return lines.withColumn("__salt", salt).join(dealt, [*KEY, "__salt"]).drop("__salt")


def boilerplate(docs: DataFrame, min_sites: int = 10, min_chars: int = 16, text: str = "text", site: str = "source", lg_k: int = 12) -> DataFrame:
    """Hashes and first place of every line seen on ``min_sites`` sites or more, stored."""
    lines = _lines(docs, text, site, min_chars)
    found = lines.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.hll_sketch_estimate(F.hll_sketch_agg(F.col("__site").cast("string"), lg_k)).alias("sites"),
        F.min(_place()).alias("__first"),
    )
    # Three standard errors of the sketch around the threshold; n bounds the sites from above.
    margin = 3 * 1.04 / 2 ** (lg_k / 2)
    found = stored(found.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites * (1 - margin))), "lines")
    sure = F.col("sites") > min_sites * (1 + margin)
    near = found.where(~sure)
    # Dealt out by line and site after the join, so that a common line is not one task's work.
    pairs = _of_lines(lines, near.select(*KEY)).select(*KEY, "__site").repartition(*KEY, "__site").distinct()
    exact = pairs.groupBy(*KEY).agg(F.count("__site").alias("exact")).where(F.col("exact") >= min_sites)
    kept = found.where(sure).select(*KEY, "__first").unionByName(near.join(exact, KEY).select(*KEY, "__first"))
    return stored(kept, "boilerplate")


def _may_be_among(found: DataFrame, min_chars: int):
    """A test of a line that holds for every line in ``found`` and for few others: a bit per hash in ``SLOTS``."""
    slot = F.pmod(F.col(KEY[0]), F.lit(SLOTS))
    words = found.select(slot.alias("slot")).groupBy(F.expr("cast(slot div 32 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits"))
    bits = {r.word: r.bits for r in words.collect()}
    table = F.expr("array(" + ",".join(f"{bits.get(w, 0)}L" for w in range(SLOTS // 32)) + ")")

    def test(line):
        slot = F.pmod(F.xxhash64(F.trim(line)), F.lit(SLOTS)).cast("int")
        return (F.length(F.trim(line)) >= min_chars) & (F.getbit(F.get(table, F.shiftright(slot, 5)), slot % 32) == 1)

    return test


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, min_chars: int = 16, text: str = "text", site: str = "source", lg_k: int = 12) -> DataFrame:
    """``docs`` with those lines cut from ``text``, and columns n_lines and n_removed (replaced if there)."""
    found = boilerplate(docs, min_sites, min_chars, text, site, lg_k)
    gone = _of_lines(_lines(docs, text, site, min_chars), found).where(F.col("__first") != _place())
    gone = gone.groupBy(F.col("__doc").alias("__d"), F.col("__row").alias("__r")).agg(F.collect_set("__pos").alias("__gone"))
    parts = F.split(text, "\n", -1)
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines")
    asked = docs.withColumn("__asked", F.coalesce(F.exists(parts, _may_be_among(found, min_chars)), F.lit(False)))
    sure = asked.where("not __asked").select(*cols, n_lines, F.lit(0).cast("long").alias("n_removed"))
    asked = asked.where("__asked").withColumns({"__doc": F.col("doc_id"), "__row": F.xxhash64(text)})
    # The texts stream past a hash table of positions instead of being sorted.
    asked = asked.join(gone.hint("shuffle_hash"), F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left")
    cut = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed")
    return sure.unionByName(asked.select(*[cut.alias(c) if c == text else F.col(c) for c in cols], n_lines, removed))
