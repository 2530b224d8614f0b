"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, the budget is shared by weight, and no source may be repeated
more than `most` times: what a capped source cannot take is reshared among the others by
weight until none is above its cap. The closed form of that sharing needs one running total
over the sources in order of cap / weight. A document is then emitted floor(rate) times plus
once more if a hash of the seed, its id and its text falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stored
from .sharding import numbered


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with weight, cap and target; sources weigh in code-point order, null last.

    The windows without a key run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double").alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"), F.sum("source_size").over(Window.partitionBy()).alias("all_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("all_size") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return ranked.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy())).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def draw(id_col: str, digest_col: str, nth_col: str, seed: int) -> Column:
    """Uniform in [0, 1) from the seed, the id, the text's digest and the place among fully equal rows; the same on every run."""
    nth = F.when(F.col(nth_col) > 0, F.concat(F.lit(":"), F.col(nth_col).cast("string"))).otherwise(F.lit(""))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.col(digest_col), nth)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
#: Rows and bytes of keys up to which a table is broadcast; larger ones are joined by an exchange.
SMALL_ROWS, SMALL_BYTES = 1 << 17, 1 << 24
#: Rows of one cell when equal rows are numbered.
CELL_ROWS = 10_000


def _places(docs: DataFrame) -> list[tuple[str, str]]:
    """(name, name by place) of each column."""
    return [(c, f"in{i}") for i, c in enumerate(docs.columns)]


def _small(table: DataFrame, text_col: str | None = None) -> DataFrame:
    """A stored table, broadcast if it is of few rows and bytes."""
    size = F.sum(F.octet_length(text_col)) if text_col else F.lit(0)
    n, held = table.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(table) if n <= SMALL_ROWS and held <= SMALL_BYTES else table


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with nth: 0, or the place from 0 among those that agree in `key`. repeated: the keys of several rows.

    Only rows that repeat are written once and numbered, in cells whose counts are added up.
    """
    if repeated.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    keys = _small(repeated)
    again = stored(rows.join(keys, "key", "left_semi").withColumn("uid", F.monotonically_increasing_id()), "mix-again")
    cells = max(1, -(-again.count() // CELL_ROWS))
    again = numbered(again, "key", F.pmod(F.xxhash64("uid"), F.lit(cells)), ["uid"], "place").withColumn("nth", F.col("place").cast("long")).drop("uid", "place")
    return rows.join(keys, "key", "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(again)


def _drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The input's columns, named by place (in0, in1, ...) so that none clashes, and the added ones.

    They stay columns of their own: those that a caller does not ask for are not read. No text is
    exchanged while sources and keys of repeated rows are few enough for a broadcast.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    sized = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in _places(docs)], F.col(id_col).alias("id"), F.col(source_col).alias("own"), digest.alias("digest"), n_words(text_col).alias("mix_size")).withColumn("key", F.xxhash64("id", "own", "digest"))
    facts = stored(sized.groupBy("own", "key").agg(F.sum("mix_size").alias("size"), F.count("*").alias("n")), "mix-facts")
    sizes = facts.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = _small(stored(source_targets(sizes, weights, share, most), "mix-targets"), "source")
    rows = _numbered(sized, facts.where("n > 1").select("key").distinct())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    drawn = rows.join(targets, rows["own"].eqNullSafe(targets["source"])).withColumn("rate", rate)
    copies = (whole + (draw("id", "digest", "nth", seed) < F.col("rate") - whole).cast("long")).cast("long")
    return drawn.select(*[n for _, n in _places(docs)], "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"))


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """docs plus mix_size, mix_source_size, mix_target and mix_copies.

    Null or empty texts have size 0; a source of size 0 has target 0 and emits nothing. A null
    source is a source of its own. Each row draws a number of its own: from its id and text, and
    rows that agree in id, text and source are numbered, so rows without an id, repeated ids and
    repeated rows are mixed like any others (which of such equal rows is taken more often is not
    said if they differ in further columns). A text of any length counts whole. Of the input's columns only those of
    the four added names are replaced, any other name is kept as it is; an empty table gives no
    rows. Options are those of _drawn.
    """
    return _drawn(docs, **options).select(*[F.col(n).alias(c) for c, n in _places(docs) if c not in ADDED], *ADDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the input's columns, whatever their names, each row as often as the mix takes it."""
    out = _drawn(docs, **options).where("mix_copies > 0").select(*[n for _, n in _places(docs)], F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("nth"))
    return out.select(*[F.col(n).alias(c) for c, n in _places(docs)])
