"""Known patterns: brick grammar, expansion to flat sequences, series, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.config import DEFAULT, Config
from seqloom.functions.chords import chord_masks, key_info
from seqloom.functions.series import resample
from seqloom.operators.ordered import Ordered, first_non_null, index_sequence, per_key, running
from seqloom.operators.projection import series_value, with_references
from seqloom.operators.similarity import nearest_within
from seqloom.session import ensure_checkpoint_dir

COMPONENT = "struct<kind:string,name:string,value:string,duration:string>"


def _strip(line: Column) -> Column:
    """Surrounding blanks, leading ``(`` and trailing ``)``."""
    return F.regexp_replace(F.trim(line), r"^\(+|\)+$", "")


def _rest(x: Column) -> Column:
    """All elements but the first."""
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def parse_grammar(blocks: DataFrame, text: str = "value") -> DataFrame:
    """Bricks from blank-line separated blocks, one block per row.

    Head line ``defbrick name(variant) mode type key``, then rows ``kind value duration`` or
    ``kind name value duration``; blocks starting with ``//`` and others are left out. Blanks
    inside parentheses do not separate.
    """
    lines = F.filter(F.transform(F.split(F.trim(text), "\n"), _strip), lambda x: x != "")
    b = (blocks.select(lines.alias("lines")).filter(F.get("lines", F.lit(0)).startswith("defbrick")))
    head = _rest(F.split(F.get("lines", F.lit(0)), " +"))
    b = b.withColumn("h", head).withColumn("label", F.array_join(F.slice("h", 1, F.greatest(F.size("h") - 3, F.lit(0))), ""))

    def component(line: Column) -> Column:
        inside = F.regexp_extract(line, r"\(([^)]*)\)", 1)
        x = F.split(F.when(inside != "", F.replace(line, inside, F.replace(inside, F.lit(" "), F.lit(""))))
                    .otherwise(line), " +")
        short = F.size(x) == 3
        return F.struct(F.get(x, F.lit(0)).alias("kind"),
                        F.when(~short, F.get(x, F.lit(1))).alias("name"),
                        F.when(short, F.get(x, F.lit(1))).otherwise(F.get(x, F.lit(2))).alias("value"),
                        F.when(short, F.get(x, F.lit(2))).otherwise(F.get(x, F.lit(3))).alias("duration"))

    variant = F.regexp_extract("label", r"\((.*?)\)", 1)
    return b.select(
        F.regexp_extract("label", r"^([^(]*)", 1).alias("name"),
        F.when(variant != "", variant).alias("variant"),
        F.element_at("h", -3).alias("mode"), F.element_at("h", -2).alias("block_type"),
        F.element_at("h", -1).alias("block_key"),
        F.transform(_rest(F.col("lines")), component).alias("components"))


def expand_bricks(bricks: DataFrame) -> DataFrame:
    """Replace every reference to a brick by the components of its variants.

    ``bricks(name, variant, components)``; a reference to a brick with several variants gives
    one sequence per variant. Each pass substitutes the first open reference of every sequence;
    every component carries the names it came from, a reference to one of them is a cycle and
    raises, a reference to a brick that does not exist gives no sequence. Rows ``(name, variant, choices, components)``.
    """
    ensure_checkpoint_dir(bricks.sparkSession)
    variants = bricks.select(F.col("name").alias("_ref"), F.coalesce("variant", F.lit("")).alias("_variant"),
                             F.col("components").alias("_sub"))
    path_of = "transform(components, c -> array(name))"
    open_rows = bricks.select("name", "variant", F.array().cast("array<string>").alias("choices"), "components",
                              F.expr(path_of).alias("paths"))
    done = None
    while True:
        first = "array_position(transform(components, c -> c.kind), 'brick')"
        marked = open_rows.withColumn("_at", F.expr(f"cast({first} as int)")).checkpoint()
        closed = marked.filter(F.col("_at") == 0).drop("_at")
        done = closed if done is None else done.unionByName(closed)
        rest = marked.filter(F.col("_at") > 0)
        if rest.isEmpty():
            return done.drop("paths")
        at, n = F.col("_at"), F.size("components")
        path = F.get("paths", at - 1)
        checked = F.when(F.array_contains(path, F.col("_ref")), F.raise_error(F.lit("bricks refer to each other in a cycle"))
                         ).otherwise(F.array_append(path, F.col("_ref")))
        open_rows = (rest.withColumn("_ref", F.get("components", at - 1)["name"]).join(variants, "_ref")
                     .select("name", "variant", F.concat("choices", F.array(F.concat_ws("/", "_ref", "_variant"))).alias("choices"),
                             F.concat(F.slice("components", 1, at - 1), "_sub",
                                      F.slice("components", at + 1, n)).alias("components"),
                             F.concat(F.slice("paths", 1, at - 1), F.array_repeat(checked, F.size("_sub")),
                                      F.slice("paths", at + 1, n)).alias("paths")))


def known_sequences(rows: DataFrame) -> Ordered:
    """Flat sequences ``(label, ord, chord, duration, key)`` with times and comparison chords.

    Sequences of one chord are left out, ``*`` counts as a duration of 1.
    """
    seq = index_sequence(rows, ("label",), ("ord",))
    seq = per_key(seq, {"n_chords": F.count(F.lit(1))})
    ticks = F.replace("duration", F.lit("*"), F.lit("1")).cast("bigint")
    seq = seq.with_df(seq.df.filter(F.col("n_chords") > 1).withColumn("ticks", ticks))
    seq = running(seq, {"t1": ("sum", "ticks")})
    seq = seq.with_df(seq.df.withColumns({
        "t0": F.col("t1") - F.col("ticks"), "cm": chord_masks("chord"), "km": key_info("key")}))
    seq = per_key(seq, {"gk": F.min_by("km", "pos"), "global_key": F.min_by("key", "pos")})
    return with_references(seq)


def known_series(seq: Ordered, kind: str) -> DataFrame:
    """``(label, n_chords, ts)`` of known sequences; patterns are short by nature."""
    ticks = (seq.df.withColumn("v", series_value(kind)).filter(F.col("t1") > F.col("t0"))
             .select("label", "n_chords", "v", F.explode(F.sequence(F.col("t0"), F.col("t1") - 1)).alias("t")))
    return ticks.groupBy("label", "n_chords").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("ts"))


def coverage(segments: DataFrame, known: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """How many known patterns of each length occur among the segments.

    ``segments(id, ts, *by)``, ``known(label, n_chords, ts, *by)``. A pattern is covered if some
    segment lies within the distance threshold after resampling; its nearest one gives the
    distance. Columns ``by`` keep several segmentations apart in one pass.
    """
    size = cfg.resampling_size
    # grouped by their hash first: a sort of arrays compares them element by element
    targets = (segments.select(*by, "id", resample(F.col("ts"), size).alias("tx")).withColumn("hash", F.xxhash64("tx"))
               .groupBy("hash", *by, "tx").agg(F.min("id").alias("id"))
               .select(*by, "tx", F.array(F.struct(*by, "id")).alias("ids")))
    sources = known.select(*by, F.struct(*by, "label").alias("source"), resample(F.col("ts"), size).alias("sx"))
    near = (nearest_within(sources, targets, 1, cfg.dist_threshold, by=by)
            .select(*[F.col(f"source.{c}").alias(c) for c in (*by, "label")], "distance"))
    return (known.select(*by, "label", "n_chords").join(near, [*by, "label"], "left").groupBy(*by, "n_chords")
            .agg(F.count(F.lit(1)).alias("n_patterns"), F.count("distance").alias("n_covered"),
                 F.round(F.count("distance") / F.count(F.lit(1)), 6).alias("coverage"),
                 F.round(F.avg("distance"), 6).alias("mean_distance")))
