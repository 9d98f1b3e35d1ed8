"""Log line parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneprep.functions.text import let, once, strip
from tuneprep.rules.terms import DICT_LINE, SAMPLE_BLOCK, SAMPLE_LIMITS
from tuneprep.schema import LOG_METRIC, TRAINER_ROW

STRICT = {"allowSingleQuotes": "false"}
PERMISSIVE = {"mode": "PERMISSIVE"}


def parsed_metrics(lines: DataFrame, line: str = "line") -> DataFrame:
    """Replace a line column by metric columns; lines without a metric are dropped.

    JSON with a loss comes first, then dictionary-style text. JSON is parsed once per line and
    the regular expression only sees lines that contain its literal part.
    """
    kept = [c for c in lines.columns if c != line]
    text = F.col("_text")
    no_loss = F.col("_json.loss").isNull() & F.contains(text, F.lit("'loss':"))

    def group(i: int) -> Column:
        return F.regexp_extract(text, DICT_LINE, i).try_cast("double")

    zero = F.lit(0.0)
    is_json = F.col("_json.loss").isNotNull()

    def pick(name: str, other: Column) -> Column:
        return F.when(is_json, F.coalesce(F.col(f"_json.{name}"), zero)).otherwise(other)


    def read(t: Column) -> Column:
        looks_json = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))
        parsed = F.from_json(F.when(looks_json, t), LOG_METRIC, STRICT)
        return F.struct(t.alias("_text"), parsed.alias("_json"))

    return (
        lines.select(*kept, once(strip(F.col(line)), read).alias("_r"))
        .select(*kept, "_r.*")
        .withColumn("_dict", F.when(no_loss, F.array(group(1), group(2), group(3))))
        .filter(is_json | F.col("_dict")[0].isNotNull())
        .select(
            *kept,
            pick("step", zero).cast("long").alias("step"),
            pick("epoch", F.col("_dict")[2]).alias("epoch"),
            pick("loss", F.col("_dict")[0]).alias("loss"),
            pick("learning_rate", F.col("_dict")[1]).alias("learning_rate"),
            pick("grad_norm", zero).alias("grad_norm"),
            pick("elapsed_seconds", zero).alias("elapsed_seconds"),
            F.when(is_json, "json").otherwise("text").alias("style"),
        )
    )


def trainer_row(line: Column) -> Column:
    """Struct of one trainer log row."""
    return F.from_json(line, TRAINER_ROW, PERMISSIVE)


def sample_blocks(log: Column, keep: int = 3, limits: dict[str, int] | None = None) -> Column:
    """Last prediction samples of a whole log text: step, input, predict, label.

    ``limits`` cuts the named texts to so many characters; without it they are whole.

    The text is searched once; only the kept samples are taken apart.
    """
    found = F.regexp_extract_all(log, F.lit(SAMPLE_BLOCK), F.lit(0))
    last = let(found, lambda f: F.slice(f, F.greatest(F.size(f) - (keep - 1), F.lit(1)), keep))

    def parts(sample: Column) -> Column:
        # No group can hold a quote, so a quote separates them safely.
        return F.split(F.regexp_replace(sample, SAMPLE_BLOCK, '$1"$2"$3"$4'), '"')

    def row(p: Column) -> Column:
        return F.struct(p[0].alias("step"), *[
            (F.substring(p[i], 1, limits[name]) if limits and name in limits else p[i]).alias(name)
            for i, name in enumerate(SAMPLE_LIMITS, 1)
        ])

    return F.transform(F.transform(last, parts), row)
