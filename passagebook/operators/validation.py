"""Data rules for chunks, vectors and transcriptions.

The rules of a row are one array column, exploded to issue rows (row_id, level, field,
message, value). Every rule is a built-in expression, so a check is one narrow scan, and
reports count all rows rather than a sample unless a sample is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebook.functions.text import strip
from passagebook.functions.vectors import has_bad_value, has_vector, norm
from passagebook.settings import Settings

ERROR, WARNING = "error", "warning"
_ISSUE = "struct<level:string,field:string,message:string,value:string>"

# The texts of the issues. {} is filled in per row.
MISSING_FIELD = "Missing required field: {}"
CONTENT_TOO_SHORT = "Content too short ({} chars)"
CONTENT_TOO_LONG = "Content too long ({} chars)"
CONTENT_BLANK = "Content is empty or whitespace-only"
NEGATIVE_INDEX = "Chunk index cannot be negative"
NO_EMBEDDING = "Embedding is null or empty"
WRONG_DIMENSION = "Wrong embedding dimension: {}, expected {}"
NORM_TOO_SMALL = "Embedding norm too small: {}"
NORM_TOO_LARGE = "Embedding norm too large: {}"
BAD_VALUES = "Embedding contains NaN or Inf values"
TEXT_TOO_SHORT = "Transcription text is very short"
DURATION_NOT_POSITIVE = "Duration must be positive"
DURATION_TOO_LONG = "Duration unusually long"


def _filled(text: str, *values: Column) -> Column:
    return F.format_string(text.replace("{}", "%s"), *values)


def _issue(when: Column, level: str, field: str, message, value: Column | None = None) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    shown = F.lit(None).cast("string") if value is None else value.cast("string")
    body = F.struct(
        F.lit(level).alias("level"), F.lit(field).alias("field"), text.alias("message"), shown.alias("value")
    )
    return F.when(F.coalesce(when, F.lit(False)), body)


def _collect(rules: list[Column]) -> Column:
    return F.array_compact(F.array(*rules)).cast(f"array<{_ISSUE}>")


def _absent(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(True)
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def chunk_rules(df: DataFrame, settings: Settings | None = None) -> Column:
    s = settings or Settings()
    rules = [
        _issue(_absent(df, name), ERROR, name, MISSING_FIELD.format(name))
        for name in ("chunk_id", "document_id", "content")
    ]
    if "content" in df.columns:
        text, n = F.col("content"), F.length("content")
        rules += [
            _issue((n > 0) & (n < s.min_chunk_length), WARNING, "content", _filled(CONTENT_TOO_SHORT, n), n),
            _issue(n > s.max_chunk_length, WARNING, "content", _filled(CONTENT_TOO_LONG, n), n),
            _issue((n > 0) & (strip(text) == ""), ERROR, "content", CONTENT_BLANK),
        ]
    if "chunk_index" in df.columns:
        index = F.col("chunk_index")
        rules.append(_issue(index < 0, ERROR, "chunk_index", NEGATIVE_INDEX, index))
    return _collect(rules)


def embedding_rules(vector: Column, settings: Settings | None = None, name: str = "embedding") -> Column:
    """Rules for one vector; a null or empty one has that single issue.

    A NaN norm passes no threshold, so such a vector is only reported for its values.
    """
    s = settings or Settings()
    there = F.coalesce(has_vector(vector), F.lit(False))
    n = F.when(there, F.size(vector))
    length = F.when(there, norm(vector))
    known = ~F.isnan(length)
    shown = F.format_string("%.4f", length)
    wrong = _filled(WRONG_DIMENSION, n, F.lit(s.embedding_dimension))
    return _collect(
        [
            _issue(~there, ERROR, name, NO_EMBEDDING),
            _issue(n != s.embedding_dimension, ERROR, name, wrong, n),
            _issue(known & (length < s.min_embedding_norm), WARNING, name, _filled(NORM_TOO_SMALL, shown), length),
            _issue(known & (length > s.max_embedding_norm), WARNING, name, _filled(NORM_TOO_LARGE, shown), length),
            _issue(there & has_bad_value(vector), ERROR, name, BAD_VALUES),
        ]
    )


def transcription_rules(df: DataFrame, settings: Settings | None = None) -> Column:
    s = settings or Settings()
    rules = [
        _issue(_absent(df, name), ERROR, name, MISSING_FIELD.format(name))
        for name in ("transcription_id", "text")
    ]
    if "text" in df.columns:
        n = F.length("text")
        rules.append(_issue((n > 0) & (n < s.min_text_length), WARNING, "text", TEXT_TOO_SHORT, n))
    if "duration_seconds" in df.columns:
        d = F.col("duration_seconds")
        rules += [
            _issue(~F.isnan(d) & (d <= 0), ERROR, "duration_seconds", DURATION_NOT_POSITIVE, d),
            _issue(~F.isnan(d) & (d > s.max_duration_seconds), WARNING, "duration_seconds", DURATION_TOO_LONG, d),
        ]
    return _collect(rules)


def issues(df: DataFrame, rules: Column, row_id: str) -> DataFrame:
    """One row per issue; a row without an id is 'unknown'."""
    who = F.coalesce(F.col(row_id).cast("string"), F.lit("unknown")) if row_id in df.columns else F.lit("unknown")
    return df.select(who.alias("row_id"), F.inline(rules))


def validate_chunks(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    return issues(df, chunk_rules(df, settings), "chunk_id")


def validate_embeddings(
    df: DataFrame, settings: Settings | None = None, vector: str = "embedding", row_id: str = "chunk_id"
) -> DataFrame:
    return issues(df, embedding_rules(F.col(vector), settings), row_id)


def validate_transcriptions(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    return issues(df, transcription_rules(df, settings), "transcription_id")


def issue_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("level", "field").agg(F.count(F.lit(1)).alias("n_issues"))


def issue_head(found: DataFrame, n: int = 100) -> DataFrame:
    """The first issues of a report, in the order of row, field, level and message."""
    return found.orderBy("row_id", "field", "level", "message").limit(n)


def errors(found: DataFrame) -> DataFrame:
    return found.filter(F.col("level") == ERROR)


def warnings(found: DataFrame) -> DataFrame:
    return found.filter(F.col("level") == WARNING)


def _reports(
    df: DataFrame, settings: Settings | None, vector: str, fraction: float | None, seed: int
) -> DataFrame:
    """One row with the structs `chunks` and `embeddings`, from one pass over the table.

    A report that is not selected costs nothing: its sums are pruned.
    """
    s = settings or Settings()
    own = chunk_rules(df, s)
    if vector in df.columns:
        there = F.coalesce(has_vector(F.col(vector)), F.lit(False))
        of_vector = F.when(there, embedding_rules(F.col(vector), s)).otherwise(_no_issues())
    else:
        there, of_vector = F.lit(False), _no_issues()
    picked = F.lit(True) if fraction is None else F.rand(seed) < fraction
    marked = df.withColumn("_picked", picked).select(
        "_picked",
        there.alias("_there"),
        F.when(F.col("_picked"), F.concat(own, of_vector)).alias("_all"),
        F.when(F.col("_picked"), of_vector).alias("_vector"),
    )

    def bad(column):
        return F.exists(column, lambda i: i["level"] == ERROR)

    def total(column):
        return F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("bigint")

    there, picked = F.col("_there"), F.col("_picked")
    counts = marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(there).alias("embedded"),
        F.count_if(picked).alias("checked_c"),
        F.count_if(picked & ~bad("_all")).alias("good_c"),
        total(F.when(picked, F.col("_all"))).alias("issues_c"),
        F.count_if(there & picked).alias("checked_e"),
        F.count_if(there & picked & ~bad("_vector")).alias("good_e"),
        total(F.when(picked, F.col("_vector"))).alias("issues_e"),
    )
    share = F.when(F.col("total") > 0, F.col("embedded") / F.col("total")).otherwise(0.0)
    few = (share < s.min_coverage).cast("bigint")
    return counts.select(
        _report("chunks", "total", "checked_c", "good_c", F.col("issues_c")).alias("chunks"),
        _report(
            "embeddings", "embedded", "checked_e", "good_e", F.col("issues_e") + few,
            F.col("embedded"), share,
        ).alias("embeddings"),
    )


def _no_issues() -> Column:
    return F.array().cast(f"array<{_ISSUE}>")


def _report(
    name: str,
    population: str,
    checked: str,
    good: str,
    found: Column,
    embedded: Column | None = None,
    coverage: Column | None = None,
) -> Column:
    """Report struct; the good rows among those checked are scaled to the population."""
    n, seen, fine = F.col(population), F.col(checked), F.col(good)
    scaled = F.when(seen == n, fine).when(seen > 0, F.floor(n * (fine / seen))).otherwise(n).cast("bigint")
    return F.struct(
        F.lit(name).alias("report"),
        F.col("total").alias("total_records"),
        seen.alias("checked_records"),
        scaled.alias("valid_records"),
        (n - scaled).alias("invalid_records"),
        found.alias("issue_count"),
        (fine == seen).alias("is_valid"),
        (F.lit(None).cast("bigint") if embedded is None else embedded).alias("embedded_records"),
        (F.lit(None).cast("double") if coverage is None else coverage).alias("coverage"),
    )


def chunk_quality_report(
    df: DataFrame,
    settings: Settings | None = None,
    vector: str = "embedding",
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row: total, valid and invalid rows, issues, verdict.

    The vector rules apply to rows that have a vector. With `fraction`, rules run on a
    sample and valid_records is scaled to all rows.
    """
    rows = _reports(df, settings, vector, fraction, seed).select("chunks.*")
    return rows.drop("embedded_records", "coverage")


def embedding_coverage(
    df: DataFrame,
    settings: Settings | None = None,
    vector: str = "embedding",
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row: total and embedded rows, their share, and the vector rules on the embedded.

    Coverage below the least share counts as one warning.
    """
    return _reports(df, settings, vector, fraction, seed).select("embeddings.*")


def rag_data_report(
    df: DataFrame,
    settings: Settings | None = None,
    vector: str = "embedding",
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Both reports on one table, one row each, from one scan."""
    both = F.array("chunks", "embeddings")
    return _reports(df, settings, vector, fraction, seed).select(F.inline(both))
