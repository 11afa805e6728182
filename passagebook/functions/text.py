"""Column expressions on text: words, ids, previews, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as space.
SPACE = " \t\n\r\x0b\x0c"
SPACE_RUN = "[ \\t\\n\\r\\x0B\\f]+"
NOT_SPACE = "[^ \\t\\n\\r\\x0B\\f]"

MAP_STRING = "map<string,string>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Words between runs of space; no empty words at the ends."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def token_count(text: Column) -> Column:
    return F.size(words(text))


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the UTF-8 bytes."""
    return F.substring(F.sha2(text, 256), 1, 16)


def document_id(path: Column) -> Column:
    return short_hash(path)


def chunk_id(doc: Column, index: Column, content: Column) -> Column:
    """Stable id from the document, the position and the head of the content."""
    return short_hash(
        F.concat_ws(":", doc, index.cast("string"), F.substring(content, 1, 100))
    )


def keyword_score(query: Column, content: Column) -> Column:
    """Share of the distinct query words that occur in the content, 0 for a blank query."""
    asked = word_set(query)
    found = F.size(F.array_intersect(asked, word_set(content)))
    return found / F.greatest(F.size(asked), F.lit(1))


def preview(content: Column, limit: int = 200) -> Column:
    cut = F.concat(F.substring(content, 1, limit), F.lit("..."))
    return F.when(F.length(content) > limit, cut).otherwise(content)


def parse_metadata(metadata: Column) -> Column:
    """JSON object as a string map; anything else is an empty map."""
    empty = F.create_map().cast(MAP_STRING)
    return F.coalesce(F.from_json(metadata, MAP_STRING), empty)


def overlay(base: Column, own: Column) -> Column:
    """Both maps in one; on a shared key the second wins."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(kept, own)


def metadata_json(metadata: Column) -> Column:
    """Map as JSON text with its keys in order."""
    pairs = F.sort_array(F.map_entries(metadata))
    return F.to_json(F.map_from_entries(pairs))
